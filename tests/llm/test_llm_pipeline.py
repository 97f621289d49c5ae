"""The corpus pipeline: every stage against a plain version of it, on its own input."""

import hashlib
from collections import Counter

import pytest
from brute import LOWER, SCHEMA, awkward, components, words
from conftest import SMALL

import corpus_pipeline
from tabwright.llm import bpe, toxicity


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage over the small tables."""
    seen, docs = [], spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, docs, SMALL), f"test-{name}")
        seen.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in seen}


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "bpe"]
    for name, (before, after) in stages.items():
        if name != "bpe":
            assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    chain = toxicity.train_toxicity(before, toxicity.learned_labels(spark, SMALL))
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(before, chain).collect()}
    assert {r[0] for r in rows(after)} == {i for i, s in scores.items() if s < 0.7}


def test_copies_go(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for r in rows(before):
        key = (r[1] or "").translate(LOWER)
        best[key] = max(best.get(key, r), r, key=lambda x: x[0])
    assert sorted(rows(after)) == sorted(best.values())


def test_near_copies_go(stages):
    before, after = stages["ngram_join"]
    found = components({r[0]: r[1] for r in rows(before)})
    assert {r[0] for r in rows(after)} == {c for _, c in found.values()}


def test_mix_repeats_documents_by_rate(stages):
    before, after = stages["mixing"]
    have, given = Counter(rows(after)), rows(before)
    assert set(have) <= set(given) and max(have.values()) <= 2
    total = sum(len(words(r[1])) for r in given)
    taken = sum(len(words(r[1])) * n for r, n in have.items())
    assert taken == pytest.approx(1.5 * total, rel=0.1)


def test_texts_are_encoded(stages):
    tokenizers = pytest.importorskip("tokenizers")
    from tabwright.llm import bpe

    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    before, after = stages["bpe"]
    texts = {r[0]: r[1] for r in rows(before)}
    got = after.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows(before))
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["token_ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_chains_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in got.collect()) == sorted(
        (r["doc_id"], r["ids_sha256"]) for r in stages["bpe"][1].collect()
    )


def test_awkward_and_no_rows(spark):
    for table in (spark.createDataFrame(awkward(), SCHEMA), spark.createDataFrame([], SCHEMA)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.count() <= 2 * table.count()


def test_digests_are_of_the_encoded_columns(spark):
    """Columns of the user with the names of helper columns stay what they are."""
    rows = [(1, "hello", [7], "hello world", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, decoded string, token_ids array<int>, text string, n_tokens int")
    for keep in (True, False):
        got = bpe.digests(bpe.encode_documents(docs, bpe.default_path()), keep_ids=keep).first().asDict()
        assert (got["decoded"], got["token_ids"], got["n_tokens"]) == ("hello", [7], 9)
        assert got["decoded_sha256"] == hashlib.sha256(b"hello world").hexdigest()
        assert got["n_tokens_"] == 2 and ("token_ids_" in got) == keep
