"""Fingerprints, secrets, BPE and the n-gram join against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from brute import LONG, SCHEMA, awkward, components, shingles
from conftest import SMALL

import corpus_pipeline
from tabwright.llm import bpe, fingerprints, frequent, mixing, ngram_join, secret_scan
from tabwright.llm import components as stars


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# ---- fingerprints ----


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_follow_descending_ids(spark, texts):
    got = {r["doc_id"]: r for r in corpus_pipeline.LLM_QUERIES["op2_fingerprints"](spark, SMALL).collect()}
    ids = sorted(texts, reverse=True)
    assert len(got) == len(ids)
    for i, following in zip(ids, ids[1:] + ids[:1], strict=True):
        text, after = texts[i], texts[following]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_edited"] == pytest.approx(jaccard(shingles(text), shingles(edited)), abs=0.2)
        assert got[i]["near_next"] == pytest.approx(jaccard(shingles(text), shingles(after)), abs=0.2)


def test_edits_of_awkward_rows(odd, spark):
    got = fingerprints.fingerprint_edits(odd).collect()
    assert len(got) == odd.count()
    prints = {}
    for r in got:
        prints.setdefault(r["doc_id"], r)
    assert prints[3]["fingerprint"] == prints[4]["fingerprint"] and prints[5]["fingerprint"] == prints[6]["fingerprint"]
    assert prints[0]["fingerprint"] == "" and prints[0]["near_edited"] == 1.0
    assert prints[12]["n_chars"] == len(LONG)
    single = spark.createDataFrame([(1, "abcd", "en", "s", 0)], SCHEMA)
    (row,) = fingerprints.fingerprint_edits(single).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and row["near_next"] == 1.0
    assert fingerprints.fingerprint_edits(odd.limit(0)).count() == 0
    assert fingerprints.fingerprint(odd.withColumnRenamed("lang", "fingerprint")).columns[-1] == "fingerprint_"


def test_sketches_estimate_and_merge():
    a = " ".join(f"a{i}" for i in range(3000))
    b = " ".join(f"a{i}" for i in range(1500, 4500))
    x, y, both = fingerprints.sketches([a, b, a + " " + b])
    assert fingerprints.distinct_count(x) == pytest.approx(2996, rel=0.3)
    assert fingerprints.resemblance(x, y) == pytest.approx(jaccard(shingles(a), shingles(b)), abs=0.12)
    assert fingerprints.containment(x, y) == pytest.approx(0.5, abs=0.17)
    merged = fingerprints.merge(x, y)
    assert np.isin(merged, both).mean() > 0.95  # but for the few shingles across the seam
    assert (fingerprints.unpacked(fingerprints.packed(x)) == x).all()
    repeated = fingerprints.sketches(["p q r s t u " * 5000])[0]
    assert len(repeated) == 6 == fingerprints.distinct_count(repeated)


# ---- secrets ----

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def plain_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


SECRETS = [
    'é PassWord = "abc_def1" and token:12345 token: 123456', "AKIA" + "A" * 15, "AKIA" + "B" * 16 + " AKIAAKIA" + "C" * 14, "f" * 23 + " " + "0a" * 12,
    "API_KEY=" + "ab" * 20, "apikey :'x.y.z=='", "ſecret = abcdefgh", "toKen=abcdefg", "password password=secret=token=abcdef", "x" * 50_000 + "passwd=hunter22",
]


def test_secrets_match_a_plain_search(spark, texts):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*SECRETS, *texts.values(), None, ""])]
    found = secret_scan.scan_secrets(spark.createDataFrame(rows, SCHEMA), secret_scan.BASE).collect()
    for r in found:
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"]) == plain_spans(r["text"]), r["text"]
    digests = {r["doc_id"]: r for r in corpus_pipeline.LLM_QUERIES["op4_secrets"](spark, SMALL).collect()}
    for i, t in texts.items():
        assert digests[i]["base_sha256"] == hashlib.sha256(plain_spans(t).encode()).hexdigest()


def test_secret_scan_of_no_rows_and_taken_names(odd):
    assert secret_scan.scan_secrets(odd.limit(0)).count() == 0
    assert secret_scan.scan_secrets(odd.withColumnRenamed("lang", "spans")).columns[-1] == "spans_"


def test_trigram_queries_lose_no_match():
    made = {
        "assign": "API_KEY = 'zzzzzz'", "access": "AKIA" + "Z" * 16, "hex": "0" * 24, "github": "ghp_" + "a" * 36, "slack": "xoxb-0123456789",
        "google": "AIza" + "b" * 35, "pem": "-----BEGIN RSA PRIVATE KEY-----", "jwt": "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + ".c", "login": "://u:p@",
    }
    for rule in secret_scan.BASE + secret_scan.MORE:
        text = made[rule.kind]
        assert re.search(rule.pattern, text, re.ASCII), rule.kind
        query = secret_scan.trigram_query(rule.pattern)
        low = text.lower().encode()

        def holds(q, low=low):
            if isinstance(q, bytes):
                return q in low
            return all(map(holds, q[1])) if q[0] == "and" else any(map(holds, q[1]))

        assert holds(query), (rule.kind, query)
        assert (query == secret_scan.ANY) == (rule.kind == "hex")


# ---- BPE ----


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer.from_file(bpe.default_path())
    made.no_truncation()
    made.no_padding()
    return made


def test_bpe_equals_the_library(spark, library, texts):
    random.seed(3)
    letters = ["aeiou tnsh", "abc \n\t'", "éèüß漢字  😀", "0123 .,!", "aaaa", " ", "'s't're"]
    made = ["".join(random.choice(random.choice(letters)) for _ in range(random.randint(0, 60))) for _ in range(1500)]
    made += [*texts.values(), LONG, "a" * 3001, "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", ""]
    model = bpe.ByteBpe(bpe.default_path())
    for text, right in zip(made, library.encode_batch(made, add_special_tokens=False), strict=True):
        ids = np.frombuffer(model.encode(text), np.int32)
        assert ids.tolist() == right.ids, text[:80]
        assert model.decode(ids).decode() == library.decode(right.ids, skip_special_tokens=False)


def test_bpe_query_and_awkward_rows(spark, library, odd, texts):
    for r in corpus_pipeline.LLM_QUERIES["op6_bpe"](spark, SMALL).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    coded = bpe.encode_documents(odd.withColumnRenamed("lang", "token_ids"), bpe.default_path())
    assert coded.columns[-2:] == ["token_ids_", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in coded.collect())
    assert bpe.encode_documents(odd.limit(0), bpe.default_path()).count() == 0


# ---- n-gram join ----


def test_components_equal_all_pairs(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in corpus_pipeline.LLM_QUERIES["op10_ngram_join"](spark, SMALL).collect()}
    assert got == components(texts)


def _family(seed, n, edits):
    """Random edits of one text: some links, chains of links, near misses."""
    draw = random.Random(seed)
    base = [f"b{seed}_{i}" for i in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(len(w))] = f"e{draw.randrange(50)}"
        out.append(" ".join(w))
    return out


def test_families_chains_and_passages(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(60))
    made = _family(1, 60, 6) + _family(2, 40, 4) + [passage + " " + " ".join(f"u{k}_{i}" for i in range(25)) for k in range(120)]
    rows = {1000 - 3 * i: t for i, t in enumerate(made)}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows.items()], SCHEMA)
    right = components(rows)
    assert len({c for _, c in right.values()}) > 120
    for block, run in ((ngram_join.BLOCK, ngram_join.SMALL_RUN), (16, 4)):  # the second cuts buckets and grows trees
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "SMALL_RUN", run)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()}
        assert got == right


def test_tree_join_is_complete():
    draw = np.random.default_rng(5)
    centres = draw.poisson(3, (12, 64))
    points = np.maximum(0, centres[draw.integers(0, 12, 400)] + draw.integers(-1, 2, (400, 64)) * (draw.random((400, 64)) < 0.1)).astype(np.int32)
    sizes = points.sum(axis=1)
    tree = ngram_join.RTree(points, sizes, np.arange(400))
    found = {(min(i, j), max(i, j)) for a, b in ngram_join.tree_join(tree, tree) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i != j}
    common = np.minimum(points[:, None], points[None]).sum(axis=2)
    allowed = np.triu(7 * common >= 3 * (sizes[:, None] + sizes[None]), 1)
    assert found >= set(zip(*map(list, np.nonzero(allowed)), strict=True))
    assert len(found) < 400 * 399 / 4


def test_join_of_awkward_rows(spark, odd):
    got = {}
    for r in ngram_join.ngram_components(odd).collect():
        got.setdefault(r["doc_id"], (r["n_shingles"], r["component_id"]))
    right = components({r[0]: r[1] for r in awkward() if r[0] is not None})
    assert {k: v for k, v in got.items() if k is not None} == right
    assert got[None][1] is None
    kept = ngram_join.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) == {c for _, c in right.values()} | {None}
    assert ngram_join.ngram_components(odd.limit(0)).count() == 0
    assert ngram_join.drop_near_duplicates(odd.limit(0)).count() == 0


def family(n, seed=5):
    """Near copies of one text with one word changed each: they link to some of each other only."""
    rng = random.Random(seed)
    base = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        text = list(base)
        text[rng.randrange(60)] = f"other{i}"
        rows.append((i, " ".join(text)))
    return rows


def test_a_family_costs_pairs_in_proportion(spark, monkeypatch):
    per_row = []
    for n in (300, 1200):
        counts, write = {}, ngram_join.stored

        def counted(df, label, counts=counts, write=write):
            table = write(df, label)
            if label in ("likely", "fresh", "verified"):
                counts[label] = counts.get(label, 0) + table.count()
            return table

        monkeypatch.setattr(ngram_join, "stored", counted)
        rows = family(n)
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        monkeypatch.setattr(ngram_join, "stored", write)
        per_row.append((counts["likely"] + counts["fresh"]) / n)
        assert counts["verified"] <= 12 * n
        if n == 300:
            assert got == {i: c for i, (_, c) in components(dict(rows)).items()}
        else:
            assert len(set(got.values())) == 1
    assert max(per_row) <= 40 and per_row[1] <= 1.3 * per_row[0]


def jobs_of(spark, run):
    """What ``run`` returns and the number of Spark jobs it started."""
    spark.sparkContext.setJobGroup(group := f"jobs-{random.random()}", "counted")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_least_count_takes_a_job_a_page(spark, monkeypatch):
    counted = spark.createDataFrame([(c,) for c in range(1, 61) for _ in range(1 + c % 3)], "c long").repartition(4)
    for page, most in ((4096, 50), (7, 50), (7, 0), (7, 10_000), (60, 10_000)):
        monkeypatch.setattr(frequent, "PAGE", page)
        held = [c for c in range(1, 61) if sum(1 + x % 3 for x in range(c, 61)) <= most]
        got, jobs = jobs_of(spark, lambda most=most: frequent.least_count(counted, most))
        assert got == min(held, default=None)
        assert page != 4096 or jobs <= 3


def test_labels_stand_for_the_links_they_come_from(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    right = {i: i for pair in links for i in pair if pair[0] != pair[1]}
    for _ in right:
        for x, y in links:
            if x != y:
                right[x] = right[y] = min(right[x], right[y])

    def found(df):
        return stars.components(df).select("node", "component")

    whole = spark.createDataFrame(links, "a long, b long")
    assert {tuple(r) for r in found(whole).collect()} == set(right.items())
    first = found(spark.createDataFrame(links[:90], "a long, b long")).toDF("a", "b")
    again = found(first.unionByName(spark.createDataFrame(links[90:], "a long, b long")))
    assert {tuple(r) for r in again.collect()} == set(right.items())


def test_components_go_on_from_labels(spark, monkeypatch):
    sizes, write = [], stars.stored
    monkeypatch.setattr(stars, "stored", lambda df, label: sizes.append((table := write(df, label)).count()) or table)
    found = ngram_join.ngram_components(spark.createDataFrame(family(200), "doc_id long, text string"))
    assert found.select("component_id").distinct().count() == 1
    assert max(sizes[1:]) < sizes[0] and sizes[-2:] == [199, 199]  # labels, not all links found so far, are what later rounds add to


def test_sources_are_ranked_once(spark):
    docs = spark.createDataFrame([(i, f"s{i % 5}" if i % 5 else None, "a b c") for i in range(40)], "doc_id long, source string, text string")
    table, jobs = jobs_of(spark, lambda: mixing.source_targets(docs))
    _, more = jobs_of(spark, lambda: table.collect())
    assert more == 1  # a scan of the written table
    assert {(r["source"], r["source_size"], r["weight"]) for r in table.collect()} == {
        ("s1", 24, 3.0), ("s2", 24, 1.0), ("s3", 24, 2.0), ("s4", 24, 3.0), (None, 24, 1.0)
    }


def test_spanning_pairs_join_what_all_pairs_join():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 80, 4000), rng.integers(0, 80, 4000)
    a, b = a[a != b], b[a != b]
    for forests in (1, 2, 5):
        kept = ngram_join.spanning(a, b, forests)
        assert len(np.unique(np.concatenate([a, b]))) - 1 <= kept.sum() <= forests * 79
        parent = list(range(80))
        for x, y in zip(a[kept], b[kept]):
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            parent[x] = y
        assert sum(parent[x] == x for x in np.unique(np.concatenate([a, b]))) == 1
