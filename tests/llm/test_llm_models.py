"""Language model, toxicity and quality: plain counts, closed forms and held-out accuracy."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import SCHEMA, awkward, words
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from tabwright.llm import language_model, quality, toxicity
from tabwright.llm.labelled import sample_ids

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}


# ---- language model ----


def plain_base(texts, is_train):
    """Per document: tokens, known tokens, training tokens, base score."""
    counts, ends = Counter(), 0
    for i, t in texts:
        if is_train(i):
            counts.update(words(t))
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    bottom = total + 0.1 * (distinct + 1)
    out = []
    for i, t in texts:
        seen = [counts[w] for w in words(t)] + [ends]
        out.append((i, len(seen), sum(c > 0 for c in seen), total, sum(math.log10((c + 0.1) / bottom) for c in seen)))
    return out


def test_base_scores_and_gain(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in corpus_pipeline.LLM_QUERIES["op5_lm"](spark, SMALL).collect()}
    for i, n, known, total, base in plain_base(rows, lambda i: zlib.crc32(str(i).encode()) % 10 != 0):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_words_beyond_the_head_are_joined(spark, odd, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 40)
    got = language_model.score_texts(odd, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))).collect()
    right = plain_base([(r[0], r[1]) for r in awkward()], lambda i: i is not None and i % 2 == 0)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    found = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    for a, b in zip(found, sorted(right, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
    assert language_model.score_texts(odd.limit(0), F.lit(True)).count() == 0
    assert language_model.score_texts(odd, F.lit(False)).count() == odd.count(), "without training texts"


def test_every_training_text_serves_one_round(spark, monkeypatch):
    rows = [(i if i % 3 else None, f"text {i}") for i in range(300)]
    texts = spark.createDataFrame(rows, "id long, text string")
    seen = []

    def collected(part, counts, table, k):
        seen.append(sorted(r["text"] for r in part.collect()))
        return table

    monkeypatch.setattr(language_model, "_trained", collected)
    counts = language_model.summarise(language_model.count_words(texts), 300)
    language_model.train_model(texts, counts, F.col("id"))
    assert sorted(t for part in seen for t in part) == sorted(t for _, t in rows)
    assert all(any(int(t.split()[1]) % 3 == 0 for t in part) for part in seen), "null ids in every round"


def test_the_512_commonest_words_are_told_apart(spark):
    texts = spark.createDataFrame([(" ".join(f"word{i}" for i in range(n)),) for n in range(1, 601)], "text string")
    counts = language_model.summarise(language_model.count_words(texts), 600)
    common = np.argsort(-counts.counts, kind="stable")[:512]
    assert len(set(counts.classes[common])) == 512 and counts.classes[common].max() < counts.model.words


def some_classes(n=3000):
    """Classes of a vocabulary whose ranks follow a power law."""
    c = np.maximum(5, (50_000 / np.arange(1, n + 1)).astype(np.int64))
    draw = np.random.default_rng(1)
    return language_model.classes_of(draw.integers(0, language_model.ENDINGS, n), c, draw.integers(1, 900, language_model.ENDINGS), 500)


def test_groups_hold_every_word_once():
    order, model = some_classes()
    assert sorted(order) == list(range(3000)) and (np.diff(model.bounds) > 0).all()
    assert model.words == 3000 and model.first_classes < 400, "two levels are far smaller than one"
    assert np.bincount(model.group, model.share[: len(model.group)]) == pytest.approx(1.0)
    assert language_model.classes_of(np.zeros(0, int), np.zeros(0, int), np.zeros(32), 0)[1].words == 0, "no words"


def test_probabilities_sum_to_one():
    _, model = some_classes()
    table = language_model.first_parameters(model)
    every = np.arange(model.end + 1)
    context = np.tile([3, model.end - 2, model.start, 2999], (len(every), 1))
    logs = language_model.Scorer(table, model).log_probabilities(context, every)
    assert (10.0**logs).sum() == pytest.approx(1.0, rel=1e-4)


def test_noise_contrastive_steps_learn_both_levels():
    draw = np.random.default_rng(0)
    _, model = some_classes()
    trainer = language_model.Trainer(language_model.first_parameters(model), model, 0)
    context = np.tile(draw.integers(0, 8, (2000, 1)), (1, language_model.PLACES))
    for shift in (20, 70):  # first-level classes; words of one group
        target = context[:, 0] + shift
        before = language_model.Scorer(trainer.table, model).log_probabilities(context, target).mean()
        for _ in range(100):
            trainer.learn(context, target)
        after = language_model.Scorer(trainer.table, model).log_probabilities(context, target).mean()
        assert after > before + 1.0, "the context decides"


def plain_score(text, table, counts, of_word):
    """log10 probability of a text: a loop over tokens with an explicit softmax at both levels."""
    m = counts.model
    seen, outer, inner, place = (x.astype(float) for x in language_model.parts(table, m))
    tokens = [of_word(w) for w in words(text)]
    past, out = [m.start] * language_model.PLACES, 0.0
    for c, share in [*tokens, (m.end, 0.0)]:
        h = np.append(sum(seen[p] * place[k] for k, p in enumerate(past)), 1.0)
        first = outer @ h
        out += (first[m.first[c]] - math.log(sum(math.exp(x) for x in first))) / math.log(10)
        if m.single <= c < m.words:
            g = m.group[c - m.single]
            own = inner[m.bounds[g] : m.bounds[g + 1]] @ h
            out += (own[c - m.bounds[g]] - math.log(sum(math.exp(x) for x in own))) / math.log(10)
        out += share
        past = [c, *past[:-1]]
    return out


def test_scores_equal_a_plain_softmax_and_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 20_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    kept = {}
    train = language_model.train_model

    def remembered(texts, counts, key):
        kept["counts"], kept["table"] = counts, train(texts, counts, key)
        return kept["table"]

    monkeypatch.setattr(language_model, "train_model", remembered)
    results = []
    for n in (2, 8):
        scored = language_model.score_texts(docs.repartition(n), F.col("doc_id") % 10 != 0)
        results.append({r["doc_id"]: r["score"] for r in scored.collect()})
    assert results[0].keys() == results[1].keys()
    for i, score in results[0].items():
        assert results[1][i] == pytest.approx(score, rel=1e-5)

    counts, table = kept["counts"], kept["table"]
    assert counts.model.words > language_model.SINGLE, "groups are in use"
    rows = docs.collect()
    seen = Counter(w for r in rows if r["doc_id"] % 10 for w in words(r["text"]))

    def of_word(w):
        (h,), _ = language_model.word_ids(pa.array([w]))
        (c,), _, _ = counts.look_up(np.array([h]))
        return c, 0.0 if c < counts.model.words else counts.within(seen[w], int(h) % language_model.ENDINGS)

    for r in rows[:40]:
        assert results[1][r["doc_id"]] == pytest.approx(plain_score(r["text"], table, counts, of_word), rel=1e-4)


# ---- toxicity ----


def test_marginals_equal_enumeration():
    draw = np.random.default_rng(2)
    counts = np.array([5, 0, 1, 7])
    first = toxicity._firsts(counts)
    emission, moves, start = draw.normal(0, 1, counts.sum()), draw.normal(0, 1, (2, 2)), draw.normal(0, 1, 2)
    f, b, _ = toxicity.marginals(emission, first, moves, start)
    got = toxicity.posterior(f, b)
    at = 0
    for n in counts:
        total, toxic = 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=int(n)):
            value = start[states[0]] if n else 0.0
            value += sum(emission[at + k] for k in range(n) if states[k]) + sum(moves[p, q] for p, q in zip(states, states[1:], strict=False))
            total += math.exp(value)
            toxic += math.exp(value) * np.array(states, float)
        assert got[at : at + n] == pytest.approx(toxic / total)
        at += n


def test_toxicity_on_held_out_documents(spark, labels):
    got = [r for r in corpus_pipeline.LLM_QUERIES["op8_toxicity"](spark, MIDDLE).collect() if r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == labels[r["doc_id"]]["toxic"] for r in held]) > 0.93
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)


def test_toxic_spans_are_code_points(spark):
    clean = "élan vital öde bread water stone river hill cloud grass"
    rows = [(i, f"{clean} {'vile' if i % 2 else 'fine'} filler{i} 漢字", "en", "s", 0) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    tags = spark.createDataFrame([(i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    chain = toxicity.train_toxicity(docs, tags)
    fresh = spark.createDataFrame([(1, "ÉÉ vile, vile 漢 " + clean, "en", "s", 0), (2, clean, "en", "s", 0), (3, None, "en", "s", 0)], SCHEMA)
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(fresh, chain).collect()}
    assert [tuple(s) for s in scored[1]["toxic_spans"]] == [(3, 13)]
    assert scored[1]["toxicity"] > 0.7 > scored[2]["toxicity"] and scored[3]["toxicity"] < 0.7
    assert {r["doc_id"] for r in toxicity.drop_toxic(fresh, chain).collect()} == {2, 3}


def test_toxicity_of_awkward_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train_toxicity(odd, none)
    taken = odd.withColumnRenamed("lang", "toxicity")
    scored = toxicity.score_toxicity(taken, chain)
    assert scored.columns[-2:] == ["toxicity_", "toxic_spans"] and scored.count() == odd.count()
    assert toxicity.drop_toxic(odd, chain).count() == odd.count(), "nothing was learned, nothing is rejected"
    assert toxicity.drop_toxic(odd.limit(0), chain).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    tags = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    chosen = sample_ids(tags, "toxic", "doc_id", 300)
    sizes = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    assert all(200 < n < 400 for n in sizes.values())
    assert chosen.exceptAll(sample_ids(tags.repartition(5), "toxic", "doc_id", 300)).count() == 0


# ---- quality ----


def test_quality_on_held_out_documents(spark, labels):
    got = [r for r in corpus_pipeline.LLM_QUERIES["op9_quality"](spark, MIDDLE).collect() if r["doc_id"] in labels]
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == labels[r["doc_id"]]["quality"] for r in held]) > 0.95


def test_ranking_orders_pairs():
    draw = np.random.default_rng(1)
    x = draw.normal(0, 1, (400, 5))
    y = (x @ np.array([2.0, -1.0, 0.0, 0.0, 0.5]) + draw.normal(0, 0.3, 400) > 0).astype(int)
    strength = x @ quality.bradley_terry(x, y)
    assert np.mean(strength[y == 1][:, None] > strength[y == 0][None, :]) > 0.95


def test_features_do_not_depend_on_the_batch():
    texts = [r[1] for r in awkward()]
    together = quality.text_features(pa.array(texts, pa.string()))
    alone = np.concatenate([quality.text_features(pa.array([t], pa.string())) for t in texts])
    assert together == pytest.approx(alone)


def test_quality_of_awkward_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ranking = quality.train_quality(odd, none)
    scored = quality.score_quality(odd, ranking)
    assert {r["quality_score"] for r in scored.collect()} == {0.5}
    assert quality.keep_best(scored, 0.1).filter("selected").count() == odd.count(), "ties at the quantile stay"
    assert quality.keep_best(scored.limit(0), 0.5).count() == 0
    graded = spark.range(1000).select(F.col("id"), (F.col("id") / 1000).alias("quality_score"))
    assert quality.keep_best(graded, 0.2).filter("selected").count() == pytest.approx(200, abs=2)
