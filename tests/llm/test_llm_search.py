"""Lexical search, hard negatives and line dedup: SQL on the tables, plain versions on awkward rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import oracle
import pytest
from brute import LOWER, SCHEMA, awkward
from conftest import SMALL, plan
from pyspark.sql import functions as F

import corpus_pipeline
from tabwright.llm import lexical_search, line_dedup, negatives


@pytest.mark.parametrize("name", ["op11_search", "op12_negatives", "op13_line_dedup"])
def test_agrees_with_sql(spark, name):
    df = corpus_pipeline.LLM_QUERIES[name](spark, SMALL)
    assert oracle.differences(df, oracle.connect(SMALL), corpus_pipeline.LLM_SQL[name]) is None
    if name == "op13_line_dedup":
        assert "Python" not in plan(df) and "Arrow" not in plan(df) and "Pandas" not in plan(df)


# ---- line dedup ----

LINES = [
    (1, " Licence \nunique one\nlicence", "x", "s", 0), (2, "LICENCE\n\nother", "x", "s", 0), (3, "Ünïcode\nlicence\t", "x", "s", 0),
    (3, "Ünïcode\nlicence\t", "x", "s", 0), (4, "ÜNÏCODE", "x", "s", 0), (5, None, "x", "s", 0), (6, "", "x", "s", 0),
    (7, "\n\n", "x", "s", 0), (None, "licence\nother", "x", "s", 0), (None, "licence", "x", "s", 0), (8, "licence", "x", "s", 0),
    (9, "\x0b\x0c \t\r", "x", "s", 0), (10, " licence", "x", "s", 0), (11, "a\r\nb", "x", "s", 0),
    (12, "\n".join(f"line {i % 700}" for i in range(30_000)), "x", "s", 0), (13, "line 1\nline 2 \nLINE 699\nrest", "x", "s", 0),
]


def plain_lines(rows, least, keep_first):
    """Kept positions of every row; rows with the same id and text are one document."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    documents = {(r[0], r[1] or "") for r in rows}
    holds, occurrences = Counter(), {}
    for doc_id, text in documents:
        holds.update({key(line) for line in text.split("\n")} - {""})
        for pos, line in enumerate(text.split("\n")):
            occurrences.setdefault(key(line), []).append((doc_id, text, pos))
    out = {}
    for doc_id, text in documents:
        lines = text.split("\n")
        out[doc_id, text] = [p for p, line in enumerate(lines) if not key(line) or holds[key(line)] < least]
    return out, holds, occurrences, key


def test_lines_of_awkward_rows(spark):
    docs = spark.createDataFrame(LINES, SCHEMA)
    marked = line_dedup.line_bitmaps(docs, min_docs=4, keep_first=False)
    got = marked.withColumn("kept", line_dedup.apply_runs(F.col("text"), F.col("keep_runs"))).collect()
    kept, *_ = plain_lines(LINES, 4, False)
    assert len(got) == len(LINES)
    for r in got:
        lines = (r["text"] or "").split("\n")
        places = kept[r["doc_id"], r["text"] or ""]
        assert [p for run in r["keep_runs"] for p in range(run["at"], run["at"] + run["n"])] == places
        assert r["kept"] == "\n".join(lines[p] for p in places)
        assert (r["n_lines"], r["n_dropped"]) == (len(lines), len(lines) - len(places))


def test_first_occurrence_stays(spark):
    docs = spark.createDataFrame(LINES, SCHEMA)
    got = line_dedup.line_bitmaps(docs, min_docs=1).dropDuplicates(["doc_id", "text"]).collect()
    _, _, occurrences, key = plain_lines(LINES, 1, True)
    stay = Counter()
    for r in got:
        lines = (r["text"] or "").split("\n")
        stay.update(key(lines[p]) for run in r["keep_runs"] for p in range(run["at"], run["at"] + run["n"]))
    assert {k: n for k, n in stay.items() if k} == {k: 1 for k in occurrences if k}, "one line of each key is kept"
    first = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert first[12]["n_lines"] - first[12]["n_dropped"] == 700 and first[13]["n_dropped"] == 3
    assert first[5]["n_dropped"] == first[7]["n_dropped"] == 0


def test_line_columns_may_be_taken_and_tables_empty(spark):
    docs = spark.createDataFrame([(1, "a\nb", 7, 8), (2, "a", 7, 8)], "doc_id long, text string, n_lines int, lost_id int")
    got = line_dedup.line_bitmaps(docs, keep_first=False)
    assert got.columns == [*docs.columns, "n_lines_", "n_dropped", "keep_runs"]
    assert sorted((r["doc_id"], r["n_lines"], r["n_lines_"], r["n_dropped"]) for r in got.collect()) == [(1, 7, 2, 1), (2, 7, 1, 1)]
    assert line_dedup.line_bitmaps(docs.limit(0)).count() == 0


def test_hot_line_is_cut_into_ranges(spark):
    docs = spark.range(8_000).selectExpr("id AS doc_id", "concat('same line\\nown ', id) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        sizes = line_dedup.line_rows(docs).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in sizes) < 16_000 / 4, "half of all lines have one key"


# ---- hard negatives ----


def plain_negatives(rows):
    rows = [(i, v, label) for i, v, label in rows if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows]
    out = []
    last = lambda i: (i is None, i or 0)
    for i, v, label in whole:
        if i is None or i % 100:
            continue
        dot = lambda o: sum(a * b for a, b in zip(v, o, strict=False))  # noqa: B023, E731
        scored = sorted(((-dot(o), last(j), j, other) for j, o, other in whole if j != i), key=lambda s: s[:2])
        for down, _, j, _ in [s for s in scored if s[3] == label][:5]:
            near = [s for s in scored if s[3] != label and 80 * -down <= 100 * -s[0] <= 100 * -down][:5]
            out += [(i, j, k + 1, s[2], -down, -s[0]) for k, s in enumerate(near)]
    return sorted(out, key=str)


def vectors(n=600, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 8)) * 0.2
    rows = [(int(i), [float(x) for x in centres[i % 4] + rng.normal(size=8) * 0.1], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, rows[5][1], i % 3) for i in range(60)]  # a vector that many rows share
    rows += [(None, rows[7][1], 1), (100, rows[100][1], 2), (8, None, 1), (9, [None] * 8, 1), (10, [float("nan")] * 8, 1),
             (11, [float("inf")] * 8, 0), (700, [0.5] * 3, 0), (800, [], 0), (801, [0.0] * 8, None)]
    return rows


@pytest.mark.parametrize("blocks", [(2_048, 16_384), (2, 50)])
def test_negatives_against_all_pairs(spark, blocks):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.hard_negatives(table, F.col("id") % 100 == 0, anchors_per_block=blocks[0], rows_per_block=blocks[1])
    assert sorted(map(tuple, got.collect()), key=str) == plain_negatives(rows)


def test_negatives_with_large_components_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>, label int, at int, score int"
    table = spark.createDataFrame([(0, [4e6, 1.0], 0, 1, 1), (1, [4e6, 2.0], 0, 1, 1), (2, [4e6, 1.0], 1, 1, 1)], schema)
    big = 1_024_000_000 * 1_024_000_000
    got = [tuple(r) for r in negatives.hard_negatives(table, F.col("id") == 0).collect()]
    assert got == [(0, 1, 1, 2, big + 256 * 512, big + 256 * 256)]
    assert negatives.hard_negatives(table.limit(0), F.col("id") == 0).count() == 0


# ---- lexical search ----

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=50):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, n_words = sum(1 for _, t in terms if t), sum(len(t) for _, t in terms)
    counts = [(i, len(t), Counter(t)) for i, t in terms]
    df = Counter(x for _, _, c in counts for x in c)
    out = []
    for item, text in items:
        asked, scored = set(TERM.findall((text or "").translate(LOWER))), []
        for i, n, c in counts:
            m = 50 + (50 * n * n_docs) // max(1, n_words)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m))
                for x in asked if c[x]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def documents():
    rng = np.random.default_rng(9)
    rows = [(r[0], r[1]) for r in awkward()]
    for i in range(300):
        rows.append((100 + i, " ".join(f"t{int(x)}" for x in rng.zipf(1.4, size=int(rng.integers(1, 60))) if x < 500)))
    return rows + [(900 + i, "t1 t2 copy-of_it") for i in range(80)]


@pytest.mark.parametrize("postings", [400_000, 40])
def test_search_against_plain_scores(spark, monkeypatch, postings):
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(lexical_search, "FIRST_DOCS", 60)
    docs, items = documents(), [(1, "t1 t2 t3, T4 t5! t1"), (2, "copy of it"), (3, None), (4, "...  "), (5, "ünïcode 漢字"), (6, "nowhere9"),
                                (None, "t7 term1 word"), (1, "t1 t2 t3, T4 t5! t1")]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int").repartition(5)
    got = lexical_search.ranked_search(table, spark.createDataFrame(items, "item_id long, text string"), 20)
    assert sorted(map(tuple, got.select("item", "rank", "id", "score").collect()), key=str) == plain_search(docs, items, 20)


def test_search_in_several_sets_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", 20)
    docs, items = documents(), [(i, f"t{i} t{i + 1} term{i}") for i in range(6)]
    got = lexical_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, items, 5)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lexical_search.ranked_search(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_pair_bounds_hold_and_tighten(spark):
    rng = np.random.default_rng(4)
    corpus = lexical_search.Corpus(1_000, 60_000, np.array([300, 200, 150, 90, 30, 10]))
    weights, n_docs = corpus.weights(), 1_000
    pairs, query = np.array([[0, 1], [2, 3], [4, 5]]), lexical_search.Query(np.arange(6), np.array([0, 1, 2]))
    lists = [sorted(rng.choice(6, int(rng.integers(1, 5)), replace=False)) for _ in range(n_docs)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in lists])])
    counts = rng.integers(1, 9, size=ends[-1])
    block = lexical_search.make_block(
        np.arange(n_docs), rng.integers(20, 200, size=n_docs), ends, np.concatenate(lists), counts, corpus, weights, pairs
    )
    total = np.zeros((n_docs, 7), np.int64)
    for k in range(6):
        docs, adds = block.postings(k)
        total[docs, k + 1] = adds
    reached = np.cumsum(total, axis=1).max(axis=0)
    bounds = lexical_search.prefix_bounds(query, block)
    alone = np.concatenate([[0], np.cumsum(block.most)])
    assert (reached <= bounds).all() and (bounds <= alone).all() and (bounds < alone).any()
    full = total.sum(axis=1)
    for least in (1, int(np.median(full)), int(full.max()), int(full.max()) + 1):
        scratch = np.zeros(n_docs, np.int64)
        found, scores = lexical_search.search_block(query, block, least, scratch)
        assert found.tolist() == np.flatnonzero(full >= least).tolist() and (scores == full[found]).all() and not scratch.any()


def test_line_digest_is_of_the_kept_text(spark):
    got = {r["doc_id"]: r for r in corpus_pipeline.LLM_QUERIES["op13_line_dedup"](spark, SMALL).collect()}
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    kept, *_ = plain_lines([tuple(r) for r in texts], 10, False)
    for doc_id, text in texts:
        lines = (text or "").split("\n")
        assert got[doc_id]["kept_sha256"] == hashlib.sha256("\n".join(lines[p] for p in kept[doc_id, text or ""]).encode()).hexdigest()
