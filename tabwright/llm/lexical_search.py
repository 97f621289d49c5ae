"""Ranked lexical search: MaxScore whose bounds come from single terms and from pairs of terms.

The documents are read once, for the terms the queries hold: every document becomes a row of terms and their
counts.  Their totals give the weights of the terms.  The rows are then turned into blocks of bounded size, an inverted index each:
the documents of a term with what the term adds to their score, the highest addition of each term, and for the listed
pairs of terms the joint maximum, found on the intersection of the two lists: the most that a document with both can get from both.
The listed pairs are neighbours in the order of weight inside a query.

A query takes its terms by ascending weight.  Whatever the terms of a prefix add to one document is at most the
sum of the pairs' bounds, and a pair's bound is its joint maximum or the higher single one; that is never above, and mostly below,
the sum of the terms' own maxima.  The longest prefix that stays under the score of the query's last place needs no
reading for candidates: those come from the lists of the other terms alone, and lose their place as soon as their
score and the bound of the prefix that is left stay under it.  Documents at the bound are kept, so ties are whole and results are exact.
Places are first taken on a share of the blocks; the scores they need travel to all tasks.  Each task returns its best
per query, merged in two steps, so that one query's rows never meet in one task before they are few.

Queries come in sets of bounded bytes, each set against all documents.

Defined cases.  A null or empty text has no terms; a query without terms has no results.  Rows are documents and
queries on their own, also when they repeat an id or a text.  A null id is returned as null and comes last among
equal scores.  An empty table gives an empty table.  Other columns are not read.  Texts are read whole, slice by slice.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.llm.batches import LOWER, flat, slices, span_hashes, word_spans
from tabwright.llm.components import stored
from tabwright.llm.registry import llm_query

QUERY_BYTES = 4 << 20
BLOCK_POSTINGS = 400_000
FIRST_DOCS, FIRST_SHARE = 20_000, 1 / 64
MERGE_GROUPS = 64
NO_ID = np.iinfo(np.int64).max
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased, starts and ends of the terms, terms per text."""
    data, bounds = flat(texts)
    data = LOWER[data]
    return data, *word_spans(data, bounds, IN_TERM[data])


class Vocabulary:
    """The terms of a set of queries; found by hash, then compared byte by byte."""

    def __init__(self, terms: Iterable[bytes]):
        terms = sorted(set(terms))
        lengths = np.array([len(t) for t in terms], np.int64)
        data, ends = np.frombuffer(b"".join(terms), np.uint8), np.cumsum(lengths)
        hashes = span_hashes(data, ends - lengths, ends)
        order = np.argsort(hashes, kind="stable")
        self.terms = [terms[i] for i in order]
        self.hashes, self.lengths, self.starts, self.data = hashes[order], lengths[order], (ends - lengths)[order], data
        self.number = {t: i for i, t in enumerate(self.terms)}
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two query terms share a hash")

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the spans that hold a term, and the number of that term."""
        if not len(self.terms) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = span_hashes(data, starts, ends)
        term = np.minimum(np.searchsorted(self.hashes, hashes), len(self.terms) - 1)
        at = np.flatnonzero((self.hashes[term] == hashes) & (self.lengths[term] == ends - starts))
        if not len(at):
            return at, at
        term, lengths = term[at], (ends - starts)[at]
        first = np.cumsum(lengths) - lengths
        step = np.arange(lengths.sum()) - np.repeat(first, lengths)
        same = data[step + np.repeat(starts[at], lengths)] == self.data[step + np.repeat(self.starts[term], lengths)]
        equal = np.logical_and.reduceat(same, first)
        return at[equal], term[equal]


@dataclass(frozen=True)
class Corpus:
    """What a weight depends on: documents with terms, all their terms, documents per query term."""

    docs: int
    words: int
    with_term: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.docs + 2) / (2 * int(d) + 1))) for d in self.with_term], np.int64)

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """The length of a document against the average, in hundredths, half of it counted."""
        most = int(n.max()) if len(n) else 0
        if 50 * most * self.docs < 1 << 63:
            return 50 + (50 * n.astype(np.int64) * self.docs) // self.words
        return np.array([50 + 50 * int(x) * self.docs // self.words for x in n], np.int64)


def term_rows(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, terms, counts`` per document: all its terms counted, those of the vocabulary listed."""
    size = max(1, len(vocabulary.terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts, ends, per_text = terms_in(part.column("text"))
                at, term = vocabulary.find(data, starts, ends)
                doc = np.repeat(np.arange(len(per_text)), per_text)[at]
                pair, times = np.unique(doc * size + term, return_counts=True)
                ends_of = np.searchsorted(pair, np.arange(len(per_text) + 1) * size)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends_of, pa.int32()), pa.array(values, pa.int32()))
                    for values in (pair % size, times)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(per_text, pa.int64()), *lists], names=["id", "n", "terms", "counts"]
                )

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(count, "id long, n long, terms array<int>, counts array<int>")


def corpus_of(rows: DataFrame, terms: int) -> Corpus:
    """One pass for the totals, one for the documents per term, which are at most as many as query terms."""
    docs, words = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    with_term = np.zeros(terms, np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c")).collect():
        with_term[r["term"]] = r["c"]
    return Corpus(docs, words or 0, with_term)


BLOCK = "chance double, ids binary, ends binary, docs binary, adds binary, most binary, pairs binary"


@dataclass
class Block:
    """The inverted index of some documents: per term its documents, what it adds to each, and the most it adds."""

    ids: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    adds: np.ndarray
    most: np.ndarray
    pairs: np.ndarray

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.ends[term], self.ends[term + 1])
        return self.docs[span], self.adds[span]


def make_block(ids, n, ends, terms, counts, corpus: Corpus, weights: np.ndarray, pairs: np.ndarray) -> Block:
    """Index the documents; a pair's bound is the highest sum on the intersection, or the higher of both alone."""
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ends))
    tf = counts.astype(np.int64)
    adds = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * corpus.lengths(n)[doc]))
    order = np.argsort(terms, kind="stable")
    term_ends = np.searchsorted(terms[order], np.arange(len(weights) + 1))
    block = Block(ids, term_ends, doc[order], adds[order], np.zeros(len(weights), np.int64), np.zeros(len(pairs), np.int64))
    held = np.flatnonzero(np.diff(term_ends))
    if len(held):
        block.most[held] = np.maximum.reduceat(block.adds, term_ends[:-1][held])
    dense, at = np.zeros(len(ids), np.int64), -1
    for i, (a, b) in enumerate(pairs):  # in the order of the first term
        if a != at:
            if at >= 0:
                dense[block.postings(at)[0]] = 0
            dense[block.postings(a)[0]] = block.postings(a)[1]
            at = a
        docs, more = block.postings(b)
        both = dense[docs]
        joint = (more + both)[both > 0]
        block.pairs[i] = max(block.most[a], block.most[b], joint.max() if len(joint) else 0)
    return block


def index_blocks(rows: DataFrame, corpus: Corpus, weights: np.ndarray, pairs: np.ndarray, postings: int) -> DataFrame:
    """One row per block of documents, about ``postings`` entries each."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        terms = table["terms"].combine_chunks()
        ids = table["id"].to_pandas().astype("Int64").fillna(NO_ID).to_numpy(np.int64)
        ends = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
        block = make_block(
            ids, table["n"].to_numpy(), ends, terms.flatten().to_numpy(),
            table["counts"].combine_chunks().flatten().to_numpy(), corpus, weights, pairs,
        )
        fields = (block.ids, block.ends.astype(np.int64), block.docs.astype(np.int32), block.adds, block.most, block.pairs)
        values = [x.tobytes() for x in fields]
        chance = zlib.crc32(values[0]) / 2**32
        return pa.RecordBatch.from_arrays(
            [pa.array([chance]), *[pa.array([v], pa.binary()) for v in values]],
            names=["chance", "ids", "ends", "docs", "adds", "most", "pairs"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.cumsum(batch.column("terms").value_lengths().to_numpy())
            at = 0
            while at < batch.num_rows:
                done = lengths[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(lengths, done + postings - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(lengths[to - 1] - done)
                at = to
                if size >= postings or at < batch.num_rows:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return rows.filter(F.size("terms") > 0).mapInArrow(build, BLOCK)


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    kinds = {"ids": np.int64, "ends": np.int64, "docs": np.int32, "adds": np.int64, "most": np.int64, "pairs": np.int64}
    for batch in batches:
        columns = {name: batch.column(name) for name in kinds}
        for i in range(batch.num_rows):
            yield Block(**{name: np.frombuffer(columns[name][i].as_buffer(), kind) for name, kind in kinds.items()})


@dataclass(frozen=True)
class Query:
    """Terms by ascending weight, and the numbers of the pairs (first and second, third and fourth, ...)."""

    terms: np.ndarray
    pairs: np.ndarray


def prefix_bounds(query: Query, block: Block) -> np.ndarray:
    """For every prefix of the terms the most it can add to one document of the block."""
    bounds = np.zeros(len(query.terms) + 1, np.int64)
    if len(query.pairs):
        bounds[2::2] = np.cumsum(block.pairs[query.pairs])
    bounds[1::2] = bounds[0:-1:2] + block.most[query.terms[0::2]]
    return bounds


def search_block(query: Query, block: Block, least: int, scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block with a score of at least ``least``, and the scores; ``scratch`` is zero before and after."""
    bounds = prefix_bounds(query, block)
    if bounds[-1] < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    skipped = int(np.searchsorted(bounds, least, "left")) - 1  # the longest prefix below it
    touched = []
    for term in query.terms[skipped:]:
        docs, adds = block.postings(term)
        if len(docs):
            scratch[docs] += adds
            touched.append(docs)
    found = np.flatnonzero(scratch)
    for k in range(skipped - 1, -1, -1):
        found = found[scratch[found] + bounds[k + 1] >= least]
        if not len(found):
            break
        docs, adds = block.postings(query.terms[k])
        if len(found) * 16 < len(docs):
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            there = docs[at] == found
            scratch[found[there]] += adds[at[there]]
        elif len(docs):
            scratch[docs] += adds
            touched.append(docs)
    scores = scratch[found]
    for docs in touched:
        scratch[docs] = 0
    good = scores >= least
    return found[good], scores[good]


class Places:
    """The best documents of one query so far."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(1, least)
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        best = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[best], scores[best]
        if len(best) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def search(blocks: DataFrame, queries: list[Query], k: int, least: list[int] | None = None) -> DataFrame:
    """``query, id, score, part``: the best ``k`` of every task; ``least`` is a score every query's last place has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [Places(k, least[i] if least else 1) for i in range(len(queries))]
        for block in read_blocks(batches):
            scratch = np.zeros(len(block.ids), np.int64)
            for query, place in zip(queries, places, strict=True):
                docs, scores = search_block(query, block, place.least, scratch)
                if len(docs):
                    place.add(block.ids[docs], scores)
        sizes = [len(p.ids) for p in places]
        if sum(sizes):
            ids = np.concatenate([p.ids for p in places])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(places), dtype=np.int32), sizes)),
                    pa.array(ids, mask=ids == NO_ID),
                    pa.array(np.concatenate([p.scores for p in places])),
                ],
                names=["query", "id", "score"],
            )

    found = blocks.mapInArrow(run, "query int, id long, score long")
    return found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """``query, id, score, rank``: tasks are merged by groups first, then the groups."""
    order = (F.desc("score"), F.asc_nulls_last("id"))
    for keys in (("query", "part"), ("query",)):
        ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("rank", ranked).filter(F.col("rank") <= k)
    return found.drop("part")


def _set_results(docs: DataFrame, items: list, k: int, id_col: str, text_col: str) -> DataFrame | None:
    data, starts, ends, per_text = terms_in(pa.array([r["text"] for r in items], pa.string()))
    spans = [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)]
    vocabulary = Vocabulary(spans)
    if not spans:
        return None
    rows = stored(term_rows(docs, vocabulary, id_col, text_col), "terms")
    corpus = corpus_of(rows, len(vocabulary.terms))
    if not corpus.words:
        return None
    weights = corpus.weights()
    pair_number: dict[tuple[int, int], int] = {}
    queries, at = [], 0
    for size in per_text:
        terms = np.array(sorted({vocabulary.number[t] for t in spans[at : at + size]}, key=lambda t: (weights[t], t)), np.int64)
        at += size
        couples = [(int(min(c)), int(max(c))) for c in zip(terms[0:-1:2], terms[1::2], strict=False)]
        queries.append(Query(terms, np.array([pair_number.setdefault(c, len(pair_number)) for c in couples], np.int64)))
    # the pairs are stored by their first term; queries refer to the stored order
    listed = sorted(pair_number)
    place = {pair_number[c]: i for i, c in enumerate(listed)}
    queries = [Query(q.terms, np.array([place[int(p)] for p in q.pairs], np.int64)) for q in queries]
    pairs = np.array(listed, np.int64).reshape(-1, 2)
    blocks = stored(index_blocks(rows, corpus, weights, pairs, BLOCK_POSTINGS), "index")
    share, least = max(FIRST_SHARE, FIRST_DOCS / corpus.docs), None
    if share < 0.5:
        first = best_of(search(blocks.filter(F.col("chance") < share), queries, k), k).filter(F.col("rank") == k)
        known = {r["query"]: r["score"] for r in first.collect()}  # one score per query of the set
        least = [known.get(i, 1) for i in range(len(queries))]
    best = best_of(search(blocks, queries, k, least), k)
    names = docs.sparkSession.createDataFrame([(i, r["id"]) for i, r in enumerate(items)], "query int, item long")
    return best.join(F.broadcast(names), "query").select("item", "rank", "id", "score")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item, rank, id, score``: the ``k`` highest-scoring documents of every item, ties by id."""
    text = F.col(f"`{item_text}`").cast("string")
    asked = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), text.alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = max(1, -(-size // QUERY_BYTES))
    asked = asked.withColumn("set", F.pmod(F.xxhash64("id", "text"), F.lit(sets)))
    result = docs.sparkSession.createDataFrame([], "item long, rank int, id long, score long")
    for number in range(sets):
        members = asked.filter((F.col("set") == number) & F.col("text").isNotNull()).select("id", "text").collect()
        found = _set_results(docs, members, k, id_col, text_col)
        result = result if found is None else result.unionByName(found)
    return result


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), c AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_words FROM t WHERE len(terms) > 0
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), u AS (
  SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM t
), p AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM p, c GROUP BY term, n_docs
), s AS (
  SELECT q.item_id, p.doc_id, p.r,
         sum(w.weight * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * c.n_docs) // c.n_words))))::BIGINT AS score
  FROM q JOIN p ON q.term = p.term JOIN w ON q.term = w.term, c
  GROUP BY q.item_id, p.doc_id, p.r
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""


@llm_query("op11_search", "documents", SQL)
def op11_search(docs: DataFrame, folder: str) -> DataFrame:
    items = docs.sparkSession.read.parquet(f"{folder}/benchmark.parquet")
    return ranked_search(docs, items, 50).select(
        F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score"
    )
