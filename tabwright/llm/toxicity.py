"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of ASCII letters and digits and of other bytes from 128 up, A-Z lower-cased.
A token's features are its hash and the hashes of its first bytes, in a table of fixed size.
Labels are given per document, so token labels are made first: features that stand out in toxic
training documents (log-likelihood ratio and odds) mark the tokens of those documents.
The chain of two states is fitted on them by gradient ascent on its log-likelihood.
Scoring runs forward-backward over whole texts; a document's score is a logistic function
of its highest marginal and of the number of toxic tokens; tokens with a marginal of one half
and more are the offending spans, neighbours joined.

Null and empty texts have no tokens: their score is that of no evidence.  Without labels of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.batches import LOWER, SLICE_BYTES, code_points, flat, mix, shingle_hashes, slices, span_hashes, word_spans
from tabwright.llm.columns import free_names
from tabwright.llm.labelled import fit_once, fold, sample_ids
from tabwright.llm.registry import llm_query

PER_CLASS = 2_500  # labelled documents of each class that the model is fitted on, about
FEATURES = 1 << 21
PREFIXES = (3, 4, 5, 6)
STEPS, RATE, PENALTY = 30, 0.5, 1e-3
BLOCK_TOKENS = 200_000  # tokens whose messages are held at a time in fitting
LEAST_ODDS, LEAST_RATIO = 20.0, 20.0
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Chain:
    """Weights of features, transitions (from, to), start, and of the document score."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    score: np.ndarray


def token_features(texts: pa.Array):
    """Per token its features; per text its number of tokens; the tokens' spans in bytes; their hashes."""
    data, bounds = flat(texts)
    starts, ends, counts = word_spans(data, bounds, INSIDE[data])
    low = LOWER[data]
    words = span_hashes(low, starts, ends)
    columns = [words] + [mix(span_hashes(low, starts, np.minimum(ends, starts + n)) + np.uint64(n)) for n in PREFIXES]
    return np.stack([(c % np.uint64(FEATURES)).astype(np.int32) for c in columns]), counts, starts, ends, words


def marginals(emission: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray):
    """For each token the share of state 1 in the forward and in the backward message, and the four entries of its factor.

    All texts form one sequence; the factor of a first token has equal rows, so nothing
    passes from one text to the next.  The sequence is laid out as rows of equal length: products of factors
    along each row, messages from row to row, messages inside all rows at once.
    """
    n = len(emission)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    up = np.exp(np.clip(emission, -30, 30))
    step = np.exp(moves)
    # the four entries of each token's factor, as columns of equal places of all rows
    factor = np.zeros((4, rows * width))
    factor[0], factor[3] = 1.0, 1.0  # past the end nothing changes
    for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        factor[k, :n] = np.where(first, np.exp(start[j]), step[i, j]) * (up if j else 1.0)
    a, b, c, d = (np.ascontiguousarray(x.reshape(rows, width).T) for x in factor)

    p, q, r, t = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for k in range(width):
        p, q, r, t = p * a[k] + q * c[k], p * b[k] + q * d[k], r * a[k] + t * c[k], r * b[k] + t * d[k]
        if k % 4 == 3 or k == width - 1:
            most = 1.0 / np.maximum(np.maximum(p, q), np.maximum(r, t))
            p, q, r, t = p * most, q * most, r * most, t * most
    # the share of state 1 in the message that enters each row from the left, and in that from the right
    left, right = np.full(rows, 0.5), np.full(rows, 0.5)
    for k in range(1, rows):
        x, y = 1 - left[k - 1], left[k - 1]
        zero, one = x * p[k - 1] + y * r[k - 1], x * q[k - 1] + y * t[k - 1]
        left[k] = one / (zero + one)
    for k in range(rows - 2, -1, -1):
        x, y = 1 - right[k + 1], right[k + 1]
        zero, one = p[k + 1] * x + q[k + 1] * y, r[k + 1] * x + t[k + 1] * y
        right[k] = one / (zero + one)
    forward, backward = np.empty((width, rows)), np.empty((width, rows))
    for k in range(width):
        x, y = 1 - left, left
        one = x * b[k] + y * d[k]
        left = one / (x * a[k] + y * c[k] + one)
        forward[k] = left
        back = width - 1 - k
        backward[back] = right
        x, y = 1 - right, right
        one = c[back] * x + d[back] * y
        right = one / (a[back] * x + b[back] * y + one)
    return forward.T.ravel()[:n], backward.T.ravel()[:n], factor[:, :n]


def _firsts(counts: np.ndarray) -> np.ndarray:
    first = np.zeros(int(counts.sum()), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    return first


def posterior(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Probability of state 1 from the two messages."""
    one = forward * backward
    return one / (one + (1 - forward) * (1 - backward))


def toxic_marginals(features: np.ndarray, counts: np.ndarray, chain: Chain) -> np.ndarray:
    if not features.shape[1]:
        return np.zeros(0)
    f, b, _ = marginals(chain.weights[features].sum(axis=0), _firsts(counts), chain.moves, chain.start)
    return posterior(f, b)


def evidence(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: 1, highest marginal, log of 1 + number of toxic tokens.

    The fourth power of the marginals is summed, so that the faint doubt about each of many tokens
    does not add up in long texts.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(owner, p**4, len(counts))
    most = np.zeros(len(counts))
    np.maximum.at(most, owner, p)
    return np.stack([np.ones(len(counts)), most, np.log1p(total)], axis=1)


def _log_ratio(a, b, na, nb):
    """Log-likelihood ratio of two shares."""
    def part(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    return 2 * (part(a, na, a / na) + part(b, nb, b / nb) - part(a, na, (a + b) / (na + nb)) - part(b, nb, (a + b) / (na + nb)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights of a logistic model by Newton's method; the first column is the intercept."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return w


def _blocks(features: np.ndarray, counts: np.ndarray, state: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, counts and states of runs of whole texts of about ``BLOCK_TOKENS`` tokens."""
    ends = np.cumsum(counts)
    out, text, token = [], 0, 0
    while text < len(counts):
        to = max(text + 1, int(np.searchsorted(ends, token + BLOCK_TOKENS, "right")))
        end = int(ends[to - 1])
        out.append((features[:, token:end], counts[text:to], state[token:end]))
        text, token = to, end
    return out


def _gradients(chain: Chain, features: np.ndarray, counts: np.ndarray, state: np.ndarray):
    """Of the log-likelihood of the states, by weights, transitions and start."""
    if not len(state):
        return 0.0, np.zeros((2, 2)), np.zeros(2)
    first = _firsts(counts)
    f, b, factor = marginals(chain.weights[features].sum(axis=0), first, chain.moves, chain.start)
    p = posterior(f, b)
    weights = sum(np.bincount(c, state - p, FEATURES) for c in features)
    inner = np.flatnonzero(~first)
    left, right = f[inner - 1], b[inner]
    joint = factor[:, inner] * np.stack([(1 - left) * (1 - right), (1 - left) * right, left * (1 - right), left * right])
    joint /= joint.sum(axis=0)
    moves = np.bincount(2 * state[inner - 1].astype(int) + state[inner], minlength=4).reshape(2, 2) - joint.sum(axis=1).reshape(2, 2)
    start = np.array([np.count_nonzero(state[first] == s) for s in (0, 1)]) - np.array([(1 - p[first]).sum(), p[first].sum()])
    return weights, moves, start


def fit_chain(texts: list[str], labels: list[int], weights: list[float]) -> Chain:
    nothing = Chain(np.zeros(FEATURES, np.float32), np.zeros((2, 2)), np.zeros(2), np.array([-30.0, 0.0, 0.0]))
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return nothing
    features, counts, _, _, words = token_features(pa.array(texts, pa.string()))
    owner = np.repeat(np.arange(len(texts)), counts)
    # texts that share their smallest shingle hash are taken for copies: one of them counts
    shingles, per_text = shingle_hashes(words, counts)
    ends = np.cumsum(per_text)
    least = np.array([shingles[e - k : e].min() if k else i for i, (e, k) in enumerate(zip(ends, per_text, strict=True))], np.uint64)
    counted = np.zeros(len(texts), bool)
    counted[np.unique(np.stack([least, y.astype(np.uint64)]), axis=1, return_index=True)[1]] = True
    n1, n0 = max(1, int((counted & (y == 1)).sum())), max(1, int((counted & (y == 0)).sum()))
    tagged = np.zeros(len(owner), bool)
    for column in features:
        pairs = np.unique(owner[counted[owner]].astype(np.int64) * FEATURES + column[counted[owner]])
        doc, feature = pairs // FEATURES, pairs % FEATURES
        a = np.bincount(feature[y[doc] == 1], minlength=FEATURES).astype(float)
        b = np.bincount(feature[y[doc] == 0], minlength=FEATURES).astype(float)
        odds = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
        marks = (odds >= LEAST_ODDS) & (_log_ratio(a, b, n1, n0) >= LEAST_RATIO)
        tagged |= marks[column]
    tagged &= y[owner] == 1

    chain = Chain(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2), np.zeros(3))
    chain.weights[:] = -1.0 / len(features)
    seen = [np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2)]
    blocks = _blocks(features, counts, tagged.astype(np.int8))
    for _ in range(STEPS if len(owner) else 0):
        total = [-PENALTY * chain.weights, np.zeros((2, 2)), np.zeros(2)]
        for block in blocks:  # texts are independent, so gradients add up
            for whole, g in zip(total, _gradients(chain, *block), strict=True):
                whole += g
        for target, g, past in zip((chain.weights, chain.moves, chain.start), total, seen, strict=True):
            past += g * g
            target += RATE * g / (np.sqrt(past) + 1e-8)
    x = np.concatenate([evidence(toxic_marginals(f, c, chain), c) for f, c, _ in blocks])
    chain.score = logistic(x, y.astype(float), np.array(weights) / np.mean(weights))
    chain.weights = chain.weights.astype(np.float32)
    return chain


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def toxic_spans(p: np.ndarray, counts: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: pa.Array) -> list[list[dict]]:
    """Runs of tokens with a marginal of at least one half, in code points of their text."""
    out: list[list[dict]] = [[] for _ in counts]
    at = np.flatnonzero(p >= 0.5)
    if not len(at):
        return out
    data, bounds = flat(texts)
    place = code_points(data)
    owner = np.repeat(np.arange(len(counts)), counts)
    run = np.concatenate([[0], np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0)) + 1, [len(at)]])
    for a, b in zip(run[:-1], run[1:], strict=True):
        out[owner[at[a]]].append((starts[at[a]], ends[at[b - 1]]))
    return [
        [{"start": int(place[s] - place[base]), "end": int(place[e] - place[base])} for s, e in spans]
        for base, spans in zip(bounds[:-1], out, strict=True)
    ]


def score_toxicity(docs: DataFrame, chain: Chain, text_col: str = "text", score: str = "toxicity", spans: str = "toxic_spans") -> DataFrame:
    """Append the score and the offending spans of every whole text."""
    score, spans = free_names(docs, score, spans)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(spans, SPAN)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES // 2):
                features, counts, starts, ends, _ = token_features(part.column(text_col))
                p = toxic_marginals(features, counts, chain)
                values = 1 / (1 + np.exp(-np.clip(evidence(p, counts) @ chain.score, -30, 30)))
                found = toxic_spans(p, counts, starts, ends, part.column(text_col))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values), pa.array(found, kind)], names=schema.names)

    return docs.mapInArrow(work, schema)


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Chain:
    """Fit on about ``per_class`` labelled documents of each class, all of them if there are fewer."""
    chosen = sample_ids(labels, "toxic", id_col, per_class)
    return fit_once(docs, chosen, id_col, text_col, fit_chain)


THRESHOLD = 0.7


def learned_labels(spark, folder: str) -> DataFrame:
    """The rows that labels may be learned from."""
    return spark.read.parquet(f"{folder}/labels.parquet").filter(fold("doc_id", 3) != 1)


@llm_query("op8_toxicity", "documents")
def op8_toxicity(docs: DataFrame, folder: str) -> DataFrame:
    texts = docs.select("doc_id", "text")
    chain = train_toxicity(texts, learned_labels(docs.sparkSession, folder))
    scored = score_toxicity(texts, chain)
    return scored.select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("toxic_spans").cast("long").alias("n_spans"),
    )


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, columns untouched."""
    score, spans = free_names(docs, "toxicity", "toxic_spans")
    return score_toxicity(docs, chain, text_col, score, spans).filter(F.col(score) < threshold).select(*docs.columns)
