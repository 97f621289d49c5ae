"""Document quality by Bradley-Terry pairwise ranking.

Every text gets a few dozen features of its whole bytes and words.  Preference pairs of a good and a bad
training document are drawn by a seeded generator; the ranking weights maximise the logistic likelihood of the feature
differences (Newton's method), so a document's strength is linear in its features.  A logistic curve
fitted on the same sample turns strengths into scores from 0 to 1 without changing their order.
``keep_best`` cuts at a quantile of the scores of all documents.

Null and empty texts have all features zero and are scored like any other.  Without
labels of both classes every score is one half.  Ties at the quantile stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.batches import LOWER, flat, slices, span_hashes, word_spans
from tabwright.llm.columns import free_names
from tabwright.llm.components import stored
from tabwright.llm.labelled import fit_once, fold, sample_ids
from tabwright.llm.registry import llm_query
from tabwright.llm.toxicity import logistic

PER_CLASS = 5_000  # labelled documents of each class that the model is fitted on, about
PAIRS, SEED = 60_000, 7
#: Kinds of bytes whose share in a text is a feature.
KINDS = ("lower", "upper", "digit", "blank", "newline", "stop", "bar", "bang", "mark", "high")
_KIND = np.full(256, KINDS.index("mark"))
for _name, _bytes in {
    "lower": range(0x61, 0x7B), "upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A), "blank": b" \t", "newline": b"\n\r",
    "stop": b".,;:?'\"-()", "bar": b"|", "bang": b"!", "high": range(0x80, 0x100),
}.items():
    _KIND[list(_bytes)] = KINDS.index(_name)


@dataclass
class Ranking:
    """Weights of the standardised features and the curve from strength to score."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    curve: tuple[float, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        strength = np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * strength, -30, 30)))


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of features per text."""
    data, bounds = flat(texts)
    n, size = len(bounds) - 1, np.diff(bounds)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * len(KINDS) + _KIND[data], minlength=n * len(KINDS)).reshape(n, -1).astype(float)
    shares = kinds / np.maximum(size, 1)[:, None]
    starts, ends, words = word_spans(data, bounds)
    of = np.repeat(np.arange(n), words)
    hashes = span_hashes(LOWER[data], starts, ends)
    length = ends - starts
    per = np.maximum(words, 1)
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[fresh], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(fresh), len(h)))
    commonest = np.zeros(n)
    np.maximum.at(commonest, o[fresh], runs)
    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    far = np.zeros(len(hashes), bool)  # the same word and the same one before it, anywhere in the text
    if len(hashes) > 1:
        pair = hashes[1:] * np.uint64(3) + hashes[:-1]
        order2 = np.lexsort((pair, of[1:]))
        p2, o2 = pair[order2], of[1:][order2]
        far[1:][order2[1:]] = (p2[1:] == p2[:-1]) & (o2[1:] == o2[:-1])
    last = _KIND[data[ends - 1]] if len(ends) else np.zeros(0, int)
    first = _KIND[data[starts]] if len(starts) else np.zeros(0, int)

    def mean(x):
        return np.bincount(of, x, n) / per

    plain = np.stack(
        [
            mean(length), mean(length.astype(float) ** 2) ** 0.5, distinct / per, commonest / per, mean(echo), mean(far),
            mean((last == KINDS.index("mark")) | (last == KINDS.index("bang"))), mean(first == KINDS.index("upper")),
            mean(length == 1), np.log1p(words), np.log1p(kinds[:, KINDS.index("newline")]),
        ],
        axis=1,
    )
    ratio = kinds[:, KINDS.index("upper")] / np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    return np.concatenate([shares, np.sqrt(shares), plain, np.sqrt(np.abs(plain[:, 4:7])), ratio[:, None]], axis=1)


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = SEED, penalty: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights that maximise the likelihood of the good document's win in random pairs."""
    draw = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    apart = x[draw.choice(good, pairs)] - x[draw.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        lost = 1 / (1 + np.exp(np.clip(apart @ w, -30, 30)))
        hessian = (apart * np.maximum(lost * (1 - lost), 1e-6)[:, None]).T @ apart + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, apart.T @ lost - penalty * w)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return w


def fit_ranking(texts: list[str], labels: list[int], weights: list[float]) -> Ranking:
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        k = text_features(pa.array([""], pa.string())).shape[1]
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), (0.0, 0.0))
    x = np.concatenate([text_features(pa.array(texts[i : i + 200], pa.string())) for i in range(0, len(texts), 200)])
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    x = np.clip((x - centre) / scale, -8, 8)
    w = bradley_terry(x, y)
    strength = x @ w
    curve = logistic(np.stack([np.ones(len(y)), strength], axis=1), y.astype(float), np.array(weights) / np.mean(weights))
    return Ranking(centre, scale, w, (float(curve[0]), max(0.0, float(curve[1]))))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Ranking:
    """Fit on about ``per_class`` labelled documents of each class, all of them if there are fewer."""
    return fit_once(docs, sample_ids(labels, "quality", id_col, per_class), id_col, text_col, fit_ranking)


def score_quality(docs: DataFrame, ranking: Ranking, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """Append the score of every whole text."""
    (name,) = free_names(docs, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                scores = ranking.scores(text_features(part.column(text_col)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=schema.names)

    return docs.mapInArrow(work, schema)


def keep_best(scored: DataFrame, share: float, score: str = "quality_score", name: str = "selected") -> DataFrame:
    """Mark the rows that reach the quantile of all scores which leaves ``share`` of them."""
    (name,) = free_names(scored, name)
    cut = scored.agg(F.percentile_approx(score, 1.0 - share, 100_000)).first()[0]
    return scored.withColumn(name, F.col(score) >= F.lit(cut).cast("double"))


THRESHOLD, SHARE = 0.3, 0.8


@llm_query("op9_quality", "documents")
def op9_quality(docs: DataFrame, folder: str) -> DataFrame:
    """``predicted`` cuts at a fixed score, ``selected`` at the quantile that keeps four fifths."""
    labels = docs.sparkSession.read.parquet(f"{folder}/labels.parquet").filter(fold("doc_id", 5) != 0)
    texts = docs.select("doc_id", "text")
    scored = score_quality(texts, train_quality(texts, labels)).drop("text")
    marked = keep_best(stored(scored, "quality"), SHARE)
    return marked.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
        "selected",
    )
