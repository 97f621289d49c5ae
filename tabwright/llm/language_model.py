"""Text scoring with a log-bilinear model trained by noise-contrastive estimation.

Words (A-Z lower-cased, split at ASCII white space) are 64-bit ids: a hash whose last five bits name the
class of the word's ending.  Word counts cover every training text.  The model's vocabulary grows with the corpus:
every word found ``LEAST`` times or more in training texts, the ``WORDS`` commonest at most; all other words are known
by their ending.  The model predicts the next word from the four before it: their vectors, weighted by place, sum
to a predicted vector whose product with a class's vector, plus its bias, is the class's score.  The softmax has two
levels: first the commonest words, the endings, the end of the text and groups of words of like frequency and ending,
then the words of the group.  Both are normalised and both depend on the context.  Training contrasts the true class
of each level with noise, drawn by frequency at the first level and evenly within a group.

Training texts are dealt by a hash of their id to rounds and, within a round, to shards of about ``SHARD_TOKENS``
tokens, so each is trained on once and neither the number of tasks nor the layout of the table changes the model.
A shard is trained in the order of the hash; after a round Spark averages the rows of the parameters that the shards
touched, by how often they did.  Scoring multiplies blocks of predicted vectors with all class
vectors and normalises, then adds the word's share of its ending class where the class is an ending.

The counts of the commonest words travel to all tasks, bounded by ``HEAD``; all other
words of a text are looked up by a join, so no count is dropped.  Null and empty texts are the end token alone.  Rows
without an id are dealt by text and place, repeated rows count as often as they occur, long texts are read in whole.
The result has the named columns only, whatever else the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.batches import LOWER, flat, mix, slices, span_hashes, word_spans
from tabwright.llm.components import stored
from tabwright.llm.frequent import head_of, least_count
from tabwright.llm.labelled import fold
from tabwright.llm.registry import llm_query

HEAD = 1 << 17  # words whose counts every task gets
WORDS, LEAST = 1 << 14, 5  # most words of the model, and how often each is found at least
ENDINGS = 32  # classes of all other words
SINGLE, TIERS = 64, (1024, 8192)  # ranks: words that are first-level classes, ends of the tiers that groups keep to
PLACES, DIM = 4, 12
ROUNDS = 3  # each training text serves one round
SHARD_TOKENS = 1 << 21
BATCH, NOISE, INNER_NOISE, RATE = 2048, 32, 2, 0.2
BLOCK, SUMMED = 256, 4096
SMOOTH = 0.1
COUNTED_TOKENS = 2_000_000


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words and the number of words of each text."""
    data, bounds = flat(texts)
    data = LOWER[data]
    starts, ends, counts = word_spans(data, bounds)
    ids = span_hashes(data, starts, ends)
    if len(ids):
        last = data[ends - 1].astype(np.uint64)
        before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        ending = mix(last * np.uint64(257) + before) >> np.uint64(59)
        ids = (ids & ~np.uint64(ENDINGS - 1)) | ending
    return ids, counts


def count_words(texts: DataFrame) -> DataFrame:
    """Stored table of all words and their counts: ``word``, ``c``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "c"])

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(word_ids(part.column("text"))[0])
                size += len(held[-1])
                if size > COUNTED_TOKENS:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    each = texts.select("text").mapInArrow(work, "word long, c long")
    return stored(each.groupBy("word").agg(F.sum("c").alias("c")), "words")


@dataclass
class Classes:
    """The words of the model are 0 to ``words`` - 1, then come the endings, the end and, in contexts only, the start."""

    frequency: np.ndarray  # of words, endings and the end
    single: int  # the first words are first-level classes
    bounds: np.ndarray  # the rest are runs, one for each group

    def __post_init__(self):
        self.words = int(self.bounds[-1])
        self.end = self.words + ENDINGS
        self.start = self.end + 1
        sizes = np.diff(self.bounds)
        groups = len(sizes)
        self.first_classes = self.single + groups + ENDINGS + 1
        self.group = np.repeat(np.arange(groups), sizes)  # of the words after the single ones
        self.first = np.concatenate(
            [np.arange(self.single), self.single + self.group, self.single + groups + np.arange(ENDINGS + 1)]
        )
        self.first_frequency = np.bincount(self.first, self.frequency, self.first_classes)
        mass = self.first_frequency[self.single : self.single + groups]
        self.share = self.frequency[self.single : self.words] / mass[self.group]  # of each word in its group


def classes_of(ending: np.ndarray, c: np.ndarray, outside: np.ndarray, texts: int) -> tuple[np.ndarray, Classes]:
    """Order of the given words, commonest first, by class, and the classes.

    A tier of n words that hold a share p of all tokens is cut into groups of the root of n / p, which
    keeps the expected work of both levels least.  Groups run through the words of a tier by ending, then by rank.
    """
    n, total = len(c), float(c.sum() + outside.sum() + texts)
    single = min(SINGLE, n)
    order, bounds = [np.arange(single)], [single]
    edges = [single, *[t for t in TIERS if single < t < n], n]
    for low, high in zip(edges, edges[1:], strict=False):
        if high > low:
            order.append(low + np.argsort(ending[low:high], kind="stable"))
            size = int(np.ceil(np.sqrt((high - low) * total / c[low:high].sum())))
            bounds += [*range(low + size, high, size), high]
    order = np.concatenate(order)
    return order, Classes(np.concatenate([c[order], outside, [texts]]).astype(float), single, np.array(bounds))


@dataclass
class Counts:
    """What all tasks know: the head of the counts, totals, and totals of words outside the vocabulary by ending."""

    words: np.ndarray  # sorted ids of the head
    counts: np.ndarray
    classes: np.ndarray  # class of each word of the head
    least: int | None
    texts: int
    tokens: int
    distinct: int
    outside: np.ndarray  # tokens by ending
    outside_distinct: np.ndarray
    model: Classes

    def base(self, c):
        return np.log10((c + SMOOTH) / (self.tokens + SMOOTH * (self.distinct + 1)))

    def within(self, c, ending):
        """Share of a word in its ending class."""
        return np.log10((c + SMOOTH) / (self.outside[ending] + SMOOTH * (self.outside_distinct[ending] + 1)))

    def look_up(self, ids: np.ndarray):
        """Class, place in the head and whether the head has the word."""
        other = self.model.words + (ids & np.uint64(ENDINGS - 1)).astype(np.int64)
        if not len(self.words):
            return other, np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        at = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        known = self.words[at] == ids
        return np.where(known, self.classes[at], other), at, known


def summarise(counted: DataFrame, texts: int) -> Counts:
    least = least_count(counted, HEAD)
    head = head_of(counted, least)
    ids, c = head["word"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64)
    order = np.argsort(ids)
    ids, c = ids[order], c[order]
    ending = (ids & np.uint64(ENDINGS - 1)).astype(np.int64)
    common = np.lexsort((ids, -c))[:WORDS]
    common = common[c[common] >= LEAST]
    by_ending = counted.groupBy(F.col("word").bitwiseAND(F.lit(ENDINGS - 1)).alias("e")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")
    )
    tokens, distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for row in by_ending.collect():
        tokens[row["e"]], distinct[row["e"]] = row["c"], row["n"]
    outside = tokens - np.bincount(ending[common], c[common], ENDINGS)
    outside_distinct = distinct - np.bincount(ending[common], minlength=ENDINGS)
    order, model = classes_of(ending[common], c[common], outside, texts)
    classes = model.words + ending
    classes[common[order]] = np.arange(len(common))
    return Counts(
        ids, c, classes, least, texts, int(tokens.sum()) + texts, int(distinct.sum()) + (texts > 0), outside, outside_distinct, model
    )


def sequences(texts: pa.Array, counts: Counts):
    """Classes of all tokens with the ends, contexts, per text the number of tokens; and the words with what is known of them."""
    ids, words = word_ids(texts)
    classes, at, known = counts.look_up(ids)
    lengths = words + 1
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    tokens = np.full(len(place), counts.model.end)
    is_word = place < np.repeat(words, lengths)
    tokens[is_word] = classes
    context = np.full((len(tokens), PLACES), counts.model.start)
    for k in range(PLACES):
        there = np.flatnonzero(place > k)
        context[there, k] = tokens[there - k - 1]
    return tokens, context, lengths, words, ids, at, known


# ---- the model -----------------------------------------------------------------------------------


def first_parameters(model: Classes) -> np.ndarray:
    """Rows: context vectors, first-level and word vectors with their bias in the last column, weights of places.

    The biases start at the log frequencies, so the untrained model is the unigram model.
    """
    rows = model.start + 1 + model.first_classes + model.words
    table = np.zeros((rows + PLACES, DIM + 1), np.float32)
    table[:rows, :DIM] = np.random.default_rng(11).normal(0, 0.1, (rows, DIM))
    _, outer, inner, place = parts(table, model)
    outer[:, DIM] = log_share(model.first_frequency)
    inner[model.single :, DIM] = np.log(model.share)
    place[:] = 1.0 / PLACES
    return table


def log_share(frequency: np.ndarray) -> np.ndarray:
    return np.log((frequency + 0.5) / (frequency.sum() + 0.5 * len(frequency)))


def parts(table: np.ndarray, model: Classes):
    """Views: context vectors, first-level vectors and biases, word vectors and biases, weights of places."""
    a = model.start + 1
    b = a + model.first_classes
    return table[:a, :DIM], table[a:b], table[b : b + model.words], table[-PLACES:, :DIM]


def _odds(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.minimum(-score, 60)))  # finite in single precision


class Trainer:
    """Noise-contrastive ascent with a step size per row of the table, on a copy of it."""

    def __init__(self, table: np.ndarray, model: Classes, seed: int):
        self.model, self.table = model, table.copy()
        self.past = np.full(len(table), 1e-4, np.float32)
        self.used = np.zeros(len(table))  # how often each row took part
        self.draw = np.random.default_rng(seed)
        self.log_noise = log_share(model.first_frequency).astype(np.float32)
        self._slot = np.zeros(len(table), np.int32)

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        order = self.draw.permutation(len(target))
        share = np.exp(self.log_noise.astype(float))
        for at in range(0, len(order), BATCH):
            few = order[at : at + BATCH]
            noise = self.draw.choice(len(share), NOISE, p=share / share.sum())
            self.step(context[few], target[few], noise)

    def _move(self, rows, gradient: np.ndarray) -> None:
        past = self.past[rows] + np.einsum("nd,nd->n", gradient, gradient) / np.float32(DIM)
        self.past[rows] = past
        gradient *= (np.float32(RATE) / np.sqrt(past))[:, None]
        self.table[rows, : gradient.shape[1]] += gradient

    def _move_some(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        """Rows may repeat: their gradients are summed first."""
        at = np.arange(len(rows), dtype=np.int32)
        self._slot[rows] = at
        last = self._slot[rows]
        own = last == at
        number = (np.cumsum(own) - 1)[last]
        distinct, width = rows[own], gradient.shape[1]
        cells = (number[:, None] * width + np.arange(width)).ravel()
        summed = np.bincount(cells, gradient.ravel(), len(distinct) * width).astype(np.float32)
        self.used[distinct] += np.bincount(number)
        self._move(distinct, summed.reshape(-1, width))

    def step(self, context: np.ndarray, target: np.ndarray, noise: np.ndarray) -> None:
        """One step; the first level's noise is shared by the batch, a word's is any word of its group."""
        m, n = self.model, len(target)
        seen, outer, inner, place = parts(self.table, m)
        inputs = seen[context]
        predicted = np.ones((n, DIM + 1), np.float32)  # the last column meets the bias
        predicted[:, :DIM] = np.einsum("npd,pd->nd", inputs, place)

        first, shift = m.first[target], np.float32(np.log(len(noise)))
        true, false = outer[first], outer[noise]
        mean = np.float32(1 / n)
        up = mean - mean * _odds(np.einsum("nd,nd->n", predicted, true) - self.log_noise[first] - shift)
        down = -mean * _odds(predicted @ false.T - (self.log_noise[noise] + shift))
        push = up[:, None] * true[:, :DIM] + down @ false[:, :DIM]
        g_outer = np.zeros(outer.shape, np.float32)
        np.add.at(g_outer, noise, down.T @ predicted)
        cells = (first[:, None] * (DIM + 1) + np.arange(DIM + 1)).ravel()
        g_outer += np.bincount(cells, (up[:, None] * predicted).ravel(), g_outer.size).reshape(g_outer.shape).astype(np.float32)

        grouped = np.flatnonzero((target >= m.single) & (target < m.words))
        if len(grouped):
            word, own = target[grouped], predicted[grouped]
            low, high = m.bounds[m.group[word - m.single]], m.bounds[m.group[word - m.single] + 1]
            size = (high - low)[:, None]
            others = low[:, None] + (self.draw.random((len(word), INNER_NOISE), np.float32) * size).astype(np.int64)
            others = np.minimum(others, high[:, None] - 1)
            words = np.concatenate([word[:, None], others], axis=1)  # the true one first
            vectors = inner[words]
            score = np.einsum("nd,nkd->nk", own, vectors) + np.log(size / INNER_NOISE).astype(np.float32)
            pull = -mean * _odds(score)
            pull[:, 0] += mean
            push[grouped] += np.einsum("nk,nkd->nd", pull, vectors[:, :, :DIM])
            g_words = (pull[:, :, None] * own[:, None, :]).reshape(-1, DIM + 1)
        g_place = np.einsum("npd,nd->pd", inputs, push)
        g_seen = (push[:, None, :] * place).reshape(-1, DIM)

        a = m.start + 1
        self._move_some(context.ravel(), g_seen)
        self._move(slice(a, a + m.first_classes), g_outer)
        if len(grouped):
            self._move_some(a + m.first_classes + words.ravel(), g_words)
        self._move(slice(-PLACES, None), g_place)
        self.used[a : a + m.first_classes] += n
        self.used[-PLACES:] += n


def _trained(texts: DataFrame, counts: Counts, table: np.ndarray, round_: int) -> np.ndarray:
    """One round: every shard is trained on from the same start, Spark averages the touched rows by their use."""
    shards = max(1, round(counts.tokens / ROUNDS / SHARD_TOKENS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(trainer: Trainer) -> Iterator[pa.RecordBatch]:
            touched = np.flatnonzero(trainer.used)
            values = pa.FixedSizeListArray.from_arrays(pa.array(trainer.table[touched].ravel()), DIM + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(touched), pa.array(trainer.used[touched]), values.cast(pa.list_(pa.float32()))], names=["k", "w", "v"]
            )

        shard, trainer = None, None
        for batch in batches:
            of = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if of[low] != shard:
                    if trainer is not None:
                        yield from result(trainer)
                    shard, trainer = of[low], Trainer(table, counts.model, 1000 * round_ + int(of[low]))
                for part in slices(batch.slice(low, high - low), "text"):
                    tokens, context, *_ = sequences(part.column("text"), counts)
                    trainer.learn(context, tokens)
        if trainer is not None:
            yield from result(trainer)

    dealt = texts.withColumn("shard", F.pmod(F.floor(F.col("deal") / ROUNDS), F.lit(shards)).cast("int"))
    placed = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "deal", "text")
    rows = placed.select("shard", "text").mapInArrow(work, "k long, w double, v array<float>")
    means = [(F.sum(F.col("v")[i] * F.col("w")) / F.sum("w")).cast("float").alias(f"v{i}") for i in range(DIM + 1)]
    average = rows.groupBy("k").agg(*means).toArrow()  # at most one row per row of the table
    trained = table.copy()
    if average.num_rows:
        trained[average["k"].to_numpy()] = np.stack([average[f"v{i}"].to_numpy() for i in range(DIM + 1)], axis=1)
    return trained


def deal_of(key: Column, text: Column) -> Column:
    """What rounds and shards are dealt by: the key's hash, or that of text and place where the key is null."""
    unkeyed = F.xxhash64(text, F.monotonically_increasing_id(), F.lit(5))
    return F.shiftrightunsigned(F.when(key.isNull(), unkeyed).otherwise(F.xxhash64(key, F.lit(5))), 12)


def train_model(texts: DataFrame, counts: Counts, key: Column) -> np.ndarray:
    """``texts`` are the training texts; every one is dealt to one of the rounds."""
    table = first_parameters(counts.model)
    dealt = texts.select("text", deal_of(key, F.col("text")).alias("deal"))
    for k in range(ROUNDS):
        table = _trained(dealt.filter(F.pmod("deal", F.lit(ROUNDS)) == k), counts, table, k)
    return table


class Scorer:
    """Normalised log10 probabilities of the classes, in blocks of one matrix product."""

    def __init__(self, table: np.ndarray, model: Classes):
        seen, outer, self.inner, place = parts(table, model)
        self.model = model
        self.weighted = [
            np.hstack([seen * place[k], np.full((len(seen), 1), 1.0 / PLACES)]).astype(np.float32) for k in range(PLACES)
        ]  # the last column sums to 1 and meets the bias
        self.outer = np.ascontiguousarray(outer)

    @staticmethod
    def _normalised(predicted: np.ndarray, vectors: np.ndarray, true: np.ndarray) -> np.ndarray:
        out = np.empty(len(true))
        scores = np.empty((min(BLOCK, len(true)), len(vectors)), np.float32)
        ones = np.ones(len(vectors), np.float32)
        for at in range(0, len(true), BLOCK):
            t = true[at : at + BLOCK]
            block = scores[: len(t)]
            np.matmul(predicted[at : at + BLOCK], vectors.T, out=block)
            if block.max() > 60:  # beyond the range of single precision after exp
                block -= block.max(axis=1, keepdims=True)
            own = block[np.arange(len(t)), t].astype(float)
            np.exp(block, out=block)
            out[at : at + BLOCK] = own - np.log(block @ ones)
        return out

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        m = self.model
        predicted = np.empty((len(target), DIM + 1), np.float32)
        for at in range(0, len(target), SUMMED):  # few enough to stay in the cache
            few = context[at : at + SUMMED]
            predicted[at : at + SUMMED] = sum(self.weighted[k][few[:, k]] for k in range(PLACES))
        out = self._normalised(predicted, self.outer, m.first[target])
        grouped = np.flatnonzero((target >= m.single) & (target < m.words))
        group = m.group[target[grouped] - m.single]
        grouped = grouped[np.argsort(group.astype(np.int16), kind="stable")]
        ends = np.cumsum(np.bincount(group, minlength=len(m.bounds) - 1))
        for g in np.flatnonzero(np.diff(ends, prepend=0)):
            few = grouped[ends[g - 1] if g else 0 : ends[g]]
            low = m.bounds[g]
            out[few] += self._normalised(predicted[few], self.inner[low : m.bounds[g + 1]], target[few] - low)
        return out / np.log(10)


# ---- scoring -------------------------------------------------------------------------------------

PARTIAL = "row long, id long, n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>"


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), train.alias("train"))
    training = rows.filter("train")
    counted = count_words(training)
    counts = summarise(counted, training.count())
    table = train_model(training, counts, F.col("id"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_of = counts.base(counts.counts)
        ending = (counts.words & np.uint64(ENDINGS - 1)).astype(np.int64)
        inside = np.where(counts.classes < counts.model.words, 0.0, counts.within(counts.counts, ending))
        end_base = counts.base(counts.texts)
        scorer = Scorer(table, counts.model)
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, context, lengths, words, ids, at, known = sequences(part.column("text"), counts)
                n = len(lengths)
                owner, of = np.repeat(np.arange(n), lengths), np.repeat(np.arange(n), words)
                at = at[known]
                score = np.bincount(owner, scorer.log_probabilities(context, tokens), n)
                score += np.bincount(of[known], inside[at], n)
                base = np.bincount(of[known], base_of[at], n) + end_base
                n_known = np.bincount(of[known], minlength=n) + (counts.texts > 0)
                rare, its = ids[~known], of[~known]
                order = np.lexsort((rare, its))
                rare, its = rare[order], its[order]
                fresh = np.ones(len(rare), bool)
                fresh[1:] = (rare[1:] != rare[:-1]) | (its[1:] != its[:-1])
                begins = np.flatnonzero(fresh)
                times = np.diff(np.append(begins, len(rare))).astype(np.int32)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(its[begins], minlength=n))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("id"), pa.array(lengths), pa.array(n_known), pa.array(base), pa.array(score),
                        pa.ListArray.from_arrays(ends, pa.array(rare[begins].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times)),
                    ],
                    names=["row", "id", "n_tokens", "n_known", "base", "score", "rare", "times"],
                )

    partial = stored(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(work, PARTIAL), "scores")
    pairs = partial.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        "row", F.col("w.rare").alias("word"), F.col("w.times").alias("times")
    )
    tail = counted.filter(F.col("c") < counts.least) if counts.least is not None else counted
    c = F.coalesce("c", F.lit(0))
    bottom = F.lit(float(counts.tokens + SMOOTH * (counts.distinct + 1)))
    bottoms = F.array(*[F.lit(float(o + SMOOTH * (d + 1))) for o, d in zip(counts.outside, counts.outside_distinct, strict=True)])
    ending = (F.col("word").bitwiseAND(F.lit(ENDINGS - 1))).cast("int")
    sums = (
        pairs.join(tail, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"),
            F.sum(F.col("times") * F.log10((c + SMOOTH) / bottom)).alias("base_more"),
            F.sum(F.col("times") * F.log10((c + SMOOTH) / bottoms[ending])).alias("score_more"),
        )
    )
    zero = F.lit(0.0)
    return partial.drop("rare", "times").join(sums, "row", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("score_more", zero)).alias("score"),
    )


@llm_query("op5_lm", "documents")
def op5_lm(docs: DataFrame, folder: str) -> DataFrame:
    scored = score_texts(docs.select("doc_id", "text"), fold("doc_id", 10) != 0)
    return scored.withColumn("held_out", fold("doc_id", 10) == 0)
