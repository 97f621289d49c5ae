"""Find secrets with a trigram inverted index.

Each rule's pattern is turned into a Boolean query over the trigrams that any
match must hold (case of A-Z folded).  Every slice of documents is an index
segment of its own: postings from trigrams to documents, kept for the trigrams that some
rule asks for, since no other can be looked up.  The query intersects and unites
postings; only the documents it leaves are searched with the pattern.  A rule without
mandatory trigrams searches every document.  Segments are bounded by bytes, so
nothing is shuffled and no posting list grows with the corpus.

Null and empty texts have no spans.  Spans of one rule are leftmost and do not
overlap; starts and ends count code points, the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.batches import LOWER, flat, slices
from tabwright.llm.columns import free_names
from tabwright.llm.registry import llm_query


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which ties are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of [0-9a-f]+ that have 24 characters or more
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("login", r"://[^\s/:@]+:[^\s/:@]+@"),
)
MOST_STRINGS, MOST_LETTERS = 64, 8
ANY = ("and", ())  # holds for every document


def _both(a, b):
    return b if a == ANY else a if b == ANY else ("and", (a, b))


def _holds(strings: set[str]):
    """Some of the strings occurs: each needs all of its trigrams."""
    ways = []
    for s in sorted(strings):
        raw = s.encode()
        grams = sorted({raw[i : i + 3] for i in range(len(raw) - 2)})
        if not grams:
            return ANY
        ways.append(("and", tuple(grams)))
    return ("or", tuple(ways)) if ways else ANY


def _letters(items) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            found.add(chr(arg).lower() if arg < 128 else chr(arg))
        elif op is sre.RANGE and arg[1] < 128:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
        if len(found) > MOST_LETTERS:
            return None
    return found


def _read(sequence) -> tuple[set[str] | None, tuple]:
    """All strings a parsed pattern can match, if few, and what a match must hold otherwise."""
    query, run, exact = ANY, {""}, True
    for op, arg in sequence:
        strings, inner = None, ANY
        if op is sre.LITERAL:
            strings = {chr(arg).lower() if arg < 128 else chr(arg)}
        elif op is sre.IN:
            strings = _letters(arg)
        elif op is sre.SUBPATTERN:
            strings, inner = _read(arg[3])
        elif op is sre.BRANCH:
            ways = [_read(way) for way in arg[1]]
            if all(s is not None for s, _ in ways):
                strings = set().union(*(s for s, _ in ways))
            else:
                needs = [q if s is None else _holds(s) for s, q in ways]
                inner = ANY if ANY in needs else ("or", tuple(needs))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, body = arg
            strings, once = _read(body)
            if strings is not None and len(strings) ** min(max(int(least), 1), 8) <= MOST_STRINGS and least <= 8:
                times = {"".join(p) for p in product(strings, repeat=int(least))}
                if most == least:
                    strings = times
                elif (least, most) == (0, 1):
                    strings = times | strings
                else:  # the strings of the shortest form, then anything
                    joined = {a + b for a, b in product(run, times)} if len(run) * len(times) <= MOST_STRINGS else run
                    run, strings, inner = joined, None, ANY
            else:
                strings, inner = None, once if least else ANY
        elif op is sre.AT:
            continue
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        exact = False
        query = _both(_both(query, _holds(run)), inner if strings is None else ANY)
        run = {""} if strings is None else strings
    return (run, ANY) if exact else (None, _both(query, _holds(run)))


def trigram_query(pattern: str):
    """The Boolean query of a pattern: nested ("and"|"or", parts) over trigrams; ``ANY`` if none is mandatory."""
    strings, query = _read(sre_parser.parse(pattern))
    return query if strings is None else _holds(strings)


def _grams(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(_grams, query[1]), set())


class Segment:
    """The inverted index of one slice: for each asked trigram the documents that hold it."""

    def __init__(self, texts: pa.Array, asked: Sequence[bytes], numbers: np.ndarray):
        data, bounds = flat(texts)
        low = LOWER[data].astype(np.int32)
        self.size = len(bounds) - 1
        self.postings = {g: np.zeros(0, np.int64) for g in asked}
        if len(low) < 3:
            return
        found = numbers[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(found)
        doc = np.searchsorted(bounds, at, "right") - 1
        inside = at + 2 < bounds[doc + 1]
        pairs = np.unique(found[at[inside]].astype(np.int64) * self.size + doc[inside])
        gram, doc = pairs // self.size, pairs % self.size
        ends = np.searchsorted(gram, np.arange(1, len(asked) + 2))
        self.postings = {g: doc[ends[i] : ends[i + 1]] for i, g in enumerate(asked)}

    def find(self, query) -> np.ndarray:
        """Numbers of the documents for which the query holds."""
        if isinstance(query, bytes):
            return self.postings[query]
        if query == ANY:
            return np.arange(self.size)
        parts = sorted((self.find(q) for q in query[1]), key=len)
        out = parts[0]
        for part in parts[1:]:
            out = np.intersect1d(out, part, assume_unique=True) if query[0] == "and" else np.union1d(out, part)
        return out


def _gram_numbers(asked: Sequence[bytes]) -> np.ndarray:
    """For each of the 2**24 trigrams its number among the asked ones, 0 for the others."""
    numbers = np.zeros(1 << 24, np.int16)
    for i, g in enumerate(asked):
        numbers[int.from_bytes(g, "big")] = i + 1
    return numbers


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, text_col: str = "text", name: str = "spans") -> DataFrame:
    """Append the spans of all rules, ordered by start, then by the order of the rules."""
    (name,) = free_names(docs, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        asked = sorted(set().union(*map(_grams, queries), set()))
        numbers = _gram_numbers(asked)
        patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(text_col).to_pylist()
                segment = Segment(part.column(text_col), asked, numbers)
                found: list[list[tuple]] = [[] for _ in texts]
                for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                    for i in segment.find(query):
                        for m in patterns[k].finditer(texts[i] or ""):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                found[i].append((m.start(), k, m.end()))
                spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(f)] for f in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], names=schema.names)

    return docs.mapInArrow(work, schema)


def _listed(spans: Column) -> Column:
    shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


@llm_query("op4_secrets", "documents")
def op4_secrets(docs: DataFrame, folder: str) -> DataFrame:
    found = scan_secrets(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    counts = [F.size(_of_kind(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
