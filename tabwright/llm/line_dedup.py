"""Line deduplication: which lines repeat across documents, answered with run-length bitmaps.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  Every line with a key
becomes a narrow row (128-bit hash, document, position).  These rows are partitioned by ranges of
(hash, document) and sorted by hash, document and position inside each range, so a key that a third
of all documents carry is cut into many ranges, and one pass over a sorted range meets the lines of a document
together and the first occurrence of a key before all others.  What a range finds out about a key is one partial
row, merged over the ranges the key touches.

The result is not text but a keep bitmap per document, compressed to runs of kept lines.  ``apply_runs`` makes
the text of it.

Defined cases.  A null text is an empty text, which is one empty line.  Lines with an empty key (fewer
than ``min_length`` code points) are never dropped.  A document is told apart by its id and its text: rows that
repeat both count as one document and get the same bitmap, a null id is an id like any other.  Of equal lines the one with
the smallest (id, hash of the text, position) is the first, a null id before the others.  An empty table gives an empty table.  Columns
of the table that carry the names of helper columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.columns import ascii_lower, free_names, whole_text
from tabwright.llm.components import stored
from tabwright.llm.registry import llm_query

BREAK = "\n"
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one, an empty one."""
    return F.split(whole_text(text), BREAK, -1)


def line_keys(text: Column) -> Column:
    """The keys of all lines, in order."""
    bare = F.transform(lines_of(text), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.transform(bare, ascii_lower)


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 1) -> DataFrame:
    """``h1, h2, id, body, pos``: one row per line with a key, ranged by (hash, document), sorted by position too.

    ``body`` is a hash of the whole text, which tells rows with the same id apart.
    """
    lines = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(whole_text(F.col(text_col))).alias("body"),
        F.posexplode(line_keys(F.col(text_col))).alias("pos", "key"),
    )
    keyed = lines.filter(F.char_length("key") >= max(1, min_length)).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "body", "pos"
    )
    return keyed.repartitionByRange("h1", "h2", "id", "body").sortWithinPartitions("h1", "h2", "id", "body", "pos")


def document_keys(rows: DataFrame) -> DataFrame:
    """One row per key and document with the positions of its lines; the ranges serve, no further shuffle."""
    return rows.groupBy("h1", "h2", "id", "body").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def key_counts(by_document: DataFrame) -> DataFrame:
    """``n_docs`` and the ``first`` occurrence of every key: a partial row per range, merged by key."""
    place = F.struct("id", "body", F.col("positions")[0].alias("pos"))
    return by_document.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min(place).alias("first"))


def dropped_lines(
    docs: DataFrame,
    min_docs: int = 2,
    keep_first: bool = True,
    min_length: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, body, dropped``: the sorted positions a document loses; documents that lose nothing have no row.

    A line goes when its key is found in at least ``min_docs`` documents; with ``keep_first`` the first occurrence of
    the key stays.  The sorted ranges are written once, for the counts and for the lines that go; the repeated keys are
    written too, since adaptive execution splits a hot key only in a join that stands right above both shuffles.
    """
    by_document = stored(document_keys(line_rows(docs, id_col, text_col, min_length)), "lines")
    repeated = key_counts(by_document).filter(F.col("n_docs") >= min_docs)
    if not keep_first:
        repeated = repeated.drop("first")
    repeated = stored(repeated, "repeated")  # a finished table, so that only shuffles lie below the join
    found = by_document.join(repeated, ["h1", "h2"])
    positions = F.col("positions")
    if keep_first:
        owner = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("body") == F.col("first.body"))
        positions = F.when(owner, F.slice(positions, F.lit(2), F.greatest(F.size(positions) - 1, F.lit(0)))).otherwise(positions)
    lost = found.select("id", "body", positions.alias("positions")).filter(F.size("positions") > 0)
    return lost.groupBy("id", "body").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("dropped"))


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """The keep bitmap of a document as runs of kept lines: where each begins and how many lines it has.

    A run of dropped lines begins where the position before is not dropped and ends where the next is not; what
    lies between two of them is kept.
    """
    begins = F.filter(dropped, lambda p, i: (i == 0) | (F.get(dropped, i - 1) != p - 1))
    ends = F.filter(dropped, lambda p, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != p + 1))
    opens = F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + 1))
    closes = F.concat(begins, F.array(n_lines))
    between = F.transform(
        F.arrays_zip(opens.alias("at"), closes.alias("to")),
        lambda r: F.struct(r["at"].alias("at"), (r["to"] - r["at"]).alias("n")),
    )
    whole = F.array(F.struct(F.lit(0).alias("at"), n_lines.alias("n")))
    return F.when(dropped.isNull(), whole).otherwise(F.filter(between, lambda r: r["n"] > 0))


def apply_runs(text: Column, runs: Column) -> Column:
    """The kept lines of a text, joined again; the text is split once."""
    kept = F.transform(
        F.array(lines_of(text)), lambda lines: F.flatten(F.transform(runs, lambda r: F.slice(lines, r["at"] + 1, r["n"])))
    )
    return F.array_join(kept[0], BREAK)


def line_bitmaps(
    docs: DataFrame,
    min_docs: int = 2,
    keep_first: bool = True,
    min_length: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents with ``n_lines``, ``n_dropped`` and ``keep_runs`` (renamed if taken) appended."""
    n_lines, n_dropped, runs, body, lost_id, lost_body, dropped = free_names(
        docs, "n_lines", "n_dropped", "keep_runs", "line_body", "lost_id", "lost_body", "lost_lines"
    )
    lost = dropped_lines(docs, min_docs, keep_first, min_length, id_col, text_col).toDF(lost_id, lost_body, dropped)
    marked = docs.withColumn(body, F.xxhash64(whole_text(F.col(text_col))))
    joined = marked.join(lost, F.col(id_col).eqNullSafe(F.col(lost_id)) & (F.col(body) == F.col(lost_body)), "left")
    count = F.size(lines_of(F.col(text_col)))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        count.cast("long").alias(n_lines),
        F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias(n_dropped),
        keep_runs(F.col(dropped), count).alias(runs),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT r, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), m AS (
  SELECT k.r, k.pos, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key
), t AS (
  SELECT r, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM m GROUP BY r
)
SELECT d.doc_id, t.n_lines, t.n_dropped, sha256(t.kept) AS kept_sha256 FROM d JOIN t ON d.r = t.r
"""


@llm_query("op13_line_dedup", "documents", SQL)
def op13_line_dedup(docs: DataFrame, folder: str) -> DataFrame:
    marked = line_bitmaps(docs.select("doc_id", "text"), min_docs=10, keep_first=False)
    kept = apply_runs(F.col("text"), F.col("keep_runs"))
    return marked.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))
