"""Exact deduplication by content hash with a byte comparison inside each group.

Two texts are equal when they are the same bytes after lower-casing A-Z; null
counts as empty, so null and empty texts are one group.  Rows are grouped by
the 128-bit hash *and* the text, so a hash collision cannot merge different
texts; copies are combined before the shuffle, so a hot text travels once per
task.  The members find their group again by the hash together with a 256-bit
digest, over narrow rows that adaptive execution can split.

Of equal texts the row with the largest id stays, a null id only in a group
without any other.  Rows that repeat both id and text count in ``group_size``;
the filter keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.columns import ascii_lower, free_names, whole_text
from tabwright.llm.registry import llm_query

HASH, DIGEST = "content_hash", "text_sha256"


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).alias("id"), ascii_lower(whole_text(F.col(text_col))).alias("text"))
    return text.withColumns({HASH: F.unhex(F.md5("text")), DIGEST: F.sha2("text", 256)})


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: hash, digest, id of the row that stays, size of the group."""
    groups = _keys(docs, id_col, text_col).groupBy(HASH, "text").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return groups.select(HASH, F.sha2("text", 256).alias(DIGEST), "keep_id", "group_size")


def dedup_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its group and whether it stays."""
    members = _keys(docs, id_col, text_col).select("id", HASH, DIGEST)
    found = members.join(content_groups(docs, id_col, text_col), [HASH, DIGEST])
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        DIGEST,
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, columns untouched.

    The join that drops copies has the id among its keys, so the copies of a
    hot text are spread over all tasks.
    """
    hash_name, digest_name = free_names(docs, HASH, DIGEST)
    keep_name, hash_key, digest_key = free_names(docs.withColumns({hash_name: F.lit(0), digest_name: F.lit(0)}),
                                                 "keep_id", "keep_hash", "keep_digest")
    text = ascii_lower(whole_text(F.col(text_col)))
    marked = docs.withColumns({hash_name: F.unhex(F.md5(text)), digest_name: F.sha2(text, 256)})
    stay = content_groups(docs, id_col, text_col).select(
        F.col("keep_id").alias(keep_name), F.col(HASH).alias(hash_key), F.col(DIGEST).alias(digest_key)
    )
    same = (
        F.col(id_col).eqNullSafe(F.col(keep_name))
        & (F.col(hash_name) == F.col(hash_key))
        & (F.col(digest_name) == F.col(digest_key))
    )
    kept = marked.join(stay, same, "left_semi")
    repeated = _keys(docs, id_col, text_col).groupBy("id", HASH).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates([id_col, hash_name, digest_name])
    return kept.select(*docs.columns)


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


@llm_query("op7_exact_dedup", "documents", SQL)
def op7_exact_dedup(docs: DataFrame, folder: str) -> DataFrame:
    return dedup_decisions(docs)
