"""Preference formatting: shared prompt, paired completions with loss masks.

A pair holds two conversations as arrays of (role, text) turns.  Their longest
common prefix of equal turns is rendered once as the prompt; what is left of
each becomes its completion, with a mask of one character per code point: 1
where an assistant's text and its end mark are to be learned, 0 elsewhere.

Null roles read as ``user``, null texts as empty; turns are ordered by number,
then role, then text, nulls first, and repeated turns are kept; rows without a
conversation id form one conversation.  Identical conversations give empty
completions.  A pair is one output row, so its turns meet in one task; nothing
larger than a conversation is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.registry import llm_query

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def _turn() -> Column:
    """(turn, role, text), in the order in which turns sort."""
    return F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def _said(turns: Column) -> Column:
    return F.transform(F.array_sort(turns), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def conversation_arrays(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation with its turns in order."""
    return turns.groupBy(id_col).agg(_said(F.collect_list(_turn())).alias("turns"))


def pair_conversations(chosen: DataFrame, rejected: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Pair two tables of turns by id; a conversation absent on one side has no turns there."""
    sides = [d.select(F.col(id_col), F.lit(k).alias("side"), _turn().alias("t")) for k, d in enumerate((chosen, rejected))]
    both = sides[0].unionByName(sides[1])
    return both.groupBy(id_col).agg(
        *[_said(F.collect_list(F.when(F.col("side") == k, F.col("t")))).alias(n) for k, n in enumerate(("chosen", "rejected"))]
    )


def _render(turns: Column) -> Column:
    shown = F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END)))
    return F.array_join(shown, "")


def _mask(turns: Column) -> Column:
    marks = F.transform(
        turns,
        lambda t: F.concat(
            F.repeat(F.lit("0"), F.char_length(t["role"]) + len(OPEN + CLOSE)),
            F.repeat(F.when(t["role"] == LEARNED, "1").otherwise("0"), F.char_length(t["text"]) + len(END)),
        ),
    )
    return F.array_join(marks, "")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Replace the arrays ``chosen`` and ``rejected`` by prompt, completions, masks and turn counts."""
    differs = F.zip_with("chosen", "rejected", lambda a, b: ~a.eqNullSafe(b))
    first = F.array_position(differs, True)
    prefix = F.when(first > 0, first - 1).otherwise(F.size("chosen")).cast("int")
    kept = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    rest = {c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.size(c)) for c in ("chosen", "rejected")}
    return pairs.withColumn("n_prompt_turns", prefix).select(
        *kept,
        "n_prompt_turns",
        _render(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        *[F.size(rest[c]).alias(f"n_{c}_turns") for c in rest],
        *[_render(rest[c]).alias(c) for c in rest],
        *[_mask(rest[c]).alias(f"{c}_mask") for c in rest],
    )


def cut_reply(turns: Column, pick: Column) -> Column:
    """A worse version of a conversation: it ends in half of one of its replies.

    ``pick`` chooses the reply, modulo their number; without any reply the last turn goes.
    """
    places = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: F.element_at(turns, i)["role"] == LEARNED)
    place = F.when(
        F.size(places) > 0, F.element_at(places, (F.pmod(F.coalesce(pick, F.lit(0)), F.size(places)) + 1).cast("int"))
    ).otherwise(F.size(turns))
    reply = F.element_at(turns, place)
    half = F.substring(reply["text"], F.lit(1), F.floor(F.char_length(reply["text"]) / 2).cast("int"))
    short = F.slice(turns, F.lit(1), place - 1)
    worse = F.array(F.struct(reply["role"].alias("role"), half.alias("text")))
    return F.when(F.size(places) > 0, F.concat(short, worse)).otherwise(short)


SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS pos
  FROM conversations
), r AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id) AS n,
         count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS n_replies,
         count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY pos) AS reply
  FROM t
), c AS (
  SELECT conv_id, any_value(n) AS n,
         max(CASE WHEN n_replies = 0 THEN n WHEN role = 'assistant' AND reply = 1 + coalesce(conv_id, 0) % n_replies THEN pos END) AS place,
         max(CASE WHEN role = 'assistant' AND reply = 1 + coalesce(conv_id, 0) % n_replies THEN substr(text, 1, (length(text) // 2)::INT) END) AS half,
         max(CASE WHEN role = 'assistant' AND reply = 1 + coalesce(conv_id, 0) % n_replies AND text = '' THEN 1 ELSE 0 END) AS same
  FROM r GROUP BY conv_id
), p AS (
  SELECT r.*, c.place, c.half, CASE WHEN c.same = 1 THEN c.place ELSE c.place - 1 END AS p,
         '<|' || r.role || '|>' || chr(10) || r.text || '<|end|>' || chr(10) AS shown,
         repeat('0', (length(r.role) + 5)::INT) || repeat(CASE WHEN r.role = 'assistant' THEN '1' ELSE '0' END, (length(r.text) + 8)::INT) AS mask
  FROM r JOIN c ON r.conv_id IS NOT DISTINCT FROM c.conv_id
)
SELECT conv_id, any_value(p)::INT AS n_prompt_turns,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (pos <= p), '') AS prompt,
       any_value(n - p)::INT AS n_chosen_turns,
       any_value(CASE WHEN half IS NOT NULL AND p < place THEN 1 ELSE 0 END)::INT AS n_rejected_turns,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (pos > p), '') AS chosen,
       any_value(CASE WHEN half IS NOT NULL AND p < place THEN '<|assistant|>' || chr(10) || half || '<|end|>' || chr(10) ELSE '' END) AS rejected,
       coalesce(string_agg(mask, '' ORDER BY pos) FILTER (pos > p), '') AS chosen_mask,
       any_value(CASE WHEN half IS NOT NULL AND p < place THEN repeat('0', 14) || repeat('1', (length(half) + 8)::INT) ELSE '' END) AS rejected_mask
FROM p GROUP BY conv_id
"""


@llm_query("op1_preferences", "conversations", SQL)
def op1_preferences(turns: DataFrame, folder: str) -> DataFrame:
    """Each conversation against the version of itself that ends in half a reply."""
    arrays = conversation_arrays(turns)
    return format_preferences(
        arrays.select("conv_id", F.col("turns").alias("chosen"), cut_reply(F.col("turns"), F.col("conv_id")).alias("rejected"))
    )
