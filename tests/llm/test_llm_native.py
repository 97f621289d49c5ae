"""Preference formatting, mixing and exact dedup: SQL on the tables, rules on awkward rows."""

import oracle
import pytest
from brute import SCHEMA, awkward, words
from conftest import SMALL, plan

import corpus_pipeline
from tabwright.llm import exact_dedup, mixing, preferences

NATIVE = ["op1_preferences", "op3_mix", "op7_exact_dedup"]


@pytest.mark.parametrize("name", NATIVE)
def test_agrees_with_sql(spark, name):
    df = corpus_pipeline.LLM_QUERIES[name](spark, SMALL)
    assert oracle.differences(df, oracle.connect(SMALL), corpus_pipeline.LLM_SQL[name]) is None
    assert "Python" not in plan(df) and "Arrow" not in plan(df)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


def test_dedup_groups_awkward_rows(odd):
    got = exact_dedup.dedup_decisions(odd).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert len(got) == odd.count()
    assert {by_id[0][0]["keep_id"], by_id[1][0]["keep_id"]} == {1} and by_id[1][0]["group_size"] == 2
    assert by_id[3][0]["keep_id"] == 4 and not by_id[3][0]["kept"]
    assert {r["keep_id"] for r in by_id[5]} == {6} and by_id[6][0]["group_size"] == 3
    assert by_id[17][0]["keep_id"] == 17 and by_id[18][0]["keep_id"] == 18, "only A-Z are lower-cased"
    assert by_id[None][0]["kept"] and by_id[2][0]["group_size"] == 1


def test_dedup_keeps_one_of_each(spark, odd):
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns
    texts = [(r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").lower() for t in texts} | {1, 2})  # É and é, Ü and ü differ
    twice = spark.createDataFrame([(1, "a", "en", "s", 1)] * 3, SCHEMA)
    assert exact_dedup.exact_dedup(twice).count() == 1
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0 and exact_dedup.dedup_decisions(odd.limit(0)).count() == 0


def test_helper_columns_may_be_taken(spark):
    rows = [(1, "a b", "s", 1, 2, 3, 4), (2, "A B", "s", 1, 2, 3, 4)]
    names = "doc_id long, text string, source string, content_hash int, keep_id int, mix_copies int, MIX_target int"
    docs = spark.createDataFrame(rows, names)
    assert [tuple(r) for r in exact_dedup.exact_dedup(docs).collect()] == [rows[1]]
    assert set(map(tuple, mixing.mix_sources(docs).collect())) <= set(rows)


def test_mix_meets_targets_and_repeats(spark, odd):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 5}" if i % 50 else None, 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    decided = [tuple(r) for r in mixing.mix_decisions(docs).collect()]
    again = [tuple(r) for r in mixing.mix_decisions(docs.repartition(3)).collect()]
    assert sorted(map(str, decided)) == sorted(map(str, again))
    size, target, taken = {}, {}, {}
    for doc_id, text, _, source, _, source_size, goal, copies in decided:
        n = len(words(text))
        size[source], target[source] = size.get(source, 0) + n, goal
        assert source_size > 0 and copies <= 2
        taken[source] = taken.get(source, 0) + n * copies
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(target[s] <= 2 * size[s] and taken[s] == pytest.approx(target[s], rel=0.1, abs=60) for s in size)
    assert mixing.mix_sources(docs).count() == sum(r[-1] for r in decided)
    assert mixing.mix_sources(odd).columns == odd.columns
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_mix_with_many_sources_is_salted(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", f"s{i % 5}", 0) for i in range(500)], SCHEMA)
    usual = sorted(map(str, mixing.mix_decisions(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 2)
    assert sorted(map(str, mixing.mix_decisions(docs).collect())) == usual


def _turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt int")


def test_pairs_share_their_prefix_once(spark):
    chosen = _turns(spark, [(1, 0, "user", "hi", 0), (1, 1, "assistant", "good", 0), (1, 2, "user", "more", 0), (2, 0, None, None, 0), (3, 0, "user", "x", 0)])
    rejected = _turns(spark, [(1, 0, "user", "hi", 0), (1, 1, "assistant", "bad", 0), (2, 0, "user", "", 0), (4, 0, "user", "y", 0)])
    got = {r["conv_id"]: r for r in preferences.format_preferences(preferences.pair_conversations(chosen, rejected)).collect()}
    one = got[1]
    assert one["prompt"] == "<|user|>\nhi<|end|>\n" and one["n_prompt_turns"] == 1
    assert one["chosen"] == "<|assistant|>\ngood<|end|>\n<|user|>\nmore<|end|>\n"
    assert one["rejected"] == "<|assistant|>\nbad<|end|>\n"
    learned = "".join(c for c, m in zip(one["chosen"], one["chosen_mask"], strict=True) if m == "1")
    assert learned == "good<|end|>\n" and len(one["rejected_mask"]) == len(one["rejected"])
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["n_prompt_turns"] == 1, "null role and text have defaults"
    assert got[3]["prompt"] == "" and got[3]["rejected"] == "" and got[4]["chosen"] == ""


def test_conversations_with_ties_nulls_and_no_rows(spark):
    rows = [(None, 0, "user", "a", 0), (7, 1, "assistant", "b", 0), (7, 1, "assistant", "b", 0), (7, None, "user", "first", 0)]
    arrays = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in preferences.conversation_arrays(_turns(spark, rows)).collect()}
    assert arrays == {None: ["a"], 7: ["first", "b", "b"]}
    assert corpus_pipeline.LLM_QUERIES.keys() >= set(NATIVE)
    assert preferences.op1_preferences(_turns(spark, rows), "").count() == 2
    assert preferences.op1_preferences(_turns(spark, rows).limit(0), "").count() == 0
