import json

import pytest
from pyspark.sql import functions as F

from tabwright.functions import text as tx
from tabwright.operators import texts as op


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"a": 1}', {"a": 1}),
        ('say ```json\n{"a": {"b": 2}}\n``` end', {"a": {"b": 2}}),
        ('```\n{"a": 3}\n```', {"a": 3}),
        ('{{"a": "x"}}', {"a": "x"}),
        ('noise {oops\n  {"a": 4}  \nmore }', {"a": 4}),
        ('{"a": {"b": {"c": 5}}}', {"a": {"b": {"c": 5}}}),
        ('{"a": 6, "b": {"c": 7', {"a": 6, "b": {"c": 7}}),
        ('{"a": 8, "tru', {"a": 8}),
        ("nothing", None),
        ("", None),
    ],
)
def test_json_text(spark, text, expected):
    got = one(spark, text, tx.json_text)
    assert (json.loads(got) if got is not None else None) == expected


def test_reasoning(spark):
    def split(text):
        r = one(spark, text, tx.reasoning)
        return r["thinking"], r["result"], r["has_thinking"]

    assert split("<think>a</think> b <THINK>c\nd</THINK>e") == ("a\n\nc\nd", "b e", True)
    assert split("[THINKING]x[/THINKING]\ny ") == ("x", "y", True)
    assert split("Reasoning: why\nAnswer: 42 ") == ("why", "42", True)
    assert split("pre Let me think: hm Final Answer: yes") == ("hm", "yes", True)
    assert split("Step by step: only this") == ("only this", "", True)
    assert split("<think></think> plain ") == ("", "<think></think> plain", False)
    assert split("  just text ") == ("", "just text", False)


def test_metrics(spark):
    logs = spark.createDataFrame(
        [("RMSE: 2.5\nR²: -0.5 f1: 0.25",), ("mse:4 MSE: 9 Accuracy: 1.2.3",), ("none",)], "text string"
    )
    got = [r.asDict() for r in op.extract_metrics(logs).drop("text").collect()]
    assert (got[0]["root_mean_squared_error"], got[0]["mean_squared_error"], got[0]["r_squared"]) == (2.5, None, -0.5)
    assert (got[0]["f1_score"], got[1]["mean_squared_error"], got[1]["accuracy"]) == (0.25, 4.0, None)
    assert set(got[2].values()) == {None}


def test_normalize(spark):
    df = spark.createDataFrame(
        [({"a": "None", "b": "True", "c": '["x"]', "d": "[[7]]", "e": "[1, 2]", "f": " null ", "g": "5"},)],
        "m map<string,string>",
    )
    got = op.normalize_json(df, "m").first()["m"]
    assert got == {"a": None, "b": "true", "c": "x", "d": "7", "e": "[1, 2]", "f": None, "g": "5"}


def test_tool_calls(spark):
    texts = spark.createDataFrame(
        [
            (1, '```json\n{"tool": "a", "arguments": {"x": 1}}\n```\n```json\n[{"tool": "b"}, {"no": 1}]\n```'),
            (2, ' {"tool": "c", "arguments": {}} '),
            (3, "```json\n{broken}\n```"),
            (4, ""),
        ],
        "id int, text string",
    )
    got = [(r["id"], r["call"], r["tool"], r["arguments"]) for r in op.extract_tool_calls(texts).orderBy("id", "call").collect()]
    assert got == [(1, 0, "a", '{"x":1}'), (1, 1, "b", None), (2, 0, "c", "{}")]


def test_params(spark):
    code = 'a = 1\nmodel_params = {"n": "5", "d": "None"}\nmodel_params = {"n": 9}'
    assert one(spark, code, tx.params_from_code) == {"n": "5", "d": None}
    assert one(spark, "model_params = {broken}", tx.params_from_code) is None


def test_issue_scores_agree(spark):
    codes = spark.createDataFrame(
        [(1, "eval(x); exec(y); os.system(z); pickle.load(f)"), (2, "while True:\n  pass"), (3, "ok")],
        "id int, text string",
    )
    direct = {r["id"]: r["security_score"] for r in op.code_scores(codes).collect()}
    counted = {r["id"]: r["security_score"] for r in op.scores_from_issues(op.scan_code(codes), "id").collect()}
    assert direct == {1: 0.0, 2: 8.0, 3: 10.0}
    assert counted == {1: 0.0, 2: 8.0}
