"""Column expressions that pull structure out of text; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: metric names and the labels they are printed with
METRIC_LABELS = {
    "mean_absolute_error": "MAE",
    "mean_squared_error": "MSE",
    "root_mean_squared_error": "RMSE",
    "r_squared": "R2|R²|R-squared",
    "accuracy": "Accuracy",
    "precision": "Precision",
    "recall": "Recall",
    "f1_score": "F1|F1-Score|F1 Score",
}

# fixed values: what an error looks like on the error stream
ERROR_WORDS = [
    "Error:", "Exception:", "Traceback", "SyntaxError",
    "ImportError", "ModuleNotFoundError", "FileNotFoundError",
    "PermissionError", "exit(1)", "sys.exit(1)",
    "IndentationError", "NameError", "TypeError", "ValueError",
    "KeyError", "AttributeError", "RuntimeError",
]

# fixed values: markers around the reasoning part of an answer
THINK_TAG = r"(?is)<think>(.*?)</think>"
THINK_MARKER = r"(?is)\[THINKING\](.*?)\[/THINKING\]"
THINK_PHRASES = ["Reasoning:", "Let me think:", "Step by step:"]
PHRASE_END = r"(.*?)(?=Answer:|Final Answer:|$)"
FINAL_ANSWER = r"(?is)(?:Answer|Final Answer):\s*(.*?)$"

# fixed values: lines that wrap code in an answer
FENCE_LINES = [
    r"(?md)^\s*```[\w]*\s*",
    r"(?md)\s*```\s*$",
    r"(?md)^\s*# Output:\s*$",
    r"(?md)^\s*# Ausgabe:\s*$",
]

REPAIR_WINDOW = 100


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def metric(text: Column, labels: str) -> Column:
    """The first number printed after one of the labels; NULL when absent or no number."""
    found = F.regexp_extract(text, rf"(?i)\b(?:{labels}):\s*(-?[\d.]+)", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def has_error(stderr: Column, returncode: Column) -> Column:
    pattern = "|".join(word.replace("(", r"\(").replace(")", r"\)").replace(".", r"\.") for word in ERROR_WORDS)
    return F.coalesce(returncode != 0, F.lit(False)) | F.coalesce(stderr.rlike(pattern), F.lit(False))


def count_of(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def _last(text: Column, character: str) -> Column:
    """0-based place of the last occurrence, -1 when there is none."""
    at = F.instr(F.reverse(text), character)
    return F.when(at == 0, -1).otherwise(F.length(text) - at)


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def repair_json(text: Column) -> Column:
    """Close a truncated object; NULL when nothing is missing or the result is no JSON."""
    body = F.rtrim(text)
    missing = count_of(text, "{") - count_of(text, "}")
    comma, colon = _last(body, ","), _last(body, ":")
    cut = (comma > colon) & (comma > F.length(body) - REPAIR_WINDOW)
    closed = F.concat(
        F.when(cut, F.substr(body, F.lit(1), comma)).otherwise(body),
        F.repeat(F.lit("}"), F.greatest(missing, F.lit(0))),
    )
    whole = bind(closed, lambda c: F.when(is_json(c), c))
    return F.when(F.ltrim(text).startswith("{") & (missing > 0), whole)


def json_text(text: Column) -> Column:
    """The JSON held in a text: the whole, a fenced block, the outermost braces, a line, or a repair."""
    # braces that a template has doubled are undone only where the text as it stands holds no JSON
    clean = F.replace(F.replace(text, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))

    def checked(candidate: Column) -> Column:
        return F.when(is_json(candidate), candidate)

    def braced(source: Column) -> Column:
        return F.nullif(F.regexp_extract(source, r"(?s)\{.*\}", 0), F.lit(""))

    def fenced(source: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(source, pattern, 1), F.lit(""))

    outer = braced(clean)
    lines = F.filter(
        F.transform(F.split(clean, "\n"), lambda line: F.trim(line)),
        lambda line: line.startswith("{") & line.endswith("}") & is_json(line),
    )
    fences = (r"(?s)```json\s*(\{.*?\})\s*```", r"(?s)```\s*(\{.*?\})\s*```")
    return F.coalesce(
        checked(text),
        *[checked(fenced(text, f)) for f in fences],
        checked(braced(text)),
        checked(clean),
        *[checked(fenced(clean, f)) for f in fences],
        checked(outer),
        F.get(lines, 0),
        repair_json(outer),
        repair_json(F.nullif(F.regexp_extract(clean, r"(?s)\{.*", 0), F.lit(""))),
    )


def normalize_value(value: Column) -> Column:
    """Python spellings of null and booleans, and lists of one, as plain values."""
    listed = F.when(value.rlike(r"(?s)^\s*\[.*\]\s*$"), F.from_json(value, "array<string>"))
    opened = bind(listed, lambda items: F.when(F.size(items) == 1, F.get(items, 0)).otherwise(value))

    def plain(text: Column) -> Column:
        word = F.trim(text)
        return (
            F.when(word.isin("None", "null"), F.lit(None))
            .when(word == "True", "true")
            .when(word == "False", "false")
            .otherwise(text)
        )

    return bind(opened, plain)


def normalize_map(values: Column) -> Column:
    # a list of one may hold another list of one
    return F.transform_values(values, lambda _, v: bind(normalize_value(v), normalize_value))


def params_from_code(text: Column) -> Column:
    """The first ``model_params = {…}`` line as a map of normalised values."""
    found = F.nullif(F.regexp_extract(text, r"model_params = (\{.*\})", 1), F.lit(""))
    return F.when(is_json(found), normalize_map(F.from_json(found, "map<string,string>")))


def strip_fences(text: Column) -> Column:
    for pattern in FENCE_LINES:
        text = F.regexp_replace(text, pattern, "")
    return strip(text)


def reasoning(text: Column) -> Column:
    """``thinking``, ``result`` and ``has_thinking`` as a struct."""

    def joined(pattern: str) -> Column:
        return F.array_join(F.regexp_extract_all(text, F.lit(pattern), 1), "\n\n")

    def without(pattern: str) -> Column:
        return strip(F.regexp_replace(text, pattern, ""))

    def found(thinking: Column, result: Column) -> Column:
        return F.struct(thinking.alias("thinking"), result.alias("result"))

    by_tag, by_marker = joined(THINK_TAG), joined(THINK_MARKER)
    chosen = F.when(by_tag != "", found(by_tag, without(THINK_TAG))).when(
        by_marker != "", found(by_marker, without(THINK_MARKER))
    )
    for phrase in THINK_PHRASES:
        pattern = f"(?is){phrase}{PHRASE_END}"
        answer = F.when(text.rlike(FINAL_ANSWER), F.regexp_extract(text, FINAL_ANSWER, 1)).otherwise(
            F.regexp_replace(text, pattern, "")
        )
        chosen = chosen.when(text.rlike(f"(?i){phrase}"), found(joined(pattern), strip(answer)))
    chosen = chosen.otherwise(found(F.lit(""), text))
    has_any = chosen["thinking"] != ""
    return F.struct(
        strip(chosen["thinking"]).alias("thinking"),
        F.when(has_any, chosen["result"]).otherwise(strip(text)).alias("result"),
        has_any.alias("has_thinking"),
    )


TOOL_BLOCK = r"(?i)```json\s*(\{[\s\S]*?\}|\[[\s\S]*?\])\s*```"
CALL_SCHEMA = "array<struct<tool:string,arguments:string>>"


def tool_calls(text: Column) -> Column:
    """Calls written as JSON in fenced blocks or, failing that, as the whole text."""

    def calls_in(block: Column) -> Column:
        body = F.trim(block)
        as_list = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
        parsed = F.from_json(F.when(is_json(body), as_list), CALL_SCHEMA)
        return F.coalesce(F.filter(parsed, lambda c: c["tool"].isNotNull()), F.from_json(F.lit("[]"), CALL_SCHEMA))

    fenced = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TOOL_BLOCK), 1), calls_in))
    return F.when(F.size(fenced) > 0, fenced).otherwise(calls_in(strip(text)))
