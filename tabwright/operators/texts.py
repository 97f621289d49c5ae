"""Operators over tables of texts (logs, answers, generated code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import text as tx

# fixed values: code patterns that make a text critical, with their messages
DANGEROUS = [
    (r"eval\s*\(", "Use of eval() is dangerous"),
    (r"exec\s*\(", "Use of exec() is dangerous"),
    (r"__import__\s*\(", "Dynamic imports can be dangerous"),
    (r"os\.system\s*\(", "Use of os.system() is dangerous"),
    (r"subprocess\.call\s*\(.*shell\s*=\s*True", "Shell=True in subprocess is dangerous"),
    (r"pickle\.loads?\s*\(", "Pickle can execute arbitrary code"),
]
SCALED_ALGORITHMS = ["SVC", "SVR", "KNeighbors", "LogisticRegression"]
SCALERS = ["StandardScaler", "MinMaxScaler"]
PRINT_LIMIT = 5

# fixed values: points lost per issue
SECURITY_COST = {"critical": 3.0, "high": 2.0, "medium": 1.0}
QUALITY_COST = {"high": 2.0, "medium": 1.0}
OTHER_COST = 0.5

ISSUE = "array<struct<kind:string,type:string,severity:string,message:string>>"


def extract_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """One column per metric with the first number printed for it."""
    return df.withColumns({name: tx.metric(F.col(text), labels) for name, labels in tx.METRIC_LABELS.items()})


def extract_json(df: DataFrame, text: str = "text", name: str = "json") -> DataFrame:
    """Append the JSON found in a text as a VARIANT; NULL where there is none."""
    return df.withColumn(name, F.try_parse_json(tx.json_text(F.col(text))))


def normalize_json(df: DataFrame, values: str) -> DataFrame:
    return df.withColumn(values, tx.normalize_map(F.col(values)))


def repair_json(df: DataFrame, text: str = "text", name: str = "repaired") -> DataFrame:
    return df.withColumn(name, tx.repair_json(F.col(text)))


def split_reasoning(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("_r", tx.reasoning(F.col(text))).select(*df.columns, "_r.*")


def extract_tool_calls(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per call, in order of appearance."""
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.posexplode(tx.tool_calls(F.col(text))).alias("call", "_c")).select(
        *kept, "call", "_c.tool", "_c.arguments"
    )


def strip_code_fences(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, tx.strip_fences(F.col(text)))


def has_error(df: DataFrame, stderr: str = "stderr", returncode: str = "returncode") -> DataFrame:
    return df.withColumn("has_error", tx.has_error(F.col(stderr), F.col(returncode)))


def params_from_code(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("params", tx.params_from_code(F.col(text)))


def _issues(code: Column) -> Column:
    """Everything the rules find in a text, as an array."""

    def issue(when: Column, kind: str, type_: str, severity: str, message: Column | str) -> Column:
        said = message if isinstance(message, Column) else F.lit(message)
        return F.when(
            when,
            F.struct(
                F.lit(kind).alias("kind"), F.lit(type_).alias("type"), F.lit(severity).alias("severity"),
                said.alias("message"),
            ),
        )

    prints = F.regexp_count(code, F.lit(r"\bprint\s*\("))
    any_of = lambda words: code.rlike("|".join(words))
    found = [issue(code.rlike(p), "security", "security_risk", "critical", m) for p, m in DANGEROUS]
    found += [
        issue(
            code.rlike(r"while\s+True\s*:") & ~code.contains("break"),
            "security", "infinite_loop", "high", "Potential infinite loop detected (while True without break)",
        ),
        issue(
            code.rlike(r"(?i)password\s*=\s*[\"']"),
            "quality", "hardcoded_credential", "medium", "Hardcoded password detected",
        ),
        issue(
            code.contains("try:") & code.contains("except:"),
            "quality", "bare_except", "low", "Bare except clause - should specify exception type",
        ),
        issue(
            prints > PRINT_LIMIT,
            "quality", "excessive_prints", "low",
            F.format_string("Excessive print statements (%d) - consider using logging", prints),
        ),
        issue(
            code.contains("fit(") & ~code.contains("train_test_split"),
            "practice", "missing_train_test_split", "medium",
            "Model training without train-test split detected",
        ),
        issue(
            any_of(SCALED_ALGORITHMS) & ~any_of(SCALERS),
            "practice", "missing_scaling", "medium", "Algorithm may benefit from feature scaling",
        ),
    ]
    return F.array_compact(F.array(*found)).cast(ISSUE)


def scan_code(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per finding."""
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.inline(_issues(F.col(text))))


def _cost(severity: Column, costs: dict[str, float]) -> Column:
    cost = F.lit(OTHER_COST)
    for name, points in costs.items():
        cost = F.when(severity == name, points).otherwise(cost)
    return cost


def code_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """Security and quality points of every text, findings or not; needs no shuffle."""
    scanned = df.withColumn("_issues", _issues(F.col(text)))

    def score(kind: str, costs: dict[str, float]) -> Column:
        lost = F.aggregate(
            F.filter("_issues", lambda i: i["kind"] == kind),
            F.lit(0.0),
            lambda total, i: total + _cost(i["severity"], costs),
        )
        return F.greatest(F.lit(0.0), 10 - lost)

    return scanned.select(
        *[c for c in df.columns if c != text],
        score("security", SECURITY_COST).alias("security_score"),
        score("quality", QUALITY_COST).alias("quality_score"),
    )


def scores_from_issues(issues: DataFrame, key: str) -> DataFrame:
    """The same points from a table of findings; only keys with findings appear."""

    def score(kind: str, costs: dict[str, float]) -> Column:
        lost = F.sum(F.when(F.col("kind") == kind, _cost(F.col("severity"), costs)).otherwise(0.0))
        return F.greatest(F.lit(0.0), 10 - lost)

    return issues.groupBy(key).agg(
        score("security", SECURITY_COST).alias("security_score"),
        score("quality", QUALITY_COST).alias("quality_score"),
    )


def merge_issues(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All findings of the first review, and those of the second of a type the first lacks."""
    known = first.select(key, "type").distinct()
    return first.unionByName(second.join(known, [key, "type"], "left_anti"))


def merge_scores(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Weighted points of two reviews (fixed weights), one decimal."""
    other = second.select(
        key, F.col("security_score").alias("_security"), F.col("quality_score").alias("_quality")
    )
    return first.join(other, key).select(
        key,
        F.round(F.col("security_score") * 0.6 + F.col("_security") * 0.4, 1).alias("security_score"),
        F.round(F.col("quality_score") * 0.4 + F.col("_quality") * 0.6, 1).alias("quality_score"),
    )


def is_safe(scores: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """Safe means no critical finding and at least 5 security points."""
    critical = issues.filter(F.col("severity") == "critical").select(key).distinct().withColumn("_c", F.lit(True))
    return scores.join(critical, key, "left").select(
        *scores.columns, (F.col("_c").isNull() & (F.col("security_score") >= 5)).alias("is_safe")
    )
