"""Column profiles of a user table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabwright.operators.edit import quoted
from tabwright.plans.quantiles import exact_quantiles, number

# a value a reader would accept as a number (fixed value)
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def logical_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    return "categorical" if isinstance(data_type, T.StringType) else "unknown"


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if logical_type(f.dataType) == kind]


def is_missing(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return quoted(name).isNull() | F.isnan(quoted(name))
    return quoted(name).isNull()


def _rows(parts: list[Column]) -> Column:
    """One output row per struct."""
    return F.inline(F.array(*parts))


def _schema_table(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, logical_type(f.dataType), f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, logical_type string, dtype string")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def logical_types(df: DataFrame) -> DataFrame:
    return _schema_table(df).select("column", "logical_type")


def type_counts(df: DataFrame) -> DataFrame:
    return logical_types(df).groupBy("logical_type").agg(F.count(F.lit(1)).alias("columns"))


def sniff_types(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """Types judged from the first rows only, as text: a cheap first look."""
    first = (df.orderBy(*order_by) if order_by else df).limit(n)
    numeric = {c: F.coalesce(F.trim(quoted(c).cast("string")) != "", F.lit(False)) for c in df.columns}
    parts = []
    for c in df.columns:
        sample = F.when(numeric[c], quoted(c).cast("string"))
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.when(F.count(sample) == 0, "unknown")
                .when(F.bool_and(sample.rlike(NUMBER_TEXT)), "numeric")
                .otherwise("categorical")
                .alias("sniffed_type"),
            )
        )
    return first.agg(F.array(*parts).alias("_r")).select(F.inline("_r"))


def missing_counts(df: DataFrame) -> DataFrame:
    parts = [
        F.struct(F.lit(c).alias("column"), F.count_if(is_missing(df, c)).alias("missing")) for c in df.columns
    ]
    return df.agg(F.array(*parts).alias("_r")).select(F.inline("_r"))


def _quantile_exprs(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[Column]]:
    """Exact quantiles, found first and entered as literals."""
    found = exact_quantiles(df, columns, probs)
    return {c: [F.lit(v).cast("double") for v in found[c]] for c in columns}


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """min, max, mean, median, sample std and missing share, one row per numeric column."""
    columns = list(columns) if columns is not None else columns_of(df, "numeric")
    median = _quantile_exprs(df, columns, [0.5])
    rows = F.count(F.lit(1))
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.min(number(c)).alias("min"),
            F.max(number(c)).alias("max"),
            F.avg(number(c)).alias("mean"),
            median[c][0].alias("median"),
            F.stddev_samp(number(c)).alias("std"),
            (rows - F.count(number(c))).alias("missing"),
            _share(rows - F.count(number(c)), rows).alias("missing_percentage"),
        )
        for c in columns
    ]
    return df.agg(F.array(*parts).alias("_r")).select(F.inline("_r"))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per column and value of the text columns, missing values included."""
    columns = list(columns) if columns is not None else columns_of(df, "categorical")
    long = df.select(*[quoted(c).cast("string").alias(c) for c in columns]).unpivot(
        [], [quoted(c) for c in columns], "column", "value"
    )
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    """The most frequent values per text column; equal counts are ordered by value."""
    return _top(value_counts(df, columns), top)


def _top(counts: DataFrame, top: int) -> DataFrame:
    """Spark prunes to ``top`` rows per column and task before the shuffle.

    Missing values are ranked last instead of being filtered first, so that the
    totals over the same counts can share their shuffle.
    """
    order = Window.partitionBy("column").orderBy(F.col("value").isNull(), F.desc("n"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.filter(F.col("value").isNotNull())


def categorical_stats(df: DataFrame, columns: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    """Distinct count, top values, missing count and share, one row per text column."""
    counts = value_counts(df, columns)
    totals = counts.groupBy("column").agg(
        F.count("value").alias("unique_count"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.sum("n").alias("_rows"),
    )
    best = _top(counts, top).groupBy("column").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
            lambda t: F.struct(t["value"].alias("value"), t["n"].alias("count")),
        ).alias("top_values")
    )
    return totals.join(best, "column", "left").select(
        "column",
        "unique_count",
        F.coalesce("top_values", F.array().cast("array<struct<value:string,count:bigint>>")).alias("top_values"),
        "missing",
        _share(F.col("missing"), F.col("_rows")).alias("missing_percentage"),
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max: one row per statistic, one column per column."""
    columns = list(columns) if columns is not None else columns_of(df, "numeric")
    quart = _quantile_exprs(df, columns, [0.25, 0.5, 0.75])
    statistics = {
        "count": lambda c: F.count(number(c)).cast("double"),
        "mean": lambda c: F.avg(number(c)),
        "std": lambda c: F.stddev_samp(number(c)),
        "min": lambda c: F.min(number(c)),
        "25%": lambda c: quart[c][0],
        "50%": lambda c: quart[c][1],
        "75%": lambda c: quart[c][2],
        "max": lambda c: F.max(number(c)),
    }
    parts = [
        F.struct(F.lit(name).alias("statistic"), *[make(c).alias(c) for c in columns])
        for name, make in statistics.items()
    ]
    return df.agg(F.array(*parts).alias("_r")).select(F.inline("_r"))


def column_report(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    order_by: Sequence[str],
    samples: int = 50,
) -> DataFrame:
    """Type, sample values of the first rows and role of every column."""
    first = df.orderBy(*order_by).limit(samples)
    # at most `samples` rows reach this window
    placed = first.withColumn("_at", F.row_number().over(Window.orderBy(*order_by)))
    text = placed.select("_at", *[quoted(c).cast("string").alias(c) for c in df.columns])
    long = text.unpivot(["_at"], [quoted(c) for c in df.columns], "column", "value")
    sampled = long.groupBy("column").agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("value") != "", F.struct("_at", "value")))),
            lambda s: s["value"],
        ).alias("samples")
    )
    return (
        _schema_table(df)
        .join(sampled, "column", "left")
        .select(
            "column",
            "logical_type",
            F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
            F.col("column").isin(*features).alias("is_feature"),
            (F.col("column") == target).alias("is_target"),
        )
    )


def profile(df: DataFrame, top: int = 10) -> DataFrame:
    """Numeric and text statistics of all columns as one table."""
    numbers, texts = columns_of(df, "numeric"), columns_of(df, "categorical")
    others = [c for c in df.columns if c not in numbers and c not in texts]
    parts = []
    if numbers:
        parts.append(numeric_stats(df, numbers).withColumn("logical_type", F.lit("numeric")))
    if texts:
        parts.append(categorical_stats(df, texts, top).withColumn("logical_type", F.lit("categorical")))
    if others:
        rows = F.count(F.lit(1))
        structs = [
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(is_missing(df, c)).alias("missing"),
                _share(F.count_if(is_missing(df, c)), rows).alias("missing_percentage"),
            )
            for c in others
        ]
        parts.append(
            df.agg(F.array(*structs).alias("_r")).select(F.inline("_r")).withColumn("logical_type", F.lit("unknown"))
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def info(df: DataFrame) -> DataFrame:
    """Columns, types, shape and null counts."""
    rows = F.count(F.lit(1))
    parts = [
        F.struct(F.lit(c).alias("column"), rows.alias("rows"), F.count_if(is_missing(df, c)).alias("null_count"))
        for c in df.columns
    ]
    counts = df.agg(F.array(*parts).alias("_r")).select(F.inline("_r"))
    return (
        _schema_table(df)
        .join(counts, "column")
        .select("column", "dtype", "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "null_count")
    )


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair, in one aggregate."""
    columns = list(columns) if columns is not None else columns_of(df, "numeric")
    parts = [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.corr(number(a), number(b)).alias("correlation"))
        for i, a in enumerate(columns)
        for b in columns[i + 1:]
    ]
    return df.agg(F.array(*parts).alias("_r")).select(F.inline("_r"))


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Values outside 1.5 interquartile ranges, per numeric column."""
    columns = list(columns) if columns is not None else columns_of(df, "numeric")
    quart = exact_quantiles(df, columns, [0.25, 0.75])
    parts = []
    for c in columns:
        low, high = iqr_bounds(*quart[c])
        outside = (number(c) < F.lit(low)) | (number(c) > F.lit(high))
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(low).cast("double").alias("lower_bound"),
                F.lit(high).cast("double").alias("upper_bound"),
                F.count_if(outside).alias("outliers"),
            )
        )
    return df.agg(F.array(*parts).alias("_r")).select(F.inline("_r"))


def iqr_bounds(q1: float | None, q3: float | None) -> tuple[float | None, float | None]:
    if q1 is None or q3 is None:
        return None, None
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
