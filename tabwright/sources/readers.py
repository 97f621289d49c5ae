"""Tables from files.

Schema inference reads a file twice; give a schema for anything large or
repeated, and for every stream.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Schema = T.StructType | str | None

# fixed values: what may be loaded; spreadsheets have to be converted first
EXTENSIONS = [".csv", ".json", ".txt", ".parquet"]
LINE_EXTENSIONS = [".jsonl", ".ndjson"]
SPREADSHEETS = [".xlsx", ".xls"]


def read_csv(
    spark: SparkSession, path: str, schema: Schema = None, mode: str = "PERMISSIVE", multiline: bool = False
) -> DataFrame:
    """Header row, UTF-8, types inferred unless a schema is given.

    ``multiline`` allows line breaks inside quotes, at the price of one task per file.
    """
    reader = spark.read.option("header", True).option("mode", mode).option("multiLine", multiline)
    reader = reader.option("encoding", "UTF-8").option("quote", '"').option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str | list[str], schema: Schema = None, lines: bool = False) -> DataFrame:
    """An array of objects or one object per file, or with ``lines`` one object per line.

    Only the line form can be split between tasks.
    """
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def json_forms(spark: SparkSession, path: str) -> DataFrame:
    """``file, lines``: whether a JSON file holds one value per line, told by its first line that is not blank."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
        "value",
    )
    first = lines.filter(F.col("value").rlike(r"\S")).groupBy("file").agg(F.min_by("value", "at").alias("first"))
    whole = F.try_parse_json("first").isNotNull() & ~F.ltrim("first").startswith("[")
    return first.select("file", whole.alias("lines"))


def _united(parts: Sequence[DataFrame]) -> DataFrame:
    """All columns of all parts; where their types do not go together, as text."""
    kinds: dict[str, set] = {}
    for part in parts:
        for f in part.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType)
    mixed = {
        name for name, types in kinds.items()
        if len(types) > 1 and not all(isinstance(t, T.NumericType) for t in types) and not all(isinstance(t, T.StructType) for t in types)
    }
    plain = (T.StructType, T.ArrayType, T.MapType)

    def text(part: DataFrame, name: str) -> Column:
        column = F.col(f"`{name}`")
        return F.to_json(column) if isinstance(part.schema[name].dataType, plain) else column.cast("string")

    same = [part.withColumns({c: text(part, c) for c in part.columns if c in mixed}) for part in parts]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), same)


def read_json_files(spark: SparkSession, path: str, schema: Schema = None) -> DataFrame:
    """JSON files of either form, each read by its own: the two kinds are read as two groups and united.

    Only a folder that holds both kinds is listed on the driver, one name per file.
    """
    forms = json_forms(spark, path)
    counted = {r["lines"]: r["count"] for r in forms.groupBy("lines").count().collect()}
    if len(counted) < 2:
        return read_json(spark, path, schema, lines=True) if True in counted else read_json_documents(spark, path, schema)
    named: dict[bool, list[str]] = {True: [], False: []}
    for r in forms.collect():
        named[r["lines"]].append(unquote(r["file"]))
    parts = [read_json(spark, named[True], schema, lines=True), read_json_documents(spark, named[False], schema)]
    return _united(parts)


def read_json_documents(spark: SparkSession, path: str | list[str], schema: Schema = None) -> DataFrame:
    """Files of one value each; an error if a file holds several, of which only the first would be read."""
    several = F.col("value").rlike(r"[}\]]\s*\n\s*[{\[]")  # inside one value a comma stands between
    if not spark.read.text(path, wholetext=True).filter(several).isEmpty():
        raise ValueError(f"a JSON file in {path} holds more than one value and not one per line")
    return read_json(spark, path, schema)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """The lines that are not blank."""
    return spark.read.text(path).filter(F.col("value").rlike(r"\S"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_any(spark: SparkSession, path: str, schema: Schema = None, lines: bool | None = None) -> DataFrame:
    """Choose the reader by extension; an unknown one is tried as CSV.

    ``lines`` says whether JSON files hold one object per line; without it each file tells for itself.
    """
    extension = PurePosixPath(path.rstrip("/")).suffix.lower()
    if extension in SPREADSHEETS:
        raise ValueError(f"{extension} files have to be converted to CSV or Parquet first")
    if extension in LINE_EXTENSIONS:
        return read_json(spark, path, schema, lines=True)
    if extension == ".json":
        if lines is None:
            return read_json_files(spark, path, schema)
        return read_json(spark, path, schema, lines=True) if lines else read_json_documents(spark, path, schema)
    if extension == ".txt":
        return read_text(spark, path)
    if extension == ".parquet":
        return read_parquet(spark, path)
    return read_csv(spark, path, schema)
