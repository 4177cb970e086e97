"""Raw sources: all-string CSV and JSON scans, header names, required columns."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.functions.constants import REQUIRED


def snake_case(name: str) -> str:
    parts = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip())
    return re.sub(r"[^a-z0-9]+", "_", parts.lower()).strip("_")


def require_columns(df: DataFrame, dataset: str) -> DataFrame:
    absent = sorted(set(REQUIRED[dataset]) - set(df.columns))
    if absent:
        raise ValueError(f"{dataset} is missing required columns: {', '.join(absent)}")
    return df


def _checked(load, path: str) -> DataFrame:
    try:
        return load()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise


def read_csv(spark: SparkSession, path: str, dataset: str | None = None, multiline: bool = True) -> DataFrame:
    """Every cell a string; an empty cell stays the empty string, as duplicates are judged on raw rows.

    With ``multiline`` cells may hold line ends, and each file is read by one task. Files without such
    cells are split among tasks with ``multiline=False``; large inputs should come so, or as many files.
    """

    def load() -> DataFrame:
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
        return reader.option("inferSchema", False).csv(path)

    df = _checked(load, path).na.fill("")
    df = df.toDF(*[snake_case(c) for c in df.columns])
    return require_columns(df, dataset) if dataset else df


def read_json(spark: SparkSession, path: str, dataset: str | None = None, lines: bool = False) -> DataFrame:
    """A JSON array, one task a file, or with ``lines`` an object a line, split among tasks; primitives as strings."""
    df = _checked(lambda: spark.read.option("multiLine", not lines).option("primitivesAsString", True).json(path), path)
    df = df.select(*[F.col(f"`{f.name}`").cast("string").alias(snake_case(f.name)) for f in df.schema.fields])
    return require_columns(df, dataset) if dataset else df


def all_string_schema(dataset: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED[dataset]])


def read_raw(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    return read_json(spark, path, dataset, path.endswith(".jsonl")) if path.endswith((".json", ".jsonl")) else read_csv(spark, path, dataset)
