"""Sinks of tables, reports, run summaries and failures, and the cached bundle of marts."""

from __future__ import annotations

import json
import time
import traceback
from collections import OrderedDict
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.text import truthy

BUNDLE = (
    "transactions",
    "linkage",
    "users",
    "merchants",
    "nodes",
    "edges",
    "validation",
    "integration_audit",
    "network_audit",
    "kyc_summary",
)


def write_table(df: DataFrame, folder: str, name: str) -> str:
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_report(df: DataFrame, folder: str, name: str) -> str:
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def _save_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_summary(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict:
    """Row counts and the UTC time as JSON."""
    counts = {name: df.count() for name, df in tables.items()}
    summary = {"completed_at": datetime.now(timezone.utc).isoformat(), "rows": counts}
    _save_text(spark, path, json.dumps(summary, indent=1))
    return summary


def logged(spark: SparkSession, path: str, work: Callable[[], object]) -> object:
    """Run ``work``; on failure write the traceback to ``path`` and raise again."""
    try:
        return work()
    except Exception:
        _save_text(spark, path, traceback.format_exc())
        raise


class BundleCache:
    """Marts by folder, re-read after ``ttl`` seconds, ``most`` folders at a time."""

    def __init__(self, spark: SparkSession, ttl: float = 900, most: int = 4, clock: Callable[[], float] = time.monotonic):
        self.spark, self.ttl, self.most, self.clock = spark, ttl, most, clock
        self.held: OrderedDict[str, tuple[float, dict[str, DataFrame]]] = OrderedDict()

    def load(self, folder: str) -> dict[str, DataFrame]:
        now = self.clock()
        if folder in self.held and now - self.held[folder][0] < self.ttl:
            self.held.move_to_end(folder)
            return self.held[folder][1]
        self.drop(folder)
        found, absent = {}, []
        for name in BUNDLE:
            try:
                found[name] = self.spark.read.parquet(f"{folder}/{name}")
            except Exception as error:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                absent.append(name)
        if absent:
            raise FileNotFoundError(f"missing tables: {', '.join(absent)}")
        for df in found.values():
            df.cache()
        self.held[folder] = (now, found)
        while len(self.held) > self.most:
            self.drop(next(iter(self.held)))
        return found

    def drop(self, folder: str) -> None:
        _, tables = self.held.pop(folder, (0, {}))
        for df in tables.values():
            df.unpersist()


def retype(df: DataFrame, timestamps: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """Types of a table that came back from CSV; what doesn't parse is null or false."""
    times = {c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz") for c in timestamps if c in df.columns}
    return df.withColumns(times | {c: truthy(F.col(c)) for c in flags if c in df.columns}) if times or flags else df
