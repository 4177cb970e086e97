"""The payment-risk pipeline: clean, validate, derive, link, rate, connect, summarize."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.cleaning import clean_all
from tessera.operators.features import engineer
from tessera.operators.graph import build_network
from tessera.operators.linkage import integrate
from tessera.operators.marts import risk_marts
from tessera.operators.quality import gate, validate
from tessera.session import cut
from tessera.sources.adapters import raw_tables
from tessera.sources.readers import read_raw
from tessera.sources.sinks import write_summary, write_table


def build(raw: Mapping[str, DataFrame], guard: bool = True, network: bool = True) -> dict[str, DataFrame]:
    """All tables by name.

    ``guard`` runs the FAIL gate and the join guards, which are actions. Cleaned tables, features,
    linked tables and marts are each written once to the shared checkpoint folder, as several later
    tables read them; the rest is lazy.
    """
    cleaned = clean_all(dict(raw))
    frames = {name: cut(c.frame) for name, c in cleaned.items()}
    checks = validate(frames)
    if guard:
        gate(checks)
    tables: dict[str, DataFrame] = {f"{n}_cleaned": f for n, f in frames.items()} | {f"{n}_audit": c.audit for n, c in cleaned.items()} | {"validation": checks}
    features = {n: cut(f) for n, f in engineer(frames).items()}
    tables |= {f"{n}_features": f for n, f in features.items()}
    linked = integrate(features, guard)
    tables |= linked | {n: cut(linked[n]) for n in ("transactions", "linkage", "kyc_summary", "merchant_summary")}
    tables |= {n: cut(m) for n, m in risk_marts(tables, guard).items()}
    if network:
        tables |= build_network(tables["transactions"], tables["linkage"], tables["users"], tables["merchants"])
    return tables


def run(spark: SparkSession, paths: Mapping[str, str], folder: str) -> dict:
    """Read the four raw files, write every table to ``folder`` as Parquet and a JSON summary beside them."""
    tables = build({name: read_raw(spark, path, name) for name, path in paths.items()})
    written = {name: spark.read.parquet(write_table(df, folder, name)) for name, df in tables.items()}
    return write_summary(spark, written, f"{folder}/summary.json")


_BUILT: dict[tuple, dict[str, DataFrame]] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Sizes and times of the files of the driver tables, so that a changed table is built anew."""
    found = []
    for name in ("orders", "lineitem", "customer", "nation", "supplier", "events"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return tuple(sorted(found))


def from_driver_tables(spark: SparkSession, sf_dir: str, network: bool = False) -> dict[str, DataFrame]:
    """The pipeline over the driver tables in their payment roles, built once a session and state of the files."""
    key = (spark.sparkContext.applicationId, network, _stamp(spark, sf_dir))
    if key not in _BUILT:
        _BUILT[key] = build(raw_tables(spark, sf_dir), network=network)
    return _BUILT[key]
