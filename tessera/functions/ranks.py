"""Ranks, quartile bands, outlier bounds and z-scores over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BANDS = ("LOW", "MEDIUM", "HIGH", "VERY_HIGH")


BUCKETS = 64


def counts_below(df: DataFrame, value: str) -> DataFrame:
    """(v, n, upto): each non-null value with its count and the count of all values up to it.

    Values are counted first, then added up in ranges between approximate quantiles, so neither a task
    nor a buffer holds all of them. The value is compared as a double.
    """
    held = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    bounds = held.agg(F.percentile_approx("v", [i / BUCKETS for i in range(1, BUCKETS)], 10_000)).scalar()
    keyed = held.withColumn("bounds", bounds).withColumn("bucket", F.size(F.filter("bounds", lambda b: b < F.col("v"))))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("bucket").agg(F.sum("n").alias("all")).select("bucket", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))  # 64 rows at most
    own = Window.partitionBy("bucket").orderBy("v")
    return keyed.withColumn("own", F.sum("n").over(own)).join(F.broadcast(base), "bucket").select("v", "n", (F.col("own") + F.col("base")).alias("upto"))


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row: for each name the interpolated quantile of a column, null over no values."""
    one = None
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        total = df.agg(F.count(column)).scalar()
        found = counts_below(df, column)
        figures = []
        for name, (of, q) in wanted.items():
            if of == column:
                place = (total - 1) * q
                low, high = F.floor(place), F.ceil(place)
                at = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("v")))
                figures.append(F.when(low == high, at(low)).otherwise((high - place) * at(low) + (place - low) * at(high)).alias(name))
        row = found.agg(*figures)
        one = row if one is None else one.crossJoin(F.broadcast(row))  # single rows
    return one.select(*wanted)


def with_global_rank(df: DataFrame, value: str, tie: list[str], out: str = "_rank") -> DataFrame:
    """Row number among non-null values by (value, tie), counted in ranges so that no task sees all rows.

    Rows of null values get a null rank and are in no range.
    """
    known = df.where(F.col(value).isNotNull())
    bounds = known.agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 10_000)).scalar()
    keyed = known.withColumn("_bounds", bounds).withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # 64 rows at most
    own = Window.partitionBy("_bucket").orderBy(F.col(value), *tie)
    ranked = keyed.join(F.broadcast(base), "_bucket").withColumn(out, F.row_number().over(own) + F.col("_base")).drop("_bucket", "_base")
    return ranked.unionByName(df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("long")))


def with_percent_rank(df: DataFrame, value: str, *names: list[str] | str) -> DataFrame:
    """Average rank of ties over the count of non-null values; null for null.

    Names the new column last. Columns that order ties may stand before it; they change nothing, as
    equal values share their average rank.
    """
    out = names[-1]
    total = df.agg(F.count(value)).scalar()
    ranks = counts_below(df, value).select(F.col("v").alias("_v"), ((F.col("upto") - (F.col("n") - 1) / 2) / total).alias(out))
    return df.join(ranks, F.col(value).cast("double") == F.col("_v"), "left").drop("_v")


def quartile_band(rank: Column, n: Column) -> Column:
    """Band of a first-come rank: the edges are interpolated quartiles of 1..n."""
    over = sum(((rank > 1 + (n - 1) * k / 4).cast("int") for k in (1, 2, 3)), F.lit(0))
    return F.when(rank.isNotNull(), F.element_at(F.array(*[F.lit(b) for b in BANDS]), over + 1))


def zscore(value: Column | str, mean: Column | str, spread: Column | None = None) -> Column:
    """(value - mean) / spread, null where nothing varies; or, given a column and a group by name, that of the window."""
    if spread is None:
        group = Window.partitionBy(mean)
        return zscore(F.col(value), F.avg(value).over(group), F.stddev_samp(value).over(group))
    return F.try_divide(value - mean, F.when(spread != 0, spread))


def iqr_bounds(df: DataFrame, value: str) -> DataFrame:
    """One row: q1, q3, lower, upper."""
    q = exact_quantiles(df, {"q1": (value, 0.25), "q3": (value, 0.75)})
    return q.withColumn("lower", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("upper", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
