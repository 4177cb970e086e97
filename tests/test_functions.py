import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import constants as K, dates as D, numeric as N, ranks as R, text as T
from tessera.operators import legacy


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("make", "value", "expected"),
    [
        (T.normalize_text, "  a   b\t", "a b"),
        (T.normalize_text, "n/a", None),
        (T.normalize_text, "", None),
        (lambda x: T.prefixed_id(x, "USR"), " usr-123 ", "USR123"),
        (lambda x: T.prefixed_id(x, "USR"), "usrUSR1", "USRUSR1"),
        (lambda x: T.prefixed_id(x, "USR"), "usr", None),
        (lambda x: T.prefixed_id(x, "USR"), "--", None),
        (T.canonical_token, " kyc  done! ", "KYC_DONE"),
        (T.canonical_token, "--", None),
        (T.money, "Rs. 6,362.9", 6362.9),
        (T.money, "inr -5", -5.0),
        (T.money, "1-2", None),
        (T.money, "--5", None),
        (T.money, "1.2.3", None),
        (T.money, ".", None),
        (T.money, "5.", 5.0),
        (T.money, "-.5", -0.5),
        (lambda x: T.mcc(x, False), "MCC-5411.05", "54115"),
        (lambda x: T.mcc(x, False), "mcc5411", "mcc5411"),
        (lambda x: T.mcc(x, True), "mcc 5411.0", "5411"),
        (T.four_digits, "5411\n", False),
        (T.four_digits, "5411", True),
        (T.pan_valid, "ABCDE1234F", True),
        (T.aadhaar, "1234 5678-9012", "123456789012"),
        (T.account, "ac-12 3", "AC123"),
        (T.truthy, " Yes", True),
        (T.truthy, None, False),
        (T.node_type, "MCH1", "MERCHANT"),
        (lambda x: legacy.short_id(x, "TXN", 3), "txn 12345", "TXN345"),
        (lambda x: legacy.exact_label(x, {"a": "A"}), "b", None),
    ],
)
def test_text(spark, make, value, expected):
    assert one(spark, value, make) == expected


@pytest.mark.parametrize(
    ("parse", "value", "expected"),
    [
        (D.unambiguous_date, "25/03/2026", dt.datetime(2026, 3, 25)),
        (D.unambiguous_date, "25-03-2026", None),
        (D.unambiguous_date, "03/25/2026", None),
        (D.unambiguous_date, "03-25-2026", dt.datetime(2026, 3, 25)),
        (D.unambiguous_date, "05/05/2026", None),
        (D.unambiguous_date, "5-Mar-2026", dt.datetime(2026, 3, 5)),
        (D.unambiguous_date, "2026-1-5", dt.datetime(2026, 1, 5)),
        (D.unambiguous_date, "31/02/2026", None),
        (D.transaction_timestamp, "03-04-2026 1:02:03 PM", dt.datetime(2026, 3, 4, 13, 2, 3)),
        (D.transaction_timestamp, "13-04-2026 1:02:03 PM", dt.datetime(2026, 4, 13, 13, 2, 3)),
        (D.transaction_timestamp, "03/04/2026", dt.datetime(2026, 4, 3)),
        (D.transaction_timestamp, "1700000000", dt.datetime(2023, 11, 14, 22, 13, 20)),
        (D.transaction_timestamp, "170000000", None),
        (D.chargeback_timestamp, "3-4-2026 1:02 am", dt.datetime(2026, 3, 4, 1, 2)),
        (D.chargeback_timestamp, "2026/03/04 24:00:00", None),
        (D.chargeback_timestamp, None, None),
    ],
)
def test_dates(spark, parse, value, expected):
    assert one(spark, value, parse) == expected


def test_age_on_birthday(spark):
    df = spark.createDataFrame([("2008-09-15",)], "x string").select(D.age_years(F.col("x").cast("timestamp_ntz")).alias("y"))
    assert df.first()["y"] == 17


def test_category_map_keeps_unknown(spark):
    df = spark.createDataFrame([("S",), ("ODD",), (None,)], "x string")
    rows = df.select(N.canonical(F.col("x"), K.TXN_STATUS).alias("v"), N.unmapped(F.col("x"), K.TXN_STATUS).alias("u")).collect()
    assert [tuple(r) for r in rows] == [("COMPLETED", False), ("ODD", True), (None, False)]


def test_group_aggregates(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0)], "k string, v double")
    got = {r["k"]: r for r in df.groupBy("k").agg(N.total(F.col("v")).alias("t"), N.average(F.col("v")).alias("m"), N.quantile_or_zero(F.col("v"), 0.5).alias("q")).collect()}
    assert tuple(got["a"])[1:] == (0.0, None, 0.0) and tuple(got["b"])[1:] == (2.0, 2.0, 2.0)


def test_stable_values_and_representative(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", ""), ("y", None), ("z", "c")], "k string, v string")
    got = {r["k"]: (r["s"], r["r"]) for r in df.groupBy("k").agg(N.stable_values(F.col("v")).alias("s"), N.representative(F.col("v")).alias("r")).collect()}
    assert got == {"x": ("a | b", "MULTIPLE_VALUES"), "y": ("", None), "z": ("c", "c")}


def test_percent_rank_and_bands(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, None, 4.0])], "i int, v double")
    got = {r["i"]: r["p"] for r in R.with_percent_rank(df, "v", ["i"], "p").collect()}
    assert got == {0: 0.25, 1: 0.625, 2: 0.625, 3: None, 4: 1.0}
    six = R.with_global_rank(spark.createDataFrame([(i, float(i)) for i in range(6)], "i int, v double"), "v", ["i"])
    bands = [r["b"] for r in six.select("i", R.quartile_band(F.col("_rank"), F.lit(6)).alias("b")).orderBy("i").collect()]
    assert [bands.count(b) for b in R.BANDS] == [2, 1, 1, 2]


def test_zscore_of_single_and_constant(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0)], "k string, v double")
    assert [r["z"] for r in df.select(R.zscore("v", "k").alias("z")).collect()] == [None, None, None]
