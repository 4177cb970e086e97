import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric as N, ranks
from tessera.operators import graph, linkage, marts, quality
from tessera.operators.cleaning import clean_kyc
from tessera.operators.components import connected_components
from tessera.operators.features import with_group_figures
from tessera.operators.guards import null_safe_join, require_same_count, require_unique
from tessera.plans.ask import EXAMPLES, ask, evidence_prompt, grounded_reply
from tessera.sources import readers, sinks
from tessera.streaming.velocity import event_velocity


def test_components_match_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in up}


def test_empty_components(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_null_safe_join_and_guard(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([(None, 5), ("y", 6)], "k string, b int")
    assert {(r["a"], r["b"]) for r in null_safe_join(a, b, ["k"]).collect()} == {(1, None), (2, 5)}
    assert null_safe_join(a, b, ["k"], "full_outer").count() == 3
    with pytest.raises(ValueError):
        require_unique(spark.createDataFrame([(None,), (None,)], "k string"), ["k"], "twice")


def test_duplicates_go_before_normalization(spark):
    cols = readers.REQUIRED["kyc"]
    row = {c: "a" for c in cols} | {"user_id": "usr1", "monthly_income": "-5", "date_of_birth": "05/05/2000"}
    rows = [row, row, row | {"user_id": "USR-1"}]
    got = clean_kyc(spark.createDataFrame([[r[c] for c in cols] for r in rows], ", ".join(f"{c} string" for c in cols)))
    assert [r["user_id"] for r in got.frame.collect()] == ["USR1", "USR1"]
    first = got.frame.first()
    assert first["monthly_income"] is None and first["monthly_income_invalid_flag"] and first["date_of_birth_parse_failure_flag"]
    audit = {(r["issue"], r["column"]): (r["numerator"], r["denominator"]) for r in got.audit.collect()}
    assert audit["kyc exact duplicates removed", "ALL"] == (1, 3)


def _facts(spark):
    t = spark.createDataFrame([("TXN1", "USR1", "MCH1", 10.0, "COMPLETED", dt.datetime(2024, 1, 1))], "txn_id string, user_id string, merchant_id string, amount double, status string, timestamp timestamp_ntz")
    c = spark.createDataFrame(
        [(f"CBK{i}", "TXN1", f"USR{i + 5}", "MCH9", 10.0, True, False, False, False) for i in (1, 2)],
        "complaint_id string, txn_id string, user_id string, merchant_id string, disputed_amount double, is_high_severity boolean, disputed_amount_invalid_flag boolean, reported_before_transaction_flag boolean, bank_response_before_transaction_flag boolean",
    )
    return t, c


def test_linkage_keeps_complaints_and_transactions(spark):
    t, c = _facts(spark)
    link = linkage.link_chargebacks(c, t)
    rows = link.collect()
    assert len(rows) == 2 and all(r["transaction_record_found"] and r["identity_mismatch"] and r["network_disconnected"] for r in rows)
    assert {r["linkage_status"] for r in rows} == {"IDENTITY_MISMATCH"} and all(r["disputed_amount_match"] for r in rows)
    edges = graph.network_edges(t, link)
    assert edges.where("relationship_type = 'CHARGEBACK_ONLY'").count() == 2
    nodes, inside = graph.ego_network(edges, "MCH9")
    assert {r["node_id"] for r in nodes.collect()} == {"MCH9", "USR6", "USR7"} and inside.count() == 2
    places = graph.layout(["a", "b"], [("a", "b")])
    assert set(places) == {"a", "b"}


def test_questions(spark):
    t, c = _facts(spark)
    tables = {"transactions": t, "linkage": linkage.link_chargebacks(c, t)}
    assert ask(spark, " ", tables).data is None
    assert ask(spark, "cbk1", tables).data.count() == 1
    assert ask(spark, "CBK77", tables).title == "No complaint CBK77"
    assert ask(spark, "what is a mismatch", tables).data.count() == 2
    assert ask(spark, "hello", tables).data.count() == len(EXAMPLES)
    assert '"rows_in_all": 2' in evidence_prompt("mismatch", ask(spark, "mismatch", tables))
    assert grounded_reply(spark, "mismatch", tables, lambda p: "said").text == "said"

    def broken(prompt):
        raise TimeoutError

    assert grounded_reply(spark, "mismatch", tables, broken).source == "tables"
    assert "TimeoutError" in grounded_reply(spark, "mismatch", tables, broken).text and "silent" in grounded_reply(spark, "mismatch", tables, lambda p: " ").text


def test_guards_refuse_repeated_keys(spark):
    t, c = _facts(spark)
    with pytest.raises(ValueError, match="share a txn_id"):
        linkage.link_chargebacks(c, t.unionByName(t))
    nulls = t.withColumn("txn_id", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="share a txn_id"):
        linkage.link_chargebacks(c, nulls.unionByName(nulls))
    kyc = spark.createDataFrame([("USR1",), ("USR1",)], "user_id string")
    mch = spark.createDataFrame([("MCH1",)], "merchant_id string")
    link = linkage.link_chargebacks(c, t)
    with pytest.raises(ValueError, match="several rows for a user"):
        linkage.enrich_transactions(t, link, kyc, mch)
    with pytest.raises(ValueError, match="several rows for a user"):
        marts.user_mart(t, link, kyc)
    with pytest.raises(ValueError, match="several rows for a merchant"):
        marts.merchant_mart(t, link, mch.unionByName(mch))
    with pytest.raises(ValueError, match="lost"):
        require_same_count(t, t.unionByName(t), "lost")


def test_sums_of_any_size(spark):
    cases = {"fine": [0.004, 0.004], "huge": [1e17, 1e17], "beyond": [1e300, 1e300], "odd": [float("nan"), 1.0], "none": [None, None], "cents": [0.1] * 10}
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k string, v double")
    got = {r["k"]: (r["t"], r["a"]) for r in df.groupBy("k").agg(N.total(F.col("v")).alias("t"), N.average(F.col("v")).alias("a")).collect()}
    assert got["fine"] == (0.008, 0.004) and got["huge"] == (2e17, 1e17) and got["beyond"] == (2e300, 1e300) and got["none"] == (0.0, None)
    assert got["cents"][0] == 1.0 and got["odd"][0] != got["odd"][0]


def test_quantiles_and_ranks_match_numpy(spark):
    import random

    rng = random.Random(4)
    values = [rng.choice([None, 0.0, -1.5, rng.gauss(0, 9)]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(5)
    known = sorted(v for v in values if v is not None)

    def at(q):
        p = q * (len(known) - 1)
        lo = int(p)
        return known[lo] + (p - lo) * (known[min(lo + 1, len(known) - 1)] - known[lo])

    row = ranks.exact_quantiles(df, {"a": ("v", 0.25), "b": ("v", 0.95), "c": ("i", 1.0)}).first()
    assert abs(row["a"] - at(0.25)) < 1e-9 and abs(row["b"] - at(0.95)) < 1e-9 and row["c"] == 699
    assert ranks.exact_quantiles(df.where("false"), {"a": ("v", 0.5)}).first()["a"] is None
    share = {r["i"]: r["p"] for r in ranks.with_percent_rank(df, "v", "p").collect()}
    for i, v in enumerate(values):
        want = None if v is None else (sum(x < v for x in known) + (sum(x == v for x in known) + 1) / 2) / len(known)
        assert share[i] == want or abs(share[i] - want) < 1e-12
    place = {r["i"]: r["_rank"] for r in ranks.with_global_rank(df, "v", ["i"]).collect()}
    order = sorted((v, i) for i, v in enumerate(values) if v is not None)
    assert [place[i] for _, i in order] == list(range(1, len(order) + 1)) and sum(p is None for p in place.values()) == values.count(None)


def test_group_figures_meet_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 3.0)], "k string, v double")
    got = sorted((r["v"], r["n"]) for r in with_group_figures(df, "k", n=F.count("v")).collect())
    assert got == [(1.0, 1), (2.0, 2), (3.0, 2)]


def test_run_from_raw_files(spark, sf_dir, tmp_path):
    """Four raw files in, every table out, with the rows that the driver tables give."""
    from tessera.plans import pipeline
    from tessera.plans.queries import tidy
    from tessera.sources.adapters import raw_tables

    paths = {}
    for name, df in raw_tables(spark, sf_dir).items():
        if name == "chargebacks":
            paths[name] = str(tmp_path / "chargebacks.json")
            (tmp_path / "chargebacks.json").write_text("[" + ",".join(df.toJSON().collect()) + "]")
        else:
            paths[name] = str(tmp_path / name)
            df.coalesce(1).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(paths[name])
    out = str(tmp_path / "out")
    summary = pipeline.run(spark, paths, out)
    built = pipeline.from_driver_tables(spark, sf_dir)
    for name in ("transactions", "linkage", "users", "merchants", "transactions_cleaned"):
        assert summary["rows"][name] == built[name].count()
        a, b = (sorted(map(str, tidy(df.select(sorted(df.columns)), 4).collect())) for df in (spark.read.parquet(f"{out}/{name}"), built[name]))
        assert a == b, name
    cache = sinks.BundleCache(spark, ttl=10, most=1, clock=iter([0.0, 5.0, 11.0]).__next__)
    first = cache.load(out)
    assert cache.load(out) is first and cache.load(out) is not first


def test_gate(spark):
    bad = spark.createDataFrame([("kyc", "x", "FAIL")], "dataset string, check string, status string")
    with pytest.raises(quality.ValidationFailed):
        quality.gate(bad)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('TxnId,Timestamp,user id,merchant_id,amount,utr,mcc,status\n1,,"a ""q""",m,1,,5411,S\n1,,"a ""q""",m,1,,5411,S\n')
    df = readers.read_csv(spark, str(tmp_path / "t.csv"), "transactions")
    assert df.columns[0] == "txn_id" and df.first()["timestamp"] == "" and df.first()["user_id"] == 'a "q"'
    (tmp_path / "c.json").write_text('[{"complaint_id": 1, "disputed_amount": 12.50}]')
    with pytest.raises(ValueError, match="missing required"):
        readers.read_json(spark, str(tmp_path / "c.json"), "chargebacks")
    assert readers.read_json(spark, str(tmp_path / "c.json")).first()["disputed_amount"] == "12.50"
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))
    summary = sinks.write_summary(spark, {"t": df}, str(tmp_path / "s.json"))
    assert summary["rows"] == {"t": 2} and "rows" in (tmp_path / "s.json").read_text()
    with pytest.raises(ZeroDivisionError):
        sinks.logged(spark, str(tmp_path / "log.txt"), lambda: 1 / 0)
    assert "ZeroDivisionError" in (tmp_path / "log.txt").read_text()
    with pytest.raises(FileNotFoundError, match="transactions"):
        sinks.BundleCache(spark).load(str(tmp_path))


def test_stream_equals_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    query = event_velocity(source).writeStream.outputMode("complete").format("memory").queryName("velocity").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((r["start"], r["user_id"], r["events"]) for r in df.collect())
    assert key(spark.table("velocity")) == key(event_velocity(events))


def test_queries_match_duckdb(spark, sf_dir):
    import duckdb

    from tessera.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for name in "nation customer supplier orders lineitem events".split():
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name in sorted(ORACLES):
        df = QUERIES[name](spark, sf_dir)
        cols = sorted(df.columns)
        flat = lambda v: round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        got = sorted((tuple(flat(r[c]) for c in cols) for r in df.collect()), key=repr)
        found = con.execute(ORACLES[name])
        at = [[d[0] for d in found.description].index(c) for c in cols]
        assert got == sorted((tuple(flat(row[i]) for i in at) for row in found.fetchall()), key=repr), name


def test_whole_audits_of_transactions_and_kyc(spark, sf_dir):
    import re

    from tessera.plans.pipeline import from_driver_tables
    from tessera.plans.queries import QUERIES
    from tessera.sources.adapters import raw_tables

    ids = {"transactions": {"txn_id": "TXN", "user_id": "USR", "merchant_id": "MCH", "utr": "UTR"}, "kyc": {"user_id": "USR"}}
    valid = {"transactions": {"invalid MCC": ("mcc", "mcc_valid")}, "kyc": {"invalid PAN": ("pan", "pan_valid"), "invalid Aadhaar": ("aadhaar", "aadhaar_valid")}}
    flags = {"parse_failure_flag": None, "invalid_flag": "invalid negative monetary values", "unmapped_flag": "unmapped category values"}
    for name in ids:
        raw = raw_tables(spark, sf_dir)[name].collect()
        rows = from_driver_tables(spark, sf_dir)[f"{name}_cleaned"].collect()
        once = set(raw)
        want = {("exact duplicates removed", "ALL"): (len(raw) - len(once), len(raw))}
        for c in rows[0].asDict():
            nulls = sum(r[c] is None for r in rows)
            want["missing values after cleaning", c] = (nulls, len(rows))
            for end, issue in flags.items():
                if c.endswith(f"_{end}"):
                    of = c.removesuffix(f"_{end}")
                    kind = issue or ("monetary parse failures" if of in ("amount", "monthly_income") else "timestamp parse failures")
                    want[kind, of] = (sum(r[c] for r in rows), len(raw))
            if c in ids[name]:
                plain = sum(bool(re.fullmatch(ids[name][c] + "[0-9]+", r[c].strip())) for r in once if r[c])
                want["ID standardization", c] = (len(rows) - nulls - plain, len(raw))
                want["missing identifier", c] = (nulls, len(rows))
        for issue, (c, ok) in valid[name].items():
            want[issue, c] = (sum(r[c] is not None and not r[ok] for r in rows), len(raw))
        got = {(r["issue"].removeprefix(f"{name} "), r["column"]): (r["numerator"], r["denominator"]) for r in QUERIES[f"audit_{name}"](spark, sf_dir).collect()}
        assert got == want


def test_whole_components_cover_all_observed_pairs(spark, sf_dir):
    from tessera.plans.pipeline import from_driver_tables
    from tessera.plans.queries import QUERIES

    t = from_driver_tables(spark, sf_dir)
    pairs = {(r[0], r[1]) for r in t["transactions_cleaned"].select("user_id", "merchant_id").collect()}
    ends = pairs | {(r[0], r[1]) for r in t["chargebacks_cleaned"].select("user_id", "merchant_id").collect()}
    up = {x: x for pair in ends for x in pair if x is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    sizes = {}
    for x in up:
        sizes[find(x)] = sizes.get(find(x), 0) + 1
    got = {r["node_id"]: (r["component_id"], r["component_size"]) for r in QUERIES["network_components"](spark, sf_dir).collect()}
    assert got == {x: (find(x), sizes[find(x)]) for x in up}


def test_entry_has_every_oracle(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
