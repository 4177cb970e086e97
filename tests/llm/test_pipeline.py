import collections
import re

from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, EDGE, brute_components


def test_stages_in_order(spark, sf_dir):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = p.quality(spark, docs, sf_dir).cache()
    assert 0.4 * docs.count() < clean.count() < docs.count()
    one = p.near_dedup(spark, clean, sf_dir).cache()
    want = brute_components([(r["doc_id"], r["text"]) for r in clean.collect()])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(want.values()))
    safe = p.secret_scan(spark, one, sf_dir).cache()
    assert safe.count() == one.count() and not [r for r in safe.collect() if re.search("[0-9a-f]{24,}", r["text"])]
    mixed = p.mixing(spark, safe, sf_dir).cache()
    sizes = {r["doc_id"]: len(r["text"].split()) for r in safe.collect()}
    got = collections.Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(r["text"].split())
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 30 and all(got[i] <= 2 * sizes[i] for i in got)
    assert all(x.columns == list(p.COLUMNS) for x in (clean, one, safe, mixed))
    packed = p.packing(spark, mixed, sf_dir)
    assert packed.where("piece = 0").count() == mixed.count()


def test_run_and_edges(spark, sf_dir, tmp_path):
    import corpus_pipeline as p

    assert p.run(spark, sf_dir).count() > 0
    for rows in (EDGE, []):
        docs = spark.createDataFrame(rows, DOCS)
        for k, (_, stage) in enumerate(p.STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{len(rows)}-{k}")


def test_near_dedup_keeps_different_texts_of_one_id(spark, sf_dir):
    import corpus_pipeline as p

    text = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, text("a"), "en", "s", 1, "x"), (1, text("b"), None, "s", 1, "x"), (1, text("b"), None, "s", 1, "x"), (2, text("b") + " z", "en", "s", 1, "x")]
    rows += [(None, text("c"), "en", None, 1, "x"), (None, text("d"), "en", None, 1, "x"), (3, text("d"), None, None, None, "x"), (4, None, None, None, None, "x"), (4, "", None, None, None, "x")]
    df = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"extra": "kept"}).withColumn("component_id", F.lit(1)).withColumn("_n", F.lit(1))
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in p.near_dedup(spark, df, sf_dir).collect())
    assert got == sorted([(1, text("a")), (2, text("b") + " z"), (0, text("c")), (3, text("d")), (4, "")] + [(4, "")] * (len(got) - 5)) and len(got) in (5, 6)


def test_mixing_writes_the_drawn_blocks(spark, sf_dir):
    import corpus_pipeline as p
    from tessera.llm import mixing

    size = 5100
    words = {s: [f"{s}{i}" for i in range(size)] for s in "abc"}
    rows = [(k, " ".join(words[s]), None, s, 1, None) for k, s in enumerate("abc")]
    targets = mixing.mixture_targets(spark.createDataFrame([(s, size) for s in "abc"], "source string, size long"))
    want = collections.Counter()
    for r in mixing.mixture_slots(targets).collect():
        at = r["block"] * mixing.BLOCK
        want.update(words["abc"[r["idx"]]][at : at + r["take"]])
    got = collections.Counter()
    for r in p.mixing(spark, spark.createDataFrame(rows, DOCS), sf_dir).collect():
        row = r["text"].split()
        first = int(row[0][1:])
        assert row == words[r["source"]][first : first + len(row)] and r["n_chars"] == len(r["text"])
        got.update(row)
    assert got == want and 0 < len([w for w in words["b"] if w in got]) < size
    assert {w for w in words["b"] if w in got} != set(words["b"][: sum(w in got for w in words["b"])])


def test_mixing_takes_repeated_rows_each_for_itself(spark, sf_dir):
    import corpus_pipeline as p
    from tessera.llm import mixing

    text = " ".join(f"w{i}" for i in range(500))
    rows = [(None, text, None, "b", 1, None)] * 3 + [(7, text, "en", "b", 1, None), (7, text + " x", "de", "b", 1, None)]
    rows += [(k, " ".join([text] * 6), None, s, 1, None) for k, s in enumerate("ac")]
    goal = {r["source"]: r["target"] for r in mixing.mixture_targets(spark.createDataFrame([(r[3], len(r[1].split())) for r in rows], "source string, size long")).collect()}
    got = collections.Counter()
    for r in p.mixing(spark, spark.createDataFrame(rows, DOCS), sf_dir).collect():
        got[r["source"]] += len(r["text"].split())
    assert all(abs(got[s] - goal[s]) <= 1 for s in "abc")
