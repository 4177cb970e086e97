"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, its documents end to end by doc_id buckets, are cut into blocks of
``block`` words. A target gives whole passes over all blocks plus a part of one more pass, so a
number of slots; slot j of a source names block pi(j), where every pass has a pseudorandom index
permutation of its own (the swap-or-not shuffle of Hoang, Morris and Rogaway, 2012, which works on
any number of blocks). Output shards hold ``shard_slots`` slots each. How many of them go to each
source is a multinomial draw, independent for every shard, with the sources' shares of all slots as
probabilities. Over all shards a source is so drawn more or less often than it has slots, by about
the square root of them; the draws over its slots, its last ones, go to the sources that were drawn
too seldom, so totals meet the targets exactly and all but these few slots are as drawn. The slots
of a shard follow each other by the source's running count over shards, and take places in the
shard by a permutation. Slots meet documents in a shuffled join on (source, block index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.text import n_words
from tessera.session import cut

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
BLOCK, SHARD_SLOTS, SEED = 256, 4096, 20240611
ROUNDS = 12
CHUNK_DOCS = 20_000
BROADCAST_SOURCES = 100_000
TASK_SHARDS, TASK_SLOTS, RUN_SHARDS = 16, 30_000, 4096


def _small(sources: DataFrame) -> DataFrame:
    """A table of a row a source, to be joined: sent to every executor up to ``BROADCAST_SOURCES`` rows, else by a shuffled merge."""
    return F.broadcast(sources) if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else sources.hint("merge")


def permuted(x: Column, n: Column, *keys: Column) -> Column:
    """Place of index ``x`` in a pseudorandom permutation of 0..n-1 chosen by ``keys`` (0 if n is 0)."""
    size = F.greatest(n, F.lit(1))

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *keys), size) - at, size)
        swap = F.pmod(F.xxhash64(F.lit(SEED + 1), r, F.greatest(at, other), *keys), F.lit(2)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x.cast("long"), step)


def mixture_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source of (source, size) rows: idx, source_size, weight, target.

    Sources go by code point, null last. Targets share ``share`` times all sizes by weight; none is
    above ``cap`` times its source, and what is over goes to the rest by weight (water-filling).
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    tall = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    everything, order = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("weight"), "idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = tall.withColumn("place", F.row_number().over(order)).withColumn("level", level)
    short = F.col("most") > F.col("weight") * F.col("level")
    first = F.min(F.when(short, F.struct("place", "level"))).over(everything)
    target = F.when(first.isNull() | (F.col("place") < first["place"]), F.col("most")).otherwise(F.col("weight") * first["level"])
    return filled.withColumn("target", target).select("source", "idx", "source_size", "weight", "target")


def source_slots(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per source with a target: idx, source_size, full (whole blocks), blocks, passes, rest, slots, base (slots before it)."""
    size, goal = F.col("source_size"), F.round("target").cast("long")
    src = targets.where("source_size > 0").select(
        "idx", "source_size", F.expr(f"source_size div {block}").alias("full"), F.ceil(size / block).cast("long").alias("blocks"), F.least(goal, 2 * size).alias("goal")
    )
    src = src.withColumn("passes", F.expr("goal div source_size")).withColumn("rest", F.expr("goal - passes * source_size"))
    src = src.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)).where("slots > 0")
    return src.withColumn("base", F.coalesce(F.sum("slots").over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _source_of(at: Column, ranges: Column, steps: int) -> Column:
    """idx of the last of the (base, idx) ranges that begins at or below ``at``, by binary search."""

    def step(low: Column, k: Column) -> Column:
        return F.when(F.coalesce(F.get(ranges, low + k)["base"] <= at, F.lit(False)), low + k).otherwise(low)

    return F.get(ranges, F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(steps))]), F.lit(0), step))["idx"]


def shard_counts(src: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, idx, drawn, shard_size: a multinomial draw of source counts for every output shard."""
    spark = src.sparkSession
    sums = src.agg(F.sum("slots").alias("n"), F.count(F.lit(1)).alias("sources")).first()
    total = sums["n"] or 0
    shards = -(-total // shard_slots)
    steps = max(1, sums["sources"].bit_length())
    ranges = src.agg(F.sort_array(F.collect_list(F.struct("base", "idx"))).alias("ranges"))  # one row, an entry a source
    each = spark.range(0, shards, 1, max(1, min(shards, max(spark.sparkContext.defaultParallelism, shards // TASK_SHARDS)))).withColumnRenamed("id", "shard")
    each = each.withColumn("shard_size", F.least(F.lit(shard_slots).cast("long"), F.lit(total) - F.col("shard") * shard_slots)).withColumn("ranges", ranges.scalar())
    draw = F.pmod(F.xxhash64(F.lit(SEED + 2), "shard", "i"), F.lit(max(1, total)).cast("long"))
    drawn = each.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shard_size") - 1))).select("shard", "shard_size", _source_of(draw, F.col("ranges"), steps).alias("idx"))
    return drawn.groupBy("shard", "idx").agg(F.count(F.lit(1)).alias("drawn"), F.min("shard_size").alias("shard_size"))


def mixture_slots(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per slot: idx, pass, block, take (its first words that count), shard, place."""
    src = source_slots(targets, block)
    counts = cut(shard_counts(src, shard_slots))
    runs = counts.withColumn("run", F.expr(f"shard div {RUN_SHARDS}"))
    earlier = Window.partitionBy("idx").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.groupBy("idx", "run").agg(F.sum("drawn").alias("n")).select("idx", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("run_at"))
    own = Window.partitionBy("idx", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    begun = runs.withColumn("own_at", F.coalesce(F.sum("drawn").over(own), F.lit(0))).join(bases, ["idx", "run"]).withColumn("first", F.col("run_at") + F.col("own_at"))
    begun = begun.withColumn("in_shard", F.coalesce(F.sum("drawn").over(inside), F.lit(0)))
    order = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    totals = src.select("idx", "slots").join(counts.groupBy("idx").agg(F.sum("drawn").alias("all_drawn")), "idx", "left").withColumn("all_drawn", F.coalesce("all_drawn", F.lit(0)))
    over, short = F.greatest(F.col("all_drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("all_drawn"), F.lit(0))
    evened = totals.withColumn("over_at", F.coalesce(F.sum(over).over(order), F.lit(0))).withColumn("short", short).withColumn("short_at", F.coalesce(F.sum(short).over(order), F.lit(0)))
    evened = cut(evened)  # a row a source
    parts = max(begun.sparkSession.sparkContext.defaultParallelism, (evened.agg(F.sum("slots")).first()[0] or 0) // TASK_SLOTS)
    drawn = begun.join(_small(evened.select("idx", "slots", "over_at")), "idx").repartition(parts, "shard", "idx")
    drawn = drawn.withColumn("j", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("drawn") - 1)))
    drawn = drawn.withColumn("place", permuted(F.col("in_shard") + F.col("j") - F.col("first"), F.col("shard_size"), F.lit("place"), F.col("shard")))
    kept = drawn.where("j < slots").select("idx", "j", "shard", "place")
    # draws beyond a source's slots, numbered over all sources, take the open slots of others, numbered alike
    moved = drawn.where("j >= slots").select((F.col("over_at") + F.col("j") - F.col("slots")).alias("q"), "shard", "place")
    open_ = evened.where("short > 0").select("idx", F.explode(F.sequence(F.col("all_drawn"), F.col("slots") - 1)).alias("j"), "all_drawn", "short_at")
    open_ = open_.select("idx", "j", (F.col("short_at") + F.col("j") - F.col("all_drawn")).alias("q"))
    every = kept.unionByName(moved.join(open_, "q").select("idx", "j", "shard", "place"))
    slots = every.join(_small(src.drop("slots", "base")), "idx").withColumn("pass", F.expr("j div blocks")).withColumn("i", F.expr("j % blocks"))
    # the one short block of a source keeps the last place of a pass, so word totals come out exactly
    slots = slots.withColumn("block", F.when(F.col("i") < F.col("full"), permuted(F.col("i"), F.col("full"), F.col("idx"), F.col("pass"))).otherwise(F.col("i")))
    whole = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    take = F.when(F.col("pass") < F.col("passes"), whole).otherwise(F.least(F.lit(block).cast("long"), F.col("rest") - F.col("i") * block))
    return slots.select("idx", "pass", "block", take.alias("take"), "shard", "place")


def placed_documents(sized: DataFrame, targets: DataFrame, *ids: str) -> DataFrame:
    """(doc_id, size) rows with their source's figures and ``at``, their first word in the source; ``ids`` break ties."""
    chunks = max(8, -(-sized.count() // CHUNK_DOCS))
    held = sized.join(_small(targets), sized["source"].eqNullSafe(targets["source"])).drop("source", "weight").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    before = Window.partitionBy("idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.groupBy("idx", "chunk").agg(F.sum("size").alias("n")).select("idx", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("chunk_at"))
    own = Window.partitionBy("idx", "chunk").orderBy("doc_id", "size", *ids).rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("own_at", F.coalesce(F.sum("size").over(own), F.lit(0))).join(bases, ["idx", "chunk"]).withColumn("at", F.col("chunk_at") + F.col("own_at")).drop("chunk", "chunk_at", "own_at")


DRAWS = "array<struct<pass: bigint, start: bigint, take: bigint, block: bigint, shard: bigint, place: bigint>>"


def mix_draws(docs: DataFrame, block: int = BLOCK, *ids: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source, ``ids``): doc_id, ids, size, source_size, target, draws.

    ``draws`` are the word ranges that slots drew from the row, by pass and ``start`` (its words are
    numbered from 0): ``take`` words of ``block`` of the source, dealt to ``place`` of the output ``shard``.
    """
    sized = cut(docs.select(F.col("doc_id").cast("long"), "source", n_words(F.col("text")).alias("size"), *ids))
    targets = cut(mixture_targets(sized))
    slots = mixture_slots(targets, block)
    placed = placed_documents(sized, targets, *ids)
    parts = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    first = F.greatest(F.col("at"), F.col("block") * block)
    got = F.least(F.col("at") + F.col("size"), F.col("block") * block + F.col("take")) - first
    # least() skips the null of a block that wasn't drawn
    draw = F.when(F.col("take").isNotNull() & (got > 0), F.struct("pass", (first - F.col("at")).alias("start"), got.alias("take"), "block", "shard", "place"))
    # both sides grow with the corpus, which the planner can't see behind explode()
    drawn = parts.join(slots.hint("merge"), ["idx", "block"], "left").withColumn("draw", draw)
    keys = ["doc_id", *ids, "size", "source_size", "target"]
    held = drawn.groupBy("idx", "at", *keys).agg(F.sort_array(F.collect_list("draw")).cast(DRAWS).alias("draws"))
    blank = placed.where("size = 0").select(*keys, F.array().cast(DRAWS).alias("draws"))
    return held.select(*keys, "draws").unionByName(blank)


def mix_sources(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, draws.

    ``draws`` are the row's parts of the mixed shards (see ``mix_draws``), ``taken`` their words. Read by
    shard and place, with the words each names, they are the mix. A null source is a source of its own, the last. Null or blank text has size 0 and nothing
    taken. Rows that repeat a doc_id are mixed each for itself. Other columns are not read. An
    empty table gives an empty result. Reruns agree, whatever the partitions.
    """
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["take"])
    return mix_draws(docs, block).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")
