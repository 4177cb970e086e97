"""MinHash near-dedup with odd sketches.

Every document becomes its set of distinct 5-word shingles (64-bit). 160 MinHash samples give
40 bands of 4, and the same samples folded into a 512-bit parity bitmap give the odd sketch
(Mitzenmacher, Pagh and Pham, 2014): the population count of the XOR of two sketches estimates
a high Jaccard similarity closely. A pair is a candidate when a band agrees and the sketch
estimate reaches ``SLACK`` below the threshold (five standard errors); candidates are confirmed
on the full shingle sets of their texts.

Large groups never become all pairs. Exact copies of a set collapse to one representative. Each
bucket of a band elects a hub (the member that shares most buckets with others, so the original of
a family of edits), and every member is compared with the best known hub of its buckets: one pair a
member. What hubs leave apart, members of buckets that still hold several components, meets by
prefixes instead of by bucket: shingles in one order, rare ones first, of which two sets at the
threshold share one so early that what follows it can still reach the threshold (Bayardo, Ma and
Srikant, 2007; Xiao and others, 2008). That is exact for every pair with an agreeing band, whatever
the size of the bucket, and a list of a common shingle is dropped as soon as all its members are of
one component or too late in the order. A pair at the threshold misses all bands with probability
below 3e-7; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.llm.text import hash64, words_of
from tessera.operators.components import connected_components
from tessera.session import cut, cut_table, settled

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 40, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS, SKETCH_LONGS = 512, 8
SLACK = 0.20
BROADCAST_IDS = 500_000  #: document ids (8 bytes each) that may be sent to every executor

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_POLY = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) | _U(1)
_MUL = (_RNG.integers(1, 2**31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_BANDMUL = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | _U(1)
_PLACE = (np.arange(SAMPLES, dtype=np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer with full avalanche."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, hashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    hashes.trim()
    if len(w) < SHINGLE:
        return mix((w * _POLY[: len(w)]).sum(dtype=np.uint64, keepdims=True) + _U(len(w)))
    total = w[: len(w) - SHINGLE + 1] * _POLY[0]
    for i in range(1, SHINGLE):
        total = total + w[i : len(w) - SHINGLE + 1 + i] * _POLY[i]
    return np.unique(mix(total))


def minhash(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    small = (shingles >> _U(32)).astype(np.uint32)
    for at in range(0, len(small), 2048):
        part = small[at : at + 2048]
        np.minimum(low, (_MUL[:, None] * part[None, :] + _ADD[:, None]).min(axis=1), out=low)
    return low


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = (samples.astype(np.uint64).reshape(BANDS, ROWS) + _U(1)) * _BANDMUL
    return mix(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of how many samples fall on each bit."""
    bits = mix(samples.astype(np.uint64) + _PLACE) % _U(SKETCH_BITS)
    parity = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def most_odd_bits(similarity: float) -> int:
    """Population count of the XOR expected at a similarity."""
    return int(SKETCH_BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - similarity) / SKETCH_BITS)))


def estimate(odd_bits: np.ndarray) -> np.ndarray:
    """Similarity for a population count of the XOR."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(1e-9, 1 - 2 * np.asarray(odd_bits) / SKETCH_BITS))


_SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_a", T.LongType()),
        T.StructField("set_b", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.ArrayType(T.LongType())),
    ]
)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = hash64()
    for batch in batches:
        rows = []
        for text in batch["text"]:
            s = shingle_set(text, hashes)
            if not len(s):
                rows.append((0, 0, 0, None, None))
                continue
            m = minhash(s)
            rows.append((len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + _U(7))).view(np.int64)), band_keys(m), odd_sketch(m)))
        out = pd.DataFrame(rows, columns=["n_shingles", "set_a", "set_b", "bands", "sketch"])
        out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
        yield out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit set digest, band keys and odd sketch of each row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_sign, _SIGNED)


def _xor_bits(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_LONGS)), F.lit(0))


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = hash64()
    last: tuple = (None, None)
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        for i, (x, y) in enumerate(zip(batch["text_a"], batch["text_b"], strict=True)):
            a = last[1] if last[0] == x else shingle_set(x, hashes)
            last = (x, a)
            b = shingle_set(y, hashes)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep[i] = both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)
        yield batch.loc[keep, ["a", "b"]]


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents in ``ids``.

    Up to ``BROADCAST_IDS`` ids are sent to the texts, so that only these texts are shuffled later;
    more ids meet them in a shuffled join.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    pairs = settled(pairs)
    texts = texts_of(docs, pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id"))
    full = pairs.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    return full.select("a", "b", "text_a", "text_b").mapInPandas(_confirm, "a long, b long")


def _sketches_agree(a: str = "sa", b: str = "sb") -> Column:
    return _xor_bits(a, b) <= most_odd_bits(PERCENT / 100 - SLACK)


def set_classes(signed: DataFrame) -> DataFrame:
    """One row per distinct set: set_a, set_b, n_shingles, rep (smallest doc_id), top, bands, sketch."""
    held = signed.where("n_shingles > 0 and doc_id is not null")
    return held.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))


def bucket_members(reps: DataFrame) -> DataFrame:
    """(key, id, fame, neg): members of the buckets of two and more; fame is how many members the buckets of an id have."""
    banded = reps.select(F.explode("bands").alias("key"), "id")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    by_id = banded.join(shared, "key").groupBy("id").agg(F.sum("c").alias("fame"), F.collect_list("key").alias("keys"))  # 40 keys an id
    return by_id.select(F.explode("keys").alias("key"), "id", "fame", (-F.col("id")).alias("neg"))


def hub_pairs(members: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): every member and the best known hub of its buckets, if sizes and sketches allow a link."""
    hubs = members.groupBy("key").agg(F.max(F.struct("fame", "neg")).alias("hub"))
    best = members.join(hubs, "key").where("neg <> hub.neg").groupBy("id").agg(F.max("hub").alias("hub"))
    pairs = best.select(F.col("id").alias("a"), (-F.col("hub.neg")).alias("b"))
    x = reps.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    y = reps.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    sized = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    return pairs.join(x, "a").join(y, "b").where(sized & _sketches_agree()).select("a", "b")


def _list_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = hash64()
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            sets = [shingle_set(x, hashes) for x in part["text"]]
            yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(np.int64), [len(x) for x in sets]), "s": np.concatenate(sets).view(np.int64)})


def _can_reach(overlap: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m that share ``overlap`` reach the threshold."""
    return (100 + PERCENT) * overlap >= PERCENT * (n + m)


def prefix_pairs(apart: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): pairs across components among ``apart`` (id, comp) that prefixes, sizes and sketches don't rule out.

    The shingles of a set are numbered from the rarest (among ``apart``). The first one that two sets
    share, at places p and q, leaves room for n - p and m - q shared ones. (An id with several texts
    has the shingles of all, which only leaves it more room.)
    """
    rows = settled(texts_of(docs, apart.select("id")).mapInPandas(_list_shingles, "id long, s long"))
    common = rows.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    own = Window.partitionBy("id")
    numbered = rows.join(common, "s").withColumn("k", F.row_number().over(own.orderBy("c", "s"))).withColumn("all", F.count(F.lit(1)).over(own))
    known = numbered.join(reps.select("id", "n_shingles", "sketch"), "id").join(apart, "id")
    room = F.col("all") - F.col("k") + 1  # the shingles from this one on; those that no other set has came before
    early = known.withColumn("room", room).where(100 * F.col("room") >= PERCENT * F.col("n_shingles")).select("s", "id", "comp", "n_shingles", "room", "sketch")
    placed = cut_table(early)
    least = placed.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n_shingles").alias("least")).where("lo <> hi").select("s", "least")
    able = placed.join(least, "s").where(_can_reach(F.col("room"), F.col("n_shingles"), F.col("least")))
    lead = able.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("s").agg(F.max(F.struct("c", "comp")).alias("lead"), F.count(F.lit(1)).alias("comps"))
    mixed = able.join(lead.where("comps > 1").select("s", F.col("lead.comp").alias("lead")), "s")
    x = mixed.where("comp <> lead").select("s", F.col("id").alias("i"), F.col("comp").alias("ci"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"), F.col("room").alias("ra"))
    y = mixed.select(F.col("s").alias("t"), F.col("id").alias("j"), F.col("comp").alias("cj"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"), F.col("room").alias("rb"))
    close = (F.col("s") == F.col("t")) & (F.col("ci") != F.col("cj")) & _can_reach(F.least("ra", "rb"), F.col("na"), F.col("nb")) & _sketches_agree()
    return x.join(y, close).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def near_duplicate_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between representatives of sets that connect all that reach the threshold.

    There are as many confirmed links as the components need, at most.
    """
    reps = classes.select(F.col("rep").alias("id"), "n_shingles", "bands", "sketch")
    members = settled(bucket_members(reps))
    first = settled(confirm(hub_pairs(members, reps), docs))
    parts = connected_components(first, "a", "b").withColumnsRenamed({"node": "id"})
    placed = settled(members.join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp")))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    apart = settled(placed.join(mixed, "key").groupBy("id").agg(F.min("comp").alias("comp")))
    return first.unionByName(confirm(prefix_pairs(apart, reps, docs), docs))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Null or blank text: no shingles, linked with nothing, kept. Rows that share a doc_id and have
    words are one node. A null doc_id is linked with nothing: component_id is null, kept is true.
    Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    signed = cut_table(signatures(docs))
    classes = cut_table(set_classes(signed))
    links = near_duplicate_links(docs, classes)
    worded = signed.where("n_shingles > 0 and doc_id is not null")
    sets = F.struct("set_a", "set_b", "n_shingles")
    again = worded.groupBy("doc_id").agg(F.min(sets).alias("lo"), F.max(sets).alias("hi")).where("lo <> hi").select("doc_id")
    key = ["set_a", "set_b", "n_shingles"]
    one_node = worded.join(again, "doc_id", "left_semi").join(classes.select(*key, "rep"), key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    parts = connected_components(links.unionByName(one_node), "a", "b").withColumnRenamed("node", "rep")
    groups = classes.select(*key, "rep", "top").join(parts, "rep", "left").where("component is not null or top > rep").select(*key, F.coalesce("component", "rep").alias("component_id"))
    found = signed.select("doc_id", *key).join(groups, key, "left")
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", linked.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
