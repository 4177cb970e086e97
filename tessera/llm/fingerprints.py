"""Order MinHash document fingerprints (Marcais et al., 2019).

A text's k-mers are its runs of ``K`` words, each numbered by its occurrence so that repeats differ.
For each of ``SKETCHES`` hash functions the ``PICK`` k-mers of least hash are selected, put back in
the order of the text, and their tuple is hashed: two texts share an entry when they share k-mers
in the same order, so the share of equal entries follows edit distance, not only common content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.near_dups import mix
from tessera.llm.text import hash64
from tessera.session import cut

K, PICK, SKETCHES = 2, 2, 64
CHUNK_CHARS = 16 << 20  #: code points of a chunk, unless that makes more than MOST_CHUNKS
MOST_CHUNKS = 200_000
KEYS_A_TASK = 2_000_000

_U = np.uint64
_RNG = np.random.default_rng(20240613)
_POLY = _RNG.integers(1, 2**63, K, dtype=np.uint64) | _U(1)
_MUL = _RNG.integers(1, 2**63, SKETCHES, dtype=np.uint64) | _U(1)
_ADD = _RNG.integers(1, 2**63, SKETCHES, dtype=np.uint64)
_TUPLE = _RNG.integers(1, 2**63, PICK, dtype=np.uint64) | _U(1)


def numbered_kmers(text: str, hashes) -> np.ndarray:
    """Hashes of the occurrence-numbered k-mers in text order; a text below K words is one k-mer."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.full(1, len(text), np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    hashes.trim()
    if len(w) < K:
        grams = mix(w[:1] * _POLY[0] + _U(K))
    else:
        grams = w[: len(w) - K + 1] * _POLY[0]
        for i in range(1, K):
            grams = grams + w[i : len(w) - K + 1 + i] * _POLY[i]
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.concatenate(([0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1))
    number = np.arange(len(grams)) - np.repeat(first, np.diff(np.append(first, len(grams))))
    times = np.empty(len(grams), np.uint64)
    times[order] = number.astype(np.uint64)
    return mix(grams + times * _U(0x9E3779B97F4A7C15))


def order_minhash(kmers: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of the ordered tuples of selected k-mers (uint32)."""
    n = len(kmers)
    if n <= PICK:
        picked = np.tile(kmers, (SKETCHES, 1))
    else:
        best, where = np.empty((SKETCHES, 0), np.uint64), np.empty((SKETCHES, 0), np.int64)
        for at in range(0, n, 2048):
            part = kmers[at : at + 2048]
            keys = _MUL[:, None] * part[None, :] + _ADD[:, None]
            keys ^= keys >> _U(29)
            here = []
            for _ in range(min(PICK, len(part))):
                low = keys.argmin(axis=1)
                here.append((keys[np.arange(SKETCHES), low], low + at))
                keys[np.arange(SKETCHES), low] = _U(0xFFFFFFFFFFFFFFFF)
            best = np.concatenate([best, *[k[:, None] for k, _ in here]], axis=1)
            where = np.concatenate([where, *[p[:, None] for _, p in here]], axis=1)
            keep = np.lexsort((where, best), axis=1)[:, :PICK] if best.shape[1] > PICK else None
            if keep is not None:
                best, where = np.take_along_axis(best, keep, 1), np.take_along_axis(where, keep, 1)
        picked = kmers[np.sort(where, axis=1)]
    folded = np.zeros(SKETCHES, np.uint64) + _U(picked.shape[1])
    for i in range(picked.shape[1]):
        folded = mix(folded * _TUPLE[i % PICK] + picked[:, i])
    return (mix(folded + np.arange(SKETCHES, dtype=np.uint64)) >> _U(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _print_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one chunk in order, the first row of the next chunk (``head``) last: each is compared with the row after it."""
    import hashlib

    hashes = hash64()
    sign = lambda text: order_minhash(numbered_kmers(text, hashes))
    show = lambda s: s.astype(">u4").tobytes().hex()
    held: tuple | None = None
    for batch in batches:
        rows = []
        for head, doc_id, text in zip(batch["head"], batch["doc_id"].astype("Int64"), batch["text"], strict=True):
            text = text or ""
            now = (doc_id, text, sign(text))
            if held is not None:
                edited = edited_text(held[1], text)
                mark = sign(edited)
                rows.append((held[0], len(held[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), show(held[2]), show(mark), likeness(held[2], mark), likeness(held[2], now[2])))
            held = None if head else now
        out = pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


_KEY = ["z", "d", "h"]  #: null doc_ids last, doc_id, hash of the text
_KEY_ROWS = "z int, d long, h long"


def _key_of(docs: DataFrame) -> list[Column]:
    return [
        F.col("doc_id").isNull().cast("int").alias("z"),
        F.coalesce(F.col("doc_id"), F.lit(0).cast("long")).alias("d"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"),
    ]


def _cut_keys(most: int):
    """Of sorted rows (key, n): the first key, and each one at which ``most`` code points have passed since the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passed, last = most, None
        for batch in batches:
            found = []
            for z, d, h, n in zip(batch["z"].tolist(), batch["d"].tolist(), batch["h"].tolist(), batch["n"].tolist(), strict=True):
                if passed >= most and (z, d, h) != last:
                    found.append((z, d, h))
                    passed = 0
                passed += n
                last = (z, d, h)
            yield pd.DataFrame(found, columns=_KEY)

    return run


def chunk_bounds(sizes: DataFrame, chunk_chars: int | None = None) -> list[tuple[int, int, int]]:
    """Sorted first keys of chunks of about equal text, from (z, d, h, n) rows; the first is the smallest key of all.

    At most about ``MOST_CHUNKS`` and one for every ``KEYS_A_TASK`` rows, as the bounds of any range partitioning.
    """
    sums = sizes.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).first()
    most = chunk_chars or max(CHUNK_CHARS, (sums["n"] or 0) // MOST_CHUNKS)
    ranged = sizes.repartitionByRange(max(1, -(-sums["rows"] // KEYS_A_TASK)), *_KEY).sortWithinPartitions(*_KEY)
    return sorted((r["z"], r["d"], r["h"]) for r in ranged.mapInPandas(_cut_keys(most), _KEY_ROWS).collect())


def _chunk_of(bounds: list[tuple[int, int, int]]) -> Column:
    """Number of the last bound at or below the row's key, by binary search."""
    values = F.from_json(F.lit("[" + ",".join(f'{{"z":{z},"d":{d},"h":{h}}}' for z, d, h in bounds) + "]"), f"array<struct<{_KEY_ROWS.replace('z int', 'z:int').replace('d long', 'd:bigint').replace('h long', 'h:bigint')}>>")
    key = F.struct(*_KEY)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(bounds).bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda low, k: F.when(F.coalesce(F.get(values, low + k) <= key, F.lit(False)), low + k).otherwise(low))


def fingerprint_neighbours(docs: DataFrame, chunk_chars: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document, with their likenesses.

    Rows go in the order of doc_id, nulls last, rows that repeat a doc_id by the hash of their text; the
    row after the last is the first, also when it is the only one. Null text counts as empty. Equal
    texts have equal fingerprints. Other columns are not read. An empty table gives an empty result.
    Texts are shuffled once, into ranges of about ``chunk_chars`` code points; rows of a task are
    streamed. Rows alike in doc_id and text stay in one range.
    """
    held = docs.select(F.col("doc_id").cast("long"), "text")
    keyed = held.select("doc_id", "text", *_key_of(held))
    bounds = chunk_bounds(cut(keyed.select(*_KEY, F.coalesce(F.length("text"), F.lit(0)).alias("n"))), chunk_chars)
    n = max(1, len(bounds))
    chunked = keyed.withColumn("chunk", _chunk_of(bounds or [(0, 0, 0)]))
    # the first row of each chunk also closes the chunk before it, that of the first closes the last
    firsts = docs.sparkSession.createDataFrame(bounds, _KEY_ROWS)
    heads = chunked.join(F.broadcast(firsts), _KEY).groupBy("chunk").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("doc_id").alias("doc_id"))
    closing = cut(heads.select("doc_id", "text", *[F.lit(0).cast(t).alias(c) for c, t in (("z", "int"), ("d", "long"), ("h", "long"))], F.pmod(F.col("chunk") - 1, F.lit(n)).alias("chunk"), F.lit(1).alias("head")))
    rows = chunked.withColumn("head", F.lit(0)).unionByName(closing)
    placed = rows.repartitionById(n, F.col("chunk").cast("int")).sortWithinPartitions("head", *_KEY)
    return placed.select("head", "doc_id", "text").mapInPandas(
        _print_chunk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
