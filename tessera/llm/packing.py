"""Best-fit packing with Martello-Toth dominance reduction.

Token pieces have whole lengths from 1 to the capacity, so an instance of any size is a histogram
of at most ``capacity`` counts; the plan is made on it, on the driver. First the reduction of
Martello and Toth (1990): taken from the longest, a set of pieces that dominates every other
feasible set with its longest piece is fixed, in as many copies as there are; the shrunk rest is
packed best-fit decreasing, bins of equal content counted together. The plan is a list of rank
ranges per length, of a size bounded by the capacity; each piece finds its place by its rank among
pieces of its length, and ranks are counted in hash buckets, so that no length is one task.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tessera.session import cut

CAPACITY, END_ID = 2048, 0
BUCKET_ROWS = 500_000
BROADCAST_ROWS = 200_000  #: rows of a plan (60 bytes each) that may be sent to every executor


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


MARKS = ".,;:!?#$%&*()"
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: a word of Latin letters, marks after it: the vocabulary's splitter cuts it there, so both parts are encoded for themselves
_PLAIN = f"^{_LETTERS}[{MARKS}]*$"
APART = "\x01"  #: stands between words that are encoded together; words that hold it go alone
TOGETHER, GROUP_BYTES = 4096, 8 << 20
LONGEST = 63  #: bytes of a word that is merged here; the tokenizer itself encodes longer ones
COLUMNS = 8192  #: words merged at a time
_NO_SYMBOL, _NO_PAIR, _NO_MERGE = 0xFFFF, 0xFFFFFFFF, np.iinfo(np.int32).max

#: how a vocabulary splits texts whose plain words can be merged here: white space is dropped, runs of letters and of marks stand alone
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "ignore_merges": False}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def mergeable(config: dict) -> bool:
    """Whether this vocabulary encodes a plain word by the byte-pair merges of its bytes and nothing else."""
    model, splits = config["model"], (config["pre_tokenizer"] or {}).get("pretokenizers") or []
    return (
        config["normalizer"] == _NORMAL
        and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        and splits[0] == _SPLIT
        and not splits[1]["add_prefix_space"]
        and not splits[1]["use_regex"]
        and all(model.get(k, v) == v for k, v in _MODEL.items())
        and max(model["vocab"].values()) < _NO_SYMBOL
        and all(c + end in model["vocab"] for c in _byte_letters() for end in ("", "</w>"))
        and not any(re.search(_PLAIN, t["content"]) or re.search(f"^[{MARKS}]*$", t["content"]) for t in config["added_tokens"])
    )


class PairMerges:
    """Byte-pair encoding of many short words at once.

    Words stand in columns. Each round merges one pair in every column: the pair of the lowest rank,
    the leftmost of equal ones, which is the order of the tokenizer.
    """

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]):
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.uint32)
        self.final = np.array([vocab[c + "</w>"] for c in letters], np.uint32)
        self.result = np.array([vocab[a + b] for a, b in merges], np.uint32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.uint32)
        bits = max(4, (4 * len(merges)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, _NO_PAIR, np.uint32), np.full(1 << bits, _NO_MERGE, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # open addressing: who finds a slot taken goes on to the next one
            free = np.flatnonzero(self.keys[at] == _NO_PAIR)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.ranks[at[put]] = keys[left[put]], left[put]
            left, at = np.delete(left, put), (np.delete(at, put) + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761) >> self.shift).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << np.uint32(16) | b
        at = self._slot(keys)
        held, ranks = self.keys[at], self.ranks[at]
        other = held != keys
        ranks[other] = _NO_MERGE
        left = np.flatnonzero(other & (held != _NO_PAIR))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            held = self.keys[at]
            found = held == keys[left]
            ranks[left[found]] = self.ranks[at[found]]
            on = ~found & (held != _NO_PAIR)
            left, at = left[on], at[on]
        return ranks

    def _columns(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, high = len(starts), int(sizes.max())
        rows = np.arange(high + 1, dtype=np.int64)[:, None]  # the last row stands for no symbol
        inside = rows < sizes
        held = np.full((high + 1, n), _NO_SYMBOL, np.uint32)
        held[inside] = self.inner[data[(rows + starts)[inside]]]
        columns = np.arange(n)
        held[sizes - 1, columns] = self.final[data[starts + sizes - 1]]
        after = np.where(rows + 1 < sizes, rows + 1, high)
        before = np.broadcast_to(np.where(rows > 0, rows - 1, high), held.shape).copy()
        order = np.full((high + 1, n), _NO_MERGE, np.int32)

        def ordered(ranks: np.ndarray, row: np.ndarray) -> np.ndarray:
            return np.where(ranks == _NO_MERGE, _NO_MERGE, ranks << 6 | row).astype(np.int32)

        if high > 1:
            order[: high - 1] = ordered(self._rank(held[: high - 1].ravel(), held[1:high].ravel()).reshape(high - 1, n), rows[: high - 1])
        while True:
            best = order[:high].min(axis=0)
            at = np.flatnonzero(best != _NO_MERGE)
            if not len(at):
                break
            row, symbol = best[at] & 63, self.result[best[at] >> 6]
            gone = after[row, at]
            nxt, prev = after[gone, at], before[row, at]
            held[row, at], held[gone, at], order[gone, at] = symbol, _NO_SYMBOL, _NO_MERGE
            after[row, at], before[nxt, at] = nxt, row
            order[row, at] = ordered(self._rank(symbol, held[nxt, at]), row)
            order[prev, at] = ordered(self._rank(held[prev, at], symbol), prev)
        kept = held.T
        return kept[kept != _NO_SYMBOL], (held != _NO_SYMBOL).sum(axis=0)

    def encode(self, words: pa.Array) -> pa.Array:
        """Ids of non-empty words of at most LONGEST bytes, as large_binary."""
        offsets, data = _flat(words)
        starts, sizes = offsets[:-1], np.diff(offsets)
        by_size = np.argsort(sizes, kind="stable")
        ids, counts = [], []
        for at in range(0, len(by_size), COLUMNS):
            some = by_size[at : at + COLUMNS]
            found, n = self._columns(data, starts[some], sizes[some])
            ids.append(found.astype("<u4"))
            counts.append(n)
        if not ids:
            return pa.array([], pa.large_binary())
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) * 4
        held = pa.Array.from_buffers(pa.large_binary(), len(by_size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.concatenate(ids))])
        place = np.empty(len(by_size), np.int64)
        place[by_size] = np.arange(len(by_size))
        return held.take(pa.array(place))


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array without nulls."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


class WordEncoder:
    """Ids of words as little-endian uint32.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its
    words in order. Each distinct word of a group of texts is encoded once: plain words by the
    merges of the vocabulary, many at a time, others by the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.apart = self._ids(APART)
        config = json.loads(Path(path).read_text("utf-8"))
        model = config["model"]
        self.merges = PairMerges(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]) if mergeable(config) else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _by_tokenizer(self, words: pa.Array) -> pa.Array:
        texts = [w.decode("utf-8", "replace") for w in words.cast(pa.large_binary()).to_pylist()]
        found = {w: self._ids(w).tobytes() for w in texts if APART in w or len(self.apart) != 1}
        rest = [w for w in texts if w not in found]
        for at in range(0, len(rest), TOGETHER):
            some = rest[at : at + TOGETHER]
            ids = self._ids(f" {APART} ".join(some))
            ends = np.append(np.flatnonzero(ids == self.apart[0]), len(ids)) * 4
            data, start = ids.tobytes(), 0
            for w, end in zip(some, ends.tolist(), strict=True):
                found[w] = data[start:end]
                start = end + 4
        return pa.array([found[w] for w in texts], pa.large_binary())

    def _of_distinct(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(ids, place of each word's ids) of distinct words."""
        if self.merges is None:
            return self._by_tokenizer(words), np.arange(len(words))
        heads = pc.ascii_rtrim(words, MARKS)
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.less_equal(pc.binary_length(heads), LONGEST))
        head = pc.utf8_lower(heads.filter(plain)).dictionary_encode()
        tail = pc.replace_substring_regex(words.filter(plain), f"^{_LETTERS}", "").dictionary_encode()
        of_plain = pc.binary_join_element_wise(
            self.merges.encode(head.dictionary).take(head.indices), self._by_tokenizer(tail.dictionary).take(tail.indices), pa.scalar(b"", pa.large_binary())
        )
        is_plain = plain.to_numpy(zero_copy_only=False)
        place = np.where(is_plain, np.cumsum(is_plain) - 1, len(of_plain) + np.cumsum(~is_plain) - 1)
        return pa.concat_arrays([of_plain, self._by_tokenizer(words.filter(pc.invert(plain)))]), place

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, memoryview]:
        """(offsets, bytes): ids of the texts, one after the other, each with the end id after it."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        words = split.flatten().dictionary_encode()
        ids, place = self._of_distinct(words.dictionary)
        table = pa.concat_arrays([ids, pa.array([np.array([end_id], "<u4").tobytes()], pa.large_binary())])
        ends = np.cumsum(counts + 1)  # an end stands after each text's words
        order = np.full(int(ends[-1]), len(ids), np.int64)
        is_word = np.ones(len(order), bool)
        is_word[ends - 1] = False
        order[is_word] = place[words.indices.to_numpy()]
        offsets, data = _flat(table.take(pa.array(order)))
        return np.concatenate([offsets[:1], offsets[ends]]), memoryview(data)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _groups(batch: pa.RecordBatch, most: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``most`` bytes, or of one row with more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def _pieces_of(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for group in _groups(batch):
                offsets, data = encode(group["text"], end_id)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, (begin, end) in enumerate(itertools.pairwise(offsets.tolist())):
                    for k, at in enumerate(range(begin, end, 4 * capacity)):
                        part = data[at : min(end, at + 4 * capacity)]
                        row.append(i)
                        piece.append(k)
                        start.append((at - begin) // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(bytes(part))
                longs = [pa.array(v, pa.int64()) for v in (start, length, crc)]
                columns = [group["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *longs, *([pa.array(ids, pa.binary())] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return run


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked, ids (binary, uint32)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    run = _pieces_of(tokenizer or default_tokenizer(), capacity, end_id, keep_ids)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _largest(counts: list[int], room: int, besides: int) -> int:
    for w in range(room, 0, -1):
        if counts[w] > (w == besides):
            return w
    return 0


def _smallest(counts: list[int], besides: int, n: int) -> list[int]:
    found: list[int] = []
    for w in range(1, len(counts)):
        found += [w] * min(n - len(found), counts[w] - (w == besides))
        if len(found) == n:
            break
    return found


def _best_two(counts: list[int], room: int, besides: int) -> int:
    sizes = [w for w in range(1, room) if counts[w] > (w == besides)]
    best, hi = 0, len(sizes) - 1
    for lo, w in enumerate(sizes):
        while hi >= lo and w + sizes[hi] > room:
            hi -= 1
        if hi < lo:
            break
        if hi > lo or counts[w] - (w == besides) > 1:
            best = max(best, w + sizes[hi])
    return best


def reduce_instance(counts: list[int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fix dominating sets and take them out of ``counts``; returns (copies, [(length, times)])."""
    fixed: list[tuple[int, list[tuple[int, int]]]] = []
    changed = True
    while changed:
        changed = False
        for w in range(capacity, 0, -1):
            while counts[w]:
                room = capacity - w
                mate = _largest(counts, room, w)
                if mate == 0:  # nothing fits beside it
                    fixed.append((counts[w], [(w, 1)]))
                    counts[w] = 0
                    changed = True
                    break
                if mate != room:
                    low = _smallest(counts, w, 3)
                    if len(low) > 2 and sum(low) <= room:
                        break  # three more may fit: no set of at most three dominates
                    if len(low) > 1 and sum(low[:2]) <= room and mate < _best_two(counts, room, w):
                        break
                n = counts[w] // 2 if mate == w else min(counts[w], counts[mate])
                fixed.append((n, [(w, 2)] if mate == w else [(w, 1), (mate, 1)]))
                counts[w] -= n
                counts[mate] -= n
                changed = True
    return fixed


def best_fit(counts: list[int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over a histogram; bins of equal content stay one entry."""
    open_bins: dict[int, list[list]] = {}  # free space -> [[copies, content]]
    free: list[int] = []

    def put(space: int, copies: int, content: list[tuple[int, int]]) -> None:
        if copies:
            if space not in open_bins:
                bisect.insort(free, space)
                open_bins[space] = []
            open_bins[space].append([copies, content])

    for w in range(capacity, 0, -1):
        left = counts[w]
        while left:
            at = bisect.bisect_left(free, w)
            if at == len(free):
                each, space, n, content = capacity // w, capacity, left, []
            else:
                space = free[at]
                n, content = open_bins[space].pop()
                if not open_bins[space]:
                    del open_bins[space], free[at]
                each = space // w
            whole = min(n, left // each)
            put(space - each * w, whole, [*content, (w, each)])
            left -= whole * each
            n -= whole
            if n and left and left < each:
                put(space - left * w, 1, [*content, (w, left)])
                n, left = n - 1, 0
            if content:
                put(space, n, content)
    return [(copies, content) for held in open_bins.values() for copies, content in held]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, times per sequence, first sequence, first offset)."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    bins = reduce_instance(counts, capacity)
    bins += best_fit(counts, capacity)
    rows, used, sequence = [], [0] * (capacity + 1), 0
    for copies, content in bins:
        offset = 0
        for length, times in content:
            rows.append((length, used[length], used[length] + copies * times, times, sequence, offset))
            used[length] += copies * times
            offset += length * times
        sequence += copies
    return rows


def best_fit_pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset, in as few sequences as the method finds.

    Null text counts as empty (its piece is the end id alone). Rows that repeat a doc_id are packed
    each for itself; a null doc_id is packed too. Other columns of ``docs`` are not read. An empty
    table gives an empty result.
    """
    pieces = cut(token_pieces(docs, tokenizer, capacity, end_id, keep_ids))
    total = pieces.count()
    buckets = max(16, -(-total // BUCKET_ROWS))
    held = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    by_bucket = cut(held.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = held.withColumn("place", F.row_number().over(own) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("place") + F.col("base"))
    rows = plan(histogram, capacity)
    # the plan has a few rows a length: it grows with the capacity, not with the documents; a larger one is joined by shuffle
    slots = docs.sparkSession.createDataFrame(rows or [(0, 0, 0, 1, 0, 0)], "slot_length long, first long, until long, times long, sequence0 long, offset0 long")
    found = ranked.join(F.broadcast(slots) if len(rows) <= BROADCAST_ROWS else slots, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until")))
    step = F.col("rank") - F.col("first")
    return found.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence0") + F.floor(step / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + step % F.col("times") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )
