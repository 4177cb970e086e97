"""Subword lattice likelihood.

The pieces of an existing vocabulary, weighted by unigram log-probabilities, give every word a
lattice of segmentations; a forward recursion in log space returns the marginal probability of
the word over all of them; words of any length are read whole, long ones in stretches that carry the
recursion on. A word of the training documents has one more edge, itself, weighed by
its discounted relative frequency; the discounts' mass weighs the segmentations into pieces
(absolute discounting), so the probabilities of all texts still sum to one at most. The vocabulary is fixed; its unigram scores are fitted by expectation
maximization over the word counts of all training documents, in rounds of distributed expected
counts. Each word is weighed once, in the table of words; documents gather their words' scores in
chunks, through the vocabulary of a chunk, so that a common word costs one row per chunk.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.llm.near_dups import mix
from tessera.session import cut_table

FOLDS, HELD_OUT = 5, 1
ROUNDS = 4
LEAST = 0.01
CHUNK_DOCS = 8192
CHUNK_MB = 24
END = ""  #: the end of a text, as a word
LONG_WORD = 512  #: bytes; longer words are weighed one by one, ``STRETCH`` bytes at a time
STRETCH = 4096
GROUP_CELLS = 150_000  #: bytes of words that are weighed together
_U = np.uint64


def default_vocabulary() -> list[bytes]:
    """Pieces of the public 32k vocabulary as UTF-8, single bytes included, word starts as a blank.

    Its runs of blanks are left out: no word holds a blank after its start.
    """
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:]:
                pieces.add(piece)
    return sorted(pieces)


class Lattice:
    """Batched forward and forward-backward recursions over the segmentations of words."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.logp = logp
        self.sizes = np.array(sorted({len(p) for p in pieces}))
        self.longest = int(self.sizes[-1])
        self.power = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(self.longest + 1)], np.uint64)
        keys = self._hash_pieces(pieces)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        bits = 1 << 20
        self.table = np.zeros(bits, np.int32)
        self._fill(bits)

    def _hash_pieces(self, pieces: list[bytes]) -> np.ndarray:
        out = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            h = 0
            for b in p:
                h = (h * 0x100000001B3 + b + 1) & 0xFFFFFFFFFFFFFFFF
            out[i] = h
        return mix(out + np.fromiter(map(len, pieces), np.uint64, len(pieces)))

    def _fill(self, bits: int) -> None:
        """Open addressing with linear probes; slot -> position in keys, plus one."""
        mask = bits - 1
        for pos, key in enumerate(self.keys.tolist()):
            at = key & mask
            while self.table[at]:
                at = (at + 1) & mask
            self.table[at] = pos + 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers of substring hashes, -1 where there is no such piece."""
        mask = _U(len(self.table) - 1)
        at = hashes & mask
        out = np.full(hashes.shape, -1, np.int64)
        open_ = np.arange(hashes.size)
        flat, at = hashes.ravel(), at.ravel()
        res = out.ravel()
        while open_.size:
            slot = self.table[at[open_]]
            has = slot > 0
            open_, slot = open_[has], slot[has]
            hit = self.keys[slot - 1] == flat[open_]
            res[open_[hit]] = self.ids[slot[hit] - 1]
            open_ = open_[~hit]
            at[open_] = (at[open_] + _U(1)) & mask
        return res.reshape(hashes.shape)

    def _edges(self, words: list[bytes]):
        """Piece numbers by (length, word, start) for words of one length."""
        n = len(words[0])
        chars = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n).astype(np.uint64) + _U(1)
        prefix = np.zeros((len(words), n + 1), np.uint64)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * _U(0x100000001B3) + chars[:, i]
        edges = {}
        for size in self.sizes[self.sizes <= n].tolist():
            raw = prefix[:, size:] - prefix[:, : n + 1 - size] * self.power[size]
            edges[size] = self.find(mix(raw + _U(size)))
        return n, edges

    def _ends(self, word: bytes, a: int, b: int) -> np.ndarray:
        """Piece numbers (length, end) of pieces that end in a+1..b, -1 where there is none."""
        lo = max(0, a + 1 - self.longest)
        found = np.full((len(self.sizes), b - a), -1, np.int64)
        _, edges = self._edges([word[lo:b]])
        for k, size in enumerate(self.sizes.tolist()):
            if size in edges:
                own = edges[size][0]  # by start from lo, so ends from lo + size
                skip = max(0, a + 1 - lo - size)
                found[k, max(0, lo + size - a - 1) :] = own[skip:]
        return found

    def _forward(self, scores: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log mass of the prefixes up to each end, after the ``longest`` values ``before`` them."""
        ahead = np.concatenate([before, np.full(scores.shape[1], -np.inf)])
        for e in range(scores.shape[1]):
            into = ahead[self.longest + e - self.sizes] + scores[:, e]
            top = into.max()
            if top > -np.inf:
                ahead[self.longest + e] = top + np.log(np.exp(into - top).sum())
        return ahead

    def weigh_long(self, word: bytes, expected: np.ndarray | None = None, count: float = 1.0) -> float:
        """As ``weigh`` for one word of any length: a stretch is held at a time, and the state between stretches."""
        cuts = list(range(0, len(word), STRETCH))
        state = np.full(self.longest, -np.inf)
        state[-1] = 0.0
        states = []
        for a in cuts:
            states.append(state)
            edges = self._ends(word, a, min(len(word), a + STRETCH))
            state = self._forward(np.where(edges >= 0, self.logp[edges], -np.inf), state)[-self.longest :]
        total = float(state[-1])
        if expected is not None:
            later = np.full(self.longest, -np.inf)  # mass from the last places of the stretch so far, its end last
            later[-1] = 0.0
            for a, state in zip(reversed(cuts), reversed(states), strict=True):
                edges = self._ends(word, a, min(len(word), a + STRETCH))
                scores = np.where(edges >= 0, self.logp[edges], -np.inf)
                ahead = self._forward(scores, state)
                behind = np.full(len(ahead), -np.inf)
                behind[-self.longest :] = later
                for e in range(scores.shape[1] - 1, -1, -1):
                    at = self.longest + e
                    behind[at - self.sizes] = np.logaddexp(behind[at - self.sizes], scores[:, e] + behind[at])
                    share = np.exp(ahead[at - self.sizes] + scores[:, e] + behind[at] - total) * count
                    use = edges[:, e] >= 0
                    np.add.at(expected, edges[use, e], share[use])
                later = behind[: self.longest]
        return total

    def weigh(self, words: list[bytes], expected: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each word's marginal probability; adds expected piece counts if asked.

        All words have one length.
        """
        n, edges = self._edges(words)
        m = len(words)
        sizes = list(edges)
        scores = {s: np.where(e >= 0, self.logp[e], -np.inf) for s, e in edges.items()}
        ahead = np.full((m, n + 1), -np.inf)
        ahead[:, 0] = 0.0
        for j in range(1, n + 1):
            into = np.stack([ahead[:, j - s] + scores[s][:, j - s] for s in sizes if s <= j])
            top = into.max(axis=0)
            ahead[:, j] = top + np.log(np.exp(into - np.where(np.isfinite(top), top, 0.0)).sum(axis=0))
        total = ahead[:, n]
        if expected is not None:
            behind = np.full((m, n + 1), -np.inf)
            behind[:, n] = 0.0
            for i in range(n - 1, -1, -1):
                out = np.stack([scores[s][:, i] + behind[:, i + s] for s in sizes if s <= n - i])
                top = out.max(axis=0)
                behind[:, i] = top + np.log(np.exp(out - np.where(np.isfinite(top), top, 0.0)).sum(axis=0))
            for s, e in edges.items():
                share = np.exp(ahead[:, : n + 1 - s] + scores[s] + behind[:, s:] - total[:, None]) * counts[:, None]
                use = e >= 0
                expected += np.bincount(e[use], share[use], minlength=len(expected))
        return total


def spelled(word: str) -> bytes:
    return b" " + word.encode("utf-8", "surrogatepass")


def _by_length(words: list[bytes]):
    """Index lists of words of one length, of bounded size."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    ends = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, ends):
        if len(group):
            most = max(1, GROUP_CELLS // max(1, int(sizes[group[0]])))
            for at in range(0, len(group), most):
                yield group[at : at + most]


def weigh_all(lattice: Lattice, words: list[bytes], expected: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
    """As Lattice.weigh for words of any lengths."""
    total = np.zeros(len(words))
    for group in _by_length(words):
        if len(words[group[0]]) > LONG_WORD:
            for i in group:
                total[i] = lattice.weigh_long(words[i], expected, 1.0 if counts is None else float(counts[i]))
        else:
            total[group] = lattice.weigh([words[i] for i in group], expected, None if counts is None else counts[group])
    return total


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one chunk after another -> (chunk, word, training count), words of all documents."""
    chunk, trained, seen = None, Counter(), set()

    def rows() -> pd.DataFrame:
        words = list(seen | trained.keys())
        out = pd.DataFrame({"word": [w.decode("utf-8", "surrogatepass") for w in words], "c": [trained[w] for w in words]}, dtype=object)
        out["c"] = out["c"].astype("int64")
        out.insert(0, "chunk", np.full(len(out), chunk, np.int64))
        return out

    for batch in batches:
        for at, held_out, text in zip(batch["chunk"], batch["held_out"], batch["text"], strict=True):
            if at != chunk:
                if chunk is not None:
                    yield rows()
                chunk, trained, seen = at, Counter(), {b""}
            words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
            if held_out:
                seen.update(words)
            else:
                trained.update(words)
                trained[b""] += 1
    if chunk is not None:
        yield rows()


def _expect(pieces: list[bytes], logp: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(pieces, logp)
        expected = np.zeros(len(pieces))
        ends = 0.0
        for batch in batches:
            is_end = batch["word"] == END
            ends += float(batch.loc[is_end, "c"].sum())
            batch = batch[~is_end]
            words = [spelled(w) for w in batch["word"]]
            if words:
                weigh_all(lattice, words, expected, batch["c"].to_numpy(float))
        used = np.flatnonzero(expected > 1e-6)
        yield pd.DataFrame({"piece": np.append(used, -1), "n": np.append(expected[used], ends)})

    return run


def _score_words(pieces: list[bytes], logp: np.ndarray, end_logp: float, n: int, discount: float, rest: float):
    """``discount``: taken off each word's count; ``rest``: the mass that segmentations into pieces share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(pieces, logp)
        for batch in batches:
            is_end = (batch["word"] == END).to_numpy()
            words = [spelled(w) for w in batch["word"]]
            got = weigh_all(lattice, words) if words else np.zeros(0)
            lm = np.where(is_end, end_logp, got)
            if n:
                own = np.maximum(0.0, batch["c"].to_numpy(float) - discount) / n
                with np.errstate(divide="ignore"):
                    lm = np.logaddexp(np.log(own), math.log(rest) + lm)
            yield batch.assign(lm=lm / math.log(10))

    return run


def fit_pieces(words: DataFrame, pieces: list[bytes], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Natural log-probabilities of pieces and of the end, from (word, c) training counts.

    Expectation maximization with ``LEAST`` added to the count of every piece, so that each text has a
    probability; pieces, ends and nothing else share the whole mass.
    """
    lengths = np.fromiter(map(len, pieces), float, len(pieces))
    logp = -1.5 * lengths - math.log(len(pieces)) / 2
    logp -= np.log(np.exp(logp).sum() * 1.01)
    end = math.log(0.01)
    trained = words.where("c > 0").select("word", "c")
    for _ in range(rounds):
        got = trained.mapInPandas(_expect(pieces, logp), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # one row per piece at most
        counts = np.full(len(pieces), LEAST)
        ends = LEAST
        for r in got:
            if r["piece"] < 0:
                ends += r["n"]
            else:
                counts[r["piece"]] += r["n"]
        total = counts.sum() + ends
        logp, end = np.log(counts / total), math.log(ends / total)
    return logp, end


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score_chunks(mass: float):
    """Rows sorted by (chunk, kind): the words of a chunk (kind 0: text is the word, id its count), then its documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, known, held, tables = None, {}, [], None
        for batch in batches:
            rows = []
            at = batch["chunk"].to_numpy()
            kind = batch["kind"].to_numpy()
            starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (kind[1:] != kind[:-1]))) if len(batch) else []
            for lo, hi in zip(starts, [*starts[1:], len(batch)], strict=True):
                part = batch.iloc[lo:hi]
                if at[lo] != chunk:
                    chunk, known, held, tables = at[lo], {}, [], None
                if kind[lo] == 0:
                    n = len(known)
                    known.update(zip((w.encode("utf-8", "surrogatepass") for w in part["text"]), range(n, n + len(part)), strict=True))
                    held.append((part["id"].to_numpy(float), part["lm"].to_numpy(float)))
                    continue
                if tables is None:
                    counts, lm = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                    tables, held = (counts > 0, np.log10((counts + 0.5) / mass), lm), []
                has, base, lm = tables
                for doc_id, held_out, text in zip(part["id"].astype("Int64"), part["held_out"], part["text"], strict=True):
                    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                    where = np.fromiter(map(known.__getitem__, [*words, b""]), np.int64, len(words) + 1)
                    rows.append((doc_id, held_out, len(where), int(has[where].sum()), float(base[where].sum()), float(lm[where].sum())))
            out = pd.DataFrame(rows, columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def score_documents(docs: DataFrame, pieces: list[bytes] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, token figures, base_score and score.

    A null doc_id counts as a training document (its remainder is null). Null or blank text is the
    end alone. Repeated rows count as often as they stand. Words of any length are scored whole. Other
    columns are not read. An empty table gives an empty result. A task holds the words of a chunk,
    and streams its documents.
    """
    pieces = pieces or default_vocabulary()
    folded = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    held = docs.select(F.col("doc_id").cast("long"), "text", folded.alias("held_out"))
    size = held.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("b")).first()
    chunks = max(1, -(-size["n"] // CHUNK_DOCS), -(-(size["b"] or 0) // (CHUNK_MB << 20)))
    keyed = held.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    placed = F.col("chunk").cast("int")
    split = keyed.repartitionById(chunks, placed).sortWithinPartitions("chunk")
    local = cut_table(split.select("chunk", "held_out", "text").mapInPandas(_count_words, "chunk long, word string, c long"))
    words = cut_table(local.groupBy("word").agg(F.sum("c").alias("c")))
    sums = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    logp, end = fit_pieces(words, pieces, rounds)
    discount = min(0.95, max(0.05, (sums["once"] or 0) / max(1, (sums["once"] or 0) + 2 * (sums["twice"] or 0))))
    weighed = words.mapInPandas(_score_words(pieces, logp, end, n, discount, discount * v / max(1, n)), "word string, c long, lm double")
    vocab = local.select("chunk", "word").join(weighed, "word")
    vocab = vocab.select("chunk", F.lit(0).alias("kind"), F.col("c").alias("id"), F.col("word").alias("text"), F.lit(False).alias("held_out"), F.col("lm").cast("float").alias("lm"))
    texts = keyed.select("chunk", F.lit(1).alias("kind"), F.col("doc_id").alias("id"), "text", "held_out", F.lit(0.0).cast("float").alias("lm"))
    rows = vocab.unionByName(texts).repartitionById(chunks, placed).sortWithinPartitions("chunk", "kind")
    return rows.mapInPandas(_score_chunks(n + 0.5 * (v + 1)), _SCORED).withColumn("train_tokens", F.lit(n).cast("long"))
