"""Language identification of code-switched text by a linear-chain conditional random field.

Words are the positions of the chain. A word's features are its affixes (first and last 1, 2 and 4
characters), its character bigrams and trigrams and itself as a lexicon entry (all hashed, of words
of any length); transitions between the languages of neighbouring words are learned. Training
maximizes the conditional likelihood by stochastic gradients of the forward-backward algorithm; since
rated texts are in one language each, stretches of several are joined into code-switched chains.
Prediction runs forward-backward over every word of a text.

The model is fitted on a sample: of the ``MOST_LANGS`` most frequent languages at most ``TRAIN_ROWS``
distinct texts in all, as many of each language, by the hash of the text; of each text a stretch of
``TRAIN_CHARS`` characters at a place of the whole text that its hash chooses. Predictions cover
whole texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.near_dups import mix
from tessera.llm.text import words_of

FOLDS, HELD_OUT = 4, 2
BITS = 16
TRAIN_ROWS, TRAIN_CHARS, MOST_LANGS = 2000, 400, 256
STRETCH, CHAIN = 20, 60
EPOCHS, RATE, DECAY, BATCH = 4, 0.15, 1e-5, 32
UNKNOWN = "und"
BATCH_CELLS = 600_000  #: words (with padding) of one forward-backward batch
WINDOW = 1 << 18  #: characters whose features are hashed at a time
_MASK = (1 << BITS) - 1
_U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_STRIP = ".,;:!?'\"()[]{}|#*$%&<>-_/\\0123456789"


def core_of(word: bytes) -> str:
    """The word in lower case between its outer marks; empty without a letter."""
    text = word.decode("utf-8", "replace").lower().strip(_STRIP)
    return text if text.isalpha() or any(map(str.isalpha, text)) else ""


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mix(hashes + _U(kind + 1)) & _U(_MASK)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + _U(1)


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs and triples of neighbouring codes."""
    two = codes[:-1] * _U(_P) + codes[1:]
    return two, two[:-1] * _U(_Q) + codes[2:]


def features_of(cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all features of short words, each as often as it occurs."""
    codes = _codes("".join(f"^{c}$" for c in cores))
    sizes = np.fromiter((len(c) + 2 for c in cores), np.int64, len(cores))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(cores)), sizes)
    place = np.arange(len(codes)) - starts[owner]
    behind = ends[owner] - 1 - np.arange(len(codes))
    two, three = _grams(codes)
    in_two = np.flatnonzero((place[:-1] >= 1) & (behind[:-1] >= 2))
    in_three = np.flatnonzero(behind[:-2] >= 2)
    powers = np.cumprod(np.append(_U(1), np.full(int(sizes.max()), _P, np.uint64)))
    words = [np.arange(len(cores))] * 7
    found = [_bucket(np.add.reduceat(codes * powers[place], starts), 2)]
    for k, n in enumerate((1, 2, 4)):
        found.append(_bucket(np.add.reduceat(np.where((place >= 1) & (place <= n) & (behind >= 1), codes * powers[place], _U(0)), starts), 3 + k))
        found.append(_bucket(np.add.reduceat(np.where((behind >= 1) & (behind <= n) & (place >= 1), codes * powers[behind], _U(0)), starts), 6 + k))
    return np.concatenate([owner[in_two], owner[in_three], *words]), np.concatenate([_bucket(two[in_two], 0), _bucket(three[in_three], 1), *found])


def long_features(core: str) -> np.ndarray:
    """Buckets of one word of any length, ``WINDOW`` characters at a time, as counts by bucket."""
    counts = np.zeros(1 << BITS)
    whole, power = 0, 1
    padded = f"^{core}$"
    for at in range(0, len(padded), WINDOW):
        codes = _codes(padded[max(0, at - 2) : at + WINDOW])
        two, three = _grams(codes) if len(codes) > 1 else (codes[:0], codes[:0])
        new = 2 if at else 0  # the first codes are the last of the window before
        inner = two[max(0, new - 1) :]
        if at == 0:
            inner = inner[1:]
        if at + WINDOW >= len(padded):
            inner = inner[:-1]
        counts += np.bincount(_bucket(inner, 0), minlength=1 << BITS) + np.bincount(_bucket(three, 1), minlength=1 << BITS)
        own = codes[new:]
        powers = np.cumprod(np.append(_U(1), np.full(len(own) - 1, _P, np.uint64)))
        whole = (whole + power * int((own * powers).sum(dtype=np.uint64))) & 0xFFFFFFFFFFFFFFFF
        power = power * pow(_P, len(own), 1 << 64) & 0xFFFFFFFFFFFFFFFF
    counts[_bucket(np.array([whole], np.uint64), 2)] += 1
    for k, n in enumerate((1, 2, 4)):
        for kind, codes in ((3 + k, _codes(core[:n])), (6 + k, _codes(core[-n:])[::-1])):
            total = sum(int(c) * pow(_P, i + 1, 1 << 64) for i, c in enumerate(codes)) & 0xFFFFFFFFFFFFFFFF
            counts[_bucket(np.array([total], np.uint64), kind)] += 1
    return counts


def emissions(cores: list[str], emit: np.ndarray) -> np.ndarray:
    """(word, language) sums of the weights of the words' features."""
    out = np.zeros((len(cores), emit.shape[1]))
    at = 0
    while at < len(cores):
        end, size = at, 0
        while end < len(cores) and size + len(cores[end]) <= WINDOW:
            size += len(cores[end]) + 2
            end += 1
        if end == at:
            out[at] = long_features(cores[at]) @ emit
            end += 1
        else:
            owner, bucket = features_of(cores[at:end])
            for k in range(emit.shape[1]):
                out[at:end, k] = np.bincount(owner, emit[bucket, k], minlength=end - at)
        at = end
    return out


@dataclass
class ChainModel:
    langs: list[str]
    emit: np.ndarray  #: feature bucket x language
    trans: np.ndarray  #: language x language


def forward_backward(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chain, word, language) and pair sums (chain, from, to) of a padded batch of chains."""
    b, n, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(trans)
    live = np.arange(n)[None, :] < lengths[:, None]
    e[~live] = 1.0
    ahead, behind = np.empty_like(e), np.empty_like(e)
    at = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    ahead[:, 0] = at
    for t in range(1, n):
        new = (at @ a) * e[:, t]
        new /= new.sum(axis=1, keepdims=True)
        at = np.where(live[:, t, None], new, at)
        ahead[:, t] = at
    back = np.full((b, k), 1.0 / k)
    behind[:, n - 1] = back
    for t in range(n - 2, -1, -1):
        new = (e[:, t + 1] * back) @ a.T
        new /= new.sum(axis=1, keepdims=True)
        back = np.where(live[:, t + 1, None], new, back)
        behind[:, t] = back
    marginal = ahead * behind
    marginal /= marginal.sum(axis=2, keepdims=True)
    pairs = np.zeros((b, k, k))
    if n > 1:
        joint = ahead[:, :-1, :, None] * a[None, None] * (e[:, 1:] * behind[:, 1:])[:, :, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        pairs = (joint * live[:, 1:, None, None]).sum(axis=1)
    return marginal * live[:, :, None], pairs


def fit_chain(texts: list[str], labels: list[str], epochs: int = EPOCHS) -> ChainModel:
    langs = sorted(set(labels))
    k = len(langs)
    emit, trans = np.zeros((1 << BITS, max(1, k))), np.zeros((max(1, k), max(1, k)))
    if not texts or k < 2:
        return ChainModel(langs or [UNKNOWN], emit, trans)
    number = {x: i for i, x in enumerate(langs)}
    pieces: list[tuple[int, list[np.ndarray]]] = []
    for text, lang in zip(texts, labels, strict=True):
        cores = [c for c in map(core_of, words_of(text)) if c]
        if cores:
            owner, bucket = features_of(cores)
            order = np.argsort(owner, kind="stable")
            feats = np.split(bucket[order], np.flatnonzero(np.diff(owner[order])) + 1)
            pieces += [(number[lang], feats[i : i + STRETCH]) for i in range(0, len(feats), STRETCH)]
    rng = np.random.default_rng(7)
    g_emit, g_trans = np.full_like(emit, 1e-8), np.full_like(trans, 1e-8)
    share = np.bincount([y for y, _ in pieces], minlength=k) / max(1, len(pieces))
    weight = np.minimum(5.0, 1 / (k * np.maximum(share, 1e-9))) ** 0.5
    per_chain = CHAIN // STRETCH
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        chains = [[pieces[i] for i in order[j : j + per_chain]] for j in range(0, len(order), per_chain)]
        for j in range(0, len(chains), BATCH):
            batch = chains[j : j + BATCH]
            feats = [[f for _, fs in c for f in fs] for c in batch]
            gold = [np.concatenate([np.full(len(fs), y) for y, fs in c]) for c in batch]
            lengths = np.fromiter(map(len, feats), np.int64, len(feats))
            if not lengths.max(initial=0):
                continue
            n = lengths.max()
            flat = np.concatenate([f for fs in feats for f in fs])
            sizes = np.fromiter((len(f) for fs in feats for f in fs), np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            place = np.concatenate([b * n + np.arange(m) for b, m in enumerate(lengths)])
            each = np.zeros((len(sizes), k))
            np.add.at(each, owner, emit[flat])
            scores = np.zeros((len(batch) * n, k))
            scores[place] = each
            marginal, pairs = forward_backward(scores.reshape(len(batch), n, k), lengths, trans)
            y = np.concatenate(gold)
            diff = marginal.reshape(-1, k)[place]
            diff[np.arange(len(y)), y] -= 1
            diff *= weight[y][:, None] / len(y)
            grad = np.zeros_like(trans)
            for b, g in enumerate(gold):
                np.add.at(grad, (g[:-1], g[1:]), -1.0)
                grad += pairs[b]
            grad = grad / len(y) + DECAY * trans
            used, back = np.unique(flat, return_inverse=True)
            ge = np.zeros((len(used), k))
            np.add.at(ge, back, diff[owner])
            ge += DECAY * emit[used]
            g_emit[used] += ge * ge
            emit[used] -= RATE * ge / np.sqrt(g_emit[used])
            g_trans += grad * grad
            trans -= RATE * grad / np.sqrt(g_trans)
    return ChainModel(langs, emit, trans)


def train_chain(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> ChainModel:
    """Model from (text, lang) rows; rows with a null lang or text are not used."""
    rated = docs.where("lang is not null and text is not null")
    h = F.xxhash64("text")
    counts = rated.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(h).alias("texts")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    if not counts:
        return fit_chain([], [])
    each = max(1, train_rows // len(counts))
    # of each language a hash slice somewhat larger than needed first, so that no task holds more rows than its share
    rates = F.from_json(F.lit(json.dumps({r["lang"]: int(min(1_000_000, 1_300_000 * each / max(1, r["texts"]) + 2000)) for r in counts})), "map<string,long>")
    start = F.pmod(F.xxhash64(h), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1)))
    part = F.substring(F.col("text"), (start + 1).cast("int"), F.lit(TRAIN_CHARS))
    # words that the stretch cuts go, unless one fills it
    left = F.when(start > 0, F.regexp_replace(part, r"\A[^\x20\x09-\x0D]+[\x20\x09-\x0D]", "")).otherwise(part)
    inner = F.when(start + TRAIN_CHARS < F.length("text"), F.regexp_replace(left, r"[\x20\x09-\x0D][^\x20\x09-\x0D]+\z", "")).otherwise(left)
    sliced = rated.where(F.pmod(h, F.lit(1_000_000)) < F.element_at(rates, F.col("lang"))).groupBy(h.alias("h"), "lang").agg(F.min(inner).alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    got = sliced.withColumn("place", place).where(F.col("place") <= each).orderBy("h", "lang").select("text", "lang").collect()  # at most train_rows rows
    return fit_chain([r["text"] for r in got], [r["lang"] for r in got])


class WordScores:
    """Emission scores of words as rows of a growing matrix; row 0 stands for a word without letters."""

    def __init__(self, model: ChainModel, most: int = 700_000):
        self.model, self.most = model, most
        self.reset()

    def reset(self) -> None:
        self.table = np.zeros((1024, len(self.model.langs)), np.float32)
        self.used = 1
        self.cores: dict[str, int] = {"": 0}
        self.rows: dict[bytes, int] = {}

    def learn(self, words: set[bytes]) -> None:
        """Make all of these words known."""
        new = [w for w in words if w not in self.rows]
        cores = [core_of(w) for w in new]
        fresh = list(dict.fromkeys(c for c in cores if c not in self.cores))
        need = self.used + len(fresh)
        if need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), self.table.shape[1]), np.float32)])
        if fresh:
            self.table[self.used : need] = emissions(fresh, self.model.emit)
            self.cores.update(zip(fresh, range(self.used, need), strict=True))
            self.used = need
        self.rows.update(zip(new, map(self.cores.__getitem__, cores), strict=True))

    def scores(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """(word, language) of the words with a letter, by text."""
        if len(self.rows) > self.most:
            self.reset()
        self.learn({w for words in texts for w in words})
        found = []
        for words in texts:
            at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            found.append(self.table[at[at > 0]])
        return found


def _groups(texts: list[str | None], most: int = 1 << 20):
    """(number of the first, words of each) of runs of texts of about ``most`` characters."""
    group, size, first = [], 0, 0
    for i, text in enumerate(texts):
        group.append(words_of(text))
        size += len(text or "")
        if size >= most:
            yield first, group
            group, size, first = [], 0, i + 1
    if group:
        yield first, group


def label_words(model: ChainModel, texts: list[str | None], keep: bool = True) -> list[np.ndarray | None]:
    """Marginals (word, language) of every word with a letter, by text; None for a text without.

    Without ``keep`` one row per text, the mean.
    """
    if label_words.scores is None or label_words.scores.model is not model:
        label_words.scores = WordScores(model)
    found: list[np.ndarray | None] = [None] * len(texts)
    rows = []
    for first, group in _groups(texts):
        for i, scores in enumerate(label_words.scores.scores(group), first):
            if len(scores):
                rows.append((i, scores))
    rows.sort(key=lambda r: len(r[1]))
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and (end + 1 - at) * len(rows[end][1]) <= BATCH_CELLS and len(rows[end][1]) <= 1.2 * len(rows[at][1]) + 40:
            end += 1
        batch = rows[at:end]
        lengths = np.fromiter((len(s) for _, s in batch), np.int64, len(batch))
        padded = np.zeros((len(batch), lengths.max(), len(model.langs)), np.float32)
        for b, (_, s) in enumerate(batch):
            padded[b, : len(s)] = s
        marginal, _ = marginals(padded, lengths, model.trans)
        for b, (i, s) in enumerate(batch):
            found[i] = marginal[b, : len(s)].copy() if keep else marginal[b, : len(s)].mean(axis=0, dtype=float)[None]
        at = end
    return found


label_words.scores = None


def marginals(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, None]:
    """forward_backward without the pair sums."""
    b, n, k = scores.shape
    e = np.ascontiguousarray(np.exp(scores - scores.max(axis=2, keepdims=True)).transpose(1, 0, 2))
    a = np.exp(trans - trans.max())
    last = lengths - 1
    ahead = np.empty_like(e)
    at = e[0]
    for t in range(n):
        at = e[t] if t == 0 else (at @ a) * e[t]
        at = at / at.sum(axis=1, keepdims=True)
        ahead[t] = at
    back = np.ones((b, k))
    for t in range(n - 1, -1, -1):
        back[last <= t] = 1.0
        ahead[t] *= back
        back = (e[t] * back) @ a.T
        back /= back.sum(axis=1, keepdims=True)
    ahead /= ahead.sum(axis=2, keepdims=True)
    return ahead.transpose(1, 0, 2), None


def _predict(model: ChainModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                for text, m in zip(part["text"], label_words(model, list(part["text"]), keep=False), strict=True):
                    if m is None:
                        letters = bool(text) and any(c.isalpha() for c in text)
                        rows.append((model.langs[0] if letters else UNKNOWN, 0.0))
                    else:
                        mean = m.mean(axis=0)
                        best = int(mean.argmax())
                        rows.append((model.langs[best], float(min(1.0, max(0.0, mean[best])))))
            out = pd.DataFrame(rows, columns=["lang_pred", "score"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            out.insert(1, "held_out", batch["held_out"].astype("boolean").to_numpy())
            yield out

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def identify_languages(docs: DataFrame, model: ChainModel | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Fitted on rows that aren't held out, by text and lang alone, unless a model is given. lang_pred
    is the language of the highest mean word probability, score that mean; null text or text
    without a letter gives ``und`` and 0, letters inside no word feature the first language and 0.
    A null doc_id is not held out. Without a rated row every text is ``und``. Repeated rows get equal
    results; an empty table gives an empty result.
    """
    marked = docs.select(F.col("doc_id").cast("long"), "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = model or train_chain(marked.where(~F.col("held_out")))
    return marked.select("doc_id", "held_out", "text").mapInPandas(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
