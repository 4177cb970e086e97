"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is the set of its distinct words; each word stands for hashed features (itself, its leading
and its last characters), each document for one more on how far its words repeat. One shared weight
vector w and ordered thresholds t give P(grade <= k) = sigmoid(t[k] - w.x); the gaps between
thresholds are exponentials, so their order holds throughout the fit. Selection uses the expected
grade and tail probabilities P(grade >= k).

The model is fitted on at most ``TRAIN_ROWS`` rated rows (by hash of text, so the choice doesn't
depend on partitions); everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.llm.text import WordMap

BITS = 19
TRAIN_ROWS = 3000
LEADS, TAIL = (3, 4, 5, 6, 7), 3
MIN_DOCS = 3  #: rated rows that a feature must stand in
LEAST_DRIFT = 4.0  #: standard errors by which the grade of a feature's rows must differ
STEPS, RATE, DECAY = 200, 0.02, 1e-4
REPEAT_STEPS = 10
SHORT_CAPITALS = 3  #: letters up to which capitals are no shouting
_MASK = (1 << BITS) - 1


def _bucket(kind: bytes, value: bytes) -> int:
    return xxhash.xxh3_64_intdigest(kind + value) & _MASK


def word_features(word: bytes) -> list[int]:
    text = word.decode("utf-8", "replace").lower()
    found = {_bucket(b"w", text.encode())}
    found.update(_bucket(b"p%d" % n, text[:n].encode()) for n in LEADS if len(text) > n)
    if len(text) > TAIL:
        found.add(_bucket(b"s", text[-TAIL:].encode()))
    return sorted(found)


def document_features(n_words: int, distinct: set[bytes], shouts: bool) -> list[int]:
    """Buckets for how far words repeat (``distinct`` lower-cased) and whether a word is in capitals."""
    share = int(REPEAT_STEPS * len(distinct) / n_words) if n_words else 0
    return [_bucket(b"r", b"%d" % share), _bucket(b"u", b"%d" % shouts)]


def _split(text: str | None) -> tuple[int, set[bytes], bool]:
    """Number of words, the distinct ones with A-Z lowered, and whether one of two and more letters is in capitals."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    raw = set(words)
    return len(words), {w.lower() for w in raw}, any(len(w) > SHORT_CAPITALS and w.isupper() for w in raw)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    of_word = WordMap(word_features)
    for batch in batches:
        ids, ns = [], []
        for text in batch["text"]:
            n_words, distinct, shouts = _split(text)
            all_ids = [i for w in distinct for i in of_word[w]] + document_features(n_words, distinct, shouts)
            of_word.trim()
            got, n = np.unique(np.asarray(all_ids, np.int32), return_counts=True)
            ids.append(got)
            ns.append(n.astype(np.float32))
        yield pd.DataFrame({"grade": batch["grade"].astype("int32"), "ids": ids, "ns": ns})


@dataclass
class OrdinalModel:
    weights: np.ndarray  #: by feature bucket
    thresholds: np.ndarray  #: ordered, one fewer than grades

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. by column."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(latent)[:, None] - self.thresholds[None, :], -40, 40)))


def loss_and_gradient(w: np.ndarray, t: np.ndarray, cols: np.ndarray, vals: np.ndarray, rows: np.ndarray, grades: np.ndarray, balance: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood with weight decay, and its gradients by the weights and by t (first threshold, logs of the gaps)."""
    n, n_grades = max(1, len(grades)), len(t) + 1
    theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
    z = np.bincount(rows, vals * w[cols], minlength=len(grades))
    up = np.concatenate([theta, [np.inf]])[grades] - z
    lo = np.concatenate([[-np.inf], theta])[grades] - z
    cu, cl = 1 / (1 + np.exp(-np.clip(up, -30, 30))), 1 / (1 + np.exp(-np.clip(lo, -30, 30)))
    cu, cl = np.where(np.isposinf(up), 1.0, cu), np.where(np.isneginf(lo), 0.0, cl)
    p = np.maximum(1e-9, cu - cl)
    du, dl = cu * (1 - cu) / p, cl * (1 - cl) / p
    gz = balance * (du - dl) / n  # of the negative log likelihood by z
    gtheta = np.bincount(grades, -du * balance, minlength=n_grades)[:-1] / n + np.bincount(grades, dl * balance, minlength=n_grades)[1:] / n
    later = np.cumsum(gtheta[::-1])[::-1]
    gt = np.concatenate([later[:1], later[1:] * np.exp(t[1:])])
    gw = np.bincount(cols, vals * gz[rows], minlength=len(w)) + DECAY * w
    return float(-(balance * np.log(p)).sum() / n + DECAY / 2 * (w * w).sum()), gw, gt


def fit_ordinal(ids: list[np.ndarray], ns: list[np.ndarray], grades: np.ndarray, n_grades: int) -> OrdinalModel:
    """Maximum likelihood with weight decay, by Adam over the whole (bounded) sample."""
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    cols = np.concatenate(ids) if len(ids) else np.zeros(0, np.int32)
    vals = np.concatenate(ns) if len(ns) else np.zeros(0, np.float32)
    rows = np.repeat(np.arange(len(ids), dtype=np.int32), lens)
    df = np.bincount(cols, minlength=1 << BITS)
    # features whose rows' mean grade stands clearly off the whole: the rest would only add noise to long texts
    mean, spread = (grades.mean(), max(1e-6, grades.std())) if len(grades) else (0.0, 1.0)
    drift = np.bincount(cols, (grades - mean)[rows], minlength=1 << BITS) / (spread * np.sqrt(np.maximum(1, df)))
    use = (df[cols] >= MIN_DOCS) & (np.abs(drift[cols]) >= LEAST_DRIFT)
    cols, vals, rows = cols[use], vals[use], rows[use]
    kept, cols = np.unique(cols, return_inverse=True)
    w = np.zeros(len(kept))
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / max(1, len(grades)), 0.01, 0.99)
    first = np.log(share / (1 - share))
    t = np.concatenate([first[:1], np.log(np.maximum(1e-3, np.diff(first)))])
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    n = max(1, len(ids))
    counts = np.bincount(grades, minlength=n_grades)
    balance = (n / (n_grades * np.maximum(1, counts)))[grades] ** 0.5
    for step in range(1, STEPS + 1):
        _, gw, gt = loss_and_gradient(w, t, cols, vals, rows, grades, balance)
        for k, (x, g) in enumerate(((w, gw), (t, gt))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            x -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w
    return OrdinalModel(weights, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])))


def train_ordinal(rated: DataFrame, n_grades: int, train_rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Model from (text, grade) rows; rows with a null grade or text are not used."""
    known = rated.where("grade is not null and text is not null").select("text", F.col("grade").cast("int"))
    n = known.count()
    # a hash slice somewhat larger than needed first, so that no task holds more rows than its share
    slice_ = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(min(1_000_000, 1_300_000 * train_rows / max(1, n) + 2000))
    sample = known.where(slice_).orderBy(F.xxhash64("text"), "text", "grade").limit(train_rows)
    got = sample.repartition(12).mapInPandas(_features, "grade int, ids array<int>, ns array<float>").toPandas()  # at most train_rows rows
    got = got.sort_values("grade", kind="stable") if len(got) else got
    return fit_ordinal(list(got["ids"]), list(got["ns"]), got["grade"].to_numpy(np.int64), n_grades)


def _grade(weights: np.ndarray, thresholds: np.ndarray):
    model = OrdinalModel(weights, thresholds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_word = WordMap(lambda w: float(weights[word_features(w)].sum()))
        for batch in batches:
            latent = np.zeros(len(batch))
            for i, text in enumerate(batch["text"]):
                n_words, distinct, shouts = _split(text)
                # sorted, so that the sum doesn't depend on the order of a set
                latent[i] = np.sort(np.fromiter(map(of_word.__getitem__, distinct), float, len(distinct))).sum() + weights[document_features(n_words, distinct, shouts)].sum()
                of_word.trim()
            tails = model.tails(latent)
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "latent": latent, "expected_grade": tails.sum(axis=1)})
            out["tails"] = list(tails)
            yield out

    return run


def grade_documents(docs: DataFrame, model: OrdinalModel, bar: float = 0.3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): latent, expected_grade, tails (P(grade >= k)), kept.

    kept: the probability of the highest grade is at least ``bar``. Null or blank text is graded by
    the thresholds and the features of an empty document. Repeated rows get equal grades; other
    columns are not read; an empty table gives an empty result.
    """
    graded = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_grade(model.weights, model.thresholds), "doc_id long, latent double, expected_grade double, tails array<double>")
    return graded.withColumn("kept", F.element_at("tails", -1) >= bar)
