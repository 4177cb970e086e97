"""Quality rules by distribution divergence, in DataFrame operations only.

A document's histogram over character classes and its histogram over common words are compared
with references of each language by Jensen-Shannon distance. References are sums over all documents
that name the language. A document is kept when some language is near enough in both histograms;
texts below the length guards are judged by the base rules alone. All per-document work stays
inside the row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.secrets import let
from tessera.llm.text import word_array

#: fixed values: common words by language
COMMON = {
    "en": "the of and to in a is that it for was on be with as this by at are from or an".split(),
    "de": "der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es".split(),
    "fr": "de la le et les des en un une que qui est pour dans au du par sur pas avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo".split(),
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
SPACES = " \t\n\x0b\x0c\r"
CLASSES = ("space", "digit", "symbol", "exclaim", "punct", "upper", "other")

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_CHARS = 200  #: guard of the histogram of character classes, in characters of words
MIN_COMMON = 60  #: guard of the histogram of common words, in words
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.26, 0.325
JOINT_CHAR, JOINT_WORD = 0.14, 0.27  #: distances that reject a document only together


#: spellings under which a common word counts
SPELLINGS = sorted({x for w in WORDS for x in (w, w.capitalize())})


def _raw_classes(text: Column) -> Column:
    """Counts of space, digit, symbol, exclaim, punct, upper, and the length.

    Runs of lower-case letters, most of a text, go first, so the classes are counted on the rest.
    """
    rest = F.regexp_replace(text, r"\p{Ll}+", "")
    marks = (r"[\x20\x09-\x0D]", "[0-9]", r"[#*$%&|<>]", "!", r"[.,;:?'\"()-]", r"\p{Lu}")
    return let(rest, lambda r: F.array(*[F.regexp_count(r, F.lit(m)) for m in marks], F.length(text)))


def _common(words: Column) -> Column:
    """The common words of an array of words, lower-cased and sorted."""
    return F.sort_array(F.transform(F.filter(words, lambda w: w.isin(SPELLINGS)), F.lower))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array."""

    def grams(v: Column) -> Column:
        return F.when(F.size(v) < 3, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.slice(v, 3, F.greatest(F.size(v) - 2, F.lit(0))), lambda w, i: F.xxhash64(F.get(v, i), F.get(v, i + 1), w)))

    def places(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twins = lambda z: F.filter(z, lambda e, k: (e["h"] == F.get(z, k + 1)["h"]) | (e["h"] == F.get(z, k - 1)["h"]))
        return F.sort_array(F.transform(let(keyed, lambda z: F.filter(twins(z), lambda e: e.isNotNull())), lambda e: e["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), p - F.coalesce(F.get(at, k - 1), p - 3)))
        return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

    return let(let(words, grams), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places(h), covered)))


def base_measures(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the class counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counts = let(
        word_array(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"), _common(w).alias("common")),
    )
    chars = _raw_classes(text)
    return (
        docs.withColumn("_counts", counts)
        .withColumn("_chars", chars)
        .withColumn("n_words", F.col("_counts.n_words"))
        .withColumn("n_repeat_words", F.col("_counts.n_repeat_words"))
        .withColumn("word_chars", (F.length(text) - F.col("_chars")[0]).cast("long"))
        .withColumn("n_symbols", F.col("_chars")[2].cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    )


def _class_array(chars: Column) -> Column:
    """Counts by CLASSES from the raw counts, whose last is the length."""
    known = sum((chars[i] for i in range(1, 6)), chars[0])
    return F.array(*[chars[i] for i in range(6)], chars[6] - known)


def language_references(docs: DataFrame) -> dict[str, tuple[list[float], dict[str, float]]]:
    """Per language: shares of the character classes, shares of the common words among all words.

    Sums over every document of ``docs`` whose lang is one of ``COMMON``; the result has one row per
    known language and word, whatever the input's size.
    """
    known = docs.where(F.col("lang").isin(list(COMMON)) & F.col("text").isNotNull())
    rows = known.select("lang", _raw_classes(F.col("text")).alias("c"), let(word_array(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), _common(w).alias("w"))).alias("x"))
    rows = rows.select("lang", "c", F.col("x.n").alias("n"), F.col("x.w").alias("w"))
    each = rows.select("lang", F.explode(F.concat(F.array(F.struct(F.lit("").alias("w"), F.col("n").cast("long").alias("k"), _class_array(F.col("c")).alias("c"))), F.transform("w", lambda w: F.struct(w.alias("w"), F.lit(1).cast("long").alias("k"), F.expr("cast(null as array<int>)").alias("c"))))).alias("x"))
    sums = each.groupBy("lang", F.col("x.w").alias("w")).agg(F.sum("x.k").alias("k"), *[F.sum(F.get(F.col("x.c"), F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))])
    found: dict[str, tuple[list[float], dict[str, float]]] = {}
    got = sums.collect()  # languages x (common words + 1) rows at most
    for lang in sorted({r["lang"] for r in got}):
        total = next(r for r in got if r["lang"] == lang and r["w"] == "")
        n, c = max(1, total["k"]), [total[f"c{i}"] or 0 for i in range(len(CLASSES))]
        found[lang] = ([x / max(1, sum(c)) for x in c], {r["w"]: r["k"] / n for r in got if r["lang"] == lang and r["w"]})
    return found


def _kl(p: Column, q: Column) -> Column:
    """The terms of one bin in twice the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return part(p) + part(q)


def _nearest(values: list[Column]) -> Column:
    return F.array_min(F.array(*values)) if values else F.lit(0.0)


def char_distances(counts: Column, refs: dict) -> list[Column]:
    """Jensen-Shannon distance (0 to 1) to each reference."""
    total = F.greatest(F.aggregate(counts, F.lit(0), lambda a, x: a + x), F.lit(1))
    return [F.sqrt(F.greatest(F.lit(0.0), sum((_kl(counts[i] / total, F.lit(float(q))) for i, q in enumerate(shares)), F.lit(0.0)) / 2)) for shares, _ in refs.values()]


def word_distances(common: Column, n: Column, refs: dict) -> list[Column]:
    """As char_distances, over the common words and one bin for all others.

    ``common``: sorted array of a document's common words, n: all its words. Bins that the document
    lacks add half their reference share (log2 of 2), so only its own bins are visited.
    """
    total = F.greatest(n, F.lit(1))
    langs = list(refs)
    table = F.create_map(*[x for w in WORDS for x in (F.lit(w), F.array(*[F.lit(float(refs[k][1].get(w, 0.0))) for k in langs]))])

    def bins(w: Column) -> Column:
        return let(F.array_distinct(w), lambda d: F.transform(d, lambda x, i: F.struct((F.coalesce(F.array_position(w, F.get(d, i + 1)), F.size(w) + 1) - F.array_position(w, x)).alias("n"), F.element_at(table, x).alias("q"))))

    def distances(b: Column) -> Column:
        out = []
        for k, lang in enumerate(langs):
            seen = F.aggregate(b, F.lit(0.0), lambda a, x: a + _kl(x["n"] / total, x["q"][k]) - x["q"][k])
            rest = F.lit(1.0 - sum(refs[lang][1].values()))
            other = 1 - F.aggregate(b, F.lit(0.0), lambda a, x: a + x["n"] / total)
            out.append(F.sqrt(F.greatest(F.lit(0.0), (seen + F.lit(float(sum(refs[lang][1].values()))) + _kl(F.greatest(other, F.lit(0.0)), F.greatest(rest, F.lit(0.0)))) / 2)))
        return F.array(*out)

    return [let(let(common, bins), distances)]


def quality_rules(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """``docs`` with the base measures, char_distance, word_distance, base_failed and kept.

    Null text counts as empty: no words, base_failed. Without any reference (no document names a
    known language) the base rules decide alone. Every column of ``docs`` is kept but for names that
    clash with these, and ``_counts`` and ``_chars``, which are used inside. No row is dropped; repeated
    rows get equal results; an empty table gives an empty result.
    """
    refs = language_references(docs) if refs is None else refs
    measured = base_measures(docs)
    char = _nearest(char_distances(_class_array(F.col("_chars")), refs)) if refs else F.lit(0.0)
    word = F.array_min(word_distances(F.col("_counts.common"), F.col("n_words"), refs)[0]) if refs else F.lit(0.0)
    judged = (
        measured.withColumn("char_distance", F.when(F.col("word_chars") >= MIN_CHARS, char))
        .withColumn("word_distance", F.when(F.col("n_words") >= MIN_COMMON, word))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )
    near = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    both = (F.coalesce("char_distance", F.lit(0.0)) > JOINT_CHAR) & (F.coalesce("word_distance", F.lit(0.0)) > JOINT_WORD)
    return judged.withColumn("kept", ~F.col("base_failed") & near & ~both).drop("_counts", "_chars")


def js_distance(p: list[float], q: list[float]) -> float:
    """Plain Jensen-Shannon distance of two histograms, for tests."""
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))
