"""Secret scans, in DataFrame operations only.

Base kinds are found by their patterns. The method adds spans of kind ``entropy``: candidate
strings are read by a sliding window of ``WINDOW`` characters whose Shannon entropy is kept by
incremental counts: the counts of all characters of the window are carried along, each step takes
one character out and one in and corrects the sum of c*log2(c) by the counts of these two alone. A
candidate whose highest window reaches the threshold of its character class (digits, hexadecimal,
letters, all) is reported, unless an allow-list pattern covers it or a base span holds it. Letters in
one case, or in words of two and more lower-case letters, are on the allow-list: by entropy they
can't be told from long words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: fixed values: base patterns, their value groups and least lengths
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run counts from its first AKIA, so 20 in all
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so shorter ones can be left out at once
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: highest window entropy in bits from which a candidate of a character class counts
THRESHOLDS = (("digits", r"\A[0-9]+\z", 2.6), ("hex", r"\A[0-9a-fA-F]+\z", 3.0), ("letters", r"\A[A-Za-z]+\z", 3.75), ("all", r"\A[A-Za-z0-9+/_=-]+\z", 3.6))
_WORDS = r"(?:[A-Z]++|[A-Z]{0,4}[a-z]{2,}+(?:[A-Z]{1,4}[a-z]{2,}+)*+[A-Z]{0,4}|[a-z])"
#: strings that are never secrets: words and identifiers in one case or camel case, with a short number; such parts joined; UUIDs; examples
ALLOW = (
    rf"\A{_WORDS}[0-9]{{0,4}}\z",
    rf"\A[-_/=+]*(?:{_WORDS}|[0-9]{{1,8}})(?:[-_/=+](?:{_WORDS}|[0-9]{{1,8}})?)+\z",
    r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z",
    r"(?i)example|sample|placeholder|xxxx|0123456789|1234567890|9876543210|abcdefgh",
    r"\A(.)\1+\z",
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
COUNT_BITS, COUNTS_A_WORD = 5, 12  #: a count of a window is below 32; twelve of them are kept in one long
RUN = 256  #: matches whose lengths are added up one by one


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.transform(F.array(value), body)[0]


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda n, x: n + x)


def _running(lengths: Column) -> Column:
    """Running sums, by runs of ``RUN`` so that long arrays cost little more than their length."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda b: _total(F.slice(lengths, b * RUN + 1, F.lit(RUN))))
    begun = let(runs, lambda r: F.transform(r, lambda _, b: _total(F.slice(r, F.lit(1), b))))
    return let(begun, lambda at: F.transform(lengths, lambda _, i: F.get(at, F.floor(i / RUN).cast("int")) + _total(F.slice(lengths, F.floor(i / RUN).cast("int") * RUN + 1, i % RUN + 1))))


def _starts(text: Column, pattern: str, matches: Column) -> Column:
    """Code points before each match (of one at least): those of the pieces and matches to its left."""
    pieces = F.split(text, pattern, -1)

    def steps(v: Column) -> Column:
        return F.transform(F.slice(v["p"], F.lit(1), F.size(v["m"])), lambda x, i: F.length(x) + F.coalesce(F.length(F.get(v["m"], i - 1)), F.lit(0)))

    return let(let(F.struct(pieces.alias("p"), matches.alias("m")), steps), _running)


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end>> of all matches."""
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")

    def build(m: Column) -> Column:
        return F.transform(F.arrays_zip(_starts(text, pattern, m).alias("s"), m.alias("m")), lambda x: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), (x["s"] + F.length(x["m"])).alias("end")))

    return F.when(F.regexp_like(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build)).otherwise(empty)


def _assign_spans(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return F.when(
        F.regexp_like(text, F.lit(ASSIGN)),
        let(values, lambda v: F.filter(_spans(text, ASSIGN, 0), lambda _, i: F.length(F.element_at(v, i + 1)) >= ASSIGN_VALUE)),
    ).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)"))


def _term(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)))).otherwise(F.lit(0.0))


def top_window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits a character, of any window of the candidate (-1 if shorter).

    For strings of ``ALPHABET`` and windows below 32. The counts of a window are five bits each, in longs.
    """
    longs = -(-len(ALPHABET) // COUNTS_A_WORD)

    def unit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), place % COUNTS_A_WORD * COUNT_BITS)

    def scan(places: Column) -> Column:
        def count(counts: Column, place: Column) -> Column:
            held = F.get(counts, F.floor(place / COUNTS_A_WORD).cast("int"))
            return F.call_function("shiftright", held, place % COUNTS_A_WORD * COUNT_BITS).bitwiseAND(F.lit(31))

        def moved(counts: Column, place: Column, by: Column) -> Column:
            return F.transform(counts, lambda v, k: F.when(k == F.floor(place / COUNTS_A_WORD).cast("int"), v + by * unit(place)).otherwise(v))

        def step(acc: Column, i: Column) -> Column:
            out, new = F.get(places, F.greatest(i - window, F.lit(0))), F.get(places, i)
            full = F.when(i >= window, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
            gone = count(acc["counts"], out)
            left = acc["sum"] - F.when(i >= window, _term(gone) - _term(gone - 1)).otherwise(F.lit(0.0))

            def take(counts: Column) -> Column:
                here = count(counts, new)
                total = left - _term(here) + _term(here + 1)
                bits = F.when(i >= window - 1, F.log2(F.lit(float(window))) - total / window).otherwise(F.lit(-1.0))
                return F.struct(moved(counts, new, F.lit(1).cast("long")).alias("counts"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"))

            return let(moved(acc["counts"], out, -full), take)

        none = F.array(*[F.lit(0).cast("long")] * longs)
        first = F.struct(none.alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), first, step, lambda acc: acc["best"])

    return let(F.transform(F.split(candidate, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)) - 1), scan)


def _is_secret(candidate: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | F.regexp_like(candidate, F.lit(pattern))
    bar = F.lit(None).cast("double")
    for _, pattern, least in reversed(THRESHOLDS):
        bar = F.when(F.regexp_like(candidate, F.lit(pattern)), F.lit(least).cast("double")).otherwise(bar)
    return F.when(allowed, F.lit(False)).otherwise(F.coalesce(top_window_entropy(candidate) >= bar, F.lit(False)))


def _entropy_spans(text: Column, base: Column) -> Column:
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")

    def build(m: Column) -> Column:
        zipped = F.arrays_zip(_starts(text, CANDIDATE, m).alias("s"), m.alias("m"))
        held = lambda x: F.exists(base, lambda b: (b["start"] <= x["s"]) & (b["end"] >= x["s"] + F.length(x["m"])))
        found = F.filter(zipped, lambda x: ~held(x) & _is_secret(x["m"]))
        return F.transform(found, lambda x: F.struct(x["s"].alias("start"), F.lit(3).alias("kind"), (x["s"] + F.length(x["m"])).alias("end")))

    return F.when(F.regexp_like(text, F.lit(CANDIDATE)), let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), build)).otherwise(empty)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_found`` and ``found``: arrays of (start, kind, end), sorted, code points, end exclusive.

    kind numbers ``KINDS``. Null text has no spans. All columns of ``docs`` are kept; the two names
    are overwritten where they clash. No row is dropped and none is compared with another.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(_assign_spans(text), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    both = docs.withColumn("base_found", base)
    return both.withColumn("found", F.array_sort(F.concat("base_found", _entropy_spans(text, F.col("base_found")))))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``found`` replaced by ``mask``; overlapping spans give one mask."""

    def cover(found: Column) -> Column:
        ends = F.transform(found, lambda s, i: F.array_max(F.transform(F.slice(found, 1, i + 1), lambda x: x["end"])))
        firsts = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (F.element_at(found, i + 1)["start"] >= F.get(ends, i - 1)))
        return let(F.struct(firsts.alias("f"), ends.alias("e")), lambda v: F.transform(v["f"], lambda i, k: F.struct(F.element_at(found, i + 1)["start"].alias("start"), F.element_at(v["e"], F.coalesce(F.get(v["f"], k + 1), F.size(found))).alias("end"))))

    def masked(runs: Column) -> Column:
        text = F.col("text")
        parts = F.transform(runs, lambda r, k: F.concat(F.substring(text, F.coalesce(F.get(runs, k - 1)["end"], F.lit(0)) + 1, r["start"] - F.coalesce(F.get(runs, k - 1)["end"], F.lit(0))), F.lit(mask)))
        last = F.element_at(runs, -1)["end"]
        return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))

    return docs.withColumn("text", F.when(F.size("found") > 0, let(let(F.col("found"), cover), masked)).otherwise(F.col("text")))
