"""String rules of the cleaners, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.constants import NULL_WORDS


def _rx(col: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(col, pattern, to)


def nullif_blank(col: Column) -> Column:
    return F.when(col != "", col)


def normalize_text(col: Column) -> Column:
    """Trim, collapse any Unicode white space, null words to null."""
    flat = F.trim(_rx(col.cast("string"), r"(?U)\s+", " "))
    return F.when(~F.upper(flat).isin(*NULL_WORDS), flat)


def normalize_frame(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in skip else normalize_text(F.col(c)).alias(c) for c in df.columns])


def prefixed_id(col: Column, prefix: str) -> Column:
    """Upper-case letters and digits, one leading prefix taken off and put back; nothing left is null."""
    body = _rx(F.upper(_rx(col, "[^A-Za-z0-9]")), f"^{prefix}")
    return F.when(body != "", F.concat(F.lit(prefix), body))


def canonical_token(col: Column) -> Column:
    return nullif_blank(_rx(_rx(F.upper(F.trim(col)), "[^A-Za-z0-9]+", "_"), "^_+|_+$"))


def money(col: Column) -> Column:
    """Number in a money text without currency words and separators, null if there is none."""
    bare = _rx(_rx(_rx(col, r"(?i)INR|RS\.?"), ","), "[^0-9.\\-]")
    return F.when(bare.rlike(r"\A-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"), bare.try_cast("double"))


def mcc(col: Column, any_case: bool) -> Column:
    text = F.upper(col) if any_case else col
    for part in ("MCC", "-", " ", ".0"):
        text = F.replace(text, F.lit(part), F.lit(""))
    return text


def matches(col: Column, pattern: str) -> Column:
    """Whole-string match, null as false."""
    return F.coalesce(col.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def four_digits(col: Column) -> Column:
    return matches(col, r"\p{Nd}{4}")


def pan(col: Column) -> Column:
    return F.upper(F.translate(col, " -", ""))


def pan_valid(col: Column) -> Column:
    return matches(col, "[A-Z]{5}[0-9]{4}[A-Z]")


def aadhaar(col: Column) -> Column:
    return _rx(col, r"[^\p{Nd}]")


def aadhaar_valid(col: Column) -> Column:
    return matches(col, r"\p{Nd}{12}")


def account(col: Column) -> Column:
    return _rx(F.upper(col), r"[^\p{L}\p{N}]")


def account_valid(col: Column) -> Column:
    return matches(col, "[A-Z0-9]{9,18}")


def truthy(col: Column) -> Column:
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def node_type(col: Column) -> Column:
    return F.when(col.startswith("USR"), "USER").when(col.startswith("MCH"), "MERCHANT").otherwise("UNKNOWN")


def human_number(col: Column) -> Column:
    """1.2K and 3.4M forms; a dash for null."""
    size = F.abs(col)
    return (
        F.when(col.isNull(), F.lit("—"))
        .when(size >= 1_000_000, F.concat(F.format_number(col / 1_000_000, 1), F.lit("M")))
        .when(size >= 1_000, F.concat(F.format_number(col / 1_000, 1), F.lit("K")))
        .otherwise(F.format_number(col, 0))
    )


def inr(col: Column) -> Column:
    return F.when(col.isNull(), F.lit("—")).otherwise(F.concat(F.lit("₹"), F.format_number(col, 2)))


def allow(df: DataFrame, preferred: list[str]) -> DataFrame:
    """The preferred columns that exist."""
    return df.select(*[c for c in preferred if c in df.columns])
