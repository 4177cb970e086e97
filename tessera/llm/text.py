"""Shared pieces of the text operators: word rule, bounded word caches, Spark expressions."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, functions as F

#: Words of every operator: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 with A-Z lowered; bytes.split() and bytes.lower() follow exactly the ASCII rules."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordMap(dict):
    """word -> make(word), remembered; trim() between documents keeps it bounded."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        value = self[word] = self.make(word)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def hash64() -> WordMap:
    return WordMap(xxhash.xxh3_64_intdigest, most=100_000)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_array(text: Column) -> Column:
    """Words as an array<string>; empty for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
