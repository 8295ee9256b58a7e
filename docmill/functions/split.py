"""Splitting of long texts: a sliding window of characters, and packing of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lstrip, strip


def check_window(most: int, overlap: int) -> None:
    if not 0 <= overlap < most:
        raise ValueError(f"overlap must be at least 0 and under the size: {overlap}, {most}")


def sliding_window(text: Column, most: int = 2000, overlap: int = 200) -> Column:
    """Pieces of ``most`` characters, each beginning ``most - overlap`` after the one before; a short text is one piece."""
    check_window(most, overlap)
    cut = F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(most - overlap)), lambda i: F.substring(text, i + 1, F.lit(most)))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(cut)


def pack_paragraphs(text: Column, most: int = 1500, overlap: int = 100) -> Column:
    """Paragraphs packed to chunks of up to ``most`` characters, each beginning with the last ``overlap`` of the one before.

    A paragraph is never cut, so a chunk may be longer. A text up to ``most`` is one chunk as it is.
    """
    if overlap < 0:
        raise ValueError(f"overlap must not be negative: {overlap}")
    paragraphs = F.filter(F.transform(F.split(text, "\n{2,}"), strip), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def add(acc: Column, p: Column) -> Column:
        cur = acc["cur"]
        full = (cur != "") & (F.length(cur) + 2 + F.length(p) > most)
        tail = lstrip(F.when(F.length(cur) > overlap, F.substring(cur, -overlap, overlap)).otherwise(cur)) if overlap else F.lit("")
        begun = F.when(tail != "", F.concat(tail, F.lit("\n\n"), p)).otherwise(p)
        longer = F.when(cur != "", F.concat(cur, F.lit("\n\n"), p)).otherwise(p)
        return F.struct(F.when(full, F.concat(acc["out"], F.array(strip(cur)))).otherwise(acc["out"]).alias("out"), F.when(full, begun).otherwise(longer).alias("cur"))

    def end(acc: Column) -> Column:
        out = F.when(strip(acc["cur"]) != "", F.concat(acc["out"], F.array(strip(acc["cur"])))).otherwise(acc["out"])
        return F.when(F.size(out) > 0, out).otherwise(F.array(text))

    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.aggregate(paragraphs, zero, add, end))
