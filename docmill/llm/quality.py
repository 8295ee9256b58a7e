"""Quality rules, with cross-document line frequency by host.

Rules of one text (words, symbols, repeated lines and windows) come with a hash of
each normalised line. A line in many documents of a host is removed, each distinct
text counted once (copies of whole documents are near dedup's task); a document with
too few words left is rejected.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, boxed, map_texts, row_key, table, unboxed
from .lines import without_lines

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
#: A line in more distinct documents of one host is over the limit.
MAX_LINE_DOCS = 100

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in runs of ``window`` words that the text has twice or more; ``window`` is a power of two."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ranks = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == n:
        return 0
    width = 1
    while True:
        pairs = ranks[:-width] * np.int64(n + 1) + ranks[width:]
        _, ranks, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        width *= 2
        if len(counts) == len(ranks):
            return 0
        if width == window:
            break
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(counts[ranks] > 1)
    edge[starts] += 1
    np.subtract.at(edge, starts + window, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[list[int], list[int], list[int]]:
    """The counts of ``BASE`` but the last, and of each distinct non-blank line: hash, words in all its occurrences."""
    words = text.split()
    seen: set[bytes] = set()
    dup = 0
    sizes: dict[int, int] = {}
    for line in text.split(b"\n"):
        own = line.translate(LOWER).split()
        if not own:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        h = xxhash.xxh64_intdigest(b" ".join(own), 42)
        sizes[h] = sizes.get(h, 0) + len(own)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    base = [len(words), len(text.translate(None, _NOT_COUNTED)), symbols, dup, repeat_words(words)]
    return base, list(sizes), list(sizes.values())


def features(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each row: ``__row, __id, __th, host``, the columns of ``BASE`` and arrays ``h, w`` of distinct lines."""

    def start():
        def work(texts):
            rows = [measure(t or b"") for t in texts]
            names = [x.split()[0] for x in BASE.split(", ")][:5]
            out = {n: [r[0][i] for r in rows] for i, n in enumerate(names)}
            out["base_failed"] = [r[0][0] < MIN_WORDS or 100 * r[0][4] > REPEAT_PERCENT * r[0][0] for r in rows]
            out["h"], out["w"] = ([np.array(r[i], np.uint64).view(np.int64) for r in rows] for i in (1, 2))
            return out

        return work

    ident, th = row_key(text, doc_id)
    keys = {"__row": F.monotonically_increasing_id(), "__id": ident, "__th": th, "host": F.col(host)}
    return map_texts(docs, keys, text, start, BASE + ", h array<bigint>, w array<bigint>")


def frequent_lines(lines: DataFrame, most: int = MAX_LINE_DOCS) -> DataFrame:
    """``(host, h)`` over the limit, of ``(host, h, th)`` with one row for each document and line."""
    some = lines.groupBy("host", "h").agg(F.count("*").alias("n"), F.min("th").alias("t0"), F.max("th").alias("t1")).where((F.col("n") > most) & (F.col("t0") != F.col("t1")))
    # written before they are grouped: else a line that is everywhere would stay in the one task that joined it
    mine = table(lines.join(some.select("host", "h"), ["host", "h"], "left_semi"), "lines-to-count")
    texts = mine.groupBy("host", "h", "th").agg(F.lit(1).alias("x"))
    return texts.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > most).select("host", "h")


def verdicts(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id", most: int = MAX_LINE_DOCS) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, the columns of ``BASE``, ``kept, n_removed_words``, and ``__id, __th, host, drop``.

    ``drop`` has the hashes of lines over the limit (null if none). Null texts have
    no words and fail. Rows without a host are one host. Repeated rows keep their
    rows; no rows give none. Long texts are worked on whole; other columns aren't
    read, so that their names can't clash.
    """
    rows = table(features(docs, host, text, doc_id), "quality")
    flat = rows.select("__row", F.col("__th").alias("th"), F.coalesce("host", F.lit("")).alias("host"), F.explode(F.arrays_zip("h", "w")).alias("x")).select("__row", "th", "host", "x.*")
    bad = table(frequent_lines(flat.select("host", "h", "th"), most), "frequent-lines")
    lost = flat.join(bad, ["host", "h"]).groupBy("__row").agg(F.collect_list("h").alias("drop"), F.sum("w").alias("n_removed_words"))
    out = rows.drop("h", "w").join(lost, "__row", "left")
    left = F.col("n_words") - F.coalesce("n_removed_words", F.lit(0))
    return out.select(
        F.col("__id").alias("doc_id"), *[x.split()[0] for x in BASE.split(", ")],
        (~F.col("base_failed") & (left >= MIN_WORDS)).alias("kept"), F.coalesce("n_removed_words", F.lit(0)).cast("long").alias("n_removed_words"),
        "__id", "__th", "host", "drop",
    )


def report(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words)``."""
    return verdicts(docs, host, text, doc_id).drop("__id", "__th", "host", "drop")


def apply(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without rejected rows, and without lines over the limit; columns as they were, whatever their names."""
    got = verdicts(docs, host, text, doc_id).where("not kept or drop is not null")
    # equal rows have equal verdicts
    got = got.groupBy(F.col("__id").alias("__id2"), F.col("__th").alias("__th2"), F.col("host").alias("__host")).agg(F.first("kept").alias("__kept"), F.first("drop").alias("__drop"))
    same = F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__th") == F.col("__th2")) & F.col("__doc").getField(host).eqNullSafe(F.col("__host"))
    both = boxed(docs, text, doc_id).join(got, same, "left").where("coalesce(__kept, true)")
    out = unboxed(docs) | {text: without_lines(F.col("__doc").getField(text), F.col("__drop")).alias(text)}
    return both.select(*out.values())
