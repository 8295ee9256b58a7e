"""Token counts with a public tokenizer: lengths only, in batches balanced by bytes.

Long texts are cut at safe boundaries: before a blank that stands between two other
characters. The byte-level pre-tokenizer never joins across one, since a blank
begins a token there whatever follows, so the parts' counts add up to the text's.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Characters from which a text is cut.
PART_CHARS = 64 << 10
#: Characters in one call of the tokenizer.
BATCH_CHARS = 256 << 10

_SAFE = re.compile(r"(?<=\S) (?=\S)")


def cut(text: str, most: int = PART_CHARS) -> list[str]:
    """Parts of at most about ``most`` characters whose token counts add up to that of ``text``; longer where no boundary is safe."""
    parts, start = [], 0
    while len(text) - start > most:
        m = _SAFE.search(text, start + most - 1)
        if not m:
            break
        parts.append(text[start : m.start()])
        start = m.start()
    return [*parts, text[start:]]


class Counter:
    """Token counts of texts by the library that the tokenizer file is for."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's to deal out
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, texts: list[bytes | None], most: int = PART_CHARS) -> np.ndarray:
        counts = np.zeros(len(texts), np.int64)
        batch: list[str] = []
        rows: list[int] = []
        size = 0
        for k, t in enumerate(texts):
            for p in cut(t.decode("utf-8", "replace"), most) if t else ():
                if batch and size + len(p) > BATCH_CHARS:
                    self.add(batch, rows, counts)
                    batch, rows, size = [], [], 0
                batch.append(p)
                rows.append(k)
                size += len(p)
        self.add(batch, rows, counts)
        return counts

    def add(self, batch: list[str], rows: list[int], counts: np.ndarray) -> None:
        for k, e in zip(rows, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
            counts[k] += len(e)


@functools.lru_cache(maxsize=1)
def counter_of(path: str) -> Counter:
    """The counter of a worker process."""
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row.

    ``tokenizer`` is the path of a byte-level ``tokenizers`` file. No begin or end
    tokens are added; special strings in a text are found as the library does by
    default. Null and empty texts have 0 bytes and tokens; repeated rows keep their
    rows; an empty table gives no rows; other columns are not read.
    """

    def start():
        count = counter_of(tokenizer)

        def work(texts):
            n = count(texts)
            return {"n_bytes": [len(t or b"") for t in texts], "n_tokens": n, "over_limit": n > limit}

        return work

    return map_texts(docs, {"doc_id": F.col(doc_id)}, text, start, "n_bytes long, n_tokens long, over_limit boolean")
