"""Token ids of texts as ORC files in ascending order of document ids.

Rows are dealt to tasks by ranges of id, sorted, encoded and written in one stage, a
file for each range. ORC keeps ids as run-length encoded integers in stripes, with
row indexes of every column and Bloom filters of the document ids: Spark reads
stripes in parallel, and :func:`lookup` reads the row groups only that may hold the
ids asked for. Each row has its place among its file's ids; the places of the files
follow from their sums, read from two narrow columns.

Encoding is by distinct words: a blank between two other characters begins a token
of the byte-level pre-tokenizer, as does a stop after a letter, so a text's ids are
those of its words, each with its blank, and stops, one after the other. Words
repeat: each distinct one of a slice is encoded once, by the library itself, and
remembered for the slices that follow, within bounds.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import small_batches
from .token_counts import BATCH_CHARS, cut

#: Bytes of text whose words are encoded together.
SLICE_BYTES = 8 << 20
#: Distinct words in one call of the tokenizer.
WORDS_AT_ONCE = 2000
#: Words that a worker process remembers with their ids, some 40 bytes each.
KNOWN_WORDS = 1_000_000
#: Files whose places are sent to all tasks, 16 bytes each; of more they are joined by a shuffle.
MOST_FILES = 100_000
#: What files are written with, unless the caller says otherwise.
ORC_OPTIONS = {"compression": "zstd", "orc.stripe.size": str(64 << 20), "orc.row.index.stride": "10000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}

# A blank after white space and before white space or the end: there the pre-tokenizer may join blanks.
_SPACE = r"[\s\x0B\p{Z}\x{85}\x{180E}\x{1C}-\x{1F}]"
UNSAFE = f"{_SPACE} ({_SPACE}|$)"
# Between a letter and one of these a token ends, too.
AFTER_LETTER = r"([A-Za-z])([.,;:!?\n])"


class Encoder:
    """Ids of texts by a ``tokenizers`` file, without tokens added at the ends."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's to deal out
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.words, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int32)
        # words can be encoded by themselves
        self.by_words = not made.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.added = [t["content"] for t in made.get("added_tokens") or []]
        # a special string of which no end is a beginning parts words from each other
        plain = [t for t in made.get("added_tokens") or [] if not (t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.mark = next(((t["content"], t["id"]) for t in plain if not any(t["content"].startswith(t["content"][-k:]) for k in range(1, len(t["content"])))), None)

    def each(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, encoded alone."""
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def flat(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of each."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for k in range(0, len(words), WORDS_AT_ONCE):
            some = words[k : k + WORDS_AT_ONCE]
            if self.mark:
                text, mark = self.mark
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), text)[0].as_py() + text
                got = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
                ends = np.flatnonzero(got == mark)
                if len(ends) == len(some):
                    ids.append(np.delete(got, ends))
                    sizes.append((np.diff(ends, prepend=-1) - 1).astype(np.int32))
                    continue
            one = self.each(some.to_pylist())
            ids.extend(one)
            sizes.append(np.array([len(x) for x in one], np.int32))
        return np.concatenate(ids), np.concatenate(sizes)

    def remembered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words that are remembered, and of each of ``words`` how many it has and where they begin; new ones are encoded."""
        place = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(place))
        if len(self.words) + len(new) > KNOWN_WORDS:  # begin again with these
            self.words, self.ids, self.sizes = words[:0], np.zeros(0, np.int32), np.zeros(0, np.int32)
            place, new = pa.nulls(len(words), pa.int32()), words
        if len(new):
            ids, sizes = self.flat(new)
            at = place.to_numpy(zero_copy_only=False)
            where = np.where(np.isnan(at), 0, at).astype(np.int32)
            where[np.isnan(at)] = np.arange(len(self.words), len(self.words) + len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        else:
            where = place.to_numpy()
        begin = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        return self.ids, self.sizes[where], begin[where]

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text as it is, in parts that the library works on."""
        parts = cut(text)
        out = []
        step = max(1, BATCH_CHARS // max(1, *map(len, parts)))
        for k in range(0, len(parts), step):
            out += self.each(parts[k : k + step])
        return np.concatenate(out)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each; null counts as empty."""
        texts = texts.fill_null("")
        direct = np.ones(len(texts), bool)
        if self.by_words:
            odd = pc.match_substring_regex(texts, UNSAFE)
            for t in ["\0", *self.added]:
                odd = pc.or_(odd, pc.match_substring(texts, t))
            direct = odd.to_numpy(zero_copy_only=False)
        ids, sizes = self.spelled(texts.filter(pa.array(~direct)))
        if not direct.any():
            return ids, sizes
        own = [self.whole(t) for t in texts.filter(pa.array(direct)).to_pylist()]
        all_sizes = np.zeros(len(texts), np.int64)
        all_sizes[~direct], all_sizes[direct] = sizes, [len(x) for x in own]
        out = np.empty(all_sizes.sum(), np.int32)
        where = np.repeat(direct, all_sizes)
        out[~where], out[where] = ids, np.concatenate(own)
        return out, all_sizes

    def spelled(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts by their distinct words."""
        cut_up = pc.replace_substring_regex(pc.replace_substring(texts, " ", "\0 "), AFTER_LETTER, "\\1\0\\2")
        lists = pc.split_pattern(cut_up, "\0")
        del cut_up
        at = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        del lists
        code, known = words.indices.to_numpy(zero_copy_only=False), words.dictionary
        del words
        ids, n, begin = self.remembered(known)
        sizes = n[code]
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        take = np.repeat(begin[code] - total[:-1], sizes)
        take += np.arange(len(take))
        return ids[take], total[at[1:] - at[0]] - total[at[:-1] - at[0]]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker process."""
    return Encoder(path)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``batches`` in order, about ``most`` bytes of ``column`` at a time, or one row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + most - size, side="right")), start + (not held))
            if stop > start:
                held.append(b.slice(start, stop - start))
                size += int(ends[stop - 1] - before)
            if stop < b.num_rows or size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
            start = stop
    if held:
        yield pa.concat_batches(held)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 0, text: str = "text", doc_id: str = "doc_id", options: dict[str, str] | None = None) -> None:
    """Write the ids of each text, and ``end`` after them, to ORC files at ``path`` in ascending order of ``doc_id``.

    Rows: ``part`` (the file's place), ``doc_id``, ``offset`` (ids of the file before the
    row), ``n_tokens`` and ``ids``. Null and empty texts have ``end`` only; null ids come
    first; rows with one id are ordered by a hash of the text, and may be dealt to
    several files, so that no id is too frequent; repeated rows keep their rows; an
    empty table gives files without rows. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    key = StructField("doc_id", docs.schema[doc_id].dataType)
    schema = StructType([*_parse_datatype_string("part int").fields, key, *_parse_datatype_string("offset long, n_tokens int, ids array<int>").fields])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, before = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        for b in slices(batches, "text", SLICE_BYTES):
            ids, sizes = encode(b.column("text"))
            ends = np.cumsum(sizes)
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)), pa.array(np.insert(ids, ends, end)))
            sizes = sizes + 1
            offsets = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part, np.int32)), b.column("doc_id").cast(arrow.field(1).type), pa.array(offsets), pa.array(sizes.astype(np.int32)), rows.cast(arrow.field(4).type)], schema=arrow)
            del ids, rows
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.make_valid_utf8(text).alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "h", "row"]
    got = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(work, schema)
    got.write.options(**{**ORC_OPTIONS, **(options or {})}).orc(path)


def placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` (part, offset) of ``files`` with ``start``: the ids of all files and rows before.

    The sums of the files come from their last offsets; one row a file is put in order,
    and sent to all tasks where the files are at most ``MOST_FILES``.
    """
    totals = files.groupBy("part").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("base"))
    bases = F.broadcast(bases) if len(files.inputFiles()) <= MOST_FILES else bases
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("offset")).drop("base")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(part, doc_id, offset, n_tokens, ids, start)`` of the files at ``path``."""
    files = spark.read.orc(path)
    return placed(files, files)


def lookup(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """``(doc_id, ids)`` of the documents named: a filter that ORC answers from row indexes and Bloom filters."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of the files at ``path``: a checksum of the ids as little-endian 32-bit integers, made before places are joined."""
    files = spark.read.orc(path)
    schema = StructType([files.schema["doc_id"], *_parse_datatype_string("part int, offset long, n_tokens long, ids_crc32 long").fields])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(arrow.field(0).type), b.column("part"), b.column("offset"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], schema=arrow)

    small_batches(spark)
    return placed(files.select("doc_id", "part", "offset", "ids").mapInArrow(work, schema), files).select("doc_id", "start", "n_tokens", "ids_crc32")
