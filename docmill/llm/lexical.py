"""Ranked lexical search, score-at-a-time over impact-ordered postings.

The index is a table made in one pass over the texts: tasks cut their documents into
shards of bounded bytes, and each shard has a row for each of its terms (documents
and frequencies) and one for its documents. A search keeps the rows of terms that
are asked for, counts documents of each, and gives every shard its postings. There a
posting's exact impact (weight of the term times the integer part of the score) is
worked out once, postings of a term with equal impact form a segment, and an item's
segments are added up by falling impact, until the most that is left to add proves
that no other document can come among the first k. Scores of those that may are then
completed from the postings by document. Shards give k rows an item at most, and
the best k of all shards follow from a window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string

from .common import ALNUM, forget, small_batches, table
from .token_files import slices

#: Bytes of text in a shard.
SHARD_BYTES = 16 << 20
#: Bytes of items that are searched for at once; more are dealt into blocks, each with a pass over the postings.
BLOCK_BYTES = 4 << 20
#: Postings that are added up before the bound is first tried; each step adds twice as many.
FIRST_STEP = 512
#: Documents left as candidates at which adding up ends and their scores are completed, times k.
CANDIDATES = 8


@dataclass
class Index:
    """Postings ``(shard, term, n, docs, tfs, ids)``: of a term its documents (places in the shard) and frequencies; of the null term ``tfs``, the terms of each document, and ``ids``."""

    postings: DataFrame
    n_docs: int
    n_terms: int

    def drop(self) -> None:
        """Delete the tables."""
        forget(self.postings)


def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Index:
    """Index every row of ``docs``, by one pass over the texts.

    Terms are runs of 0-9, A-Z, a-z and all characters beyond ASCII, A-Z lower-cased.
    Null and empty texts have none. Repeated rows are documents of their own. Other
    columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = StructType([*_parse_datatype_string("shard long, term string, n long, total long, docs array<int>, tfs array<int>").fields, StructField("ids", ArrayType(docs.schema[doc_id].dataType))])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for k, b in enumerate(slices(batches, "text", SHARD_BYTES)):
            yield from shard_rows(part + k, b.column("id"), b.column("text"), arrow)

    rows = docs.select(F.col(doc_id).alias("id"), F.make_valid_utf8(text).cast("binary").alias("text"))
    postings = table(rows.mapInArrow(work, schema), "postings")
    got = postings.where("term is null").agg(F.sum("n"), F.sum("total")).first()
    return Index(postings, got[0] or 0, got[1] or 0)


def shard_rows(shard: int, ids: pa.Array, texts: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The postings of some documents."""
    texts = pa.concat_arrays([texts.fill_null(b"")])
    size = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + size + 1]
    raw = bytes(memoryview(texts.buffers()[2])[at[0] : at[-1]]).translate(ALNUM) if texts.buffers()[2] else b""
    plain = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(raw)])
    lists = pc.split_pattern(plain, b" ")
    words = lists.flatten().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(size), np.diff(lists.offsets.to_numpy()))
    blank = pc.index(words.dictionary, pa.scalar(b"", pa.binary())).as_py()
    if blank >= 0:
        code, doc = code[code != blank], doc[code != blank]
    key, tf = np.unique(code * size + doc, return_counts=True)
    term, doc_of = key // size, (key % size).astype(np.int32)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    bounds = pa.array(np.append(first, len(term)).astype(np.int32))
    counts, totals = np.diff(np.append(first, len(term))), np.bincount(doc, minlength=size)
    none = lambda n, f: pa.nulls(n, schema.field(f).type)
    if len(first):
        names = words.dictionary.take(pa.array(term[first])).cast(pa.string())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(first), shard)), names, pa.array(counts.astype(np.int64)), none(len(first), "total"),
            pa.ListArray.from_arrays(bounds, pa.array(doc_of)).cast(schema.field("docs").type), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32))).cast(schema.field("tfs").type), none(len(first), "ids"),
        ], schema=schema)
    one = pa.array([0, size], pa.int32())
    yield pa.RecordBatch.from_arrays([
        pa.array([shard]), none(1, "term"), pa.array([int((totals > 0).sum())]), pa.array([int(totals.sum())]), none(1, "docs"),
        pa.ListArray.from_arrays(one, pa.array(totals.astype(np.int32))).cast(schema.field("tfs").type), pa.ListArray.from_arrays(one, ids).cast(schema.field("ids").type),
    ], schema=schema)


def terms_of(text: str | None) -> list[str]:
    """Terms of a text, in order."""
    return [w.decode("utf-8", "replace") for w in (text or "").encode("utf-8", "replace").translate(ALNUM).split(b" ") if w]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Impact-ordered segments of the postings of one shard.

    ``seg_*``: segments by term and falling impact, each a run of ``doc`` of equal
    impact. ``key``: the postings by term and document, for scores of single documents.
    """

    def __init__(self, rows: pa.Table, weights: dict[str, int], n_docs: int, n_terms: int) -> None:
        is_docs = pc.is_null(rows["term"])
        own = rows.filter(is_docs)
        self.ids = own["ids"].combine_chunks().flatten()
        sizes = own["tfs"].combine_chunks().flatten().to_numpy()
        self.size = len(sizes)
        posts = rows.filter(pc.invert(is_docs))
        names = posts["term"].to_pylist()
        self.place = {t: k for k, t in enumerate(names)}
        counts = posts["n"].to_numpy()
        doc = posts["docs"].combine_chunks().flatten().to_numpy().astype(np.int64)
        tf = posts["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
        term = np.repeat(np.arange(len(names)), counts)
        some, back = np.unique(sizes, return_inverse=True)
        m = np.array([100 - 75 + (75 * int(n) * n_docs) // n_terms for n in some], np.int64)[back]
        w = np.array([weights[t] for t in names], np.int64)
        impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        self.key, self.impact = term * self.size + doc, impact
        by_key = np.argsort(self.key, kind="stable")
        self.key, self.impact = self.key[by_key], impact[by_key]
        order = np.lexsort((-impact, term))
        self.doc, impact, term = doc[order], impact[order], term[order]
        start = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(impact, prepend=-1) != 0))
        self.seg_start, self.seg_size = start, np.diff(np.append(start, len(doc)))
        self.seg_impact, seg_term = impact[start], term[start]
        self.term_start = np.searchsorted(seg_term, np.arange(len(names) + 1))

    def complete(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whole scores of ``docs``."""
        want = terms[:, None] * self.size + docs[None, :]
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return (np.where(self.key[at] == want, self.impact[at], 0) * times[:, None]).sum(axis=0)

    def best(self, asked: Counter, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` first documents, all with scores above 0."""
        terms = np.array([self.place[t] for t in asked if t in self.place], np.int64)
        if not len(terms):
            return terms, terms
        times = np.array([n for t, n in asked.items() if t in self.place], np.int64)
        begin, end = self.term_start[terms], self.term_start[terms + 1]
        n = end - begin
        of = np.repeat(np.arange(len(terms)), n)
        segs = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[of]
        value = self.seg_impact[segs] * times[of]
        order = np.argsort(-value, kind="stable")
        segs, of, value = segs[order], of[order], value[order]
        ends = np.cumsum(self.seg_size[segs])
        score = np.zeros(self.size, np.int64)
        done, step, used = 0, FIRST_STEP, np.zeros(len(terms), np.int64)
        while done < len(segs):
            stop = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + step, side="right")), done + 1)
            some = segs[done:stop]
            sizes = self.seg_size[some]
            posts = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - self.seg_start[some], sizes)
            np.add.at(score, self.doc[posts], np.repeat(value[done:stop], sizes))
            used += np.bincount(of[done:stop], minlength=len(terms))
            done, step = stop, step * 2
            if done < len(segs) and self.size > k:
                left = begin + used
                rest = int((np.where(used < n, self.seg_impact[np.minimum(left, len(self.seg_impact) - 1)], 0) * times).sum())
                kth = int(np.partition(score, self.size - k)[self.size - k])
                if rest < kth:  # no document that isn't met yet can come in
                    may = np.flatnonzero(score + rest >= kth)
                    if len(may) <= CANDIDATES * k:
                        return self.first(may, self.complete(may, terms, times), k)
        met = np.flatnonzero(score)
        return self.first(met, score[met], k)

    def first(self, docs: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``k`` by falling score, then by id; null ids are last."""
        docs, score = docs[score > 0], score[score > 0]
        if len(docs) > k:
            kth = np.partition(score, len(score) - k)[len(score) - k]
            docs, score = docs[score >= kth], score[score >= kth]
        ids = self.ids.take(pa.array(docs))
        order = pc.sort_indices(pa.table({"s": score, "i": ids}), [("s", "descending"), ("i", "ascending")], null_placement="at_end").to_numpy()[:k]
        return docs[order], score[order]


def blocks(items: DataFrame) -> Iterator[list]:
    """Rows ``(row, item_id, text)`` of ``items`` in blocks of about ``BLOCK_BYTES``."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    for b in range(n):
        yield items.where(F.pmod(F.xxhash64("row"), F.lit(n)) == b).collect()


def search(index: Index, items: DataFrame, k: int = 10, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: of each row of ``items`` the ``k`` documents with the highest scores above 0.

    Equal scores are ranked by ascending id, null ids last; documents that share an id
    are ranked one by one. Items without a term that a document has give no rows, as
    does an empty index; each row of repeated items is an item of its own. Other
    columns of ``items`` aren't read. A term's score is its weight times
    ``(10**9 * tf) div (1000 * tf + 8 * m)``, ``m = 25 + (75 * n * N) div L``.
    """
    spark = items.sparkSession
    doc_type = index.postings.schema["ids"].dataType.elementType
    local = StructType([*_parse_datatype_string("row long").fields, StructField("item_id", items.schema[item_id].dataType), StructField("doc_id", doc_type), *_parse_datatype_string("score long").fields])
    asked = table(items.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).alias("item_id"), F.col(text).alias("text")), "items")
    found = [spark.createDataFrame([], local)]
    for block in blocks(asked) if index.n_docs else ():
        found.append(search_block(index, [(r["row"], r["item_id"], Counter(terms_of(r["text"]))) for r in block], k, local))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    forget(asked)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_block(index: Index, block: list[tuple[int, object, Counter]], k: int, local: StructType) -> DataFrame:
    """The first ``k`` of each shard for the items of a block, whose terms are sent to all tasks."""
    spark = index.postings.sparkSession
    vocabulary = sorted({t for _, _, c in block for t in c})
    # the null term's rows, those of the documents, are needed too
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in [None, *vocabulary]], "t string"))
    posts = index.postings.join(wanted, F.col("term").eqNullSafe(F.col("t")), "left_semi")
    df = posts.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()  # of the block's terms
    weights = {r["term"]: weight(index.n_docs, r["n"]) for r in df}
    n_docs, n_terms = index.n_docs, index.n_terms
    arrow = to_arrow_schema(local)
    own = [(row, item, asked) for row, item, asked in block if any(t in weights for t in asked)]

    def rank(rows: pa.Table) -> pa.Table:
        shard = Shard(rows, weights, n_docs, n_terms)
        got = [(row, item, *shard.best(asked, k)) for row, item, asked in own]
        sizes = [len(docs) for _, _, docs, _ in got]
        docs = np.concatenate([np.zeros(0, np.int64), *[d for _, _, d, _ in got]])
        return pa.Table.from_arrays([
            pa.array(np.repeat(np.array([r for r, *_ in got], np.int64), sizes)), pa.array([i for (_, i, _, _), n in zip(got, sizes) for _ in range(n)], arrow.field(1).type),
            shard.ids.take(pa.array(docs)).cast(arrow.field(2).type), pa.array(np.concatenate([np.zeros(0, np.int64), *[s for *_, s in got]])),
        ], schema=arrow)

    return posts.groupBy("shard").applyInArrow(rank, local)
