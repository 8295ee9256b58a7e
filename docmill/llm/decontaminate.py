"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of every test item. A text's words are
streamed through it, which gives at each word the length of the longest run ending
there that some item has; runs of a window's length or more are hits. Items of
fewer words than a window count as wholes. Items that are too many for one automaton
are split by hash into parts, each with an automaton and a pass of its own, and the
hits of a text are united.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .common import ALNUM, map_texts, row_key, table

WINDOW = 10
#: Words of the items of one automaton, which has under twice as many states and goes to every worker.
MAX_ITEM_WORDS = 500_000
#: A text of which a larger share is hit is dropped as a whole, rather than cut.
MAX_COVERAGE = 0.5

_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters and digits of ASCII and of all non-ASCII characters, A-Z in lower case."""
    return text.translate(ALNUM).split() if text else []


class Automaton:
    """Generalised suffix automaton over the words of items; ``items`` are (id, words)."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        own: list[set] = [set()]  # items of which a prefix ends in the state
        whole: dict[int, list[tuple[int, object]]] = {}
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(self.vocabulary.setdefault(w, len(self.vocabulary)), last)
                while len(own) < len(self.len):
                    own.append(set())
                own[last].add(item)
            if words and len(words) < window:
                whole.setdefault(last, []).append((len(words), item))
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        #: the state at which a run of just ``window`` words is, from any state of longer runs
        self.at_window = [0] * len(self.len)
        #: (length, item) of whole short items that are suffixes of the state's runs
        self.whole: list[tuple] = [()] * len(self.len)
        for v in order:
            p = self.link[v]
            if self.len[v] >= window:
                self.at_window[v] = v if self.len[p] < window else self.at_window[p]
            self.whole[v] = (*self.whole[p], *whole.get(v, ()))
        merged: dict[int, set] = {}
        for v in order:
            if self.len[v] >= window:
                merged.setdefault(self.at_window[v], set()).update(own[v])
        shared: dict[frozenset, frozenset] = {}  # most states are of one item, and equal sets are kept once
        self.items = {v: shared.setdefault(f, f) for v, f in ((v, frozenset(x)) for v, x in merged.items())}

    def _extend(self, c: int, last: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state({}, 0, length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(dict(self.next[q]), self.link[q], self.len[p] + 1)
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _state(self, nxt: dict[int, int], link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans of ``words``, as sorted disjoint [from, to), and the items with windows there."""
        spans: list[list[int]] = []
        found: set = set()
        nxt, link, length, window, short = self.next, self.link, self.len, self.window, self.whole
        v = n = 0
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                v = n = 0
                continue
            t = nxt[v].get(c)
            if t is None:
                while True:
                    v = link[v]
                    if v < 0:
                        v = n = 0
                        break
                    t = nxt[v].get(c)
                    if t is not None:
                        n, v = length[v] + 1, t
                        break
                if not n:
                    continue
            else:
                v = t
                n += 1
            hit = 0
            if n >= window:
                hit = window
                found |= self.items[self.at_window[v]]
            for m, item in short[v]:
                if m <= n:
                    hit = max(hit, m)
                    found.add(item)
            if hit:
                a = i + 1 - hit
                while spans and spans[-1][0] >= a:
                    spans.pop()
                if spans and spans[-1][1] >= a:
                    spans[-1][1] = i + 1
                else:
                    spans.append([a, i + 1])
        return [(a, b) for a, b in spans], found


def parts_of(benchmark: DataFrame, most: int | None = None, text: str = "text", item_id: str = "item_id") -> list[DataFrame]:
    """``benchmark`` as parts that one automaton of ``most`` words (8 bytes each) takes; dealt by hash, at half of that on average."""
    most = 8 * (most or MAX_ITEM_WORDS)
    bytes_ = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    if bytes_ <= most:
        return [benchmark]
    n = -(-2 * bytes_ // most)
    return [benchmark.where(F.pmod(F.xxhash64(text, item_id), F.lit(n)) == k) for k in range(n)]


def items_of(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> list[tuple[object, list[bytes]]]:
    """(id, words) of the items of one part that have words; ids as strings, null as the empty one; items that share an id count as one."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).cast("binary").alias("t")).collect()
    return sorted((r["i"], w) for r in rows if (w := words_of(bytes(r["t"]))))


def scan_part(docs: DataFrame, cast, keys: dict[str, F.Column | str], text: str = "text") -> DataFrame:
    """:func:`scan` with one automaton, which is broadcast as ``cast``."""

    def start():
        automaton = cast.value

        def work(texts):
            n, hit, ids, spans = [], [], [], []
            for t in texts:
                words = words_of(t)
                s, found = automaton.scan(words)
                n.append(len(words))
                hit.append(sum(b - a for a, b in s))
                ids.append(sorted(found))
                spans.append([x for ab in s for x in ab])
            return {"n_words": n, "n_hit": hit, "item_ids": ids, "spans": spans}

        return work

    return map_texts(docs, keys, text, start, "n_words long, n_hit long, item_ids array<string>, spans array<int>")


def unite(spans: Iterable[int]) -> list[int]:
    """Pairs of positions (from, to) in any order, as sorted and disjoint ones."""
    at, out = np.asarray(spans).reshape(-1, 2), []
    for a, b in at[np.argsort(at[:, 0], kind="stable")].tolist():
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def united(spans: pd.Series) -> pd.Series:
    return spans.map(unite)


def scan(docs: DataFrame, benchmark: DataFrame, keys: dict[str, F.Column | str], window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``keys`` and ``n_words, n_hit, item_ids, spans`` (pairs of word positions) for every row.

    Null and wordless texts have no words and no hits; repeated rows keep their
    rows; without items, or without documents, nothing is hit.
    """
    sc = docs.sparkSession.sparkContext
    first, *others = parts_of(benchmark)
    cast = sc.broadcast(Automaton(items_of(first), window))
    if not others:
        return scan_part(docs, cast, keys, text)
    ident = dict(zip(("__id", "__th"), row_key(text, doc_id)))
    rows = table(scan_part(docs, cast, {**keys, **ident}, text), "scan")
    cast.destroy()
    hits = []
    for k, part in enumerate(others):
        cast = sc.broadcast(Automaton(items_of(part), window))
        found = scan_part(docs, cast, ident, text).where("n_hit > 0").groupBy("__id", "__th")
        # equal rows have equal hits, so that a row has one array of each part at most
        hits.append(table(found.agg(F.first("item_ids").alias("i"), F.first("spans").alias("s")), f"scan-{k}"))
        cast.destroy()
    more = hits[0]
    for h in hits[1:]:
        more = more.unionByName(h)
    more = more.groupBy(F.col("__id").alias("__id2"), F.col("__th").alias("__th2")).agg(F.flatten(F.collect_list("i")).alias("__i"), F.flatten(F.collect_list("s")).alias("__s"))
    both = rows.join(more, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__th") == F.col("__th2")), "left")
    all_ids = F.array_sort(F.array_distinct(F.concat("item_ids", F.coalesce("__i", F.array().cast("array<string>")))))
    all_spans = united(F.concat("spans", F.coalesce("__s", F.array().cast("array<int>"))))
    got = both.select(*keys, "n_words", all_ids.alias("item_ids"), all_spans.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: x - n)  # to - (from - n), pair by pair
    return got.select(*keys, "n_words", n_hit.alias("n_hit"), "item_ids", "spans")


def report(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row."""
    found = scan(docs, benchmark, {"doc_id": doc_id}, text=text, doc_id=doc_id)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` and what stands between them."""
    at = [m.span() for m in _WORDS.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


@F.pandas_udf(StringType())
def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts (bytes) without their spans; null stays null."""
    return pd.Series([None if t is None else without_spans(bytes(t), np.reshape(s, (-1, 2)).tolist()).decode("utf-8", "replace") for t, s in zip(text, spans)], dtype=object)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = MAX_COVERAGE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without hit spans, and without rows of which more than ``coverage`` is hit; columns as they were.

    Rows without hits stay as they are, null texts too.
    """
    own = {f"__c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    got = scan(docs, benchmark, own, window, text, doc_id).where(F.col("n_hit") <= F.col("n_words") * coverage)
    whole = F.col(f"__c{docs.columns.index(text)}")
    # texts without hits aren't sent to be cut
    cleaned = F.when(F.col("n_hit") > 0, cut(F.when(F.col("n_hit") > 0, whole.cast("binary")), F.col("spans"))).otherwise(whole)
    return got.select(*[(cleaned if c == text else F.col(f"__c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def mask(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(n, bool)
    for a, b in spans:
        out[a:b] = True
    return out
