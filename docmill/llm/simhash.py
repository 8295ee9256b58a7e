"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a
23-bit vector. The perfect [23,12,7] Golay code decodes every vector to one
codeword; decoding the vector and its 23 one-bit neighbours gives one or six
codeword indices, and two vectors at two or fewer differing bits share at least
one. Two fingerprints that differ in at most two bits agree wholly in one of the
three segments (pigeonhole), so (that segment, an index of the next one) is a key
they share: 3 to 18 keys a fingerprint. Fingerprints that share a key are verified.

The pipeline's near dedup is :func:`keep_one`, at a Jaccard similarity of 0.8 of
five-word shingles. Fingerprints of these that link are verified by the sets. 0.8 is
about ten bits of 64, too many for keys that miss none, so a join of the sets that are
still apart, by their prefixes, finds the links that fingerprints miss.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import LOWER, boxed, forget, map_texts, row_key, small_batches, table, tidy, unboxed

SHINGLE = 3
SEED = 42
#: Offset and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the cyclic Golay code.
GENERATOR = 0b110001110101
#: Keys with up to so many fingerprints are joined pair by pair; those of larger keys are linked by shared one-bit neighbours, which is as exact and linear.
PAIRWISE = 32
#: Edges of which a task keeps track at once, and tasks for the edges, however few there are.
TASK_EDGES = 1 << 18
LEAST_TASKS = 6

#: Near copies as wholes, for :func:`keep_one`: shingles of so many words, alike from this fraction on.
COPY_SHINGLE = 5
ALIKE = (4, 5)
#: Sets of a block, and hashes by which two blocks are compared at a time.
BLOCK = 256
COLUMNS = 4096
BLOCK_ROWS = "array<struct<sig:bigint,n:bigint,root:bigint,prefix:array<bigint>>>"
#: Rows of a small table, of 16 bytes each, that is sent to all tasks.
SENT = 1 << 19
#: Rounds in which a set is compared with one other by each of its shingles.
ROUNDS = 2
#: Shingles of so many of the texts in one of ``SAMPLE`` parts are compared last, the ``MAX_OFTEN`` most common at most.
SAMPLE = 16
SAMPLE_OFTEN = 8
MAX_OFTEN = 1 << 20


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """64-bit hashes of a text's shingles, repeats included; a text with fewer words is one shingle, one without any has none."""
    words = text.translate(LOWER).split() if text else []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)] if words else [], np.uint64)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Signed 64-bit fingerprints of texts by the hashes of their shingles: bits set in over half of them; zero where there is none."""
    out = np.zeros(len(hashes), np.uint64)
    for k, own in enumerate(hashes):
        if len(own):
            ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            out[k] = np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def fingerprint_batch(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit fingerprints of texts; zero where there is no word."""
    return majority([shingle_hashes(t, shingle) for t in texts])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fp)``: a signed long for each row; null text counts as no word."""
    return map_texts(docs, {doc_id: doc_id}, text, lambda: lambda texts: {"fp": fingerprint_batch(texts)}, "fp long")


def _mod(v: int) -> int:
    for k in range(22, 10, -1):
        if v >> k & 1:
            v ^= GENERATOR << (k - 11)
    return v


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes by the bytes of a 23-bit vector, and the error pattern of each of the 2,048 syndromes."""
    one = [_mod(1 << k) for k in range(24)]
    syndromes = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for v in range(256):
            for k in range(8):
                if v >> k & 1 and byte * 8 + k < 23:
                    syndromes[byte, v] ^= one[byte * 8 + k]
    errors = np.zeros(2048, np.int64)
    for n in range(4):
        for where in itertools.combinations(range(23), n):
            s = 0
            for k in where:
                s ^= one[k]
            errors[s] = sum(1 << k for k in where)
    return syndromes, errors


def decode(v: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of each 23-bit vector."""
    syndromes, errors = tables
    s = syndromes[0][v & 255] ^ syndromes[1][v >> 8 & 255] ^ syndromes[2][v >> 16]
    return (v ^ errors[s]) >> 11


def golay_keys(fps: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``fps`` and the keys of each, without repeats."""
    u = fps.view(np.uint64)
    parts = [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    flips = np.array([0, *(1 << k for k in range(23))], np.int64)
    rows, keys = [], []
    for i, whole in enumerate(parts):
        near = np.sort(decode(parts[(i + 1) % 3][:, None] ^ flips[None, :], tables), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r)
        keys.append(np.int64(i) << np.int64(40) | whole[r] << 12 | near[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def candidate_keys(fps: DataFrame) -> DataFrame:
    """``(key, fp)`` of distinct fingerprints ``fp``."""

    def run(batches):
        tables = golay_tables()
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(v):
                rows, keys = golay_keys(v, tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(v[rows])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """``(a, b)``, a > b: links between distinct fingerprints at two or fewer differing bits that join all that such links join.

    Small keys give their verified pairs. Fingerprints that share a large key are
    linked through the vectors one bit away from them: two fingerprints are within
    two bits exactly if they have such a vector (or themselves) in common, and one
    vector has at most 65 of them, so no group is unbounded and no pair is left out.
    """
    keys = table(candidate_keys(fps), "golay-keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    both = keys.join(shared, "key")
    near = F.transform(F.col("fps"), lambda x, i: F.transform(F.filter(F.slice("fps", i + 2, F.size("fps")), lambda y: F.bit_count(x.bitwiseXOR(y)) <= 2), lambda y: F.struct(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))))
    small = both.where(F.col("n") <= PAIRWISE).groupBy("key").agg(F.collect_list("fp").alias("fps")).select(F.explode(F.flatten(near)).alias("e")).select("e.*")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    large = both.where(F.col("n") > PAIRWISE).select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    star = large.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a != b").select("a", "b")
    got = table(small.unionByName(star).distinct(), "fingerprint-links")
    forget(keys)
    return got


def linked_sets(reps: DataFrame) -> DataFrame:
    """``(a, b)``, a > b: numbers of sets ``reps`` (sig, fp) that join all whose fingerprints :func:`links` joins, equal ones among them."""
    first = table(reps.groupBy("fp").agg(F.min("sig").alias("first")), "distinct-fingerprints")
    near = links(first)
    one, two = (first.select(F.col("fp").alias(x), F.col("first").alias(f"s{x}")) for x in "ab")
    pairs = near.join(one, "a").join(two, "b").select("sa", "sb").unionByName(reps.join(first, "fp").where("sig != first").select(F.col("sig").alias("sa"), F.col("first").alias("sb")))
    got = table(pairs.select(F.greatest("sa", "sb").alias("a"), F.least("sa", "sb").alias("b")).distinct(), "linked-sets")
    for t in (near, first):
        forget(t)
    return got


class Union:
    """Smallest member of each group of linked numbers."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (t := up.get(top, top)) != top:
            top = t
        while (t := up.get(x, x)) != x:
            up[x], x = top, t
        return top

    def add(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> pa.RecordBatch:
        a = [x for x in self.up]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([self.root(x) for x in a], pa.int64())], ["a", "b"])


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges that join what ``edges`` join, by ``tasks`` tasks: each gives the stars of every ``TASK_EDGES`` of its edges."""

    def run(batches):
        union, n = Union(), 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                union.add(a, b)
            n += batch.num_rows
            if n >= TASK_EDGES:
                yield union.stars()
                union, n = Union(), 0
        yield union.stars()

    return edges.select("a", "b").coalesce(tasks).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(a, root)`` for every vertex that is not the smallest of its component.

    In a round each vertex learns the smallest of itself and its neighbours, and all
    of them are linked to that one instead, until every vertex is the smallest or
    has the smallest as its only neighbour. Minima are added up before the shuffle
    and joined to the edges, so that hubs are never gathered. Before each round every
    task replaces its edges by their stars, which leaves few rounds and rows.
    """
    now = table(edges.select("a", "b").where("a != b"), "edges")
    tasks = max(LEAST_TASKS, -(-now.count() // TASK_EDGES))
    while True:
        was, now = now, table(contracted(now, tasks), "stars")
        forget(was)
        seen = Observation()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x")).observe(seen, F.count_if(F.expr("m < a and m != x")).alias("open"))
        low = table(low.select("a", "m").coalesce(tasks), "least-neighbours")
        if not seen.get["open"]:
            forget(now)
            return low.where("m < a").select("a", F.col("m").alias("root"))
        least = low.select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        linked = both.join(least, F.col("a") == F.col("c")).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now, was = table(linked.where("a != b").distinct().coalesce(tasks), "edges"), now
        forget(was)
        forget(low)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row.

    Null, empty and blank texts have fingerprint zero and link like any other.
    Repeated rows keep their rows. ``component_id`` is the smallest id reachable over
    fingerprints at two or fewer differing bits; null ids are never that, unless
    there is no other. Other columns are not read. An empty table gives no rows.
    """
    rows = table(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "fingerprints")
    first = table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(first))
    named = first.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = table(named, "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The set of a text's shingles: sorted distinct 63-bit hashes; without a word it is that of the empty text."""
    if not len(hashes):
        hashes = np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)
    return np.unique(hashes >> np.uint64(1)).view(np.int64)


def shingle_set(text: bytes | None, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a text's shingles; a text with fewer words is one shingle, as is a text without any."""
    return distinct(shingle_hashes(text, shingle))


def prefix(hashes: np.ndarray, often: np.ndarray) -> np.ndarray:
    """So many of a set's first hashes, those of ``often`` (sorted) last, that two sets alike enough share one of theirs.

    Hashes that aren't in ``often`` come as negative numbers, so that prefixes are sorted.

    Sets alike at 0.8 have at least 0.8 of either in common, so by any one order of
    all hashes the first common one is among the first 0.2 n + 1 of both.
    """
    n = len(hashes)
    if len(often):
        at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
        last = often[at] == hashes
    else:
        last = np.zeros(n, bool)
    hashes = np.concatenate([hashes[~last] + np.iinfo(np.int64).min, hashes[last]])
    return hashes[: n - (n * ALIKE[0] + ALIKE[1] - 1) // ALIKE[1] + 1]


def often_shared(docs: DataFrame, text: str) -> np.ndarray:
    """Sorted hashes of shingles that many distinct texts of a sample have, the most common if too many.

    They only choose the order in which :func:`prefix` takes shingles, which any
    order leaves exact: common passages are the last by which texts are compared.
    """
    th = row_key(text, text)[1]
    some = docs.select(th, F.col(text).alias("t")).where(F.pmod("__th", F.lit(SAMPLE)) == 0).dropDuplicates(["__th"])
    sets = map_texts(some, {"__th": "__th"}, "t", lambda: lambda texts: {"hs": [shingle_set(t) for t in texts]}, "hs array<bigint>")
    n = sets.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_OFTEN)
    got = n.orderBy(F.desc("n"), "h").limit(MAX_OFTEN).select("h").toArrow()
    return np.sort(got.column(0).to_numpy().astype(np.int64))


def enough(common: F.Column, m: F.Column, n: F.Column) -> F.Column:
    """Whether sets of sizes ``m`` and ``n`` with so much in common are alike: i / (m + n - i) >= p / q, in whole numbers."""
    return common * sum(ALIKE) >= (m + n) * ALIKE[0]


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()


def close(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The ``(a, b)`` of distinct ``pairs`` of set numbers that may be alike, by sizes and prefixes of ``reps`` (sig, n, prefix)."""
    reps = reps.join(ends_of(pairs), "sig", "left_semi")
    one, two = (reps.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"p{x}")) for x in "ab")
    # all common hashes up to the end of the prefix that ends first are in both prefixes, so only what follows it in either set can be more
    end = F.least(F.element_at("pa", -1), F.element_at("pb", -1))
    after = lambda x: F.col(f"n{x}") - F.size(F.filter(f"p{x}", lambda h: h <= F.col("end")))
    most = F.size(F.array_intersect("pa", "pb")) + F.least(after("a"), after("b"))
    return pairs.join(one, "a").join(two, "b").withColumn("end", end).where(enough(F.least(most, "na", "nb"), F.col("na"), F.col("nb"))).select("a", "b")


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of a few numbers a row, to be sent to all tasks if it has no more than ``SENT`` rows."""
    return F.broadcast(df) if df.count() <= SENT else df


def whole_sets(reps: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``(sig, hs)``, a table: the whole shingle sets of ``reps`` (sig, __th), made of their texts once more."""
    # texts of one set may differ in case and space, and any will do
    asked = table(reps.select("sig", "__th"), "texts-asked")
    texts = docs.select(row_key(text, text)[1], F.col(text).alias("t")).join(small(asked), "__th").select("sig", "t")
    sets = map_texts(texts, {"sig": "sig"}, "t", lambda: lambda ts: {"hs": [shingle_set(t) for t in ts]}, "hs array<bigint>")
    sets = table(sets.dropDuplicates(["sig"]), "candidate-sets")
    forget(asked)
    return sets


def alike(pairs: DataFrame, reps: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The ``(a, b)``, a table, of distinct ``pairs`` of set numbers whose Jaccard similarity is high enough, by their whole sets."""
    mine = whole_sets(reps.join(ends_of(pairs), "sig", "left_semi"), docs, text)
    one, two = (mine.select(F.col("sig").alias(x), F.col("hs").alias(f"h{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b")
    got = table(both.where(enough(F.size(F.array_intersect("ha", "hb")), F.size("ha"), F.size("hb"))).select("a", "b"), "links")
    forget(mine)
    return got


def comparable(apart: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of ``apart`` (sig, n, h, root) whose sets may be alike with another one of the same ``h``, by what they can have in common, with the ``size`` of each ``h``.

    A set shares no more of its prefix with sets of other components than it has rows
    here. With all that follows the prefix, that must be enough for the smallest set of
    the same ``h``.
    """
    rows = apart.groupBy("sig").agg(F.count("*").alias("rows"))
    after = reps.select("sig", (F.col("n") - F.size("prefix")).alias("after"))
    least = apart.groupBy("h").agg(F.min("n").alias("least"))
    able = apart.join(rows.join(after, "sig"), "sig").join(least, "h").where(enough(F.col("after") + F.col("rows"), F.col("n"), F.col("least")))
    able = table(able.select("sig", "n", "h", "root"), "shared-able")
    met = able.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo != hi").select("h", "size")
    kept = table(able.join(met, "h"), "shared-comparable")
    forget(able)
    return kept


Block = tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]  # number, size, root and prefix of some sets


def close_in_blocks(h: int, x: Block, y: Block) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`close` finds of two blocks of sets with ``h`` in their prefixes: pairs of different components, for which ``h`` is the first they share."""
    sizes = [list(map(len, b[3])) for b in (x, y)]
    hashes, at, held = np.unique(np.concatenate([*x[3], *y[3]]), return_inverse=True, return_counts=True)
    # hashes that one set alone has are in no product; the others are multiplied so many at a time, those before h apart
    shared = held > (2 if x is y else 1)
    at = np.where(shared, np.cumsum(shared) - 1, -1)[at]
    row = np.repeat(np.arange(len(x[0]) + len(y[0])), sizes[0] + sizes[1])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    n, k = int(shared.sum()), int(np.searchsorted(hashes[shared], h))
    edges = [*range(0, k, COLUMNS), *range(k, n, COLUMNS), n]
    common, before = (np.zeros((len(x[0]), len(y[0])), np.float32) for _ in range(2))
    for left, right in zip(edges, edges[1:]):
        a, b = np.searchsorted(at, (left, right))
        grid = np.zeros((len(x[0]) + len(y[0]), right - left), np.float32)
        grid[row[a:b], at[a:b] - left] = 1
        part = grid[: len(x[0])] @ grid[len(x[0]) :].T
        common += part
        if right <= k:
            before += part
    common, first = common.astype(np.int64), before == 0
    last = [np.array([p[-1] for p in b[3]]) for b in (x, y)]
    # so many of a prefix are up to the end of the other one
    of_x = np.array([np.searchsorted(p, last[1], "right") for p in x[3]])
    of_y = np.array([np.searchsorted(p, last[0], "right") for p in y[3]]).T
    n, m = x[1][:, None], y[1][None, :]
    most = np.minimum(common + np.minimum(n - of_x, m - of_y), np.minimum(n, m))
    ok = first & (x[2][:, None] != y[2][None, :]) & (most * sum(ALIKE) >= (n + m) * ALIKE[0])
    return np.nonzero(ok)


def close_apart(apart: DataFrame, reps: DataFrame) -> DataFrame:
    """The ``(a, b)`` that :func:`close` would find of all pairs of ``apart`` (sig, n, h, root) that share ``h`` in different components.

    Sets that share a hash are dealt into blocks by their numbers, and two blocks are
    compared at a time; no pair is made that isn't close.
    """
    prefixes = reps.select("sig", "prefix")
    count = apart.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    keyed = apart.join(count, "h").select("sig", "h", "n", "root", "blocks", F.pmod(F.xxhash64("sig", "h"), F.col("blocks")).cast("int").alias("i"))
    blocks = lambda some: some.join(prefixes, "sig").groupBy("h", "i", "blocks").agg(F.collect_list(F.struct("sig", "n", "root", "prefix")).alias("x"))
    one = blocks(keyed.where("blocks = 1")).select("h", "x", F.lit(None).cast(BLOCK_ROWS).alias("y"))
    many = table(blocks(keyed.where("blocks > 1")), "blocks")
    left = many.select("h", "i", "x", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"))
    two = left.join(many.select("h", F.col("i").alias("j"), F.col("x").alias("y")), ["h", "j"]).select("h", "x", F.when(F.col("i") != F.col("j"), F.col("y")).alias("y"))
    met = one.unionByName(two)

    def run(batches):
        def block(rows_: pa.Array) -> Block:
            v = rows_.flatten()
            p = v[3].to_numpy(zero_copy_only=False)
            return v[0].to_numpy(), v[1].to_numpy(), v[2].to_numpy(), list(p)

        for batch in batches:
            a, b = [], []
            for h, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                one = block(x.values)
                two = block(y.values) if y.is_valid else one
                i, j = close_in_blocks(h, one, two)
                if not y.is_valid:
                    i, j = i[i < j], j[i < j]
                a.append(np.maximum(one[0][i], two[0][j]))
                b.append(np.minimum(one[0][i], two[0][j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for v in (a, b)], ["a", "b"])

    small_batches(apart.sparkSession)
    return met.mapInArrow(run, "a long, b long")


def copy_links(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``(a, root)`` of sets that links at the similarity join, for each that is not the smallest of its component.

    Sets whose SimHash fingerprints link by Golay keys are candidates first, verified by
    the sets. Fingerprints of sets alike at 0.8 may differ in more bits than keys bear,
    so the exact join completes that. Of the sets that have a shingle in their prefixes,
    each is compared with one hub: a set that the shingle's hash picks, so that a set
    meets another hub by each of its shingles. What that joins need not be compared again. After so many
    rounds, linear in the number of sets, all sets of different components that still
    share a shingle are compared, block by block.
    """
    keys = rows.select("sig", "n", F.explode("prefix").alias("h"))
    shared = keys.groupBy("h").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo != hi").select("h")
    keys = table(keys.join(small(table(shared, "hashes-shared")), "h", "left_semi").distinct(), "shared-shingles")
    near = F.least("n", "n2") * ALIKE[1] >= F.greatest("n", "n2") * ALIKE[0]
    pair = lambda df: df.where((F.col("sig") != F.col("sig2")) & near).select(F.greatest("sig", "sig2").alias("a"), F.least("sig", "sig2").alias("b")).distinct()
    reps = table(rows.join(keys.select("sig").distinct(), "sig", "left_semi").dropDuplicates(["sig"]).select("sig", "n", "fp", "prefix", "__th"), "candidates")
    links, apart = None, keys.withColumn("root", F.col("sig"))
    tidy(rows.sparkSession)
    for k in range(ROUNDS + 1):
        if k:
            order = F.col("sig") if k == 1 else F.xxhash64("sig", "h", F.lit(k))
            hub = apart.groupBy("h").agg(F.min(F.struct(order.alias("o"), "sig", "n", "root")).alias("m")).select("h", F.col("m.sig").alias("sig2"), F.col("m.n").alias("n2"), F.col("m.root").alias("root2"))
            tried = table(pair(apart.join(hub, "h").where("root != root2")), "hub-pairs")
        else:
            tried = linked_sets(reps)
        near_ = table(close(tried, reps), "close-pairs")
        forget(tried)
        more = alike(near_, reps, docs, text)
        forget(near_)
        tidy(rows.sparkSession)
        links = more if links is None else links.unionByName(more)
        roots = components(links)
        named = keys.join(roots.withColumnRenamed("a", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        count = named.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo != hi").select("h", "size")
        was, apart = apart, table(named.join(count, "h"), "shared-apart")
        forget(was)
        tidy(rows.sparkSession)
    forget(keys)
    was, apart = apart, comparable(apart, reps)
    forget(was)
    few = apart.where(F.col("size") <= PAIRWISE).groupBy("h").agg(F.collect_list(F.struct("sig", "n", "root")).alias("x")).select(F.explode("x").alias("one"), "x").select("one", F.explode("x").alias("two"))
    few = few.where("one.sig > two.sig and one.root != two.root").select(F.col("one.sig").alias("sig"), F.col("one.n").alias("n"), F.col("two.sig").alias("sig2"), F.col("two.n").alias("n2"))
    tried = table(pair(few), "few-pairs")
    near_ = table(close(tried, reps).unionByName(close_apart(apart.where(F.col("size") > PAIRWISE), reps)).distinct(), "close-pairs")
    for t in (tried, apart):
        forget(t)
    tidy(rows.sparkSession)
    more = alike(near_, reps, docs, text)
    for t in (near_, reps):
        forget(t)
    tidy(rows.sparkSession)
    return components(links.unionByName(more))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row, that of the smallest id, of each group of near copies; columns as they were.

    Texts are near copies if their sets of five-word shingles have a Jaccard
    similarity of 0.8 or more, or a chain of such texts joins them. Texts without a
    word are copies of each other; null ids stay only where there is no other. Columns
    may have any names.
    """
    often = often_shared(docs, text)

    def start():
        def work(texts):
            hashes = [shingle_hashes(t, COPY_SHINGLE) for t in texts]
            sets = [distinct(h) for h in hashes]
            sig = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            return {"sig": sig, "fp": majority(hashes), "n": [len(s) for s in sets], "prefix": [prefix(s, often) for s in sets]}

        return work

    ident, th = row_key(text, doc_id)
    rows = table(map_texts(docs, {"__id": ident, "__th": th}, text, start, "sig long, fp long, n long, prefix array<bigint>"), "shingles")
    roots = copy_links(rows, docs, text)
    named = rows.join(roots.withColumnRenamed("a", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__th")).alias("k")).select(F.col("k.__id").alias("__id2"), F.col("k.__th").alias("__th2"))
    count = rows.groupBy("__id", "__th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("__id").alias("__id3"), F.col("__th").alias("__th3"))
    same = lambda k: F.col("__id").eqNullSafe(F.col(f"__id{k}")) & (F.col("__th") == F.col(f"__th{k}"))
    kept = table(best.join(count, F.col("__id2").eqNullSafe(F.col("__id3")) & (F.col("__th2") == F.col("__th3")), "left").select("__id2", "__th2", F.col("__th3").isNotNull().alias("many")), "kept")
    keyed = boxed(docs, text, doc_id)
    # only rows that are there more than once are sought for repeats
    once = keyed.join(kept.where("not many"), same(2), "left_semi")
    many = keyed.join(kept.where("many"), same(2), "left_semi").dropDuplicates(["__id", "__th"])
    return once.unionByName(many).select(*unboxed(docs).values())
