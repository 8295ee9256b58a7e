"""LM scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) P(branch | class, history) P(unit | branch, history) P(word | unit).
The first three are softmaxes of ``WIDTH`` outcomes each over hashed features of the
history: the word before, the one before that as a skip feature, and both as an
n-gram. P(word | unit) comes from exact corpus counts, as do the weights with which
training begins, which are those of the model without history.

Units are words: the most frequent ones have a unit each, the others share units by
their hash. Which words may share follows from the texts. Frequent words that stand near
each other more often than by chance are put into groups (in texts of several languages
these are mostly languages), every word of some frequency into the group of the words
it stands near, and rarer ones, as well as those that no text has, into that of words
with the same end and beginning. Each group has classes of its own, as many as its
share of the tokens, so that a history that tells the group tells the class.

All training texts give the first step: observed counts by bucket and outcome, added
up over all tasks, against those expected without history, which need no pass of
their own, as a bucket belongs to one softmax. Then all texts are dealt over rounds by
the hash of their key, and each round takes a step of the class softmax by observed
less expected counts at the weights so far, divided by the logarithmic mean of the two
(iterative scaling). So the model doesn't depend on how texts are dealt over tasks, but
for the order in which floating-point numbers are added. The buckets follow the
counted vocabulary.

Counts of frequent words, of which there can be only a bounded number, go to all tasks;
those of the others are joined.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, by_bytes, map_texts, small_batches, table

#: Outcomes of each softmax, and softmaxes of each level: one, one a class, one a branch.
WIDTH = 16
NODES = (1, WIDTH, WIDTH * WIDTH)
UNITS = WIDTH**3
#: Share of the units of a group that frequent words have alone; its other words share the rest.
OWN = (3, 4)
#: Groups, frequent words that are put into groups first, and how far apart words are near each other.
GROUPS = 8
FREQUENT = 256
NEAR = 4
#: Kinds of ends and beginnings of words.
KINDS = 1 << 14
#: Distinct words for a bucket of the class softmax, least and most of these as powers of two; each further level has four times as many.
WORDS_A_BUCKET = 16
BUCKETS = (10, 14)
#: Parts of eight of the training texts in each round.
ROUNDS = (1, 2, 5)
#: Share of a step that is taken (three features add up), first and in the rounds, and counts added to observed and expected ones.
RATES = (0.65, 0.5)
PRIORS = (2.0, 2.0)
#: Bound of a weight.
MOST = 15.0
#: Tokens in a piece of work.
STEP = 1 << 15
#: Bytes of text made to tokens at once, and longest word that isn't hashed on its own.
BLOCK_BYTES = 1 << 20
LONG_WORD = 32
#: Words that make up over 1 / HEAD of the training tokens each: at most HEAD of them, which bounds what goes to every task.
HEAD = 1 << 20
#: Numbers in a chunk of a table that is added up, and tasks that add up one chunk, before one adds up theirs.
CHUNK = 1 << 16
SALTS = 8
#: Tasks that add up counts over texts, for each core that Spark has.
TASKS_A_CORE = 2
#: Distinct words that a task counts before it hands them on.
COUNTED = 1 << 20
#: The end token's hash stands for no word: words have no line break.
END = xxhash.xxh64_intdigest(b"\n", 42)

#: An odd base of word hashes, and odd numbers that mix bits.
BASE_ = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What a byte counts for in a word's hash: nothing if it is white space.
_VALUES = np.where(_SPACE, 0, np.arange(1, 257)).astype(np.uint64)
_GAP = re.compile(rb"[ \t-\r]")
with np.errstate(over="ignore"):
    _POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(LONG_WORD, BASE_, np.uint64)]))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of unsigned 64-bit numbers, mixed one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data``, where each begins, and its kind: a hash of its last three bytes and the first."""
    b = np.frombuffer(data, np.uint8)
    word = np.zeros(len(b) + 2, bool)
    word[1:-1] = ~_SPACE[b]
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, size = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    kind = b[starts].astype(np.uint32)
    for k in (1, 2, 3):
        kind = kind * np.uint32(257) + np.where(size >= k, b[np.maximum(starts + size - k, 0)], 0).astype(np.uint32)
    kind = (kind * np.uint32(2654435761) >> np.uint32(18)).astype(np.int32)
    b = b[starts[0] :]
    first = (starts - starts[0]).astype(np.int32)
    place = np.arange(len(b), dtype=np.int32) - np.repeat(first, np.diff(first, append=np.int32(len(b))))
    h = mixed(np.add.reduceat(_VALUES.take(b) * _POWERS.take(place, mode="clip"), first))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + size[i]], 42)
    return h, starts, kind


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of texts, an end after each text, where each text's begin (the last is where all end), and the kinds of the tokens."""
    data = b"\n".join([*((t or b"").translate(LOWER) for t in texts), b""])
    hashes, starts, kinds = [], [], []
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + BLOCK_BYTES)
        to = gap.start() if gap else len(data)
        h, s, x = word_hashes(data[at:to])
        hashes.append(h)
        starts.append(s + at)
        kinds.append(x)
        at = to
    h, begin = np.concatenate(hashes), np.concatenate(starts)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    n = np.searchsorted(begin, ends)  # words before each end
    out = np.full(len(h) + len(texts), END, np.uint64)
    stops = n + np.arange(1, len(texts) + 1)
    word = np.ones(len(out), bool)
    word[stops - 1] = False
    out[word] = h
    kind = np.zeros(len(out), np.int32)
    kind[word] = np.concatenate(kinds)
    return out, np.concatenate([[0], stops]), kind


def histories(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Feature hashes (3 x tokens) of each token's history; texts begin with none."""
    one, two = np.zeros_like(h), np.zeros_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    first = starts[:-1]
    one[first] = two[first] = 0
    two[first[np.diff(starts) > 1] + 1] = 0
    odd = np.uint64(BASE_)
    return np.stack([mixed(one + np.uint64(1)), mixed(two * odd + np.uint64(2)), mixed(one * odd ^ (two + np.uint64(3)))])


class Words:
    """Numbers of words by hash, found without search: each stands at the place of its hash or soon after."""

    def __init__(self, hashes: np.ndarray) -> None:
        size = 1 << max(4, (4 * len(hashes)).bit_length())
        self.mask = np.uint64(size - 1)
        self.key, self.number = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        todo, at = np.arange(len(hashes)), (hashes & self.mask).astype(np.int64)
        while len(todo):
            free = self.number[at] < 0
            self.number[at[free]] = todo[free]  # of several, one stays
            self.key[at[free]] = hashes[self.number[at[free]]]
            left = self.number[at] != todo
            todo, at = todo[left], (at[left] + 1) & int(self.mask)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        at = (h & self.mask).astype(np.int64)
        got = self.number[at]
        look = np.flatnonzero((self.key[at] != h) & (got >= 0))
        at = at[look]
        while len(look):
            at = (at + 1) & int(self.mask)
            got[look] = self.number[at]
            on = (self.key[at] != h[look]) & (got[look] >= 0)
            look, at = look[on], at[on]
        return got


@dataclass
class Tree:
    """Units of words: of group g those from ``first[g]`` on, ``own[g]`` of them for one word each and then ``shared[g]`` by hash."""

    first: np.ndarray
    own: np.ndarray
    shared: np.ndarray
    #: groups of words by kind
    kinds: np.ndarray

    def hashed(self, h: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Units of words that have none of their own."""
        return self.first[group] + self.own[group] + ((h >> np.uint64(20)) % self.shared[group].astype(np.uint64)).astype(np.int64)

    def hashed_column(self, h: Column, group: Column) -> Column:
        """The same of signed numbers."""
        at = lambda v: F.get(F.array(*[F.lit(int(x)) for x in v]), group)
        return at(self.first + self.own) + F.pmod(F.shiftrightunsigned(h, 20), at(self.shared))


@dataclass
class Model:
    """``w``: a table of buckets x outcomes for each level, of which each softmax has a stretch; ``bias``: softmaxes x outcomes."""

    total: int
    distinct: int
    #: hashes, counts and units of frequent words, the most frequent first, and whether a unit is theirs alone
    head: np.ndarray
    head_counts: np.ndarray
    head_units: np.ndarray
    head_own: np.ndarray
    tree: Tree
    #: (counts + 1) of the words of each unit
    mass: np.ndarray
    w: list[np.ndarray]
    bias: list[np.ndarray]
    words: Words | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "words": None}

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if self.words is None:
            self.words = Words(self.head)
        return self.words.find(h)

    def units(self, h: np.ndarray, number: np.ndarray, kind: np.ndarray) -> np.ndarray:
        out = self.head_units[number] if len(self.head) else np.zeros(len(h), np.int64)  # of unknown words, mended below
        tail = np.flatnonzero(number < 0)
        out[tail] = self.tree.hashed(h[tail], self.tree.kinds[kind[tail]])
        return out

    def own(self, number: np.ndarray) -> np.ndarray:
        return (number >= 0) & (self.head_own[number] if len(self.head) else False)


def groups_of(near: np.ndarray) -> np.ndarray:
    """Groups of the frequent words by ``near``, how often each two stand near each other.

    Words are points by the largest eigenvectors of the positive logs of observed to
    expected counts, on a sphere, and go to the nearest of ``GROUPS`` middles, which begin
    with points far apart and are then moved to the middle of theirs, weighted by counts.
    """
    n = len(near)
    if n < GROUPS:
        return np.zeros(n, np.int64)
    weight = np.maximum(near.sum(1), 1.0)
    chance = np.outer(weight, weight) / weight.sum()
    values, vectors = np.linalg.eigh(np.maximum(np.log((near + 1) / (chance + 1)), 0))
    points = vectors[:, -GROUPS:] * np.sqrt(np.maximum(values[-GROUPS:], 0))
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    middles = points[:1]
    while len(middles) < GROUPS:
        apart = ((points[:, None] - middles[None]) ** 2).sum(2).min(1)
        middles = np.vstack([middles, points[(apart * np.sqrt(weight)).argmax()]])
    for _ in range(20):
        group = ((points[:, None] - middles[None]) ** 2).sum(2).argmin(1)
        middles = np.array([np.average(points[group == g], axis=0, weights=weight[group == g]) if (group == g).any() else middles[g] for g in range(GROUPS)])
    return group


def grouped(around: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of the head's words by ``around``, how often words of each group stand near them, and groups by kind, by all of a kind together."""
    prior = 0.5 * (around.sum(0) + 1) / (around.sum() + GROUPS)
    of_kind = np.zeros((KINDS, GROUPS))
    np.add.at(of_kind, kinds, around)
    by_kind = (of_kind + prior).argmax(1)
    return np.where(around.sum(1) > 0, (around + prior).argmax(1), by_kind[kinds]), by_kind


def planted(tokens_of: np.ndarray, kinds: np.ndarray) -> Tree:
    """The tree for groups with so many tokens: each has a class, and those with the most for each class have the others."""
    classes = np.ones(GROUPS, np.int64)
    while classes.sum() < WIDTH:
        classes[(tokens_of / classes).argmax()] += 1
    units = classes * WIDTH * WIDTH
    own = units * OWN[0] // OWN[1]
    return Tree(np.cumsum(units) - units, own, units - own, kinds)


def own_units(tree: Tree, head: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of the head's words, and whether they have them alone: in each group the most frequent."""
    units, alone = tree.hashed(head, group), np.zeros(len(head), bool)
    for g in range(GROUPS):
        some = np.flatnonzero(group == g)[: tree.own[g]]
        units[some], alone[some] = tree.first[g] + np.arange(len(some)), True
    return units, alone


def biases(mass: np.ndarray) -> list[np.ndarray]:
    """Logs of the shares of the outcomes of each softmax."""
    m = np.maximum(mass, mass.sum() * 1e-9).reshape(WIDTH, WIDTH, WIDTH)
    by = m.sum((1, 2))[None], m.sum(2), m.reshape(-1, WIDTH)
    return [np.log(x / x.sum(1, keepdims=True)).astype(np.float32) for x in by]


def blank_weights(distinct: int) -> list[np.ndarray]:
    power = min(BUCKETS[1], max(BUCKETS[0], (distinct // WORDS_A_BUCKET).bit_length()))
    return [np.zeros((1 << power + 2 * level, WIDTH), np.float32) for level in range(len(NODES))]


def answers(unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the softmax that a unit is under, and its outcome there."""
    return [(np.zeros_like(unit), unit // (WIDTH * WIDTH)), (unit // (WIDTH * WIDTH), unit // WIDTH % WIDTH), (unit // WIDTH, unit % WIDTH)]


def buckets(f: np.ndarray, level: int, node: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Buckets (3 x tokens) of feature hashes, in the stretch of each token's softmax."""
    each = len(w) // NODES[level]
    return ((f >> np.uint64((40, 16, 28)[level])).astype(np.int64) & (each - 1)) + node * each


def logits(w: np.ndarray, at: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = w.take(at[0], axis=0)
    for i in at[1:]:
        z += w.take(i, axis=0)
    z += bias
    return z


def softmax(z: np.ndarray) -> np.ndarray:
    np.exp(z, out=z)  # weights are bounded, so that this is
    z /= np.einsum("ij->i", z)[:, None]
    return z


def log_probs(m: Model, f: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Natural logs of P(unit | history)."""
    out = np.zeros(len(unit))
    for a in range(0, len(unit), STEP):
        s, y = f[:, a : a + STEP], unit[a : a + STEP]
        for level, (node, answer) in enumerate(answers(y)):
            z = logits(m.w[level], buckets(s, level, node, m.w[level]), m.bias[level][node])
            got = z[np.arange(len(y)), answer]
            np.exp(z, out=z)
            out[a : a + STEP] += got - np.log(np.einsum("ij->i", z))
    return out


def near_pairs(of: np.ndarray, starts: np.ndarray):
    """Places of tokens and of those up to ``NEAR`` after them in the same text, of which ``of`` tells whether each counts."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for d in range(1, NEAR + 1):
        i = np.flatnonzero(of[:-d] | of[d:])
        i = i[text[i] == text[i + d]]
        yield i, i + d


class Near:
    """How often each two frequent words stand near each other."""

    def __init__(self, head: np.ndarray) -> None:
        self.words, self.n = Words(head[:FREQUENT]), min(FREQUENT, len(head))
        self.sums = np.zeros(self.n * self.n, np.int64)

    def add(self, h: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> None:
        number = self.words.find(h)
        for i, j in near_pairs(number >= 0, starts):
            a, b = number[i], number[j]
            both = (a >= 0) & (b >= 0)
            self.sums += np.bincount(a[both].astype(np.int64) * self.n + b[both], minlength=len(self.sums))


class Around:
    """How often words of each group stand near the words of the head."""

    def __init__(self, head: np.ndarray, group: np.ndarray) -> None:
        self.words, self.group = Words(head), group.astype(np.int64)
        self.sums = np.zeros(len(head) * GROUPS, np.int64)

    def add(self, h: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> None:
        number = self.words.find(h).astype(np.int64)
        frequent = (number >= 0) & (number < len(self.group))
        for i, j in near_pairs(frequent, starts):
            for a, b in ((i, j), (j, i)):
                ok = frequent[b] & (number[a] >= 0)
                np.add.at(self.sums, number[a[ok]] * GROUPS + self.group[number[b[ok]]], 1)


class Seen:
    """Observed counts by bucket and outcome, of all levels."""

    def __init__(self, m: Model) -> None:
        self.m = m
        self.size = [w.size for w in m.w]
        self.sums = np.zeros(sum(self.size), np.int32)

    def add(self, h: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> None:
        m, begin = self.m, 0
        f, unit = histories(h, starts), m.units(h, m.numbers(h), kinds)
        for level, (node, answer) in enumerate(answers(unit)):
            # sorted first: a table is larger than what a core has at hand
            keys = np.sort((buckets(f, level, node, m.w[level]) * WIDTH + answer).astype(np.int32), axis=None)
            ends = np.flatnonzero(np.diff(keys, append=np.int32(-1))) + 1
            self.sums[begin + keys[ends - 1]] += np.diff(ends, prepend=0).astype(np.int32)
            begin += self.size[level]


class Gradient:
    """Observed and then expected counts by bucket and outcome, of the class softmax."""

    def __init__(self, m: Model) -> None:
        self.m, self.sums = m, np.zeros(2 * m.w[0].size)

    def add(self, h: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> None:
        m, w = self.m, self.m.w[0]
        seen, expected = self.sums.reshape(2, WIDTH, -1)
        f, unit = histories(h, starts), m.units(h, m.numbers(h), kinds)
        for a in range(0, len(unit), STEP):
            node, answer = answers(unit[a : a + STEP])[0]
            at = buckets(f[:, a : a + STEP], 0, node, w)
            p = np.ascontiguousarray(softmax(logits(w, at, m.bias[0])).T)
            for i in at:
                seen += np.bincount(answer * len(w) + i, minlength=w.size).reshape(seen.shape)
                for j, row in enumerate(p):
                    expected[j] += np.bincount(i, row, len(w))


def first_step(m: Model, sums: np.ndarray) -> None:
    """Weights by the counts of :class:`Seen`; a bucket is expected to have the shares of its softmax."""
    begin = 0
    for level, w in enumerate(m.w):
        each = len(w) // NODES[level]
        for node, bias in enumerate(m.bias[level].astype(np.float64)):
            seen = sums[begin : begin + each * WIDTH].reshape(each, WIDTH).astype(np.float64)
            expected = seen.sum(1, keepdims=True) * np.exp(bias)
            w[node * each : (node + 1) * each] = np.clip(RATES[0] * (np.log(seen + PRIORS[0]) - np.log(expected + PRIORS[0])), -MOST, MOST)
            begin += each * WIDTH


def step(m: Model, sums: np.ndarray) -> None:
    """One step of the class softmax by the counts of :class:`Gradient`."""
    seen, expected = sums.astype(np.float64).reshape(2, WIDTH, -1)
    m.w[0] = np.clip(m.w[0] + RATES[1] * (np.log(seen.T + PRIORS[1]) - np.log(expected.T + PRIORS[1])), -MOST, MOST).astype(np.float32)


def summed(docs: DataFrame, text: str, make, what: object, size: int) -> np.ndarray:
    """``make(what).sums`` of all texts, added up over all tasks, of which there are about as many as cores; ``size`` numbers."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(what)

    def run(batches):
        got, any_ = make(shared.value), False
        for b in batches:
            texts = b.column(0).to_pylist()
            for x, y in by_bytes(texts):
                got.add(*tokens(texts[x:y]))
                any_ = True
        if any_:
            at = range(0, len(got.sums), CHUNK)
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK for i in at], pa.int32()), pa.array([salt] * len(at), pa.int32()), pa.array([got.sums[i : i + CHUNK].astype(np.float32).tobytes() for i in at])], ["chunk", "salt", "v"])

    texts = docs.select(F.col(text).cast("binary").alias("t")).coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    got = added_up(texts.mapInArrow(run, "chunk int, salt int, v binary"))
    shared.destroy()
    return np.concatenate([got[i] for i in sorted(got)]) if got else np.zeros(size, np.float32)


def added_up(changes: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the vectors ``v`` (float32 bytes) by ``chunk``; each task holds one vector for each of its chunks."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("chunk").to_pylist(), b.column("v")):
                x = np.frombuffer(v.as_buffer(), np.float32)
                sums[k] = sums[k] + x if k in sums else x.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()])], ["chunk", "salt", "v"])

    schema = "chunk int, salt int, v binary"
    changes = changes.repartition("chunk", "salt").mapInArrow(add, schema)
    rows = changes.repartition("chunk").mapInArrow(add, schema).collect()  # as many as the model has chunks
    return {r["chunk"]: np.frombuffer(r["v"], np.float32) for r in rows}


def train(m: Model, docs: DataFrame, text: str, key: str) -> None:
    """Trains ``m``: a step by the counts of all of ``docs``, and rounds of the class softmax, over which they are dealt by the hash of ``key``."""
    first_step(m, summed(docs, text, Seen, m, sum(w.size for w in m.w)))
    done = 0
    for share in ROUNDS:
        deal = F.pmod(F.xxhash64(key), F.lit(sum(ROUNDS)))
        part = docs.where((deal >= done) & (deal < done + share))
        done += share
        step(m, summed(part, text, Gradient, m, 2 * m.w[0].size))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``(h, kind, n)``: the hash of each word and of the end token, as a signed number, its kind and its count; added up within tasks first."""

    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, first, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            return h, np.concatenate([p[1] for p in parts])[first], np.bincount(back, np.concatenate([p[2] for p in parts]), len(h)).astype(np.int64)

        def batch(h: np.ndarray, kind: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind), pa.array(n)], ["h", "kind", "n"])

        for b in batches:
            texts = b.column(0).to_pylist()
            for x, y in by_bytes(texts):
                h, _, kind = tokens(texts[x:y])
                own, first, n = np.unique(h, return_index=True, return_counts=True)
                parts.append((own, kind[first], n))
                size += len(parts[-1][0])
                if size > COUNTED:
                    parts = [merged()]
                    size = len(parts[0][0])
                    if size > COUNTED // 2:
                        yield batch(*parts[0])
                        parts, size = [], 0
        if parts:
            yield batch(*merged())

    rows = docs.select(F.col(text).cast("binary")).mapInArrow(run, "h long, kind int, n long")
    return rows.groupBy("h").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model of ``docs`` and the table of all counts, ``(h, kind, n)``.

    Rows with equal keys, null ones too, are in one round together. An empty table
    gives a model in which every word is unknown.
    """
    small_batches(docs.sparkSession)
    counts = table(word_counts(docs, text), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("n") * head > total).toArrow()  # under ``head`` rows, as counts add up to the total
    h, n, kind = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy(), top["kind"].to_numpy()
    order = np.lexsort((h, -n))
    h, n, kind = h[order], n[order], kind[order]

    frequent = min(FREQUENT, len(h))
    near = summed(docs, text, Near, h, frequent * frequent).reshape(frequent, frequent)
    seeds = groups_of((near + near.T).astype(np.float64))
    around = summed(docs, text, lambda x: Around(*x), (h, seeds), len(h) * GROUPS).reshape(-1, GROUPS).astype(np.float64)
    group, by_kind = grouped(around, kind)

    small = docs.sparkSession.createDataFrame([(i, int(g)) for i, g in enumerate(by_kind)], "kind int, g int")
    rest = counts.where(F.col("n") * head <= total).join(F.broadcast(small), "kind")  # as many rows as there are kinds
    of_group = np.bincount(group, n + 1, GROUPS)
    for r in rest.groupBy("g").agg(F.sum(F.col("n") + 1).alias("n")).collect():
        of_group[r["g"]] += r["n"]
    tree = planted(of_group, by_kind)
    units, alone = own_units(tree, h, group)
    mass = np.bincount(units, n + 1, UNITS)
    for r in rest.groupBy(tree.hashed_column(F.col("h"), F.col("g")).alias("unit")).agg(F.sum(F.col("n") + 1).alias("n")).collect():  # no more than units
        mass[r["unit"]] += r["n"]
    for first, own, shared in zip(tree.first, tree.own, tree.shared):
        mass[first + own : first + own + shared] += 1  # words that no training text has
    m = Model(total, distinct, h, n, units, alone, tree, mass, blank_weights(distinct), biases(mass))
    train(m, docs, text, key)
    return m, counts


SCORES = "n_tokens long, known long, base double, model double, tail array<struct<h:bigint,n:int>>"


def scorer(m: Model):
    """A function of texts to ``SCORES``: sums over units and frequent words, and the other words with how often they occur."""
    ln10 = math.log(10)
    log_mass = np.log10(np.maximum(m.mass, 1.0))
    log_base = np.log10(m.total + m.distinct + 1)
    log_count = np.log10(m.head_counts + 1.0)
    kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))

    def work(texts):
        h, starts, kinds = tokens(texts)
        docs, n = len(texts), np.diff(starts)
        number = m.numbers(h)
        known = number >= 0
        unit = m.units(h, number, kinds)
        count = np.where(known, log_count[number] if len(log_count) else 0.0, 0.0)
        given = log_probs(m, histories(h, starts), unit) / ln10 + np.where(m.own(number), 0.0, count - log_mass[unit])
        row = np.repeat(np.arange(docs), n)
        sums = lambda v: np.bincount(row, v, docs)
        rest = np.flatnonzero(~known)
        order = rest[np.lexsort((h[rest], row[rest]))]
        first = np.flatnonzero(np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (row[order[1:]] != row[order[:-1]])])) if len(order) else rest
        times = np.diff(np.append(first, len(order))).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(h[order[first]].view(np.int64)), pa.array(times)], fields=list(kind.value_type))
        at = np.searchsorted(row[order[first]], np.arange(docs + 1)).astype(np.int32)
        return {"n_tokens": n, "known": sums(known).astype(np.int64), "base": sums(count - log_base), "model": sums(given), "tail": pa.ListArray.from_arrays(pa.array(at), values)}

    return work


def score(docs: DataFrame, model: Model, counts: DataFrame, keys: dict[str, Column | str], text: str = "text") -> DataFrame:
    """``keys`` and ``n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Null and empty texts are the end token alone; long texts are worked on whole.
    Repeated rows keep their rows, and null keys stay; other columns of ``docs`` are
    not read, so that their names can't clash; no rows give none. Words are told
    apart by their 64-bit hash.
    """
    cast = docs.sparkSession.sparkContext.broadcast(model)
    rows = table(map_texts(docs, {"__row": F.monotonically_increasing_id(), **keys}, text, lambda: scorer(cast.value), SCORES), "lm-scores")
    rest = rows.select("__row", F.explode("tail").alias("x")).select("__row", "x.*")
    known = counts.select("h", F.col("n").alias("c"))
    # words that no training text has add nothing
    more = rest.join(known, "h").groupBy("__row").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("s"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    out = rows.drop("tail").join(more, "__row", "left")
    return out.select(
        *keys, "n_tokens", (F.col("known") + zero("k")).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("s")).alias("base_score"), (F.col("model") + zero("s")).alias("score"),
    )
