"""Language identification: averaged hashed subword embeddings and a linear softmax.

A word gives its hashed character n-grams; a text is the mean of their embeddings,
and a linear layer and softmax give the languages. Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows; temperature and
rejection threshold are set on labelled rows kept out of the training.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_batches

BUCKETS = 1 << 15
DIM = 16
ORDERS = (1, 2, 3, 4)
#: Labelled rows to fit on, for each language; the model is fit on a sample of this bound and no more.
SAMPLE_PER_LANGUAGE = 600
#: Bound of that sample over all languages; what reaches the driver of a row is at most a count for each bucket.
SAMPLE_ROWS = 6000
#: Words whose sums a worker keeps; when there are more, it begins anew.
CACHE_WORDS = 400_000
UNDETERMINED = "und"

#: Characters of words that aren't letters: numbers that have no place value.
_NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isdecimal() and not c.isalpha())
_WORD = re.compile(r"[^\W\d_]+")
_STRICT = re.compile(f"[^\\W\\d_{''.join(sorted(_NUMBERS))}]+")
#: Odd numbers that mix the characters of an n-gram.
_MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def words_of(text: bytes | None) -> list[str]:
    """Runs of letters of a text in lower case."""
    t = text.decode("utf-8", "replace").lower() if text else ""
    # the strict pattern is slow, and few texts need it
    return (_WORD if t.isascii() or _NUMBERS.isdisjoint(t) else _STRICT).findall(t)


def subwords(words: list[str], buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each ``<word>``, and the place in ``words`` of the one that each is of; by order, then place."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters to the word's end
    at, of = [], []
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(orders) + 1):
        h = h[: len(codes) - n + 1] * _MIX[0] + codes[n - 1 :]
        if n in orders:
            whole = left[: len(h)] >= n
            x = (h[whole] + np.uint32(n)) * _MIX[1]
            at.append(((x ^ (x >> np.uint32(15))) % np.uint32(buckets)).astype(np.int64))
            of.append(owner[: len(h)][whole])
    return np.concatenate(at), np.concatenate(of)


@dataclass
class Model:
    """``scores``: a row of logits for each bucket (embedding times the linear layer)."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    orders: tuple[int, ...] = ORDERS


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int, least_steps: int = 3000, epochs: int = 8, rate: float = 2.0, batch: int = 16, seed: int = 1, buckets: int = BUCKETS, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """``(embeddings times linear layer, bias)`` by SGD over ``(buckets, weights)`` bags whose weights add up to one."""
    rng = np.random.default_rng(seed)
    epochs = max(epochs, -(-least_steps * batch // max(1, len(bags))))
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    lin, bias = rng.normal(0, 0.1, (dim, k)), np.zeros(k)
    n, step, steps = len(bags), 0, max(1, epochs * -(-len(bags) // batch))
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            rows = order[a : a + batch]
            now = rate * (1 - step / steps)
            step += 1
            mean = np.array([w @ emb[b] for b, w in (bags[r] for r in rows)])
            p = softmax(mean @ lin + bias)
            p[np.arange(len(rows)), labels[rows]] -= 1
            back = p @ lin.T
            lin -= now / len(rows) * (mean.T @ p)
            bias -= now / len(rows) * p.sum(0)
            for g, r in zip(back, rows):
                b, w = bags[r]
                emb[b] -= now * w[:, None] * g
    return emb @ lin, bias


def calibrate(z: np.ndarray, labels: np.ndarray, precision: float = 0.99) -> tuple[float, float]:
    """The temperature of least log loss, and the least score from which held-out answers are right ``precision`` of the time."""
    if not len(z):
        return 1.0, 0.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    losses = [-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), labels], 1e-12)).mean() for t in grid]
    t = float(grid[int(np.argmin(losses))])
    p = softmax(z / t)
    top, right = p.max(1), p.argmax(1) == labels
    order = np.argsort(-top, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(z) + 1)
    good = np.flatnonzero(share >= precision)
    return t, float(top[order][good[-1]]) if len(good) else 1.0


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    grams, _ = subwords(words_of(text))
    b, n = np.unique(grams, return_counts=True)
    return b, n / max(1, n.sum())


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model of the rows of ``labelled`` with text and label, repeated rows once.

    About ``per_language`` rows of each language are taken by the hash of ``key`` and
    text, or about ``SAMPLE_ROWS`` in all if the languages are many: a sample that any
    partitioning gives alike. Texts are counted whole, where they are; n-gram counts, not
    texts, reach the driver. Without labelled rows the model has no language.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    most = min(per_language, SAMPLE_ROWS / len(languages))
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, most / n))])
    # the hash as a number from 0 to 1
    u = (F.col("h").cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    sample = rows.where(u <= share[F.col("lang")]).dropDuplicates(["h", "lang"])

    def count(batches):
        for b in batches:
            texts, langs, hs = (b.column(n).to_pylist() for n in ("text", "lang", "h"))
            bags = [bag(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs), pa.array(hs, pa.int64()), pa.array([x[0].astype(np.int32) for x in bags], pa.list_(pa.int32())), pa.array([x[1].astype(np.float32) for x in bags], pa.list_(pa.float32()))],
                ["lang", "h", "b", "w"],
            )

    small_batches(spark)
    got = sample.mapInArrow(count, "lang string, h long, b array<int>, w array<float>").toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    bags = [(np.array(b, np.int64), np.array(w)) for b, w in zip(got["b"].to_pylist(), got["w"].to_pylist())]
    labels = np.array([languages.index(x) for x in got["lang"].to_pylist()], np.int64)
    some = np.array([len(b) > 0 for b, _ in bags], bool)
    held = np.arange(len(bags)) % 5 == 4
    use = np.flatnonzero(some & ~held)
    scores, bias = train([bags[i] for i in use], labels[use], len(languages))
    tune = np.flatnonzero(some & held)
    z = np.array([bags[i][1] @ scores[bags[i][0]] + bias for i in tune]).reshape(-1, len(languages))
    return Model(languages, scores.astype(np.float32), bias, *calibrate(z, labels[tune]))


def predictor(model: Model):
    """A function of texts to ``lang_pred, score, accepted``; words are summed once and kept."""
    index: dict[str, int] = {}
    k = len(model.languages)
    sums = np.zeros((1 << 12, k + 1), np.float32)  # logits, n-grams

    def learn(new: list[str]) -> None:
        grams, of = subwords(new, len(model.scores), model.orders)
        n = len(index)
        index.update(zip(new, range(n, n + len(new))))
        for j in range(k):
            sums[n : n + len(new), j] = np.bincount(of, model.scores[grams, j], len(new))
        sums[n : n + len(new), k] = np.bincount(of, minlength=len(new))

    def work(texts: list[bytes | None]) -> dict:
        nonlocal sums
        if len(index) > CACHE_WORDS:
            index.clear()
        words = list(map(words_of, texts))
        new = list(set().union(*words) - index.keys())
        if len(index) + len(new) > len(sums):
            sums = np.concatenate([sums, np.zeros((len(index) + len(new), k + 1), np.float32)])
        for a in range(0, len(new), 50_000):
            learn(new[a : a + 50_000])
        langs: list[str] = []
        score = np.zeros(len(texts))
        for i, ws in enumerate(words):
            if not ws or not k:
                langs.append(UNDETERMINED)
                continue
            s = sums[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))].sum(0, dtype=np.float64)
            p = softmax(((s[:-1] / s[-1] + model.bias) / model.temperature)[None])[0]
            best = int(p.argmax())
            langs.append(model.languages[best])
            score[i] = p[best]
        return {"lang_pred": langs, "score": score, "accepted": (score >= model.threshold) & np.array([bool(w and k) for w in words], bool)}

    return work


def identify(docs: DataFrame, model: Model, keys: dict[str, F.Column | str], text: str = "text") -> DataFrame:
    """``keys`` and ``lang_pred, score, accepted`` for every row.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned; long texts count as wholes; other columns are not read, so that their
    names can't clash; else a learned
    language with its calibrated probability, ``accepted`` if that reaches the
    rejection threshold. Repeated rows keep their rows; no rows give none.
    """
    cast = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, keys, text, lambda: predictor(cast.value), "lang_pred string, score double, accepted boolean")


def fold(doc_id: str = "doc_id", of: int = 3) -> F.Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of
