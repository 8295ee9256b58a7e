"""Whitening, token files and ranked search against brute force, the library itself and odd tables."""

import collections
import glob
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from docmill.llm import lexical, queries, token_files, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t ", "en", "s", 0), (4, "one", "en", None, 3), (5, "one", "en", "t", 3), (5, "one", "en", "t", 3), (6, LONG, "en", "s", 1), (None, "no id here", "en", "s", 1)]


def clash(df):
    """``df`` with columns named as those of results and inner steps."""
    return df.withColumns({c: F.lit("x") for c in ("x", "w", "n", "node", "component", "part", "offset", "start", "ids", "h", "row", "id", "shard", "term", "rank", "score", "__id", "__th", "n_lines")})


# 11


def slow_whitening(vectors, most=32):
    """Deviations, whitened rows and shares, by the covariance itself."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    mid = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    e, v = np.linalg.eigh(mid.T @ mid / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(most, len(e))
    return deviation, mid @ v[:, :k], e, e[:k] / e.sum()


@pytest.mark.parametrize("parts", [1, 20])
def test_whitening(spark, parts):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in e.collect()}
    keys = list(vectors)
    deviation, projected, var, shares = slow_whitening([vectors[k] for k in keys])
    got = collections.defaultdict(dict)
    for r in whitening.whiten(clash(e).repartition(parts, "vec_id")).collect():
        got[r["vec_id"]][r["component"]] = r
    assert sorted(got) == sorted(keys) and all(sorted(c) == list(range(1, 33)) for c in got.values())
    w = np.array([[got[k][c + 1]["whitened"] for c in range(32)] for k in keys])
    want = projected / np.sqrt(var[:32])
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * sign).max() < 1e-8
    for k, d in zip(keys, deviation):
        r = got[k][1]
        assert (r["n"], r["deviation"]) == (len(keys), d) and r["identity_error"] < 1e-9
    assert np.allclose([got[keys[0]][c + 1]["explained"] for c in range(32)], shares, rtol=1e-9)


def test_whitening_summaries_lose_nothing():
    rnd = np.random.default_rng(3)
    x = rnd.integers(-500, 500, (300, 12)) + 1_000_000
    x[:, 11] = x[:, 0]  # one dimension less
    parts = [whitening.Summary.of(x[a:b]) for a, b in ((0, 1), (1, 5), (5, 120), (120, 300))]
    left = parts[0].merge(parts[1]).merge(parts[2]).merge(parts[3])
    right = parts[3].merge(parts[2].merge(parts[1].merge(parts[0])))
    mid = x - x.mean(axis=0)
    for s in (left, right):
        assert s.n == 300 and s.sums == x.sum(axis=0).tolist() and len(s.values) == 12
        assert np.allclose((s.values[:, None] * s.vectors).T @ (s.values[:, None] * s.vectors), mid.T @ mid, rtol=1e-9, atol=1e-6)
    assert left.values[-1] < 1e-9 * left.values[0]


VECTORS = "vec_id long, embedding array<float>"


def test_whitening_odd(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, -1.0]), (None, [3.0, 0.0])]
    bad = [(4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, -inf]), (9, [])]
    got = whitening.whiten(spark.createDataFrame(good + bad, VECTORS)).collect()
    deviation, projected, var, _ = slow_whitening([v for _, v in good])
    assert collections.Counter((r["vec_id"], r["component"], r["deviation"]) for r in got) == collections.Counter((i, c, d) for (i, _), d in zip(good, deviation) for c in (1, 2))
    for (i, _), p in zip(good, projected):
        assert any(r["vec_id"] == i and r["component"] == 1 and abs(abs(r["whitened"]) - abs(p[0]) / math.sqrt(var[0])) < 1e-9 for r in got)
    for rows in ([], bad):
        none = whitening.whiten(spark.createDataFrame(rows, VECTORS))
        assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], VECTORS)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in same)
    few = whitening.whiten(spark.createDataFrame([(1, [float(i) for i in range(40)]), (2, [1.0] * 40)], VECTORS)).collect()
    assert len(few) == 64 and [r["component"] for r in few if r["vec_id"] == 1 and r["whitened"] is not None] == [1]
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 2.0]), (2, [-3e38, 1.0])], VECTORS)).collect()
    assert {r["deviation"] for r in huge} == {None}
    with pytest.raises(Exception, match="one length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], VECTORS).coalesce(1))


def test_exact_deviations():
    x = np.array([[10**6 + 5, 10**6 - 7], [10**6, 10**6 + 1], [10**6 + 2**40, 10**6]], np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    want = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, 3, sums) == [v if v < 1 << 63 else None for v in want]


# 12


@pytest.fixture(scope="module")
def byte_bpe():
    return queries.tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(byte_bpe):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe)


def test_encoder(byte_bpe, library, monkeypatch):
    """Any mix of words, blanks of all kinds and special strings, against the library."""
    rnd = random.Random(12)
    bits = ["a", "Word", "'s", "12", "é", "漢字", "🙂", " ", " ", " ", "  ", "   ", "\n", "\t", "\r\n", " ", " ", "\x0b", "\x1c", "\u0085", "<|endoftext|>", "<|endoft", "|>", "!", "..."]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 14))) for _ in range(4000)] + ["", " ", "  ", "   ", " a", "a ", "a  ", " \n a", LONG, "x" * 70_000, None]
    encode = token_files.encoder_of(byte_bpe)
    ids, sizes = encode(pa.array(texts, pa.string()))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes)] == want
    plain = token_files.Encoder(byte_bpe)
    plain.mark = None
    again, more = plain(pa.array(texts[:500], pa.string()))
    assert more.tolist() == sizes[:500].tolist() and again.tolist() == ids[: ends[499]].tolist()
    for most in (50, 300):  # words are remembered, or forgotten
        monkeypatch.setattr(token_files, "KNOWN_WORDS", most)
        small = token_files.Encoder(byte_bpe)
        for k in range(0, 1000, 50):
            some, n = small(pa.array(texts[k : k + 50], pa.string()))
            assert n.tolist() == sizes[k : k + 50].tolist() and some.tolist() == ids[ends[k] - sizes[k] : ends[k + 49]].tolist()
    plain.by_words = False
    assert plain(pa.array(texts[:500], pa.string()))[0].tolist() == ids[: ends[499]].tolist()


def slow_files(rows, library, order):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=order):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def test_token_files(spark, library):
    """The query against the library, document by document."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op12_token_files(spark, SF).collect())
    assert got == slow_files(rows, library, lambda r: r[0])


def test_token_files_odd(spark, byte_bpe, library, tmp_path):
    docs = clash(spark.createDataFrame(ODD, DOCS).drop("ids")).repartition(3)
    token_files.write(docs, str(tmp_path / "odd"), byte_bpe)
    got = token_files.digests(spark, str(tmp_path / "odd")).collect()
    want = slow_files([(r[0], r[1]) for r in ODD], library, lambda r: -1 if r[0] is None else r[0])
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    token_files.write(spark.createDataFrame([], DOCS), str(tmp_path / "none"), byte_bpe)
    assert token_files.digests(spark, str(tmp_path / "none")).count() == 0


def test_token_files_one_id(spark, byte_bpe, tmp_path, monkeypatch):
    """One id with a third of the rows is dealt to several files, which stay in order."""
    rows = [(7 if i % 3 == 0 else i, f"text {i}") for i in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), str(tmp_path / "hot"), byte_bpe)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sent = sorted(map(tuple, token_files.read(spark, str(tmp_path / "hot")).collect()))
    monkeypatch.setattr(token_files, "MOST_FILES", 0)
    back = token_files.read(spark, str(tmp_path / "hot"))
    assert sorted(map(tuple, back.collect())) == sent
    parts = {p: (a, b) for p, a, b in back.groupBy("part").agg(F.min("doc_id"), F.max("doc_id")).collect()}
    assert len(parts) > 2 and sum(a <= 7 <= b for a, b in parts.values()) > 1
    assert [p[0] for p in sorted(parts.values())] == [parts[k][0] for k in sorted(parts)] and all(parts[a][1] <= parts[b][0] for a, b in zip(sorted(parts), sorted(parts)[1:]))
    placed = sorted(back.select("start", "n_tokens", "doc_id", F.size("ids").alias("n")).collect())
    assert all(a["start"] + a["n_tokens"] == b["start"] and a["doc_id"] <= b["doc_id"] for a, b in zip(placed, placed[1:])) and all(r["n"] == r["n_tokens"] for r in placed) and len(placed) == 600


def scanned(df):
    """Rows that the scan of ``df`` gave, as its metric says."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_token_files_prune(spark, byte_bpe, library, tmp_path):
    """Row indexes leave out row groups beyond an id, Bloom filters those between whose ids it stands."""
    rows = [(2 * i, f"number {i}") for i in range(40_000)]
    path = str(tmp_path / "many")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, byte_bpe, options={"orc.row.index.stride": "1000", "orc.stripe.size": "16384"})
    held = token_files.lookup(spark, path, [20_002])
    assert [tuple(r) for r in held.collect()] == [(20_002, [*library.encode("number 10001", add_special_tokens=False).ids, 0])]
    assert 0 < scanned(held) <= 4000
    absent = [20_001 + 2 * i for i in range(0, 400, 40)]  # between ids that are there
    assert sum(scanned(token_files.lookup(spark, path, [i])) for i in absent) <= 2 * 1000
    assert "doc_id" in str(held._jdf.queryExecution().executedPlan()) and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,20002)]" in str(held._jdf.queryExecution().executedPlan())
    from pyarrow import orc

    assert sum(orc.ORCFile(f).nstripes for f in glob.glob(f"{path}/*.orc")) >= 4


# 13


def slow_search(docs, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, collections.Counter(words(t))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in words(text) if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return collections.Counter(out)


def ranked(spark, docs, items, k=10):
    index = lexical.build(docs)
    got = collections.Counter(tuple(r) for r in lexical.search(index, items, k).collect())
    index.drop()
    return got


def test_search_odd(spark, monkeypatch):
    """Small shards and blocks, copies, nulls and clashing names."""
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 64)
    rnd = random.Random(13)
    word = lambda: rnd.choice(["a", "b", "the", "The", "x1", "é", "ÉA", "漢", "foo_bar", "z" * 50, "Ｗ"])
    rows = [(i, " ".join(word() for _ in range(rnd.randint(0, 30)))) for i in range(200)] + [(300 + i, "the same foo") for i in range(40)] + [(r[0], r[1]) for r in ODD]
    items = [(i, " ".join(word() for _ in range(rnd.randint(0, 8)))) for i in range(12)] + [(50, None), (51, ""), (52, "same Same w3"), (52, "same Same w3"), (None, "one no_id"), (53, "nowhere")]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    asked = clash(spark.createDataFrame(items, "item_id long, text string"))
    assert ranked(spark, docs, asked) == slow_search(rows, items)
    assert ranked(spark, docs, asked, 3) == slow_search(rows, items, 3)


def test_search_empty(spark):
    none = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert not ranked(spark, none, some) and not ranked(spark, spark.createDataFrame(ODD, DOCS).where("doc_id < 4"), some)
    got = lexical.search(lexical.build(spark.createDataFrame(ODD, DOCS)), spark.createDataFrame([], "item_id long, text string"))
    assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_stops_early(monkeypatch):
    """Adding up ends before all postings are met, with the same documents."""
    rnd = random.Random(1)
    texts = [" ".join(["t" + str(i % 150)] * rnd.randint(1, 3) + rnd.choices(["of", "to", "and", *["w" + str(j) for j in range(60)]], k=40)) for i in range(3000)]
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
    rows = pa.Table.from_batches(list(lexical.shard_rows(0, pa.array(range(3000)), pa.array([t.encode() for t in texts]), schema)))
    n_docs, n_terms = 3000, sum(len(t.split()) for t in texts)
    df = collections.Counter(t for x in texts for t in set(x.split()))
    completed = []
    monkeypatch.setattr(lexical.Shard, "complete", lambda self, docs, *a, f=lexical.Shard.complete: completed.append(len(docs)) or f(self, docs, *a))
    shard = lexical.Shard(rows, {t: lexical.weight(n_docs, n) for t, n in df.items()}, n_docs, n_terms)
    for i in range(40):
        text = f"of to and t{i} of t{i}"
        docs, scores = shard.best(collections.Counter(text.split()), 10)
        want = slow_search(list(enumerate(texts)), [(0, text)])
        assert collections.Counter((0, r + 1, int(d), int(s)) for r, (d, s) in enumerate(zip(docs, scores))) == want
    assert len(completed) > 10 and max(completed) <= 80
