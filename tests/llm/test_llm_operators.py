"""The ten operators against brute force, round trips, held-out accuracy and odd tables."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from conftest import SF
from oracle import agree
from pyspark.sql import functions as F

from docmill.llm import decontaminate, language, licenses, lines, maxent, quality, queries, sentencepiece, simhash, token_counts, warc
from docmill.llm.common import by_bytes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t ", "en", "s", 0), (4, "one", "en", None, 3), (5, "one", "en", "t", 3), (5, "one", "en", "t", 3), (6, LONG, "en", "s", 1), (None, "no id here", "en", "s", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    agree(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name])


def clash(df):
    """``df`` with columns named as those of results and inner steps."""
    return df.withColumns({c: F.lit("x") for c in ("fp", "h", "path", "drop", "kept", "n_words", "ids", "key", "component_id", "title", "__cut", "n_lines", "n_removed_lines", "__id", "__th", "__id2", "__th2", "__doc", "__drop", "__new", "__kept", "root", "sig", "n", "site", "host", "a.b")})


def test_by_bytes():
    assert list(by_bytes([b"a" * 3, b"b" * 3, None, b"c" * 9, b""], 6)) == [(0, 3), (3, 4), (4, 5)]
    assert list(by_bytes([])) == []


# 1


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    ids = list(range(len(rows)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2:
                ids[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return collections.Counter((r[0], f"{r[1]:016x}", least.get(root(i))) for i, r in enumerate(rows))


def test_simhash(spark, docs, odd):
    some = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    rows = [(r["doc_id"], slow_fingerprint(r["text"])) for r in some.collect()]
    got = collections.Counter(tuple(r) for r in simhash.near_duplicates(clash(some)).collect())
    assert got == slow_components(rows)


def signed64(v):
    return v - (1 << 64) if v >> 63 else v


def test_simhash_large_buckets(spark, monkeypatch):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = set()
    for b in base:
        for _ in range(60):
            v = b
            for _ in range(rnd.randint(0, 4)):
                v ^= 1 << rnd.randrange(64)
            fps.add(v)
    signed = [signed64(v) for v in fps]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    got = {r["a"]: r["root"] for r in simhash.components(edges).collect()}
    rows = [(v, v & (2**64 - 1)) for v in signed]
    want = {r[0]: r[2] for r in slow_components(rows)}
    assert {v: got.get(v, v) for v in signed} == want


def test_golay_keys_meet():
    rnd = random.Random(1)
    t = simhash.golay_tables()
    assert len(set(t[1].tolist())) == 2048
    a = np.array([signed64(rnd.getrandbits(64)) for _ in range(500)], np.int64)
    b = a.copy().view(np.uint64)
    for i in range(len(b)):
        for k in rnd.sample(range(64), rnd.randint(0, 2)):
            b[i] ^= np.uint64(1 << k)
    keys = [collections.defaultdict(set), collections.defaultdict(set)]
    for out, v in zip(keys, (a, b.view(np.int64))):
        for r, k in zip(*simhash.golay_keys(v, t)):
            out[r].add(k)
    assert all(keys[0][i] & keys[1][i] for i in range(500)) and max(map(len, keys[0].values())) <= 18


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    got = {r["a"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_keep_one(spark, odd):
    for some in (odd, clash(odd)):
        got = simhash.keep_one(some)
        assert sorted((r["doc_id"] for r in got.collect()), key=str) == [1, 4, 6, None] and got.columns == some.columns


def jaccard(a, b):
    one, two = (set(simhash.shingle_set(t.encode()).tolist()) for t in (a, b))
    return len(one & two) / len(one | two)


def test_keep_one_finds_near_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    rnd = random.Random(3)
    passage = [f"p{k}" for k in range(30)]
    texts = []
    for k in range(60):
        words = (passage if k % 2 else []) + [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([20, 60, 150, 400]))]
        texts.append(" ".join(words))
        for edits in (1, 2, 4, 7):
            copy = list(words)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(3000)}"
            texts.append(" ".join(copy))
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    sims = {(a, b): jaccard(texts[a], texts[b]) for a in range(len(texts)) for b in range(a)}
    for (a, b), v in sims.items():
        if v >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert sum(0.8 <= v < 0.95 for v in sims.values()) > 20 and any(0.7 < v < 0.8 for v in sims.values())
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted({find(k) for k in range(len(texts))})


def test_keep_one_by_fingerprints(spark, monkeypatch):
    """Copies whose fingerprints link by Golay keys are candidates of the first round, and verified by their sets."""
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    fp = lambda ws: int(simhash.fingerprint_batch([" ".join(ws).encode()], 5)[0])
    edited = ([*words[:k], "other", *words[k + 1 :]] for k in range(0, 3000, 7))
    near = next(ws for ws in edited if 1 <= ((fp(ws) ^ fp(words)) & (2**64 - 1)).bit_count() <= 2)
    texts = [" ".join(words), " ".join(near), " ".join(f"v{k}" for k in range(50))]
    found, linked_sets = [], simhash.linked_sets

    def seen(reps):
        got = linked_sets(reps)
        found.extend((r["a"], r["b"]) for r in got.collect())
        return got

    monkeypatch.setattr(simhash, "linked_sets", seen)
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate([*texts, texts[2]])], DOCS)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [0, 2]
    assert len(found) == 1


def test_blocks_are_compared_by_parts(monkeypatch):
    """No table of all sets by all hashes of two blocks: so many hashes at a time, with the same pairs."""
    rnd = random.Random(7)
    widest, zeros = [], np.zeros

    def made(shape, *args):
        widest.append(shape[1] if isinstance(shape, tuple) else 0)
        return zeros(shape, *args)

    def block(start):
        sets = [np.array(sorted({50, *rnd.sample(range(1, 50), 3), *rnd.sample(range(51, 100), rnd.randrange(5, 40)), *rnd.sample(range(1000, 90000), 60)})) for _ in range(20)]
        return np.arange(start, start + 20), np.array([len(p) + 3 for p in sets]), np.arange(start, start + 20) // 3, sets

    one, two = block(0), block(20)
    monkeypatch.setattr(simhash, "ALIKE", (1, 12))
    want = {}
    for y in (one, two):
        want[y is one] = simhash.close_in_blocks(50, one, y)
    monkeypatch.setattr(simhash, "COLUMNS", 7)
    monkeypatch.setattr(simhash.np, "zeros", made)
    for y in (one, two):
        for a, b in zip(simhash.close_in_blocks(50, one, y), want[y is one]):
            assert a.tolist() == b.tolist()
        assert len(want[y is one][0])
    for i in range(20):
        for j in range(20):
            p, q = one[3][i], two[3][j]
            common, end = len(set(p) & set(q)), min(p[-1], q[-1])
            most = min(common + min(one[1][i] - sum(p <= end), two[1][j] - sum(q <= end)), one[1][i], two[1][j])
            ok = min(set(p) & set(q)) == 50 and one[2][i] != two[2][j] and most * 13 >= (one[1][i] + two[1][j])
            assert ok == ((i, j) in set(zip(*(v.tolist() for v in want[False]))))
    assert max(widest) == 20  # the products; the tables are narrower


# 2


def test_licenses(spark):
    rows = [("a/LICENSE", "MIT License\n\nReleased under the MIT License."), ("a/b/x.txt", "nothing"), ("a/b/y.txt", "words\nLicensed under the Apache License, Version 2.0.\nmore"), ("z.txt", None), ("a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/e.txt", "the license of a bird is to sing and so it goes on and on"), (None, ""), ("a/b/x.txt", "nothing")]
    got = collections.Counter((r["path"], r["license"], r["origin"], r["inherited_from"]) for r in licenses.scan(clash(spark.createDataFrame(rows, "path string, text string").withColumnRenamed("path", "p")).drop("path").withColumnRenamed("p", "path")).collect())
    assert got == collections.Counter(
        [("a/LICENSE", "MIT", "file", None), ("a/b/x.txt", "MIT", "directory", "a/LICENSE"), ("a/b/x.txt", "MIT", "directory", "a/LICENSE"), ("a/b/y.txt", "Apache-2.0", "file", None), ("z.txt", None, None, None), ("a/b/c/COPYING.txt", "GPL-3.0", "file", None), ("a/b/c/d/e.txt", "GPL-3.0", "directory", "a/b/c/COPYING.txt"), ("", None, None, None)]
    )
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_license_headers(spark):
    """Headers wrapped over lines behind comment signs, and clauses of licence files; near misses aren't taken."""

    def wrapped(text, sign, width=9):
        words = text.split()
        return "\n".join(sign + " ".join(words[i : i + width]) for i in range(0, len(words), width))

    long_ones = [(name, t) for name, t in licenses.TEMPLATES if len(t) > 120]
    rows = [(f"{k}.py", f"#!/bin/run\n#\n{wrapped(t, '# ')}\n#\nimport words\n" + "\n".join(f"call {i} of things" for i in range(50))) for k, (_, t) in enumerate(long_ones)]
    rows += [("x/COPYING", f"Some License\n\nCopyright 2020 Someone\n\n{wrapped(dict(long_ones)['MIT'], '')}\n\nMore conditions."), ("x/a.c", "int main"), ("y.c", "free software\nand a copy of it\nfor any purpose\nthat birds have in their own old gardens"), ("z.c", "\n\n\n")]
    got = {r["path"]: (r["license"], r["line_no"], r["origin"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[f"{k}.py"] for k in range(len(long_ones))] == [(name, 2, "file") for name, _ in long_ones]
    assert got["x/COPYING"] == ("MIT", 4, "file") and got["x/a.c"] == ("MIT", None, "directory") and got["y.c"][0] is None and got["z.c"][0] is None


def test_license_lines(spark):
    """Usual lines alone and in files; other versions, near misses and sentences in long lines."""
    said = {
        "# SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0", "; SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
        "Copyright 2020 Foo. Licensed under the MIT License.": "MIT", "Eclipse Public License - v 2.0": "EPL-2.0", "Licensed under the BSD 2-Clause License.": "BSD-2-Clause",
        "Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
        "This is the code of a small thing that somebody wrote in a summer; Licensed under the Apache License, Version 2.0. Read on and on for what else there is to say about it": "Apache-2.0",
        "Licensed under the Apache License, v2": "Apache-2.0", "Released under the zlib license": "Zlib", "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991": "GPL-2.0",
        # other versions and near misses
        "Licensed under the GNU Lesser General Public License, version 4.": None, "Licensed under the Apache License, Version 1.1.": None, "Licensed under CC BY-NC 3.0.": None, "SPDX-License-Identifier: Unknown-1.0": None, "the MIT campus has a license plate museum": None,
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "BSD-2-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n" + dict(licenses.TEMPLATES[::-1])["BSD-3-Clause"]: "BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD-3-Clause",
    }
    fill = "\n".join(f"some words of line {i} and more" for i in range(30))
    for wrap in ("%s", fill + "\n\n%s\n\n" + fill):
        rows = [(f"{k}/f.txt", wrap % t) for k, t in enumerate(said)]
        got = {r["path"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
        assert [got[f"{k}/f.txt"] for k in range(len(said))] == list(said.values())


def test_license_ties(spark):
    """Of equal scores the earlier line counts, then the name; a text of a million words is read whole."""
    rows = [("a", "MIT License\nISC License"), ("b", "ISC License\nMIT License"), ("c", "word " * 1_000_000 + "\nMIT License")]
    got = {r["path"]: (r["license"], r["line_no"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a": ("MIT", 0), "b": ("ISC", 0), "c": ("MIT", 1)}


def test_licenses_of_documents(spark, docs):
    got = {r["doc_id"]: r["license"] for r in queries.op2_licenses(spark, SF).where("origin = 'file'").collect()}
    lines_ = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Released under the MIT License.": "MIT"}
    want = {r["doc_id"]: next(lines_[x] for x in r["text"].split("\n") if x in lines_) for r in docs.collect() if any(x in lines_ for x in r["text"].split("\n"))}
    assert got == want


# 3


def test_sentencepiece(spark, docs, odd, empty):
    import sentencepiece as library

    path = queries.tokenizer("piece_bpe_32k.model")
    sp, own = library.SentencePieceProcessor(model_file=path), sentencepiece.Encoder(path)
    rnd = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "the", "ing", " th", "<s>", "日本", "𝄞", "▁", "ion", "    ", "\x00", "<0x0A>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    ids = [x.tolist() for x in own([t.encode() for t in texts])]
    assert ids == sp.encode(texts) and [own.decode(i) for i in ids] == sp.decode(ids)
    assert all(own.decode(i) == t.replace("▁", " ") for i, t in zip(ids, texts))
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = sentencepiece.encode(clash(both), path, {"doc_id": "doc_id", "t": "text"}).collect()
    assert len(rows) == both.count()
    for r in rows:
        assert r["ids"] == sp.encode(r["t"] or "") and r["decoded"] == (r["t"] or "") and r["n_tokens"] == len(r["ids"])
    assert sentencepiece.encode(empty, path, {"doc_id": "doc_id"}).count() == 0


# 4


def test_warc(spark, empty):
    big = "<p>" + "x" * 1200
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u\r\nX: y", "short"), (7, "u", "short"), (8, "u", "é" * 500), (9, "u", "é" * 500)] + [(100 + i, "u", str(i) * 90_000) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "n": F.lit(2)})
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    for pid, _, html in rows:
        data = (html or "").encode()
        last = max(p for p, _, h in rows if (h or "").encode() == data)
        revisit = len(data) >= 1000 and last != pid
        assert got[pid] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None)
    b = warc.archive(pages).collect()
    entries = [(r["archive"], e) for r in b for e in r["entries"]]
    assert len(entries) == len(rows) and any(e["frame"] > 0 for _, e in entries)
    for a, e in entries:
        r = warc.read_record(bytes(a), e["frame"], e["offset"])
        assert r["record_id"] == e["record_id"]
    import zstandard

    raw = b"".join(zstandard.ZstdDecompressor().decompress(bytes(r["archive"])[s : s + c], max_output_size=d) for r in b for s, c, d in warc.read_seek_table(bytes(r["archive"])))
    names = re.findall(rb"WARC-Record-ID: <([^>]*)>", raw)
    assert len(set(names)) == len(rows) and set(re.findall(rb"WARC-Refers-To: <([^>]*)>", raw)) <= set(names) and raw.count(b"application/http") == len(rows)
    with pytest.raises(ValueError):
        warc.read_seek_table(b"x" * 40)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    twice = warc.archive(spark.createDataFrame([(7, "u", big), (7, "u", big), (None, "u", big), (3, "u", big), (None, "u", "a")], "page_id long, url string, html string").coalesce(1)).collect()
    whole = b"".join(zstandard.ZstdDecompressor().decompress(bytes(r["archive"])[s : s + c], max_output_size=d) for r in twice for s, c, d in warc.read_seek_table(bytes(r["archive"])))
    assert len(set(re.findall(rb"WARC-Record-ID: <([^>]*)>", whole))) == 5
    strange = spark.createDataFrame([(None, "u", big), (None, "u", "a"), (7, "u", big), (7, "v", big), (8, "w", "b"), (8, "w", "c")], "page_id long, url string, html string")
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(strange).collect()), key=str)
    assert got == sorted([(0, 1203, "response", None), (0, 1, "response", None), (7, 1203, "response", None), (7, 1203, "response", None), (8, 1, "response", None), (8, 1, "response", None)], key=str)


# 5


def test_token_counts(spark, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_counts.Counter(path)
    rnd = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "!", "'s", "<|endoftext|>", " the", " ", "　", "\x1c", "\x85", "日本"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own([t.encode() for t in texts]).tolist() == want
    assert own([t.encode() for t in texts], most=3).tolist() == want  # cut wherever it is safe
    got = token_counts.count_tokens(clash(odd), path).collect()
    for r in got:
        texts_ = {t for i, t, *_ in ODD if i == r["doc_id"]}
        n = len(library.encode(next(iter(texts_)) or "", add_special_tokens=False))
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 512)
    assert len(got) == len(ODD) and token_counts.count_tokens(empty, path).count() == 0


# 6


def test_language(spark, docs, odd, empty):
    model = language.fit(docs.where(language.fold() != 1), per_language=100)
    rows = language.identify(docs, model, {"doc_id": "doc_id", "lang": "lang", "held": language.fold() == 1}).where("held").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r for r in language.identify(clash(odd), model, {"doc_id": "doc_id"}).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[4]["lang_pred"] in model.languages and not got[1]["accepted"]
    assert language.identify(empty, model, {"doc_id": "doc_id"}).count() == 0
    nothing = language.identify(odd, language.fit(empty), {"doc_id": "doc_id"}).collect()
    assert len(nothing) == len(ODD) and {(r["lang_pred"], r["score"], r["accepted"]) for r in nothing} == {("und", 0.0, False)}
    marks = spark.createDataFrame([(1, "² ½ ①"), (2, "12 _ -"), (3, "²a"), (None, "b")], "doc_id long, text string")
    rows = {r["text"]: (r["lang_pred"], r["held"]) for r in language.identify(marks, model, {"text": "text", "held": language.fold() == 1}).collect()}
    assert rows["² ½ ①"][0] == rows["12 _ -"][0] == "und" != rows["²a"][0] and rows["b"][1] in (True, False)
    # scores one n-gram at a time
    def slow(text):
        words = [w for w in re.split("[^a-zà-ÿß]+", text.lower()) if w]
        z = n = 0
        for w in (f"<{w}>" for w in words):
            for k in model.orders:
                for i in range(len(w) - k + 1):
                    h = 0
                    for c in w[i : i + k]:
                        h = (h * 0x01000193 + ord(c)) % 2**32
                    x = (h + k) * 0x9E3779B1 % 2**32
                    z, n = z + model.scores[(x ^ x >> 15) % len(model.scores)].astype(float), n + 1
        return language.softmax(((z / n + model.bias) / model.temperature)[None])[0] if n else None

    some = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect() if r["text"] and re.fullmatch(r"[\sa-zA-Zà-ÿÀ-ÖØ-Þß0-9.,!?@:/_-]*", r["text"])]
    got = language.predictor(model)([t.encode() for t in some])
    assert len(some) > 5
    for text, name, score in zip(some, got["lang_pred"], got["score"]):
        p = slow(text.replace("_", " "))
        assert name == "und" if p is None else (model.languages[int(p.argmax())] == name and p.max() == pytest.approx(score, abs=1e-4))


def test_language_steps():
    """One SGD step over one batch against the gradient by finite differences."""
    bags = [(np.array([0, 2]), np.array([0.5, 0.5])), (np.array([1]), np.array([1.0]))]
    y = np.array([1, 0])
    args = dict(least_steps=1, epochs=1, rate=0.1, batch=2, seed=3, buckets=3, dim=2)
    scores, bias = language.train(bags, y, 2, **args)
    rng = np.random.default_rng(3)
    emb, lin, b = rng.uniform(-0.5, 0.5, (3, 2)), rng.normal(0, 0.1, (2, 2)), np.zeros(2)

    def loss(emb, lin, b):
        p = language.softmax(np.array([w @ emb[g] for g, w in bags]) @ lin + b)
        return -np.log(p[[0, 1], y]).mean()

    def gradient(k):
        parts = [emb, lin, b]
        out = np.zeros_like(parts[k])
        for i in np.ndindex(out.shape):
            up, down = ([x.copy() for x in parts] for _ in range(2))
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            out[i] = (loss(*up) - loss(*down)) / 2e-5
        return out

    # the embeddings' step is per row, not per batch: twice the mean's gradient for two rows
    want = (emb - 0.1 * 2 * gradient(0)) @ (lin - 0.1 * gradient(1))
    assert np.allclose(scores, want, atol=1e-5) and np.allclose(bias, b - 0.1 * gradient(2), atol=1e-5)


# 7


def slow_hits(words, items, window):
    hit, found = [False] * len(words), set()
    for item, own in items:
        n = min(window, len(own))
        runs = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in runs:
                found.add(item)
                hit[i : i + n] = [True] * n
    return hit, found


def test_automaton():
    rnd = random.Random(9)
    for _ in range(300):
        items = [(f"i{k}", [b"%d" % rnd.randrange(3) for _ in range(rnd.randint(0, 9))]) for k in range(rnd.randint(0, 5))]
        a = decontaminate.Automaton(items, 4)
        words = [b"%d" % rnd.randrange(4) for _ in range(40)]
        spans, found = a.scan(words)
        hit, want = slow_hits(words, items, 4)
        assert decontaminate.mask(40, spans).tolist() == hit and found == want


def test_decontaminate_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one"), (2, None), (3, " - "), (4, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.report(clash(odd), bench).collect()}
    assert got[1] == got[2] == (0, 0, 0) and got[4] == (1, 1, 1) and got[6][1] == 61 * 11 - (0 if 60_000 % 997 > 11 else 11)
    kept = {r["doc_id"]: r["text"] for r in decontaminate.clean(odd, bench).collect()}
    assert 4 not in kept and kept[1] is None and kept[2] == "" and "w1 w2 w3" not in kept[6] and kept[6].startswith("w0  w12") or kept[6].startswith("w0 ")
    assert decontaminate.report(empty, bench).count() == 0 and decontaminate.report(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontaminate_null_items(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "two three"), (1, None), (2, "four"), (2, "one two")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.report(docs, items).collect()}
    assert got == {1: (3, 2, hashlib.sha256(b",2").hexdigest()), 2: (1, 1, hashlib.sha256(b"2").hexdigest())}


def test_decontaminate_parts(spark, docs, odd, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    extra = spark.createDataFrame([(901, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (902, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), (903, "one"), (904, None)], "item_id long, text string")
    bench = bench.unionByName(extra)
    both = docs.unionByName(odd)
    one, kept = (collections.Counter(map(tuple, f(both, bench).collect())) for f in (decontaminate.report, decontaminate.clean))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(decontaminate, "MAX_ITEM_WORDS", size // 12)
    assert len(decontaminate.parts_of(bench)) > 2
    assert collections.Counter(map(tuple, decontaminate.report(both, bench).collect())) == one
    assert collections.Counter(map(tuple, decontaminate.clean(both, bench).collect())) == kept
    assert decontaminate.unite([5, 9, 1, 3, 3, 4, 7, 8]) == [1, 4, 5, 9] and decontaminate.unite([]) == []


# 8


def test_maxent(spark, docs, odd, empty):
    got = queries.op8_lm_score(spark, SF).collect()
    held = {r["doc_id"]: r["held"] for r in docs.select("doc_id", (language.fold(of=7) == 2).alias("held")).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    cut = lambda t: [*(t or "").encode().lower().split(), "end"]
    c = collections.Counter(w for d, t in texts.items() if not held[d] for w in cut(t))
    n, v = sum(c.values()), len(c)
    for r in got:
        words = cut(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(words), sum(c[w] > 0 for w in words), n, held[r["doc_id"]])
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    model, counts = maxent.fit(docs)
    rows = maxent.score(clash(odd), model, counts, {"doc_id": F.col("doc_id")}).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert maxent.score(empty, model, counts, {"doc_id": F.col("doc_id")}).count() == 0
    assert maxent.fit(empty)[0].total == 0


def mixed64(x):
    x &= 2**64 - 1
    x = (x ^ x >> 30) * maxent.MIX[0] & 2**64 - 1
    x = (x ^ x >> 27) * maxent.MIX[1] & 2**64 - 1
    return x ^ x >> 31


def dense_scores(texts, rounds, head):
    """Scores by the model as it is defined, token by token; ``rounds``: the round of each training text, None if it is held out."""
    def word_hash(w):
        return maxent.END if w is None else mixed64(sum((c + 1) * pow(maxent.BASE_, i, 2**64) for i, c in enumerate(w)))

    def word_kind(w):
        x = w[0]
        for k in (1, 2, 3):
            x = (x * 257 + (w[-k] if len(w) >= k else 0)) % 2**32
        return (x * 2654435761 % 2**32) >> 18

    words = [(t or "").encode().lower().split() for t in texts]
    kind = {word_hash(w): word_kind(w) for ws in words for w in ws} | {maxent.END: 0}
    runs = [[*map(word_hash, ws), maxent.END] for ws in words]
    seen_runs = [r for r, k in zip(runs, rounds) if k is not None]
    c = collections.Counter(h for r in seen_runs for h in r)
    n = sum(c.values())
    known = sorted((h for h in c if c[h] * head > n), key=lambda h: (-c[h], h))
    place = {h: i for i, h in enumerate(known)}
    G, F_ = maxent.GROUPS, min(maxent.FREQUENT, len(known))
    near = np.zeros((F_, F_))
    pairs = [(r[i], r[j]) for r in seen_runs for i in range(len(r)) for j in range(max(0, i - maxent.NEAR), min(len(r), i + maxent.NEAR + 1)) if i != j]
    for a, b in pairs:
        if place.get(a, F_) < F_ and place.get(b, F_) < F_:
            near[place[a], place[b]] += 1
    seeds = maxent.groups_of(near)
    around = np.zeros((len(known), G))
    for a, b in pairs:
        if a in place and place.get(b, F_) < F_:
            around[place[a], seeds[place[b]]] += 1
    prior = 0.5 * (around.sum(0) + 1) / (around.sum() + G)
    of_kind = collections.defaultdict(lambda: np.zeros(G))
    for h, v in zip(known, around):
        of_kind[kind[h]] += v
    by_kind = lambda h: int(np.argmax(of_kind[kind[h]] + prior))
    group = lambda h: int(np.argmax(around[place[h]] + prior)) if h in place and around[place[h]].sum() else by_kind(h)
    tokens_of, classes = np.zeros(G), [1] * G
    for h in c:
        tokens_of[group(h)] += c[h] + 1
    while sum(classes) < 16:
        classes[int(np.argmax(tokens_of / classes))] += 1
    first = [256 * sum(classes[:g]) for g in range(G)]
    alone = [192 * k for k in classes]
    own, taken = {}, [0] * G
    for h in known:
        g = group(h)
        if taken[g] < alone[g]:
            own[h] = first[g] + taken[g]
            taken[g] += 1
    unit = lambda h: own[h] if h in own else first[group(h)] + alone[group(h)] + (h >> 20) % (64 * classes[group(h)])
    mass = np.zeros(4096)
    for g in range(G):
        mass[first[g] + alone[g] : first[g] + 256 * classes[g]] += 1
    for h in c:
        mass[unit(h)] += c[h] + 1
    m = np.maximum(mass, mass.sum() * 1e-9).reshape(16, 16, 16)
    share = [m.sum((1, 2))[None] / m.sum(), m.sum(2) / m.sum((1, 2))[:, None], (m / m.sum(2, keepdims=True)).reshape(256, 16)]
    power = max(maxent.BUCKETS[0], (len(c) // maxent.WORDS_A_BUCKET).bit_length())
    w = [collections.defaultdict(lambda: np.zeros(16)) for _ in range(3)]

    def parts(run, levels=(0, 1, 2)):
        one = two = 0
        for h in run:
            f = [mixed64(one + 1), mixed64(two * maxent.BASE_ + 2), mixed64((one * maxent.BASE_ & 2**64 - 1) ^ (two + 3))]
            u = unit(h)
            for k in levels:
                node, y = ((0, u // 256), (u // 256, u // 16 % 16), (u // 16, u % 16))[k]
                each = (1 << power + 2 * k) // (1, 16, 256)[k]
                at = [(x >> (40, 16, 28)[k] & each - 1) + node * each for x in f]
                z = np.log(share[k][node]) + sum(w[k][i] for i in at)
                yield k, node, at, y, np.exp(z) / np.exp(z).sum()
            one, two = h, one

    seen, softmax_of = [collections.defaultdict(lambda: np.zeros(16)) for _ in range(3)], {}
    for r in seen_runs:
        for k, node, at, y, _ in parts(r):
            for i in at:
                seen[k][i][y] += 1
                softmax_of[k, i] = node
    for k in range(3):
        for i, v in seen[k].items():
            w[k][i] = maxent.RATES[0] * np.log((v + maxent.PRIORS[0]) / (v.sum() * share[k][softmax_of[k, i]] + maxent.PRIORS[0]))
    for k in range(len(maxent.ROUNDS)):
        seen, expected = (collections.defaultdict(lambda: np.zeros(16)) for _ in range(2))
        for run, r in zip(runs, rounds):
            for _, _, at, y, p in parts(run, (0,)) if r == k else ():
                for i in at:
                    seen[i][y] += 1
                    expected[i] += p
        for i in seen:
            w[0][i] = w[0][i] + maxent.RATES[1] * np.log((seen[i] + maxent.PRIORS[1]) / (expected[i] + maxent.PRIORS[1]))
    return [sum(np.log10(p[y]) for *_, y, p in parts(run)) + sum(0 if h in own else np.log10((c[h] + 1) / mass[unit(h)]) for h in run) for run in runs]


def test_groups_are_languages():
    """Words that stand near each other come together."""
    rnd = np.random.default_rng(2)
    of = np.repeat([0, 1, 2, 3], 16)
    near = rnd.poisson(np.where(of[:, None] == of[None], 40, 1))
    got = maxent.groups_of((near + near.T).astype(float))
    assert all(len(set(of[got == g])) <= 1 for g in range(maxent.GROUPS))
    assert maxent.groups_of(np.zeros((0, 0))).tolist() == [] and maxent.groups_of(np.ones((5, 5))).tolist() == [0] * 5


def witten_bell(texts, held):
    """The sums over held-out texts of log10 P(token) by one count (the base) and by a bigram, and the tokens."""
    cut = lambda t: [*(t or "").encode().lower().split(), "end"]
    c, follow = collections.Counter(), collections.defaultdict(collections.Counter)
    for d, t in texts.items():
        if not held[d]:
            for a, b in itertools.pairwise(["begin", *cut(t)]):
                c[b] += 1
                follow[a][b] += 1
    n, v = sum(c.values()), len(c)
    sums = {a: (sum(x.values()), len(x)) for a, x in follow.items()}
    base = pair = count = 0
    for d, t in texts.items():
        if held[d]:
            for a, b in itertools.pairwise(["begin", *cut(t)]):
                one = (c[b] + 1) / (n + v + 1)
                m, k = sums.get(a, (0, 0))
                base += np.log10(one)
                pair += np.log10((follow[a][b] + k * one) / (m + k) if m else one)
                count += 1
    return base, pair, count


def test_maxent_learns(spark):
    """On held-out texts the model gains over one count half of what a bigram does, or more."""
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", (language.fold(of=7) == 2).alias("held")).collect()
    base, pair, count = witten_bell({r["doc_id"]: r["text"] for r in big}, {r["doc_id"]: r["held"] for r in big})
    got = queries.op8_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert got[0] == pytest.approx(base, rel=1e-9) and got[2] == count
    assert got[1] - got[0] >= 0.5 * (pair - base)


def test_maxent_is_the_dense_model(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    texts = [" ".join(rnd.choices(words, [1 / (i + 1) for i in range(300)], k=rnd.randint(1, 60))) for _ in range(120)] + [None, "", "a", "a b a b c", "a b a b c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id") % 5 == 2
    deal = {r["doc_id"]: (r["deal"], r["held"]) for r in rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(sum(maxent.ROUNDS))).alias("deal"), held.alias("held")).collect()}
    ends = list(itertools.accumulate(maxent.ROUNDS))
    rounds = [None if deal[i][1] else next(k for k, e in enumerate(ends) if deal[i][0] < e) for i in range(len(texts))]
    for head in (maxent.HEAD, 40):  # 40: most words are joined
        model, counts = maxent.fit(rows.where(~held), head=head)
        got = {r["doc_id"]: r["score"] for r in maxent.score(rows, model, counts, {"doc_id": "doc_id"}).collect()}
        want = dense_scores(texts, rounds, head)
        assert all(got[i] == pytest.approx(want[i], rel=1e-4) for i in range(len(texts)))


def test_word_hashes():
    texts = [b"a b  c a", None, b"", b" A\tb", "é".encode() * 50 + b" " + b"y" * 100, b"w" * (maxent.BLOCK_BYTES + 5) + b" end " + b"k " * maxent.BLOCK_BYTES]
    h, starts, kinds = maxent.tokens(texts)
    assert len(kinds) == len(h) and kinds[0] == kinds[3] != kinds[1] and 0 <= kinds.min() and kinds.max() < maxent.KINDS and (kinds[starts[1:] - 1] == 0).all()
    cut = [[*(t or b"").lower().split(), None] for t in texts]
    assert np.diff(starts).tolist() == [len(c) for c in cut]
    names = {}
    assert all(names.setdefault(w, k) == k for w, k in zip(itertools.chain.from_iterable(cut), h.tolist())) and len(set(names.values())) == len(names)
    w = maxent.Words(np.array(sorted(names.values()), np.uint64)[:-1])
    assert w.find(h).tolist() == [sorted(names.values()).index(k) if k != max(names.values()) else -1 for k in h.tolist()]


# 9 and 10


def test_line_dedup_odd(spark, odd, empty):
    got = {r["doc_id"]: r for r in lines.dedup_lines(clash(odd)).collect()}
    assert got[1]["text"] is None and got[1]["n_lines"] == 0 and got[3]["n_lines"] == 0 and got[4]["text"] == "one" and got[4]["__id"] == "x" and got[6]["n_lines"] == 1
    assert lines.dedup_lines(clash(odd)).columns.count("n_lines") == 1
    assert lines.dedup_lines(odd).count() == len(ODD) and lines.dedup_lines(empty).count() == 0


def test_line_dedup_spares_copies(spark):
    own = [(i, f"start {i}\nShared  LINE here\nend {i}", "en", f"s{i % 7}", 1) for i in range(30)]
    copies = [(100 + i, "\n".join(f"copied line {k}" for k in range(12)), "en", f"s{i % 7}", 1) for i in range(30)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(own + copies, DOCS)).collect()}
    assert all(got[i]["text"] == f"start {i}\nend {i}" and got[i]["n_removed_lines"] == 1 for i in range(30))
    assert all(got[100 + i]["n_removed_lines"] == 0 for i in range(30))


def test_line_dedup_takes_blocks(spark):
    footer = [f"footer line {k}" for k in range(5)]
    rows = [(i, "\n".join([f"start {i}", "", "A notice", "", f"middle {i}", *footer, f"end {i}"]), "en", f"s{i % 7}", 1) for i in range(30)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i]["text"] == f"start {i}\n\n\nmiddle {i}\nend {i}" and got[i]["n_removed_lines"] == 6 for i in range(30))


def test_line_dedup_share_is_not_lowered(spark):
    own = [(i, f"start {i}\nhot line\nend {i}", "en", f"s{i % 7}", 1) for i in range(30)]
    copies = [(100 + i, "one page\nhot line\nover and over", "en", "s0", 1) for i in range(500)]
    repeats = [(900, "\n".join(["hot line", "between"] * 200), "en", "s1", 1)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(own + copies + repeats, DOCS)).collect()}
    assert all(got[i]["n_removed_lines"] == 1 for i in [*range(30), *range(100, 600)]) and got[900]["n_removed_lines"] == 200


def test_quality(spark, odd, empty):
    w, w2 = (" ".join(f"{x}{k}" for k in range(30)) for x in ("word", "other"))
    menu = "home about contact " * 8
    rows = [(i, f"{menu}\nown {i}", "en", "h", 1) for i in range(130)] + [(200 + i, f"{w} {i}\n{menu}\n{i} {w2}", "en", "h", 1) for i in range(20)] + [(300 + i, "\n".join(f"{w} {k}" for k in range(10)), "en", "h", 1) for i in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["kept"] for r in quality.report(docs).collect()}
    assert not any(got[i] for i in range(130)) and all(got[200 + i] for i in range(20))
    r = {x["doc_id"]: x for x in quality.report(clash(odd)).collect()}
    assert r[1]["n_words"] == 0 and r[1]["base_failed"] and r[6]["n_words"] == 60_000 and r[6]["n_repeat_words"] == 60_000
    assert quality.report(odd).count() == len(ODD) and quality.report(empty).count() == 0
    long_own = spark.createDataFrame([(9, "\n".join(f"line {i} of so many words in it" for i in range(4000)), "en", "s", 1)], DOCS)
    again = quality.apply(clash(long_own))
    assert [r["text"] for r in again.collect()] == [r["text"] for r in long_own.collect()] and again.columns == clash(long_own).columns
    cleaned = {x["doc_id"]: x["text"] for x in quality.apply(docs).collect()}
    assert 5 not in cleaned and cleaned[205] == f"{w} 5\n5 {w2}"


def test_quality_takes_templates(spark):
    menu = [f"menu entry {k} of this host" for k in range(4)]
    page = lambda *own: "\n".join([*menu, "", "A notice between blank lines", "", *own])
    rows = [(i, page(f"own {i}"), "en", "h", 1) for i in range(150)] + [(1000 + i, page("hot page"), "en", "h", 1) for i in range(5000)]
    copies = [(10_000 + i, "\n".join(f"copied line {k} with words" for k in range(10)), "en", "h", 1) for i in range(150)]
    got = {r["doc_id"]: r for r in quality.report(spark.createDataFrame(rows + copies, DOCS)).collect()}
    assert all(got[r[0]]["n_removed_words"] == 29 and not got[r[0]]["kept"] for r in rows)
    assert all(got[r[0]]["n_removed_words"] == 0 and got[r[0]]["kept"] for r in copies)


def slow_pipeline(rows, items, encode):
    """The rules of all stages, row by row and pair by pair: ``{doc_id: ids}`` of ``(doc_id, text, source)``."""
    ws = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    norm = lambda line: " ".join(ws(low(line)))

    def without(text, bad):
        return "\n".join(x for x in text.split("\n") if norm(x) not in bad)

    # quality rules
    texts_of = collections.defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if norm(x):
                texts_of[s, norm(x)].add(t)
    kept = []
    for i, t, s in rows:
        w = ws(t)
        runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        twice = {k + d for k, r in enumerate(runs) if runs.count(r) > 1 for d in range(8)}
        bad = {norm(x) for x in (t or "").split("\n") if len(texts_of[s, norm(x)]) > 100}
        left = without(t or "", bad)
        if len(w) >= 20 and 100 * len(twice) <= 30 * len(w) and len(ws(left)) >= 20:
            kept.append((i, left, s))
    # line dedup
    sites, texts = collections.defaultdict(set), collections.defaultdict(set)
    for _, t, s in kept:
        for x in t.split("\n"):
            sites[norm(x)].add(s)
            texts[norm(x)].add(t)
    bad = {x for x in sites if x and len(sites[x]) >= 5 and len(texts[x]) >= 5}
    kept = [(i, without(t, bad), s) for i, t, s in kept]
    # near dedup
    sets = []
    for _, t, _ in kept:
        w = ws(low(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(kept)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(kept)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(kept):
        least[find(k)] = min(least.get(find(k), i), i)
    kept = [(i, t, s) for k, (i, t, s) in enumerate(kept) if least[find(k)] == i]
    # decontamination
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    own_items = [(i, re.findall(word, low(t or ""))) for i, t in items]
    out = {}
    for i, t, _ in kept:
        at = [m.span() for m in re.finditer(word, low(t))]
        hit, _ = slow_hits([low(t)[a:b] for a, b in at], own_items, 10)
        if 2 * sum(hit) > len(hit):
            continue
        left, last, k = "", 0, 0
        while k < len(hit):
            if hit[k]:
                end = k
                while end + 1 < len(hit) and hit[end + 1]:
                    end += 1
                left, last, k = left + t[last : at[k][0]], at[end][1], end
            k += 1
        out[i] = encode(left + t[last:])
    return out


def test_pipeline_is_its_rules(spark, tmp_path):
    """All stages together against the rules: hosts' menus, footers, near copies with chains, benchmark passages, poor and odd rows."""
    import corpus_pipeline
    import sentencepiece as library

    rnd = random.Random(20)
    word = lambda: "".join(rnd.choice("abcdefgéß") for _ in range(rnd.randint(2, 7)))
    run = lambda n: " ".join(word() for _ in range(n))
    items = [(k, run(rnd.choice([4, 9, 14, 30]))) for k in range(6)] + [(90, None), (91, "")]
    rows = [(i, f"Menu of THIS host\n{run(25)}\nmore {i} {run(12)}", "h0") for i in range(110)]
    rows += [(200 + i, f"{run(24)}\n\nFooter  on all sites\n{run(8)}", f"s{i % 6}") for i in range(24)]
    for i in range(16):
        base = run(60).split()
        for k in range(3):
            copy = list(base)
            for _ in range(k * rnd.choice([1, 2, 3])):
                copy[rnd.randrange(60)] = word()
            rows.append((300 + 3 * i + k, " ".join(copy), f"s{k}"))
    rows += [(400 + i, f"{run(18)} {items[i % 6][1].upper() if i % 2 else items[i % 6][1]}, {run(rnd.choice([3, 30]))}", "s1") for i in range(18)]
    rows += [(500, None, "s"), (501, "", None), (502, run(19), "s"), (503, "the same words again and again " * 9, "s"), (504, rows[0][1], "h0"), (505, run(3000), None), (506, run(25), None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    sp = library.SentencePieceProcessor(model_file=queries.tokenizer(corpus_pipeline.MODEL))
    want = slow_pipeline(rows, items, sp.encode)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in got} == want and all(r["round_trip"] for r in got) and len(got) == len(want)
    assert 100 < len(want) <= len(rows) - 12


def test_stages_odd(spark, odd, empty):
    """Null, empty, blank, long and repeated rows, null ids, clashing columns and empty tables, stage by stage."""
    import corpus_pipeline

    kept = {
        "quality rules": [], "line dedup": [r[0] for r in ODD], "near dedup": [1, 4, 6, None], "decontamination": [r[0] for r in ODD], "sentencepiece": [r[0] for r in ODD],
    }
    texts = {r[0]: r[1] for r in ODD}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, clash(odd), SF)
        rows = got.collect()
        assert sorted((r["doc_id"] for r in rows), key=str) == sorted(kept[name], key=str), name
        assert stage(spark, empty, SF).count() == 0
        if name == "sentencepiece":
            assert all(r["round_trip"] for r in rows) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
        else:
            assert got.columns == corpus_pipeline.COLUMNS and all(r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"] or "") for r in rows)


def test_pipeline(spark, docs):
    import corpus_pipeline

    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
    rows = now.collect()
    assert 0 < len(rows) < docs.count() and all(r["round_trip"] for r in rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in rows)
