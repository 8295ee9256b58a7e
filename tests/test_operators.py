import json
import os
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.functions import ids, split, tags, text
from docmill.operators import adoc, embed, html, markdown
from docmill.plans import pipelines
from docmill.sources import files, maps
from docmill.sources.store import ChunkTable


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


def chunks(spark, body, source="a/b.md", **options):
    got = markdown.chunks(spark.createDataFrame([(source, body)], "source string, text string"), **options)
    return got.orderBy("chunk_index").collect()


def test_uuid_and_hash(spark):
    key = "4.18|https://x/é"
    assert one(spark, ids.stable_uuid(F.lit("4.18"), F.col("u")), u="https://x/é") == str(uuid.uuid5(uuid.NAMESPACE_URL, key)) == "1832fa84-fec5-5989-be89-f94b56cf8fed"
    assert one(spark, ids.content_hash(F.col("u")), u=key) == "c1cd07e53bc6b3b3"


def test_file_stem(spark):
    for name, stem in {"x.md": "x", "a.b.md": "a.b", ".a": ".a", "..md": ".", "a": "a"}.items():
        assert one(spark, ids.file_stem(F.col("n")), n=name) == stem


def test_sliding_window(spark):
    assert one(spark, split.sliding_window(F.col("t"), 4, 1), t="abcdefghij") == ["abcd", "defg", "ghij", "j"]
    with pytest.raises(ValueError):
        split.sliding_window(F.lit(""), 4, 4)


@pytest.mark.parametrize("overlap", [0, 3, 20])
def test_pack_paragraphs(spark, overlap):
    """Every paragraph is whole in one chunk, in order; a chunk begins with the end of the one before, and is too long only with one paragraph."""
    rnd = random.Random(overlap)
    texts = [[f"<{i}{'x' * rnd.randint(0, 30)}>" for i in range(rnd.randint(1, 12))] for _ in range(100)]
    df = spark.createDataFrame([(i, rnd.choice(["\n\n", "\n\n\n", "\n\n \n\n"]).join(t)) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: (r[1], r[2]) for r in df.select("i", split.pack_paragraphs(F.col("t"), 64, overlap), "t").collect()}
    for i, paragraphs in enumerate(texts):
        chunks_, whole = got[i]
        if len(whole) <= 64:
            assert chunks_ == [whole]
            continue
        left = list(paragraphs)
        for before, chunk in zip([None, *chunks_], chunks_):
            own = 0
            while own < len(left) and left[own] in chunk:
                own += 1
            mine = "\n\n".join(left[:own])
            assert own and chunk.endswith(mine) and (len(chunk) <= 64 or own == 1)
            lead = chunk.removesuffix(mine).removesuffix("\n\n")
            assert len(lead) <= overlap and (before is None and not lead or before is not None and before.endswith(lead))
            left = left[own:]
        assert not left


MARKDOWN = {
    "hello": [("b", "hello")],
    "": [],
    "intro\n# A\nx": [("A", "intro"), ("A > A", "x")],
    "# A\na\n### B\nb\n### C\nc": [("A > A", "a"), ("A > A > B", "b"), ("A > A > B > C", "c")],
    "```\n# not\n```": [("not", "```"), ("not > not", "```")],
    "####### x": [("b", "####### x")],
    "# \nnext": [],
    "# A\r\nx": [("A > A", "x")],
    "---\na: [\n---\nx": [("b", "x")],
    "---\ntitle: T\ntags: [b, a, b]\nk: 1\n---\n# H\nx": [("T > H", "x")],
}


@pytest.mark.parametrize("body", sorted(MARKDOWN))
def test_markdown(spark, body):
    assert [(r["section"], r["content"]) for r in chunks(spark, body)] == MARKDOWN[body]


def test_markdown_tags_and_pieces(spark):
    r = chunks(spark, "---\ntags: [b, a, b]\nk: 1\n---\nabcdefghij", extra_tags=["c", "a"], most=4, overlap=1)
    assert [x["content"] for x in r] == ["abcd", "defg", "ghij", "j"] and r[0]["tags"] == ["b", "a", "c"] and r[0]["metadata"].toPython() == {"k": 1}
    assert [x["section"] for x in r] == [f"b [{i}/4]" for i in (1, 2, 3, 4)]
    assert len({x["chunk_id"] for x in r}) == 4


def test_heading_stack_random(spark):
    rnd = random.Random(3)
    docs, want = [], {}
    for d in range(40):
        levels = [rnd.randint(1, 6) for _ in range(rnd.randint(1, 12))]
        docs.append((f"d{d}", "\n".join(f"{'#' * v} h{i}\nx" for i, v in enumerate(levels))))
        stack, paths = [], []
        title = next((f"h{i}" for i, v in enumerate(levels) if v == 1), f"d{d}")
        for i, v in enumerate(levels):
            stack = [*stack[: v - 1], f"h{i}"]
            paths.append(" > ".join([title, *stack]))
        want[f"d{d}"] = paths
    got = {}
    for r in markdown.chunks(spark.createDataFrame(docs, "source string, text string")).orderBy("source", "chunk_index").collect():
        got.setdefault(r["source"], []).append(r["section"])
    assert got == want


PAGE = """<html><head><meta name="dcterms.modified" content="2024"></head><body><nav>no</nav><article><div class="docs-content-container">
<h1 class="chapter-title">Chapter 3. Page</h1><section id="a"><div class="titlepage"><h2><a class="anchor-heading">1.2. First</a><rh-tooltip>copy</rh-tooltip></h2></div>
<p>one  two</p><ul><li>x <b>y</b></li></ul><table><tr><td>p</td><td>q</td></tr></table><section id="b"><div class="titlepage"><h3>Second<rh-tooltip>z</rh-tooltip></h3></div><pre>code</pre></section></section>
<section><p>lost</p><section id="c"><div class="titlepage"><h3>Third</h3></div><div class="admonitionblock"><table><tr><td class="icon">i</td><td class="content">note it</td></tr></table></div></section></section></div></article></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([("https://h/a/b", PAGE), ("https://h/none", "<p>x</p>"), ("https://h/c/last", "<main><p>t</p></main>"), ("https://h/null", None)], "url string, html string")
    got = {(r["page_url"], r["heading"], r["level"], tuple(r["breadcrumbs"]), r["body"]) for r in html.sections(pages).collect()}
    assert got == {
        ("https://h/a/b#a", "First", 1, (), "one two\n- x y\np q"),
        ("https://h/a/b#b", "Second", 2, ("First",), "code"),
        ("https://h/a/b#c", "Third", 2, (), "note it"),
        ("https://h/c/last", "last", 1, (), "t"),
    }


def test_html_cut_as_the_library_reads_it():
    """Plain pages are cut without the library, to the same events; the others go to it."""
    odd = ["", "x", "<p>a<P class='x'>b</p>", '<div id="i" ID="j"><a data-x="1">e &amp; f &copy</a>', "<title><b></title><p>a < b</p>", "<script><p></script><br/><!-- c --><p>x", '<a t="a>b">x</a>', "<p>&", "<p", "</p x></>", '<option selected id="k">o', "<!doctype html><h1>T"]
    for page in [PAGE, PAGE.replace('<meta name="dcterms.modified" content="2024">', ""), *odd]:
        by_library, cut = html.Events(), html.Events()
        by_library.feed(page)
        by_library.close()
        plain = lambda rows: [(kind, data, e and (e.n, e.tag, e.cls, e.id, e.noise, e.up and e.up.n)) for kind, data, e in rows]
        assert plain(cut.read(page)) == plain(by_library.rows)


def test_html_rows_are_pieces(spark):
    """What is dealt out has a row for each piece, not each event, and no path of elements with it."""
    inside = "".join(f'<section id="s{k}"><div class="titlepage"><h2>H{k}</h2></div><ul><li>a <b>b</b></li></ul><p>c</p></section>' for k in range(50))
    pages = spark.createDataFrame([(1, f"<article>{inside}</article>")], "page int, html string")
    rows = html.read_pieces(pages, [], "page").collect()
    assert len(rows) == 50 * 3 + 1
    assert sorted(r["texts"] for r in rows if r["reads"] == "item") == [["a ", "b"]] * 50


def test_html_table_wrappers(spark):
    page = """<article><section><div class="titlepage"><h2>H</h2></div><rh-table><p>no</p><div><table><tr><td>a</td><td>b <b>c</b></td></tr><tr><td><rh-table><table><tr><td>in</td></tr></table></rh-table></td></tr></table></div>
<table><tr><td>second</td></tr></table><ul><li>no</li></ul></rh-table><ul></ul><pre> x
 y </pre><p></p>tail</section></article>"""
    rows = html.sections(spark.createDataFrame([("https://h/a", page)], "url string, html string")).collect()
    assert [(r["heading"], r["body"]) for r in rows] == [("H", "a\tb c\nin\tin\n\n x\n y \n\ntail".replace("\t", " "))]


def test_strips_all_white_space(spark):
    spaces = [chr(k) for k in range(0x3100) if chr(k).isspace()]
    df = spark.createDataFrame([(f"{c}a{c}b{c}{c}", f"a{c}b", f"a{c}b{c}{c}") for c in [*spaces, "\u200b", "\x1b", "q"]] + [("", "", ""), (None, None, None)], "x string, y string, z string")
    got = df.select("y", "z", text.strip(F.col("x")).alias("s"), text.lstrip(F.col("x")).alias("l"), text.word_count(F.col("x")).alias("n"), text.clean_text(F.concat("x", F.lit("c \t \td\n\n\n\n"))).alias("c")).collect()
    assert all((r["s"], r["l"], r["n"]) == (r["y"], r["z"], 2) for r in got[: len(spaces)])
    assert [r["s"] for r in got[len(spaces) :]] == ["\u200ba\u200bb\u200b\u200b", "\x1ba\x1bb\x1b\x1b", "qaqbqq", "", None]
    assert [r["n"] for r in got[len(spaces) :]] == [1, 1, 1, 0, None] and got[-2]["c"] == "c d"


def test_html_records(spark):
    pages = spark.createDataFrame([("https://h/a/b", None, PAGE)], "url string, last_modified string, html string")
    rows = pipelines.html_records(pages, "4").orderBy("chunk_index").collect()
    assert len(rows[0]) == 23 and [r["chunk_index"] for r in rows] == [0, 1, 2]
    r = rows[1]
    assert r["text"] == "Page: Page\nSection: First > Second\n\ncode" and r["sor_last_modified"] == "2024" and (r["source_dir"], r["source_file"]) == ("a", "b")
    assert r["document_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "4|https://h/a/b"))


def test_adoc(spark):
    src = {
        "top/a.adoc": "before\n[id=\"x\"]\n= Page {v}\n:attr: 1\n\n* *bold* and `code`\n[[y]]\nmore\n=== Deep\nxref:b.adoc[see] é*b*\ninclude::part.adoc[]\ninclude::mod/p2.adoc[leveloffset=+1]\ninclude::none.adoc[]\n== Last\n\n[[z]]",
        "top/part.adoc": "inner\ninclude::part.adoc[]",
        "mod/p2.adoc": "from root\n",
    }
    files_ = spark.createDataFrame(list(src.items()), "path string, text string")
    topics = spark.createDataFrame([("a", "http://s/a.html", "Name")], "stem string, page_url string, page_name string")
    mapped = spark.createDataFrame([("top/a.adoc",)], "path string")
    whole = adoc.resolve_includes(files_, mapped).first()["text"]
    assert whole.count("inner") == 8 and "from root" in whole
    docs = spark.createDataFrame([("top/a.adoc", "Name", src["top/a.adoc"])], "path string, page_name string, text string")
    got = [(r["heading"], r["level"], r["anchor"], r["breadcrumbs"], r["body"]) for r in adoc.sections(docs).orderBy("section_pos").collect()]
    assert got == [("Name", 1, "", [], "before"), ("Page", 1, "x", [], "- bold and code\nmore"), ("Deep", 3, "y", ["Page"], "see é*b*")]
    rows = pipelines.adoc_records(files_, topics, "br").orderBy("chunk_index").collect()
    assert rows[0]["text"] == "Page: Name\n\nbefore" and rows[2]["page_url"] == "http://s/a.html#y" and rows[2]["text"].startswith("Page: Name\nSection: Page > Deep\n\n")


def slow_includes(files_, path, depth=0):
    def of(m):
        for name in (os.path.normpath(os.path.join(os.path.dirname(path), m[1].strip())), os.path.normpath(m[1].strip())):
            if name in files_ and depth < 8:
                return slow_includes(files_, name, depth + 1)
            if name in files_:
                return ""
        return ""

    return re.sub(r"^include::([^\[]+)\[.*?\]$", of, files_[path].replace("\r\n", "\n"), flags=re.M)


def test_includes(spark):
    """Any graph of includes: circles, targets beside and from the top, over several lines, lone and last lines, files without text."""
    rnd = random.Random(4)
    names = [f"{d}/f{i}.adoc" if d else f"f{i}.adoc" for i in range(12) for d in ("", "a", "a/b")]
    target = lambda: rnd.choice([rnd.choice(names), "f3.adoc", "../f2.adoc", "../../f1.adoc", "./b/f4.adoc", " a/f5.adoc ", "none.adoc", "f6\nx"])
    part = lambda: rnd.choice([f"include::{target()}[]", f"include::{target()}[a=b]c]", "include::open[", "text", "", "see include::f1.adoc[]", "include::[]"])
    src = {n: "\n".join(rnd.choice([part(), "words"]) for _ in range(rnd.randint(0, 4))) for n in names}
    src["f0.adoc"] = "include::f0.adoc[]\r\ninclude::a/f1.adoc[]\r\n"
    files_ = spark.createDataFrame([*src.items(), ("null.adoc", None)], "path string, text string")
    want = {n: slow_includes(src, n) for n in names} | {"null.adoc": ""}
    assert {r["path"]: r["text"] for r in adoc.resolve_includes(files_).collect()} == want
    roots = spark.createDataFrame([("f0.adoc",), ("a/f1.adoc",), ("a/f1.adoc",), ("not there",)], "path string")
    assert sorted((r["path"], r["text"]) for r in adoc.resolve_includes(files_, roots).collect()) == sorted((n, want[n]) for n in ("f0.adoc", "a/f1.adoc"))


def test_conversion_counts(spark, tmp_path):
    """Files of the map with chunks and without, and chunks, as they are written."""
    files_ = spark.createDataFrame([("a.adoc", "= A\none\n== B\ntwo"), ("b.adoc", "include::none.adoc[]"), ("c.adoc", "not in the map")], "path string, text string")
    topics = spark.createDataFrame([("a", "https://s/a.html", "A"), ("b", "https://s/b.html", "B")], "stem string, page_url string, page_name string")
    got = pipelines.convert(files_, topics, "1", str(tmp_path / "out"))
    assert got == {"processed": 1, "skipped": 1, "chunks": 2} and spark.read.json(str(tmp_path / "out")).count() == 2


def test_topic_maps(spark):
    doc = {"Dir": "top", "Distros": "other", "Topics": [{"File": "a", "Name": "A"}, {"Dir": "in", "Distros": "other", "Topics": [{"File": "no"}]}, {"Dir": "in", "Topics": [{"File": "b"}, {"File": "a"}]}]}
    got = {r["stem"]: (r["page_url"], r["page_name"]) for r in maps.topics(spark, [doc], "http://s", "mine").collect()}
    assert got == {"a": ("http://s/in/a.html", "a"), "b": ("http://s/in/b.html", "b")}
    assert maps.base_url({"site_url": "http://x/", "d": {"branches": {"b": {"dir": "p/"}}}}, "b", "http://d") == "http://x/p"
    assert maps.base_url({}, "enterprise-4.1", "http://d") == "http://d/container-platform/4.1"


def test_sitemaps(spark):
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">%s</urlset>'
    urls = ["https://d/4/", "https://d/4/a", "https://d/4/a", "https://d/4/html-single/x", "https://d/4/pdf/x", "https://d/4/x.pdf", "https://d/5/a"]
    df = spark.createDataFrame([(0, xml % "".join(f"<url><loc>{u}</loc></url>" for u in urls))], "ord int, xml string")
    assert [r["url"] for r in files.sitemap_urls(df, "https://d/4/").orderBy("ord").collect()] == urls[:2]


@pytest.mark.parametrize("root", [None, "page"])
def test_crumbs_in_blocks(spark, root):
    """The rows of the plain windows, with runs without headings, levels that go up and down, and blocks of three rows."""
    from docmill.operators.headings import with_crumbs, with_crumbs_in_blocks

    rnd = random.Random(8)
    rows = [(d, i, rnd.choice([0, 0, 1, 2, 3, 4, 5, 6]) if d else 0, f"h{i}" if i % 5 else None) for d in range(6) for i in range(rnd.randint(1, 40))]
    df = spark.createDataFrame(rows, "doc int, pos int, level int, heading string")
    seed = None if root is None else F.lit(root)
    want = sorted(map(str, with_crumbs(df, ["doc"], "pos", root=seed).collect()))
    got = with_crumbs_in_blocks(df, ["doc"], "pos", root=seed, block=3)
    assert got.columns == [*df.columns, "crumbs"] and sorted(map(str, got.collect())) == want


def test_one_long_document(spark):
    """A million headings of one document are dealt to all tasks."""
    from docmill.operators.headings import with_crumbs_in_blocks

    level = F.when(F.col("id") % 1000 == 0, 1).otherwise(2 + F.col("id") % 3)
    df = spark.range(1_000_000).select(F.lit("d").alias("doc"), F.col("id").alias("pos"), level.cast("int").alias("level"), F.col("id").cast("string").alias("heading"))
    got = with_crumbs_in_blocks(df, ["doc"], "pos")
    dealt = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in dealt) == 1_000_000 and max(r["count"] for r in dealt) < 500_000
    assert got.where("pos = 999998").first()["crumbs"] == ["999000", "999996", "999997", "999998"]


def test_ordered_files(spark, tmp_path):
    """Files one after the other are in order: with nulls, paths by parts, and a key with half of all rows, which keep their order."""
    from docmill.sources import ordered

    rnd = random.Random(9)
    rows = [(rnd.choice(["a/b", "a-b", "a", "hot", "hot", "hot", "b/c/d", None]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "source string, n int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    ordered.write_ordered(df, str(tmp_path / "o"), [ordered.path_order()])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = [json.loads(line) for f in ordered.in_order(spark, str(tmp_path / "o")) for line in open(f.removeprefix("file:"))]
    assert [(r.get("source"), r["n"]) for r in found] == sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").split("/")))
    sizes = [sum(1 for _ in open(f.removeprefix("file:"))) for f in ordered.in_order(spark, str(tmp_path / "o"))]
    assert len(sizes) > 1 and max(sizes) < 1200
    got = ordered.numbered(spark, str(tmp_path / "o"), "source string, n int").collect()
    assert [(r["source"], r["n"]) for r in sorted(got, key=lambda r: r["position"])] == [(r.get("source"), r["n"]) for r in found]
    ordered.write_ordered(df.limit(0), str(tmp_path / "e"), ["n"])
    assert ordered.numbered(spark, str(tmp_path / "e"), "source string, n int").count() == 0


def test_metadata_types(spark, tmp_path):
    """Metadata keep their types through a table and JSON lines, and a filter on one reads its own column."""
    body = "---\ntitle: T\nn: 7\nf: 1.5\nb: true\nd: 2024-05-06\nx: .nan\nnone:\nlist: [1, {k: v}]\n1: one\n---\n# H\ntext"
    got = chunks(spark, body)[0]["metadata"]
    want = {"n": 7, "f": 1.5, "b": True, "d": "2024-05-06", "x": "nan", "none": None, "list": [1, {"k": "v"}], "1": "one"}
    assert json.loads(got.toJson()) == want
    df = markdown.chunks(spark.createDataFrame([("a.md", body), ("b.md", "no block"), ("c.md", None)], "source string, text string"))
    pipelines.export_jsonl(df, str(tmp_path / "j"), ["source"])
    back = files.json_lines(spark, str(tmp_path / "j")).collect()
    assert [json.loads(r["metadata"].toJson()) for r in back] == [want, {}]
    df.write.parquet(str(tmp_path / "p"))
    some = spark.read.schema(df.schema).parquet(str(tmp_path / "p")).where("try_variant_get(metadata, '$.n', 'int') > 6").select("source")
    assert [r["source"] for r in some.collect()] == ["a.md"]
    assert "GreaterThan(metadata.`0`,6)" in str(some._jdf.queryExecution().executedPlan()) or "GreaterThan(metadata" in str(some._jdf.queryExecution().executedPlan())


def test_marks_in_texts(spark):
    """Code points that mark headings inside are texts like others."""
    m = "\ufdd0"
    got = [(r["section"], r["content"]) for r in chunks(spark, f"{m}1 a{m}\n# H{m}0 {m}2x\nb{m}3{m}\n{m}")]
    assert got == [(f"H{m}0 {m}2x", f"{m}1 a{m}"), (f"H{m}0 {m}2x > H{m}0 {m}2x", f"b{m}3{m}\n{m}")]


def test_file_history(spark):
    """Chains of renames, forth and back, names used again, changes in one commit, rows without a path."""
    from docmill.sources import history

    rows = [
        (1, "a", None), (2, "b", "a"), (3, "b", None), (4, "c", "b"),  # a, b, c: one file
        (1, "x", None), (2, "y", "x"), (3, "x", "y"),  # forth and back
        (1, "old", None), (2, "new", "old"), (5, "old", None),  # old is used again
        (1, "p", None), (1, "q", None), (7, "p", "q"), (7, "q", "p"),  # two that change places
        (3, "z", "never"), (4, "same", "same"), (9, None, None), (4, "same", None),
    ]
    got = {r["path"]: (r["last_changed"], r["first_changed"], r["n_changes"]) for r in history.file_history(spark.createDataFrame(rows, "committed_at int, path string, renamed_from string")).collect()}
    assert got == {"c": (4, 1, 4), "x": (3, 1, 3), "new": (2, 2, 1), "old": (5, 1, 2), "p": (7, 1, 2), "q": (7, 1, 2), "z": (3, 3, 1), "same": (4, 4, 2)}
    long = spark.range(1, 300).selectExpr("id AS committed_at", "'n' || id AS path", "'n' || (id - 1) AS renamed_from")
    assert [tuple(r) for r in history.file_history(long).collect()] == [("n299", 299, 1, 299)]


def test_adoc_command(spark, tmp_path):
    """A tree with maps and a table of commits, by the command line."""
    from docmill import cli

    tree = tmp_path / "tree"
    (tree / "mod").mkdir(parents=True)
    (tree / "_distro_map.yml").write_text("own:\n  branches:\n    b1: {dir: docs/1}\n")
    (tree / "_topic_map.yml").write_text("---\nName: Top\nDir: mod\nTopics:\n- Name: One\n  File: one\n---\nName: Other\nDir: x\nTopics:\n- {Name: Two, File: two, Distros: other}\n")
    (tree / "mod" / "one.adoc").write_text("= One\ninclude::two.adoc[]\n")
    (tree / "mod" / "two.adoc").write_text("body of two\n")
    (tmp_path / "commits.json").write_text('{"committed_at":"2024-01-02","path":"mod/first.adoc"}\n{"committed_at":"2024-03-04","path":"mod/one.adoc","renamed_from":"mod/first.adoc"}\n')
    args = ["adoc", str(tree), "--output", str(tmp_path / "out"), "--branch", "b1", "--site", "https://s", "--distro", "own"]
    assert cli.main([*args, "--commits", str(tmp_path / "commits.json")]) == 0
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r["page_url"], r["sor_last_modified"], r["text"]) for r in rows] == [("https://s/docs/1/mod/one.html", "2024-03-04", "Page: One\n\nbody of two")]


def test_globs(spark, tmp_path):
    """Patterns over paths from the folder on, as a shell with ``**`` reads them; a file by itself; names with blanks and signs."""
    names = ["a.md", "b c.md", "x/a.md", "x/y/a.md", "x/y/b.txt", "x.y/d1.md", "x.y/d2.md", "x/+.md"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    ask = lambda p: sorted(r["text"] for r in files.whole_files(spark, str(tmp_path), p).collect())
    for p in ("*.md", "**/*.md", "x/*.md", "x/**/*.md", "*/*.md", "x.y/d?.md", "x.y/d[1]*", "**/y/*", "x/**", "x/+.md", "?.md"):
        want = sorted(str(f.relative_to(tmp_path)) for f in tmp_path.glob(p if p != "x/**" else "x/**/*") if f.is_file())
        assert ask(p) == want, p
    assert ask("[!a].md") == [] and ask("none/*.md") == []
    assert [r["text"] for r in files.markdown(spark, str(tmp_path / "b c.md")).collect()] == ["b c.md"]


def test_settings_file(tmp_path, monkeypatch):
    """Names of a file where the environment has none; quotes, comments and lines that say nothing."""
    from docmill.config import Settings, read_env

    f = tmp_path / ".env"
    f.write_text("# a comment\nEMBEDDING_PROVIDER=openai\nexport EMBEDDING_API_KEY='k # y'\nEMBEDDING_MODEL=\"m\\n\\\"x\\\"\" # behind\nCHUNK_MAX_CHARS = 500 # chars\nEMPTY=\nno line\nINDEX_PATH=/from/file\n")
    assert read_env(str(f)) == {"EMBEDDING_PROVIDER": "openai", "EMBEDDING_API_KEY": "k # y", "EMBEDDING_MODEL": 'm\n"x"', "CHUNK_MAX_CHARS": "500", "EMPTY": "", "INDEX_PATH": "/from/file"}
    monkeypatch.setenv("INDEX_PATH", "/from/env")
    s = Settings.from_env(file=str(f))
    assert (s.provider, s.provider_settings["api_key"], s.max_chars, s.index_path) == ("openai", "k # y", 500, "/from/env")
    assert read_env(str(tmp_path / "none")) == {} and Settings.from_env({}).provider == "hashing"
    s.validate()
    with pytest.raises(ValueError):
        Settings.from_env({"EMBEDDING_PROVIDER": "openai"}).validate()


def test_stored_sitemaps(spark, tmp_path):
    """An index of three files, one of them named twice: places, counts, filters that leave files unread, files that aren't there."""
    from docmill.sources import sitemaps

    space = "http://www.sitemaps.org/schemas/sitemap/0.9"
    locs = {"a.xml": ["https://d/4/x", "https://d/4/pdf/x", "https://d/5/y", "https://d/4/q?a=1&b=2"], "b.xml": [], "c.xml": ["https://d/4/x", "https://d/4/z"]}
    for name, urls in locs.items():
        (tmp_path / name).write_text(f'<urlset xmlns="{space}">' + "".join(f"<url><loc>{u.replace('&', '&amp;')}</loc><lastmod>2024</lastmod></url>" for u in urls) + "</urlset>")
    index = lambda *names: (tmp_path / "sitemap_index.xml").write_text(f'<sitemapindex xmlns="{space}">' + "".join(f"<sitemap><loc>https://h/s/{n}</loc></sitemap>" for n in names) + "</sitemapindex>")
    index("c.xml", "a.xml", "b.xml", "c.xml")
    rows = sitemaps.read(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 8
    assert [r["url"] for r in sitemaps.pages(rows, "https://d/4/").orderBy("ord").collect()] == ["https://d/4/x", "https://d/4/z", "https://d/4/q?a=1&b=2"]
    assert sorted((r["sitemap"], r["sitemap_pos"], r["n"]) for r in sitemaps.counts(rows, "https://d/4/").collect()) == [("a.xml", 1, 3), ("c.xml", 0, 2), ("c.xml", 3, 2)]
    assert [r["pos"] for r in sitemaps.read(spark, str(tmp_path), "https://d/5/").collect()] == [2]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        (tmp_path / "b.xml").write_text("not read")
        some = sitemaps.read(spark, str(tmp_path)).where("sitemap = 'a.xml' and url like 'https://d/4/%' and pos > 0")
        assert [r["pos"] for r in some.collect()] == [1, 3] and some.rdd.getNumPartitions() == 1
        assert sitemaps.read(spark, str(tmp_path)).where("sitemap in ('no.xml')").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="not well-formed|syntax error"):
        rows.collect()
    index("gone.xml")
    with pytest.raises(Exception, match="gone.xml"):
        sitemaps.read(spark, str(tmp_path)).collect()


def test_tag_filters(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, None)], "n int, tags array<string>")
    ask = lambda *a, **k: [r["n"] for r in df.where(tags.wanted(*a, **k)).collect()]
    assert ask() == [1, 2, 3] and ask(["b", "c"]) == [1, 2] and ask(none_of=["c"], where="n <= 2") == [1] and ask(where="n > 1") == [2, 3]
    assert ask(all_of=["a", "b"]) == [1] and ask(["a", "c"], ["b"], ["c"]) == [1]
    assert [r["n"] for r in df.where(tags.has_all(F.col("tags"), [])).collect()] == [1, 2, 3] and ask(all_of=["z"]) == []
    assert one(spark, tags.remove(F.col("t"), ["a"]), t=["a", "b", "b"]) == ["b", "b"]
    assert one(spark, tags.retag(F.col("t"), ["x"], ["x", "b"]), t=["a", "b", "a"]) == ["a"]


def test_store_and_search(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "# A\nred fox"), ("b.md", "# B\nblue whale")], "source string, text string")
    made = embed.embed_chunks(markdown.chunks(docs), "hashing", {"dimensions": 32})
    store = ChunkTable(spark, str(tmp_path / "index"), 32)
    store.upsert(made, 1)
    store.upsert(made, 2)
    rows = store.read().collect()
    assert len(rows) == 2 and {r["ingested_at"] for r in rows} == {2}
    one_id = next(r["chunk_id"] for r in rows if r["source"] == "a.md")
    missing = store.retag([one_id, "none"], ["t"], [])
    assert [r["chunk_id"] for r in missing.collect()] == ["none"] and store.get(one_id).first()["tags"] == ["t"]
    from docmill.operators.search import knn

    q = embed.PROVIDERS["hashing"]({"dimensions": 32})(["blue whale"])[0]
    assert knn(store.read(), q, 1).first()["source"] == "b.md" and knn(store.read(), q, 5, tags.wanted(["t"])).count() == 1 and knn(store.read(), q, 5, "array_contains(tags, 't')").count() == 1
    assert store.drop(True) and not store.exists()
    with pytest.raises(ValueError):
        embed.embedder("nope")


def clustered(rnd, n, dims=8, groups=20):
    mid = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [c + rnd.gauss(0, 0.02) for c in mid[i % groups]]) for i in range(n)]


def test_pruned_search(spark, tmp_path, monkeypatch):
    """The rows of the plain search, ties by id; of vectors in groups most cells aren't read."""
    from docmill.operators import nearest, search

    rnd = random.Random(6)
    rows = clustered(rnd, 1200)
    rows += [(5000 + i, rows[3][1]) for i in range(30)] + [(6000, None), (6001, [0.0] * 8), (6002, [1.0]), (6003, [float("nan")] * 8), (6004, [])]
    index = spark.createDataFrame(rows, "id long, v array<float>").repartition(6)
    queries = spark.createDataFrame([(f"q{i}", v) for i, v in rows[::40] if v] + [("far", [1.0, -1.0] * 4)], "query_id string, v array<float>")
    monkeypatch.setattr(nearest, "PART_BYTES", 1500)  # several parts a cell, and blocks of queries
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 7)
    cells = nearest.build(index, str(tmp_path / "cells"), "id", "v", 32)
    for k in (1, 7, 45):
        want = search.knn_batch(index.where("id < 6000"), queries, k, "id", "v")
        got = nearest.search(cells, queries, k, "v")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns
    q = queries.select(F.col("query_id").alias("q"), "v", F.lit(0.002).alias("tau"))
    pairs = nearest.asked(cells, q.withColumn("tau", F.lit(None).cast("double")), 7).union(nearest.asked(cells, q, 7)).collect()
    assert len(pairs) < 0.2 * queries.count() * sum(1 for b in cells.bounds if b[0])
    assert "PartitionFilters: [isnotnull(cell" in cells.read(spark, [1])._jdf.queryExecution().toString()


def test_batch_search(spark, monkeypatch):
    """Each row a query of its own, ties by id, more queries than go to all tasks at once."""
    from docmill.operators import search

    rnd = random.Random(16)
    rows = clustered(rnd, 400) + [(9000 + i, clustered(random.Random(1), 1)[0][1]) for i in range(9)] + [(9100, None), (9101, [1.0]), (9102, [0.0] * 8)]
    index = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    asked = [(i % 7, v) for i, v in rows[:400:9]] + [(99, None)]
    queries = spark.createDataFrame(asked, "query_id int, v array<float>")
    whole = {r["id"]: np.array(r["v"], float) for r in index.where("size(v) = 8 and id != 9102").collect()}
    want = []
    for q, v in asked:
        if v:
            a = np.array(spark.createDataFrame([(v,)], "v array<float>").first()[0], float)
            d = sorted((round(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), 6) + 0.0, i) for i, b in whole.items())[:6]
            want += [(q, i, s, r + 1) for r, (s, i) in enumerate(d)]
    for most in (4096, 10):
        monkeypatch.setattr(search, "QUERY_BLOCK", most)
        monkeypatch.setattr(search, "MOST_ROWS", 128)
        got = sorted(map(tuple, search.knn_batch(index, queries, 6, "id", "v").collect()))
        assert [(a[0], a[1], a[3]) for a in got] == [(a[0], a[1], a[3]) for a in sorted(want)] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, sorted(want)))
    assert search.knn_batch(index, queries.limit(0), 6, "id", "v").count() == 0


def test_pruned_search_odd(spark, tmp_path):
    """Fewer rows than asked for, queries without a distance or twice there, no rows at all."""
    from docmill.operators import nearest

    few = nearest.build(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0])], "id int, v array<double>"), str(tmp_path / "few"), "id", "v")
    q = spark.createDataFrame([(1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], "query_id int, v array<double>")
    got = nearest.search(few, q, 5, "v").collect()
    assert len(got) == 6 and sorted(r["rank"] for r in got) == [1, 1, 2, 2, 3, 3] and {r["query_id"] for r in got} == {1}
    none = nearest.build(spark.createDataFrame([], "id int, v array<double>"), str(tmp_path / "none"), "id", "v")
    assert nearest.search(none, q, 5, "v").count() == 0 and nearest.search(few, q.limit(0), 5, "v").count() == 0


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, content string, arrival int")


def stored(path):
    """The files of each bucket."""
    return {b.name: sorted(f.name for f in b.glob("*.parquet")) for b in path.glob("rows/bucket=*")}


def test_upsert_touches_its_buckets(spark, tmp_path):
    """An upsert, a change of tags and a lookup of one row read and write one bucket; the rest stays as it is."""
    t = ChunkTable(spark, str(tmp_path / "t"), 0, 8)
    t.upsert(chunk_rows(spark, [(str(i), "old", 0) for i in range(400)]), 1)
    before = stored(tmp_path / "t")
    assert len(before) == 8 and all(before.values())
    t.upsert(chunk_rows(spark, [("7", "b", 1), ("7", "new", 3), ("7", "c", 2)]), 2, "arrival")
    after = stored(tmp_path / "t")
    assert sum(before[b] != after[b] for b in before) == 1 and all(len(f) == 1 for f in after.values())
    assert {(r["chunk_id"], r["content"], r["ingested_at"]) for r in t.read().collect()} == {(str(i), "new" if i == 7 else "old", 2 if i == 7 else 1) for i in range(400)}
    one_ = t.get("7")
    assert one_.count() == 1 and len(one_.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(bucket" in one_._jdf.queryExecution().toString()
    t.set_tags("7", ["x"])
    t.retag(["7", "8", "no"], ["y"], ["x"])
    last = stored(tmp_path / "t")
    assert sum(after[b] != last[b] for b in before) <= 2 and t.get("7").first()["tags"] == ["y"] == t.get("8").first()["tags"]
    assert t.read().count() == 400


def test_upsert_odd(spark, tmp_path):
    """Nulls, ids that arrive very often, rows that arrive together, an empty batch, dropping and taking up again."""
    t = ChunkTable(spark, str(tmp_path / "t"), 3, 4)
    t.upsert(chunk_rows(spark, []), 1, "arrival")
    assert t.read().count() == 0
    rows = [(None, "n", 1), ("a", None, None), ("a", "x", None), *[("hot", f"{i % 90:03}", i % 10) for i in range(900)]]
    t.upsert(chunk_rows(spark, rows), 1, "arrival")
    assert {(r["chunk_id"], r["content"]) for r in t.read().collect()} == {(None, "n"), ("a", "x"), ("hot", "089")}
    t.upsert(chunk_rows(spark, [(None, "m", 1)]), 2, "arrival")
    assert t.read().where("chunk_id is null").first()["content"] == "m" and t.read().count() == 3
    assert t.drop() and not t.exists() and not t.drop()
    with pytest.raises(FileNotFoundError):
        t.read()
    again = ChunkTable(spark, str(tmp_path / "t"), 3, 32)
    again.create()
    assert again.buckets == 4 and again.read().count() == 3
    with pytest.raises(ValueError):
        ChunkTable(spark, str(tmp_path / "t"), 5).create()


def test_ingest_and_stream(spark, tmp_path):
    from docmill.config import Settings
    from docmill.streaming.ingest import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.md").write_text("---\ntags: [t]\n---\n# X\none\n## Y\ntwo\n")
    s = Settings(dimensions=16, provider_settings={"dimensions": 16}, index_path=str(tmp_path / "i"), output_dir=str(tmp_path / "o"))
    assert pipelines.ingest(spark, str(tmp_path / "in"), s, ["e"], jsonl=str(tmp_path / "j")).count() == 2
    assert files.json_lines(spark, str(tmp_path / "j")).count() == 2
    hit = pipelines.query(spark, "two", s, 1).first()
    assert hit["section"] == "X > X > Y" and hit["tags"] == ["t", "e"]
    watch(spark, str(tmp_path / "in"), s, str(tmp_path / "c")).awaitTermination()
    rows = ChunkTable(spark, s.index_path, 16).read().collect()
    assert len(rows) == 2 and all(r["ingested_at"] > 10**9 for r in rows)  # the stream finds the rows of the batch, and gives them its time


def test_crawl_resumes(spark, tmp_path):
    pages = spark.createDataFrame([("https://h/a", 200, "text/html", "m", "<main><p>t</p></main>"), ("https://h/b", 200, "application/pdf", None, None), ("https://h/c", 500, "text/html", None, None)], "url string, status int, content_type string, last_modified string, html string")
    out, progress = str(tmp_path / "out"), str(tmp_path / "seen")
    assert pipelines.crawl(pages, files.load_seen(spark, progress), "1", out, progress=progress) == {"pages": 1, "skipped": 2, "chunks": 1}
    seen = files.load_seen(spark, progress)
    assert sorted(r["url"] for r in seen.collect()) == ["https://h/a", "https://h/b"]
    assert files.unseen(pages, seen).count() == 1


def test_seen_urls(spark, tmp_path):
    """Each URL once, through a stop; again after it has expired."""
    import datetime

    from docmill.streaming import seen

    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    deliver = lambda *rows: spark.createDataFrame(list(rows), "url string, seen_at timestamp").write.mode("append").json(str(tmp_path / "in"))

    def run():
        seen.remember(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "10 days", "1 day").awaitTermination()
        rows = spark.read.schema("url string, first_seen timestamp").json(str(tmp_path / "out")).collect()
        return sorted((r["url"], (r["first_seen"] - day(0)).days) for r in rows)

    deliver(("a", day(2)), ("a", day(1)), ("b", day(2)), (None, day(1)), ("z", None))
    assert run() == [("a", 1), ("b", 2)]
    deliver(("a", day(3)), ("c", day(3)), ("c", day(3)))
    assert run() == [("a", 1), ("b", 2), ("c", 3)]
    assert run() == [("a", 1), ("b", 2), ("c", 3)]  # nothing new
    deliver(("d", day(30)))
    assert run() == [("a", 1), ("b", 2), ("c", 3), ("d", 30)]
    deliver(("a", day(31)), ("d", day(32)))
    assert run() == [("a", 1), ("a", 31), ("b", 2), ("c", 3), ("d", 30)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider") is False


def test_bloom(spark, monkeypatch):
    """What is there is held; of the rest about a hundredth is; the join is exact with a filter or without."""
    from docmill.operators import bloom

    left = spark.createDataFrame([(f"u{i}",) for i in range(3000)] + [("u1",), (None,)], "url string")
    right = spark.range(40_000).select(F.concat(F.lit("u"), (F.col("id") * 2).cast("string")).alias("url")).unionByName(spark.createDataFrame([(None,)], "url string"))
    b = bloom.build(left, "url")
    assert left.where(b.may_hold(F.col("url"))).count() == 3001
    others = right.where("CAST(substr(url, 2) AS INT) >= 3000")
    assert 0 < others.where(b.may_hold(F.col("url"))).count() < 0.03 * others.count()
    want = sorted(str(r[0]) for r in left.join(right, "url", "left_anti").collect())
    assert sorted(str(r[0]) for r in bloom.anti_join(left, right, "url").collect()) == want and len(want) == 1502
    monkeypatch.setattr(bloom, "MOST_BYTES", 100)
    assert bloom.build(left, "url") is None and bloom.anti_join(left, right, "url").count() == len(want)
    assert bloom.anti_join(left.limit(0), right, "url").count() == 0 and bloom.anti_join(left, right.limit(0), "url").count() == 3002


def test_text_functions(spark):
    assert one(spark, text.clean_heading(F.col("t")), t="Chapter 2. 1.A b") == "1.A b"
    assert one(spark, text.clean_heading(F.col("t")), t="1.2.3. Y") == "Y"
    assert one(spark, text.strip(F.col("t")), t=" \x1c a \n") == "a"
    assert one(spark, text.split_lines(F.col("t")), t="a\r\nb c\x85d\n") == ["a", "b", "c", "d"]
    assert one(spark, text.word_count(F.col("t")), t=" a\x1cb c ") == 3
    assert one(spark, text.adoc_prefix(F.col("p"), F.col("c"), F.lit("Spring floods")), p="Tides", c=["Harbours", "Tides"]) == "Page: Tides\nSection: Harbours > Spring floods"
