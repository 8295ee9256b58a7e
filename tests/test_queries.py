import pytest
from conftest import SF
from oracle import agree
from pyspark.sql import functions as F

from docmill.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    agree(spark, duck, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and df.columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_agrees_with_sql_on_odd_pages(spark, tmp_path):
    """URLs that are there more than once, and a title that is cut in a character reference."""
    import duckdb

    html = "<html><body><article><h1>a &amp;&amp</h1><p>b &lt; c &gt &copy; d</p></article></body></html>"
    pages = [(k, f"https://h/{k % 9}", html) for k in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("crawl_counters", "html_fallback_text"):
        agree(spark, con, QUERIES[name], ORACLE_SQL[name], str(tmp_path))


def test_scan_files_holds_no_language_whole(spark, tmp_path, monkeypatch):
    """Files of a bounded number of documents, digested in order as if they were one."""
    import duckdb

    from docmill.sources import files

    docs = spark.range(9000).select("id", F.concat(F.lit("é "), F.col("id").cast("string")).alias("text"), F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de")), (F.col("id") % 3 + 1).cast("int")).alias("lang"))
    docs.withColumnRenamed("id", "doc_id").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    longest, whole_files = [], files.whole_files

    def measured(*args):
        found = whole_files(*args)
        longest.append(found.agg(F.max(F.length("text"))).first()[0])
        return found

    monkeypatch.setattr(files, "whole_files", measured)
    agree(spark, con, QUERIES["scan_files"], ORACLE_SQL["scan_files"], str(tmp_path))
    assert longest[0] < 9000


def test_no_text_goes_through_heading_stacks(spark, monkeypatch):
    """What is staged for the stacks has no column of texts, which each section would repeat."""
    from docmill.operators import headings

    seen, staged = [], headings.staged
    monkeypatch.setattr(headings, "staged", lambda df, label: (seen.append(df.columns), staged(df, label))[1])
    assert QUERIES["md_sections_blocks"](spark, SF).columns
    assert seen and not {"text", "body", "content", "metadata"} & {c for columns in seen for c in columns}


def test_html_events_are_dealt_once(spark):
    """Pages are dealt out to be read, and their events once; nothing is shuffled between the groups of a page."""
    plan = QUERIES["html_sections"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("name", ["html_section_records", "html_sections"])
def test_html_is_read_once(spark, name):
    """No filter that Spark infers from what is read may read all pages a second time, before they are spread."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1
