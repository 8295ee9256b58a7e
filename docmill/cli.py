"""Command line: ingest, query, retag, index, html, adoc."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions import tags
from .functions.text import preview
from .operators.records import RecordSettings
from .plans import pipelines
from .sources import files, history, maps
from .sources.store import ChunkTable


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docmill")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("path")
    a.add_argument("--glob", default="**/*.md", help="paths from the folder on")
    a.add_argument("--tags", nargs="*", default=[])
    a.add_argument("--jsonl")
    a.add_argument("--no-index", action="store_true")
    a = sub.add_parser("query")
    a.add_argument("question")
    a.add_argument("--top-k", type=int, default=5)
    a.add_argument("--any-tag", nargs="*", default=[], help="one of these at least")
    a.add_argument("--all-tags", nargs="*", default=[], help="all of these")
    a.add_argument("--no-tag", nargs="*", default=[], help="none of these")
    a.add_argument("--where", help="a condition in Spark SQL")
    a.add_argument("--json-out", action="store_true")
    a = sub.add_parser("retag")
    a.add_argument("ids", nargs="+")
    a.add_argument("--add", nargs="*", default=[])
    a.add_argument("--remove", nargs="*", default=[])
    a = sub.add_parser("index")
    a.add_argument("action", choices=["create", "drop"])
    a.add_argument("--delete-docs", action="store_true")
    for name in ("html", "adoc"):
        a = sub.add_parser(name)
        a.add_argument("input")
        a.add_argument("--output", required=True)
        a.add_argument("--version", "--branch", dest="version", required=True)
        a.add_argument("--max-section-chars", type=int, default=1500)
        a.add_argument("--overlap", type=int, default=100)
        if name == "html":
            a.add_argument("--progress")
            a.add_argument("--resume", action="store_true")
        else:
            a.add_argument("--site", default="")
            a.add_argument("--distro", required=True)
            a.add_argument("--commits", help="JSON lines of changes: committed_at, path, renamed_from")
    return p


def main(argv: list[str] | None = None) -> int:
    args, settings = parser().parse_args(argv), Settings.from_env()
    spark = SparkSession.builder.appName("docmill").getOrCreate()
    store = ChunkTable(spark, settings.index_path, settings.dimensions)
    if args.command == "ingest":
        done = pipelines.ingest(spark, args.path, settings, args.tags, args.glob, args.jsonl, not args.no_index)
        print(f"{done.count()} chunks")
    elif args.command == "query":
        rows = pipelines.query(spark, args.question, settings, args.top_k, tags.wanted(args.any_tag, args.all_tags, args.no_tag, args.where))
        rows = rows if args.json_out else rows.withColumn("content", preview(rows.content))
        hits = [r.asDict() for r in rows.collect()]  # top k rows
        if args.json_out:
            print(json.dumps(hits, ensure_ascii=False, indent=2))
        for i, h in enumerate([] if args.json_out else hits, 1):
            print(f"{i}. {h['title']} | {h['section']} | {h['score']:.4f}\n{h['content']}\n")
        if not hits and not args.json_out:
            print("No results found.")
    elif args.command == "retag":
        for r in store.retag(args.ids, args.add, args.remove).collect():
            print(f"no chunk {r['chunk_id']}")
    elif args.command == "index":
        store.create() if args.action == "create" else store.drop(args.delete_docs)
    else:
        sizes = RecordSettings(args.max_section_chars, args.overlap)
        if args.command == "html":
            seen = files.load_seen(spark, args.progress) if args.resume and args.progress else spark.createDataFrame([], "url string")
            print(pipelines.crawl(spark.read.parquet(args.input), seen, args.version, args.output, sizes, args.progress))
        else:
            import yaml

            with open(f"{args.input}/_distro_map.yml") as f:
                base = maps.base_url(yaml.safe_load(f), args.version, args.site)
            documents = []
            for path in maps.find_topic_maps(args.input):
                with open(path) as f:
                    documents += yaml.safe_load_all(f)
            modified = None
            if args.commits:
                changes = files.json_lines(spark, args.commits, "committed_at string, path string, renamed_from string")
                modified = history.file_history(changes).select("path", F.col("last_changed").alias("committed_at"))
            print(pipelines.convert(files.asciidoc(spark, args.input), maps.topics(spark, documents, base, args.distro), args.version, args.output, sizes, modified))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
