"""Distro and topic maps: a few YAML files that the driver reads to small tables."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Where topic maps may be, in order.
TOPIC_MAPS = ["_topic_map.yml", "_topic_map.yaml", "_topic_map_*.yml", "_topic_map_*.yaml", "_topic_maps/*.yml", "_topic_maps/*.yaml"]


def base_url(distros: dict, branch: str, default_site: str) -> str:
    """Site and directory of ``branch`` in a distro map; without an entry, the container platform's of its version."""
    folders = [(entry or {}).get("dir", "") for d in distros.values() if isinstance(d, dict) for name, entry in (d.get("branches") or {}).items() if name == branch]
    folder = str(folders[0]).strip("/") if folders else "container-platform/" + branch.replace("enterprise-", "")
    return "/".join([str(distros.get("site_url", default_site)).rstrip("/"), folder])


def find_topic_maps(root: str) -> list[str]:
    found = list(dict.fromkeys(f for p in TOPIC_MAPS for f in sorted(glob.glob(os.path.join(root, p)))))
    if not found:
        raise FileNotFoundError(f"no topic map in {root}: looked for {', '.join(TOPIC_MAPS)}")
    return found


def nodes(maps: DataFrame) -> DataFrame:
    """``(path, name, file, dir, distros, top)`` of all nodes of topic maps ``(ord, map)``, ``map`` a VARIANT; ``path``: places from the map down.

    A node has what it says itself: one round for each level explodes the topics of the
    level above, so that a round's rows are that level's nodes.
    """
    say = lambda key: F.try_variant_get("node", f"$.{key}", "string").alias(key.lower())
    level = maps.select(F.array("ord").alias("path"), F.col("map").alias("node"))
    found = None
    while not level.isEmpty():
        own = level.select("path", say("Name"), say("File"), say("Dir"), say("Distros"), F.try_variant_get("node", "$.Distros", "array<string>").alias("distro_list"))
        found = own if found is None else found.unionByName(own)
        below = level.select("path", F.posexplode(F.try_variant_get("node", "$.Topics", "array<variant>")).alias("at", "node"))
        level = below.where(F.try_variant_get("node", "$", "map<string,variant>").isNotNull()).select(F.concat("path", F.array("at")).alias("path"), "node")
    return found


def resolved(found: DataFrame, distro: str) -> DataFrame:
    """``(path, file, name, dir)`` of the nodes that ``distro`` has, with what they take over from the nodes above.

    Each node is joined with itself and those above it: the lowest directory counts,
    and one node of other distros leaves it out. What a map itself says of distros doesn't count.
    """
    up = found.select("path", "file", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("above"))
    own = found.select(F.col("path").alias("above"), "dir", (F.coalesce(~F.coalesce(F.array_contains("distro_list", distro), F.col("distros").contains(distro)) & (F.col("distros") != "") & (F.coalesce(F.size("distro_list"), F.lit(1)) > 0), F.lit(False)) & (F.size("path") > 1)).alias("other"))
    taken = up.join(own, "above").groupBy("path", "file", "name").agg(F.max_by("dir", F.when(F.col("dir").isNotNull(), F.size("above"))).alias("dir"), F.bool_or("other").alias("other"))
    return taken.where("not other").select("path", "file", "name", F.coalesce("dir", F.lit("")).alias("dir"))


def topics(spark: SparkSession, documents: list[object], base: str, distro: str) -> DataFrame:
    """``(stem, page_url, page_name, dir, ord)``: one row for each stem, that of its last entry."""
    rows = [(i, json.dumps(d, default=str)) for i, d in enumerate(documents) if isinstance(d, dict)]
    maps = spark.createDataFrame(rows, "ord int, doc string").select("ord", F.parse_json("doc").alias("map"))
    got = resolved(nodes(maps), distro).where("size(path) > 1 and file is not null") if rows else spark.createDataFrame([], "path array<int>, file string, name string, dir string")
    where = F.when(F.col("dir") != "", F.concat("dir", F.lit("/"), "file")).otherwise(F.col("file"))
    return last_wins(got.select(F.col("file").alias("stem"), F.concat(F.lit(base + "/"), where, F.lit(".html")).alias("page_url"), F.coalesce("name", "file").alias("page_name"), "dir", F.col("path").alias("ord")))


def last_wins(entries: DataFrame, key: str = "stem", order: str = "ord") -> DataFrame:
    """Of the rows of each key, the one of the greatest ``order``."""
    rest = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
