"""Deterministic ids, hashes, URL and path parts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL namespace of RFC 4122, a fixed value.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def stable_uuid(*parts: Column) -> Column:
    """Version 5 UUID in the URL namespace of the parts joined by ``|``; null if a part is."""
    key = parts[0].cast("string")
    for p in parts[1:]:
        key = F.concat(key, F.lit("|"), p.cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(key, "UTF-8")))
    cut = lambda a, n: F.substring(h, a, n)
    variant = F.translate(cut(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def content_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def url_path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def last_part(path: Column) -> Column:
    """What follows the last slash, slashes at the ends left out."""
    return F.regexp_extract(F.regexp_replace(path, "^/+|/+$", ""), "([^/]*)$", 1)


def all_but_last(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "/?[^/]*$", "")


def without_leading_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "^/+", "")


def deep_link(url: Column, anchor: Column) -> Column:
    """``url#anchor``, or the url alone if there is no anchor."""
    return F.when(F.coalesce(anchor, F.lit("")) != "", F.concat(url, F.lit("#"), anchor)).otherwise(url)


def file_stem(name: Column) -> Column:
    """A file name without its last suffix; names that begin with their only dot stay whole."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
