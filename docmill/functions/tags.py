"""Tag arrays, and the filters of searches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(tags: list[str]) -> Column:
    return F.array(*map(F.lit, tags)).cast("array<string>")


def add(tags: Column, more: list[str]) -> Column:
    """Union in order of first appearance."""
    return F.array_distinct(F.concat(tags, literal(more)))


def remove(tags: Column, some: list[str]) -> Column:
    """All occurrences of ``some`` dropped; other repeats stay."""
    gone = literal(some)
    return F.filter(tags, lambda t: ~F.array_contains(gone, t)) if some else tags


def retag(tags: Column, more: list[str], some: list[str]) -> Column:
    """Add, then remove: a tag in both is removed."""
    return remove(add(tags, more), some)


def has_any(tags: Column, required: list[str]) -> Column:
    """Nothing is required: nothing has it."""
    return F.coalesce(F.arrays_overlap(tags, literal(required)), F.lit(False))


def has_all(tags: Column, required: list[str]) -> Column:
    """Nothing is required: all have it, null tags too; else null tags have none."""
    return F.size(F.array_except(literal(required), F.coalesce(tags, literal([])))) == 0


def wanted(any_of: list[str] | None = None, all_of: list[str] | None = None, none_of: list[str] | None = None, where: str | None = None, tags: str = "tags") -> Column:
    """Rows with one tag of ``any_of``, all of ``all_of``, none of ``none_of``, for which the SQL condition ``where`` holds; what isn't asked for doesn't count."""
    out = F.lit(True)
    if any_of:
        out = out & has_any(F.col(tags), any_of)
    if all_of:
        out = out & has_all(F.col(tags), all_of)
    if none_of:
        out = out & ~has_any(F.col(tags), none_of)
    return out & F.expr(where) if where else out
