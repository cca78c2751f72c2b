"""Validation rules of entities, locations, events, points and configurations, as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.schema import DISTANCES, EVENT_PRIORITY


def is_trimmed(value: Column) -> Column:
    """Neither null nor blank, and without space around."""
    return F.coalesce((F.length(value) > 0) & (value == F.trim(value)), F.lit(False))


def valid_entity(entity_id: Column, name: Column, qualified: Column) -> Column:
    return F.coalesce(entity_id.contains("::"), F.lit(False)) & is_trimmed(name) & is_trimmed(qualified)


def valid_location(first_line: Column, last_line: Column, first_column: Column, last_column: Column, first_byte: Column, last_byte: Column) -> Column:
    """Lines from 1, and no end before its start; columns are compared within one line."""
    ordered = (first_line >= 1) & (last_line >= first_line) & (last_byte >= first_byte)
    return F.coalesce(ordered & ((last_line > first_line) | (last_column >= first_column)), F.lit(False))


def valid_event(kind: Column, path: Column, old_path: Column) -> Column:
    """A known kind and a path; a move also has its old path."""
    return F.coalesce(kind.isin(*EVENT_PRIORITY) & (F.length(path) > 0) & ((kind != "moved") | (F.length(old_path) > 0)), F.lit(False))


def valid_point(vector: Column, dimensions: int, *required: Column) -> Column:
    ok = F.coalesce(F.size(vector) == dimensions, F.lit(False))
    for c in required:
        ok = ok & c.isNotNull()
    return ok


def check_collection(name: str, dimensions: int, distance: str) -> None:
    """Raises for a collection that cannot be made."""
    if not name or not name.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"{name!r} is no collection name")
    if not 1 <= dimensions <= 65536:
        raise ValueError("vectors have 1 to 65536 dimensions")
    if distance not in DISTANCES:
        raise ValueError(f"a distance is one of {', '.join(DISTANCES)}")


def relevance(score: Column) -> Column:
    return F.when(score > 0.8, "high").when(score > 0.6, "moderate").otherwise("low")


def is_expired(stored_at: Column, ttl_seconds: float, now: Column) -> Column:
    return F.unix_micros(stored_at) / 1e6 + ttl_seconds < F.unix_micros(now) / 1e6


def hit_rate(hits: Column, total: Column) -> Column:
    return F.when(total > 0, hits / total).otherwise(0.0)
