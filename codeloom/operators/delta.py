"""Workspace against collection, snapshot against snapshot, and consistency: set algebra by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_indexed(collection: DataFrame) -> DataFrame:
    """file_path, indexed_at (newest epoch or null), entities."""
    return collection.groupBy("file_path").agg(F.max("indexed_at").alias("indexed_at"), F.count("*").alias("entities"))


def file_delta(workspace: DataFrame, collection: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """file_path, change_type added / deleted / modified / unchanged."""
    w = workspace.select("file_path", "mtime", F.lit(True).alias("here"))
    c = latest_indexed(collection).select("file_path", "indexed_at", F.lit(True).alias("there"))
    newer = F.col("indexed_at").isNull() | (F.col("mtime") - F.col("indexed_at") > tolerance)
    kind = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "deleted").when(newer, "modified").otherwise("unchanged")
    return w.join(c, "file_path", "full_outer").select("file_path", kind.alias("change_type"))


def delta_summary(delta: DataFrame) -> DataFrame:
    n = lambda kind: F.count_if(F.col("change_type") == kind)
    out = delta.agg(*(n(k).alias(k) for k in ("added", "deleted", "modified", "unchanged")))
    total = F.col("added") + F.col("deleted") + F.col("modified")
    known = F.col("deleted") + F.col("modified") + F.col("unchanged")
    return out.withColumn("total_changes", total).withColumn("change_ratio", F.when(known > 0, total / known).when(total > 0, 1.0).otherwise(0.0))


def snapshot_changes(old: DataFrame, new: DataFrame, polling_tolerance: float = 0.01) -> DataFrame:
    """file_path, change_type of two polls (file_path, mtime, size)."""
    a = old.select("file_path", F.col("mtime").alias("m0"), F.col("size").alias("s0"))
    b = new.select("file_path", F.col("mtime").alias("m1"), F.col("size").alias("s1"))
    changed = (F.abs(F.col("m1") - F.col("m0")) > polling_tolerance) | (F.col("s0") != F.col("s1"))
    kind = F.when(F.col("m0").isNull(), "created").when(F.col("m1").isNull(), "deleted").when(changed, "modified")
    return a.join(b, "file_path", "full_outer").select("file_path", kind.alias("change_type")).where("change_type is not null")


LOCATION = ("start_line", "end_line", "start_column", "end_column")
STABLE_KEY = ("file_path", "entity_type", "qualified_name")


def entity_changes(old: DataFrame, new: DataFrame, key: tuple[str, ...] = STABLE_KEY) -> DataFrame:
    """entity_id, change_type created / deleted / modified / moved, four flags, confidence.

    Joined on a stable key by default; key=("entity_id",) joins on ids.  Moved: an
    equal, non-empty signature under another id, the last entity per signature.
    """
    fields = [c for c in ("entity_id", "source_hash", "signature", *LOCATION, "metadata") if c in old.columns and c in new.columns]
    a = old.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(key)), F.struct(*fields).alias("o"))
    b = new.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(key)), F.struct(*fields).alias("n"))
    both = a.join(b, [f"k{i}" for i in range(len(key))], "full_outer")
    differs = lambda f: ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")) if f in fields else F.lit(False)
    present = F.col("o").isNotNull() & F.col("n").isNotNull()
    content, signature = present & differs("source_hash"), present & differs("signature")
    location = present & (differs("start_line") | differs("end_line") | differs("start_column") | differs("end_column"))
    metadata = present & differs("metadata")
    kind = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "deleted").when(content | signature | location | metadata, "modified")
    own = both.select(F.coalesce("n.entity_id", "o.entity_id").alias("entity_id"), kind.alias("change_type"), content.alias("content_changed"), signature.alias("signature_changed"), location.alias("location_changed"), metadata.alias("metadata_changed"), F.lit(1.0).alias("confidence")).where("change_type is not null")
    last = old.where(F.length("signature") > 0).groupBy("signature").agg(F.max_by("entity_id", F.struct("start_line", "entity_id")).alias("old_id"))
    moved = new.where(F.length("signature") > 0).join(last, "signature").where("entity_id <> old_id").select("entity_id", F.lit("moved").alias("change_type"), F.lit(False).alias("content_changed"), F.lit(False).alias("signature_changed"), F.lit(True).alias("location_changed"), F.lit(False).alias("metadata_changed"), F.lit(0.8).alias("confidence"))
    return own.unionByName(moved)


def similarity(a: str = "a", b: str = "b") -> Column:
    """Of two entities in the struct columns a and b: 0 for other types, else name .3, signature .4, content .2, place .1."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    given = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    name = F.when(x("entity_name") == y("entity_name"), 0.3).when(F.lower(x("entity_name")) == F.lower(y("entity_name")), 0.24).otherwise(0.0)
    sa, sb = given(x("signature")), given(y("signature"))
    sig = F.when(sa & sb & (x("signature") == y("signature")), 0.4).when(sa & sb, 0.2).when(~sa & ~sb, 0.4).otherwise(0.0)
    content = F.when(x("source_hash") == y("source_hash"), 0.2).otherwise(0.0)
    gap = F.abs(x("start_line") - y("start_line"))
    place = F.when(gap == 0, 0.1).when(gap <= 5, 0.05).otherwise(0.0)
    return F.when(x("entity_type") != y("entity_type"), 0.0).otherwise(F.least(F.round(name + sig + content + place, 6), F.lit(1.0)))


def consistency(collection: DataFrame, files: DataFrame) -> DataFrame:
    """issue_type, entity_id, file_path: entities of no file are orphaned, files of no entity missing."""
    orphans = collection.join(files.select("file_path"), "file_path", "left_anti").select(F.lit("orphaned_entity").alias("issue_type"), F.col("entity_id").cast("string").alias("entity_id"), "file_path")
    missing = files.join(collection.select("file_path"), "file_path", "left_anti").select(F.lit("missing_entity").alias("issue_type"), F.lit(None).cast("string").alias("entity_id"), "file_path")
    return orphans.unionByName(missing)


def deep_consistency(collection: DataFrame, parsed: DataFrame) -> DataFrame:
    """The same by entity, and entities whose hash differs are stale."""
    one = lambda rows, kind: rows.select(F.lit(kind).alias("issue_type"), F.col("entity_id").cast("string").alias("entity_id"), "file_path")
    ids = lambda df: df.select("entity_id")
    stale = collection.join(parsed.select("entity_id", F.col("source_hash").alias("now")), "entity_id").where(F.col("source_hash") != F.col("now"))
    return one(collection.join(ids(parsed), "entity_id", "left_anti"), "orphaned_entity").unionByName(one(parsed.join(ids(collection), "entity_id", "left_anti"), "missing_entity")).unionByName(one(stale, "stale_entity"))


def issue_summary(issues: DataFrame) -> DataFrame:
    n = lambda kind: F.count_if(F.col("issue_type") == kind)
    return issues.agg(n("orphaned_entity").alias("orphaned"), n("missing_entity").alias("missing"), n("stale_entity").alias("stale"), F.count("*").alias("total"))


def replacement(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path, entity_id, action removed / added / unchanged of replacing a file's entities."""
    a = old.select("file_path", "entity_id", F.lit(True).alias("was")).distinct()
    b = new.select("file_path", "entity_id", F.lit(True).alias("is")).distinct()
    action = F.when(F.col("is").isNull(), "removed").when(F.col("was").isNull(), "added").otherwise("unchanged")
    return a.join(b, ["file_path", "entity_id"], "full_outer").select("file_path", "entity_id", action.alias("action"))


def keep_last(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the last in the order."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) if isinstance(c, str) else c.desc() for c in order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def stale_entities(collection: DataFrame, cutoff: float) -> DataFrame:
    """Entities that were never stamped or were stamped before the cutoff (epoch seconds)."""
    return collection.where(F.col("indexed_at").isNull() | (F.col("indexed_at") < cutoff))
