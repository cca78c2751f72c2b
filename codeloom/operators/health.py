"""Health of a collection: one aggregate row, then classification, score and advice as expressions on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_HOURS, MIN_HEALTH = 24.0, 0.7


def metadata(collection: DataFrame, *by: str) -> DataFrame:
    """total_entities, file_coverage, types, unknown_ratio, per_file, oldest and newest update (epoch seconds)."""
    files = F.countDistinct("file_path")
    total = F.count("*")
    unknown = F.count_if(F.coalesce("entity_type", F.lit("unknown")) == "unknown")
    return collection.groupBy(*by).agg(
        total.alias("total_entities"), files.alias("file_coverage"), F.countDistinct("entity_type").alias("types"),
        (unknown / F.greatest(total, F.lit(1))).alias("unknown_ratio"), F.when(files > 0, total / files).otherwise(0.0).alias("per_file"),
        F.min("indexed_at").alias("oldest"), F.max("indexed_at").alias("newest"),
    )


def analysed(meta: DataFrame, now: Column, stale_hours: float = STALE_HOURS, min_health: float = MIN_HEALTH) -> DataFrame:
    """meta with age_hours, state, issues, health_score and recommendations."""
    age = (now - F.col("newest")) / 3600
    low, unknown = (F.col("file_coverage") > 0) & (F.col("per_file") < 1), F.col("unknown_ratio") > 0.5
    state = F.when(F.col("total_entities") == 0, "empty").when(F.col("age_hours") > stale_hours, "stale").when(low | unknown, "inconsistent").otherwise("healthy")
    issues = (
        F.when(F.col("state") == "stale", F.array(F.concat(F.lit("Collection is "), F.format_number("age_hours", 1), F.lit(f" hours old (threshold: {stale_hours:g}h)"))))
        .when(F.col("state") == "inconsistent", F.array_compact(F.array(F.when(low, "Very low entities per file ratio"), F.when(unknown, "High ratio of unknown entity types"))))
        .otherwise(F.array().cast("array<string>"))
    )
    recency = F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("age_hours") / (2 * stale_hours)), F.lit(0.0))
    base = F.when(F.col("total_entities") > 0, 0.4).otherwise(0.0) + 0.4 * recency + 0.1 * F.least(F.lit(1.0), F.col("types") / 3.0) + F.when(F.col("file_coverage") > 0, 0.1 * F.least(F.lit(1.0), F.col("per_file") / 5.0)).otherwise(0.0)
    less = F.greatest(F.lit(0.0), base - 0.1 * F.size("issues"))
    by_state = F.when(F.col("state") == "inconsistent", less * 0.6).when(F.col("state") == "stale", less * 0.8).when(F.col("state") == "empty", 0.0).otherwise(less)
    score = F.least(F.lit(1.0), by_state * F.when(unknown, 1 - F.col("unknown_ratio") * 0.5).otherwise(1.0))
    some = F.col("total_entities") > 0
    advice = F.array_compact(
        F.array(
            F.when(F.col("state") == "empty", "Perform initial full scan to populate collection")
            .when(F.col("state") == "stale", "Perform incremental scan to update stale entities")
            .when(F.col("state") == "inconsistent", "Run consistency validation and repair")
            .when(F.col("health_score") < min_health, "Consider incremental scan to improve collection health")
            .otherwise("Collection is healthy - enable real-time sync monitoring"),
            F.when((F.col("state") == "stale") & (F.col("age_hours") > 3 * stale_hours), "Consider full rescan due to extended staleness"),
            F.when((F.col("state") == "inconsistent") & unknown, "Check parser configuration for supported file types"),
            F.when(some & (F.col("file_coverage") == 0), "Investigate missing file path metadata in entities"),
            F.when(some & (F.col("types") <= 1), "Verify parser is extracting diverse entity types"),
        )
    )
    out = meta.withColumn("age_hours", age).withColumn("state", state).withColumn("issues", issues)
    return out.withColumn("health_score", F.round(score, 6)).withColumn("recommendations", advice)


def is_healthy(state: Column, score: Column, min_health: float = MIN_HEALTH) -> Column:
    return (state == "healthy") & (score >= min_health)
