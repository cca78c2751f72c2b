"""Re-ranking strategies, diversity and per-file limits over result lists (query, entity_id, score, ...)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import is_main_path
from codeloom.operators.search import ranked


@dataclass(frozen=True)
class Config:
    freshness_weight: float = 0.1
    popularity_weight: float = 0.15
    quality_weight: float = 0.2
    boost_main_directories: bool = True
    diversity_threshold: float = 0.8
    max_results_per_file: int = 3


def by_score(rows: DataFrame, c: Config = Config()) -> DataFrame:
    return ranked(rows, "query")


def flagged(rows: DataFrame, column: str, members: DataFrame, name: str) -> DataFrame:
    """rows with a boolean `name`: whether the column's value is in members (one column)."""
    known = members.select(F.col(members.columns[0]).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    return rows.join(known, F.col(column) == F.col("__key"), "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")


def freshness(rows: DataFrame, fresh_files: DataFrame, c: Config = Config()) -> DataFrame:
    out = flagged(rows, "file_path", fresh_files, "fresh")
    return ranked(out.withColumn("score", F.round(F.col("score") * (1 + F.when(F.col("fresh"), c.freshness_weight * 0.3).otherwise(0.0)), 6)).drop("fresh"), "query")


def popularity(rows: DataFrame, entities: DataFrame, files: DataFrame, c: Config = Config()) -> DataFrame:
    out = flagged(flagged(rows, "entity_id", entities, "pe"), "file_path", files, "pf")
    gain = F.when(F.col("pe"), c.popularity_weight * 0.5).otherwise(0.0) + F.when(F.col("pf"), c.popularity_weight * 0.3).otherwise(0.0)
    return ranked(out.withColumn("score", F.round(F.col("score") * (1 + gain), 6)).drop("pe", "pf"), "query")


def doc_ladder(doc: Column, steps: tuple[float, float, float, float]) -> Column:
    n = F.length(F.coalesce(doc, F.lit("")))
    return F.when(n > 200, steps[0]).when(n > 100, steps[1]).when(n > 50, steps[2]).when(n > 20, steps[3]).otherwise(0.0)


def quality(rows: DataFrame, c: Config = Config()) -> DataFrame:
    sig = F.coalesce("signature", F.lit(""))
    hints = F.when(sig.contains("->"), 0.3).otherwise(0.0) + 0.2 * F.least(F.regexp_count(sig, F.lit(":")), F.lit(3))
    main = F.when(is_main_path(F.coalesce("file_path", F.lit(""))), 0.4).otherwise(0.0) if c.boost_main_directories else F.lit(0.0)
    gain = c.quality_weight * (doc_ladder(F.col("docstring"), (0.8, 0.5, 0.3, 0.1)) + hints + main)
    return ranked(rows.withColumn("score", F.round(F.col("score") * (1 + gain), 6)), "query")


def hybrid(rows: DataFrame, fresh_files: DataFrame, popular: DataFrame, c: Config = Config()) -> DataFrame:
    out = flagged(flagged(rows, "file_path", fresh_files, "fresh"), "entity_id", popular, "pe")
    sig, name, q = F.coalesce("signature", F.lit("")), F.lower("entity_name"), F.lower("query")
    gain = (
        F.when(F.col("fresh"), c.freshness_weight * 0.3).otherwise(0.0)
        + F.when(F.col("pe"), c.popularity_weight * 0.5).otherwise(0.0)
        + c.quality_weight * doc_ladder(F.col("docstring"), (0.6, 0.4, 0.2, 0.1))
        + F.when(sig.contains("->") | sig.contains(":"), c.quality_weight * 0.2).otherwise(0.0)
        + (F.when(is_main_path(F.coalesce("file_path", F.lit(""))), 0.15).otherwise(0.0) if c.boost_main_directories else F.lit(0.0))
        + F.when(name == q, 0.5).when(name.contains(q), 0.3 * F.length(q) / F.length(name)).otherwise(0.0)
    )
    return ranked(out.withColumn("score", F.round(F.col("score") * (1 + gain), 6)).drop("fresh", "pe"), "query")


def diverse(rows: DataFrame, c: Config = Config()) -> DataFrame:
    """In rank order keeps a row whose name and signature share at most the threshold of words with every row kept.

    A fold over the ranked rows of a query, which are a result list of bounded length.
    """
    if c.diversity_threshold >= 1:
        return rows
    key = F.concat_ws(":", F.coalesce("entity_name", F.lit("")), F.substring(F.coalesce("signature", F.lit("")), 1, 50))
    parts = F.array_distinct(F.filter(F.split(F.lower(key), r"\s+"), lambda w: w != ""))
    lists = rows.withColumn("w", parts).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "w", "entity_id"))).alias("l"))

    def alike(a: Column, b: Column) -> Column:
        union = F.size(F.array_union(a, b))
        return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(False)).otherwise(F.size(F.array_intersect(a, b)) / union > c.diversity_threshold)

    none = F.expr("cast(array() as array<struct<rank:int,w:array<string>,entity_id:string>>)")
    kept = F.aggregate("l", none, lambda acc, x: F.when(F.exists(acc, lambda y: alike(x["w"], y["w"])), acc).otherwise(F.concat(acc, F.array(F.struct(x["rank"].alias("rank"), x["w"].alias("w"), x["entity_id"].cast("string").alias("entity_id"))))))
    ids = lists.select("query", F.explode(kept).alias("k")).select("query", F.col("k.rank").alias("rank"))
    w = Window.partitionBy("query")
    out = rows.join(ids, ["query", "rank"], "left_semi")
    return out.withColumn("rank", F.row_number().over(w.orderBy("rank"))).withColumn("total_results", F.count("*").over(w))


def per_file(rows: DataFrame, c: Config = Config()) -> DataFrame:
    """At most max_results_per_file rows of a file, in rank order, ranked anew."""
    if c.max_results_per_file <= 0:
        return rows
    nth = F.row_number().over(Window.partitionBy("query", "file_path").orderBy("rank"))
    w = Window.partitionBy("query")
    out = rows.withColumn("__n", nth).where(F.col("__n") <= c.max_results_per_file).drop("__n")
    return out.withColumn("rank", F.row_number().over(w.orderBy("rank"))).withColumn("total_results", F.count("*").over(w))


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"score_only": by_score, "freshness_boost": freshness, "popularity_boost": popularity, "quality_boost": quality, "hybrid": hybrid}


def rank(rows: DataFrame, strategy: str = "hybrid", *context: DataFrame, config: Config = Config()) -> DataFrame:
    """The strategy, then diversity, then the per-file limit."""
    return per_file(diverse(STRATEGIES[strategy](rows, *context, config), config), config)


def explain(score: Column, rank_: Column, kind: Column) -> Column:
    return F.concat(F.lit("rank "), rank_.cast("string"), F.lit(", score "), F.format_number(score, 3), F.lit(" from "), kind, F.lit(" search"))


def quality_metrics(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """query, p_at_1, p_at_5, recall, mrr, ndcg of ranked results against relevant (query, entity_id)."""
    hits = results.join(relevant.select("query", "entity_id", F.lit(1.0).alias("hit")), ["query", "entity_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    n = relevant.groupBy("query").agg(F.countDistinct("entity_id").alias("n"))
    gain = F.col("hit") / F.log2(F.col("rank") + 1.0)
    got = hits.groupBy("query").agg(
        F.sum(F.when(F.col("rank") <= 1, F.col("hit")).otherwise(0.0)).alias("p_at_1"),
        (F.sum(F.when(F.col("rank") <= 5, F.col("hit")).otherwise(0.0)) / 5).alias("p_at_5"),
        F.sum("hit").alias("found"), F.coalesce(F.max(F.col("hit") / F.col("rank")), F.lit(0.0)).alias("mrr"), F.sum(gain).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0))
    joined = got.join(n, "query").withColumn("ndcg", F.col("dcg") / ideal)
    return joined.select("query", "p_at_1", "p_at_5", (F.col("found") / F.col("n")).alias("recall"), "mrr", F.round("ndcg", 6).alias("ndcg"))
