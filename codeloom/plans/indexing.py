"""Composite operations: index a workspace, delta scan, repair, and a small service facade."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.extract import registry
from codeloom.functions import text
from codeloom.operators import delta, health, search, vectors
from codeloom.sources import workspace
from codeloom.sources.collection import Collection


@dataclass
class Project:
    """A workspace folder, its collections' folder, and what to index."""

    name: str
    folder: str
    store: str
    include: list[str] = field(default_factory=lambda: ["*"])
    exclude: list[str] = field(default_factory=list)
    dimensions: int = 64
    embedder: str = "default"
    tolerance: float = 1.0

    def collection(self, spark: SparkSession, kind: str = "code") -> Collection:
        key = {"code": "entity_id", "relations": "id", "embeddings": "entity_id"}[kind]
        return Collection(spark, f"{self.store.rstrip('/')}/{self.name.lower().replace(' ', '-').replace('_', '-')}-{kind}", key)


STORED = "entity_id string, entity_name string, qualified_name string, entity_type string, signature string, docstring string, source_code string, source_hash string, file_path string, start_line int, end_line int, start_column int, end_column int, start_byte bigint, end_byte bigint, visibility string, is_async boolean, is_test boolean, is_deprecated boolean, language string, location_id string, indexed_at double"


def parse_files(spark: SparkSession, project: Project, paths: DataFrame, now: float) -> DataFrame:
    """Entities of the given paths (file_path), stamped."""
    files = workspace.texts_of(spark, project.folder, paths)
    return registry.entities(files).withColumn("indexed_at", F.lit(now))


def sources(spark: SparkSession, project: Project) -> DataFrame:
    rows = workspace.scan(spark, project.folder)
    return workspace.selected(rows, project.include, project.exclude).where(text.extension(F.col("file_path")).isin(*registry.EXTENSIONS))


def delta_scan(spark: SparkSession, project: Project, now: float) -> dict[str, int]:
    """Brings the code, relation and embedding collections up to date; one new version each.

    Entities of deleted and of modified files go, those of added and modified files
    come; nothing else is read, parsed or embedded, and without changes nothing is written.
    """
    code = project.collection(spark)
    fresh = vectors_schema = None
    if not code.exists():
        code.create(spark.createDataFrame([], STORED).schema)
        project.collection(spark, "relations").create(spark.createDataFrame([], registry.RELATION_DDL).schema)
        vectors_schema = spark.createDataFrame([], "entity_id string, file_path string, vector array<float>").schema
        project.collection(spark, "embeddings").create(vectors_schema)
    found = sources(spark, project).cache()
    current = code.read()
    changes = delta.file_delta(found, current.select("file_path", "indexed_at"), project.tolerance).cache()
    out = dict.fromkeys(("added", "modified", "deleted", "unchanged"), 0) | {r.change_type: r.n for r in changes.groupBy("change_type").agg(F.count("*").alias("n")).collect()}
    if not out["added"] + out["modified"] + out["deleted"]:
        found.unpersist()
        changes.unpersist()
        return out | {"entities": code.count()}
    gone = changes.where(F.col("change_type").isin("deleted", "modified"))
    come = changes.where(F.col("change_type").isin("added", "modified"))
    fresh = delta.keep_last(parse_files(spark, project, come, now), ["entity_id"], ["start_line"])
    names = code.schema().names
    # each collection drops the rows of these files and takes in the new ones
    for kind, new in (("code", fresh), ("relations", None), ("embeddings", None)):
        c = project.collection(spark, kind)
        if kind == "relations":
            new = registry.relations(workspace.texts_of(spark, project.folder, come)).dropDuplicates(["id"])
        elif kind == "embeddings":
            rows = code.read().join(come.select("file_path"), "file_path", "left_semi").select("entity_id", "file_path", F.concat_ws(" ", "entity_type", "qualified_name", "signature", "docstring").alias("text"))
            new = vectors.embed(rows, dimensions=project.dimensions, model=project.embedder).select("entity_id", "file_path", "vector")
        cols = names if kind == "code" else c.schema().names
        kept = c.read().join(gone.select("file_path"), "file_path", "left_anti")
        c._write(kept.select(*cols).unionByName(new.select(*cols)))
    found.unpersist()
    changes.unpersist()
    return out | {"entities": code.count()}


def repair(spark: SparkSession, project: Project, now: float) -> dict[str, int]:
    """Deletes entities of files that are gone and indexes files without entities."""
    return delta_scan(spark, project, now)


def validate(spark: SparkSession, project: Project) -> DataFrame:
    return delta.consistency(project.collection(spark).read(), sources(spark, project))


def status(spark: SparkSession, project: Project, now: float) -> DataFrame:
    return health.analysed(health.metadata(project.collection(spark).read()), F.lit(now))


def search_code(spark: SparkSession, project: Project, query: str, mode: str = "auto", limit: int = 10, filters: dict | None = None) -> DataFrame:
    """Ranked hits of one query: payload, semantic, hybrid, or what the query analysis recommends."""
    query, limit, _ = search.check_request(query, max(1, min(limit, 50)))
    one = spark.createDataFrame([(query,)], "query string")
    if mode == "auto":
        mode = one.select(text.analyse(F.col("query"))["mode"]).first()[0]
    rows = project.collection(spark).read()
    lists = []
    if mode in ("payload", "hybrid"):
        lists.append(search.payload_search(rows, one, 2 * limit, filters))
    if mode in ("semantic", "hybrid"):
        points = project.collection(spark, "embeddings").read()
        if filters:
            points = points.join(rows.where(search.equals(filters)).select("entity_id"), "entity_id", "left_semi")
        q = vectors.embed(one.withColumn("text", F.col("query")), dimensions=project.dimensions, model=project.embedder).select("query", F.col("vector").alias("query_vector"))
        lists.append(vectors.nearest(points, q, 2 * limit))
    hits = lists[0] if len(lists) == 1 else search.top_k(search.reciprocal_rank_fusion(lists), 2 * limit, "query")
    least = search.MIN_SCORES[mode]
    best = hits.where(F.col("score") >= least).orderBy("rank").limit(limit)
    return best.join(rows, "entity_id").select("query", "rank", "score", "entity_id", "entity_name", "qualified_name", "entity_type", "signature", "file_path", "start_line", "end_line", "language").orderBy("rank")


def context_block(hits: DataFrame) -> DataFrame:
    """rank, block: a markdown block for each hit."""
    where = F.concat_ws(":", "file_path", F.col("start_line").cast("string"))
    block = F.concat_ws("\n", F.concat(F.lit("### "), F.col("entity_type"), F.lit(" `"), F.col("qualified_name"), F.lit("`")), F.concat(F.lit("- at "), where), F.when(F.length("signature") > 0, F.concat(F.lit("- "), F.col("signature"))), F.concat(F.lit("- score "), F.format_number("score", 3)))
    return hits.select("rank", block.alias("block"))


def summary(hits: DataFrame) -> DataFrame:
    """entity_type, n, best rank: what kinds of entities were found."""
    return hits.groupBy("entity_type").agg(F.count("*").alias("n"), F.min("rank").alias("best"))
