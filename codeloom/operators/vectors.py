"""Vector distances, exact and approximate nearest neighbours, and embedding operators.

The built-in embedder hashes words to signed coordinates; it is deterministic and
needs no model, and it is not semantic.  Others plug in through `register`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from codeloom.operators.search import BROADCAST_ROWS, top_k

MAX_TEXT = 8192
SCORE_CELLS = 2_000_000


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"cosine": cosine, "euclidean": lambda a, b: 1 / (1 + euclidean(a, b)), "dot": dot}


def scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Points by queries."""
    s = x @ q.T
    if metric == "dot":
        return s
    xx, qq = (x * x).sum(1)[:, None], (q * q).sum(1)
    if metric == "euclidean":
        return 1 / (1 + np.sqrt(np.maximum(xx + qq - 2 * s, 0)))
    scale = np.sqrt(xx) * np.sqrt(qq)
    return np.clip(np.divide(s, scale, out=np.zeros_like(s), where=scale > 0), 0, 1)


class Best:
    """The k best points of each query so far, ties by id; what is below a query's k-th score is never stored."""

    def __init__(self, names: list, k: int, exclude_self: bool):
        self.names, self.k, self.exclude_self = np.array(names, object), k, exclude_self
        self.least = np.full(len(names), -np.inf)
        self.found: list[pd.DataFrame] = []
        self.waiting = 0

    def add(self, ids: np.ndarray, s: np.ndarray) -> None:
        m = self.k + self.exclude_self
        if len(s) >= m:
            self.least = np.maximum(self.least, np.partition(s, len(s) - m, axis=0)[len(s) - m])
        row, col = np.nonzero(s >= self.least)
        if self.exclude_self:
            other = ids[row] != self.names[col]
            row, col = row[other], col[other]
        self.found.append(pd.DataFrame({"q": col, "entity_id": ids[row], "score": s[row, col]}))
        self.waiting += len(row)
        if self.waiting > 8 * self.k * len(self.names):
            self.cut()

    def cut(self) -> None:
        rows = pd.concat(self.found).sort_values(["q", "score", "entity_id"], ascending=[True, False, True])
        self.found = [rows.groupby("q").head(self.k)]
        self.waiting = len(self.found[0])

    def rows(self) -> Iterator[pd.DataFrame]:
        if self.found:
            self.cut()
            rows = self.found[0]
            yield pd.DataFrame({"query": self.names[rows["q"]], "entity_id": rows["entity_id"].to_numpy(), "score": rows["score"].to_numpy()})


def nearest(points: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """query, entity_id, score, rank: the exact k nearest points (entity_id, vector) of each query (query, query_vector); cosine clamped to 0..1.

    The queries are multiplied in blocks against slices of the points, `SCORE_CELLS` scores
    at a time; a task keeps k rows per query, so the shuffle holds k rows per query and task.
    Null vectors are neither points nor queries.
    """
    queries = queries.where("query_vector is not null")
    n = queries.count()
    blocks = max(1, -(-n // BROADCAST_ROWS))
    id_type = points.schema["entity_id"].dataType.simpleString()
    q_type = queries.schema["query"].dataType.simpleString()
    src = points.where("vector is not null").select("entity_id", doubles(F.col("vector")).alias("vector"))
    out = None
    for i in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)
        rows = part.select("query", doubles(F.col("query_vector")).alias("v")).orderBy("query").collect()  # at most about BROADCAST_ROWS rows
        if not rows:
            continue
        names, matrix = [r[0] for r in rows], np.array([r[1] for r in rows])
        held = points.sparkSession.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            names, q = held.value
            best = Best(names, k, exclude_self)
            for batch in batches:
                ids = batch["entity_id"].to_numpy()
                for a in range(0, len(batch), max(1, SCORE_CELLS // len(names))):
                    x = np.stack(batch["vector"].to_numpy()[a : a + max(1, SCORE_CELLS // len(names))])
                    best.add(ids[a : a + len(x)], np.round(scores(x, q, metric), 6))
            yield from best.rows()

        found = src.mapInPandas(run, f"query {q_type}, entity_id {id_type}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = src.select(F.lit(None).cast(q_type).alias("query"), "entity_id", F.lit(0.0).alias("score")).limit(0)
    return top_k(out, k, "query")


def similar(points: DataFrame, ids: list | Column, k: int = 10) -> DataFrame:
    """The k nearest other points of each given id, or of each point for which a condition holds."""
    chosen = ids if isinstance(ids, Column) else F.col("entity_id").isin(*ids)
    return nearest(points, points.where(chosen).select(F.col("entity_id").alias("query"), F.col("vector").alias("query_vector")), k, exclude_self=True)


def approximate(points: DataFrame, query_vector: list[float], k: int = 10, bucket: float = 0.5, tables: int = 5) -> DataFrame:
    """Nearest by random projections (Euclidean); report its recall against nearest() before relying on it."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    df = points.select("entity_id", array_to_vector(doubles(F.col("vector"))).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=7).fit(df)
    return model.approxNearestNeighbors(df, Vectors.dense(query_vector), k, distCol="distance").select("entity_id", "distance")


def valid_text(text: Column, limit: int = MAX_TEXT) -> Column:
    """Trimmed and cut; empty for null or blank."""
    return F.left(F.trim(F.coalesce(text, F.lit(""))), F.lit(limit))


def hashed_vector(text: str, dimensions: int) -> list[float]:
    v = np.zeros(dimensions)
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % dimensions] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


EMBEDDERS: dict[str, Callable[[pd.Series, int], pd.Series]] = {"hashing": lambda s, d: s.map(lambda t: hashed_vector(t, d))}
ALIASES = {"default": "hashing"}


def register(name: str, fn: Callable[[pd.Series, int], pd.Series], alias: str | None = None) -> None:
    EMBEDDERS[name] = fn
    if alias:
        ALIASES[alias] = name


def embed(df: DataFrame, text: str = "text", dimensions: int = 64, model: str = "default", prompt: str = "") -> DataFrame:
    """df with `vector`; each distinct text is embedded once, blank texts give zero vectors."""
    fn = EMBEDDERS[ALIASES.get(model, model)]

    @pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield fn(s.map(lambda t: f"{prompt}{t}" if t else ""), dimensions)

    ready = df.withColumn("__text", valid_text(F.col(text)))
    distinct = ready.select("__text").distinct().withColumn("vector", run("__text"))
    return ready.join(distinct, "__text").drop("__text")


def cached_embeddings(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their vectors, misses) of texts (key, text) against a cache (key, vector)."""
    return texts.join(cache.select("key", "vector"), "key"), texts.join(cache.select("key"), "key", "left_anti")


def evicted(cache: DataFrame, keep: int, now: Column, ttl_seconds: float) -> DataFrame:
    """The `keep` most recently used rows (key, stored_at, last_access) that have not expired."""
    return cache.where(F.unix_micros("stored_at") / 1e6 + ttl_seconds >= F.unix_micros(now) / 1e6).orderBy(F.desc("last_access"), "key").limit(keep)
