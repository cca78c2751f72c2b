"""Search over an entity corpus: predicates, scores, top-k and fusion, for many queries at once.

`queries` has one row per query and is small beside the corpus; it reaches the
executors by broadcast only when its size is below BROADCAST_ROWS, else in blocks
of that many rows, each scored against all entities.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000

# Field weights, match grades, type bonuses and the exponent of the payload score.
FIELD_WEIGHTS = {"entity_name": 1.0, "qualified_name": 0.9, "signature": 0.4, "docstring": 0.2}
EXACT, PREFIX, CONTAINS, GAMMA = 1.0, 0.8, 0.5, 0.85
TYPE_BONUS = {"class": 0.2, "function": 0.15, "method": 0.15, "variable": 0.05, "constant": 0.1, "import": 0.02}
RRF_K = 60
MIN_SCORES = {"payload": 0.15, "semantic": 0.4, "hybrid": 0.1, "auto": 0.1}


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def with_tokens(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with the tokens of text columns beside them, so that a join splits each text once and not once a pair."""
    return rows.withColumns({f"__{c}": tokens(F.col(c)) for c in columns})


def token_match(text: Column, query: Column) -> Column:
    """Every token of the query begins some token of the text (both as tokens); false for a query without tokens."""
    return (F.size(query) > 0) & F.forall(query, lambda a: F.exists(text, lambda b: b.startswith(a)))


def payload_match() -> Column:
    """Tiers by query length: equal names always, name tokens from 3 characters, content tokens from 5.

    For entities and queries with_tokens of their fields and of `query`.
    """
    query, begins = F.col("query"), lambda field: token_match(F.col(f"__{field}"), F.col("__query"))
    exact = (F.col("entity_name") == query) | (F.col("qualified_name") == query)
    prefix = (F.length(query) >= 3) & (begins("entity_name") | begins("qualified_name"))
    content = (F.length(query) >= 5) & (begins("signature") | begins("docstring"))
    return F.coalesce(exact, F.lit(False)) | F.coalesce(prefix, F.lit(False)) | F.coalesce(content, F.lit(False))


def payload_matches(entities: DataFrame, queries: DataFrame) -> Iterator[DataFrame]:
    """Pairs of an entity and a query that matches it, by blocks of queries."""
    rows = with_tokens(entities, *FIELD_WEIGHTS)
    extra = [f"__{c}" for c in (*FIELD_WEIGHTS, "query")]
    return (rows.join(F.broadcast(with_tokens(q, "query")), payload_match()).drop(*extra) for q in query_blocks(queries.select("query")))


def payload_score(query: Column) -> Column:
    q = F.lower(F.trim(query))
    total = F.lit(0.0)
    for field, weight in FIELD_WEIGHTS.items():
        v = F.lower(F.col(field))
        total = total + F.when(v == q, weight * EXACT).when(v.startswith(q), weight * PREFIX).when(v.contains(q), weight * CONTAINS).otherwise(0.0)
    bonus = reduce(lambda c, kv: c.when(F.lower("entity_type") == kv[0], kv[1]), TYPE_BONUS.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    return F.when(total + bonus <= 0, 0.0).otherwise(F.pow(total + bonus, F.lit(GAMMA)))


def equals(filters: dict) -> Column:
    """AND of equalities; a list means any of its values."""
    parts = (F.col(k).isin(*v) if isinstance(v, list | tuple | set) else F.col(k) == v for k, v in filters.items())
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def query_blocks(queries: DataFrame) -> Iterator[DataFrame]:
    """The queries, each block small enough to broadcast."""
    n = queries.count()
    blocks = -(-n // BROADCAST_ROWS)
    for i in range(blocks):
        yield queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)


def top_k(scored: DataFrame, k: int, *by: str) -> DataFrame:
    """rank 1..k by score, then entity_id, within each group.  Spark keeps only k rows of a group in a task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "entity_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def payload_search(entities: DataFrame, queries: DataFrame, k: int = 10, filters: dict | None = None) -> DataFrame:
    """query, entity_id, score, rank: the true top k of each query."""
    rows = entities.where(equals(filters or {}))
    parts = [m.select("query", "entity_id", F.round(payload_score(F.col("query")), 6).alias("score")) for m in payload_matches(rows, queries)]
    return top_k(reduce(DataFrame.unionByName, parts), k, "query") if parts else rows.select(F.lit("").alias("query"), "entity_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)


def ranked(rows: DataFrame, *by: str) -> DataFrame:
    """rank and total_results attached in order of score, then entity_id."""
    w = Window.partitionBy(*by)
    return rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "entity_id"))).withColumn("total_results", F.count("*").over(w))


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = RRF_K, cap: float | None = None) -> DataFrame:
    """query, entity_id, score of lists (query, entity_id, score, rank): sum of 1/(k + rank), times (k + 1)/lists."""
    rows = reduce(DataFrame.unionByName, (x.select("query", "entity_id", "rank") for x in lists))
    total = F.sum(1.0 / (F.lit(k) + F.col("rank"))) * ((k + 1) / len(lists))
    score = F.round(F.least(total, F.lit(cap)) if cap is not None else total, 6)
    return rows.groupBy("query", "entity_id").agg(score.alias("score"))


def weighted_fusion(payload: DataFrame, semantic: DataFrame, payload_weight: float = 0.5, semantic_weight: float = 0.5) -> DataFrame:
    """query, entity_id, score: weights normalised, a missing side counts 0."""
    total = (payload_weight + semantic_weight) or 1.0
    a = payload.select("query", "entity_id", F.col("score").alias("p"))
    b = semantic.select("query", "entity_id", F.col("score").alias("s"))
    score = F.coalesce("p", F.lit(0.0)) * (payload_weight / total) + F.coalesce("s", F.lit(0.0)) * (semantic_weight / total)
    return a.join(b, ["query", "entity_id"], "full_outer").select("query", "entity_id", F.round(score, 6).alias("score"))


def entity_fusion(payload: DataFrame, semantic: DataFrame, payload_weight: float = 0.7, semantic_weight: float = 0.3) -> DataFrame:
    """query, entity_id, score, origin: weighted scores summed by entity, also within a list; the payload row is preferred."""
    rows = payload.select("query", "entity_id", (F.col("score") * payload_weight).alias("s"), F.lit("payload").alias("origin")).unionByName(
        semantic.select("query", "entity_id", (F.col("score") * semantic_weight).alias("s"), F.lit("semantic").alias("origin"))
    )
    return rows.groupBy("query", "entity_id").agg(F.round(F.sum("s"), 6).alias("score"), F.min("origin").alias("origin"))


def hybrid_search(entities: DataFrame, queries: DataFrame, semantic: DataFrame, k: int = 10) -> DataFrame:
    """Fuses the payload top k with given semantic results (query, entity_id, score, rank)."""
    fused = reciprocal_rank_fusion([payload_search(entities, queries, k), semantic.where(F.col("rank") <= k)])
    return top_k(fused, k, "query")


def post_filter(results: DataFrame, min_score: float = 0.0, without_extensions: tuple[str, ...] = (), without_types: tuple[str, ...] = ()) -> DataFrame:
    out = results.where(F.col("score") >= min_score)
    for e in without_extensions:
        out = out.where(~F.coalesce(F.col("file_path").endswith(e), F.lit(False)))
    return out.where(~F.coalesce(F.col("entity_type").isin(*without_types), F.lit(False))) if without_types else out


def min_score(mode: Column) -> Column:
    return reduce(lambda c, kv: c.when(mode == kv[0], kv[1]), MIN_SCORES.items(), F.when(F.lit(False), 0.0)).otherwise(MIN_SCORES["auto"])


def overlaps(entities: DataFrame, path: str, first_line: int, last_line: int) -> DataFrame:
    return entities.where((F.col("file_path") == path) & (F.col("start_line") <= last_line) & (F.col("end_line") >= first_line))


def by_signature(entities: DataFrame, part: str) -> DataFrame:
    return entities.where(F.lower("signature").contains(part.lower()))


def iterative_search(search, query: str, planner=None, rounds: int = 3, follow_ups: int = 3, k: int = 10) -> DataFrame:
    """search(query, mode) -> ranked list.  planner(query, rows so far) -> (sufficient, [(mode, query)]); without one the first list suffices.

    Ends when the planner is satisfied, has no follow-up, or a round brings fewer than three new entities.
    """
    lists = [search(query, "hybrid")]
    seen = {r.entity_id for r in lists[0].select("entity_id").limit(k).collect()}
    for _ in range(rounds):
        enough, more = planner(query, sorted(seen)) if planner else (True, [])
        if enough or not more:
            break
        found = [search(q, mode) for mode, q in more[:follow_ups]]
        new = {r.entity_id for x in found for r in x.select("entity_id").limit(k).collect()} - seen
        lists += found
        seen |= new
        if len(new) < 3:
            break
    same = [x.withColumn("query", F.lit(query)) for x in lists]
    return top_k(reciprocal_rank_fusion(same, cap=1.0), k, "query")


def check_request(query: str, limit: int, file_types: list[str] | None = None) -> tuple[str, int, list[str]]:
    """A request within bounds: 1 to 1000 characters, 1 to 100 results, extensions with one leading dot."""
    if not query or not query.strip() or len(query) > 1000:
        raise ValueError("a query has 1 to 1000 characters")
    if not 1 <= limit <= 100:
        raise ValueError("a limit is 1 to 100")
    return query.strip(), limit, ["." + t.strip().lstrip(".").lower() for t in file_types or [] if t.strip()]
