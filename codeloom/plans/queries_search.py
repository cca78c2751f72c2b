"""Search, scoring, fusion, ranking and vector queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import is_main_path, jaccard
from codeloom.operators import ranking, search, vectors
from codeloom.plans.catalog import Tables, query



def tokens(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def match(column: str) -> str:
    return f"len({tokens('query')}) > 0 and len(list_filter({tokens('query')}, lambda a: len(list_filter({tokens(column)}, lambda b: starts_with(b, a))) = 0)) = 0"


PAYLOAD_MATCH = f"""(entity_name = query or qualified_name = query
  or (length(query) >= 3 and (({match('entity_name')}) or ({match('qualified_name')})))
  or (length(query) >= 5 and (({match('signature')}) or ({match('docstring')}))))"""
GRADE = "case when lower({0}) = lower(trim(query)) then {1} when starts_with(lower({0}), lower(trim(query))) then {1} * 0.8 when contains(lower({0}), lower(trim(query))) then {1} * 0.5 else 0.0 end"
SCORE = f"""round(pow({GRADE.format('entity_name', '1.0::double')} + {GRADE.format('qualified_name', '0.9::double')} + {GRADE.format('signature', '0.4::double')} + {GRADE.format('docstring', '0.2::double')}
  + case entity_type when 'class' then 0.2 when 'function' then 0.15 when 'method' then 0.15 when 'variable' then 0.05 when 'constant' then 0.1 when 'import' then 0.02 else 0 end, 0.85), 6)"""
RAW = f"select query, e.*, {SCORE} as score from $ENT e, $QRY q where {PAYLOAD_MATCH}"
TOP = "select * from (select *, row_number() over (partition by query order by score desc, entity_id) as rank from ({0})) where rank <= {1}"
PAYLOAD = TOP.format(RAW, 10)

VECTOR_SQL = "select q.vec_id as query, p.vec_id as entity_id, {0} as score from embeddings q, embeddings p where q.vec_id % 50 = 0"
COSINE = "round(greatest(0.0, least(1.0, list_cosine_similarity(q.embedding::double[], p.embedding::double[]))), 6)"
VEC_TOP = TOP.format(VECTOR_SQL.format(COSINE), 10)


def payload(t: Tables, k: int = 10) -> DataFrame:
    return search.payload_search(t.entities, t.queries, k)


def results(t: Tables) -> DataFrame:
    """Payload results with their entity's columns."""
    return payload(t, 20).join(t.entities, "entity_id")


RESULTS = f"({TOP.format(RAW, 20)})"


def semantic(t: Tables) -> DataFrame:
    e = t.embeddings
    return vectors.nearest(e.select(F.col("vec_id").alias("entity_id"), F.col("embedding").alias("vector")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_vector")))


@query("q1_payload_search", "query:s entity_id:s score:f rank:i", PAYLOAD)
def _(t: Tables) -> DataFrame:
    return payload(t)


query("payload_search", "query:s entity_id:s score:f rank:i", PAYLOAD)(payload)


@query("c1_payload_match", "query:s matches:i", f"select query, count(*) as matches from $ENT e, $QRY q where {PAYLOAD_MATCH} group by query")
def _(t: Tables) -> DataFrame:
    return reduce(DataFrame.unionByName, search.payload_matches(t.entities, t.queries)).groupBy("query").agg(F.count("*").alias("matches"))


@query("c2_filtered_search", "query:s entity_id:s score:f rank:i", TOP.format(RAW + " and entity_type in ('class', 'function')", 5))
def _(t: Tables) -> DataFrame:
    return search.payload_search(t.entities, t.queries, 5, {"entity_type": ["class", "function"]})


@query("c4_post_filter", "query:s entity_id:s score:f", f"select query, entity_id, score from {RESULTS} where score >= 0.5 and entity_type not in ('import') and not ends_with(file_path, '_3.py')")
def _(t: Tables) -> DataFrame:
    return search.post_filter(results(t), 0.5, ("_3.py",), ("import",))


@query("c5_location_search", "entity_id:s", "select entity_id from $ENT where file_path = 'src/Brand_3.py' and start_line <= 60 and end_line >= 20")
def _(t: Tables) -> DataFrame:
    return search.overlaps(t.entities, "src/Brand_3.py", 20, 60)


@query("c6_signature_search", "entity_id:s", "select entity_id from $ENT where contains(lower(signature), 'small(')")
def _(t: Tables) -> DataFrame:
    return search.by_signature(t.entities, "SMALL(")


@query("c7_mode_threshold", "mode:s kept:i", f"select mode, count(*) as kept from {RESULTS} r, (values ('payload', 0.15), ('semantic', 0.4), ('hybrid', 0.1), ('auto', 0.1)) m(mode, least) where score >= least group by mode")
def _(t: Tables) -> DataFrame:
    modes = t.rows([("payload",), ("semantic",), ("hybrid",), ("auto",)], "mode string")
    return results(t).join(F.broadcast(modes), F.col("score") >= search.min_score(F.col("mode"))).groupBy("mode").agg(F.count("*").alias("kept"))


@query("c10_main_source", "file_path:s main:b", "select distinct file_path, not regexp_matches(lower(file_path), 'test|spec|example|__pycache__') as main from $ENT")
def _(t: Tables) -> DataFrame:
    return t.entities.select("file_path", is_main_path(F.col("file_path")).alias("main")).distinct()


@query("q2_semantic_search", "query:i entity_id:i score:f rank:i", VEC_TOP)
def _(t: Tables) -> DataFrame:
    return semantic(t)


RRF = "select query, entity_id, round(sum(1.0::double / (60 + rank)) * 30.5, 6) as score from ({0}) group by query, entity_id"
PREFIX_LIST = f"select query, entity_id, rank from ({PAYLOAD})"
OTHER = "select query, entity_id, row_number() over (partition by query order by size desc, entity_id) as rank from $ENT e, $QRY q where contains(lower(docstring), lower(query))"


def other_list(t: Tables) -> DataFrame:
    """A second ranked list for the queries: docstring hits by size."""
    hit = t.entities.join(F.broadcast(t.queries), F.lower("docstring").contains(F.lower("query")))
    w = Window.partitionBy("query").orderBy(F.desc("size"), "entity_id")
    return hit.select("query", "entity_id", F.lit(0.5).alias("score"), F.row_number().over(w).alias("rank")).where("rank <= 10")


@query("q3_hybrid_search", "query:s entity_id:s score:f rank:i", TOP.format(RRF.format(f"{PREFIX_LIST} union all select * from ({OTHER}) where rank <= 10"), 10))
def _(t: Tables) -> DataFrame:
    return search.hybrid_search(t.entities, t.queries, other_list(t), 10)


@query("q5_similar_entities", "query:i entity_id:i score:f rank:i", TOP.format(VECTOR_SQL.format(COSINE) + " and p.vec_id <> q.vec_id", 5))
def _(t: Tables) -> DataFrame:
    return vectors.similar(t.embeddings.select(F.col("vec_id").alias("entity_id"), F.col("embedding").alias("vector")), F.col("entity_id") % 50 == 0, 5)


@query("q8_count_by_filter", "entity_type:s n:i", "select entity_type, count(*) as n from $ENT where file_path = 'src/Brand_3.py' group by entity_type")
def _(t: Tables) -> DataFrame:
    return t.entities.where(search.equals({"file_path": "src/Brand_3.py"})).groupBy("entity_type").agg(F.count("*").alias("n"))


@query(
    "q9_distances", "a:i b:i cosine:f euclidean:f dot:f",
    "select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as cosine, list_distance(a.embedding::double[], b.embedding::double[]) as euclidean, list_inner_product(a.embedding::double[], b.embedding::double[]) as dot from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
)
def _(t: Tables) -> DataFrame:
    e = t.embeddings
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", vectors.cosine(x, y).alias("cosine"), vectors.euclidean(x, y).alias("euclidean"), vectors.dot(x, y).alias("dot"))


@query("q11_iterative_search", "query:s entity_id:s score:f rank:i", f"select 'ring' as query, entity_id, round(least(1.0, 61.0 / (60 + rank)), 6) as score, rank from ({TOP.format(RAW, 10)}) where query = 'ring'")
def _(t: Tables) -> DataFrame:
    return search.iterative_search(lambda q, mode: search.payload_search(t.entities, t.rows([(q,)], "query string"), 10), "ring")


@query("r1_payload_score", "entity_id:s query:s score:f", f"select entity_id, query, {SCORE} as score from $ENT e, $QRY q")
def _(t: Tables) -> DataFrame:
    return t.entities.join(F.broadcast(t.queries)).select("entity_id", "query", search.payload_score(F.col("query")).alias("score"))


@query("r2_weighted_fusion", "query:s entity_id:s score:f", f"select coalesce(a.query, b.query) as query, coalesce(a.entity_id, b.entity_id) as entity_id, coalesce(a.score, 0) * 0.6 + coalesce(b.score, 0) * 0.4 as score from ({PAYLOAD}) a full join (select query, entity_id, 0.5 as score from ({OTHER}) where rank <= 10) b on a.query = b.query and a.entity_id = b.entity_id")
def _(t: Tables) -> DataFrame:
    return search.weighted_fusion(payload(t), other_list(t), 3.0, 2.0)


@query("r3_reciprocal_rank_fusion", "query:s entity_id:s score:f", RRF.format(f"{PREFIX_LIST} union all select * from ({OTHER}) where rank <= 10"))
def _(t: Tables) -> DataFrame:
    return search.reciprocal_rank_fusion([payload(t), other_list(t)])


@query("r4_multi_list_fusion", "query:s entity_id:s score:f", f"select query, entity_id, least(1.0, sum(1.0::double / (60 + rank)) * 61 / 3) as score from ({PREFIX_LIST} union all select * from ({OTHER}) where rank <= 10 union all {PREFIX_LIST}) group by query, entity_id")
def _(t: Tables) -> DataFrame:
    return search.reciprocal_rank_fusion([payload(t), other_list(t), payload(t)], cap=1.0)


@query("r5_entity_fusion", "query:s entity_id:s score:f origin:s", f"select query, entity_id, sum(s) as score, min(origin) as origin from (select query, entity_id, score * 0.7 as s, 'payload' as origin from ({PAYLOAD}) union all select query, entity_id, 0.15, 'semantic' from ({OTHER}) where rank <= 10) group by query, entity_id")
def _(t: Tables) -> DataFrame:
    return search.entity_fusion(payload(t), other_list(t))


RANK = "select query, entity_id, score, row_number() over (partition by query order by score desc, entity_id) as rank, count(*) over (partition by query) as total_results from ({0})"
RANK_SPEC = "query:s entity_id:s score:f rank:i total_results:i"


@query("r6_score_rank", RANK_SPEC, RANK.format(f"select query, entity_id, score from {RESULTS}"))
def _(t: Tables) -> DataFrame:
    return ranking.by_score(results(t))


def fresh(t: Tables) -> DataFrame:
    return t.entities.where("size % 11 = 0").select("file_path").distinct()


def popular(t: Tables) -> DataFrame:
    return t.entities.where("size % 3 = 0").select("entity_id")


FRESH = "file_path in (select file_path from $ENT where size % 11 = 0)"
POPULAR = "size % 3 = 0"


@query("r7_freshness", RANK_SPEC, RANK.format(f"select query, entity_id, round(score * (1 + case when {FRESH} then 0.03 else 0 end), 6) as score from {RESULTS}"))
def _(t: Tables) -> DataFrame:
    return ranking.freshness(results(t), fresh(t))


@query("r8_popularity", RANK_SPEC, RANK.format(f"select query, entity_id, round(score * (1 + case when {POPULAR} then 0.075 else 0 end + case when {FRESH} then 0.045 else 0 end), 6) as score from {RESULTS}"))
def _(t: Tables) -> DataFrame:
    return ranking.popularity(results(t), popular(t), fresh(t))


QUALITY = "case when length(docstring) > 200 then 0.8 when length(docstring) > 100 then 0.5 when length(docstring) > 50 then 0.3 when length(docstring) > 20 then 0.1 else 0 end"
HINTS = "case when contains(signature, '->') then 0.3 else 0 end + 0.2 * least(3, length(signature) - length(replace(signature, ':', '')))"
MAIN = "not regexp_matches(lower(file_path), 'test|spec|example|__pycache__')"


@query("r9_quality", RANK_SPEC, RANK.format(f"select query, entity_id, round(score * (1 + 0.2::double * ({QUALITY} + {HINTS} + case when {MAIN} then 0.4 else 0 end)), 6) as score from {RESULTS}"))
def _(t: Tables) -> DataFrame:
    return ranking.quality(results(t))


LADDER = "case when length(docstring) > 200 then 0.6 when length(docstring) > 100 then 0.4 when length(docstring) > 50 then 0.2 when length(docstring) > 20 then 0.1 else 0 end"
HYBRID = f"""select query, entity_id, entity_name, signature, file_path, round(score * (1 + case when {FRESH} then 0.03 else 0 end + case when {POPULAR} then 0.075 else 0 end + 0.2::double * {LADDER}
  + case when contains(signature, '->') or contains(signature, ':') then 0.04 else 0 end + case when {MAIN} then 0.15 else 0 end
  + case when lower(entity_name) = lower(query) then 0.5 when contains(lower(entity_name), lower(query)) then 0.3::double * length(query) / length(entity_name) else 0 end), 6) as score from {RESULTS}"""


@query("r10_hybrid_rank", RANK_SPEC, RANK.format(HYBRID))
def _(t: Tables) -> DataFrame:
    return ranking.hybrid(results(t), fresh(t), popular(t))


@query("r11_diversity", RANK_SPEC)
def _(t: Tables) -> DataFrame:
    return ranking.diverse(ranking.by_score(results(t)))


@query(
    "r12_file_cap", RANK_SPEC,
    f"select query, entity_id, score, row_number() over (partition by query order by rank) as rank, count(*) over (partition by query) as total_results from (select *, row_number() over (partition by query, file_path order by rank) as n from {RESULTS}) where n <= 3",
)
def _(t: Tables) -> DataFrame:
    return ranking.per_file(ranking.by_score(results(t)))


@query("r13_rank_pipeline", RANK_SPEC)
def _(t: Tables) -> DataFrame:
    return ranking.rank(results(t), "hybrid", fresh(t), popular(t))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"


@query("r15_jaccard", "a:s b:s similarity:f", f"select a, b, case when len(x) = 0 or len(y) = 0 then 0 else len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))) end as similarity from (select a.query as a, b.p_name as b, {WORDS.format('a.query')} as x, {WORDS.format('b.p_name')} as y from $QRY a, (select distinct p_name from part) b)")
def _(t: Tables) -> DataFrame:
    a, b = F.broadcast(t.queries.toDF("a")), t.part.select("p_name").distinct().toDF("b")
    return b.join(a).select("a", "b", jaccard(F.col("a"), F.col("b")).alias("similarity"))


@query(
    "r17_quality_metrics", "query:s p_at_1:f p_at_5:f recall:f mrr:f",
    f"""with r as ({PAYLOAD}), rel as (select query, entity_id from $ENT e, $QRY q where contains(lower(docstring), lower(query)) and size % 3 = 0),
    h as (select r.query, r.rank, case when rel.entity_id is null then 0.0 else 1.0 end as hit from r left join rel on r.query = rel.query and r.entity_id = rel.entity_id),
    n as (select query, count(distinct entity_id) as n from rel group by query)
    select h.query, sum(case when rank <= 1 then hit else 0 end) as p_at_1, sum(case when rank <= 5 then hit else 0 end) / 5 as p_at_5, sum(hit) / n as recall, max(hit / rank) as mrr from h join n on h.query = n.query group by h.query, n""",
)
def _(t: Tables) -> DataFrame:
    relevant = t.entities.join(F.broadcast(t.queries), F.lower("docstring").contains(F.lower("query"))).where("size % 3 = 0").select("query", "entity_id")
    return ranking.quality_metrics(payload(t), relevant)


@query("m1_embed_texts", "doc_id:i nonzero:i")
def _(t: Tables) -> DataFrame:
    return vectors.embed(t.documents.select("doc_id", "text")).select("doc_id", F.size(F.filter("vector", lambda x: x != 0)).alias("nonzero"))


@query("m4_text_validation", "conv_id:i turn:i n:i", "select conv_id, turn, length(left(trim(coalesce(text, '')), 100)) as n from conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.length(vectors.valid_text(F.col("text"), 100)).alias("n"))


@query("k3_lru_eviction", "user_id:i", "select user_id from (select user_id, max(ts) as last_access, min(ts) as stored_at from events group by user_id) where epoch_us(stored_at) / 1e6 + 3e6 >= epoch_us(timestamp '2024-01-20') / 1e6 order by last_access desc, user_id limit 20")
def _(t: Tables) -> DataFrame:
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    cache = e.groupBy("user_id").agg(F.max("ts").alias("last_access"), F.min("ts").alias("stored_at")).withColumn("key", F.col("user_id"))
    return vectors.evicted(cache, 20, F.lit("2024-01-20").cast("timestamp"), 3e6)


@query("j17_embedding_cache", "part:s n:i", "select case when l.doc_id is null then 'miss' else 'hit' end as part, count(*) as n from documents d left join (select distinct doc_id from labels) l using (doc_id) group by 1")
def _(t: Tables) -> DataFrame:
    texts = t.documents.select(F.col("doc_id").alias("key"))
    cache = t.labels.select(F.col("doc_id").alias("key"), F.lit(0).alias("vector")).distinct()
    hit, miss = vectors.cached_embeddings(texts, cache)
    return hit.select(F.lit("hit").alias("part")).unionByName(miss.select(F.lit("miss").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))
