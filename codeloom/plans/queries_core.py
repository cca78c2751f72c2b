"""Delta, change, consistency, health, structural-join, aggregate, event and extraction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.extract import registry
from codeloom.operators import delta, health, joins
from codeloom.plans.catalog import Tables, query
from codeloom.sources import workspace
from codeloom.sources.collection import entity_files
from codeloom.streaming import events as ev

# workspace: customers with orders, mtime = newest order; collection: customers of even keys, stamped with the newest ship date
WORKSPACE = "(select cast(o_custkey as varchar) as file_path, epoch_us(max(o_orderdate)) / 1e6 as mtime, count(*) as size from orders group by o_custkey)"
COLLECTION = "(select cast(c_custkey as varchar) as file_path, cast(o_orderkey as varchar) as entity_id, case when o_orderkey % 17 = 0 then null else epoch_us(o_orderdate) / 1e6 end as indexed_at from customer left join (select * from orders where o_orderpriority <> '1-URGENT') on c_custkey = o_custkey where c_custkey % 3 <> 1)"


def files(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").cast("string").alias("file_path")).agg((F.unix_micros(F.max("o_orderdate").cast("timestamp")) / 1e6).alias("mtime"), F.count("*").alias("size"))


def indexed(t: Tables) -> DataFrame:
    o = t.orders.where("o_orderpriority <> '1-URGENT'")
    stamp = F.when(F.col("o_orderkey") % 17 != 0, F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6)
    return t.customer.where("c_custkey % 3 <> 1").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").cast("string").alias("file_path"), F.col("o_orderkey").cast("string").alias("entity_id"), stamp.alias("indexed_at"))


DELTA = f"""select coalesce(w.file_path, c.file_path) as file_path, case when c.file_path is null then 'added' when w.file_path is null then 'deleted' when indexed_at is null or mtime - indexed_at > 1 then 'modified' else 'unchanged' end as change_type
  from {WORKSPACE} w full join (select file_path, max(indexed_at) as indexed_at from {COLLECTION} group by file_path) c on w.file_path = c.file_path"""


@query("h1_file_delta", "file_path:s change_type:s", DELTA)
def _(t: Tables) -> DataFrame:
    return delta.file_delta(files(t), indexed(t))


@query(
    "g8_delta_summary", "added:i deleted:i modified:i unchanged:i total_changes:i change_ratio:f",
    f"select *, added + deleted + modified as total_changes, (added + deleted + modified) / cast(deleted + modified + unchanged as double) as change_ratio from (select count(*) filter (change_type = 'added') as added, count(*) filter (change_type = 'deleted') as deleted, count(*) filter (change_type = 'modified') as modified, count(*) filter (change_type = 'unchanged') as unchanged from ({DELTA}))",
)
def _(t: Tables) -> DataFrame:
    return delta.delta_summary(delta.file_delta(files(t), indexed(t)))


@query("g2_latest_indexed", "file_path:s indexed_at:f entities:i", f"select file_path, max(indexed_at) as indexed_at, count(*) as entities from {COLLECTION} group by file_path")
def _(t: Tables) -> DataFrame:
    return delta.latest_indexed(indexed(t))


@query("g1_entities_by_file", "file_path:s n:i first:s", "select file_path, count(distinct entity_id) as n, min(entity_id) as first from $ENT group by file_path")
def _(t: Tables) -> DataFrame:
    return entity_files(t.entities).select("file_path", "n", F.col("entity_ids")[0].alias("first"))


@query("a18_polling_changes", "file_path:s change_type:s", "select * from (select coalesce(a.k, b.k) as file_path, case when a.k is null then 'created' when b.k is null then 'deleted' when a.s <> b.s or a.m <> b.m then 'modified' end as change_type from (select cast(o_custkey as varchar) as k, count(*) as s, max(o_orderkey) as m from orders where o_orderkey % 5 <> 0 group by 1) a full join (select cast(o_custkey as varchar) as k, count(*) as s, max(o_orderkey) as m from orders where o_orderkey % 7 <> 0 group by 1) b on a.k = b.k) where change_type is not null")
def _(t: Tables) -> DataFrame:
    poll = lambda cond: t.orders.where(cond).groupBy(F.col("o_custkey").cast("string").alias("file_path")).agg(F.max("o_orderkey").cast("double").alias("mtime"), F.count("*").alias("size"))
    return delta.snapshot_changes(poll("o_orderkey % 5 <> 0"), poll("o_orderkey % 7 <> 0"))


def snapshot(t: Tables) -> DataFrame:
    d = t.documents
    i = F.col("doc_id")
    return d.select(i.cast("string").alias("entity_id"), F.col("source").alias("file_path"), F.lit("document").alias("entity_type"), F.concat(F.lit("d"), i).alias("qualified_name"), F.concat(F.lit("d"), i).alias("entity_name"), F.substring(F.sha2("text", 256), 1, 16).alias("source_hash"), F.concat(F.col("lang"), F.lit(":"), i).alias("signature"), (i % 100).cast("int").alias("start_line"), (i % 100 + 5).cast("int").alias("end_line"), F.lit(0).alias("start_column"), F.lit(1).alias("end_column"))


def mutated(t: Tables) -> DataFrame:
    i = F.col("entity_id").cast("bigint")
    s = snapshot(t).where(i % 13 != 0)
    return s.withColumns({"source_hash": F.when(i % 5 == 0, F.lit("changed")).otherwise(F.col("source_hash")), "signature": F.when(i % 7 == 0, F.concat("signature", F.lit("!"))).otherwise(F.col("signature")), "start_line": F.col("start_line") + F.when(i % 11 == 0, 3).otherwise(0)})


@query(
    "h8_entity_changes", "entity_id:s change_type:s content_changed:b signature_changed:b location_changed:b confidence:f",
    "select cast(doc_id as varchar) as entity_id, case when doc_id % 13 = 0 then 'deleted' else 'modified' end as change_type, doc_id % 13 <> 0 and doc_id % 5 = 0 as content_changed, doc_id % 13 <> 0 and doc_id % 7 = 0 as signature_changed, doc_id % 13 <> 0 and doc_id % 11 = 0 as location_changed, 1.0 as confidence from documents where doc_id % 13 = 0 or doc_id % 5 = 0 or doc_id % 7 = 0 or doc_id % 11 = 0",
)
def _(t: Tables) -> DataFrame:
    return delta.entity_changes(snapshot(t), mutated(t))


@query("j3_moved_entities", "entity_id:s n:i", "select cast(doc_id as varchar) || 'x' as entity_id, 1 as n from documents where doc_id % 13 <> 0 and doc_id % 7 <> 0 and doc_id % 3 = 0")
def _(t: Tables) -> DataFrame:
    new = mutated(t).where(F.col("entity_id").cast("bigint") % 3 == 0).withColumn("entity_id", F.concat("entity_id", F.lit("x")))
    return delta.entity_changes(snapshot(t), new, ("entity_id",)).where("change_type = 'moved'").groupBy("entity_id").agg(F.count("*").alias("n"))


@query(
    "r16_entity_similarity", "a:s b:s similarity:f",
    """select a.entity_id as a, b.entity_id as b, case when a.entity_type <> b.entity_type then 0 else least(1.0, case when a.entity_name = b.entity_name then 0.3 else 0 end + case when a.signature = b.signature then 0.4 else 0.2 end
    + case when a.docstring = b.docstring then 0.2 else 0 end + case when a.start_line = b.start_line then 0.1 when abs(a.start_line - b.start_line) <= 5 then 0.05 else 0 end) end as similarity from $ENT a join $ENT b on b.partkey = a.partkey + 1""",
)
def _(t: Tables) -> DataFrame:
    e = t.entities.withColumn("source_hash", F.col("docstring"))
    packed = lambda n: e.select(F.struct(*e.columns).alias(n))
    pairs = packed("a").join(packed("b"), F.col("b.partkey") == F.col("a.partkey") + 1)
    return pairs.select(F.col("a.entity_id").alias("a"), F.col("b.entity_id").alias("b"), delta.similarity().alias("similarity"))


CONSISTENCY = f"select 'orphaned_entity' as issue_type, entity_id, file_path from {COLLECTION} where file_path not in (select file_path from {WORKSPACE}) union all select 'missing_entity', null, file_path from {WORKSPACE} where file_path not in (select file_path from {COLLECTION})"


@query("h5_consistency", "issue_type:s entity_id:s file_path:s", CONSISTENCY)
def _(t: Tables) -> DataFrame:
    return delta.consistency(indexed(t), files(t))


@query("g24_issue_summary", "orphaned:i missing:i stale:i total:i", f"select count(*) filter (issue_type = 'orphaned_entity') as orphaned, count(*) filter (issue_type = 'missing_entity') as missing, 0 as stale, count(*) as total from ({CONSISTENCY})")
def _(t: Tables) -> DataFrame:
    return delta.issue_summary(delta.consistency(indexed(t), files(t)))


@query("j6_deep_consistency", "issue_type:s entity_id:s", "select case when doc_id % 13 = 0 then 'orphaned_entity' else 'stale_entity' end as issue_type, cast(doc_id as varchar) as entity_id from documents where doc_id % 13 = 0 or doc_id % 5 = 0")
def _(t: Tables) -> DataFrame:
    return delta.deep_consistency(snapshot(t), mutated(t))


@query("b12_replacement", "file_path:s action:s n:i", "select source as file_path, case when doc_id % 13 = 0 then 'removed' else 'unchanged' end as action, count(*) as n from documents group by 1, 2")
def _(t: Tables) -> DataFrame:
    return delta.replacement(snapshot(t), mutated(t)).groupBy("file_path", "action").agg(F.count("*").alias("n"))


@query("g21_keep_last", "l_orderkey:i l_linenumber:i", "select l_orderkey, max(l_linenumber) as l_linenumber from lineitem group by l_orderkey")
def _(t: Tables) -> DataFrame:
    return delta.keep_last(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"])


@query("g23_keep_first", "l_orderkey:i l_linenumber:i", "select l_orderkey, min(l_linenumber) as l_linenumber from lineitem group by l_orderkey")
def _(t: Tables) -> DataFrame:
    return delta.keep_first(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"])


@query("c9_stale_entities", "entity_id:s", "select entity_id from $ENT where indexed_at is null or indexed_at < 900950")
def _(t: Tables) -> DataFrame:
    return delta.stale_entities(t.entities, 900950.0).select("entity_id")


META = "select count(*) as total_entities, count(distinct file_path) as file_coverage, count(distinct entity_type) as types, count(*) filter (entity_type = 'unknown') / cast(count(*) as double) as unknown_ratio, count(*) / cast(count(distinct file_path) as double) as per_file, min(indexed_at) as oldest, max(indexed_at) as newest"
HEALTH = f"""select brand, state, greatest(0.0, 0.4::double + 0.4 * greatest(0.0, 1 - age / 48) + 0.1 * least(1.0, types / 3.0) + 0.1 * least(1.0, per_file / 5.0) - case when state in ('stale', 'inconsistent') then 0.1 else 0 end) * case state when 'inconsistent' then 0.6 when 'stale' then 0.8 else 1 end * case when unknown_ratio > 0.5 then 1 - unknown_ratio * 0.5 else 1 end as health_score, age as age_hours
  from (select *, case when age > 24 then 'stale' when per_file < 1 or unknown_ratio > 0.5 then 'inconsistent' else 'healthy' end as state from (select *, (980000 - newest) / 3600 as age from (select brand, {META[7:]} from $ENT group by brand)))"""


@query("g3_collection_metadata", "total_entities:i file_coverage:i types:i unknown_ratio:f per_file:f oldest:f newest:f", f"{META} from $ENT")
def _(t: Tables) -> DataFrame:
    return health.metadata(t.entities)


@query("h7_collection_health", "brand:s state:s health_score:f age_hours:f", HEALTH)
def _(t: Tables) -> DataFrame:
    return health.analysed(health.metadata(t.entities, "brand"), F.lit(980000.0))


ADVICE = f"""
select brand, concat_ws(' | ', case state when 'stale' then 'Perform incremental scan to update stale entities' when 'inconsistent' then 'Run consistency validation and repair'
    else case when round(health_score, 6) < 0.7 then 'Consider incremental scan to improve collection health' else 'Collection is healthy - enable real-time sync monitoring' end end,
  case when state = 'stale' and age_hours > 72 then 'Consider full rescan due to extended staleness' end, case when state = 'inconsistent' and unknown_ratio > 0.5 then 'Check parser configuration for supported file types' end,
  case when types <= 1 then 'Verify parser is extracting diverse entity types' end) as advice
from ({HEALTH}) join (select brand, {META[7:]} from $ENT group by brand) using (brand)"""


@query("g6_recommendations", "brand:s advice:s", ADVICE)
def _(t: Tables) -> DataFrame:
    return health.analysed(health.metadata(t.entities, "brand"), F.lit(980000.0)).select("brand", F.array_join("recommendations", " | ").alias("advice"))


# structural joins over lineitem: spans are orders' line ranges, points are lines
@query("j9_containing_span", "key:i span_id:i", "select key, min_by(id, a::bigint * 1000000000 + id) as span_id from (select p_partkey as key, p_brand as f, (p_partkey % 500) * 20 as pos from part) p join (select p_partkey as id, p_brand as g, (p_partkey % 500) * 20 - p_size as a, (p_partkey % 500) * 20 + p_size as b from part) s on g = f and a <= pos and pos <= b group by key")
def _(t: Tables) -> DataFrame:
    p = t.part
    at = (F.col("p_partkey") % 500) * 20
    spans = p.select("p_brand", (at - F.col("p_size")).alias("a"), (at + F.col("p_size")).alias("b"), F.col("p_partkey").alias("id"))
    return joins.containing(p.select("p_brand", at.alias("at"), F.col("p_partkey").alias("key")), spans, "p_brand", "at", "a", "b", "key", "id")


@query("c5_overlap_join", "a:s b:s", "select a.entity_id as a, b.entity_id as b from $ENT a join $ENT b on a.file_path = b.file_path and a.start_line <= b.end_line and b.start_line <= a.end_line and a.entity_type = 'class' and b.entity_type = 'import'")
def _(t: Tables) -> DataFrame:
    cut = lambda kind, name: t.entities.where(F.col("entity_type") == kind).select("file_path", "start_line", "end_line", F.col("entity_id").alias(name))
    return joins.overlapping(cut("class", "a"), cut("import", "b"), "file_path", "a", "b")


@query("j8_first_match", "o_orderkey:i l_partkey:i", "select o_orderkey, l_partkey from orders left join (select l_orderkey, min_by(l_partkey, l_linenumber::bigint * 1000000000 + l_partkey) as l_partkey from lineitem group by l_orderkey) on o_orderkey = l_orderkey")
def _(t: Tables) -> DataFrame:
    return joins.first_match(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k"), "l_partkey", "l_linenumber"), "k", "l_partkey", "l_linenumber").select(F.col("k").alias("o_orderkey"), "l_partkey")


@query("j18_last_definition", "entity_name:s entity_id:s", "select entity_name, max_by(entity_id, partkey) as entity_id from $ENT group by entity_name")
def _(t: Tables) -> DataFrame:
    return joins.last_definition(t.entities, "entity_name", "entity_id", "partkey")


@query("j14_last_anchor", "event_id:i anchor:i", "select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as anchor from events")
def _(t: Tables) -> DataFrame:
    return joins.as_of(t.events, "user_id", "event_id", F.col("event_type") == "signup", "event_id", "anchor").select("event_id", "anchor")


@query("j12_child_parent", "child:i parent:i", "select n_nationkey as child, r_regionkey + 100 as parent from nation join region on n_regionkey = r_regionkey")
def _(t: Tables) -> DataFrame:
    nodes = t.region.select(F.concat(F.lit("$.r"), "r_regionkey").alias("path"), (F.col("r_regionkey") + 100).alias("key")).unionByName(t.nation.select(F.concat(F.lit("$.r"), "n_regionkey", F.lit("[" ), "n_nationkey", F.lit("]")).alias("path"), F.col("n_nationkey").alias("key")))
    return joins.child_parent(nodes, "path", "key")


@query("j11_variable_uses", "property_id:i variable:s", "select p_partkey as property_id, '--v' || p_size % 4 as variable from part where p_size % 4 <> 3")
def _(t: Tables) -> DataFrame:
    v = F.concat(F.lit("--v"), F.col("p_size") % 4)
    props = t.part.select(F.col("p_partkey").alias("property_id"), F.concat(F.lit("calc(var( "), v, F.lit(") + 1px)")).alias("value"))
    return joins.variable_uses(props, t.spark.range(3).select(F.concat(F.lit("--v"), "id").alias("variable")))


@query("j13_same_file_pairs", "n_name:s s:i", "select n_name, count(*) as s from nation join supplier on n_nationkey = s_nationkey group by n_name")
def _(t: Tables) -> DataFrame:
    return joins.within_group(t.nation.withColumnRenamed("n_nationkey", "k"), t.supplier.withColumnRenamed("s_nationkey", "k"), "k").groupBy("n_name").agg(F.count("*").alias("s"))


@query("j15_project_of", "event_id:i project:s", "select event_id, case when user_id % 2 = 0 then 'even' else 'all' end as project from events")
def _(t: Tables) -> DataFrame:
    paths = t.events.select("event_id", F.concat(F.lit("/w/"), F.when(F.col("user_id") % 2 == 0, "e/").otherwise("o/"), "user_id").alias("file_path"))
    return ev.project_of(paths, t.rows([("all", "/w"), ("even", "/w/e/")], "project string, root string"))


def order_edges(li: DataFrame) -> DataFrame:
    """source, target: every order to its parts, every part to its suppliers."""
    parts = li.select(F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    return parts.unionByName(li.select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"))).distinct()


@query("v14_graph_reach", "node:s hops:i", "with recursive e as (select distinct 'o' || l_orderkey as s, 'p' || l_partkey as t from lineitem where l_orderkey < 40 union select distinct 'p' || l_partkey, 's' || l_suppkey from lineitem), h1 as (select distinct t as node from e where s = 'o1'), h2 as (select distinct t as node from e join h1 on s = h1.node) select 'o1' as node, 0 as hops union all select node, 1 from h1 union all select node, 2 from h2 where node not in (select node from h1)")
def _(t: Tables) -> DataFrame:
    return joins.neighbours(order_edges(t.lineitem), t.rows([("o1",)], "node string"), 2)


# events as a file-event stream
KIND = "case event_type when 'error' then 'deleted' when 'signup' then 'created' when 'purchase' then 'moved' else 'modified' end"
PRIORITY = "case event_type when 'error' then 1 when 'signup' then 3 when 'purchase' then 4 else 2 end"
EVENTS = f"(select cast(event_id as varchar) as event_id, cast(user_id as varchar) as file_path, case event_type when 'purchase' then 'old/' || user_id end as old_path, ts, {KIND} as event_type, {PRIORITY} as priority, event_id as eid from events)"
NOW = "timestamp '2024-02-01'"


def stream(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "purchase", "moved").otherwise("modified")
    path = F.col("user_id").cast("string")
    e = t.events.select(F.col("event_id").cast("string").alias("event_id"), path.alias("file_path"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("old/"), path)).alias("old_path"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event_type"), F.col("event_id").alias("eid"))
    return ev.with_priority(e)


def now() -> F.Column:
    return F.lit("2024-02-01").cast("timestamp")


@query(
    "t1_debounce", "file_path:s event_id:s events:i",
    f"select file_path, max_by(event_id, epoch_us(ts) * 1000 + 0) as event_id, count(*) as events from (select *, sum(start) over (partition by file_path order by ts rows unbounded preceding) as w from (select *, case when lag(ts) over (partition by file_path order by ts) is null or ts - lag(ts) over (partition by file_path order by ts) >= interval 30 minute then 1 else 0 end as start from {EVENTS})) group by file_path, w",
)
def _(t: Tables) -> DataFrame:
    return ev.debounced(stream(t), "30 minutes")


@query("t2_pending", "file_path:s event_id:s", f"select file_path, max_by(event_id, ts) as event_id from {EVENTS} group by file_path")
def _(t: Tables) -> DataFrame:
    return ev.pending(stream(t))


@query("t4_unexpired", "event_id:s", f"select event_id from {EVENTS} where epoch_us({NOW}) - epoch_us(ts) <= 60e6 * 60 * 24 * 15")
def _(t: Tables) -> DataFrame:
    return ev.unexpired(stream(t), now(), 60 * 24 * 15)


BATCHED = f"select *, cast(floor((n - 1) / 10) as bigint) as batch, (n - 1) % 10 as place from (select *, row_number() over (partition by file_path order by priority, ts, event_id) as n from {EVENTS})"


@query("t5_batches", "event_id:s batch:i place:i immediate:b", f"select event_id, batch, place, min(priority) over (partition by file_path, batch) = 1 as immediate from ({BATCHED})")
def _(t: Tables) -> DataFrame:
    return ev.batches(stream(t), 10, "file_path")


@query("g12_batch_stats", "file_path:s batch:i events:i highest:i critical:i low:i", f"select file_path, batch, count(*) as events, min(priority) as highest, count(*) filter (priority = 1) as critical, count(*) filter (priority = 4) as low from ({BATCHED}) group by file_path, batch")
def _(t: Tables) -> DataFrame:
    return ev.batch_stats(ev.batches(stream(t), 10, "file_path"), "file_path")


@query("g11_queue_stats", "priority:i event_type:s events:i avg_wait:f", f"select priority, event_type, count(*) as events, round(avg((epoch_us({NOW}) - epoch_us(ts)) / 1e6), 3) as avg_wait from {EVENTS} group by 1, 2")
def _(t: Tables) -> DataFrame:
    return ev.queue_stats(stream(t), now()).withColumn("avg_wait", F.round("avg_wait", 3))


@query("w4_rolling_wait", "event_id:s rolling_wait:f", f"select event_id, round(avg((epoch_us({NOW}) - epoch_us(ts)) / 1e6) over (partition by file_path order by ts, event_id rows unbounded preceding), 1) as rolling_wait from {EVENTS}")
def _(t: Tables) -> DataFrame:
    return ev.rolling_wait(stream(t), now(), "file_path").withColumn("rolling_wait", F.round("rolling_wait", 1))


@query("t8_moves", "event_type:s n:i", f"select event_type, count(*) as n from (select event_type from {EVENTS} where event_type <> 'moved' union all select unnest(['deleted', 'created']) from {EVENTS} where event_type = 'moved') group by 1")
def _(t: Tables) -> DataFrame:
    return ev.moves_split(stream(t)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("a17_converted", "event_type:s n:i", f"select case when event_type = 'moved' then 'created' else event_type end as event_type, count(*) as n from {EVENTS} group by 1")
def _(t: Tables) -> DataFrame:
    return ev.converted(stream(t), lambda p: ~p.startswith("old/") & (p != "")).groupBy("event_type").agg(F.count("*").alias("n"))


STATE = f"select file_path, max_by(event_type, ts) as e, max(ts) as ts from {EVENTS} group by file_path"


@query("t16_last_state", "file_path:s exists:b deleted:i", f"select file_path, e <> 'deleted' as exists, case when e = 'deleted' then epoch_us(ts) end as deleted from ({STATE})")
def _(t: Tables) -> DataFrame:
    return ev.last_state(stream(t)).select("file_path", "exists", F.unix_micros("deleted_at").alias("deleted"))


@query("t11_tombstones", "file_path:s", f"select file_path from ({STATE}) where e <> 'deleted' or epoch_us({NOW}) - epoch_us(ts) <= 1e6 * 86400 * 10")
def _(t: Tables) -> DataFrame:
    return ev.tombstones(ev.last_state(stream(t)), now(), 86400 * 10)


@query("t9_retries", "event_id:s retry_count:i", f"select event_id, eid % 5 + 1 as retry_count from {EVENTS} where eid % 5 < 3")
def _(t: Tables) -> DataFrame:
    return ev.retried(stream(t).withColumn("retry_count", F.col("eid") % 5).withColumn("max_retries", F.lit(3)))


@query("t10_unconfirmed", "event_id:s", f"select event_id from {EVENTS} where eid % 4 <> 0 and epoch_us({NOW}) - epoch_us(ts) > 5e6")
def _(t: Tables) -> DataFrame:
    return ev.unconfirmed(stream(t), stream(t).where("eid % 4 = 0"), now())


@query("t3_admitted", "event_id:s", f"select event_id from {EVENTS} order by ts, event_id limit 1000")
def _(t: Tables) -> DataFrame:
    return ev.admitted(stream(t))


@query("w5_failure_runs", "run_id:i failures:i", "select event_id as run_id, case when ok then 0 else sum(case when ok then 0 else 1 end) over (partition by user_id, island order by event_id rows unbounded preceding) end as failures from (select *, sum(case when ok then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as island from (select *, event_type <> 'error' as ok from events))")
def _(t: Tables) -> DataFrame:
    return ev.failure_runs(t.events.select(F.col("event_id").alias("run_id"), "user_id", F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("ok")), "user_id")


@query("g9_success_rates", "user_id:i total:i ok:i success_rate:f per_second:f", "select user_id, count(*) as total, count(*) filter (event_type <> 'error') as ok, round(count(*) filter (event_type <> 'error') / cast(count(*) as double), 6) as success_rate, count(*) / round(sum(value), 6) as per_second from events group by user_id")
def _(t: Tables) -> DataFrame:
    return joins.success_rates(t.events.select("user_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("seconds")), "user_id")


@query("g13_languages", "language:s files:i share:f dominant:b", "select lang as language, count(*) as files, count(*) / sum(count(*)) over () as share, row_number() over (order by count(*) desc, lang) = 1 as dominant from documents group by lang")
def _(t: Tables) -> DataFrame:
    return workspace.language_histogram(t.documents.select(F.col("lang").alias("language")))


@query("g15_relevance", "lang:s mean:f high:i", "select lang, avg(n_chars % 100 / 100.0) as mean, count(*) filter (n_chars % 100 / 100.0 > 0.8) as high from documents group by lang")
def _(t: Tables) -> DataFrame:
    score = F.col("n_chars") % 100 / 100.0
    return t.documents.groupBy("lang").agg(F.avg(score).alias("mean"), F.count_if(score > 0.8).alias("high"))


TREE = """
with f as (select distinct regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages), q as (select string_split(path, '/') as parts from f where path not like '%/'),
n as (select distinct parts[1:i] as p, i < len(parts) as folder from (select parts, unnest(range(1, least(len(parts), 5) + 1)) as i from q)),
k as (select array_to_string(list_transform(p, lambda x, j: case when folder or j < len(p) then '0' else '1' end || x), '/') as k, repeat('  ', len(p) - 1) || p[len(p)] || case when folder then '/' else '' end as line from n)
select row_number() over (order by k) as line_no, line from (select * from k order by k limit 1000)"""


@query("a16_project_tree", "line_no:i line:s", TREE)
def _(t: Tables) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return workspace.project_tree(t.pages.select(bare.alias("file_path")).where("file_path not like '%/'").distinct())


@query("u1_changed_files", "file_path:s", f"select file_path from ({DELTA}) where change_type in ('added', 'modified')")
def _(t: Tables) -> DataFrame:
    d = delta.file_delta(files(t), indexed(t))
    return d.where("change_type = 'added'").union(d.where("change_type = 'modified'")).select("file_path").distinct()


@query("o5_chunks", "c_custkey:i chunk:i", "select c_custkey, cast(floor((row_number() over (partition by c_nationkey order by c_custkey) - 1) / 100) as bigint) as chunk from customer")
def _(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    return t.customer.select("c_custkey", F.floor(n / 100).alias("chunk"))


# extraction
def page_files(t: Tables) -> DataFrame:
    return t.pages.select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("file_path"), F.col("html").alias("content"))


@query("e9_html_entities", "file_path:s entity_type:s n:i")
def _(t: Tables) -> DataFrame:
    return registry.entities(page_files(t)).groupBy("file_path", "entity_type").agg(F.count("*").alias("n"))


@query("e9_html_relations", "file_path:s relation_type:s n:i")
def _(t: Tables) -> DataFrame:
    return registry.relations(page_files(t)).groupBy("file_path", "relation_type").agg(F.count("*").alias("n"))


@query("e11_json_entities", "file_path:s entity_type:s entity_name:s", "select 'e' || event_id || '.json' as file_path, unnest(['module', 'constant']) as entity_type, unnest(['e' || event_id || '.json', 'k']) as entity_name from events")
def _(t: Tables) -> DataFrame:
    return registry.entities(t.events.select(F.concat(F.lit("e"), "event_id", F.lit(".json")).alias("file_path"), F.col("props").alias("content")))


@query("e19_parse_stats", "files:i parsed:i failed:i success_rate:f", "select count(*) as files, count(*) as parsed, 0 as failed, 1.0 as success_rate from pages")
def _(t: Tables) -> DataFrame:
    return registry.parse_stats(page_files(t))


@query("e16_recovered_text", "doc_id:i n:i", "select doc_id, length(text) as n from documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length(workspace.recovered(F.concat(F.col("text"), F.lit("\x00")))).alias("n"))
