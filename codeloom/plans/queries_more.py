"""Validation, set, window, cache and document queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.extract import registry
from codeloom.functions import documents, ids, markup, quality, text
from codeloom.operators import search
from codeloom.plans.catalog import Tables, query
from codeloom.plans.queries_core import EVENTS, files, indexed, stream
from codeloom.plans.queries_text import SELECTORS, TAGS, tags
from codeloom.streaming import events as ev


@query("c13_valid_entities", "entity_id:s valid:b", "select entity_id, entity_name = trim(entity_name) and size % 2 = 0 and length(trim(qualified_name)) > 0 as valid from $ENT")
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("size") % 2 == 0, F.concat(F.lit("python::"), "entity_id")).otherwise(F.col("entity_id"))
    return t.entities.select("entity_id", quality.valid_entity(raw, F.col("entity_name"), F.col("qualified_name")).alias("valid"))


@query("c13_valid_locations", "entity_id:s valid:b", "select entity_id, not (size % 3 = 0 and size > 0) as valid from $ENT")
def _(t: Tables) -> DataFrame:
    a, b = F.col("start_line"), F.when(F.col("size") % 3 == 0, F.col("start_line") - F.col("size")).otherwise(F.col("end_line"))
    return t.entities.select("entity_id", quality.valid_location(a, b, F.lit(0), F.lit(5), F.lit(0), F.lit(9)).alias("valid"))


@query("c13_valid_events", "event_type:s valid:b n:i", f"select event_type, event_type <> 'moved' or eid % 2 = 0 as valid, count(*) as n from {EVENTS} group by 1, 2")
def _(t: Tables) -> DataFrame:
    e = stream(t)
    ok = quality.valid_event(F.col("event_type"), F.col("file_path"), F.when(F.col("eid") % 2 == 0, F.col("old_path")))
    return e.groupBy("event_type", ok.alias("valid")).agg(F.count("*").alias("n"))


@query("c12_entity_id_format", "valid:b n:i", "select regexp_matches(x, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$') as valid, count(*) as n from (select case when doc_id % 2 = 0 then substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) else h end as x from (select doc_id, sha256(text) as h from documents)) group by 1")
def _(t: Tables) -> DataFrame:
    h = F.sha2("text", 256)
    x = F.when(F.col("doc_id") % 2 == 0, ids.hyphened(h)).otherwise(h)
    return t.documents.groupBy(ids.is_entity_id(x).alias("valid")).agg(F.count("*").alias("n"))


@query("c14_expired", "user_id:i expired:b", "select user_id, epoch_us(max(ts)) / 1e6 + 86400 < epoch_us(timestamp '2024-01-25') / 1e6 as expired from events group by user_id")
def _(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("at"))
    return last.select("user_id", quality.is_expired(F.col("at"), 86400.0, F.lit("2024-01-25").cast("timestamp")).alias("expired"))


@query("c3_config_filters", "entity_type:s n:i", "select entity_type, count(*) as n from $ENT where entity_type in ('class', 'method') and file_path in ('src/Brand_1.py', 'src/Brand_2.py') group by 1")
def _(t: Tables) -> DataFrame:
    return t.entities.where(search.equals({"entity_type": ["class", "method"], "file_path": ["src/Brand_1.py", "src/Brand_2.py"]})).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("p3_relevance_classes", "relevance:s n:i", "select case when n_chars % 100 / 100.0 > 0.8 then 'high' when n_chars % 100 / 100.0 > 0.6 then 'moderate' else 'low' end as relevance, count(*) as n from documents group by 1")
def _(t: Tables) -> DataFrame:
    return t.documents.groupBy(quality.relevance(F.col("n_chars") % 100 / 100.0).alias("relevance")).agg(F.count("*").alias("n"))


@query("p4_context_blocks", "entity_id:s reference:s", "select entity_id, file_path || ':' || start_line as reference from $ENT")
def _(t: Tables) -> DataFrame:
    return t.entities.select("entity_id", F.concat_ws(":", "file_path", F.col("start_line").cast("string")).alias("reference"))


@query("p5_type_histogram", "entity_type:s n:i first:s", "select entity_type, count(*) as n, min(entity_id) as first from $ENT group by 1")
def _(t: Tables) -> DataFrame:
    return t.entities.groupBy("entity_type").agg(F.count("*").alias("n"), F.min("entity_id").alias("first"))


@query("g16_hit_rate", "lang:s rate:f", "select lang, count(l.doc_id) / cast(count(*) as double) as rate from documents d left join (select distinct doc_id from labels) l using (doc_id) group by lang")
def _(t: Tables) -> DataFrame:
    hit = t.labels.select("doc_id").distinct().withColumn("hit", F.lit(1))
    return t.documents.join(hit, "doc_id", "left").groupBy("lang").agg(quality.hit_rate(F.sum(F.coalesce("hit", F.lit(0))), F.count("*")).alias("rate"))


@query("g17_sync_metrics", "event_type:s mean:f longest:f", "select event_type, avg(value) as mean, max(value) as longest from events group by 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("longest"))


@query("g22_best_suggestion", "key:s confidence:f", "select lower(trim(p_name)) as key, max(p_size / 100.0) as confidence from part group by 1")
def _(t: Tables) -> DataFrame:
    c = F.col("p_size") / 100.0
    return t.part.groupBy(F.lower(F.trim("p_name")).alias("key")).agg(F.max_by(c, c).alias("confidence"))


@query("j5_missing_and_orphan_files", "file_path:s side:s", "select cast(o_custkey as varchar) as file_path, 'missing' as side from (select distinct o_custkey from orders) where o_custkey % 3 = 1 union all select cast(c_custkey as varchar), 'orphan' from customer where c_custkey % 3 <> 1 and c_custkey not in (select o_custkey from orders)")
def _(t: Tables) -> DataFrame:
    f, c = files(t).select("file_path"), indexed(t).select("file_path").distinct()
    return f.join(c, "file_path", "left_anti").withColumn("side", F.lit("missing")).unionByName(c.join(f, "file_path", "left_anti").withColumn("side", F.lit("orphan")))


@query("u3_common_ids", "k:i", "select distinct l_orderkey as k from lineitem intersect select o_orderkey from orders where o_orderpriority = '1-URGENT'")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("k")).intersect(t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey"))


@query("u2_removed_ids", "k:i", "select o_orderkey as k from orders except select l_orderkey from lineitem")
def _(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("k")).subtract(t.lineitem.select("l_orderkey"))


@query("o2_priority_order", "event_id:s place:i", f"select event_id, row_number() over (partition by file_path order by priority, ts, event_id) as place from {EVENTS}")
def _(t: Tables) -> DataFrame:
    return stream(t).select("event_id", F.row_number().over(Window.partitionBy("file_path").orderBy("priority", "ts", "event_id")).alias("place"))


@query("v16_event_priorities", "priority:i n:i", f"select priority, count(*) as n from {EVENTS} group by 1")
def _(t: Tables) -> DataFrame:
    return stream(t).groupBy(ev.priority_of(F.col("event_type")).alias("priority")).agg(F.count("*").alias("n"))


@query("v14_relation_ids", "id:s", "select distinct 'contains::' || r_name || '::' || n_name as id from nation join region on n_regionkey = r_regionkey")
def _(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(ids.raw_id(F.lit("contains"), F.col("r_name"), F.col("n_name")).alias("id")).distinct()


@query("v20_query_key", "a:s n:i", "select left(sha256(cast(json_object('collection', p_brand, 'limit', 10, 'query', p_name) as varchar)), 16) as a, count(*) as n from part group by 1")
def _(t: Tables) -> DataFrame:
    return t.part.groupBy(ids.query_key(collection=F.col("p_brand"), query=F.col("p_name"), limit=F.lit(10)).alias("a")).agg(F.count("*").alias("n"))


ATTR = "coalesce(regexp_extract(raw, '{0}=\"([^\"]*)\"', 1), '')"


@query("x5_attribute_maps", "tag:s ids:i classes:i hrefs:i", f"select tag, count(*) filter (contains(raw, ' id=')) as ids, count(*) filter (contains(raw, ' class=')) as classes, count(*) filter (contains(raw, ' href=')) as hrefs from {TAGS} group by tag")
def _(t: Tables) -> DataFrame:
    n = lambda k: F.count_if(markup.has(F.col("a"), k)).alias
    return tags(t).groupBy("tag").agg(n("id")("ids"), n("class")("classes"), n("href")("hrefs"))


PARTS = "array_to_string(regexp_extract_all(s, '{0}', {1}), ',') as {2}".format
CUT = ", ".join((PARTS("[.]([a-zA-Z_-]+)", 1, "classes"), PARTS("#([a-zA-Z_-]+)", 1, "ids"), PARTS("(^|[^#.a-zA-Z0-9_-])([a-zA-Z][a-zA-Z0-9_-]*)", 2, "elements"), PARTS(":+([a-z-]+)", 1, "pseudo")))


@query("x44_selector_parts", "s:s classes:s ids:s elements:s pseudo:s", f"select s, {CUT} from (select unnest({list(SELECTORS)}) as s)")
def _(t: Tables) -> DataFrame:
    s = F.col("s")
    return t.rows([(x,) for x in SELECTORS], "s string").select("s", *(F.array_join(c, ",").alias(n) for n, c in (("classes", markup.selector_parts(s, ".")), ("ids", markup.selector_parts(s, "#")), ("elements", markup.selector_parts(s, "")), ("pseudo", F.concat(markup.pseudo_classes(s), markup.pseudo_elements(s))))))


@query("x61_json_comments", "event_id:i k:i", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(t: Tables) -> DataFrame:
    commented = F.concat(F.lit("/* note */ "), "props", F.lit(" // end"))
    return t.events.select("event_id", F.try_variant_get(documents.parsed(commented), "$.k", "bigint").alias("k"))


@query("x63_json_signatures", "event_id:i signature:s", "select event_id, '\"props\": { ' || len(json_keys(props)) || ' properties }' as signature from events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", documents.member_signature(F.lit("props"), F.col("props")).alias("signature"))


@query("x66_config_sections", "key:s section:b", "select * from (values ('scripts', true), ('name', false), ('buildOptions', true), ('DevDependencies', true), ('x', false)) t(key, section)")
def _(t: Tables) -> DataFrame:
    rows = t.rows([("scripts",), ("name",), ("buildOptions",), ("DevDependencies",), ("x",)], "key string")
    return rows.select("key", documents.is_section(F.col("key")).alias("section"))


@query("x67_flattened_json", "event_id:i path:s value:s", "select event_id, '$.k' as path, json_extract_string(props, '$.k') as value from events")
def _(t: Tables) -> DataFrame:
    return documents.flattened(t.events, "event_id", "props", 3)


RULES = ("@media screen and (min-width: 3px) {", "@keyframes spin {", '@import url("x.css");', '@charset "utf-8";', "@supports (display: grid) {", "@page {")
NAMED = f"""
select s, type, case type when 'import' then regexp_extract(rest, '"([^"]+)"', 1) when 'supports' then trim(rest, '()') when 'page' then type else rest end as name
from (select s, regexp_extract(s, '@([a-z]+)', 1) as type, trim(regexp_replace(s, '^@[a-z]+|[{{;]$', '', 'g')) as rest from (select unnest({list(RULES)}) as s))"""


@query("x46_at_rules", "s:s type:s name:s", NAMED)
def _(t: Tables) -> DataFrame:
    return t.rows([(x,) for x in RULES], "s string").select("s", markup.at_rule(F.col("s")).alias("r")).select("s", "r.type", "r.name")


CODE = "import os\nLIMIT_A = {0}\nclass Doc{0}(Base):\n    def get(self):\n        return os.path.join('a')\n"


@query("e1_python_entities", "file_path:s entity_type:s entity_name:s start_line:i", "select 'd' || doc_id || '.py' as file_path, unnest(['import', 'constant', 'class', 'method']) as entity_type, unnest(['os', 'LIMIT_A', 'Doc' || doc_id, 'get']) as entity_name, unnest([1, 2, 3, 4]) as start_line from documents")
def _(t: Tables) -> DataFrame:
    before, mid, after = CODE.split("{0}")
    code = F.concat(F.lit(before), "doc_id", F.lit(mid), "doc_id", F.lit(after))
    return registry.entities(t.documents.select(F.concat(F.lit("d"), "doc_id", F.lit(".py")).alias("file_path"), code.alias("content")))


@query("e1_python_relations", "file_path:s relation_type:s target:s", "select 'd' || doc_id || '.py' as file_path, unnest(['imports', 'inherits', 'contains', 'calls']) as relation_type, unnest(['os', 'Base', 'Doc' || doc_id || '.get', 'os.path.join']) as target from documents")
def _(t: Tables) -> DataFrame:
    before, mid, after = CODE.split("{0}")
    code = F.concat(F.lit(before), "doc_id", F.lit(mid), "doc_id", F.lit(after))
    return registry.relations(t.documents.select(F.concat(F.lit("d"), "doc_id", F.lit(".py")).alias("file_path"), code.alias("content")))


def snippet(t: Tables, ext: str, code: str) -> DataFrame:
    """One small file for each part, its name in place of NAME."""
    name = F.concat(F.lit("N"), "p_partkey")
    return t.part.select(F.concat(F.lit("f"), "p_partkey", F.lit(ext)).alias("file_path"), F.replace(F.lit(code), F.lit("NAME"), name).alias("content"))


def language_query(op: str, ext: str, code: str, want: list[tuple[str, str]]) -> None:
    kinds = ", ".join(f"'{k}'" for k, _ in want)
    names = ", ".join("'" + n.replace("NAME", "' || 'N' || p_partkey || '").replace("@", "' || p_partkey || '") + "'" for _, n in want)

    @query(op, "file_path:s entity_type:s entity_name:s", f"select 'f' || p_partkey || '{ext}' as file_path, unnest([{kinds}]) as entity_type, unnest([{names}]) as entity_name from part")
    def _(t: Tables) -> DataFrame:
        return registry.entities(snippet(t, ext, code))


language_query("e2_javascript_entities", ".js", "import a from './NAME.js';\nclass NAME extends B {\n  run(x) { return f(x); }\n}\nfunction g() { return 1; }\nconst LIMIT = 2;\n", [("import", "./NAME.js"), ("class", "NAME"), ("method", "run"), ("function", "g"), ("constant", "LIMIT")])
language_query("e3_typescript_entities", ".ts", "interface NAME { a: string; }\ntype Id = string;\nenum Color { Red }\n", [("interface", "NAME"), ("type", "Id"), ("enum", "Color")])
language_query("e4_go_entities", ".go", 'package main\n\nimport "fmt"\n\ntype NAME struct { x int }\n\nfunc (n *NAME) Run() error { return nil }\n\nfunc helper() {}\n', [("module", "main"), ("import", "fmt"), ("struct", "NAME"), ("method", "Run"), ("function", "helper")])
language_query("e5_rust_entities", ".rs", "use std::io;\npub struct NAME { x: i32 }\nimpl Draw for NAME { }\nfn run() {}\nconst MAX: u8 = 1;\n", [("import", "std::io"), ("struct", "NAME"), ("implementation", "NAME"), ("function", "run"), ("constant", "MAX")])
language_query("e6_java_entities", ".java", "package a.b;\nimport java.util.List;\npublic class NAME {\n  private int size = 0;\n  public int get(int n) { return n; }\n}\n", [("module", "a.b"), ("import", "java.util.List"), ("class", "NAME"), ("variable", "size"), ("method", "get")])
language_query("e7_c_entities", ".c", "#include <stdio.h>\n#define LIMIT 3\nstruct NAME { int x; };\nint run(int a) { return a; }\n", [("import", "stdio.h"), ("constant", "LIMIT"), ("class", "NAME"), ("function", "run")])
language_query("e8_cpp_entities", ".cpp", "#include <vector>\nnamespace geo {\nclass NAME : public Base {\n};\n}\nusing Id = int;\n", [("import", "vector"), ("module", "geo"), ("class", "NAME"), ("type_alias", "Id")])
language_query("e10_css_entities", ".css", "@import url(\"a.css\");\n.NAME { color: red; --gap: 2px; }\n", [("css_import", "a.css"), ("css_rule", ".NAME"), ("css_selector", ".NAME"), ("css_property", "color"), ("css_variable", "--gap")])
language_query("e12_yaml_entities", ".yaml", "NAME:\n  port: 1\n", [("module", "f@.yaml"), ("class", "NAME"), ("constant", "port")])


JACCARD = """
with w as (select item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) as w from benchmark)
select a.item_id as a, b.item_id as b, case when len(a.w) = 0 or len(b.w) = 0 then 0.0 else len(list_intersect(a.w, b.w)) / cast(len(list_distinct(list_concat(a.w, b.w))) as double) end as similarity
from w a join w b on b.item_id = a.item_id + 1"""


@query("s12_query_similarity", "a:i b:i similarity:f", JACCARD)
def _(t: Tables) -> DataFrame:
    b = t.benchmark
    return b.select(F.col("item_id").alias("a"), F.col("text").alias("x")).join(b.select(F.col("item_id").alias("b"), F.col("text").alias("y")), F.col("b") == F.col("a") + 1).select("a", "b", text.jaccard(F.col("x"), F.col("y")).alias("similarity"))
