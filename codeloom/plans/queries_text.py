"""Ids, text, query-analysis, suggestion, markup and path queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.functions import ids, markup, suggest, text
from codeloom.plans.catalog import Tables, query
from codeloom.sources import workspace

URL = "(select page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages)"
QUESTIONS = (
    "def parse", "how to open a file quickly", "class Reader in reader.py", 'name:"Reader"', "find code that reads files", "reader", "***", "open file reader handle", "file: config.py",
    "read all of the rows in a table fast", "import os", "  spaced   out  ", "self.rows", "explain parsing", "test helper", "async handler", "search.go", "what is this",
)
ASKED = "(select * from (values " + ", ".join("('" + q.replace("'", "''") + "')" for q in QUESTIONS) + ") t(query))"


def asked(t: Tables) -> DataFrame:
    return t.rows([(q,) for q in QUESTIONS], "query string")


def paths(t: Tables) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return t.pages.select("page_id", "url", bare.alias("path"))


@query("s19_hashes", "doc_id:i source_hash:s file_hash:s embedding_key:s", "select doc_id, substr(sha256(text), 1, 16) as source_hash, sha256(text) as file_hash, substr(sha256('m:' || text), 1, 32) as embedding_key from documents")
def _(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select("doc_id", ids.source_hash(x).alias("source_hash"), ids.file_hash(x).alias("file_hash"), ids.embedding_key(F.lit("m"), x).alias("embedding_key"))


@query("s19_point_id", "entity_id:s point_id:s", "select entity_id, cast(cast('0x' || substr(sha256(entity_id), 1, 16) as ubigint) as varchar) as point_id from $ENT")
def _(t: Tables) -> DataFrame:
    return t.entities.select("entity_id", ids.point_id(F.col("entity_id")).alias("point_id"))


BODY = "entity_name || ':' || entity_type || ':' || start_line || ':0:' || sha256(file_path) || ':' || qualified_name || ':' || substr(sha256(signature), 1, 8)"


@query("s19_entity_id", "entity_id:s uuid:s valid:b", f"select entity_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as uuid, true as valid from (select entity_id, sha256({BODY}) as h from $ENT)")
def _(t: Tables) -> DataFrame:
    c = F.col
    uuid = ids.entity_id(c("entity_name"), c("entity_type"), c("start_line"), F.lit(0), F.sha2("file_path", 256), c("qualified_name"), c("signature"))
    return t.entities.select("entity_id", uuid.alias("uuid")).withColumn("valid", ids.is_entity_id(F.col("uuid")))


@query("s21_location_id", "entity_id:s location_id:s raw_id:s", "select entity_id, file_path || ':' || start_line || ':0' as location_id, 'python::' || entity_type || '::' || qualified_name || '::' || start_line as raw_id from $ENT")
def _(t: Tables) -> DataFrame:
    c = F.col
    return t.entities.select("entity_id", ids.location_id(c("file_path"), c("start_line"), F.lit(0)).alias("location_id"), ids.raw_id(F.lit("python"), c("entity_type"), c("qualified_name"), c("start_line")).alias("raw_id"))


def marks_sql(marks: tuple[str, ...], kind: str, column: str) -> str:
    value = lambda p: p if kind in ("exact", "file", "semantic") else p.strip()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "list_filter([" + ", ".join(f"case when contains({column}, {quoted(p)}) then {quoted(kind + ':' + value(p))} end" for p in marks) + "], lambda x: x is not null)"


PATTERNS = f"list_concat(list_concat({marks_sql(text.EXACT_MARKS, 'exact', 'query')}, {marks_sql(text.CODE_MARKS, 'code', 'low')}), list_concat({marks_sql(text.FILE_MARKS, 'file', 'low')}, {marks_sql(text.SEMANTIC_MARKS, 'semantic', 'low')}))"
ANALYSIS = f"""
select query, cleaned, word_count, array_to_string(patterns, ',') as patterns, split_part(choice, ';', 1) as mode, cast(split_part(choice, ';', 2) as double) as confidence from (
  select *, case when len({marks_sql(text.EXACT_MARKS, 'exact', 'query')}) > 0 then 'payload;0.9' when len({marks_sql(text.SEMANTIC_MARKS, 'semantic', 'low')}) > 0 and word_count >= 4 then 'semantic;0.8'
    when len({marks_sql(text.CODE_MARKS, 'code', 'low')}) > 0 then case when word_count <= 2 then 'payload;0.7' else 'hybrid;0.8' end
    when len({marks_sql(text.FILE_MARKS, 'file', 'low')}) > 0 then 'payload;0.7' when word_count <= 2 and not regexp_matches(low, '[\\p{{L}}\\p{{N}}\\s]') then 'hybrid;0.4'
    when word_count <= 2 then 'payload;0.6' when word_count >= 6 then 'semantic;0.6' else 'hybrid;0.5' end as choice, {PATTERNS} as patterns
  from (select query, trim(regexp_replace(query, '\\s+', ' ', 'g')) as cleaned, lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) as low,
    len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '')) as word_count from {ASKED}))"""


@query("s7_query_analysis", "query:s cleaned:s word_count:i patterns:s mode:s confidence:f", ANALYSIS)
def _(t: Tables) -> DataFrame:
    return asked(t).select("query", text.analyse(F.col("query")).alias("a")).select("query", "a.cleaned", "a.word_count", F.array_join("a.patterns", ",").alias("patterns"), "a.mode", "a.confidence")


EXPLAINED = f"""
select query, case when mode = 'payload' and contains(patterns, 'exact:') then 'Exact search: the query has exact-match marks ' || shown
  when mode = 'payload' and word_count <= 2 then 'Keyword search: a short query of ' || word_count || ' words' when mode = 'payload' then 'Keyword search: file or code marks ' || shown
  when mode = 'semantic' and contains(patterns, 'semantic:') then 'Semantic search: natural-language marks ' || shown when mode = 'semantic' then 'Semantic search: a long query of ' || word_count || ' words'
  else 'Hybrid search: keyword and vector results for ' || word_count || ' words' end as why from (select *, '[' || replace(patterns, ',', ', ') || ']' as shown from ({ANALYSIS}))"""


@query("p8_mode_explanations", "query:s why:s", EXPLAINED)
def _(t: Tables) -> DataFrame:
    return asked(t).select("query", text.explain_mode(text.analyse(F.col("query"))).alias("why"))


ANY = lambda c, ws: "(" + " or ".join(f"contains({c}, '{w}')" for w in ws) + ")"


@query("s8_planned_mode", "query:s mode:s", f"select query, case when len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '')) <= 3 and not {ANY('lower(query)', ('how', 'what', 'why', 'explain'))} then 'payload' when {ANY('lower(query)', ('explain', 'how', 'pattern', 'implement', 'example'))} then 'semantic' else 'hybrid' end as mode from {ASKED}")
def _(t: Tables) -> DataFrame:
    return asked(t).select("query", text.planned_mode(F.col("query")).alias("mode"))


@query("s9_sanitised", "conv_id:i turn:i n:i", "select conv_id, turn, length(regexp_replace(left(text, 120), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) as n from conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.length(text.sanitise(F.col("text"), 120)).alias("n"))


STEM = "case when length(w) <= 4 then w " + " ".join(f"when ends_with(w, '{s}') and length(w) > {len(s) + 2} then left(w, length(w) - {len(s)})" for s in text.STEM_SUFFIXES) + " else w end"


@query("s10_stems", "stem:s n:i", f"select {STEM} as stem, count(*) as n from (select distinct unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) as w from benchmark) group by 1")
def _(t: Tables) -> DataFrame:
    w = t.benchmark.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").distinct()
    return w.groupBy(text.stem(F.col("w")).alias("stem")).agg(F.count("*").alias("n"))


LONG = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: length(w) >= 3)"
RELATED = f"""
with q as (select query, lower(trim(query)) as low from {ASKED}), w as (select query, w, {STEM} as stem from (select query, unnest({LONG.format('low')}) as w from q)),
shared as (select distinct x.query as a, y.query as b from w x join w y on x.w = y.w or (length(x.w) >= 4 and (contains(y.w, x.w) or contains(x.w, y.w)))
  or (length(x.w) >= 4 and length(y.w) >= 4 and left(x.w, 4) = left(y.w, 4)) or (length(x.w) > 3 and length(y.w) > 3 and x.stem = y.stem and length(x.stem) > 2))
select x.query as a, y.query as b from q x join q y on x.low <> y.low where contains(y.low, x.low) or contains(x.low, y.low) or exists (select 1 from shared s where s.a = x.query and s.b = y.query)"""


@query("s11_related_queries", "a:s b:s", RELATED)
def _(t: Tables) -> DataFrame:
    a, b = asked(t).toDF("a"), F.broadcast(asked(t).toDF("b"))
    return a.join(b, text.related(F.col("a"), F.col("b")))


@query("s18_suggestions", "query:s text:s kind:s confidence:f rank:i")
def _(t: Tables) -> DataFrame:
    return suggest.suggestions(asked(t).withColumn("current_file", F.lit("src/reader_test.py")).withColumn("recent", F.array(F.lit("def parse rows"), F.lit("class Reader"))), 10)


@query("s18_hints", "query:s hints:s")
def _(t: Tables) -> DataFrame:
    return asked(t).select("query", F.array_join(suggest.hints(F.col("query")), " | ").alias("hints"))


@query("g19_frequent_terms", "term:s n:i", "select w as term, count(*) as n from (select unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) >= 3)) as w from benchmark) group by w")
def _(t: Tables) -> DataFrame:
    return t.benchmark.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("term")).where("length(term) >= 3").groupBy("term").agg(F.count("*").alias("n"))


@query("g20_language_vote", "query:s lang:s")
def _(t: Tables) -> DataFrame:
    return asked(t).select("query", suggest.language_vote(F.col("query"), F.lit("a/b.go"), F.array(F.lit("import x"))).alias("lang"))


@query("s20_parse_time", "value:s epoch:f", "select value, epoch from (values ('12.5', 12.5), ('2024-01-02T03:04:05Z', 1704164645.0), ('2024-01-02T03:04:05.250000', 1704164645.25), ('2024-01-02', 1704153600.0), ('never', null), ('', null)) v(value, epoch)")
def _(t: Tables) -> DataFrame:
    rows = t.rows([(v,) for v in ("12.5", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.250000", "2024-01-02", "never", "")], "value string")
    return rows.select("value", text.parse_time(F.col("value")).alias("epoch"))


@query("s22_words", "conv_id:i turn:i n:i start:s", "select conv_id, turn, len(w) as n, case when len(w) > 5 then array_to_string(w[1:5], ' ') || '...' else text end as start from (select *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from conversations)")
def _(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.conversations.select("conv_id", "turn", text.word_count(x).alias("n"), text.first_words(x, 5).alias("start"))


@query("s23_backoff", "n:i retry:f worker:f", "select n, least(pow(2, n), 30) as retry, case when n < 3 then 0 else least(pow(2, n - 3), 30) end as worker from (select unnest(range(0, 12)) as n)")
def _(t: Tables) -> DataFrame:
    n = F.col("n")
    return t.spark.range(12).toDF("n").select("n", text.retry_delay(n).alias("retry"), text.worker_backoff(n).alias("worker"))


@query("x84_paths", "page_id:i ext:s base:s test:b", f"select page_id, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) as ext, split_part(path, '/', -1) as base, regexp_matches(lower(path), 'test_|_test\\.|spec\\.|\\.test\\.|/tests/|/test/') as test from {URL}")
def _(t: Tables) -> DataFrame:
    p = F.col("path")
    return paths(t).select("page_id", text.extension(p).alias("ext"), text.basename(p).alias("base"), text.is_test_path(p).alias("test"))


@query("p6_languages", "entity_id:s language:s", "select entity_id, 'python' as language from $ENT")
def _(t: Tables) -> DataFrame:
    return t.entities.select("entity_id", text.language_of(F.col("file_path"), schema.LANGUAGES).alias("language"))


@query("a4_glob_filter", "page_id:i", f"select page_id from {URL} where regexp_matches(path, '(^|/).*\\.html$') and not regexp_matches(path, '(^|/)1.*$')")
def _(t: Tables) -> DataFrame:
    return workspace.selected(paths(t), ["*.html"], ["1*"], path="path").select("page_id")


@query("a5_index_policy", "page_id:i index:b", f"select page_id, not regexp_matches(path, '^.*/en/.*$') and regexp_matches(path, '^.*\\.example\\.com/.*$') as index from {URL}")
def _(t: Tables) -> DataFrame:
    return paths(t).select("page_id", workspace.should_index(F.col("path"), ["*.example.com/*"], ["*/en/*"]).alias("index"))


@query("a6_monitored", "page_id:i monitored:b", f"select page_id, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) in ({', '.join(repr(e) for e in workspace.MONITORED)}) and len(list_intersect(string_split(path, '/')[1:-2], [{', '.join(repr(e) for e in workspace.IGNORED_FOLDERS)}])) = 0 and not (starts_with(split_part(path, '/', -1), '.') and lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) not in ('.py', '.js', '.ts')) as monitored from {URL}")
def _(t: Tables) -> DataFrame:
    return paths(t).select("page_id", workspace.is_monitored(F.col("path")).alias("monitored"))


@query("a19_prompt_tags", "conv_id:i turn:i text:s", "select conv_id, turn, trim(text) as text from conversations where length(trim(text)) > 0")
def _(t: Tables) -> DataFrame:
    prompt = F.concat(F.lit("please <CCC> "), F.col("text"), F.lit(" </ccc> and <ccc>  </ccc> thanks"))
    return t.conversations.select("conv_id", "turn", F.explode(text.tagged_queries(prompt)).alias("q")).select("conv_id", "turn", "q.text")


@query("p9_tags_removed", "conv_id:i turn:i rest:s", "select conv_id, turn, 'please  thanks' as rest from conversations")
def _(t: Tables) -> DataFrame:
    prompt = F.concat(F.lit("please <ccc>"), F.col("text"), F.lit("</ccc> thanks"))
    return t.conversations.select("conv_id", "turn", text.without_tags(prompt).alias("rest"))


@query("p11_collection_names", "source:s name:s tool:s", "select distinct source, 'my-' || source || '-code' as name, 'ccc_my_' || source as tool from documents")
def _(t: Tables) -> DataFrame:
    project = F.concat(F.lit("My "), F.col("source"))
    return t.documents.select("source", text.collection_name(project, F.lit("code")).alias("name"), text.tool_collection_name(project).alias("tool")).distinct()


TEXT = """array_to_string(list_filter(['Type: ' || entity_type, 'Name: ' || entity_name, case when qualified_name <> entity_name then 'Qualified: ' || qualified_name end, 'Signature: ' || signature,
  'Description: ' || left(docstring, {0}) || case when length(docstring) > {0} then '...' else '' end, 'File: ' || split_part(file_path, '/', -1)], lambda x: x is not null), ' | ')"""


def entity_text(doc_chars: int, lines: int) -> F.Column:
    """Searchable text of an entity from its columns; parts without a value are left out."""
    given = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    part = lambda label, c, ok=None: F.when(given(c) if ok is None else ok, F.concat(F.lit(f"{label}: "), F.col(c)))
    doc = F.when(given("docstring"), F.concat(F.lit("Description: "), F.left("docstring", F.lit(doc_chars)), F.when(F.length("docstring") > doc_chars, "...").otherwise("")))
    code_lines = F.split("source_code", "\n")
    code = F.when(given("source_code"), F.concat(F.lit("Code: "), F.array_join(F.slice(code_lines, 1, lines), "\n"), F.when(F.size(code_lines) >= lines, "\n...").otherwise("")))
    return F.concat_ws(" | ", part("Type", "entity_type"), part("Name", "entity_name"), part("Qualified", "qualified_name", given("qualified_name") & (F.col("qualified_name") != F.col("entity_name"))), part("Signature", "signature"), doc, code, F.when(given("file_path"), F.concat(F.lit("File: "), text.basename(F.col("file_path")))), part("Visibility", "visibility"))


def bare(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    return t.entities.withColumn("source_code", none).withColumn("visibility", none)


@query("p1_entity_text", "entity_id:s text:s", f"select entity_id, {TEXT.format(300)} as text from $ENT")
def _(t: Tables) -> DataFrame:
    return bare(t).select("entity_id", entity_text(300, 5).alias("text"))


@query("p2_entity_text", "entity_id:s text:s", f"select entity_id, {TEXT.format(400)} as text from $ENT")
def _(t: Tables) -> DataFrame:
    return bare(t).select("entity_id", entity_text(400, 6).alias("text"))


@query("p7_flags", "entity_type:s container:b definition:b", "select distinct entity_type, entity_type = 'class' as container, entity_type in ('class', 'function', 'method') as definition from $ENT")
def _(t: Tables) -> DataFrame:
    k = F.col("entity_type")
    return t.entities.select("entity_type", k.isin(*schema.CONTAINER_TYPES).alias("container"), k.isin(*schema.DEFINITION_TYPES).alias("definition")).distinct()


# markup: start tags of the pages, in SQL with scripts, styles and comments taken out alike
STRIPPED = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<script\\b[^>]*>).*?(</script)', '\\1\\2', 'g'), '(?is)(<style\\b[^>]*>).*?(</style)', '\\1\\2', 'g')"
TAGS = f"(select page_id, lower(regexp_extract(tag, '^<([a-zA-Z][a-zA-Z0-9-]*)', 1)) as tag, tag as raw from (select page_id, unnest(regexp_extract_all({STRIPPED}, '<[a-zA-Z][^<>]*>')) as tag from pages))"


def tags(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(markup.tags(F.col("html"))).alias("e")).select("page_id", "e.tag", markup.attributes(F.col("e.attributes")).alias("a"))


def listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


CLASS = f"case when tag in ({listed(markup.FORM)}) then 'form' when tag in ({listed(markup.MEDIA)}) then 'media' when tag in ({listed(markup.COMPONENT)}) then 'component' when tag in ({listed(markup.INTERACTIVE)}) then 'interactive' when regexp_matches(tag, '{markup.CUSTOM}') then 'custom' else 'standard' end"


@query("x2_element_classes", "page_id:i class:s n:i", f"select page_id, {CLASS} as class, count(*) as n from {TAGS} group by 1, 2")
def _(t: Tables) -> DataFrame:
    return tags(t).groupBy("page_id", markup.element_class(F.col("tag")).alias("class")).agg(F.count("*").alias("n"))


@query("x1_tags", "tag:s n:i void:b", f"select tag, count(*) as n, tag in ({listed(markup.VOID)}) as void from {TAGS} group by tag")
def _(t: Tables) -> DataFrame:
    return tags(t).groupBy("tag").agg(F.count("*").alias("n")).withColumn("void", markup.is_void(F.col("tag")))


@query("x1_text", "page_id:i n:i", "select page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) as n from pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.length(markup.text_of(F.col("html"))).alias("n"))


HREF = "coalesce(regexp_extract(raw, 'href=\"([^\"]*)\"', 1), '')"


@query("x6_link_classes", "page_id:i class:s n:i", f"select page_id, case when starts_with(h, 'mailto:') then 'email' when starts_with(h, 'tel:') then 'phone' when starts_with(h, 'http') then 'external' else 'internal' end as class, count(*) as n from (select page_id, {HREF} as h from {TAGS} where tag in ('a', 'link')) group by 1, 2")
def _(t: Tables) -> DataFrame:
    a = F.col("a")
    return tags(t).where(F.col("tag").isin("a", "link")).groupBy("page_id", markup.link_class(markup.get(a, "rel"), markup.get(a, "href")).alias("class")).agg(F.count("*").alias("n"))


@query("x7_meta_classes", "class:s seo:b social:b n:i", f"select case when contains(raw, 'charset') then 'charset' else 'unknown' end as class, false as seo, false as social, count(*) as n from {TAGS} where tag = 'meta' group by 1")
def _(t: Tables) -> DataFrame:
    a = F.col("a")
    return tags(t).where("tag = 'meta'").groupBy(markup.meta_class(a).alias("class"), markup.is_seo_meta(a).alias("seo"), markup.is_social_meta(a).alias("social")).agg(F.count("*").alias("n"))


@query("x8_script_loading", "loading:s n:i", f"select case when contains(raw, 'async') then 'async' when contains(raw, 'defer') then 'defer' else 'blocking' end as loading, count(*) as n from {TAGS} where tag = 'script' group by 1")
def _(t: Tables) -> DataFrame:
    return tags(t).where("tag = 'script'").groupBy(markup.script_loading(F.col("a")).alias("loading")).agg(F.count("*").alias("n"))


@query("x4_components", "tag:s class:s shadow:b n:i", f"select tag, case when regexp_matches(tag, '{markup.CUSTOM}') then 'custom_element' when tag in ({listed(markup.COMPONENT)}) then 'semantic_component' else 'standard_component' end as class, false as shadow, count(*) as n from {TAGS} group by 1, 2")
def _(t: Tables) -> DataFrame:
    return tags(t).groupBy("tag", markup.component_class(F.col("tag")).alias("class"), markup.uses_shadow_dom(F.col("a")).alias("shadow")).agg(F.count("*").alias("n"))


SELECTORS = ("#main", ".card", "a:hover", "ul > li", "p::before", "[type=text]", "*", "nav .item.active", "h1 + p", "input:not(.x)", "#a.b::after", "div")
CHOSEN = "(select * from (values " + ", ".join(f"('{s}')" for s in SELECTORS) + ") t(s))"


@query("x42_selector_classes", "s:s class:s combinators:s", f"select s, case when starts_with(s, '#') then 'id' when starts_with(s, '.') then 'class' when starts_with(s, '[') then 'attribute' when contains(s, '::') then 'pseudo_element' when contains(s, ':') then 'pseudo_class' when s = '*' then 'universal' else 'element' end as class, array_to_string(list_filter([case when contains(s, '>') then 'child' end, case when contains(s, '+') then 'adjacent_sibling' end, case when contains(s, '~') then 'general_sibling' end, case when contains(trim(s), ' ') then 'descendant' end], lambda x: x is not null), ',') as combinators from {CHOSEN}")
def _(t: Tables) -> DataFrame:
    s = F.col("s")
    return t.rows([(x,) for x in SELECTORS], "s string").select("s", markup.selector_class(s).alias("class"), F.array_join(markup.combinators(s), ",").alias("combinators"))


COUNTED = """len(regexp_extract_all(s, '#[a-zA-Z_-]+')) as ids, len(regexp_extract_all(s, '[.][a-zA-Z_-]+')) + len(regexp_extract_all(s, ':+[a-z-]+')) + len(string_split(s, '[')) - 1 as classes,
  len(regexp_extract_all(s, '(^|[^#.a-zA-Z0-9_-])([a-zA-Z][a-zA-Z0-9_-]*|[*])')) as elements"""


@query("x41_specificity", "s:s ids:i classes:i elements:i total:i", f"select *, ids * 100 + classes * 10 + elements as total from (select s, {COUNTED} from {CHOSEN})")
def _(t: Tables) -> DataFrame:
    return t.rows([(x,) for x in SELECTORS], "s string").select("s", markup.specificity(F.col("s")).alias("x")).select("s", "x.*")


VALUES = (("margin", "4px"), ("color", "#fff"), ("width", "12"), ("--gap", "var(--x)"), ("transform", "scale(2)"), ("display", "block"), ("font-size", "1.5rem"), ("background", "rgb(1,2,3)"), ("height", "3pt"), ("color", "red"))


@query(
    "x43_properties", "p:s v:s class:s value:s shorthand:b colour:b length:b",
    f"""select p, v, case when p in ({listed(markup.LAYOUT)}) then 'layout' when p in ({listed(markup.TYPOGRAPHY)}) then 'typography' when p in ({listed(markup.ANIMATION)}) then 'animation' when starts_with(p, '--') then 'custom' else 'other' end as class,
    case when regexp_matches(v, '^#[0-9a-fA-F]{{3,8}}$') then 'color_hex' when starts_with(v, 'rgb') then 'color_rgb' when regexp_matches(v, '^\\d+(\\.\\d+)?(px|em|rem|%|vh|vw|vmin|vmax)$') then 'length' when regexp_matches(v, '^\\d+$') then 'number' when starts_with(v, 'var(') then 'variable' when contains(v, '(') and contains(v, ')') then 'function' else 'keyword' end as value,
    p in ({listed(markup.SHORTHAND)}) as shorthand, starts_with(v, '#') or starts_with(v, 'rgb') or starts_with(v, 'hsl') or lower(v) in ({listed(markup.COLOURS)}) as colour, regexp_matches(v, '^\\d+(\\.\\d+)?(px|em|rem|%|vh|vw|vmin|vmax|pt|pc|in|cm|mm)$') as length
    from (values {", ".join(f"('{p}', '{v}')" for p, v in VALUES)}) t(p, v)""",
)
def _(t: Tables) -> DataFrame:
    p, v = F.col("p"), F.col("v")
    return t.rows(list(VALUES), "p string, v string").select("p", "v", markup.property_class(p).alias("class"), markup.value_class(v).alias("value"), markup.is_shorthand(p).alias("shorthand"), markup.is_colour(v).alias("colour"), markup.is_length(v).alias("length"))


NAMES = ("__init__", "__secret", "_inner", "plain", "#priv", "Public", "lower")


@query("s30_visibility", "n:s python:s script:s go:s java:s rust:s", "select n, case when regexp_matches(n, '^__.*__$') then 'public' when starts_with(n, '__') then 'private' when starts_with(n, '_') then 'protected' else 'public' end as python, case when regexp_matches(n, '^[_#]') then 'private' else 'public' end as script, case when regexp_matches(n, '^\\p{Lu}') then 'public' else 'private' end as go, 'protected' as java, 'public' as rust from (values " + ", ".join(f"('{n}')" for n in NAMES) + ") t(n)")
def _(t: Tables) -> DataFrame:
    n = F.col("n")
    head = F.concat(F.lit("pub protected static "), n)
    return t.rows([(x,) for x in NAMES], "n string").select("n", markup.python_visibility(n).alias("python"), markup.script_visibility(n).alias("script"), markup.go_visibility(n).alias("go"), markup.java_visibility(head).alias("java"), markup.rust_visibility(head).alias("rust"))


@query("x62_event_props", "event_id:i k:i", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
