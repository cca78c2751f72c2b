"""Collections, workspace scans, indexing, streaming and fixture cases."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from codeloom.functions import markup, suggest, text
from codeloom.operators import delta, health, ranking, search, vectors
from codeloom.plans import indexing
from codeloom.sources import workspace
from codeloom.sources.collection import Collection
from codeloom.streaming import events as ev


def test_payload_score_cases(spark):
    rows = spark.createDataFrame([("test_function", "test_function", None, None, None), ("test", None, "testing", "a test", "test it"), ("test", None, None, None, None)], "query string, entity_name string, qualified_name string, signature string, docstring string").withColumn("entity_type", F.lit(None).cast("string"))
    got = [round(r[0], 4) for r in rows.select(search.payload_score(F.col("query"))).collect()]
    assert got == [1.0, 1.0676, 0.0]


def test_delta_fixture(spark):
    w = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 100.0), ("d", 100.0)], "file_path string, mtime double")
    c = spark.createDataFrame([("b", 99.5), ("c", 50.0), ("c", 90.0), ("d", None), ("e", 1.0)], "file_path string, indexed_at double")
    got = {r.file_path: r.change_type for r in delta.file_delta(w, c, 1.0).collect()}
    assert got == {"a": "added", "b": "unchanged", "c": "modified", "d": "modified", "e": "deleted"}
    strict = {r.file_path: r.change_type for r in delta.file_delta(w, c, 0.1).collect()}
    assert strict["b"] == "modified"
    s = delta.delta_summary(delta.file_delta(w, c)).first()
    assert (s.added, s.deleted, s.modified, s.unchanged, s.total_changes) == (1, 1, 2, 1, 4) and s.change_ratio == 1.0
    assert delta.file_delta(w.where("1 = 0"), c.where("1 = 0")).count() == 0


def test_health_states(spark):
    rows = spark.createDataFrame([("x", "f1", "class", 1000.0), ("x", "f1", "function", 1000.0), ("y", "f", "unknown", 1000.0)], "g string, file_path string, entity_type string, indexed_at double")
    got = {r.g: r for r in health.analysed(health.metadata(rows, "g"), F.lit(1000.0)).collect()}
    assert got["x"].state == "healthy" and got["y"].state == "inconsistent" and got["y"].issues == ["High ratio of unknown entity types"]
    old = health.analysed(health.metadata(rows, "g"), F.lit(1000.0 + 100 * 3600)).where("g = 'x'").first()
    assert old.state == "stale" and len(old.recommendations) == 2
    none = health.analysed(health.metadata(rows.where("1 = 0")), F.lit(0.0)).first()
    assert none.state == "empty" and none.health_score == 0


def greedy(rows, limit=0.8):
    kept = []
    for r in rows:
        key = set(f"{r['entity_name']}:{(r['signature'] or '')[:50]}".lower().split())
        if all(not key or not k or len(key & k) / len(key | k) <= limit for _, k in kept):
            kept.append((r["entity_id"], key))
    return [i for i, _ in kept]


def test_diversity_is_the_greedy_fold(spark):
    data = [("q", f"e{i}", 1 - i / 100, f"name {i % 4} shared words here more", "sig one two three", "f.py") for i in range(20)]
    rows = ranking.by_score(spark.createDataFrame(data, "query string, entity_id string, score double, entity_name string, signature string, file_path string"))
    got = [r.entity_id for r in ranking.diverse(rows).orderBy("rank").collect()]
    ordered = [r.asDict() for r in rows.orderBy("rank").collect()]
    assert got == greedy(ordered)
    assert ranking.per_file(rows).count() == 3


def test_collection_versions(spark, tmp_path):
    schema = spark.createDataFrame([], "entity_id string, file_path string, n int, indexed_at timestamp").schema
    c = Collection(spark, str(tmp_path / "c"))
    assert c.create(schema) and not c.create(schema) and c.exists() and c.read().count() == 0
    row = lambda *r: spark.createDataFrame([(*x, None) for x in r], schema)
    c.upsert(row(("a", "f", 1), ("b", "f", 2), ("a", "f", 3)))
    c.upsert(row(("b", "g", 9)))
    assert sorted((r.entity_id, r.n) for r in c.read().collect()) == [("a", 3), ("b", 9)]
    c.replace_file("f", row(("z", "f", 1)))
    assert sorted(r.entity_id for r in c.read().collect()) == ["b", "z"]
    assert c.count({"file_path": ["f", "q"]}) == 1 and c.retrieve(row(("b", "", 0))).count() == 1
    c.delete_stale(row(("b", "", 0)), 5.0)
    c.delete_where({"entity_id": "nothing"})
    assert [r.entity_id for r in c.read().collect()] == ["z"]
    version = c.version()
    c.vacuum(1)
    assert c.version() == version and c.read().count() == 1 and c.info()["points"] == 1
    c.delete(row(("z", "", 0)))
    assert c.read().count() == 0 and c.drop() and not c.exists()


@pytest.fixture
def project(tmp_path):
    src = tmp_path / "src"
    (src / "pkg").mkdir(parents=True)
    (src / "node_modules").mkdir()
    (src / "pkg" / "reader.py").write_text("class FileReader:\n    def read_rows(self, path):\n        return open(path)\n")
    (src / "app.js").write_bytes("function café() { return start(); }\n".encode("latin-1"))
    (src / "node_modules" / "x.js").write_text("function hidden() {}")
    (src / ".secret.py").write_text("x = 1")
    (src / "notes.txt").write_text("plain")
    return indexing.Project("My Proj", str(src), str(tmp_path / "store"))


def test_workspace(spark, project):
    found = {r.file_path: r.size for r in workspace.scan(spark, project.folder).collect()}
    assert set(found) == {"pkg/reader.py", "app.js", "notes.txt"}
    assert [r.file_path for r in workspace.discover(spark, project.folder, (".py",)).collect()] == ["pkg/reader.py"]
    texts = {r.file_path: r.content for r in workspace.texts(spark, project.folder, (".js",)).collect()}
    assert "café" in texts["app.js"]
    tree = [r.line for r in workspace.project_tree(workspace.scan(spark, project.folder)).orderBy("line_no").collect()]
    assert tree == ["pkg/", "  reader.py", "app.js", "notes.txt"]
    assert workspace.decode_one(b"\xff\xfe\x00") is not None and workspace.decode_one(None) is None and workspace.decode_one("é�".encode() * 3) is None


def test_index_search_and_delta(spark, project):
    now = os.path.getmtime(project.folder + "/app.js") + 10
    assert indexing.delta_scan(spark, project, now)["added"] == 2
    assert indexing.delta_scan(spark, project, now) == {"added": 0, "modified": 0, "deleted": 0, "unchanged": 2, "entities": 3}
    hit = indexing.search_code(spark, project, "FileReader", "payload").first()
    assert hit.qualified_name == "FileReader" and hit["rank"] == 1
    assert indexing.search_code(spark, project, "read_rows", "auto").count() >= 1
    assert indexing.search_code(spark, project, "class FileReader", "semantic").count() >= 1
    assert "FileReader" in indexing.context_block(indexing.search_code(spark, project, "FileReader", "hybrid")).first().block
    with open(project.folder + "/app.js", "w") as f:
        f.write("function other() {}\n")
    os.utime(project.folder + "/app.js", (now + 100, now + 100))
    os.remove(project.folder + "/pkg/reader.py")
    assert indexing.validate(spark, project).where("issue_type = 'orphaned_entity'").count() == 2
    got = indexing.delta_scan(spark, project, now + 200)
    assert (got["modified"], got["deleted"], got["entities"]) == (1, 1, 1)
    version = project.collection(spark).version()
    indexing.delta_scan(spark, project, now + 300)
    assert project.collection(spark).version() == version  # nothing changed, nothing written
    names = {r.entity_name for r in project.collection(spark).read().collect()}
    assert names == {"other"} and project.collection(spark, "embeddings").count() == 1
    assert indexing.status(spark, project, now + 200).first().state == "healthy"


def test_texts_of_named_files(spark, tmp_path, monkeypatch):
    from codeloom.sources import workspace

    (tmp_path / "a b").mkdir()
    for name in ("a b/x[1].py", "{y}*.py", "z.py", "é?.py"):
        (tmp_path / name).write_text(name)
    paths = spark.createDataFrame([("a b/x[1].py",), ("{y}*.py",), ("é?.py",)], "file_path string")
    for most in (workspace.LISTED, 1):
        monkeypatch.setattr(workspace, "LISTED", most)
        got = {r.file_path: r.content for r in workspace.texts_of(spark, str(tmp_path), paths).collect()}
        assert got == {n: n for n in ("a b/x[1].py", "{y}*.py", "é?.py")}
    monkeypatch.undo()
    gone = paths.unionByName(spark.createDataFrame([("gone.py",)], "file_path string"))
    assert workspace.texts_of(spark, str(tmp_path), gone).count() == 3 and workspace.texts_of(spark, str(tmp_path), paths.limit(0)).count() == 0


def test_embedders(spark):
    df = spark.createDataFrame([(1, "read the file"), (2, "read the file"), (3, ""), (4, None)], "i int, text string")
    got = {r.i: r.vector for r in vectors.embed(df, dimensions=16).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and not any(got[3]) and not any(got[4])
    vectors.register("ones", lambda s, d: s.map(lambda t: [1.0] * d), "plain")
    assert vectors.embed(df, dimensions=2, model="plain").first().vector == [1.0, 1.0]


def test_approximate_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("entity_id"), F.col("embedding").alias("vector"))
    q = e.where("entity_id = 5").first().vector
    near = {r.entity_id for r in vectors.approximate(e, list(q), 10, bucket=4.0).collect()}
    exact = {r.entity_id for r in vectors.nearest(e, e.where("entity_id = 5").select(F.col("entity_id").alias("query"), F.col("vector").alias("query_vector")), 10, "euclidean").collect()}
    assert len(near & exact) >= 9


def test_iterative_search(spark):
    base = spark.createDataFrame([("q", f"e{i}", 1.0 - i / 10, i + 1) for i in range(3)], "query string, entity_id string, score double, rank int")
    more = spark.createDataFrame([("q", f"n{i}", 1.0 - i / 10, i + 1) for i in range(4)], "query string, entity_id string, score double, rank int")
    asked = []

    def planner(query, seen):
        asked.append(len(seen))
        return len(asked) > 2, [("semantic", "more")]

    out = search.iterative_search(lambda q, mode: more if q == "more" else base, "q", planner, k=10)
    assert out.count() == 7 and asked == [3, 7]
    with pytest.raises(ValueError):
        search.check_request("", 10)
    assert search.check_request(" x ", 5, ["py", ".JS"]) == ("x", 5, [".py", ".js"])


def test_suggestions(spark):
    q = spark.createDataFrame([("read file", "src/a_test.py", ["def parse", "read rows"]), ("class", None, None), ("  ", None, None)], "query string, current_file string, recent array<string>")
    rows = suggest.suggestions(q, 10).collect()
    mine = [r for r in rows if r.query == "read file"]
    assert [r["rank"] for r in sorted(mine, key=lambda r: r["rank"])] == list(range(1, 11)) and all(0 < r.confidence <= 0.99 for r in rows)
    assert not [r for r in rows if r.query.strip() == ""] and len({r.text.lower() for r in mine}) == 10
    assert any(r.text.startswith("def test_read file") for r in mine)
    h = {r.query: r.h for r in q.select("query", suggest.hints(F.col("query")).alias("h")).collect()}
    assert len(h["read file"]) <= 3 and h["class"][0].startswith("Try adding")


def test_analysis_blank(spark):
    r = spark.createDataFrame([("",), (None,), ("how to open files now",)], "q string").select(text.analyse(F.col("q")).alias("a")).collect()
    assert r[0].a.confidence == 0 and r[1].a.mode == "hybrid" and r[2].a.mode == "semantic"


def test_markup_attributes(spark):
    html = """<!-- <b> --><input required data-x="1" onclick='go()' aria-label=hi class="a b" class="c"><script>var s = "<p>";</script>"""
    t = spark.createDataFrame([(html,)], "h string").select(F.explode(markup.tags(F.col("h"))).alias("e")).select("e.tag", markup.attributes(F.col("e.attributes")).alias("a"))
    rows = t.select("tag", "a", markup.data_attributes(F.col("a")).alias("d"), markup.event_handlers(F.col("a")).alias("on"), markup.accessibility(F.col("a")).alias("x"), markup.validation(F.col("a")).alias("v"), markup.component_properties(F.col("a")).alias("p")).collect()
    assert [r.tag for r in rows] == ["input", "script"] and rows[0].a["class"] == "a b"
    assert rows[0].d == {"data-x": "1"} and rows[0].on == {"click": "go()"} and rows[0].x == {"aria-label": "hi"} and rows[0].v == {"required": ""}


def test_css_expressions(spark):
    one = lambda s: spark.createDataFrame([(s,)], "s string").select(markup.specificity(F.col("s")).alias("x"), markup.pseudo_classes(F.col("s")).alias("c"), markup.pseudo_elements(F.col("s")).alias("e"), markup.selector_parts(F.col("s"), ".").alias("cl")).first()
    r = one("#a .b p:hover::before")
    # names of pseudo parts count as elements too, as in the definition
    assert (r.x.ids, r.x.total) == (1, 100 + 30 + 3) and r.c == ["hover"] and r.e == ["before"] and r.cl == ["b"]
    at = spark.createDataFrame([("@media screen and (min-width: 3px) { }",), ("@keyframes spin { }",), ('@import url("x.css");',)], "s string").select(markup.at_rule(F.col("s")).alias("r")).collect()
    assert [x.r.name for x in at] == ["screen and (min-width: 3px)", "spin", "x.css"] and at[0].r.media_type == "screen"


def stream_rows(n=40):
    t0 = dt.datetime(2024, 1, 1)
    return [(f"e{i:03}", ("modified", "created", "deleted", "moved")[i % 4], f"f{i % 5}", f"old{i % 5}" if i % 4 == 3 else None, t0 + dt.timedelta(milliseconds=200 * i + (5000 if i > 20 else 0)), 0, 0, 3) for i in range(n)]


def test_streamed_debounce_equals_batch(spark, tmp_path):
    from codeloom.schema import EVENT

    src = tmp_path / "in"
    spark.createDataFrame(stream_rows(), EVENT).write.parquet(str(src))
    events = spark.readStream.schema(EVENT).parquet(str(src))
    q = ev.debounced_stream(events, "500 milliseconds", "1 second").writeStream.format("memory").queryName("deb").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.file_path, r.start, r.event_id) for r in spark.table("deb").collect()}
    want = {(r.file_path, r.start, r.event_id) for r in ev.debounced(spark.createDataFrame(stream_rows(), EVENT), "500 milliseconds").collect()}
    assert got <= want and len(want) - len(got) <= 10 and len(got) > 10


def test_sync_applies_events(spark, tmp_path):
    schema = spark.createDataFrame([], "entity_id string, file_path string, n int").schema
    c = Collection(spark, str(tmp_path / "c"))
    c.create(schema)
    c.upsert(spark.createDataFrame([("x1", "f0", 1), ("x2", "old", 1), ("x3", "kept", 1)], schema))
    from codeloom.schema import EVENT

    t = dt.datetime(2024, 1, 1)
    rows = [("1", "deleted", "f0", None, t, 1, 0, 3), ("2", "moved", "new", "old", t, 4, 0, 3), ("3", "created", "f9", None, t, 3, 0, 3)]
    spark.createDataFrame(rows, EVENT).write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema(EVENT).parquet(str(tmp_path / "ev"))
    parse = lambda paths: paths.select(F.concat(F.lit("p-"), "file_path").alias("entity_id"), "file_path", F.lit(2).alias("n"))
    ev.run_sync(events, c, parse, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination(120)
    assert sorted(r.entity_id for r in c.read().collect()) == ["p-f9", "p-new", "x3"]


def test_event_order_and_capacity(spark):
    from codeloom.schema import EVENT

    e = ev.with_priority(spark.createDataFrame(stream_rows(), EVENT))
    kinds = [r.event_type for r in ev.batches(e, 10).orderBy("batch", "place").collect()]
    assert kinds == ["deleted"] * 10 + ["modified"] * 10 + ["created"] * 10 + ["moved"] * 10
    assert ev.admitted(e, 7).count() == 7 and ev.pending(e).count() == 5


def test_reach_from_any_order(spark):
    from codeloom.operators import joins
    from codeloom.plans.queries_core import order_edges

    items = [(o, (o * 7) % 11, (o * 5) % 6) for o in range(1, 81)]
    edges = order_edges(spark.createDataFrame(items, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint"))
    for start in (1, 40, 77):
        part = {f"p{p}" for o, p, _ in items if o == start}
        want = {(f"o{start}", 0), *((p, 1) for p in part), *((f"s{s}", 2) for _, p, s in items if f"p{p}" in part)}
        assert {tuple(r) for r in joins.neighbours(edges, spark.createDataFrame([(f"o{start}",)], "node string"), 2).collect()} == want


def test_nearest_equals_brute_force(spark, monkeypatch):
    import numpy as np

    from codeloom.operators import vectors

    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (300, 3)).astype(float)  # many ties, some zero vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None)]
    points = spark.createDataFrame(rows, "entity_id bigint, vector array<double>").repartition(3)
    for cells, metric in ((10**6, "cosine"), (500, "cosine"), (500, "euclidean"), (500, "dot")):
        monkeypatch.setattr(vectors, "SCORE_CELLS", cells)
        s = np.round(vectors.scores(x, x, metric), 6)
        for alone in (False, True):
            queries = points.where("entity_id % 50 = 0").select(F.col("entity_id").alias("query"), F.col("vector").alias("query_vector"))
            got = sorted((r.query, r["rank"], r.entity_id) for r in vectors.nearest(points, queries, 7, metric, alone).collect())
            want = []
            for q in range(0, 300, 50):
                order = sorted((i for i in range(300) if not alone or i != q), key=lambda i: (-s[i, q], i))[:7]
                want += [(q, n + 1, i) for n, i in enumerate(order)]
            assert got == want


def test_slots(spark):
    from codeloom.functions import markup

    row = spark.createDataFrame([("<my-card><slot></slot><p><slot name='foot' class=x></slot></p><!-- <slot name=no> --></my-card>", "<br/>"), (None, "<p></p>")], "h string, e string")
    got = row.select(markup.slots(F.col("h")).alias("s"), markup.is_self_closing(F.col("e")).alias("c")).collect()
    assert got[0].s == ["default", "foot"] and [r.c for r in got] == [True, False] and got[1].s is None


def test_config(tmp_path):
    import json

    from codeloom import config

    path = tmp_path / "p.json"
    path.write_text(json.dumps({"name": "x", "store": "${folder}/store", "include": ["${KIND}/*", "${none}"], "limits": {"mb": 5, "deep": {"on": True}}}))
    env = {"KIND": "src", "CODELOOM_LIMITS__MB": "7", "CODELOOM_LIMITS__DEEP__ON": "no", "CODELOOM_NEW__LIST": "[1, 2]", "CODELOOM_NEW__TEXT": "plain", "CODELOOM_NEW__FLAG": "true", "CODELOOM_NAME": "12"}
    got = config.load(str(path), {"limits": {"mb": 1, "files": 9}, "tolerance": 1.0}, env)
    assert got["store"] == f"{tmp_path}/store" and got["include"] == ["src/*", "${none}"] and got["tolerance"] == 1.0 and got["name"] == "12"
    assert got["limits"] == {"mb": 7, "files": 9, "deep": {"on": False}} and got["new"] == {"list": [1, 2], "text": "plain", "flag": True}
    with pytest.raises(ValueError):
        config.load(str(path), {}, {"CODELOOM_LIMITS__DEEP__ON": "perhaps"})
    (tmp_path / "bad.json").write_text("[]")
    assert config.projects(str(tmp_path)) == {"x": str(path)}
