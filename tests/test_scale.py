"""Joins and extraction on inputs that are large, skewed or lie in one file: whole results in bounded steps."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.extract import registry
from codeloom.operators import joins
from codeloom.streaming import events



def test_containing_spans(spark):
    rng = random.Random(5)
    spans = [(rng.choice("fg"), a := rng.randint(-90, 90), a + rng.randint(-2, 40), i) for i in range(300)] + [("f", None, 4, 900), ("f", 3, None, 901), ("g", 60, 70, None)]
    points = [(rng.choice("fgh"), rng.randint(-100, 140), i) for i in range(200)] + [("f", None, 900), (None, 5, 901)]
    s = spark.createDataFrame(spans, "file string, a bigint, b bigint, id bigint")
    p = spark.createDataFrame(points, "file string, at bigint, key bigint")
    least = lambda i: (i is not None, i)
    for pick, order in (("first", lambda x: (x[1], least(x[3]))), ("shortest", lambda x: (x[2] - x[1], least(x[3])))):
        want = {k: min(held, key=order)[3] for f, at, k in points if (held := [x for x in spans if None not in (f, at, x[1], x[2]) and x[0] == f and x[1] <= at <= x[2]])}
        assert dict(map(tuple, joins.containing(p, s, "file", "at", "a", "b", "key", "id", pick).collect())) == want
    wide = spark.createDataFrame([("f", -(1 << 61), 1 << 61, 7), ("f", 5, 9, 8)], s.schema)  # no row for each block of the axis
    assert dict(map(tuple, joins.containing(spark.createDataFrame([("f", 6, 1), ("f", 1 << 60, 2)], p.schema), wide, "file", "at", "a", "b", "key", "id", "shortest").collect())) == {1: 8, 2: 7}


def test_overlapping_spans(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIRS", 8, raising=False)  # so that stretches go in several pieces
    rng = random.Random(6)
    rows = lambda n: [(rng.choice("fg"), a := rng.randint(-50, 50), a + rng.choice((-2, 0, 1, 7, 30)), i) for i in range(n)] + [("f", None, 4, 900), ("f", 3, None, 901), (None, 1, 2, 902)]
    left, right = rows(90), rows(120)
    make = lambda rows, name: spark.createDataFrame(rows, f"file string, start_line bigint, end_line bigint, {name} bigint")
    want = sorted((x[3], y[3]) for x in left for y in right if None not in x and None not in y and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    assert sorted(map(tuple, joins.overlapping(make(left, "x"), make(right, "y"), "file", "x", "y").collect())) == want
    wide = [("f", -(1 << 61), 1 << 61, 7)]
    assert sorted(map(tuple, joins.overlapping(make(wide, "x"), make([("f", 5, 9, 1), *wide], "y"), "file", "x", "y").collect())) == [(7, 1), (7, 7)]


@pytest.mark.parametrize("language", sorted(registry.PARSERS))
def test_files_of_one_task_are_dealt_out(spark, language):
    files = spark.range(200).coalesce(1).selectExpr("concat(id, '.x') as file_path", "to_json(map(concat('k', id), 1)) as content")
    for made in (registry.entities, registry.relations, registry.errors, registry.parse_stats):
        plan = made(files, language)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan
    assert sorted(r[0] for r in registry.entities(files, "json").where("entity_type = 'constant'").select("entity_name").collect()) == sorted(f"k{i}" for i in range(200))


def test_deep_page_comes_in_bounded_batches(spark):
    text = "<div>" * 2500 + "x" + "</div>" * 2500  # 69 MB of source code
    rows = registry.entities(spark.createDataFrame([("p.html", text), ("q.html", None)], "file_path string, content string"))
    got = rows.selectExpr("count(*)", "sum(length(source_code))").collect()[0]
    assert tuple(got) == (2500, sum(len(text) - 11 * i for i in range(2500)))
    sizes = [(b.num_rows, b.nbytes) for b in registry.batches_of(((c, "x" * 100_000) for c in "ab" * 500), "a string, b string")]
    assert sum(n for n, _ in sizes) == 1000 and max(b for _, b in sizes) < 5_000_000


def test_pairs_of_one_file_are_dealt_out(spark):
    rows = spark.range(3000).selectExpr("concat('f', id % 1) as file", "id % 400 as start_line", "id % 400 + id % 50 as end_line", "id as x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.overlapping(rows, rows.withColumnRenamed("x", "y"), "file", "x", "y").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(r["count"] for r in got) < 0.5 * sum(r["count"] for r in got)


def test_projects_of_events_in_one_task(spark):
    paths = spark.range(300).coalesce(1).selectExpr("id as event_id", "concat('/w/', if(id % 2 = 0, 'e/', 'o/'), id) as file_path")
    got = events.project_of(paths, spark.createDataFrame([("all", "/w"), ("even", "/w/e/")], "project string, root string"))
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(i, "all" if i % 2 else "even") for i in range(300)]
