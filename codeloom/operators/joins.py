"""Structural joins between entities: containment by range, first and last matches, prefixes, as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.partitions import spread

PAIRS = 1 << 20  # about so many pairs of a stretch go to one piece


def top_level(start: Column, end: Column) -> Column:
    """The highest level of stretches that start..end can be cut into."""
    return F.length(F.bin(F.greatest(end - start + 1, F.lit(1)))) - 1


def stretches(start: Column, end: Column) -> Column:
    """The fewest aligned stretches (level, node) of 2^level positions that together are start..end: two a level at most, none if end < start.

    A position lies in one stretch of each level, so it meets a span in exactly one of them, or in none.
    """
    shift = lambda x, k: F.call_function("shiftright", x, k)

    def at_level(k: Column) -> Column:
        low, high = shift(start + F.call_function("shiftleft", F.lit(1).cast("bigint"), k) - 1, k), shift(end + 1, k)
        odd = lambda x: (low < high) & (x.bitwiseAND(1) == 1)
        return F.array(F.when(odd(low), F.struct(k.alias("level"), low.alias("node"))), F.when(odd(high), F.struct(k.alias("level"), (high - 1).alias("node"))))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), top_level(start, end)), at_level)))


def cut(spans: DataFrame, start: str, end: str) -> DataFrame:
    """spans with a row for each of their stretches (level, node)."""
    return spans.withColumn("__s", F.explode(stretches(F.col(start), F.col(end)))).withColumns({"level": F.col("__s.level"), "node": F.col("__s.node")}).drop("__s")


def placed(points: DataFrame, at: str, spans: DataFrame, start: str, end: str) -> DataFrame:
    """points with a row for each stretch (level, node) around them, up to the highest level of the spans."""
    top = F.broadcast(spans.agg(F.max(top_level(F.col(start), F.col(end))).alias("__top")))
    out = points.crossJoin(top).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("__top")))).drop("__top")
    return out.withColumn("node", F.call_function("shiftright", F.col(at), F.col("level")))


def containing(points: DataFrame, spans: DataFrame, file: str, at: str, start: str, end: str, key: str, span_id: str, pick: str = "first") -> DataFrame:
    """key, span_id of a span of the same file that holds each point; the first by start, or the shortest. Positions are whole numbers.

    Of the spans with a stretch only the picked one is kept before the join, so a
    point meets one row for each level, however many spans hold it.
    """
    long = lambda c, name: F.col(c).cast("bigint").alias(name)
    s = spans.select(F.col(file).alias("f"), long(start, "a"), long(end, "b"), F.col(span_id).alias("span_id"))
    s = spread(s, *s.columns).groupBy("f", "a", "b").agg(F.min_by("span_id", F.struct("span_id")).alias("span_id"))
    p = spread(points.select(F.col(file).alias("f"), long(at, "at"), F.col(key).alias("key")), "key")
    order = F.struct("a", "span_id") if pick == "first" else F.struct(F.col("b") - F.col("a"), F.col("span_id"))
    best = cut(s.withColumn("best", order), "a", "b").groupBy("f", "level", "node").agg(F.min("best").alias("best"))
    hit = placed(p.select("f", "at").distinct(), "at", s, "a", "b").join(best, ["f", "level", "node"]).groupBy("f", "at").agg(F.min("best").alias("best"))
    return p.join(hit, ["f", "at"]).groupBy("key").agg(F.min("best")["span_id"].alias("span_id"))


def overlapping(a: DataFrame, b: DataFrame, file: str, a_id: str, b_id: str) -> DataFrame:
    """a_id, b_id of spans (start_line, end_line) of one file that overlap; each pair once, in the stretch of one of them where the other one starts.

    All pairs are the result, so the work is in proportion to them; a stretch with
    many is dealt over several tasks.
    """
    lines = lambda df, i, name: df.select(F.col(file).alias("f"), F.col("start_line").cast("bigint").alias(f"{name}0"), F.col("end_line").cast("bigint").alias(f"{name}1"), F.col(i).alias(i))
    x, y = lines(a, a_id, "a"), lines(b, b_id, "b")
    hit = met(y, "b0", x, F.col("a0"), F.col("a1"), b_id).unionByName(met(x, "a0", y, F.col("b0") + 1, F.col("b1"), a_id))  # b starts in a, or a starts after b and in it
    return hit.where("a0 <= b1 and b0 <= a1").select(a_id, b_id)


def met(points: DataFrame, at: str, spans: DataFrame, start: Column, end: Column, point_id: str) -> DataFrame:
    """The rows of both sides, together, for each span of a file f that holds a point of that file."""
    on = ["f", "level", "node"]
    s = spans.withColumns({"__from": start, "__to": end})
    p, s = placed(points, at, s, "__from", "__to"), cut(s, "__from", "__to").drop("__from", "__to")
    n = s.groupBy(on).agg(F.count("*").alias("spans")).join(p.groupBy(on).agg(F.count("*").alias("points")), on)
    n = n.select(*on, F.least("points", F.ceil(F.col("spans") * F.col("points") / PAIRS)).alias("pieces"))
    s = s.join(n, on).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))).drop("pieces")
    p = p.join(n, on).withColumn("piece", F.pmod(F.xxhash64(point_id), F.col("pieces"))).drop("pieces")
    return spread(p, *on, "piece").join(spread(s, *on, "piece"), [*on, "piece"])


def first_match(left: DataFrame, right: DataFrame, on: str, value: str, order: str) -> DataFrame:
    """left with the first `value` of its key in the right table."""
    one = right.groupBy(on).agg(F.min_by(value, F.struct(order, value)).alias(value))
    return left.join(one, on, "left")


def last_definition(rows: DataFrame, name: str, value: str, order: str) -> DataFrame:
    """name, value of the last row of each name."""
    return rows.groupBy(name).agg(F.max_by(value, F.struct(order, value)).alias(value))


def as_of(rows: DataFrame, by: str, line: str, is_anchor: Column, value: str, out: str) -> DataFrame:
    """rows with the value of the last anchor row before each, within its group."""
    w = Window.partitionBy(by).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(F.when(is_anchor, F.col(value)), ignorenulls=True).over(w))


def child_parent(rows: DataFrame, path: str, key: str) -> DataFrame:
    """child, parent keys of rows whose path is one step below another's."""
    parent = F.regexp_replace(F.col(path), r"(\.[^.\[\]]+|\[\d+\])$", "")
    c = rows.select(parent.alias("__p"), F.col(key).alias("child"))
    return c.join(rows.select(F.col(path).alias("__p"), F.col(key).alias("parent")), "__p").where("child <> parent").select("child", "parent")


def variable_uses(properties: DataFrame, variables: DataFrame) -> DataFrame:
    """property_id, variable of CSS values that use a defined variable."""
    used = properties.select("property_id", F.explode(F.regexp_extract_all("value", F.lit(r"var\(\s*(--[\w-]+)"), F.lit(1))).alias("variable")).distinct()
    return used.join(variables.select("variable").distinct(), "variable").select("property_id", "variable")


def within_group(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Forms with the inputs of the same file."""
    return a.join(b, on)


def neighbours(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """node, hops: the nodes reached from the start nodes along edges (source, target) within some hops."""
    seen = start.select("node", F.lit(0).alias("hops")).distinct()
    front = seen
    for h in range(1, hops + 1):
        reached = front.join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        front = reached.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def success_rates(rows: DataFrame, *by: str) -> DataFrame:
    """total, ok, success_rate, seconds, per_second of runs (ok, seconds)."""
    total = F.count("*")
    out = rows.groupBy(*by).agg(total.alias("total"), F.count_if("ok").alias("ok"), F.round(F.sum("seconds"), 6).alias("seconds"))
    return out.withColumn("success_rate", F.round(F.col("ok") / F.col("total"), 6)).withColumn("per_second", F.round(F.when(F.col("seconds") > 0, F.col("total") / F.col("seconds")).otherwise(0.0), 6))
