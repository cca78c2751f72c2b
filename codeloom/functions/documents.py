"""JSON text expressions: comments, member signatures, sections and flattening within Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.extract.data import SECTIONS


def without_comments(text: Column) -> Column:
    """JSON with comments taken out; strings are kept as they are."""
    return F.regexp_replace(text, r'(?s)("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', "$1")


def parsed(text: Column) -> Column:
    """A variant; null for text that is no JSON even without comments."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(without_comments(text)))


def kind(value: Column) -> Column:
    """class for an object, variable for an array, constant otherwise."""
    t = F.schema_of_variant(value)
    return F.when(t.startswith("OBJECT"), "class").when(t.startswith("ARRAY"), "variable").otherwise("constant")


def member_signature(name: Column, text: Column) -> Column:
    """'"name": { n properties }', '"name": [ n items ]', or the value, strings cut at 50 characters."""
    head = F.concat(F.lit('"'), name, F.lit('": '))
    keys, items = F.json_object_keys(text), F.json_array_length(text)
    plain = F.when(text.startswith('"'), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    shown = F.when(text.startswith('"'), F.concat(F.lit('"'), F.left(plain, F.lit(50)), F.when(F.length(plain) > 50, "...").otherwise(""), F.lit('"'))).otherwise(plain)
    return F.when(text.startswith("{"), F.concat(head, F.lit("{ "), F.size(keys).cast("string"), F.lit(" properties }"))).when(text.startswith("["), F.concat(head, F.lit("[ "), items.cast("string"), F.lit(" items ]"))).otherwise(F.concat(head, shown))


def is_section(key: Column) -> Column:
    return F.lower(key).isin(*sorted(SECTIONS)) | key.rlike("(Config|Settings|Options)$")


def serialised(text: Column, limit: int = 500) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def estimated_lines(members: Column, is_array: Column) -> Column:
    return F.least(members + 2, F.when(is_array, 15).otherwise(20))


def flattened(rows: DataFrame, key: str, text: str, depth: int = 10) -> DataFrame:
    """key, path, value (JSON text) of all members, one explode a level; ends at the first level without members."""
    level = rows.select(F.col(key), F.lit("$").alias("path"), parsed(F.col(text)).alias("v")).where("v is not null")
    level.createOrReplaceTempView("__flat_0")
    spark, out = rows.sparkSession, None
    for d in range(depth):
        inner = spark.sql(f"select t.`{key}`, case when e.key is null then concat(t.path, '[', e.pos, ']') else concat(t.path, '.', e.key) end as path, e.value as v from __flat_{d} t, lateral variant_explode(t.v) e")
        part = inner.select(key, "path", F.to_json("v").alias("value"))
        out = part if out is None else out.unionByName(part)
        inner.createOrReplaceTempView(f"__flat_{d + 1}")
    return out
