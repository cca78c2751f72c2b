"""Registry of the library's queries: a name, a column spec, a DataFrame function and the SQL that must agree with it.

The spec "query:s score:f rank:i flag:b" casts both sides alike: s text, i bigint,
f double rounded to six places, b boolean as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUERY_TEXTS = ("ring", "small ring", "widget", "red", "bolt", "ECONOMY", "Brand#2", "a", "blue bolt", "def SMALL", "gear")

ENTITY_SQL = """
select cast(p_partkey as varchar) as entity_id, p_name as entity_name, p_brand || '.' || p_name as qualified_name,
  case p_size % 7 when 0 then 'class' when 1 then 'function' when 2 then 'method' when 3 then 'variable' when 4 then 'constant' when 5 then 'import' else 'unknown' end as entity_type,
  case p_size % 4 when 0 then 'def ' || p_type || '(a: int, b: str) -> int' when 1 then p_type || '(a: int)' when 2 then p_type else p_type || '()' end as signature,
  trim(repeat(p_name || ' ' || p_type || ' ', cast(p_size % 12 + 1 as int))) as docstring,
  case p_size % 5 when 0 then 'tests/' else 'src/' end || replace(p_brand, '#', '_') || '.py' as file_path,
  cast(p_partkey % 500 + 1 as bigint) as start_line, cast(p_partkey % 500 + 1 + p_size as bigint) as end_line,
  case when p_size % 9 = 0 then null else 900000.0 + p_retailprice end as indexed_at, p_brand as brand, p_size as size, p_partkey as partkey
from part
"""


class Tables:
    """The driver's tables, and the projections of them that stand for entities and the like."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def entities(self) -> DataFrame:
        p = self.part
        size, key = F.col("p_size"), F.col("p_partkey")
        kinds = ("class", "function", "method", "variable", "constant", "import")
        kind = F.when(F.lit(False), "")
        for i, k in enumerate(kinds):
            kind = kind.when(size % 7 == i, k)
        t = F.col("p_type")
        signature = F.when(size % 4 == 0, F.concat(F.lit("def "), t, F.lit("(a: int, b: str) -> int"))).when(size % 4 == 1, F.concat(t, F.lit("(a: int)"))).when(size % 4 == 2, t).otherwise(F.concat(t, F.lit("()")))
        doc = F.trim(F.repeat(F.concat_ws(" ", "p_name", "p_type", F.lit("")), (size % 12 + 1).cast("int")))
        path = F.concat(F.when(size % 5 == 0, "tests/").otherwise("src/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(".py"))
        line = (key % 500 + 1).cast("bigint")
        return p.select(
            key.cast("string").alias("entity_id"), F.col("p_name").alias("entity_name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), kind.otherwise("unknown").alias("entity_type"),
            signature.alias("signature"), doc.alias("docstring"), path.alias("file_path"), line.alias("start_line"), (line + size).alias("end_line"),
            F.when(size % 9 != 0, 900000.0 + F.col("p_retailprice")).alias("indexed_at"), F.col("p_brand").alias("brand"), size.alias("size"), key.alias("partkey"),
        )

    @property
    def queries(self) -> DataFrame:
        return self.spark.createDataFrame([(q,) for q in QUERY_TEXTS], "query string")

    def rows(self, values: list[tuple], ddl: str) -> DataFrame:
        return self.spark.createDataFrame(values, ddl)


def fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(x.split(":")) for x in spec.split()]  # type: ignore[misc]


def conform(df: DataFrame, spec: str) -> DataFrame:
    cast = {"s": lambda c: F.col(c).cast("string"), "i": lambda c: F.col(c).cast("bigint"), "f": lambda c: F.round(F.col(c).cast("double"), 6), "b": lambda c: F.col(c).cast("string")}
    return df.select(*(cast[k](c).alias(c) for c, k in fields(spec)))


def conform_sql(sql: str, spec: str) -> str:
    cast = {"s": "cast({0} as varchar)", "i": "cast({0} as bigint)", "f": "round(cast({0} as double), 6)", "b": "cast(cast({0} as boolean) as varchar)"}
    return f"select {', '.join(cast[k].format(c) + ' as ' + c for c, k in fields(spec))} from ({sql})"


def query(name: str, spec: str | None = None, sql: str | None = None) -> Callable:
    """Registers fn(Tables) under a name; $ENT and $QRY in the SQL stand for the entity and query tables."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(Tables(spark, folder))
            return conform(out, spec) if spec else out

        QUERIES[name] = run
        if sql:
            texts = ", ".join(f"('{q}')" for q in QUERY_TEXTS)
            full = sql.replace("$ENT", f"({ENTITY_SQL})").replace("$QRY", f"(select * from (values {texts}) t(query))")
            ORACLES[name] = conform_sql(full, spec) if spec else full
        return fn

    return add


def load() -> None:
    from codeloom.plans import queries_core, queries_more, queries_search, queries_text  # noqa: F401


load()
