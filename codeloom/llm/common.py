"""Helpers shared by the training-data operators.

Every text operator reads only the columns it names, so extra columns (also
with names that clash with its results) never reach it.  Batches are cut again
by characters, so a batch of very long texts needs no more memory than others.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BATCH_CHARS = 2_000_000
LETTERS = re.compile(r"[^\W\d_]+")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(folds)


def hash_share(share: float, *columns: str) -> Column:
    """True for about this share of the rows, by a hash of the columns; always the same rows."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 20)) < F.lit(int(min(1.0, share) * (1 << 20)) + 1)


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8: bytes.split cuts at exactly these."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def cuts(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.zeros(batch.num_rows, np.int64) + np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        part = np.cumsum(sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Such slices, each with its texts ("" for null)."""
    for cut in cuts(batches, column, limit):
        yield cut, [x or "" for x in cut.column(column).to_pylist()]


def map_texts(df: DataFrame, fn: Callable[[list[str]], dict[str, list]], schema: str, key: str = "doc_id", text: str = "text", also: dict[str, Column] | None = None, setup: Callable | None = None) -> DataFrame:
    """One row per input row: key, the `also` columns, and what fn gives for the texts (null text: "").

    setup() is called once per task and its result is passed to fn as a second argument.
    """
    extra = also or {}
    cols = [F.col(key).alias(key), *(c.alias(n) for n, c in extra.items()), F.col(text).cast("string").alias("__text")]
    src = df.select(*cols)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for cut, texts in chunks(batches, "__text"):
            got = fn(texts, state) if setup else fn(texts)
            arrays = [cut.column(i) for i in range(cut.num_columns - 1)]
            names = [n for n in cut.schema.names if n != "__text"]
            for name, kind in pa_fields(schema):
                arrays.append(pa.array(got[name], type=ARROW[kind]))
                names.append(name)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return src.mapInArrow(run, f"{head}, {schema}")


ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
}


def pa_fields(schema: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a DDL string of flat or one-level array columns."""
    return [(x.split()[0], x.split()[1]) for x in schema.split(",")]


def filter_rows(df: DataFrame, verdict: Callable[[list[str], object], Iterable[bool]], setup: Callable | None = None, text: str = "text") -> DataFrame:
    """The rows whose text gets True, with all their columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for cut, texts in chunks(batches, text):
            yield cut.filter(pa.array(list(verdict(texts, state)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def work_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors share; in local tests below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the application's."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_work(spark: SparkSession) -> None:
    """Deletes all sub-results of this application; for when no DataFrame that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
