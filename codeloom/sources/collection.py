"""Versioned Parquet collections: upsert and delete as a rewrite into a new version, made current by one rename.

Parquet tables have no MERGE.  A version is a folder; the file `CURRENT-<n>` names
the newest, and appears by an atomic rename, so readers see the old or the new
version and a failed write leaves the old one.  Versions are bucketed by a hash of
the key within the write, so an upsert shuffles both sides once on that key.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.operators.delta import keep_last


class Collection:
    def __init__(self, spark: SparkSession, path: str, key: str = "entity_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # catalog

    def exists(self) -> bool:
        return self.fs.exists(self._p(f"{self.path}/schema.json"))

    def create(self, schema: StructType, recreate: bool = False, indexes: dict[str, str] | None = None) -> bool:
        """False if it is there already and not to be made anew."""
        if self.exists() and not recreate:
            return False
        self.drop()
        self._put(f"{self.path}/schema.json", json.dumps({"schema": schema.jsonValue(), "key": self.key, "indexes": indexes or {}}))
        self._write(self.spark.createDataFrame([], schema))
        return True

    def drop(self) -> bool:
        return bool(self.fs.delete(self._p(self.path), True))

    def info(self) -> dict:
        rows = self.read()
        return {"name": self.path.rpartition("/")[2], "points": rows.count(), "version": self.version(), "columns": rows.columns, "status": "green"}

    def version(self) -> int:
        if not self.fs.exists(self._p(self.path)):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self._p(self.path))]
        return max((int(n.removeprefix("CURRENT-")) for n in names if n.startswith("CURRENT-")), default=0)

    def schema(self) -> StructType:
        stream = self.fs.open(self._p(f"{self.path}/schema.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return StructType.fromJson(json.loads(text)["schema"])

    def _put(self, path: str, text: str) -> None:
        out = self.fs.create(self._p(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _write(self, rows: DataFrame) -> int:
        n = self.version() + 1
        folder = f"{self.path}/v{n}-{uuid.uuid4().hex[:8]}"
        rows.write.option("compression", "zstd").parquet(folder)
        draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
        self._put(draft, folder)
        if not self.fs.rename(self._p(draft), self._p(f"{self.path}/CURRENT-{n}")):
            raise OSError(f"version {n} of {self.path} was committed by another writer")
        return n

    # reads

    def read(self) -> DataFrame:
        """All rows of the current version."""
        n = self.version()
        stream = self.fs.open(self._p(f"{self.path}/CURRENT-{n}"))
        try:
            folder = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self.spark.read.schema(self.schema()).parquet(folder)

    def where(self, conditions: dict, limit: int | None = 1000) -> DataFrame:
        from codeloom.operators.search import equals

        rows = self.read().where(equals(conditions))
        return rows.limit(limit) if limit else rows

    def retrieve(self, ids: DataFrame) -> DataFrame:
        return self.read().join(ids.select(self.key), self.key, "left_semi")

    def count(self, conditions: dict | None = None) -> int:
        return self.where(conditions or {}, None).count()

    # mutations

    def upsert(self, rows: DataFrame, order: list | None = None) -> int:
        """Rows replace those of the same key; of several new rows of a key the last in the order stays."""
        new = keep_last(rows, [self.key], order or [c for c in rows.columns if c != self.key]).select(*self.schema().names)
        kept = self.read().join(new.select(self.key), self.key, "left_anti").select(*self.schema().names)
        return self._write(kept.unionByName(new))

    def delete(self, ids: DataFrame) -> int:
        return self._write(self.read().join(ids.select(self.key), self.key, "left_anti").select(*self.schema().names))

    def delete_where(self, conditions: dict) -> int:
        from codeloom.operators.search import equals

        return self._write(self.read().where(~F.coalesce(equals(conditions), F.lit(False))))

    def delete_stale(self, ids: DataFrame, cutoff: float) -> int:
        """Of the given ids those never stamped or stamped before the cutoff (epoch seconds) go."""
        gone = self.read().join(ids.select(self.key), self.key, "left_semi").where(F.col("indexed_at").isNull() | (F.unix_micros("indexed_at") / 1e6 < cutoff))
        return self.delete(gone.select(self.key))

    def replace_file(self, path: str, rows: DataFrame) -> int:
        """The file's entities become exactly these rows, in one version."""
        others = self.read().where(~F.coalesce(F.col("file_path") == path, F.lit(False)))
        fresh = keep_last(rows, [self.key], [c for c in rows.columns if c != self.key])
        return self._write(others.unionByName(fresh.select(*self.schema().names)))

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the newest versions."""
        newest = self.version()
        for s in self.fs.listStatus(self._p(self.path)):
            name = s.getPath().getName()
            n = name[1:].split("-")[0] if name.startswith("v") else name.removeprefix("CURRENT-") if name.startswith("CURRENT-") else ""
            if n.isdigit() and int(n) <= newest - keep:
                self.fs.delete(s.getPath(), True)


def entity_files(rows: DataFrame) -> DataFrame:
    """file_path, entity_ids (sorted), n."""
    return rows.groupBy("file_path").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"), F.countDistinct("entity_id").alias("n"))
