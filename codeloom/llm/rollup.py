"""Token counts as rollups maintained by deltas.

A change says that a document was inserted, deleted or counted anew; it becomes
signed rows (an insert +, a delete -, a revision both), summed by source, language
and tokenizer version before they leave a task.  commit() writes the summed deltas
of a batch into a folder named by the batch id: the folder appears by one rename,
so a batch is there whole or not at all, and committing an id again changes
nothing.  Totals are sums over batches; compact() folds them into one base that
lists the ids it holds.

Null source, language or counts: null is a group of its own; null counts are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import shared_folder

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Rows (source, lang, tokenizer, n_tokens) as additive deltas."""
    return rows.select(*KEYS, F.lit(sign).cast("bigint").alias("n_docs"), (F.lit(sign) * F.coalesce("n_tokens", F.lit(0))).cast("bigint").alias("n_tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed rows of changes (op insert / delete / revise, source, lang, tokenizer, n_tokens, old_tokenizer, old_n_tokens)."""
    fresh = changes.where(F.col("op").isin("insert", "revise"))
    gone = changes.where(F.col("op").isin("delete", "revise"))
    old = F.col("op") == "revise"
    gone = gone.select("source", "lang", F.when(old, F.col("old_tokenizer")).otherwise(F.col("tokenizer")).alias("tokenizer"), F.when(old, F.col("old_n_tokens")).otherwise(F.col("n_tokens")).alias("n_tokens"))
    return signed(fresh, 1).unionByName(signed(gone, -1))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda p: hadoop(p)
        self.fs = hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Ids of the batches that count, those within the base included."""
        return sorted([*self._folders("batch"), *self._base_ids()])

    def _folders(self, kind: str) -> dict[str, str]:
        if not self.fs.exists(self._path(self.path)):
            return {}
        names = [(str(s.getPath()), s.getPath().getName()) for s in self.fs.listStatus(self._path(self.path))]
        return {n.removeprefix(f"{kind}="): p for p, n in names if n.startswith(f"{kind}=")}

    def _base(self) -> str | None:
        bases = self._folders("base")
        return bases[max(bases, key=int)] if bases else None

    def _base_ids(self) -> list[str]:
        base = self._base()
        return [r.id for r in self.spark.read.schema("id string").json(f"{base}/ids").collect()] if base else []

    def commit(self, batch_id: str, rows: DataFrame) -> bool:
        """Adds signed rows under this id; False, and nothing changed, if the id is committed already."""
        if batch_id in self.committed():
            return False
        draft, final = shared_folder(self.spark, "rollup-draft"), f"{self.path}/batch={batch_id}"
        summed(rows).write.parquet(draft)
        self.fs.mkdirs(self._path(self.path))
        if not self.fs.rename(self._path(draft), self._path(final)):
            raise OSError(f"could not commit {final}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups that sum to nothing are left out."""
        held = set(self._base_ids())
        parts = [p for i, p in self._folders("batch").items() if i not in held]
        base = self._base()
        parts += [f"{base}/sums"] if base else []
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        return summed(rows).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Folds all committed batches into a new base; a failure before its rename leaves all as it was."""
        ids, bases = self.committed(), self._folders("base")
        version = max(map(int, bases), default=0) + 1
        draft = shared_folder(self.spark, "rollup-base")
        self.totals().write.parquet(f"{draft}/sums")
        self.spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1).write.json(f"{draft}/ids")
        if not self.fs.rename(self._path(draft), self._path(f"{self.path}/base={version}")):
            raise OSError("could not commit the base")
        held = set(ids)
        for i, p in self._folders("batch").items():
            if i in held:
                self.fs.delete(self._path(p), True)
        for p in bases.values():
            self.fs.delete(self._path(p), True)


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`, without building them: the places where one begins."""
    body = F.translate(F.coalesce(text, F.lit("")), "\t\n\u000b\f\r", "     ")
    spaced = F.concat(F.lit(" "), body)
    return F.size(F.array_remove(F.split(spaced, " +"), "")).cast("bigint")


def n_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint")


def n_fields(text: Column) -> Column:
    """A first, cruder word count: one more than the single spaces."""
    body = F.coalesce(text, F.lit(""))
    return (F.length(body) - F.length(F.translate(body, " ", "")) + 1).cast("bigint")


def op7_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents under two tokenizer versions, replays the load, then revises every word count to the second version."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    counts = F.array(F.struct(F.lit("bytes-1").alias("tokenizer"), n_bytes(text).alias("n_tokens")), F.struct(F.lit("words-1").alias("tokenizer"), n_fields(text).alias("n_tokens")))
    load = docs.select("source", "lang", F.explode(counts).alias("c")).select("source", "lang", "c.tokenizer", "c.n_tokens")
    load = signed(load, 1)
    revised = docs.select(F.lit("revise").alias("op"), "source", "lang", F.lit("words-2").alias("tokenizer"), n_words(text).alias("n_tokens"), F.lit("words-1").alias("old_tokenizer"), n_fields(text).alias("old_n_tokens"))
    table = Rollup(spark, shared_folder(spark, "rollup"))
    table.commit("load", load)
    table.commit("load", load)  # a replay: no effect
    table.commit("words-2", deltas(revised))
    table.compact()
    return table.totals()


ORACLE = """
select source, lang, tokenizer, count(*)::bigint as n_docs, sum(n)::bigint as n_tokens from (
  select source, lang, 'bytes-1' as tokenizer, strlen(coalesce(text, '')) as n from documents
  union all
  select source, lang, 'words-2', len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) from documents
) group by source, lang, tokenizer
"""
