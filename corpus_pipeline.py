"""The corpus pipeline: five stages over `documents`, each a Parquet table for the next.

toxicity        drops documents predicted toxic (score >= 0.3)
near_dedup      keeps one document of each near-duplicate component, that of the lowest id
decontaminate   drops documents that hold a benchmark item within its error budget
secrets         replaces secrets by <secret> and updates n_chars
encode          returns ids and digests of the BPE encoding of what is left

Null texts pass the first four stages; nulls in other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.bpe import digest_documents
from codeloom.llm.common import chunks, filter_rows, written
from codeloom.llm.decontamination import clean_rows
from codeloom.llm.neardup import without_near_duplicates
from codeloom.llm.secrets import redact, train_ranks
from codeloom.llm.toxicity import Scorer, learn, training_rows

TOXIC_SCORE = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scorer = learn(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    weights, coef = dict(scorer.weights), scorer.coef
    return filter_rows(docs, lambda texts, s: (s.score(t) < TOXIC_SCORE for t in texts), setup=lambda: Scorer(weights, coef))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = train_ranks(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, texts in chunks(batches):
            clean = [redact(t, ranks) for t in texts]
            changed = [c != t for c, t in zip(clean, texts)]
            for name, new in (("text", clean), ("n_chars", [len(c) for c in clean])):
                i = cut.schema.get_field_index(name)
                if i >= 0 and any(changed):
                    old = cut.column(i)
                    mixed = [n if ch else o for n, o, ch in zip(new, old.to_pylist(), changed)]
                    cut = cut.set_column(i, cut.schema.field(i), pa.array(mixed, old.type))
            yield cut

    return docs.mapInArrow(run, docs.schema)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("encode", encode)]

#: The grammar, the paths, the edit matching and the encoding are no SQL; tests hold each stage against a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
