"""How rows are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt over all cores by a hash of the columns; for work that a small input file would leave to one task.

    The number of partitions is given, since adaptive execution would merge those of few bytes, however much work their rows are.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *columns)
