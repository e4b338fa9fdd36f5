"""Readers for the test tables (parquet) with column pruning left to Catalyst."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


#: Session option of the local benchmark: partitions that a table's scan is
#: dealt into (unset: as the files split).  A single small file otherwise runs
#: every row-local step in one task.
SCAN_PARTITIONS = "spark.gapmatch.localScanPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one table; projections/filters downstream are pushed into it."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    n = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df
