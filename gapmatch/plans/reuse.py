"""Reuse of an intermediate by several branches of one plan.

Joins carry no hand-made broadcast decision: Spark chooses by byte size
(``autoBroadcastJoinThreshold``) and re-plans at runtime (AQE).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def materialize(df: DataFrame) -> DataFrame:
    """Compute a vocabulary-sized intermediate (the knowledge base) once.

    A reliable checkpoint into ``spark.checkpoint.dir`` (shared storage on a
    cluster).  Not for tables of pairs or of document rows: those stay lazy.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, plain: bool = False) -> DataFrame:
    """Write an intermediate to ``spark.checkpoint.dir`` as Parquet and read it back.

    Unlike a checkpoint it has a size that is known before the query runs, so
    a join with it is planned by that size.  ``plain``: neither dictionary nor
    codec, so that the files are about as large as the rows in memory.
    """
    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    w = df.write
    if plain:
        w = w.option("compression", "none").option("parquet.enable.dictionary", "false")
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
