"""What the training-data operators share: scans, written intermediates, words."""

from __future__ import annotations

import tempfile
import uuid
from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"
#: The setting by which Spark removes an action's shuffle files at its end.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one whole table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A private folder is made only for a local master (tests); a cluster that
    names none is an error, as executors could not read each other's files.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="llm-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a reused intermediate to the shared folder and read it back.

    The lineage ends at files that every executor can read, so a lost
    executor costs only its running tasks, and later plans know the size.
    What the write shuffled is removed from the local disks when it is done,
    and not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        df.select("*").write.parquet(path)  # a plan of its own: that of ``df`` may hold shuffles of an earlier action
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column | str) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def placed(df: DataFrame, group: list[str], order: list[str], name: str = "placed") -> DataFrame:
    """``df`` with ``pos``, each row's place (from 0) in its group by ``order``, and ``part``, its share of the group.

    No group is sorted by one task: rows are dealt by ranges of group and
    order, so a large group spreads over many parts; each part's places follow
    on the rows of the group's earlier parts.  Rows equal in all these columns
    take any order among them.  Groups are not null.
    """
    df = df.withColumn("_row", F.monotonically_increasing_id())
    keys = [F.col(c) for c in group] + [F.col(c).asc_nulls_first() for c in order] + [F.col("_row")]
    s = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    s = written(s.withColumn("part", F.shiftright("_at", 33)).drop("_row"), name)
    parts = s.groupBy(*group, "part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (s.join(parts, [*group, "part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_at", "_first", "_before"))


def map_texts(d: DataFrame, work, schema: str, keep: list[str], rows: int | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``d`` as they are, and the columns that ``work`` makes of its texts.

    ``work`` turns an iterator of series of texts into one of pandas frames
    with the columns of ``schema``, one for each series.  Columns kept pass by
    as Arrow arrays, so that no id becomes a float where another is null.  A
    series has ``rows`` texts at most, and its frame leaves the task at once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = StructType.fromDDL(schema)
    arrow = to_arrow_schema(made)
    d = d.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])

    def run(batches):
        waiting: deque = deque()

        def texts():
            for b in batches:
                for k in range(0, b.num_rows, rows or b.num_rows):
                    part = b.slice(k, rows or b.num_rows)
                    waiting.append([part.column(c) for c in keep])
                    yield pd.Series(part.column(text).to_pylist(), dtype=object)

        for t in work(texts()):
            new = [pa.Array.from_pandas(t[f.name], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(waiting.popleft() + new, names=[*keep, *arrow.names])

    return d.mapInArrow(run, StructType([*[f for f in d.schema.fields if f.name in keep], *made.fields]))
