"""Joins of many rows with one row a key, where some keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that meet in one place; more are spread over several.
SPREAD = 10_000


def spread_join(rows: DataFrame, one: DataFrame, key: str, by: list[str], counts: DataFrame | None = None,
                spread: int | None = None) -> DataFrame:
    """``rows`` left-joined with ``one``, which holds one row a key, on ``key``.

    The row of a key that many rows have is copied to as many places as they
    need, and they are dealt out by the columns ``by``.  Keys that need copies
    are at most one in ``spread`` rows, a table small enough to be broadcast.
    ``counts(key, n)``: rows of each key, where they are known already.
    """
    spread = spread or SPREAD
    counts = counts if counts is not None else rows.groupBy(key).agg(F.count("*").alias("n"))
    hot = counts.filter((F.col("n") > spread) & F.col(key).isNotNull()).select(
        key, F.ceil(F.col("n") / spread).cast("int").alias("_copies"))
    copies = F.coalesce("_copies", F.lit(1))
    dealt = (rows.join(F.broadcast(hot), key, "left")
             .withColumn("_place", F.pmod(F.xxhash64(*by), copies).cast("int")).drop("_copies"))
    copied = (one.join(F.broadcast(hot), key, "left")
              .withColumn("_place", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies"))
    return dealt.join(copied, [key, "_place"], "left").drop("_place")
