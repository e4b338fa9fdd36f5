"""PL-07 pair summary and the report tables AG-13 / AG-14."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.scoring import gap_level

PAIR = ["resume_id", "job_id"]


def alignment_counts(summary: DataFrame) -> DataFrame:
    """AG-13: three rows per pair (Matched / Missing / Extra Skills, Count)."""
    return summary.select(*PAIR, F.expr(
        "stack(3, 'Matched Skills', total_matched, 'Missing Skills', total_missing, "
        "'Extra Skills', total_extra) AS (category, count)")).withColumn("count", F.col("count").cast("bigint"))


def priority_counts(prio: DataFrame) -> DataFrame:
    """AG-14: three rows per pair with something missing (priority level, count)."""
    p = prio.filter(F.col("total_recommended") > 0)
    return p.select(*PAIR, F.expr(
        f"stack(3, '{L.PRIORITY_HIGH}', high_count, '{L.PRIORITY_MEDIUM}', medium_count, "
        f"'{L.PRIORITY_LOW}', low_count) AS (priority, count)")).withColumn("count", F.col("count").cast("bigint"))


def pair_summary(summary: DataFrame, prio: DataFrame | None = None, similarity: DataFrame | None = None,
                 keep: tuple = ()) -> DataFrame:
    """PL-07: score, level (with its sentence), missing count and high-priority count per pair.

    ``high_count`` comes from ``prio``, or is a column of the summary (``match_summary`` with ``keep``).
    ``keep``: further columns of the summary to carry along, put last.
    """
    g = gap_level("match_percentage")
    s = summary if prio is None else summary.join(prio.select(*PAIR, "high_count"), PAIR, "left")
    out = s.select(*PAIR, "match_percentage", g["level"].alias("gap_level"), g["description"].alias("gap_description"),
                   "total_matched", "total_missing", "total_extra",
                   F.coalesce("high_count", F.lit(0).cast("bigint")).alias("high_priority_count"), *keep)
    if similarity is not None:
        out = out.join(similarity.select(*PAIR, "text_similarity_percentage"), PAIR, "left")
    return out.select(*[c for c in out.columns if c not in keep], *keep)
