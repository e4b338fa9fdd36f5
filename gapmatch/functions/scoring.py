"""Classification and metric expressions (SC-16, SC-17, SC-18, UX-01)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L
from .text import col


def gap_level(pct, thresholds: dict | None = None) -> Column:
    """SC-16: clamp to 0-100 and grade; returns struct(level, description).

    ``thresholds`` maps level name -> lower bound (UX-01); only lower bounds
    are used, as in the graded behaviour.
    """
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), col(pct).cast("double")))
    levels = [(thresholds.get(lv, lo) if thresholds else lo, lv, d) for lo, lv, d in L.GAP_LEVELS]
    *upper, last = levels
    expr = None
    for lo, lv, d in upper:
        v = F.struct(F.lit(lv).alias("level"), F.lit(d).alias("description"))
        expr = F.when(score >= F.lit(float(lo)), v) if expr is None else expr.when(score >= F.lit(float(lo)), v)
    _, lv, d = last
    return expr.otherwise(F.struct(F.lit(lv).alias("level"), F.lit(d).alias("description")))


def match_percentage(matched, required) -> Column:
    """AG-05: round(100*matched/required, 2) half-even; 0.0 when nothing required."""
    m, r = col(matched), col(required)
    return F.when(r > 0, F.bround(F.lit(100.0) * m / r, 2)).otherwise(F.lit(0.0))


def priority(hot, demand, importance, count) -> Column:
    """SC-17: priority label for a missing skill."""
    hot, demand, imp, cnt = col(hot), col(demand), col(importance), col(count)
    return (F.when(hot | demand | (imp >= 4.0), F.lit(L.PRIORITY_HIGH))
            .when((cnt >= 3) | (imp >= 3.0), F.lit(L.PRIORITY_MEDIUM))
            .otherwise(F.lit(L.PRIORITY_LOW)))


def priority_reason(hot, demand, importance, count) -> Column:
    hot, demand, imp, cnt = col(hot), col(demand), col(importance), col(count)
    imp_reason = F.concat(F.lit(L.REASON_IMPORTANCE.split("{importance}")[0]), imp.cast("double").cast("string"),
                          F.lit(L.REASON_IMPORTANCE.split("{importance}")[1]))
    med_reason = F.concat(F.lit(L.REASON_MEDIUM.split("{count}")[0]), cnt.cast("string"),
                          F.lit(L.REASON_MEDIUM.split("{count}")[1]))
    return (F.when(hot & demand, F.lit(L.REASON_HOT_AND_DEMAND))
            .when(hot, F.lit(L.REASON_HOT))
            .when(demand, F.lit(L.REASON_DEMAND))
            .when(imp >= 4.0, imp_reason)
            .when((cnt >= 3) | (imp >= 3.0), med_reason)
            .otherwise(F.lit(L.REASON_LOW)))


def safe_ratio(num, den) -> Column:
    """SC-18: num/den with 0.0 on an empty denominator."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def f1(p, r) -> Column:
    p, r = col(p), col(r)
    return F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))
