"""PL-06: extraction quality against labelled samples (JN-14, ST-03, AG-06, AG-07, SC-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import f1, safe_ratio
from ..functions.text import col


def _metrics(df):
    p_ = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r_ = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    df = df.withColumn("precision", p_).withColumn("recall", r_)
    return (df.withColumn("f1", f1("precision", "recall"))
            .withColumn("jaccard", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))))


def as_set(c) -> Column:
    """A list as ``evaluate_sets`` compares it: sorted, nothing twice, [] for NULL."""
    return F.sort_array(F.array_distinct(F.coalesce(col(c), F.array().cast("array<string>"))))


def evaluate_sets(samples: DataFrame, keys=("sample_id",), truth: str = "truth", predicted: str = "predicted",
                  domain: str = "domain", sets: bool = False) -> DataFrame:
    """PL-06 on one row per sample holding both skill sets as arrays.

    Set arithmetic (ST-03) runs inside the row; only the micro-average
    total is an aggregate, beside the rows, for which common skills alone are
    looked for: the other counts follow from the sizes.  Same output as
    ``evaluate``.  ``sets``: both lists are ``as_set`` or NULL already, which
    the caller does once per list where many samples share it.
    """
    keys = list(keys)
    one = (lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))) if sets else as_set
    s = samples.select(*keys, F.col(domain).alias("domain"), one(predicted).alias("p"), one(truth).alias("t"))
    s = s.select("*", F.array_intersect("p", "t").alias("tps"))
    tp = F.size("tps")
    per = s.select(*keys, "domain", tp.cast("bigint").alias("tp"), (F.size("p") - tp).cast("bigint").alias("fp"),
                   (F.size("t") - tp).cast("bigint").alias("fn"), F.array_join("tps", "|").alias("tp_skills"),
                   F.array_join(F.array_except("p", "t"), "|").alias("fp_skills"),
                   F.array_join(F.array_except("t", "p"), "|").alias("fn_skills"))
    return _metrics(per.select(F.lit("sample").alias("level"), *per.columns).unionByName(
        _total(per, keys))).select(*_columns(keys))


LISTS = ["tp_skills", "fp_skills", "fn_skills"]


def _columns(keys) -> list[str]:
    return ["level", *keys, "domain", "tp", "fp", "fn", "precision", "recall", "f1", "jaccard", *LISTS]


def _total(per: DataFrame, keys) -> DataFrame:
    """The micro-average's one row (AG-07): three sums, so no sample row is shuffled; no samples, no total."""
    t = per.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).filter("n > 0")
    return t.select(F.lit("total").alias("level"), *[F.lit(None).cast(per.schema[c].dataType).alias(c)
                                                     for c in [*keys, "domain"]], "tp", "fp", "fn",
                    *[F.lit(None).cast("string").alias(c) for c in LISTS])


def _with_total(per: DataFrame, keys) -> DataFrame:
    """Sample rows and the micro-average total in one pass (AG-07); no samples, no total."""
    lists = ["tp_skills", "fp_skills", "fn_skills"]
    every = [F.col(k) for k in [*keys, "domain"]]
    g = per.groupingSets([every, []], *every).agg(
        F.grouping_id().alias("gid"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
        *[F.first(c).alias(c) for c in lists])
    total = F.col("gid") > 0
    g = g.withColumns({c: F.when(~total, F.col(c)) for c in lists})
    return _metrics(g).select(F.when(total, F.lit("total")).otherwise(F.lit("sample")).alias("level"), *keys, "domain",
                              "tp", "fp", "fn", "precision", "recall", "f1", "jaccard", *lists)


def evaluate(truth: DataFrame, predicted: DataFrame, keys=("sample_id",), domain: str | None = "domain") -> DataFrame:
    """Per-sample and micro-averaged precision / recall / F1 / Jaccard.

    ``truth(keys.., [domain], skill)`` (already normalised) and
    ``predicted(keys.., skill)``; both are treated as sets.  Output has one
    row per sample (``level = 'sample'``) and one total row
    (``level = 'total'``, NULL keys).
    """
    keys = list(keys)
    t = truth.select(*keys, "skill").distinct().withColumn("in_t", F.lit(True))
    p = predicted.select(*keys, "skill").distinct().withColumn("in_p", F.lit(True))
    j = t.join(p, [*keys, "skill"], "full_outer")
    tp = F.col("in_t").isNotNull() & F.col("in_p").isNotNull()
    fp = F.col("in_t").isNull()
    fn = F.col("in_p").isNull()
    per = j.groupBy(*keys).agg(
        F.count_if(tp).alias("tp"), F.count_if(fp).alias("fp"), F.count_if(fn).alias("fn"),
        F.array_join(F.sort_array(F.collect_list(F.when(tp, F.col("skill")))), "|").alias("tp_skills"),
        F.array_join(F.sort_array(F.collect_list(F.when(fp, F.col("skill")))), "|").alias("fp_skills"),
        F.array_join(F.sort_array(F.collect_list(F.when(fn, F.col("skill")))), "|").alias("fn_skills"),
    )
    if domain:
        per = per.join(truth.select(*keys, F.col(domain).alias("domain")).distinct(), keys, "left")
    else:
        per = per.withColumn("domain", F.lit(None).cast("string"))
    return _with_total(per, keys)
