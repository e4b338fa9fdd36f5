"""PL-04: demand-aware recommendations for missing skills (JN-10, SC-17, AG-11, AG-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.scoring import priority, priority_reason
from ..functions.skills import canon, title_case
from ..functions.text import select_once



def recommendations(missing: DataFrame, kb: DataFrame, keys=("resume_id", "job_id")) -> DataFrame:
    """One row per missing skill with its priority and reason.

    ``missing(keys.., skill[, pos])``; ``kb`` with the knowledge-base columns.
    ``pos``, the place in the missing list, is carried along.
    Skills absent from the KB get: name = title case of the skill, category
    'General Skill', no flags, frequency 1, importance 0.0.
    """
    k = kb.select(F.col("skill_key").alias("_k"), F.col("name").alias("_name"), F.col("category").alias("_cat"),
                  F.col("hot_technology").alias("_hot"), F.col("in_demand").alias("_dem"),
                  F.col("occupations_count").alias("_occ"), F.col("importance_score").alias("_imp"))
    m = missing.withColumn("skill_key", canon("skill"))
    j = m.join(k, F.col("skill_key") == F.col("_k"), "left")
    pos = ["pos"] if "pos" in missing.columns else []
    j = j.select(*keys, *pos, "skill_key",
                 F.coalesce("_name", title_case("skill")).alias("skill"),
                 F.coalesce("_cat", F.lit(L.DEFAULT_CATEGORY_MISSING)).alias("category"),
                 F.coalesce("_hot", F.lit(False)).alias("hot_technology"),
                 F.coalesce("_dem", F.lit(False)).alias("in_demand"),
                 F.coalesce("_occ", F.lit(1).cast("bigint")).alias("occupations_count"),
                 F.coalesce("_imp", F.lit(0.0)).alias("importance_score"))
    return j.select(*keys, *pos, "skill_key", "skill", "category",
                    priority("hot_technology", "in_demand", "importance_score", "occupations_count").alias("priority"),
                    priority_reason("hot_technology", "in_demand", "importance_score", "occupations_count")
                    .alias("reason"),
                    "hot_technology", "in_demand", "importance_score")


ITEM = ["skill_key", "skill", "category", "priority", "reason", "hot_technology", "in_demand", "importance_score"]


def priority_summary(recs: DataFrame, keys=("resume_id", "job_id")) -> DataFrame:
    """AG-11 + AG-12: bucket counts and bucket lists of whole items, in the order of the missing list
    (``pos`` where given, else by skill key)."""
    place = [c for c in ("pos", "skill_key") if c in recs.columns]

    def bucket(level):
        items = F.collect_list(F.when(F.col("priority") == level, F.struct(*place, F.struct(*ITEM).alias("item"))))
        return F.transform(F.array_sort(items), lambda s: s["item"])

    return recs.groupBy(*keys).agg(
        F.count("*").alias("total_recommended"),
        F.count_if(F.col("priority") == L.PRIORITY_HIGH).alias("high_count"),
        F.count_if(F.col("priority") == L.PRIORITY_MEDIUM).alias("medium_count"),
        F.count_if(F.col("priority") == L.PRIORITY_LOW).alias("low_count"),
        bucket(L.PRIORITY_HIGH).alias("high_priority"),
        bucket(L.PRIORITY_MEDIUM).alias("medium_priority"),
        bucket(L.PRIORITY_LOW).alias("low_priority"),
    )


def job_items(required: DataFrame, kb: DataFrame) -> DataFrame:
    """(job_id, items): the recommendation of every required skill of a job, in the order of its list.

    Made once per job, before pairs exist, for ``match.pair_frame`` (``of_jobs``).
    """
    recs = recommendations(required.select("job_id", "skill").distinct(), kb, keys=("job_id",))
    return recs.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct(*ITEM))).alias("items"))


def job_levels(required: DataFrame, kb: DataFrame) -> DataFrame:
    """(job_id, levels): the priority of every required skill of a job, as ``job_items``."""
    recs = recommendations(required.select("job_id", "skill").distinct(), kb, keys=("job_id",))
    return recs.groupBy("job_id").agg(
        F.map_from_entries(F.collect_list(F.struct("skill_key", "priority"))).alias("levels"))


def with_priority_counts(frame: DataFrame) -> DataFrame:
    """AG-11 inside the pair row: ``frame`` with total_recommended, high_count, medium_count and low_count.

    ``frame`` is ``match.pair_frame`` with ``job_levels``, so missing skills are
    neither exploded nor shuffled, and no row with lists is.
    """
    f = select_once(frame, [c for c in frame.columns if c != "levels"],
                    _lv=F.transform("missing", lambda s: F.element_at("levels", s)))
    count = lambda level: (F.size("_lv") - F.size(F.array_remove("_lv", level))).cast("bigint")
    return f.withColumns({
        "total_recommended": F.size("_lv").cast("bigint"), "high_count": count(L.PRIORITY_HIGH),
        "medium_count": count(L.PRIORITY_MEDIUM), "low_count": count(L.PRIORITY_LOW)}).drop("_lv")


def pair_priorities(frame: DataFrame, keys=("resume_id", "job_id")) -> DataFrame:
    """``priority_summary`` inside the pair row; ``frame`` is ``match.pair_frame`` with ``job_items``.

    Items stand in the order of the job's list, which is that of the missing list.
    """
    open_ = F.filter("items", lambda x: F.array_contains("missing", x["skill_key"]))
    f = select_once(frame, keys, _open=open_).filter(F.size("_open") > 0)
    bucket = lambda level: F.filter("_open", lambda x: x["priority"] == level)
    f = select_once(f, [*keys, "_open"], high_priority=bucket(L.PRIORITY_HIGH),
                    medium_priority=bucket(L.PRIORITY_MEDIUM), low_priority=bucket(L.PRIORITY_LOW))
    size = lambda c: F.size(c).cast("bigint")
    return f.select(*keys, size("_open").alias("total_recommended"), size("high_priority").alias("high_count"),
                    size("medium_priority").alias("medium_count"), size("low_priority").alias("low_count"),
                    "high_priority", "medium_priority", "low_priority")
