"""SC-19 / WN-05: normalise skill lists with ordered de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skills import cleanup, probe_dot_slash, probe_hyphen
from ..plans.reuse import materialize
from ..plans.skew import spread_join


def skill_dictionary(raw: DataFrame, aliases: DataFrame, src: str = "raw") -> DataFrame:
    """SC-05 + JN-01 on a dictionary: ``src, skill, n`` of every distinct string that is not null.

    A string is cleaned once, however often it stands in the data.  Its three
    probes (cleaned, hyphen to space, dot or slash to space) are rows of one
    join with the aliases, and the first probe that meets one decides.
    """
    d = raw.filter(F.col(src).isNotNull()).groupBy(src).agg(F.count("*").alias("n")).withColumn("s", cleanup(src))
    probes = F.array(*[F.struct(F.lit(k).alias("k"), p.alias("alias")) for k, p in enumerate(
        [F.col("s"), probe_hyphen("s"), probe_dot_slash("s")])])
    met = (d.select(src, F.inline(probes)).join(aliases.select("alias", "canonical"), "alias")
           .groupBy(src).agg(F.min_by("canonical", "k").alias("canonical")))
    skill = F.when(F.col("s") == "", F.lit("")).otherwise(F.coalesce("canonical", "s"))
    return d.join(met, src, "left").select(src, skill.alias("skill"), "n")


def normalize_by_dictionary(raw: DataFrame, aliases: DataFrame, src: str = "raw") -> DataFrame:
    """``raw`` with ``skill``; a string that many rows hold is met in several places (null stays null)."""
    words = materialize(skill_dictionary(raw, aliases, src))  # as large as the vocabulary, used three times
    return spread_join(raw, words.drop("n"), src, [c for c in raw.columns if c != src] or [src], words.select(src, "n"))


def normalize_skill_list(raw: DataFrame, aliases: DataFrame, key: str = "resume_id") -> DataFrame:
    """``raw(key, pos, raw)`` -> ``(key, n_raw, n_skills, skills ARRAY<STRING>)``.

    Each entry is normalised (SC-05 + JN-01); empties are dropped; the first
    occurrence (smallest ``pos``) of every skill decides its place.
    """
    n = normalize_by_dictionary(raw, aliases).filter(F.col("skill") != "")
    first = n.groupBy(key, "skill").agg(F.min("pos").alias("p"))
    lists = first.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", "skill"))), lambda s: s["skill"]).alias("skills"))
    counts = raw.groupBy(key).agg(F.count("*").alias("n_raw"))
    return (counts.join(lists, key, "left")
            .select(key, "n_raw", F.coalesce(F.size("skills"), F.lit(0)).cast("bigint").alias("n_skills"),
                    F.coalesce("skills", F.array().cast("array<string>")).alias("skills")))
