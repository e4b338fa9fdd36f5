"""PL-05: build the skill knowledge base and the alias map.

Inputs follow the occupational CSV layout (column names normalised, see
``gapmatch.sources.readers``):

* software records ``(soc_code, workplace_example, element_name,
  hot_technology, in_demand, ord)`` where ``ord`` orders the rows as in the
  file;
* essential records ``(element_name, data_value)``.

All steps are aggregates and joins over skill keys (AG-01, AG-02, JN-12,
JN-13, WN-04, AG-03); the hot-key case (one skill on a third of the rows)
only feeds partial aggregates (``min_by``, ``bool_or``, ``count``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.skills import alias_variant, curated_display, is_valid_skill
from ..functions.text import py_strip, select_once

KB_COLUMNS = ["skill_key", "name", "category", "skill_type", "hot_technology", "in_demand",
              "occupations_count", "soc_codes", "importance_score"]


def _pystr(c):
    """``str(value)`` of a pandas cell: missing values read as 'nan'."""
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def software_kb(sw: DataFrame) -> DataFrame:
    """AG-01 (+ FLT-03, FLT-07): one row per lowercased software skill."""
    # equal records first: their cells are stripped once, not in every record
    g = sw.groupBy("workplace_example", "soc_code", "hot_technology", "in_demand").agg(
        F.min_by("element_name", "ord").alias("element_name"), F.min("ord").alias("ord"), F.count("*").alias("n"))
    r = select_once(
        g, ["ord", "n"],
        raw=py_strip(_pystr("workplace_example")),
        hot=F.upper(py_strip(_pystr("hot_technology"))) == "Y",
        dem=F.upper(py_strip(_pystr("in_demand"))) == "Y",
        category=py_strip(_pystr("element_name")),
        soc=py_strip(F.coalesce(F.col("soc_code").cast("string"), F.lit(""))),
    )
    r = r.filter((F.col("raw") != "") & (F.lower("raw") != "nan")).withColumn("skill_key", F.lower("raw"))
    r = r.filter(~F.col("skill_key").isin(sorted(L.BLOCKLIST)))
    # two levels: (skill, soc) first, then skill; all levels are partial
    # aggregates, so a skill on a third of all rows is fine
    lvl1 = r.groupBy("skill_key", "soc").agg(
        F.min("ord").alias("o"),
        F.min_by(F.struct("raw", "category"), "ord").alias("first"),
        F.bool_or("hot").alias("hot"), F.bool_or("dem").alias("dem"), F.sum("n").alias("n"))
    agg = lvl1.groupBy("skill_key").agg(
        F.min_by("first", "o").alias("first"),
        F.min("o").alias("first_ord"),
        F.bool_or("hot").alias("hot_technology"),
        F.bool_or("dem").alias("in_demand"),
        F.sum("n").alias("occupations_count"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("soc") != "", F.struct("o", "soc")))),
                    lambda x: x["soc"]).alias("soc_codes"),
    )
    return agg.select("skill_key", F.col("first.raw").alias("name"), F.col("first.category").alias("category"),
                      F.lit("software").alias("skill_type"), "hot_technology", "in_demand",
                      F.col("occupations_count").cast("bigint").alias("occupations_count"),
                      "soc_codes", F.lit(0.0).alias("importance_score"), "first_ord")


def essential_kb(ess: DataFrame) -> DataFrame:
    """AG-02: mean / count of ``data_value`` per raw element name, then per key.

    Groups are visited in sorted raw-name order: the first spelling of a key
    creates the entry, the last one sets its importance.
    """
    g = (ess.filter(F.col("element_name").isNotNull())
         .groupBy("element_name")
         .agg(F.avg("data_value").alias("mean"), F.count("data_value").alias("cnt")))
    # names are judged once each: a condition on a grouping column would be moved below the aggregate, to every record
    g = select_once(g, ["element_name", "mean", "cnt"], raw=py_strip("element_name"))
    g = g.filter((F.col("raw") != "") & (F.lower("raw") != "nan")).withColumn("skill_key", F.lower("raw"))
    g = g.filter(~F.col("skill_key").isin(sorted(L.BLOCKLIST)) & is_valid_skill("skill_key"))
    per_key = g.groupBy("skill_key").agg(
        F.min_by(F.struct("raw", "mean", "cnt"), "element_name").alias("first"),
        F.max_by("mean", "element_name").alias("last_mean"),
        F.min("element_name").alias("first_element"),
    )
    return per_key.select(
        "skill_key", F.col("first.raw").alias("name"), F.col("first.mean").alias("mean"),
        F.col("first.cnt").cast("bigint").alias("occupations_count"),
        (F.col("first.mean") >= 4.0).alias("in_demand"),
        F.bround("last_mean", 2).alias("importance_score"), "first_element",
    )


def curated_df(spark: SparkSession) -> DataFrame:
    rows = [(i, n, c, t, h, d) for i, (n, c, t, h, d) in enumerate(L.curated_skills())]
    return spark.createDataFrame(rows, "cur_ord int, cur_name string, cur_category string, cur_type string, "
                                       "cur_hot boolean, cur_demand boolean")


def build_kb(spark: SparkSession, sw: DataFrame, ess: DataFrame) -> DataFrame:
    """JN-12 + JN-13: merge software, essential and curated skills.

    Returns KB_COLUMNS plus ``src_rank`` / ``src_ord`` (insertion order used
    by the alias generation).
    """
    s = software_kb(sw)
    e = essential_kb(ess)
    m = s.join(e.select("skill_key", F.col("name").alias("e_name"), F.col("occupations_count").alias("e_count"),
                        F.col("in_demand").alias("e_dem"), F.col("importance_score").alias("e_imp"),
                        "first_element"),
               "skill_key", "full_outer")
    is_sw = F.col("name").isNotNull()
    merged = m.select(
        "skill_key",
        F.when(is_sw, F.col("name")).otherwise(F.col("e_name")).alias("name"),
        F.when(is_sw, F.col("category")).otherwise(F.lit(L.ESSENTIAL_CATEGORY)).alias("category"),
        F.when(is_sw, F.col("skill_type")).otherwise(F.lit("essential")).alias("skill_type"),
        F.when(is_sw, F.col("hot_technology")).otherwise(F.lit(False)).alias("hot_technology"),
        F.when(is_sw, F.col("in_demand")).otherwise(F.col("e_dem")).alias("in_demand"),
        F.when(is_sw, F.col("occupations_count")).otherwise(F.col("e_count")).alias("occupations_count"),
        F.when(is_sw, F.col("soc_codes")).otherwise(F.array().cast("array<string>")).alias("soc_codes"),
        F.coalesce(F.col("e_imp"), F.col("importance_score")).alias("importance_score"),
        F.when(is_sw, F.lit(0)).otherwise(F.lit(1)).alias("src_rank"),
        F.when(is_sw, F.col("first_ord").cast("string")).otherwise(F.col("first_element")).alias("src_key"),
    )
    cur = curated_df(spark).withColumn("skill_key", F.lower("cur_name"))
    j = merged.join(F.broadcast(cur), "skill_key", "full_outer")
    new = F.col("name").isNull()
    kb = j.select(
        "skill_key",
        F.when(new, curated_display("cur_name")).otherwise(F.col("name")).alias("name"),
        F.when(new, F.col("cur_category")).otherwise(F.col("category")).alias("category"),
        F.when(new, F.col("cur_type")).otherwise(F.col("skill_type")).alias("skill_type"),
        F.when(new, F.col("cur_hot")).otherwise(F.col("hot_technology") | F.coalesce("cur_hot", F.lit(False)))
        .alias("hot_technology"),
        F.when(new, F.col("cur_demand")).otherwise(F.col("in_demand") | F.coalesce("cur_demand", F.lit(False)))
        .alias("in_demand"),
        F.when(new, F.lit(10).cast("bigint")).otherwise(F.col("occupations_count")).alias("occupations_count"),
        F.when(new, F.array().cast("array<string>")).otherwise(F.col("soc_codes")).alias("soc_codes"),
        F.when(new, F.when(F.col("cur_demand"), F.lit(4.5)).otherwise(F.lit(3.5)))
        .otherwise(F.col("importance_score")).alias("importance_score"),
        F.when(new, F.lit(2)).otherwise(F.col("src_rank")).alias("src_rank"),
        F.when(new, F.col("cur_ord")).otherwise(F.lit(None).cast("int")).alias("cur_ord"),
        "src_key",
    )
    return kb


def alias_map(spark: SparkSession, kb: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """WN-04 + SC-12: defaults plus generated punctuation-free variants.

    A variant is kept when it differs from its key and is not a default
    alias; among keys producing the same variant the first inserted wins.
    ``extra(alias, canonical)`` (UX-03) overrides everything; of user aliases
    that are equal after lower/strip the later one wins, by an ``ord`` column
    where there is one, else the greatest original spelling.
    Returns (alias, canonical, source).
    """
    defaults = L.aliases_df(spark).select("alias", "canonical", F.lit("default").alias("source"))
    v = kb.select("skill_key", alias_variant("skill_key").alias("alias"), "src_rank", "src_key", "cur_ord")
    v = v.filter(F.col("alias") != F.col("skill_key"))
    # insertion order: software by first row, essential by sorted name, curated by list position
    order = F.struct("src_rank", F.coalesce("cur_ord", F.lit(0)).alias("c"),
                     F.coalesce(F.col("src_key"), F.lit("")).alias("k"))
    gen = (v.groupBy("alias").agg(F.min_by("skill_key", order).alias("canonical"))
           .join(F.broadcast(defaults.select("alias")), "alias", "left_anti")
           .select("alias", "canonical", F.lit("generated").alias("source")))
    out = defaults.unionByName(gen)
    if extra is not None:
        place = F.struct(*(["ord"] if "ord" in extra.columns else []), F.col("alias").alias("a"),
                         F.col("canonical").alias("c"))
        ex = extra.select(py_strip(F.lower("alias")).alias("alias"), py_strip(F.lower("canonical")).alias("canonical"),
                          place.alias("place"))
        ex = (ex.filter((F.col("alias") != "") & (F.col("canonical") != "")).groupBy("alias")
              .agg(F.max_by("canonical", "place").alias("canonical")).withColumn("source", F.lit("user")))
        out = out.join(ex.select("alias"), "alias", "left_anti").unionByName(ex)
    return out


def kb_totals(kb: DataFrame, aliases: DataFrame) -> DataFrame:
    """AG-03: distinct skills, hot and in-demand counts, alias total as
    (metric, value) rows."""
    k = kb.agg(F.count("*").alias("total_skills"), F.count_if("hot_technology").alias("hot_skills"),
               F.count_if("in_demand").alias("in_demand_skills"))
    k = k.select(F.explode(F.array(
        F.struct(F.lit("total_skills").alias("metric"), F.col("total_skills").alias("value")),
        F.struct(F.lit("hot_skills").alias("metric"), F.col("hot_skills").alias("value")),
        F.struct(F.lit("in_demand_skills").alias("metric"), F.col("in_demand_skills").alias("value")),
    )).alias("m")).select("m.metric", "m.value")
    a = aliases.agg(F.count("*").alias("value")).select(F.lit("total_aliases").alias("metric"), "value")
    return k.unionByName(a)
