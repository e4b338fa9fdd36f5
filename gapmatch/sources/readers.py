"""File sources and sinks (SRC-01, SRC-04..08, SRC-10, SNK-01, SNK-02).

Schemas are explicit everywhere (no inference).  The knowledge base and the
alias map are written as parquet (the primary, splittable form) and can be
exported as one JSON object in the layout the original tools read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lookups as L
from ..functions.text import py_strip
from . import scan

# FIXED VALUES: columns of the software records, by their names in the files.
SOFTWARE_COLUMNS = {
    "O*NET-SOC Code": "soc_code", "Title": "title", "Workplace Example": "workplace_example",
    "Element ID": "element_id", "Element Name": "element_name", "Hot Technology": "hot_technology",
    "In Demand": "in_demand",
}

KB_ENTRY = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("skill_type", T.StringType()),
    T.StructField("hot_technology", T.BooleanType()),
    T.StructField("in_demand", T.BooleanType()),
    T.StructField("occupations_count", T.LongType()),
    T.StructField("soc_codes", T.ArrayType(T.StringType())),
    T.StructField("importance_score", T.DoubleType()),
])

SAMPLE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("ground_truth_skills", T.ArrayType(T.StringType())),
])


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: one row per file, (path, text); bad UTF-8 bytes become U+FFFD."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_software_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04: software records with normalised column names and file order.

    Files are scanned in byte ranges, also where quoted fields hold line
    breaks.  Columns are found by name, a missing one is null; ``ord`` sorts
    by the file's path and the row's place in it.
    """
    df = scan.read_csv(spark, path)
    pick = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")
    return df.select(*[pick(c).alias(name) for c, name in SOFTWARE_COLUMNS.items()], "ord")


def read_essential_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: essential-skill records (element_name, data_value)."""
    df = scan.read_csv(spark, path)
    return df.select(F.col("`Element Name`").alias("element_name"),
                     F.expr("try_cast(`Data Value` AS double)").alias("data_value"))


def read_kb_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: a JSON object keyed by skill, of any size -> one row per skill.

    The object (a file, or a folder of its parts) is scanned in byte ranges
    and split at the commas between its members.
    """
    m = scan.json_members(scan.json_entries(spark, path), KB_ENTRY)
    return m.select(F.col("key").alias("skill_key"), "value.*")


def read_alias_json(spark: SparkSession, path: str | None) -> DataFrame:
    """SRC-07: alias JSON over the defaults; keys/values lowercased and
    stripped; the file wins over defaults, and of keys that become equal the
    later one; a missing or non-object file adds nothing."""
    defaults = L.aliases_df(spark).select("alias", "canonical", F.lit(-1).cast("long").alias("priority"))
    if not path or not scan.exists(spark, path):
        return defaults.select("alias", "canonical")
    m = scan.json_members(scan.json_entries(spark, path), T.StringType())
    f = m.select(py_strip(F.lower("key")).alias("alias"), py_strip(F.lower("value")).alias("canonical"),
                 F.col("offset").alias("priority"))
    allr = defaults.unionByName(f)
    return (allr.groupBy("alias").agg(F.max_by("canonical", "priority").alias("canonical")))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: labelled samples; a missing file gives an empty table."""
    try:
        return spark.read.schema(SAMPLE_SCHEMA).option("multiLine", True).json(path)
    except Exception as e:  # AnalysisException: path does not exist
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], SAMPLE_SCHEMA)
        raise


def kb_or_fallback(spark: SparkSession, kb: DataFrame | None) -> DataFrame:
    """SRC-10: the fallback dictionary when no KB exists or it is empty."""
    from ..operators.extract import fallback_kb
    if kb is None or kb.isEmpty():
        return fallback_kb(spark)
    return kb


def write_kb(kb: DataFrame, path: str, json_path: str | None = None, json_file: str | None = None) -> None:
    """SNK-01: parquet (primary); optionally one JSON object, as a folder of its parts and also as one file."""
    cols = ["skill_key", "name", "category", "skill_type", "hot_technology", "in_demand",
            "occupations_count", "soc_codes", "importance_score"]
    kb.select(*cols).write.mode("overwrite").parquet(path)
    if json_path:
        entry = F.to_json(F.struct(*[F.col(c) for c in cols[1:]]), {"ignoreNullFields": "false"})
        scan.write_json_object(kb.sparkSession.read.parquet(path), "skill_key", entry, json_path, json_file)


def write_aliases(aliases: DataFrame, path: str, json_path: str | None = None, json_file: str | None = None) -> None:
    """SNK-02: alias map as parquet; optionally one JSON object, as ``write_kb``."""
    aliases.select("alias", "canonical").write.mode("overwrite").parquet(path)
    if json_path:
        text = F.regexp_replace(F.to_json(F.struct(F.col("canonical").alias("v"))), r'^\{"v":|\}\z', "")
        scan.write_json_object(aliases.sparkSession.read.parquet(path), "alias", text, json_path, json_file)
