"""From files to an analysis in one call (SRC-01, SRC-02, SRC-03, SRC-06, SRC-07, SRC-10, then PL-01 to PL-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..sources import readers as RD
from ..sources import scan
from .analyze import Analysis, analyze_pairs
from .documents import assemble_pages, route_by_suffix


def read_documents(spark: SparkSession, path: str, pages: DataFrame | None = None) -> DataFrame:
    """SRC-01 to SRC-03: ``id, kind, text, status`` of every file under a path or pattern.

    A file is routed by its suffix: ``.pdf`` in any case takes its text from
    ``pages(id, page_no, text)``, the page texts that a PDF decoder made of
    files of that name; all others are UTF-8 texts, bad bytes replaced.  The
    content of PDF files is not read.  ``id`` is the file's name; ``status``
    says what was found, and a file without text keeps an empty one.  Files of
    no bytes at all are left out, as Spark's file scans do.
    """
    names = F.element_at(F.split("path", "/"), -1).alias("id")
    listed = spark.read.format("binaryFile").load(path).select("path", names)
    text = route_by_suffix(RD.read_text_files(spark, path)).filter("kind = 'text'")
    chars = F.format_number(F.char_length("text"), 0)
    text = text.select(names, "kind", "text", F.concat(F.lit("Loaded "), chars, F.lit(" characters.")).alias("status"))
    pdf = route_by_suffix(listed).filter("kind = 'pdf'").select("id", "kind")
    if pages is None:
        made = pdf.select("id", "kind", F.lit("").alias("text"), F.lit(L.STATUS_NO_PAGES).alias("status"))
    else:
        got = assemble_pages(pages, "id").select(F.col("doc_id").alias("id"), "text", F.col("status").alias("found"))
        done = F.concat(F.lit("Extracted "), F.format_number(F.char_length("text"), 0), F.lit(" characters from PDF."))
        made = pdf.join(got, "id", "left").select(
            "id", "kind", F.coalesce("text", F.lit("")).alias("text"),
            F.when(F.col("text") != "", done).otherwise(F.coalesce("found", F.lit(L.STATUS_NO_PAGES))).alias("status"))
    return text.unionByName(made)


def load_kb(spark: SparkSession, path: str | None) -> DataFrame:
    """SRC-06, SRC-10: the knowledge base of a JSON object, the fallback where there is none or nothing in it."""
    return RD.kb_or_fallback(spark, RD.read_kb_json(spark, path) if path and scan.exists(spark, path) else None)


def analyze_files(spark: SparkSession, resumes: str, jobs: str, kb_path: str | None = None, alias_path: str | None = None,
                  pairs: DataFrame | None = None, pages: DataFrame | None = None, **options) -> Analysis:
    """The whole analysis of files of resumes and jobs.

    ``resumes`` and ``jobs`` are paths or patterns, ``pairs(resume_id,
    job_id)`` the file names to compare; without it there is one job, which
    all resumes are compared with.  ``kb_path`` and ``alias_path`` are JSON
    objects as ``write_kb`` and ``write_aliases`` make them; a missing one
    falls back to the built-in dictionary and the default aliases.
    """
    r, j = read_documents(spark, resumes, pages), read_documents(spark, jobs, pages)
    if pairs is None:
        one = [x["id"] for x in j.select("id").limit(2).collect()]
        if len(one) != 1:
            raise ValueError("give the pairs to compare where there is not exactly one job")
        pairs = r.select(F.col("id").alias("resume_id"), F.lit(one[0]).alias("job_id"))
    return analyze_pairs(r.select("id", "text"), j.select("id", "text"), pairs, load_kb(spark, kb_path),
                         RD.read_alias_json(spark, alias_path), **options)
