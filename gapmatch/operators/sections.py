"""Section detection (SC-08, WN-01, JN-04) on cleaned text.

A header line opens a section that runs to the next header; text before the
first header is ``summary``.  Sections are line ranges, so the section of any
character offset is the section of its line.  Everything is computed inside
the document row: the header list of a document is tiny compared with its
text, so no window or shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.text import bound, col, select_once


def header_class(line) -> Column:
    """SC-08: section class of a stripped line, or NULL (first class wins)."""
    def first(s):
        expr = None
        for cls, rx in L.section_classes():
            # every pattern starts with ^; only in front of them all it keeps the search from trying each position
            cond = s.rlike(rx.replace("(?i)", "(?i)^", 1))
            expr = F.when(cond, F.lit(cls)) if expr is None else expr.when(cond, F.lit(cls))
        return expr

    return bound(F.btrim(col(line), F.lit(" ")), first)  # cleaned lines hold only printable ASCII


def lines(cleaned) -> Column:
    return F.split(col(cleaned), "\n", -1)


def headers(cleaned) -> Column:
    """ARRAY<STRUCT<i INT, cls STRING>> of header lines (0-based line index)."""
    ls = lines(cleaned)
    tagged = F.transform(ls, lambda ln, i: F.struct(i.alias("i"), header_class(ln).alias("cls")))
    return F.filter(tagged, lambda h: h["cls"].isNotNull())


def section_of_line(hdrs, line_no) -> Column:
    """JN-04: class of the last header at or before ``line_no``; else summary."""
    before = F.filter(col(hdrs), lambda h: h["i"] <= col(line_no))
    return F.when(F.size(before) > 0, F.element_at(before, -1)["cls"]).otherwise(F.lit("summary"))


def display(cls) -> Column:
    kv = []
    for k, v in L.SECTION_DISPLAY.items():
        kv += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*kv), col(cls)), F.lit(L.SECTION_DISPLAY["body"]))


def section_spans(docs: DataFrame) -> DataFrame:
    """WN-01 as a table: one row per section span.

    ``docs(doc_id, clean)`` -> ``(doc_id, section, start, end)`` with
    character offsets (one character per newline), summary first.  A header
    on line one yields an empty summary span (0, 0).
    """
    # one running sum of line lengths, noted where a header opens a section
    tagged = F.transform(lines("clean"), lambda x: F.struct(
        (F.char_length(x) + 1).alias("len"), header_class(x).alias("cls")))
    init = F.struct(F.lit(0).alias("off"), F.array(F.struct(F.lit("summary").alias("cls"), F.lit(0).alias("start")))
                    .alias("b"))

    def step(acc, x):
        here = F.struct(x["cls"].alias("cls"), acc["off"].alias("start"))
        return F.struct((acc["off"] + x["len"]).alias("off"),
                        F.when(x["cls"].isNull(), acc["b"]).otherwise(F.concat(acc["b"], F.array(here))).alias("b"))

    d = select_once(docs, ["doc_id"], a=F.aggregate(tagged, init, step))
    d = d.select("doc_id", "a.b", F.col("a.off").alias("total"))
    spans = F.transform("b", lambda h, k: F.struct(
        h["cls"].alias("section"), h["start"].alias("start"),
        F.coalesce(F.try_element_at(F.col("b"), k + 2)["start"], F.col("total")).alias("end")))
    out = d.select("doc_id", F.inline(spans))
    # the leading summary span exists only when the first header is not line one
    return out.select("doc_id", "section", F.col("start").cast("bigint").alias("start"),
                      F.col("end").cast("bigint").alias("end"))
