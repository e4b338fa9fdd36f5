"""Parallel scans of formats whose state runs through a whole file (SRC-04..07).

A quoted CSV may hold line breaks inside fields, and a JSON object is one
value: where a byte range starts, only all that stands before tells whether it
is inside a string or how deep it is nested.  Spark deals a file out in byte
ranges cut at a separator (a line break, a comma).  What each piece adds to the
state is a count, the state before a piece is a prefix sum of those counts
(within its byte range, plus the totals of earlier ranges), and records begin
at separators where the state says so.  Rows of a byte range meet in one task,
rows of a file never do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col
from ..plans.reuse import materialize

RANGE = ["path", "block"]


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``path, block, at, piece``: the parts of files between separators (one byte).

    ``block`` is the start of a piece's byte range, ``at`` gives the order in it.
    """
    m = F.col("_metadata")
    return spark.read.option("lineSep", separator).text(path).select(
        m["file_path"].alias("path"), m["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))


def with_state(df: DataFrame, stream: list[str], **values) -> DataFrame:
    """``df`` with, for each name, the sum (or greatest) of a value over all earlier rows of its stream.

    A value is a column (summed over earlier rows, 0 where there is none) or
    ``("max", column)`` (the greatest up to the row itself).  A stream is all
    files of equal ``stream`` columns, in the order of their paths.  Only one
    row a byte range is ordered as a whole.
    """
    parts = {n: (F.sum, v, -1) if not isinstance(v, tuple) else (F.max, v[1], 0) for n, v in values.items()}
    totals = df.groupBy(*dict.fromkeys([*stream, *RANGE])).agg(*[f(v).alias(n) for n, (f, v, _) in parts.items()])
    ranges = Window.partitionBy(*(stream or [F.lit(0)])).orderBy(*RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*RANGE, *[f(F.col(n)).over(ranges).alias(f"_{n}") for n, (f, _, _) in parts.items()])
    inner = Window.partitionBy(*RANGE).orderBy("at")
    out = df.withColumns({n: f(v).over(inner.rowsBetween(Window.unboundedPreceding, last))
                          for n, (f, v, last) in parts.items()}).join(before, RANGE)
    both = {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_{n}"), F.lit(0)) if f is F.sum
            else F.greatest(F.col(n), F.col(f"_{n}")) for n, (f, _, _) in parts.items()}
    return out.withColumns(both).drop(*[f"_{n}" for n in parts])


def _count(c, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern)).cast("long")


# ---------------------------------------------------------------------------
# quoted CSV
# ---------------------------------------------------------------------------

def exists(spark: SparkSession, path: str) -> bool:
    """There is a file or folder of that name or pattern."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``path, offset, record``: the records of quoted CSV files, headers included.

    Fields are quoted by ``"``, a quote inside is doubled, and quoted fields
    may hold line breaks.  A line belongs to the record in which it starts
    inside quotes, which is where an odd number of quotes stands before it.
    Records of one line, the rule, are not shuffled again.  ``offset`` is the
    byte at which a record starts.  Empty lines between records are no records.
    """
    lines = pieces(spark, path, "\n")
    quotes = _count("piece", '"')
    size = (F.octet_length("piece") + 1).cast("long")
    lines = with_state(lines, ["path"], quotes=quotes, offset=size)
    starts = F.col("quotes") % 2 == 0
    whole = starts & (quotes % 2 == 0)
    single = lines.filter(whole).select("path", "offset", F.col("piece").alias("record"))
    # other lines: the start of the record is the last line start outside quotes
    rest = with_state(lines, ["path"], start=("max", F.when(starts, F.col("offset")))).filter(~whole)
    several = (rest.groupBy("path", F.col("start").alias("offset"))
               .agg(F.array_sort(F.collect_list(F.struct(F.col("offset").alias("at"), "piece"))).alias("lines"))
               .select("path", "offset", F.array_join(F.transform("lines", lambda x: x["piece"]), "\n").alias("record")))
    record = F.regexp_replace("record", "\\r\\z", "")
    record = F.when(F.col("offset") == 0, F.regexp_replace(record, r"^\uFEFF", "")).otherwise(record)
    return single.union(several).select("path", "offset", record.alias("record")).filter("record <> ''")


CSV_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "nullValue": "\0", "emptyValue": ""}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of quoted CSV files as strings, under the names of their header, with ``ord``.

    Every file starts with the same header.  ``ord`` is the file's path and
    the row's byte offset, so that it sorts in the order of the files and of
    the rows in them.  An empty field is null, a quoted empty one ''.
    """
    records = csv_records(spark, path)
    # one distinct header is looked for: two rows at most come to the driver
    heads = records.filter("offset = 0").select("record").distinct().limit(2).collect()
    if not heads:
        raise ValueError(f"no header in {path}")
    if len(heads) > 1:
        raise ValueError(f"files of {path} have different headers")
    names = spark.range(1).select(F.from_csv(F.lit(heads[0]["record"]), F.lit(
        ", ".join(f"c{k} string" for k in range(heads[0]["record"].count(",") + 1))), CSV_OPTIONS).alias("h")).first()["h"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names if n is not None])
    order = F.concat("path", F.lit("#"), F.lpad(F.col("offset").cast("string"), 20, "0"))
    rows = records.filter("offset > 0").select(
        F.from_csv("record", F.lit(", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)), CSV_OPTIONS).alias("r"),
        order.alias("_ord"))
    return rows.select("r.*", F.col("_ord").alias("ord"))


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV files with headers, as ``read_csv`` reads them: null is empty, '' is quoted."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    fields = [F.coalesce(quoted(f"`{c}`"), F.lit("")) for c in df.columns]
    header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    # each file is written by one task: its first row brings the header along
    first = F.when(F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)) == 0, F.lit(header + "\n")).otherwise("")
    df.select(F.concat(first, F.concat_ws(",", *fields)).alias("value")).write.text(path)


# ---------------------------------------------------------------------------
# one JSON object
# ---------------------------------------------------------------------------

ESCAPED, STRING = r"\\.", '"[^"]*"'


def _depth(bare) -> Column:
    """What a piece without strings adds to the nesting."""
    return _count(bare, r"[{\[]") - _count(bare, r"[}\]]")


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """``offset, entry``: the members ``"key": value`` of one JSON object, in order.

    The object is a file, or a folder of files that hold it one after the
    other.  It is dealt out at commas; the number of quotes before a comma
    tells whether it stands in a string, the brackets outside strings how deep
    it is.  Members begin after commas at depth 1.  Anything but an object has
    no members.
    """
    p = pieces(spark, path, ",")
    first = Window.partitionBy(*RANGE).orderBy("at")
    # no separator stands before the first piece of a file
    p = p.withColumn("sep", F.when((F.col("block") == 0) & (F.row_number().over(first) == 1), "").otherwise(","))
    plain = F.regexp_replace("piece", ESCAPED, "")
    size = F.octet_length("piece") + F.octet_length("sep")
    p = with_state(p.withColumn("plain", plain), [], quotes=_count("plain", '"'), offset=size.cast("long"))
    inside = F.col("quotes") % 2 == 1
    opened = F.when(inside, F.regexp_replace("plain", '^[^"]*(?:"|\\z)', "")).otherwise(F.col("plain"))
    bare = F.regexp_replace(F.regexp_replace(opened, STRING, ""), '"[^"]*\\z', "")
    p = materialize(p.select(*RANGE, "at", "piece", "sep", "offset", inside.alias("inside"), _depth(bare).alias("adds")))
    p = with_state(p, [], depth=F.col("adds"))
    begins = (F.col("offset") == 0) | ((F.col("sep") == ",") & (F.col("depth") == 1) & ~F.col("inside"))
    p = with_state(p.withColumn("begins", begins), [], start=("max", F.when(F.col("begins"), F.col("offset"))))
    text = F.concat(F.when(F.col("begins"), "").otherwise(F.col("sep")), "piece")
    last = F.max(F.col("depth") + F.col("adds") == 0)
    members = (p.groupBy(F.col("start").alias("offset"))
               .agg(F.array_sort(F.collect_list(F.struct(F.col("offset").alias("at"), text.alias("text")))).alias("x"),
                    last.alias("closes"))
               .withColumn("entry", F.array_join(F.transform("x", lambda x: x["text"]), "")))
    entry = F.when(F.col("closes"), F.regexp_replace("entry", r"\}\s*\z", "")).otherwise(F.col("entry"))
    is_object = p.filter("offset = 0").select(F.ltrim(F.regexp_replace("piece", r"^\uFEFF?\s*", "")).startswith("{")
                                              .alias("ok")).filter("ok").limit(1)
    entry = F.when(F.col("offset") == 0, F.regexp_replace(entry, r"^\uFEFF?\s*\{", "")).otherwise(entry)
    out = members.select("offset", entry.alias("entry")).filter("entry rlike '\\\\S'")
    return out.join(F.broadcast(is_object), F.lit(True), "left_semi")


def json_members(entries: DataFrame, value: T.DataType) -> DataFrame:
    """``key, value, offset`` of members; of equal keys the last one stays, as in a parsed object."""
    one = F.from_json(F.concat(F.lit("{"), F.col("entry"), F.lit("}")), T.MapType(T.StringType(), value))
    rows = entries.select(F.explode(one).alias("key", "value"), "offset")
    return (rows.groupBy("key").agg(F.max_by(F.struct("value", "offset"), "offset").alias("x"))
            .select("key", F.col("x.value").alias("value"), F.col("x.offset").alias("offset")))


def write_json_object(df: DataFrame, key: str, value: Column, path: str, single: str | None = None) -> None:
    """One JSON object ``{key: value, ...}`` from unique keys, in their order, written by all tasks.

    Rows are dealt by ranges of the key; every task writes its members as a
    part file, and the parts one after the other are the object, which
    ``json_entries`` reads.  The last file written is ``_manifest.json`` with
    each part's place (the sum of the sizes before it): a folder without it is
    unfinished.  Spark commits part files once, so a task may be repeated; a
    repeated export starts anew.  ``single`` also joins the parts to one file
    for tools that read no folder: a copy through a buffer of 1 MB, which
    takes its name when it is whole.
    """
    spark = df.sparkSession
    least = df.agg(F.min(key)).first()[0]
    # {"k":"..."} without its first five characters and its last is the quoted key
    quoted = F.regexp_replace(F.to_json(F.struct(F.col(key).alias("k"))), r'^\{"k":|\}\z', "")
    mark = F.when(F.col(key) == F.lit(least), "{").otherwise(",")
    parts = df.filter(F.col(key).isNotNull()).repartitionByRange(key).sortWithinPartitions(key)
    parts.select(F.concat(mark, quoted, F.lit(": "), value).alias("value")).write.mode("overwrite").text(path)

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(conf)

    def put(name: str, text: str):
        out = fs.create(hadoop.Path(folder, name), True)
        out.write(bytearray(text.encode()))
        out.close()

    if least is None:
        put("part-0-open.txt", "{")
    put("part-x-close.txt", "}\n")
    names = sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(folder)
                   if f.getPath().getName().startswith("part-") and f.getLen())
    if len(names) > 99_999:
        raise ValueError("more parts than names keep in order")
    places, at = [], 0
    for name, size in names:
        places.append({"part": name, "offset": at, "bytes": size})
        at += size
    put("_manifest.json", json.dumps({"bytes": at, "parts": places}))
    if single:
        target = hadoop.Path(single)
        half = hadoop.Path(target.getParent(), f"_{target.getName()}.{uuid.uuid4().hex}")
        out = fs.create(half, True)
        for name, _ in names:
            part = fs.open(hadoop.Path(folder, name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
        out.close()
        fs.delete(target, False)
        if not fs.rename(half, target):
            raise OSError(f"could not name {single}")
