"""Mixing sources to target weights by entropy balancing.

Documents get rates ``r = min(cap, exp(lambda_s * size / mean_s))``: of all
rates from 0 to ``cap`` that give each source its target number of words,
these have the least relative entropy to taking every document once.  The
convex dual has one variable per source; its Newton steps are sums over the
histogram of sizes, computed by Spark.  Rates are then rounded to whole
copies along the cumulated rates in order of size, so that a source's taken
words miss its target by less than its smallest documents.

DataFrame operations only.  All sums are exact decimals, so that reruns agree
whatever the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

SUM, WHOLE = "decimal(38,9)", "decimal(19,0)"
#: Newton steps planned in one job, and the most jobs.
STEPS, JOBS = 4, 20
TOLERANCE = 1e-7
#: Rows of one source and size that are ranked together, at most about.
RANKED = 1_000_000


def _key(source: Column | str) -> Column:
    """A source as a join key that is never null."""
    c = F.col(source) if isinstance(source, str) else source
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c.cast("string")))


def targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target words of each source.

    ``sources(skey, source, source_size)``, one row each.  Weights repeat over
    the sources in code point order, null last; together the sources get
    ``share`` of all words.  A source's target stops at ``cap`` times its size
    and what it leaves is shared again by weight until none is above: the
    sources that stop are the first in the order of ``cap * size / weight``.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = (s.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
         .withColumn("left_words", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
         .withColumn("left_weight", F.sum("weight").over(after)))
    stops = F.col("most") * F.col("left_weight") <= F.col("weight") * F.col("left_words")
    s = s.withColumn("stops", stops)
    # the first source that does not stop has what is left for all after it
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("most") / F.col("weight"),
                                                    (F.col("left_words") / F.col("left_weight")).alias("level")))
                  ).over(every)["level"]
    return s.select("skey", "source", "source_size",
                    F.when(F.col("stops"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def _rate(cap: float) -> Column:
    """The tilted rate of a size under its source's lambda."""
    tilt = F.col("lam") * F.col("size") / F.col("mean")
    free = F.exp(F.least(tilt, F.log(F.lit(cap))))
    return (F.when(F.col("source_size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(cap)))
            .otherwise(F.least(F.lit(float(cap)), free)))


def _newton(state: DataFrame, bins: DataFrame, cap: float) -> DataFrame:
    """One bracketed Newton step of every source's lambda."""
    b = bins.join(state, "skey").withColumn("r", _rate(cap))
    x = F.col("size") / F.col("mean")
    words = F.col("n") * F.col("size") * F.col("r")
    got = b.groupBy("skey").agg(
        *[F.first(c).alias(c) for c in state.columns if c != "skey"],
        F.sum(words.cast(SUM)).cast("double").alias("got"),
        F.sum(F.when(F.col("r") < cap, words * x).otherwise(0.0).cast(SUM)).cast("double").alias("slope"))
    gap = F.col("got") - F.col("target")
    done = F.col("full") | (F.abs(gap) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0)))
    lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
    hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
    got = got.withColumns({"gap": gap, "done": done, "lo": lo, "hi": hi})
    step = F.col("lam") - F.col("gap") / F.col("slope")
    inside = (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
    lam = F.when(F.col("done"), F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)
    return got.withColumn("lam", lam).select(*state.columns)


def _whole(rated: DataFrame, cap: int) -> DataFrame:
    """Whole copies ``k`` of each source and size from the rates.

    First the cumulated rates along the sizes are rounded.  What a source's
    words then miss of its target is mended from the largest size down, each
    size giving or taking as many copies as fit into the rest.  The array of
    a source's sizes is bounded by the longest document, not by the rows.
    """
    along = Window.partitionBy("skey").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    half = F.lit("0.5").cast("decimal(2,1)")
    end = F.floor(F.sum((F.col("n") * F.col("rate")).cast(SUM)).over(along) + half).cast("long")
    k = rated.withColumn("end", end)
    k = k.withColumn("k", F.least(F.col("n") * cap, F.col("end") - F.coalesce(
        F.lag("end").over(Window.partitionBy("skey").orderBy("size")), F.lit(0))))
    sizes = k.filter("size > 0").groupBy("skey").agg(
        F.round(F.first("target") - F.sum(F.col("k") * F.col("size"))).cast("long").alias("miss"),
        F.reverse(F.array_sort(F.collect_list(F.struct("size", "k", "n")))).alias("sizes"))

    def mend(acc, x):
        d = F.greatest(-x["k"], F.least(x["n"] * cap - x["k"], (acc["miss"] / x["size"]).cast("long")))
        one = F.array(F.struct(x["size"].alias("size"), d.alias("d")))
        return F.when(d == 0, acc).otherwise(F.struct((acc["miss"] - d * x["size"]).alias("miss"),
                                                      F.concat(acc["more"], one).alias("more")))

    none = F.array().cast("array<struct<size:bigint,d:bigint>>")
    mended = sizes.select("skey", F.explode(F.aggregate(
        "sizes", F.struct(F.col("miss").alias("miss"), none.alias("more")), mend, lambda a: a["more"])).alias("m"))
    mended = mended.select("skey", "m.size", "m.d")
    return (k.join(mended, ["skey", "size"], "left")
            .select("skey", "size", "source_size", "target", "rate", F.col("n").alias("n_bin"),
                    (F.col("k") + F.coalesce("d", F.lit(0))).alias("k")))


def units(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One row per distinct (id, source, size), with its number of rows."""
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                        n_words(text_col).alias("size"))
            .withColumn("skey", _key("source")).groupBy("doc_id", "skey", "size")
            .agg(F.first("source").alias("source"), F.count("*").alias("n_rows")))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2,
        id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """How many copies of each document the mix takes.

    Returns one row per distinct (doc_id, source, size): ``doc_id, source, skey,
    size, n_rows`` (rows of the input it stands for, each taken ``copies``
    times), ``source_size, target, rate, copies, taken`` (``copies * size``).

    A null text has size 0 and a null source is a source of its own.  A
    document without words is taken as its rate says (it adds no words); a
    source without words has target 0 and each of its documents is taken once.
    Repeated rows share one decision.  No rows in, no rows out.  Columns of
    other names are not read.
    """
    spark = docs.sparkSession
    u = written(units(docs, id_col, text_col, source_col), "units")
    n_salts = max(8, -(-u.count() // RANKED))
    u = u.withColumn("salt", F.pmod(F.xxhash64("doc_id", "skey"), F.lit(n_salts)).cast("int"))
    cells = written(u.groupBy("skey", "size", "salt").agg(F.first("source").alias("source"),
                                                          F.sum("n_rows").alias("n")), "cells")
    bins = written(cells.groupBy("skey", "size").agg(F.first("source").alias("source"),
                                                     F.sum("n").alias("n")), "bins")
    src = bins.groupBy("skey").agg(
        F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.sum("n").alias("n_docs"),
        F.sum((F.col("n") * F.col("size") * F.col("size")).cast(SUM)).cast("double").alias("squares"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    goal = targets(src.select("skey", "source", "source_size"), weights, share, cap)
    small = F.col("least") / F.col("mean")
    state = (goal.join(src.select("skey", "n_docs", "least", "squares"), "skey")
             .withColumn("mean", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)))
             .withColumn("full", F.col("target") >= cap * F.col("source_size"))
             # a first guess: the rate that is wanted, at the size of the mean word's document
             .withColumn("lam", F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.log(
                 F.col("target") / F.col("source_size")) / (F.col("squares") / F.col("source_size") / F.col("mean")))
                 .otherwise(F.lit(0.0)))
             .withColumn("done", F.lit(False))
             # rates at lo give too few words, at hi every document its cap
             .withColumn("lo", F.least(F.lit(0.0), F.coalesce(
                 F.log(F.col("target") / F.col("source_size")) / small, F.lit(0.0))) - 1e-6)
             .withColumn("hi", F.coalesce(F.log(F.lit(float(cap))) / small, F.lit(0.0)) + 1e-6)
             .select("skey", "source_size", "target", "mean", "full", "lam", "lo", "hi", "done"))
    state = written(state, "state")
    for _ in range(JOBS):
        state = written(reduce(lambda s, _: _newton(s, bins, cap), range(STEPS), state), "state")
        if state.filter(~F.col("done")).isEmpty():
            break
    rated = bins.join(state, "skey").withColumn("rate", F.round(_rate(cap), 9).cast("decimal(11,9)"))
    k = _whole(rated, cap)
    c = cells.select("skey", "size", "salt", "n").join(k, ["skey", "size"])
    # the copies of a size in proportion over its salts
    in_bin = Window.partitionBy("skey", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    part = lambda n: F.floor((F.col("k").cast(WHOLE) * n) / F.col("n_bin")).cast("long")
    c = c.withColumn("to", F.sum("n").over(in_bin))
    c = c.withColumn("kc", part(F.col("to").cast(WHOLE)) - part((F.col("to") - F.col("n")).cast(WHOLE)))
    c = c.select("skey", "size", "salt", "source_size", "target", F.col("rate").cast("double").alias("rate"),
                 F.expr("kc div n").alias("base"), F.pmod("kc", "n").alias("more"))
    c = written(c, "copies")
    rank = (Window.partitionBy("skey", "size", "salt")
            .orderBy(F.xxhash64("doc_id", F.lit(7)), F.col("doc_id").asc_nulls_last())
            .rowsBetween(Window.unboundedPreceding, 0))
    ranked = u.withColumn("place", F.sum("n_rows").over(rank))
    out = ranked.join(c, ["skey", "size", "salt"])
    copies = F.col("base") + (F.col("place") <= F.col("more")).cast("long")
    return (out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
            .select("doc_id", "source", "skey", "size", "n_rows", "source_size", "target", "rate", "copies", "taken"))


def per_document(mixed: DataFrame) -> DataFrame:
    """The mix with one row for each row of the input."""
    return (mixed.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
            .drop("_row", "n_rows", "skey"))


def take(docs: DataFrame, mixed: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    same = lambda a: F.coalesce(F.concat(F.lit("d"), F.col(a).cast("string")), F.lit("n"))
    d = docs.withColumns({"_id": same(id_col), "_skey": _key(source_col), "_size": n_words(text_col)})
    m = mixed.filter("copies > 0").select(same("doc_id").alias("_id"), F.col("skey").alias("_skey"),
                                          F.col("size").alias("_size"), F.col("copies").alias("_copies"))
    out = d.join(m, ["_id", "_skey", "_size"])
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select(*docs.columns)
