"""Line dedup by a log-template tree.

Lines descend a tree of fixed depth: the number of tokens, then the leading
tokens (a token with a digit counts as variable).  At a leaf the tokens that
many texts have at a position are fixed, the others are variable fields, and
what a line keeps of fixed tokens is its template: a leaf has as many as it
needs.  How many texts a fixed token needs grows with the square root of the
leaf's, so that names stay variable in a full leaf.  A line of a template that
few texts have takes the leaf's most frequent one if it agrees with it on
enough positions, else its own text with digits generalised.  Templates that
recur in many documents are boilerplate: their lines are dropped from every
document.

Documents count by text, so exact copies count once.  Near copies would make
all their lines recur; so a document is a witness only if a share of its lines
is its own, lines that do not recur, and at least a share of the documents of
a template must be witnesses.

DataFrame operations only; only digests and candidate lines are shuffled, and
the documents once for the final join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, written

VARIABLE = "<*>"
DEPTH, MIN_TOKENS, MIN_DOCS, AGREE = 3, 4, 10, 0.7
#: Share of a witness's lines that are its own, and of a template's documents that are witnesses.
OWN, DIVERSE = 0.2, 0.5


def tokens(line: Column | str) -> Column:
    """The tokens of a line."""
    return F.filter(F.split(line, WHITE), lambda x: x != "")


def masked(tk: Column | str) -> Column:
    """Tokens with those that have an ASCII digit generalised."""
    return F.transform(tk, lambda x: F.when(x.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(x))


def _once(df: DataFrame, *keep: str, **made: Column) -> DataFrame:
    """``df.select(*keep, **made)`` with every expression evaluated once, however often it is used after."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def _lines(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Lines with the keys of their document and its number of lines that are not blank."""
    # made before the lines are dealt out, so once a document and not once a line
    d = _once(docs, k=F.xxhash64(id_col, text_col), th=F.xxhash64(text_col), lines=F.split(text_col, "\n"))
    d = d.withColumn("n_full", F.size(F.filter("lines", lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")))
    return d.select("k", "th", "n_full", F.posexplode("lines").alias("pos", "line"))


def _leaves(lines: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    t = _once(lines, "k", "th", "n_full", "pos", tk=tokens("line")).filter(F.size("tk") >= min_tokens)
    # only the leading tokens are generalised here, the others at the leaves that count
    return t.withColumn("leaf", F.md5(F.concat_ws(" ", F.size("tk").cast("string"), masked(F.slice("tk", 1, depth)))))


def _templates(cand: DataFrame, min_docs: int, agree: float) -> DataFrame:
    """``cand`` lines with ``tid``, the digest of their template."""
    at = cand.select("leaf", "texts", "th", F.posexplode("tk").alias("p", "tok")).filter(F.col("tok") != VARIABLE).distinct()
    seen = at.groupBy("leaf", "texts", "p", "tok").agg(F.count("*").alias("n"))
    fixed = (seen.filter((F.col("n") >= min_docs) & (F.col("n") * F.col("n") >= F.col("texts")))
             .groupBy("leaf", "p").agg(F.collect_list("tok").alias("toks"))
             .groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("p", "toks"))).alias("fixed")))
    tmpl = F.transform("tk", lambda t, i: F.when(F.array_contains(F.element_at("fixed", i), t), t).otherwise(VARIABLE))
    m = cand.join(written(fixed, "fixed"), "leaf", "left").select("leaf", "k", "th", "pos", "n_full", "tk", tmpl.alias("tmpl"))
    enough = lambda n: n >= F.lit(agree) * F.size("tk")
    whole = enough(F.size(F.filter("tmpl", lambda t: t != VARIABLE)))
    m = m.withColumn("own", F.when(whole, F.xxhash64("leaf", F.array_join("tmpl", " "))))
    m = written(m, "lines")
    # templates that enough texts have, and the leaf's most frequent of them (of equal ones the first by code point)
    often = (m.filter("own is not null").select("leaf", "own", "th", "tmpl").distinct()
             .groupBy("leaf", "own").agg(F.count("*").alias("n"), F.first("tmpl").alias("top"))
             .filter(F.col("n") >= min_docs))
    often = written(often, "templates")
    first = F.min(F.struct((-F.col("n")).alias("less"), F.array_join("top", " ").alias("text"), F.col("own").alias("id"), "top"))
    top = often.groupBy("leaf").agg(first.alias("x")).select("leaf", F.col("x.id").alias("top_id"), F.col("x.top").alias("top"))
    m = (m.join(often.select("own", F.lit(True).alias("recurs")), "own", "left").join(top, "leaf", "left"))
    same = F.size(F.filter(F.zip_with("tk", "top", lambda a, b: (a == b) & (b != VARIABLE)), lambda x: x))
    tid = (F.when(F.col("recurs"), F.col("own")).when(F.col("top").isNotNull() & enough(same), F.col("top_id"))
           .otherwise(F.xxhash64(F.array_join("tk", " "), F.lit(1))))
    return m.select("k", "th", "pos", "n_full", tid.alias("tid"))


def line_templates(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS,
                   agree: float = AGREE, diverse: float = DIVERSE, own: float = OWN,
                   text_col="text", id_col="doc_id") -> DataFrame:
    """Lines of recurring templates: ``k, th`` (document keys) and ``drops``, the line numbers from 0."""
    lv = _leaves(_lines(docs, text_col, id_col), depth, min_tokens)
    # leaves met in enough texts
    often = (lv.select("leaf", "th").distinct().groupBy("leaf").agg(F.count("*").alias("texts"))
             .filter(F.col("texts") >= min_docs))
    cand = written(lv.join(written(often, "often"), "leaf")
                   .select("leaf", "texts", "k", "th", "pos", "n_full", masked("tk").alias("tk")), "candidates")
    m = written(_templates(cand, min_docs, agree), "matched")
    # of each text and template the number of lines, copies of a text counted once
    each = (m.select("tid", "th", "pos", "n_full").distinct().groupBy("tid", "th")
            .agg(F.count("*").alias("lines"), F.first("n_full").alias("n_full")))
    often = each.groupBy("tid").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_docs)
    each = written(each.join(often, "tid"), "recurring")
    witness = (each.groupBy("th").agg(F.sum("lines").alias("lines"), F.first("n_full").alias("n_full"))
               .filter(F.col("n_full") - F.col("lines") >= F.lit(own) * F.col("n_full")).select("th"))
    rec = (each.select("tid", "th", "texts").join(witness, "th").groupBy("tid", "texts").agg(F.count("*").alias("seen"))
           .filter((F.col("seen") >= min_docs) & (F.col("seen") >= F.lit(diverse) * F.col("texts"))).select("tid"))
    return (m.join(written(rec, "boilerplate"), "tid").groupBy("k", "th")
            .agg(F.array_sort(F.collect_set("pos")).alias("drops")))


def drop_template_lines(docs: DataFrame, text_col="text", id_col="doc_id", **params) -> DataFrame:
    """Documents without the lines of recurring templates.

    All columns of ``docs``, with ``n_lines``, ``dropped`` (numbers of dropped
    lines from 0) and ``clean_text`` (the other lines, joined by newline)
    added; columns of these names are replaced.  Every row is returned: a
    document all of whose lines recur keeps an empty text, a null text stays
    null (0 lines), an empty text stays empty.  Repeated rows are treated
    alike, ids may be null or repeat.  No rows in, no rows out.
    """
    d = docs.drop("n_lines", "dropped", "clean_text")
    drops = line_templates(d, text_col=text_col, id_col=id_col, **params)
    d = d.withColumns({"_k": F.xxhash64(id_col, text_col), "_th": F.xxhash64(text_col)})
    drops = drops.select(F.col("k").alias("_k"), F.col("th").alias("_th"), F.col("drops").alias("_drops"))
    out = d.join(drops, ["_k", "_th"], "left")
    lines = F.split(text_col, "\n")
    none = F.array().cast("array<int>")
    left = F.filter(lines, lambda x, i: ~F.array_contains(F.col("_drops"), i))
    return out.select(
        *[F.col(c) for c in d.columns if c not in ("_k", "_th")],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("_drops", none).alias("dropped"),
        F.when(F.col("_drops").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")).alias("clean_text"))
