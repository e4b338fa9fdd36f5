"""SC-02: a sentence splitter trained on the documents themselves, without labels.

A period ends a sentence unless it belongs to an abbreviation, an initial or
an ordinal.  Which words are abbreviations, which words start sentences and
which words go together across a period is read off counts of word pairs over
all documents, by likelihood ratios (Kiss and Strunk, "Unsupervised
multilingual sentence boundary detection", 2006).  Training is a few
aggregates over one table of word pairs; the decisions for the periods in
question are joins with the learned tables; the text is cut inside its row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.reuse import materialize

# FIXED VALUES: thresholds of the paper for abbreviations, collocations and sentence starters.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Likelihood of a period after an abbreviation.
AFTER_ABBREVIATION = 0.99
NUMBER = "##"
#: A token of letters alone has neither marks nor quotes, and no further rule is tried on it.
LETTERS = r"\A[A-Za-z]+\z"


class SentenceModel(NamedTuple):
    """What training learns."""
    abbreviations: DataFrame  # (w, score): words that carry a period without ending a sentence
    starters: DataFrame       # (x, score): words that follow sentence ends more often than by chance
    collocations: DataFrame   # (w, x, score): words that go together across a period


def _core(piece) -> Column:
    """A piece of text without the quotes and brackets around it."""
    return F.regexp_replace(piece, r"""^["'(\[{]+|["')\]}\s]+\z""", "")


def _word(core) -> Column:
    """The word of a token: lower case, no mark behind it, all numbers alike."""
    w = F.lower(F.regexp_replace(core, r"[.,;:!?]+\z", ""))
    return F.when(w.rlike(r"\A[0-9][0-9.,-]*\z"), F.lit(NUMBER)).otherwise(w)


def _mark(core) -> Column:
    """How a token ends: ``!`` surely a sentence, ``.`` a period, ``,`` a period and another mark, or nothing."""
    return (F.when(core.rlike(r"[!?]\z|\.\.\z"), "!").when(F.endswith(core, F.lit(".")), ".")
            .when(core.rlike(r"\.[,;:]+\z"), ",").otherwise(""))


def _tokens(docs: DataFrame, id_col: str) -> DataFrame:
    """``id, pos, w, mark, x, upper``: every token, the word after it and whether that begins in upper case."""
    cores = F.transform(F.regexp_extract_all(X.clean_text("text"), F.lit(r"\S+"), 0),
                        lambda p: F.when(p.rlike(LETTERS), p).otherwise(_core(p)))
    d = X.select_once(docs, [id_col], c=cores)
    token = lambda w, mark, upper: F.struct(w.alias("w"), mark.alias("mark"), upper.alias("upper"))
    t = X.select_once(d, [id_col], t=F.transform("c", lambda c: F.when(
        c.rlike(LETTERS), token(F.lower(c), F.lit(""), c < "a")).otherwise(
        token(_word(c), _mark(c), F.substring(c, 1, 1).rlike("[A-Z]")))))
    nxt = F.slice("t", 2, F.size("t"))
    t = X.select_once(t, [id_col], z=F.arrays_zip(F.col("t").alias("a"), nxt.alias("b")))
    rows = t.select(id_col, F.posexplode("z").alias("pos", "p"))
    return rows.select(id_col, "pos", F.col("p.a.w").alias("w"), F.col("p.a.mark").alias("mark"),
                       F.col("p.b.w").alias("x"), F.col("p.b.upper").alias("upper"))


def _log_likelihood(hits, tries, p) -> Column:
    """Of so many hits in so many tries at likelihood ``p``; nothing where that is certain."""
    at = lambda n, q: F.when((n > 0) & (q > 0), n * F.log(q)).otherwise(0.0)
    return at(hits, p) + at(tries - hits, 1 - p)


def _ratio(a, b, ab, n) -> Column:
    """Dunning's likelihood ratio of b following a: counts of a, of b, of both, of all; 0 where it follows less often."""
    p, p1, p2 = b / n, ab / a, (b - ab) / F.greatest(n - a, F.lit(1))
    r = -2 * (_log_likelihood(ab, a, p) + _log_likelihood(b - ab, n - a, p)
              - _log_likelihood(ab, a, p1) - _log_likelihood(b - ab, n - a, p2))
    return F.when(p1 > p, r).otherwise(0.0)


def train(docs: DataFrame, id_col: str = "doc_id") -> SentenceModel:
    """The model of all ``docs(id, text)``.

    All counts come from one table of word pairs, which is aggregated before
    it is shuffled and written once.
    """
    pairs = materialize(_tokens(docs, id_col).groupBy("w", "mark", "x").agg(F.count("*").alias("n")))
    period = F.col("mark").isin(".", ",")
    words = pairs.groupBy("w").agg(F.sum("n").alias("a"), F.sum(F.when(period, F.col("n")).otherwise(0)).alias("ab"))
    total, periods = words.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("ab"), F.lit(0))).first()
    total, periods = F.lit(float(max(total, 1))), F.lit(float(periods))
    letters = F.char_length(F.replace("w", F.lit(".")))
    dots = F.char_length("w") - letters + 1
    a, ab = F.col("a").cast("double"), F.col("ab").cast("double")
    ll = -2 * (_log_likelihood(ab, a, periods / total) - _log_likelihood(ab, a, F.lit(AFTER_ABBREVIATION)))
    score = ll * F.exp(-letters.cast("double")) * dots * F.pow(letters.cast("double"), ab - a)
    abbreviations = (words.filter(F.col("w").rlike(r"\A[a-z][a-z.&-]*\z") & (F.col("ab") > 0))
                     .select("w", score.alias("score")).filter(F.col("score") >= ABBREVIATION))
    abbreviations = materialize(abbreviations)

    known = abbreviations.select("w", F.lit(True).alias("short"))
    held = F.coalesce("short", F.lit(False)) | (F.col("w") == NUMBER) | F.col("w").rlike(r"\A[a-z]\z")
    marked = pairs.filter("mark <> '' and mark <> ','").join(known, "w", "left").withColumn("held", held)
    ends = marked.filter((F.col("mark") == "!") | ~F.col("held"))
    follows = ends.filter(F.col("x").rlike(r"\A[a-z]+\z")).groupBy("x").agg(F.sum("n").alias("c"))
    n_ends = F.lit(float(ends.agg(F.sum("n")).first()[0] or 1))
    s = follows.join(words.select(F.col("w").alias("x"), "a"), "x")
    d = lambda c: F.col(c).cast("double")
    starters = s.select("x", _ratio(n_ends, d("a"), d("c"), total).alias("score")).filter(F.col("score") >= STARTER)
    starters = materialize(starters)

    before = words.select("w", F.col("ab").alias("wn"))
    two = (marked.filter("mark = '.' and held and x is not null").groupBy("w", "x").agg(F.sum("n").alias("c")).filter("c > 1")
           .join(before, "w").join(words.select(F.col("w").alias("x"), F.col("a").alias("xn")), "x")
           .join(starters.select("x"), "x", "left_anti"))
    collocations = (two.select("w", "x", _ratio(d("wn"), d("xn"), d("c"), total).alias("score"))
                    .filter(F.col("score") >= COLLOCATION))
    return SentenceModel(abbreviations, starters, materialize(collocations))


def held_periods(docs: DataFrame, model: SentenceModel, id_col: str = "doc_id") -> DataFrame:
    """``id, held``: the places of tokens whose period ends no sentence, for documents that have some.

    After an abbreviation or an initial only a word in upper case that starts
    sentences begins a new one, after a number any word in upper case; words
    that go together are never parted.
    """
    t = _tokens(docs, id_col).filter("mark = '.' and x is not null")
    t = t.join(model.abbreviations.select("w", F.lit(True).alias("short")), "w", "left")
    short = F.col("short") | F.col("w").rlike(r"\A[a-z]\z") | (F.col("w") == NUMBER)
    cand = (t.filter(short).join(model.starters.select("x", F.lit(True).alias("starts")), "x", "left")
            .join(model.collocations.select("w", "x", F.lit(True).alias("together")), ["w", "x"], "left"))
    begins = F.col("upper") & ((F.col("w") == NUMBER) | F.col("starts").isNotNull())
    return (cand.filter(F.col("together").isNotNull() | ~begins).groupBy(id_col)
            .agg(F.collect_set("pos").alias("held")))


def split_sentences(docs: DataFrame, model: SentenceModel, id_col: str = "doc_id") -> DataFrame:
    """``id, sentences`` of the cleaned text of every document, with their marks; no text, no sentences."""
    d = docs.select(id_col, "text").join(held_periods(docs, model, id_col), id_col, "left")
    parts = F.regexp_extract_all(X.clean_text("text"), F.lit(r"\S+\s*"), 0)
    d = X.select_once(d, [id_col, "held"], parts=parts)
    none = F.array().cast("array<int>")
    d = X.select_once(d, [id_col, "parts"], held=F.coalesce("held", none))

    def cut(p, i):
        core = _core(p)
        ends = core.rlike(r"[.!?]\z") & (~F.endswith(core, F.lit(".")) | F.endswith(core, F.lit(".."))
                                         | ~F.array_contains("held", i))
        # cleaned text holds no such character; without a mark nothing ends
        return F.when(~p.rlike("[.!?]"), p).when(ends, F.concat(p, F.lit("\x01"))).otherwise(p)

    marked = F.array_join(F.transform("parts", cut), "")
    sentences = F.filter(F.transform(F.split(marked, "\x01"), lambda s: F.btrim(s, F.lit(" \n"))), lambda s: s != "")
    return d.select(id_col, sentences.alias("sentences"))


def trained_sentences(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sentences of every document by the model of all of them: their number and a digest."""
    s = split_sentences(docs, train(docs, id_col), id_col)
    return s.select(id_col, F.size("sentences").cast("bigint").alias("n_sentences"),
                    F.md5(F.array_join("sentences", "\n")).alias("sentences_md5"))
