"""SC-04: a lexicon of base forms induced from the documents, for the gated noun rules.

A noun rule (``ies`` to ``y``) relates a word to a base if both are words of
the corpus.  The rules by which other words lead to a base are its paradigm;
a paradigm that many bases share is a pattern of the language, one that few
show is chance.  Bases of supported paradigms are the lexicon.  Where several
rules lead a word to bases of the lexicon the most frequent base is right, and
if that is not the one ``lemma_map`` would take the word is an exception.

Everything happens on the vocabulary with counts; documents get back only the
words of theirs that change.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.reuse import materialize, stored
from .documents import LEAST_STEM, NOUN_RULES, lemma_map

#: Bases that a paradigm needs.
SUPPORT = 5


class Lexicon(NamedTuple):
    """What is induced."""
    words: DataFrame       # (term, paradigm): base forms
    exceptions: DataFrame  # (term, lemma)
    vocabulary: DataFrame  # (term, n): all content words with their counts


def _terms(docs: DataFrame, id_col: str) -> DataFrame:
    return X.select_once(docs, [id_col], t=X.content_tokens(X.word_tokens(X.clean_text("text"))))


def induce_lexicon(docs: DataFrame, id_col: str = "doc_id", support: int = SUPPORT) -> Lexicon:
    """The lexicon and exceptions of all ``docs(id, text)``."""
    return _induce(_terms(docs, id_col), support)


def _induce(terms: DataFrame, support: int = SUPPORT) -> Lexicon:
    vocab = materialize(terms.select(F.explode("t").alias("term")).groupBy("term")
                        .agg(F.count("*").alias("n")))
    alpha = vocab.filter(F.col("term").rlike(r"\A[a-z]+\z"))
    rewrites = F.filter(F.array(*[
        F.when(F.col("term").endswith(old) & (F.char_length("term") >= len(old) + LEAST_STEM),
               F.struct(F.lit(old).alias("rule"),
                        F.concat(F.expr(f"substring(term, 1, char_length(term) - {len(old)})"), F.lit(new)).alias("base")))
        for old, new in NOUN_RULES]), lambda r: r.isNotNull())
    led = alpha.select("term", F.explode(rewrites).alias("r")).select("term", "r.rule", "r.base")
    led = materialize(led.join(alpha.select(F.col("term").alias("base"), F.col("n").alias("base_n")), "base"))
    paradigms = led.groupBy("base").agg(F.array_join(F.array_sort(F.collect_set("rule")), "+").alias("paradigm"))
    common = paradigms.groupBy("paradigm").count().filter(F.col("count") >= support).select("paradigm")
    words = materialize(paradigms.join(common, "paradigm").select(F.col("base").alias("term"), "paradigm"))
    # of several bases in the lexicon the most frequent one
    known = led.join(words.select(F.col("term").alias("base")), "base", "left_semi")
    best = (known.groupBy("term").agg(
        F.min(F.struct((-F.col("base_n")).alias("less"), "base")).alias("top"),
        F.min(F.struct(F.char_length("base").alias("size"), "base")).alias("short"),
        F.count_distinct("base").alias("bases"))
        .filter((F.col("bases") > 1) & (F.col("top.base") != F.col("short.base"))))
    return Lexicon(words, best.select("term", F.col("top.base").alias("lemma")), vocab)


def induced_lemmas(docs: DataFrame, lexicon: Lexicon | None = None, id_col: str = "doc_id") -> DataFrame:
    """``id, lemma_text``: content words of every document as lemmas by an induced lexicon, joined by a space."""
    # the words are needed up to three times: written once, not cut from the texts again
    t = stored(_terms(docs, id_col))
    lex = lexicon or _induce(t)
    lemmas = lemma_map(lex.vocabulary, lex.words.select("term"), lex.exceptions)
    changes = materialize(lemmas.filter("lemma <> term"))
    own = (X.select_once(t, [id_col], d=F.array_distinct("t")).select(id_col, F.explode("d").alias("term")).join(changes, "term")
           .groupBy(id_col).agg(F.map_from_entries(F.collect_set(F.struct("term", "lemma"))).alias("changed")))
    out = t.join(own, id_col, "left")
    text = F.array_join(F.transform("t", lambda x: F.coalesce(F.element_at("changed", x), x)), " ")
    return out.select(id_col, text.alias("lemma_text"))


def induced_lemma_text(docs: DataFrame) -> DataFrame:
    """SC-04 + SO-06 through the induced lexicon: size, digest and preview of each document's lemmas."""
    return induced_lemmas(docs).select(
        "doc_id", F.char_length("lemma_text").cast("bigint").alias("lemma_chars"), F.md5("lemma_text").alias("lemma_md5"),
        X.preview("lemma_text").alias("preview"))
