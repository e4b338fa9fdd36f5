"""Document-level text jobs (SC-01..04, SC-15, FLT-01, FLT-06, SO-06, SRC-03).

All of these are narrow (row-local) transformations over a documents table
``(doc_id, text)`` except page assembly and lemmas by a lexicon table, which
aggregate per document.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as X


def clean_documents(docs: DataFrame) -> DataFrame:
    """SC-01 + SC-15 + FLT-01: cleaned text and its character counts."""
    c = X.select_once(docs, ["doc_id", "text"], clean=X.clean_text("text"))
    return c.select(
        "doc_id",
        F.coalesce(X.char_length("text"), F.lit(0)).cast("bigint").alias("raw_chars"),
        X.char_length("clean").cast("bigint").alias("clean_chars"),
        (F.col("clean") == "").alias("blank"),
        F.md5("clean").alias("clean_md5"),
    )


def sentence_counts(docs: DataFrame) -> DataFrame:
    """SC-02: sentences of the cleaned text (rule-based splitter)."""
    s = X.select_once(docs, ["doc_id"], sents=X.sentences(X.clean_text("text")))
    return s.select(
        "doc_id",
        F.size("sents").cast("bigint").alias("n_sentences"),
        F.md5(F.array_join("sents", "\n")).alias("sentences_md5"),
    )


def word_tokens(docs: DataFrame) -> DataFrame:
    """SC-03 + FLT-06: word tokens with and without stop words."""
    t = X.select_once(docs, ["doc_id"], toks=X.word_tokens(X.clean_text("text")))
    t = X.select_once(t, ["doc_id", "toks"], content=X.content_tokens("toks"))
    return t.select(
        "doc_id",
        F.size("toks").cast("bigint").alias("n_tokens"),
        F.size("content").cast("bigint").alias("n_content"),
        F.md5(F.array_join("toks", " ")).alias("tokens_md5"),
        F.md5(F.array_join("content", " ")).alias("content_md5"),
    )


# ---------------------------------------------------------------------------
# SC-04: lemmatisation (noun rules gated by a lexicon)
# ---------------------------------------------------------------------------

# FIXED VALUES: noun suffix substitutions, tried in this order.
NOUN_RULES = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"),
              ("shes", "sh"), ("men", "man"), ("ies", "y")]
#: Endings of nouns that the bare ``s`` rule leaves alone.
KEEP_S = ("ss", "us", "is")
#: Letters that a rule has to leave.
LEAST_STEM = 2


def lemma(term) -> Column:
    """Noun lemma of a token without a lexicon: the longest suffix rule that applies.

    A function of the token alone, so a document's lemmas do not depend on
    other documents.
    """
    t = X.col(term)
    out = None
    for old, new in sorted(NOUN_RULES, key=lambda r: (-len(r[0]), r[0])):
        hit = t.endswith(old) & (F.char_length(t) >= len(old) + LEAST_STEM)
        if old == "s":
            for k in KEEP_S:
                hit = hit & ~t.endswith(k)
        cut = F.concat(F.substring(t, 1, F.char_length(t) - len(old)), F.lit(new))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    # two tests spare most tokens all the others
    last = {old if not old.endswith("s") else "s" for old, _ in NOUN_RULES}
    return F.when(reduce(or_, [t.endswith(x) for x in sorted(last)]), out.otherwise(t)).otherwise(t)


def lemma_map(vocab: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """Lemma of every distinct token: ``(term, lemma)``.

    Candidates are the token itself and each noun-rule rewrite; only those in
    ``lexicon(term)`` count and the shortest wins (first in rule order on
    ties).  ``exceptions(term, lemma)`` overrides.  Tokens without a
    candidate keep their form.  Runs on the vocabulary, not on every token.
    """
    v = vocab.select("term").distinct()
    cands = F.array(
        F.struct(F.lit(0).alias("r"), F.col("term").alias("c")),
        *[F.struct(F.lit(i + 1).alias("r"),
                   F.when(F.col("term").endswith(old),
                          F.concat(F.expr(f"substring(term, 1, char_length(term) - {len(old)})"), F.lit(new))
                          ).alias("c"))
          for i, (old, new) in enumerate(NOUN_RULES)],
    )
    ex = v.select("term", F.explode(cands).alias("k")).select("term", "k.r", "k.c").filter(F.col("c").isNotNull())
    lex = lexicon.select(F.col("term").alias("c")).distinct()
    hits = ex.join(lex, "c", "left_semi")
    best = hits.groupBy("term").agg(F.min(F.struct(F.char_length("c").alias("n"), "r", "c")).alias("b"))
    out = v.join(best, "term", "left").select("term", F.coalesce("b.c", "term").alias("lemma"))
    if exceptions is not None:
        out = (out.join(exceptions.select("term", F.col("lemma").alias("x")), "term", "left")
               .select("term", F.coalesce("x", "lemma").alias("lemma")))
    return out


def lemmatized(docs: DataFrame, lexicon: DataFrame | None = None, exceptions: DataFrame | None = None,
               id_col: str = "doc_id") -> DataFrame:
    """``(id, lemma_text)``: content tokens of each document as lemmas, joined by a space.

    Without a lexicon a row-local expression.  With ``lexicon(term)``, and
    ``exceptions(term, lemma)``, the distinct tokens are looked up by joins.
    """
    toks = X.select_once(docs, [id_col], t=X.content_tokens(X.word_tokens(X.clean_text("text"))))
    if lexicon is None and exceptions is None:
        return toks.select(id_col, F.array_join(F.transform("t", lemma), " ").alias("lemma_text"))
    ex = toks.select(id_col, F.posexplode("t").alias("pos", "term"))
    vocab = ex.select("term").distinct()
    if lexicon is None:
        lm = (vocab.join(exceptions.select("term", F.col("lemma").alias("x")), "term", "left")
              .select("term", F.coalesce("x", lemma("term")).alias("lemma")))
    else:
        lm = lemma_map(vocab, lexicon, exceptions)
    per = ex.join(lm, "term").groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lemma"))), lambda s: s["lemma"]),
                     " ").alias("lt"))
    return (docs.select(id_col).join(per, id_col, "left")
            .select(id_col, F.coalesce("lt", F.lit("")).alias("lemma_text")))


def lemma_text(docs: DataFrame, lexicon: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """SC-04 + SO-06: lemmatised text per document with a 300-char preview."""
    return lemmatized(docs, lexicon, exceptions).select(
        "doc_id",
        F.char_length("lemma_text").cast("bigint").alias("lemma_chars"),
        F.md5("lemma_text").alias("lemma_md5"),
        X.preview("lemma_text").alias("preview"),
    )


# ---------------------------------------------------------------------------
# SRC-03 / SRC-02: assemble documents from page tables
# ---------------------------------------------------------------------------

def assemble_pages(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page_no",
                   text_col: str = "text") -> DataFrame:
    """Join non-blank pages by newline in page order, strip, and report status.

    ``pages(doc, page, text)`` -> ``(doc_id, n_pages, n_text_pages, text,
    status)``; ``n_pages`` counts every page, blank ones included.
    """
    p = pages.select(F.col(doc_col).alias("doc_id"), F.col(page_col).alias("page_no"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    g = p.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"),
        F.array_sort(F.collect_list(F.when(X.py_strip("t") != "", F.struct("page_no", "t")))).alias("kept"),
    )
    txt = X.py_strip(F.array_join(F.transform("kept", lambda s: s["t"]), "\n"))
    out = g.select("doc_id", "n_pages", F.size("kept").cast("bigint").alias("n_text_pages"), txt.alias("text"))
    status = (F.when(F.col("n_pages") == 0, F.lit(L.STATUS_NO_PAGES))
              .when(F.col("text") == "", F.lit(L.STATUS_NO_TEXT))
              .otherwise(F.concat(F.lit("Successfully extracted text from "), F.col("n_pages").cast("string"),
                                  F.lit(" page(s)."))))
    return out.withColumn("status", status)


def route_by_suffix(files: DataFrame, path_col: str = "path") -> DataFrame:
    """SRC-02: mark files as 'pdf' (case-insensitive ``.pdf`` suffix) or 'text'."""
    return files.withColumn("kind", F.when(F.lower(F.col(path_col)).endswith(".pdf"), F.lit("pdf"))
                            .otherwise(F.lit("text")))
