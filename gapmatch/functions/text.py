"""Column expressions for text handling (SC-01..03, SC-11, SC-15, FLT-06).

All functions take and return ``Column`` objects so they stay inside the JVM
and whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L

# Characters Python's ``str.isspace`` accepts, as a regex class that Java and
# RE2 both read the same way.
WS_CLASS = (
    r"[\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Word-token rule of the word tokenizer (applied to lowercased cleaned text).
WORD_TOKEN_RE = r"\b[a-z0-9+#.-]+\b"
# Sentence boundary of the fallback sentence splitter.
SENTENCE_SPLIT_RE = r"[.!?]+(?:\s+|\n)"
# Token rule of the TF-IDF vectorizer (two or more word characters).
VECTOR_TOKEN_RE = r"\b\w\w+\b"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(x, f) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(col(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def clean_text(c) -> Column:
    """SC-01: ASCII-fold typography, blank out non-printables, squeeze space.

    NULL or empty input gives ''.  Single characters are replaced and runs
    looked for by byte searches, which are far faster than patterns.
    """
    squeeze = lambda s, run, rx, to: F.when(
        F.contains(s, F.lit(run)), F.regexp_replace(s, rx, to)).otherwise(s)
    x = col(c)
    for chars, to in (("‘’", "'"), ("“”", '"'), ("–—", "-"), ("•‣◦", " - ")):
        for ch in chars:
            x = F.replace(x, F.lit(ch), F.lit(to))
    x = F.regexp_replace(x, r"[^\x20-\x7E\n]+", " ")  # a tab too; a run of blanks becomes one anyway
    x = bound(x, lambda s: squeeze(s, "  ", r" {2,}", " "))
    x = bound(x, lambda s: squeeze(s, "\n\n\n", r"\n{3,}", "\n\n"))
    x = F.btrim(x, F.lit(" \n"))
    return F.coalesce(x, F.lit(""))


def sentences(cleaned) -> Column:
    """SC-02 (rule-based splitter) on already-cleaned text -> ARRAY<STRING>."""
    parts = F.split(col(cleaned), SENTENCE_SPLIT_RE, -1)
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" \n"))), lambda s: s != "")


def word_tokens(cleaned) -> Column:
    """SC-03: lowercased word tokens of cleaned text -> ARRAY<STRING>."""
    return F.regexp_extract_all(F.lower(col(cleaned)), F.lit(WORD_TOKEN_RE), 0)


def content_tokens(tokens, stop_words=None) -> Column:
    """FLT-06: drop stop words and one-character tokens."""
    stops = sorted(stop_words or L.STOP_WORDS)
    return F.filter(col(tokens), lambda t: (~t.isin(stops)) & (F.length(t) > 1))


def char_length(c) -> Column:
    """SC-15: number of characters (code points)."""
    return F.char_length(col(c))


def vector_tokens(text, stop_words) -> Column:
    """SC-11 tokens: lowercase, ``\\b\\w\\w+\\b``, drop the vectorizer stop list."""
    stops = sorted(stop_words)
    toks = F.regexp_extract_all(F.lower(col(text)), F.lit(VECTOR_TOKEN_RE), 0)
    return F.filter(toks, lambda t: ~t.isin(stops))


def unigrams_bigrams(tokens) -> Column:
    """SC-11: unigrams followed by bigrams of a token array.

    Pass a column reference (not a computed expression): the array is read
    once per element inside the lambda.
    """
    t = col(tokens)
    bigrams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))),
        lambda i: F.concat_ws(" ", F.element_at(t, i), F.element_at(t, i + 1)),
    )
    return F.when(F.size(t) >= 2, F.concat(t, bigrams)).otherwise(t)


def preview(text, n: int = 300) -> Column:
    """SO-06: first ``n`` characters followed by '...'."""
    return F.concat(F.substring(col(text), 1, n), F.lit("..."))


def select_once(df, keep, **exprs):
    """``df.select(*keep, *exprs)`` with each expression evaluated once.

    Catalyst may inline a projected expression into every later use; for
    costly ones (regex cleaning, tokenising) that repeats the work.  Emitting
    them through a one-element ``inline`` generator makes them plain input
    columns for everything downstream.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))
