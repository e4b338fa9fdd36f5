"""Substring dedup by hashed units with original offsets.

A text is cut into units: lines, and sentences within a line.  Units are
normalised (words with A-Z lower-cased, one space between them) and their
128-bit digests grouped over all documents; the occurrence with the least
document id (a null last, equal ids by a hash of id and text), then the least
offset, is the one that stays.  Runs of
consecutive units that all stand earlier elsewhere are repeated passages; a
run of at least MIN_WORDS words is removed.

A passage may start and end inside a unit.  So of the hashes of all windows of
half as many words the least of each stretch of MIN_WORDS words is a mark: a
passage of MIN_WORDS words has the same marks wherever it stands.  A text is
compared with the documents where its marks stand first, and what agrees word
by word around a mark is removed too if it has MIN_WORDS words.  Spans are
offsets of characters in the original text, so nothing is lost that could not
be put back.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, written
from .words import WordHashes, shingles, split_words

#: Words of a run of repeated units that is removed, at least.
MIN_WORDS = 25
#: The rank of rows without id; documents cut into units at a time.
LAST, SLICE = 2**63 - 1, 500
#: Places in a kept document that one mark is compared at, at most.
PLACES = 8
BLANKS = re.compile(r"[ \t\r\x0b\x0c]*")
#: A unit ends after a line break, or after a sentence's end and the spaces that follow.
UNIT = r"[^\n.!?]*(?:[.!?]+(?![.!?\s])[^\n.!?]*)*(?:[.!?]+[ \t\r\x0b\x0c]*\n?|\n|$)"


def units(text: str | None):
    """(start, end, number of words, digest) of the units of a text that hold a word."""
    text = text or ""
    for m in re.finditer(UNIT, text):
        words = m[0].encode("utf-8", "surrogatepass").lower().split()
        if words:
            yield m.start(), m.end(), len(words), xxhash.xxh3_128_digest(b" ".join(words))


def marks(h: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and hashes of the marks of a text with word hashes ``h``."""
    width = max(1, min_words // 2)
    if len(h) < max(min_words, 1):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    w = shingles(h, width)
    least = np.lib.stride_tricks.sliding_window_view(w, max(min_words, 1) - width + 1).argmin(axis=1)
    at = np.unique(least + np.arange(len(least)))
    return at, w[at]


def agreeing(mine: np.ndarray, kept: np.ndarray, same: bool, min_words: int) -> list[tuple[int, int]]:
    """Word ranges of ``mine`` that agree with ``kept`` around a mark of both, ``min_words`` or longer.

    In the same text a range must agree with one that starts ``min_words``
    or more before it.
    """
    places = {}
    for p, x in zip(*(a.tolist() for a in marks(kept, min_words)), strict=True):
        places.setdefault(x, []).append(p)
    found, done = [], 0
    for a, x in zip(*(a.tolist() for a in marks(mine, min_words)), strict=True):
        if a < done:
            continue
        best = (0, 0)
        for p in places.get(x, ())[:PLACES]:
            if same and a - p < min_words:
                continue
            n = min(len(mine) - a, len(kept) - p)
            off = np.flatnonzero(mine[a:a + n] != kept[p:p + n])
            z = a + (int(off[0]) if len(off) else n)
            n = min(a, p)
            off = np.flatnonzero(mine[a - n:a] != kept[p - n:p])
            b = a - n + (int(off[-1]) + 1 if len(off) else 0)
            best = max(best, (z - b, b))
        if best[0] >= min_words:
            found.append((best[1], best[1] + best[0]))
            done = best[1] + best[0]
    return found


def unit_table(docs: DataFrame, min_words: int = MIN_WORDS, text_col="text", id_col="doc_id") -> DataFrame:
    """``k, th`` (row keys), ``rank`` (the id, a null last) and the arrays of a document's units.

    The arrays are ``starts, ends, words, d1, d2`` (digest) and ``fresh``: the
    unit's first occurrence in its own text.  ``marks`` are the hashes of its
    marks, each once, and ``twice`` whether one stands in it again.
    """
    def cut(batches):
        hashes = WordHashes()
        for b in batches:
            for at in range(0, len(b), SLICE):
                part = b.iloc[at:at + SLICE]
                rows = []
                for text in part["text"]:
                    found = list(units(text))
                    d = np.frombuffer(b"".join(u[3] for u in found), dtype=np.int64).reshape(-1, 2)
                    col = lambda k: np.array([u[k] for u in found], dtype=np.int32)  # noqa: E731, B023
                    fresh = np.zeros(len(found), dtype=bool)
                    fresh[list({u[3]: k for k, u in reversed(list(enumerate(found)))}.values())] = True
                    _, seen = marks(hashes.of(split_words(text, lower=True)), min_words)
                    once = np.unique(seen)
                    rows.append((col(0), col(1), col(2), d[:, 0], d[:, 1], fresh, once.view(np.int64),
                                 len(once) < len(seen)))
                hashes.trim()
                t = pd.DataFrame(rows, columns=["starts", "ends", "words", "d1", "d2", "fresh", "marks", "twice"])
                for c in ("rank", "th", "k"):
                    t.insert(0, c, part[c].to_numpy())
                yield t

    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    d = docs.select(F.xxhash64(id_col, text_col).alias("k"), F.hash(text_col).alias("th"), rank.alias("rank"),
                    F.col(text_col).alias("text"))
    return d.mapInPandas(cut, "k long, th int, rank long, starts array<int>, ends array<int>, words array<int>, "
                              "d1 array<long>, d2 array<long>, fresh array<boolean>, marks array<long>, twice boolean")


def earliest(each: DataFrame, *keys: str) -> DataFrame:
    """Of ``keys`` met more than once, ``first`` (the least rank) and ``first_k``, one row of that rank."""
    # rank, then row key, as one number of fixed width, so that rows are hashed and not sorted
    order = (F.col("rank").cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)")
             + F.col("k").bitwiseAND(F.lit(2**62 - 1)).cast("decimal(19,0)"))
    return (each.groupBy(*keys).agg(F.min("rank").alias("first"), F.min_by("k", order).alias("first_k"),
                                    F.count("*").alias("n")).filter("n > 1").drop("n"))


def merged(found: list[tuple]) -> list[dict]:
    """Spans of ranges (first word, word after, start, end, rank of the document kept), those that touch as one."""
    out = []
    for a, z, start, end, first in sorted(found):
        if out and start <= out[-1][3]:
            out[-1][1], out[-1][3] = max(out[-1][1], z), max(out[-1][3], end)
        else:
            out.append([a, z, start, end, first])
    return [{"start": start, "end": end, "words": z - a, "kept_doc_id": None if first == LAST else int(first)}
            for a, z, start, end, first in out]


def agreeing_spans(docs: DataFrame, u: DataFrame, min_words: int, text_col: str, id_col: str) -> DataFrame:
    """``k, th`` (row keys) and ``more``: ranges of words that agree with an earlier document, with their offsets."""
    each = u.select("k", "th", "rank", F.explode("marks").alias("mark"))
    pairs = (each.join(written(earliest(each, "mark"), "marks"), "mark").filter("k <> first_k")
             .select("k", "th", "first_k", "first"))
    own = u.filter("twice").select("k", "th", F.col("k").alias("first_k"), F.col("rank").alias("first"))
    pairs = written(pairs.union(own).distinct(), "pairs")
    need = pairs.select("k").union(pairs.select("first_k")).distinct()
    texts = docs.select(F.xxhash64(id_col, text_col).alias("k"), F.hash(text_col).alias("th"),
                        F.col(text_col).alias("text"))
    texts = written(texts.join(need, "k", "left_semi").dropDuplicates(["k", "th"]), "texts")

    def compare(batches):
        hashes = WordHashes()
        for b in batches:
            rows = []
            for k, th, first_k, first, kept, text in b.itertuples(index=False):
                both = [hashes.of(split_words(t, lower=True)) for t in (text, kept)]
                found = agreeing(*both, k == first_k, min_words)
                if found:
                    at = [m.span() for m in re.finditer(WORD, text)]
                    rows += [(k, th, {"a": a, "z": z, "start": at[a][0], "end": BLANKS.match(text, at[z - 1][1]).end(),
                                      "first": first}) for a, z in found]
                hashes.trim()
            yield pd.DataFrame(rows, columns=["k", "th", "x"])

    both = (pairs.join(texts.select(F.col("k").alias("first_k"), F.col("text").alias("kept")), "first_k")
            .join(texts, ["k", "th"]).select("k", "th", "first_k", "first", "kept", "text"))
    return (both.mapInPandas(compare, "k long, th int, x struct<a:int,z:int,start:int,end:int,first:long>")
            .groupBy("k", "th").agg(F.collect_set("x").alias("more")))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, text_col="text", id_col="doc_id") -> DataFrame:
    """Spans to remove: ``k, th`` (row keys) and ``spans``, in order.

    A span has ``start``, ``end`` (characters), ``words`` and
    ``kept_doc_id``, the document where its first unit or words stay.
    """
    u = written(unit_table(docs, min_words, text_col, id_col), "units")
    each = u.select("k", "th", "rank", F.posexplode(F.arrays_zip("d1", "d2", "fresh")).alias("pos", "x")).select(
        "k", "th", "rank", "pos", "x.d1", "x.d2", "x.fresh")
    again = (each.join(written(earliest(each, "d1", "d2"), "first"), ["d1", "d2"])
             .filter("k <> first_k or not fresh")
             .groupBy("k", "th").agg(F.collect_set(F.struct("pos", "first")).alias("again")))

    def runs(batches):
        for b in batches:
            rows = []
            for starts, ends, words, hits, more in zip(b["starts"], b["ends"], b["words"], b["again"], b["more"],
                                                       strict=True):
                hits = sorted((x["pos"], x["first"]) for x in (hits if hits is not None else ()))
                found = [(x["a"], x["z"], x["start"], x["end"], x["first"])
                         for x in (more if more is not None else ())]
                before, k = np.append(0, np.cumsum(words)), 0
                while k < len(hits):
                    j = k
                    while j + 1 < len(hits) and hits[j + 1][0] == hits[j][0] + 1:
                        j += 1
                    a, z = hits[k][0], hits[j][0]
                    if before[z + 1] - before[a] >= min_words:
                        found.append((int(before[a]), int(before[z + 1]), int(starts[a]), int(ends[z]), hits[k][1]))
                    k = j + 1
                rows.append(merged(found))
            t = b[["k", "th"]].copy()
            t["spans"] = rows
            yield t[[len(x) > 0 for x in rows]]

    # rows that repeat id and text have the same spans; each part is written, so that its shuffles end with it
    again = written(again, "again")
    more = written(agreeing_spans(docs, u, min_words, text_col, id_col), "more")
    joined = u.select("k", "th", "starts", "ends", "words").join(again.join(more, ["k", "th"], "full"), ["k", "th"])
    return joined.mapInPandas(
        runs, "k long, th int, spans array<struct<start:int,end:int,words:int,kept_doc_id:long>>"
    ).dropDuplicates(["k", "th"])


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, text_col="text", id_col="doc_id") -> DataFrame:
    """Documents without passages that stand earlier elsewhere.

    All columns of ``docs`` with ``spans`` (empty: nothing removed) and
    ``clean_text`` added; columns of these names are replaced.  Every row is
    returned; a null text stays null.  Rows that repeat id and text are one
    document and keep or lose the same spans; rows without id come after all
    others in rank, and of rows with the same id or none one is first.  A unit repeated within its own document is a repeat too.
    No rows in, no rows out.
    """
    d = docs.drop("spans", "clean_text")
    s = written(repeated_spans(d, min_words, text_col, id_col), "spans")
    s = s.withColumnsRenamed({"k": "_k", "th": "_th", "spans": "_spans"})

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, spans, strict=True):
            if t is not None and found is not None and len(found):
                edges = [0, *(x for f in found for x in (f["start"], f["end"])), len(t)]
                t = "".join(t[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2))
            out.append(t)
        return pd.Series(out, dtype=object)

    out = d.withColumns({"_k": F.xxhash64(id_col, text_col), "_th": F.hash(text_col)}).join(s, ["_k", "_th"], "left")
    none = F.array().cast("array<struct<start:int,end:int,words:int,kept_doc_id:bigint>>")
    out = out.withColumn("spans", F.coalesce("_spans", none)).withColumn("clean_text", without(text_col, "_spans"))
    return out.drop("_k", "_th", "_spans")
