"""Quality rules: log-likelihood ratio of hashed n-grams.

Two multinomials over hashed character n-grams, one of the documents that are
trusted and one of the whole raw corpus, give each n-gram the log of its two
smoothed probabilities' ratio.  A document's score is the mean over its
n-grams; it is kept if the score reaches a fixed threshold and the plain
counts (words, repeated windows) do not fail it.  Every document is counted
and judged, always alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written
from .words import WordHashes, statistics

#: Characters (bytes) of an n-gram, buckets they hash to, smoothing, threshold.
WIDTH, BUCKETS, ALPHA, THRESHOLD = 4, 1 << 15, 1.0, -0.4
BASE = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean")


def grams(utf8: bytes, width: int, buckets: int) -> np.ndarray:
    """Buckets of all ``width``-byte windows; a shorter text that is not empty has one."""
    b = np.frombuffer(utf8, dtype=np.uint8)
    if len(b) == 0:
        return np.zeros(0, dtype=np.int64)
    if len(b) < width:
        b = np.pad(b, (0, width - len(b)))
    n = len(b) - width + 1
    x = np.zeros(n, dtype=np.uint32)
    for k in range(width):
        x = (x << np.uint32(8)) | b[k:n + k] if width <= 4 else x * np.uint32(0x01000193) ^ b[k:n + k]
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return ((x >> np.uint32(8)) % np.uint32(buckets)).astype(np.int64)


def log_ratios(docs: DataFrame, trusted: DataFrame, width: int = WIDTH, buckets: int = BUCKETS,
               alpha: float = ALPHA, text_col="text", id_col="doc_id") -> np.ndarray:
    """Log probability ratio of every bucket.

    The corpus counts are those of all documents, the target's those of all
    documents whose id is in ``trusted(doc_id)``.  Texts are exchanged once
    by id, at every size alike; the ids of a partition are hashed, so texts
    are not sorted.  Each task sums
    its documents into one array of ``buckets`` counts, which Spark adds up;
    the result has ``buckets`` numbers whatever the input.  Without trusted
    documents, or without documents, all ratios are 0.
    """
    ids = trusted.select(F.col("doc_id").alias("_id")).filter("_id is not null").distinct()
    ids = ids.select("_id", F.lit(0).cast("long").alias("_deal"), F.lit(True).alias("good"))
    # rows without id match nothing and are dealt out by their text
    deal = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))
    marked = (docs.select(F.col(id_col).alias("_id"), deal.alias("_deal"), F.col(text_col).alias("text"))
              .join(ids.hint("shuffle_hash"), ["_id", "_deal"], "left")
              .select("text", F.coalesce("good", F.lit(False)).alias("good")))

    def count(batches):
        raw, good = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for sums, texts in ((raw, b["text"]), (good, b["text"][b["good"].astype(bool)])):
                for k in range(0, len(texts), 100):
                    some = [grams((t or "").encode("utf-8", "surrogatepass"), width, buckets)
                            for t in texts.iloc[k:k + 100]]
                    sums += np.bincount(np.concatenate(some), minlength=buckets)
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "good": good[at]})

    sums = (marked.mapInPandas(count, "bucket long, raw long, good long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")))
    got = written(sums, "grams").toPandas()  # at most `buckets` rows
    raw, good = np.zeros(buckets), np.zeros(buckets)
    raw[got["bucket"].to_numpy()] = got["raw"].to_numpy()
    good[got["bucket"].to_numpy()] = got["good"].to_numpy()
    if not good.sum():
        return np.zeros(buckets, dtype=np.float32)
    p = lambda c: np.log((c + alpha) / (c.sum() + alpha * buckets))
    return (p(good) - p(raw)).astype(np.float32)


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH,
          buckets: int = BUCKETS, alpha: float = ALPHA, text_col="text", id_col="doc_id") -> DataFrame:
    """Every document with its counts, ``score``, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails; a text without n-grams
    scores 0.  Repeated rows are counted and returned each; a null id is
    never trusted.  Returns ``doc_id`` and the columns named; other columns
    are not read.  No rows in, no rows out.
    """
    ratio = log_ratios(docs, trusted, width, buckets, alpha, text_col, id_col)

    def score(batches):
        hashes = WordHashes()
        for b in batches:
            rows = []
            for text in b:
                n, chars, symbols, dup, repeat, *_, utf8 = statistics(text, hashes)
                g = grams(utf8, width, buckets)
                mean = float(ratio[g].mean(dtype=np.float64)) if len(g) else 0.0
                failed = n < 10 or 100 * repeat > 20 * n
                rows.append((n, chars, symbols, dup, repeat, failed, round(mean, 9),
                             bool(not failed and mean >= threshold)))
            hashes.trim()
            yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                              "base_failed", "score", "kept"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(d, score, f"{BASE}, score double, kept boolean", ["doc_id"])
