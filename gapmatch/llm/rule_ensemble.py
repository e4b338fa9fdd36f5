"""Quality classifier: a sparse ensemble of conjunctive rules.

Boosted shallow trees over statistics of a text give paths from the root;
each path is a rule, a conjunction of thresholds.  A logistic model with lasso
penalty weighs the rules, most weights are zero, and the others are compiled
into one Spark column expression over the statistics.  The trees and weights
are fitted in numpy on a bounded sample of labelled rows; statistics and
scores are computed by Spark for every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import WordHashes, statistics

#: Labelled rows the model is fitted on, at most.
SAMPLE = 12_000
TREES, DEPTH, BINS, RATE, LEAF = 30, 3, 32, 0.3, 20
PENALTY, ROUNDS = 1e-3, 400
KEEP = 0.3

FEATURES = ("words", "mean_word", "symbols", "upper", "digits", "bangs", "stops", "other_ascii", "beyond_ascii",
            "distinct", "dup_lines", "repeats", "line_words")
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_OTHER = bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in "#*$%&|<>!.,")
_HIGH = bytes(range(128, 256))


def text_statistics(text: str | None, hashes: WordHashes) -> tuple:
    """FEATURES of one text; shares are of its bytes, words or lines (0 for an empty text)."""
    n, chars, symbols, dup, repeat, _, lines, distinct, b = statistics(text, hashes)
    size, per = max(chars, 1), max(n, 1)
    share = lambda x: (len(b) - len(b.translate(None, x))) / size
    return (float(n), chars / per, symbols / size, share(_UPPER), share(_DIGIT), share(b"!"), share(b".,"),
            share(_OTHER), share(_HIGH), distinct / per, dup / max(lines, 1), repeat / per, n / max(lines, 1))


def with_statistics(docs: DataFrame, text_col="text", name="_stats") -> DataFrame:
    """``docs`` with a struct column of FEATURES."""

    @F.pandas_udf(", ".join(f"{f} double" for f in FEATURES))
    def stats(texts: pd.Series) -> pd.DataFrame:
        hashes = WordHashes()
        return pd.DataFrame([text_statistics(t, hashes) for t in texts], columns=list(FEATURES))

    return docs.withColumn(name, stats(F.col(text_col)))


@dataclass(frozen=True)
class Rules:
    """``sigmoid(bias + sum of weights of the rules that hold)``.

    A rule is a tuple of (feature number, greater, threshold): the feature is
    greater than the threshold, or not.
    """

    bias: float
    rules: tuple = ()
    weights: tuple = ()

    def column(self, stats: str) -> Column:
        def holds(rule) -> Column:
            each = [F.col(f"{stats}.{FEATURES[f]}") > F.lit(t) if up else F.col(f"{stats}.{FEATURES[f]}") <= F.lit(t)
                    for f, up, t in rule]
            return reduce(lambda a, b: a & b, each)

        terms = [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights,
                                                                                  strict=True)]
        logit = reduce(lambda a, b: a + b, terms, F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _grow(codes: np.ndarray, cuts: list, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple,
          depth: int, paths: list, out: np.ndarray) -> None:
    """Split ``rows`` where the second-order gain is largest; record every path, set leaf values."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * LEAF:
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            c = codes[rows, f]
            n = np.cumsum(np.bincount(c, minlength=len(cut) + 1))[:-1]
            gl = np.cumsum(np.bincount(c, weights=grad[rows], minlength=len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(c, weights=hess[rows], minlength=len(cut) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < LEAF) | (len(rows) - n < LEAF)] = -1
            if gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
    if best[1] is None:
        out[rows] = g / (h + 1)
        return
    _, f, k = best
    left = codes[rows, f] <= k
    for up, some in ((False, rows[left]), (True, rows[~left])):
        longer = (*path, (f, up, float(cuts[f][k])))
        paths.append(longer)
        _grow(codes, cuts, grad, hess, some, longer, depth - 1, paths, out)


def _simpler(rule: tuple) -> tuple:
    """A rule with one threshold for each feature and direction, in order."""
    low, high = {}, {}
    for f, up, t in rule:
        if up:
            low[f] = max(t, low.get(f, t))
        else:
            high[f] = min(t, high.get(f, t))
    return tuple(sorted([(f, True, t) for f, t in low.items()] + [(f, False, t) for f, t in high.items()]))


def _holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > t) == up for f, up, t in rule])


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Rules:
    """Rules for labels ``y`` (0 or 1) over the statistics ``x``.

    Without both labels the ensemble is empty and its score the share of
    label 1 (a half without rows).
    """
    base = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(base / (1 - base)))
    if len(set(y.tolist())) < 2:
        return Rules(bias)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    logit, paths = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        out = np.zeros(len(y))
        _grow(codes, cuts, y - p, p * (1 - p), np.arange(len(y)), (), depth, paths, out)
        logit += RATE * out
    rules, seen = [], set()
    for r in dict.fromkeys(map(_simpler, paths)):
        on = _holds(r, x)
        key = on.tobytes()
        if 0 < on.sum() < len(y) and key not in seen:
            seen.add(key)
            rules.append((r, on))
    if not rules:
        return Rules(bias)
    a = np.stack([on for _, on in rules], axis=1).astype(np.float32)
    # accelerated proximal gradient on the mean logistic loss with lasso penalty
    step = 4 * len(y) / float(np.linalg.norm(a.astype(np.float64).T @ a, 2) + len(y))
    w, b = np.zeros(a.shape[1]), bias
    v, c, t = w, b, 1.0
    for _ in range(ROUNDS):
        r = 1 / (1 + np.exp(-(a @ v.astype(np.float32) + c))) - y
        u = v - step * (a.T @ r.astype(np.float32)) / len(y)
        new, d = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0), c - step * r.mean()
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / s * (new - w), d + (t - 1) / s * (d - b)
        w, b, t = new, d, s
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return Rules(round(float(b), 6), tuple(rules[k][0] for k in kept), tuple(round(float(w[k]), 6) for k in kept))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32(id as text) mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col="text", id_col="doc_id") -> Rules:
    """Fit on at most ``sample`` labelled rows that are not held out, in the order of a hash of the id.

    ``labels(doc_id, quality)``; rows with a null take no part, an id labelled
    twice counts twice.
    """
    some = (labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
            .filter("_id is not null and _y is not null").filter(~held_out("_id"))
            .orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample))
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(some), "_id"))  # at most `sample` rows of two numbers
    got = with_statistics(rows, "_text").select("_id", "_y", "_stats.*").toPandas()
    got = got.sort_values(list(got.columns), kind="stable")
    return fit_rules(got[list(FEATURES)].to_numpy(), (got["_y"].to_numpy() > 0).astype(np.float64))


def score(docs: DataFrame, rules: Rules, threshold: float = KEEP, text_col="text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    Columns of these names are replaced.  A null text is scored as an empty
    one; every row is returned.
    """
    d = with_statistics(docs.drop("score", "predicted", "_stats"), text_col)
    d = d.withColumn("score", rules.column("_stats")).drop("_stats")
    return d.withColumn("predicted", F.when(F.col("score") >= threshold, F.lit(1)).otherwise(F.lit(0)))
