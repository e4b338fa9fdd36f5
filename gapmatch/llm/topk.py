"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are postings: a dimension is a term, with the greatest and the least
value that it has in a block of documents.  A query's bound on a block is the
sum over its terms of what it could gain at most.  Blocks are visited in the
order of that bound and scored through their forward index (the rows of the
block) until the bound falls below the query's k-th score so far.

Spark deals queries and documents out into cells of bounded size, each pair of
a query block and a document range once; a cell returns each query's best k
and a window merges them.  Neither side is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Documents and queries of a cell, about at most; rows of a block; pivots that order a cell's documents.
RANGE, QUERIES, BLOCK, PIVOTS = 65_536, 16_384, 256, 64
#: Cells at least, where there are few vectors.
CELLS = 24
K = 20
_LEAST = np.iinfo(np.int64).min


def whole(vec: Column | str, scale: float = 64.0) -> Column:
    """Components as whole numbers, ``floor(scale * x)``."""
    return F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vec: Column | str) -> Column:
    """Vectors without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    c = F.col(vec) if isinstance(vec, str) else vec
    return c.isNotNull() & ~F.exists(c, bad)


def matrix(vectors, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with 0."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def order_by_pivots(x: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """An order of the rows in which similar ones are near, so that blocks have tight bounds."""
    if len(x) <= BLOCK:
        return np.arange(len(x))
    f = x.astype(np.float32)
    f /= np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-9)
    centre = f[np.linspace(0, len(f) - 1, pivots).astype(int)]
    for _ in range(3):
        near = (f @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, f)
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    s = f @ centre.T
    near = s.argmax(axis=1)
    return np.lexsort((-s[np.arange(len(s)), near], near))


def search(queries: np.ndarray, query_ids: np.ndarray, docs: np.ndarray, doc_ids: np.ndarray, k: int = K,
           block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Best ``k`` rows of ``docs`` for each query, ties to the smaller id, its own id excepted.

    Returns the query's row, the document's id, the score, and how many
    pairs of query and block were scored.
    """
    docs_at = order_by_pivots(docs)
    docs, doc_ids = docs[docs_at], doc_ids[docs_at]
    by_id = np.argsort(np.argsort(doc_ids, kind="stable"), kind="stable")
    starts = np.arange(0, len(docs), block)
    top = np.maximum.reduceat(docs, starts, axis=0)
    low = np.minimum.reduceat(docs, starts, axis=0)
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(docs).max(initial=0)) * max(docs.shape[1], 1)
    # products are exact: in float32 or float64 as far as all sums fit
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    shift = max(1, len(docs))
    if most >= 2**62 // shift:
        raise OverflowError("vector components are too large for 64-bit scores")
    q, d = queries.astype(kind), docs.astype(kind)
    bound = np.maximum(q, 0) @ top.astype(kind).T + np.minimum(q, 0) @ low.astype(kind).T
    bound = bound.astype(np.int64)
    order = np.argsort(-bound, axis=1, kind="stable")
    # score and rank of the id in one number: higher scores first, then smaller ids
    best = np.full((len(q), k), _LEAST, dtype=np.int64)
    scored = 0
    for step in range(len(starts)):
        at = order[:, step]
        kth = best.min(axis=1)
        floor = np.where(kth == _LEAST, _LEAST, kth // shift)
        alive = np.flatnonzero(bound[np.arange(len(q)), at] >= floor)
        if not len(alive):
            break
        alive = alive[np.argsort(at[alive], kind="stable")]
        cuts = np.flatnonzero(np.diff(at[alive])) + 1
        for rows in np.split(alive, cuts):
            b = int(at[rows[0]])
            span = slice(b * block, min((b + 1) * block, len(d)))
            s = (q[rows] @ d[span].T).astype(np.int64) * shift + (shift - 1 - by_id[span])
            s[query_ids[rows][:, None] == doc_ids[span][None, :]] = _LEAST
            both = np.concatenate([best[rows], s], axis=1)
            best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            scored += len(rows)
    row, col = np.nonzero(best != _LEAST)
    got = best[row, col]
    ids = np.empty(len(doc_ids), dtype=np.int64)
    ids[by_id] = doc_ids
    return row, ids[shift - 1 - got % shift], got // shift, scored


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = 64.0, id_col="vec_id",
          vec_col="embedding") -> DataFrame:
    """The ``k`` highest inner products of every query row with all other rows.

    Returns ``query_id, rank`` (from 1)``, vec_id, score``.  Rows without id,
    with a null vector or with a null or non-finite component take no part; a
    vector shorter than another counts as filled up with 0.  Repeated rows
    are candidates each, and a query once; rows with a query's id are its own
    and no candidates.  Fewer than ``k`` candidates give fewer rows, no
    vectors none.
    """
    v = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
         .filter(F.col("vec_id").isNotNull() & usable("vec")).withColumn("vec", whole("vec", scale)))
    v = written(v.withColumn("query", F.coalesce(is_query, F.lit(False))), "vectors")
    n, n_q, width = v.agg(F.count("*"), F.count_if("query"), F.max(F.size("vec"))).first()
    n_ranges = max(1, -(-n // RANGE))
    n_blocks = max(1, -(-n_q // QUERIES), min(-(-CELLS // n_ranges), n_q))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    docs = v.select("vec_id", "vec", dealt(n_ranges).alias("r"), spread(n_blocks).alias("b"))
    asks = (v.filter("query").select("vec_id", "vec").distinct()
            .select("vec_id", "vec", dealt(n_blocks).alias("b"), spread(n_ranges).alias("r")))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        ids = left["vec_id"].to_numpy()
        row, found, score, _ = search(matrix(left["vec"], width), ids, matrix(right["vec"], width),
                                      right["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": ids[row], "vec_id": found, "score": score})

    found = (asks.groupBy("b", "r").cogroup(docs.groupBy("b", "r"))
             .applyInPandas(cell, "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
