"""Near-duplicates of word shingles by SetSketch registers.

A document's sketch has M registers.  Register k holds the least of
independent exponential variates of its shingles, on a scale of powers of B
and truncated to 16 bits: registers of a union are the greater of both, and
two registers agree about as often as the sets overlap.  Bands of registers
give candidates; the likelihood of all registers of a pair, given both set
sizes, estimates its similarity jointly and drops those far below; the others
are verified on the full sets of shingles.

Documents with equal sets are one node.  A band's bucket is not expanded into
pairs: its members are first compared with one leader, the member that meets
most others; most buckets are then within one component.  In buckets that
still hold several components, pairs of different components are compared in
blocks of bounded size, and only links that join components are emitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .words import WordHashes, mix64, shingles, split_words

WIDTH = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
BANDS, ROWS = 24, 4
M = BANDS * ROWS
BASE, OFFSET, TOP = 1.001, 3200, 26_200
#: Pairs whose estimate is this far below the threshold are not verified (over five standard deviations).
SLACK = 0.2
#: Rows of a bucket compared with each other in one call.
BLOCK = 256
_A = (np.random.RandomState(1).randint(0, 2**32, M, dtype=np.uint32) | np.uint32(1))[:, None]
_C = np.random.RandomState(2).randint(0, 2**32, M, dtype=np.uint32)[:, None]
SKETCH = "n_shingles long, h1 long, h2 long, registers binary, bands array<long>"


def shingle_set(text: str | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text, words with A-Z lower-cased."""
    return np.unique(shingles(hashes.of(split_words(text, lower=True)), width))


def registers(s: np.ndarray) -> np.ndarray:
    """The M registers of a set that is not empty."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(M, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 4096):
        least = np.minimum(least, ((x[None, k:k + 4096] ^ _C) * _A).min(axis=1))
    e = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)) + OFFSET, 0, TOP).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of registers."""
    per = regs.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + per[:, k])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarities of rows of registers that are jointly most likely, given the set sizes."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        gt, lt = p(u - v * j), p(v - u * j)
        return up * np.log(gt) + down * np.log(lt) + same * np.log(np.maximum(1 - gt - lt, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood has one peak
        x, y = hi - (hi - lo) * 0.618, lo + (hi - lo) * 0.618
        right = likelihood(y) > likelihood(x)
        lo, hi = np.where(right, x, lo), np.where(right, hi, y)
    return (lo + hi) / 2


def sketches(docs: DataFrame, width: int = WIDTH, text_col="text", id_col="doc_id") -> DataFrame:
    """``doc_id, k`` (row key) and the SKETCH columns of every document.

    ``h1`` and ``h2`` are a digest of the set; a set without shingles has
    neither digest, registers nor bands.
    """

    def sketch(batches):
        hashes = WordHashes()
        for b in batches:
            rows = []
            for text in b["text"]:
                s = shingle_set(text, hashes, width)
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                r = registers(s)
                with np.errstate(over="ignore"):
                    h1, h2 = mix64(s).sum(), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum()
                rows.append((len(s), int(h1.view(np.int64)), int(h2.view(np.int64)), r.tobytes(), band_keys(r)))
            hashes.trim()
            t = pd.DataFrame(rows, columns=["n_shingles", "h1", "h2", "registers", "bands"])
            t = t.astype({"h1": "Int64", "h2": "Int64"})
            t.insert(0, "k", b["k"])
            t.insert(0, "doc_id", b["doc_id"])
            yield t

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                    row_key(id_col, text_col).alias("k"))
    # ids as objects, so that a null does not turn them into floats
    return d.mapInArrow(_in_pandas(sketch), f"doc_id long, k long, {SKETCH}")


def _in_pandas(f):
    """A function over pandas batches as one over Arrow batches, with integers kept exact where there are nulls."""
    import pyarrow as pa

    def g(batches):
        for t in f(pd.DataFrame({"doc_id": pd.array(x.column("doc_id").to_pylist(), dtype="Int64"),
                                 "k": x.column("k").to_pandas(), "text": x.column("text").to_pylist()})
                   for x in batches):
            yield pa.RecordBatch.from_pandas(t, preserve_index=False, schema=pa.schema([
                ("doc_id", pa.int64()), ("k", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()),
                ("h2", pa.int64()), ("registers", pa.binary()), ("bands", pa.list_(pa.int64()))]))
    return g


def row_key(id_col="doc_id", text_col="text") -> Column:
    """Key of a row's id and text; rows that repeat both share it."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _pool(docs: DataFrame, reps: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``id, text`` of the documents that share a bucket with others.

    Neither texts nor ids are broadcast here or later: both grow with the
    corpus.  Of repeated rows one is kept; other texts of an id are its own too.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ids = reps.select(F.col("rep").alias("id")).distinct()
    return written(texts.join(ids.hint("merge"), "id").dropDuplicates(["id", "text"]), "pool")


def _verified(pairs: DataFrame, nodes: DataFrame, pool: DataFrame, percent: int, width: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that are links: estimated on the registers, then verified on full sets."""
    side = lambda x: nodes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"),
                                  F.col("registers").alias(f"r_{x}"))

    @F.pandas_udf("double")
    def likely(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        regs = lambda x: np.frombuffer(b"".join(map(bytes, x)), dtype=np.uint16).reshape(-1, M)
        if not len(ra):
            return pd.Series([], dtype="float64")
        return pd.Series(estimate(regs(ra), regs(rb), na.to_numpy(dtype=float), nb.to_numpy(dtype=float)))

    near = (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            .filter(likely("r_a", "r_b", "n_a", "n_b") >= percent / 100 - SLACK).select("a", "b"))
    near = written(near, "near")
    def verify(batches):
        hashes, sets = WordHashes(), {}

        def of(i, text):
            s = sets.get((i, len(text)))
            if s is None or s[0] != text:
                s = sets[i, len(text)] = (text, shingle_set(text, hashes, width))
            return s[1]

        for b in batches:
            ok = []
            for i, j, x, y in zip(b["a"], b["b"], b["ta"], b["tb"], strict=True):
                s, t = of(i, x), of(j, y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(both and 100 * both >= percent * (len(s) + len(t) - both))
                if len(sets) > 500:
                    sets.clear()
            hashes.trim()
            yield b.loc[np.array(ok, dtype=bool), ["a", "b"]]

    pair_texts = (near.hint("merge").join(pool.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
                  .join(pool.select(F.col("id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a"))
    return pair_texts.select("a", "b", "ta", "tb").mapInPandas(verify, "a long, b long").distinct()


def _sets(pool: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id`` and ``shingles`` (sorted 64-bit hashes) of the documents in ``ids(id)``."""
    def cut(batches):
        hashes = WordHashes()
        for b in batches:
            t = b[["id"]].copy()
            t["shingles"] = [shingle_set(x, hashes, width).tobytes() for x in b["text"]]
            hashes.trim()
            yield t

    return pool.join(ids.hint("merge"), "id").mapInPandas(cut, "id long, shingles binary")


def _open_links(buckets: DataFrame, comp: DataFrame, nodes: DataFrame, leaders: DataFrame, pool: DataFrame,
                percent: int, width: int) -> DataFrame:
    """Links between different components that share a bucket and have not met through its leader.

    The members of such buckets are dealt into blocks, and each pair of
    blocks is compared in one task: registers first, then the full sets.  A
    pair is looked at in the first band that it shares, and only as long as
    its components are not joined already, so a cell emits fewer links than
    it has members, however many pairs it holds.
    """
    labelled = (buckets.join(comp, buckets["rep"] == comp["node"], "left")
                .select("key", "band", "rep", "n", F.coalesce("component", "rep").alias("component")))
    labelled = written(labelled, "labelled")
    mixed = (labelled.filter("n > 2").groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
             .filter("x <> y").select("key"))
    m = labelled.join(written(mixed, "mixed"), "key").join(leaders, "key").filter("rep <> leader")
    m = written(m.select("key", "band", "rep", "n", "component"), "open")
    sets = written(_sets(pool, m.select(F.col("rep").alias("id")).distinct(), width), "sets")
    m = m.hint("merge").join(nodes, "rep").join(sets.withColumnRenamed("id", "rep").hint("merge"), "rep")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    m = (m.withColumn("own", F.pmod(F.xxhash64("rep"), blocks))
         .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
         .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("rep", kind="stable")
        regs = np.frombuffer(b"".join(map(bytes, t["registers"])), dtype=np.uint16).reshape(-1, M)
        rep, own, band = t["rep"].to_numpy(), t["own"].to_numpy(), int(t["band"].iloc[0])
        n, i, j = t["n_shingles"].to_numpy(dtype=float), t["i"].iloc[0], t["j"].iloc[0]
        label = t["component"].to_numpy().copy()
        full = [np.frombuffer(x, dtype=np.uint64) for x in t["shingles"]]
        near = [np.zeros((0, 2), dtype=np.int64)]
        for x in range(len(t) - 1):
            y = np.arange(x + 1, len(t))
            ok = (label[y] != label[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))
            if i != j:
                ok &= own[y] != own[x]
            y = y[ok]
            same = regs[y] == regs[x]
            y = y[same.mean(axis=1) >= percent / 100 - SLACK - 0.05]
            if len(y):
                shared = (regs[y] == regs[x]).reshape(-1, BANDS, ROWS).all(axis=2)
                y = y[shared.argmax(axis=1) == band]
                near.append(np.stack([np.full(len(y), x), y], axis=1))
        pairs = np.concatenate(near)
        each = np.concatenate([np.zeros(0)] + [
            estimate(regs[p[:, 0]], regs[p[:, 1]], n[p[:, 0]], n[p[:, 1]])
            for p in (pairs[k:k + 20_000] for k in range(0, len(pairs), 20_000))])
        found = []
        for k in np.argsort(-each, kind="stable")[:int((each >= percent / 100 - SLACK).sum())]:
            x, y = pairs[k]
            if label[x] != label[y]:
                both = len(np.intersect1d(full[x], full[y], assume_unique=True))
                if 100 * both >= percent * (len(full[x]) + len(full[y]) - both):
                    found.append((rep[x], rep[y]))
                    label[label == label[y]] = label[x]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    cells = m.select("key", "i", "j", "own", "band", "rep", "component", "n_shingles", "registers", "shingles")
    return cells.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, text_col="text",
                    id_col="doc_id") -> DataFrame:
    """Groups of documents whose shingle sets overlap by ``percent`` of their union or more.

    Returns one row per row of ``docs``: ``doc_id, k`` (row key), ``n_shingles,
    component_id`` (the least id reachable by links, its own included) and
    ``kept`` (it is that id).  A null or empty text has no shingles and no
    links.  Rows that repeat an id are one document, whatever their texts.  A
    row without id takes the component of equal sets, if one has an id, and
    is kept only otherwise; it links nothing.  Other columns are not read.
    No rows in, no rows out.
    """
    sig = written(sketches(docs, width, text_col, id_col), "sketches")
    nodes = (sig.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2")
             .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
                  F.first("registers").alias("registers"), F.first("bands").alias("bands")))
    nodes = written(nodes, "nodes")
    keyed = nodes.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    buckets = written(keyed.join(shared, "key"), "buckets")
    meets = buckets.groupBy("rep").agg(F.sum("n").alias("meets"))
    leaders = (buckets.join(meets, "rep").groupBy("key")
               .agg(F.max(F.struct("meets", (-F.col("rep")).alias("less"))).alias("top"))
               .select("key", (-F.col("top.less")).alias("leader")))
    leaders = written(leaders, "leaders")
    pairs = (buckets.join(leaders, "key").filter("rep <> leader")
             .select(F.col("rep").alias("b"), F.col("leader").alias("a")).distinct())
    sketch = nodes.select("rep", "n_shingles", "registers")
    pool = _pool(docs, buckets, text_col, id_col)
    first = written(_verified(pairs, sketch, pool, percent, width), "links")
    comp = written(components(first), "components")
    second = written(_open_links(buckets, comp, sketch, leaders, pool, percent, width), "more")
    if not second.isEmpty():
        comp = written(components(first.union(second)), "components")
    of_set = (nodes.join(comp, nodes["rep"] == comp["node"], "left")
              .select("h1", "h2", F.coalesce("component", "rep").alias("component_id")))
    # rows that repeat an id with other texts are one document
    out = sig.select("doc_id", "k", "n_shingles", "h1", "h2").join(written(of_set, "sets"), ["h1", "h2"], "left")
    own = F.coalesce("component_id", "doc_id")
    kept = F.when(F.col("doc_id").isNull(), own.isNull()).otherwise(own == F.col("doc_id"))
    return out.select("doc_id", "k", "n_shingles", own.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, found: DataFrame, text_col="text", id_col="doc_id") -> DataFrame:
    """The documents of ``docs`` that ``found`` keeps, one row of those that repeat id and text."""
    keys = found.filter("kept").select(F.col("k").alias("_k")).distinct()
    d = docs.withColumn("_k", row_key(id_col, text_col))
    return d.join(keys, "_k", "left_semi").dropDuplicates(["_k"]).drop("_k")
