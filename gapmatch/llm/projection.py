"""Near-duplicates of vectors by sorted projection passes.

Every pass gives each vector 64 random hash bits (sides of random planes) and
sorts the vectors of a label lexicographically by them: vectors at a small
angle share long prefixes and stand near each other.  A vector is compared
with all that stand within a window before and after it, and verified pairs
of all passes are united into components.  The number of passes follows from
the largest label, so that a pair at the threshold is met with the same
likelihood at every size.

Within a component every link counts, also between vectors that no window
brought together.  Components are small as a rule and compared whole.  In a
large one, vectors within half the threshold's angle of the component's centre
are all linked with each other, by the triangle inequality, and only counted;
the others are compared with every member, in blocks.  Neither links nor
pairs of a component are written out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import placed, written
from .components import components
from .topk import usable

COSINE = 0.93
#: Neighbours on each side that a vector is compared with at least, and sorted vectors of one comparing call.
WINDOW, CELL = 256, 2048
#: Likelihood that no pass brings a pair at the threshold into one window.
MISS = 0.01
#: Members of a component that are compared whole, of a block of a larger one, and of several components in one call.
WHOLE, BIN = 512, 4096
#: Members whose mean is a large component's centre, on average.
CENTRE = 64
#: Radians kept clear of the threshold where angles are added.
CLEAR = 1e-6


def n_passes(largest: int, window: int = WINDOW, cosine: float = COSINE, miss: float = MISS) -> int:
    """Passes for a label of ``largest`` vectors: bits to agree on until a window holds the rest, repeated."""
    alike = 1 - math.acos(cosine) / math.pi
    met = alike ** max(0.0, math.log2(max(largest, 1) / window))
    return 1 if met >= 1 else math.ceil(math.log(miss) / math.log1p(-met))


def unit(table: pa.Table | pa.RecordBatch, column: str = "vec") -> np.ndarray:
    """The vectors of a column, all of one length, as rows of length 1 in double precision."""
    v = table.column(column)
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planes(a_pass: int, width: int, seed: int = 13) -> np.ndarray:
    """Normals of a pass's 64 random planes."""
    return np.random.RandomState([seed, a_pass, width]).standard_normal((width, 64))


def keys(x: np.ndarray, passes: int) -> np.ndarray:
    """For every row and pass the 64 hash bits as one number; numbers are in the bits' order."""
    out = np.empty((len(x), passes), dtype=np.int64)
    for p in range(passes):
        bits = x @ planes(p, x.shape[1]) > 0
        out[:, p] = np.packbits(bits, axis=1).view(">i8")[:, 0]
    return out


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' components under the links i, j."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _nodes(rows: DataFrame) -> DataFrame:
    """``h1, h2, label, width, vec, rep, copies``: distinct vectors of a label, their least id, how many ids hold them."""
    copies = (rows.select("h1", "h2", "vec_id").distinct().groupBy("h1", "h2")
              .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    vec = rows.groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("vec").alias("vec"))
    return vec.join(copies, ["h1", "h2"]).withColumn("width", F.size("vec"))


def _keyed(nodes: DataFrame, passes: int) -> DataFrame:
    """``nodes`` with ``keys``, their hash bits in every pass."""
    def hashed(batches):
        for b in batches:
            out = np.empty((b.num_rows, passes), dtype=np.int64)
            width = b.column("width").to_numpy()
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                out[at] = keys(unit(b.take(pa.array(at))), passes)
            yield b.append_column("keys", pa.ListArray.from_arrays(
                pa.array(np.arange(0, out.size + 1, passes, dtype=np.int32)), pa.array(out.ravel())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return nodes.mapInArrow(hashed, schema + ", keys array<long>")


def _window_links(nodes: DataFrame, cosine: float, window: int, cell: int) -> DataFrame:
    """``a, b``: verified links that join what stands together in the windows of any pass."""
    each = nodes.select("h1", "h2", "rep", "label", "width", F.posexplode("keys").alias("pass", "key"))
    at = placed(each, ["pass", "label", "width"], ["key", "rep", "h1"], "passes")
    own = F.floor(F.col("pos") / cell).cast("long")
    cells = F.when((own > 0) & (F.col("pos") % cell < window), F.array(own, own - 1)).otherwise(F.array(own))
    at = at.select("h1", "h2", "pass", "pos", F.explode(cells).alias("cell"))
    dealt = at.join(nodes.select("h1", "h2", "rep", "label", "width", "vec"), ["h1", "h2"])

    def compare(t):
        t = t.take(pa.array(np.argsort(t.column("pos").to_numpy(), kind="stable")))
        x, rep, found = unit(t), t.column("rep").to_numpy(), [np.zeros((2, 0), dtype=np.int64)]
        for k in range(0, len(x), window):
            i, j = np.nonzero(x[k:k + window] @ x[k:k + 2 * window].T >= cosine)
            found.append(np.stack([i[i < j], j[i < j]]) + k)
        i, j = np.concatenate(found, axis=1)
        root = roots(len(x), i, j)
        at = np.flatnonzero(root != np.arange(len(x)))
        return pa.table({"a": rep[at], "b": rep[root[at]]})

    out = dealt.select("label", "width", "pass", "cell", "pos", "rep", "vec")
    return out.groupBy("label", "width", "pass", "cell").applyInArrow(compare, "a long, b long").distinct()


def _whole_counts(members: DataFrame, cosine: float, n_bins: int) -> DataFrame:
    """``h1, h2, linked`` (copies of other linked vectors) in components that are compared whole, several in one call."""
    def compare(t):
        width, comp = t.column("width").to_numpy(), t.column("component").to_numpy()
        order = np.lexsort((width, comp))
        t = t.take(pa.array(order))
        cuts = np.flatnonzero((np.diff(width[order]) != 0) | (np.diff(comp[order]) != 0)) + 1
        copies, linked = t.column("copies").to_numpy(), np.zeros(len(t), dtype=np.int64)
        for x, y in zip([0, *cuts], [*cuts, len(t)], strict=True):
            u = unit(t.slice(x, y - x))
            near = u @ u.T >= cosine
            np.fill_diagonal(near, False)
            linked[x:y] = near @ copies[x:y]
        return pa.table({"h1": t.column("h1"), "h2": t.column("h2"), "linked": linked})

    m = members.withColumn("bin", F.pmod(F.xxhash64("component"), F.lit(n_bins)))
    return m.select("bin", "component", "h1", "h2", "width", "copies", "vec").groupBy("bin").applyInArrow(
        compare, "h1 long, h2 long, linked long")


def _large_counts(members: DataFrame, cosine: float, whole: int) -> DataFrame:
    """The same in larger components, dealt into blocks; ``n`` is a component's number of vectors."""
    angle = math.acos(cosine)
    blocks = F.ceil(F.col("n") / whole).cast("int")
    m = members.withColumn("block", F.pmod(F.xxhash64("h1", "h2"), blocks).cast("int"))

    def middle(key, t):
        return pa.table({"component": [key[0].as_py()], "n": [key[1].as_py()],
                         "centre": pa.array([unit(t).mean(axis=0).tolist()], type=pa.list_(pa.float64()))})

    centres = (m.filter(F.pmod(F.xxhash64("h2", "h1"), F.col("n")) < CENTRE).select("component", "n", "vec")
               .groupBy("component", "n").applyInArrow(middle, "component long, n long, centre array<double>"))
    centres = centres.select(F.col("component").alias("of"), "centre",
                             F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"))

    def measure(left, right):
        if not len(left):
            return left.append_column("wide", pa.array([], type=pa.bool_()))
        c = unit(right, "centre")[0]
        wide = np.arccos(np.clip(unit(left) @ c, -1, 1)) > (angle - CLEAR) / 2
        return left.append_column("wide", pa.array(wide))

    cols = ["component", "block", "n", "h1", "h2", "copies", "vec"]
    kinds = {f.name: f.dataType.simpleString() for f in m.schema.fields}
    m = m.select(*cols).groupBy("component", "block").cogroup(centres.groupBy("of", "part")).applyInArrow(
        measure, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", wide boolean")
    m = written(m, "angles")
    sums = m.groupBy("component").agg(F.sum(F.when(~F.col("wide"), F.col("copies"))).alias("near"),
                                      F.count_if("wide").alias("n_wide"))
    sums = written(sums, "sums")
    m = m.join(sums, "component")
    certain = m.filter("not wide").select("h1", "h2", (F.col("near") - F.col("copies")).alias("linked"))
    # every wide vector meets every member: blocks of the one with blocks of the other
    strips = F.ceil(F.col("n_wide") / whole).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    wide = (m.filter("wide").withColumn("strip", F.pmod(F.xxhash64("h2"), strips).cast("int"))
            .select(F.col("component").alias("of"), "strip", spread(blocks).alias("part"),
                    *[F.col(c).alias(c) for c in ("h1", "h2", "copies", "vec")]))  # columns of its own in the cogroup
    every = m.filter("n_wide > 0").select("component", "block", spread(strips).alias("strip"), "h1", "h2", "copies",
                                          "wide", "vec")

    def compare(left, right):
        ids = lambda t: np.stack([t.column("h1").to_numpy(), t.column("h2").to_numpy()], axis=1)
        if not len(left) or not len(right):
            none = pa.array([], type=pa.int64())
            return pa.table({"h1": none, "h2": none, "linked": none})
        a, b = ids(left), ids(right)
        near = unit(left) @ unit(right).T >= cosine
        near &= ~(a[:, None] == b[None]).all(axis=2)
        core = ~right.column("wide").to_numpy(zero_copy_only=False)
        h = np.concatenate([a, b[core]])
        return pa.table({"h1": h[:, 0], "h2": h[:, 1], "linked": np.concatenate([
            near @ right.column("copies").to_numpy(), (near.T @ left.column("copies").to_numpy())[core]])})

    met = (wide.groupBy("of", "strip", "part").cogroup(every.groupBy("component", "strip", "block"))
           .applyInArrow(compare, "h1 long, h2 long, linked long"))
    return certain.union(met).groupBy("h1", "h2").agg(F.sum("linked").alias("linked"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW, cell: int = CELL,
                 whole: int = WHOLE, id_col="vec_id", vec_col="embedding", label_col="label") -> DataFrame:
    """Vectors linked at a cosine of ``cosine`` or more with others of their label, and their components.

    Returns one row per row: ``vec_id, n_links`` (other vectors linked
    directly), ``component_id`` (the least id reachable by links, its own
    included) and ``kept`` (it is that id).  Rows with a null label or id, or
    a vector that is null, empty, zero or holds null or non-finite components,
    link with nothing and are kept, as are vectors of different lengths.  A
    row that repeats an id and its vector and label is one vector with it;
    with another vector or label it is a vector of its own, of the same
    component.  Other columns are not read; no rows in, no rows out.
    """
    label = F.col(label_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vec_col).alias("vec"))
    takes_part = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("vec")
                  & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False)))
    h = lambda k: F.when(takes_part, F.xxhash64(F.lit(k), "label", "vec"))
    rows = rows.withColumns({"h1": h(1), "h2": h(2)})
    nodes = _nodes(rows.filter("h1 is not null"))
    largest = rows.filter("h1 is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    nodes = written(_keyed(nodes, n_passes(largest, window, cosine)), "nodes")
    comp = written(components(written(_window_links(nodes, cosine, window, cell), "links")), "components")
    members = nodes.drop("keys").join(comp, nodes["rep"] == comp["node"]).drop("node")
    sizes = written(members.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    members = written(members.join(sizes, "component"), "members")
    n_bins = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // BIN))
    counts = _whole_counts(members.filter(F.col("n") <= whole), cosine, n_bins).union(
        _large_counts(members.filter(F.col("n") > whole), cosine, whole))
    found = (nodes.select("h1", "h2", "rep", "copies")
             .join(members.select("h1", "h2", "component"), ["h1", "h2"], "left").join(counts, ["h1", "h2"], "left")
             .select("h1", "h2", F.coalesce("component", "rep").alias("component"),
                     (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    out = rows.select("vec_id", "h1", "h2").join(written(found, "found"), ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
