"""Prefix trie of conversations, by collapse of whole sequences.

A conversation is a sequence of turns.  The hash of its first d turns is the
exclusive or of hashes of each turn and its place, so prefixes of a
conversation that spreads over many tasks are running sums over its parts.
Identical conversations collapse to one weighted sequence with the list of
those that end there; sequences that are no proper prefix of another, found
by an anti-join, are the leaves; the prefixes of the weighted sequences are
aggregated into nodes.

Sums over a subtree need no pairs of nodes.  A node's words times its
conversations, summed below a node, are the words that its sequences have from
there on, times their weights.  The words of each node once are those that the
sequence which owns the node has from there on: a node is owned by the
sequence of its smallest conversation, so the nodes that a sequence owns are
the last ones on its path.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, placed, written

#: Conversations that share their first turns; most turns shared, plus one.
SHARED, MOST = 20, 4
#: Ids joined into one piece of a list of ends.
PIECE = 10_000
KEY = ["x1", "x2", "depth"]


def shared_turns(conv_id: Column | str = "conv_id", most: int = MOST) -> Column:
    """How many turns a conversation takes from the first of its block: crc32 of its decimal id mod ``most``."""
    c = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    return F.crc32(c.cast("string").cast("binary")) % most


def ordered_turns(conversations: DataFrame, id_col="conv_id", turn_col="turn", role_col="role",
                  text_col="text") -> DataFrame:
    """``conv_id, part, pos, h1, h2, words``: turns in order (null first), as hashes of role and text.

    Null roles and texts are empty; turns of equal number stand in the order
    of their hashes; rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    t = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"),
        n_words(text).alias("words")).filter("conv_id is not null")
    return placed(t, ["conv_id"], ["turn", "h1", "h2"], "turns").drop("turn")


def rebuilt(turns: DataFrame, block: int = SHARED, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Conversations, and their turns with the first ones taken from the first conversation of their block.

    Conversation c starts with the first h turns of c - c % block (all if
    fewer, none if absent), h = ``shared_turns``, followed by its own turns
    after its first h.  Returns ``conv_id`` of all, and ``conv_id, part, depth,
    t1, t2, words``.
    """
    first = F.when(F.col("pos") < most - 1, F.struct("pos", "h1", "h2", "words"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(first)).alias("head"))  # fewer than ``most`` turns
    convs = written(convs.withColumn("h", shared_turns(most=most).cast("int")), "conversations")
    heads = convs.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("from"))
    convs = (convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(heads, "base", "left")
             .withColumn("taken", F.when(F.col("from").isNull(), F.array().cast(heads.schema["from"].dataType))
                         .otherwise(F.slice("from", F.lit(1), F.col("h"))))
             .select("conv_id", "h", "taken"))
    taken = (convs.select("conv_id", F.explode("taken").alias("x"))
             .select("conv_id", F.lit(-1).cast("long").alias("part"), F.col("x.pos").alias("at"), "x.h1", "x.h2", "x.words"))
    parts = (turns.select("conv_id", "part").distinct()
             .join(convs.select("conv_id", "h", F.size("taken").alias("m")), "conv_id"))
    own = (turns.join(parts, ["conv_id", "part"]).filter("pos >= h")
           .select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("m")).alias("at"), "h1", "h2", "words"))
    both = own.union(taken)
    tag = lambda k: F.xxhash64(F.lit(k), "at", "h1", "h2")
    rows = both.select("conv_id", "part", (F.col("at") + 1).alias("depth"), tag(1).alias("t1"), tag(2).alias("t2"), "words")
    return convs.select("conv_id"), written(rows, "rebuilt")


def _digests(ends: DataFrame) -> DataFrame:
    """``x1, x2, depth, ends_sha256`` of the ids that end at each node, ascending and joined by commas.

    Ids are joined into pieces by tasks that hold ranges of them; a node's
    pieces then pass through the digest one after the other, so that no list
    of ids is ever held whole.
    """
    order = [*KEY, "conv_id"]

    def pieces(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in order]
            start = 0
            for k in range(1, b.num_rows + 1):
                key = tuple(c[start] for c in cols[:3])
                if k == b.num_rows or k - start == PIECE or key != tuple(c[k] for c in cols[:3]):
                    yield (*key, cols[3][start], ",".join(map(str, cols[3][start:k])))
                    start = k

    def joined(batches):
        schema = pa.schema([*[(c, pa.int64()) for c in [*KEY, "first"]], ("ids", pa.string())])
        rows = []
        for row in pieces(batches):
            rows.append(row)
            if len(rows) == 1000:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema=schema)

    def digest(batches):
        schema = pa.schema([*[(c, pa.int64()) for c in KEY], ("ends_sha256", pa.string())])
        key, sha, rows = None, None, []
        for b in batches:
            for *at, ids in zip(*[b.column(c).to_pylist() for c in [*KEY, "ids"]], strict=True):
                if at != key:
                    if key is not None:
                        rows.append((*key, sha.hexdigest()))
                    key, sha = at, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema=schema)
                rows = []
        if key is not None:
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(schema.names, (*key, sha.hexdigest()), strict=True)},
                                             schema=schema)

    spread = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    keys = ", ".join(f"{c} long" for c in KEY)
    listed = spread.mapInArrow(joined, f"{keys}, first long, ids string")
    return (listed.repartition(*KEY).sortWithinPartitions(*KEY, "first")
            .mapInArrow(digest, f"{keys}, ends_sha256 string"))


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations ``convs(conv_id)`` with turns as ``rebuilt`` returns them.

    A node is a distinct sequence of first turns, from the root without any;
    conversations that start with it are its members, also those without
    turns.  Returns ``conv_id`` (smallest member), ``depth, parent_conv_id``
    (null at the root), ``n_convs`` (members), ``n_children, n_leaves``
    (childless nodes of its subtree, itself included), ``saved_tokens`` (over
    its subtree, words of a node's last turn times its members but one) and
    ``ends_sha256`` (of the ids that end there, ascending, joined by commas).
    No conversations, no nodes.
    """
    xor = lambda c: F.expr(f"bit_xor({c})")
    totals = turns.groupBy("conv_id", "part").agg(
        xor("t1").alias("t1"), xor("t2").alias("t2"), F.sum("words").alias("words"), F.count("*").alias("n"))
    totals = written(totals, "totals")
    zero = lambda c, name=None: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("long").alias(name or c)
    whole = (convs.join(totals, "conv_id", "left").groupBy("conv_id")
             .agg(zero(xor("t1"), "x1"), zero(xor("t2"), "x2"), zero(F.sum("n"), "depth"), zero(F.sum("words"), "all_words")))
    whole = written(whole, "whole")
    seqs = whole.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight"),
                                   F.first("all_words").alias("all_words"))
    seqs = written(seqs, "sequences")

    # the prefixes of one conversation of each sequence, part by part
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("conv_id", "part", zero(xor("t1").over(earlier), "c1"), zero(xor("t2").over(earlier), "c2"),
                          zero(F.sum("words").over(earlier), "c_words"))
    of = seqs.select(F.col("rep").alias("conv_id"), F.col("depth").alias("length"), "weight", "all_words")
    carry = written(carry.join(of, "conv_id"), "carry")
    so_far = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c, t: F.col(c).bitwiseXOR(xor(t).over(so_far))
    inner = (turns.join(carry, ["conv_id", "part"])
             .select("conv_id", "part", "depth", "length", "weight", "all_words", "words", "t1", "t2",
                     run("c1", "t1").alias("x1"), run("c2", "t2").alias("x2"),
                     (F.col("c_words") + F.sum("words").over(so_far)).alias("upto"))
             .withColumns({"p1": F.col("x1").bitwiseXOR(F.col("t1")), "p2": F.col("x2").bitwiseXOR(F.col("t2"))}).drop("t1", "t2"))
    none = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    root = of.select("conv_id", F.lit(-2).cast("long").alias("part"), "length", "weight", "all_words",
                     *none("depth", "words", "x1", "x2", "upto"),
                     F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    prefixes = written(inner.unionByName(root), "prefixes")

    nodes = written(prefixes.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.first("p1").alias("p1"),
        F.first("p2").alias("p2"), F.first("upto").alias("upto"), F.first("words").alias("words")), "nodes")
    proper = prefixes.filter("depth < length").select(*KEY).distinct()
    leaves = seqs.join(proper, KEY, "left_anti").select(F.col("rep").alias("conv_id"), F.lit(1).alias("leaf"))
    owned = nodes.groupBy("conv_id").agg(F.min_by(F.col("upto") - F.col("words"), "depth").alias("before"))
    of_seq = seqs.select(F.col("rep").alias("conv_id")).join(leaves, "conv_id", "left").join(owned, "conv_id", "left")
    parts = carry.select("conv_id", "part").union(of.select("conv_id", F.lit(-2).cast("long")))
    before_own = F.col("upto") - F.col("words")
    once = F.when(F.col("before").isNotNull(), F.col("all_words") - F.greatest(before_own, "before")).otherwise(0)
    sums = (prefixes.join(parts.join(of_seq, "conv_id"), ["conv_id", "part"]).groupBy(*KEY)
            .agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
                 F.sum(F.col("weight") * (F.col("all_words") - before_own) - once).alias("saved_tokens")))

    children = (nodes.filter("depth > 0").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2"),
                                                  (F.col("depth") - 1).alias("depth"))
                .agg(F.count("*").alias("n_children")))
    ends = written(_digests(whole), "ends")
    out = (nodes.join(sums, KEY).join(children, KEY, "left").join(ends, KEY, "left")
           .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
           .withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # the root, one row, is broadcast to its children; other parents are joined by key
    above = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), (F.col("depth") + 1).alias("depth"),
                         F.col("conv_id").alias("parent_conv_id"))
    top = F.broadcast(above.filter("depth = 1").select("depth", "parent_conv_id"))
    out = out.filter("depth < 2").join(top, "depth", "left").unionByName(
        out.filter("depth >= 2").join(above.filter("depth >= 2"), ["p1", "p2", "depth"]))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      "ends_sha256")
