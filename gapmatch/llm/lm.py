"""Language-model scores of whole documents.

Spark counts the training tokens.  The words met most get the network's
vocabulary; the gated recurrent network (``recurrent``) is trained by all
training documents in a few rounds.  Documents are dealt by a hash to shards
of about equal tokens; in a round each shard runs truncated backpropagation
over its documents of that round, in the order of the hash and from the
parameters of the round before, and Spark averages the shards' parameters,
weighted by tokens.  So the model does not depend on how the input is split.
Each document is trained on in one round.  Scoring then carries the state
through each whole text.

A word outside the network's vocabulary has the probability of the class of
other words times (c+1)/(N'+V'+1), with N' tokens and V' words counted in that
class.  Counts of the most frequent words are at hand in every task (a fixed
number); the counts of the others are joined by a hash of the word, which no
word of the hot ones takes part in.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written
from .recurrent import END, OTHER, SIZE, WORDS, Trainer, initial, score
from .words import split_words

#: Words whose counts every task holds.
HOT = 65_536
#: Of 16 parts of the documents, the last of each training round, and the rounds' learning rates.
ROUNDS = ((1, 0.015), (4, 0.01), (16, 0.005))
#: Tokens of a shard, about; shards averaged in one call.
SHARD, TOGETHER = 2_000_000, 64
#: Tokens gathered for a run of backpropagation; parameters in a row; texts coded at a time.
PIECE, PART, SLICE = 300_000, 8192, 1000
REMEMBERED = 400_000


def word_hash(word: bytes) -> int:
    """A hash of 62 bits with the next bit set, so that it is above all ranks."""
    return (xxhash.xxh3_64_intdigest(word) & (2**62 - 1)) | 2**62


class Codes(dict):
    """Word (bytes) to its rank among the hot words, or else to a hash of 62 bits with the top bit set."""

    def __init__(self, hot: np.ndarray | None = None):
        super().__init__()
        self.rank = {} if hot is None else {int(h): r for r, h in enumerate(hot)}

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word)
        h = self[word] = self.rank.get(h, h)
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = split_words(text, lower=True)
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32(id as text) mod 7 is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(7)) == 2, F.lit(False))


def word_counts(docs: DataFrame, text_col="text", id_col="doc_id") -> DataFrame:
    """``word`` (hash) and count ``c`` over the training documents."""
    def flushed(sums: Counter) -> pd.DataFrame:
        # words that share a hash are one word from here on
        return pd.DataFrame({"word": [word_hash(w) for w in sums], "c": list(sums.values())}, dtype="int64")

    def count(batches):
        sums: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                sums.update(split_words(t, lower=True))
                if len(sums) > REMEMBERED:
                    yield flushed(sums)
                    sums.clear()
        yield flushed(sums)

    train = docs.filter(~held_out(id_col)).select(F.col(text_col).alias("text"))
    return train.mapInPandas(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def network_ids(codes: np.ndarray) -> np.ndarray:
    """Ids of the network: words by rank from 1, all others one id; the text's end last."""
    return np.append(np.where(codes < WORDS - 1, codes + 1, OTHER), END).astype(np.int16)


def _averaged(parts: DataFrame, shards: int) -> DataFrame:
    """``part, x``: the shards' parameters averaged by tokens, a bounded number of shards in one call."""
    def mean(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("shard", kind="stable")  # sums in one order give one result
        w = t["tokens"].to_numpy(dtype=np.float64)
        x = sum(np.asarray(a, dtype=np.float64) * k for a, k in zip(t["x"], w, strict=True)) / w.sum()
        return pd.DataFrame({"part": [t["part"].iloc[0]], "shard": [t["shard"].iloc[0] // TOGETHER],
                             "tokens": [int(w.sum())], "x": [x]})

    while shards > 1:
        parts = (parts.withColumn("group", F.floor(F.col("shard") / TOGETHER)).groupBy("part", "group")
                 .applyInPandas(mean, "part int, shard long, tokens long, x array<double>"))
        shards = -(-shards // TOGETHER)
    return parts.select("part", "x")


def _round(docs: DataFrame, flat: np.ndarray, rate: float, shards: int) -> np.ndarray:
    """Parameters after one round over ``docs(key, shard, ids)``, averaged over shards by tokens."""

    def train(batches):
        state = {"shard": None}

        def run():
            if state["size"]:
                starts = np.zeros(state["size"], dtype=bool)
                starts[np.cumsum([0, *map(len, state["held"][:-1])])] = True
                state["trainer"].run(np.concatenate(state["held"]), starts)
                state["tokens"] += state["size"]
                state.update(held=[], size=0)

        def done():
            if state["shard"] is None:
                return
            run()
            x = state["trainer"].flat
            yield pd.DataFrame({"part": range(0, SIZE, PART), "shard": state["shard"], "tokens": state["tokens"],
                                "x": [x[k:k + PART].astype(np.float64) for k in range(0, SIZE, PART)]})

        for b in batches:
            for shard, ids in zip(b["shard"], b["ids"], strict=True):
                if shard != state["shard"]:
                    yield from done()
                    state.update(shard=shard, trainer=Trainer(flat, rate), tokens=0, held=[], size=0)
                state["held"].append(np.frombuffer(ids, dtype=np.int16))
                state["size"] += len(state["held"][-1])
                if state["size"] >= PIECE:
                    run()
        yield from done()

    # the documents of a shard stand in one order, however the input is split
    dealt = docs.repartition(shards, "shard").sortWithinPartitions("shard", "key", "ids").select("shard", "ids")
    parts = dealt.mapInPandas(train, "part int, shard long, tokens long, x array<double>")
    got = _averaged(parts, shards).toPandas()  # SIZE numbers
    if not len(got):
        return flat
    return np.concatenate(got.sort_values("part")["x"].tolist()).astype(np.float32)


def fit_and_score(docs: DataFrame, text_col="text", id_col="doc_id", rounds=ROUNDS) -> DataFrame:
    """Scores of all whole texts by a model of those that are not held out.

    Returns per row ``doc_id, held_out, n_tokens`` (words and one end)``,
    n_known`` (met in training)``, train_tokens, base_score`` (log10 under the
    smoothed counts of single tokens) and ``score`` (log10 under the network).
    A null or empty text is its end alone.  Repeated rows are counted,
    trained on and scored each.  Without training documents the base is that
    of no counts and the network that of its start.  No rows in, no rows out.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = written(word_counts(docs, text_col, id_col), "counts")
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train = d.filter(~held_out("doc_id")).count()
    # the end is a token that every training document has
    total, distinct = n_words + n_train, n_distinct + (n_train > 0)
    top = counts.orderBy(F.desc("c"), "word").limit(HOT).toPandas()  # at most HOT rows
    hot, hot_c = top["word"].to_numpy(dtype=np.int64), top["c"].to_numpy(dtype=np.float64)
    inside = min(len(hot), WORDS - 1)
    by_id = np.zeros(WORDS)
    by_id[0], by_id[1:inside + 1] = n_train, hot_c[:inside]
    n_other = total - by_id.sum()
    v_other = distinct - (n_train > 0) - inside
    log_base, log_other = np.log10(total + distinct + 1), np.log10(n_other + v_other + 1)
    hot_log, end_log = np.log10(hot_c + 1), np.log10(n_train + 1)

    def coded(texts):
        codes = Codes(hot)
        for some in texts:
            rows = []
            for t in some:
                c = codes.of(t)
                at_hand = c < HOT
                known = c[at_hand]
                logs, other = hot_log[known], known >= WORDS - 1
                rare = c[~at_hand]
                rows.append((network_ids(c).tobytes(), len(c) + 1, len(known) + bool(n_train), end_log + float(logs.sum()),
                             float(logs[other].sum()), int(other.sum()) + len(rare), rare))
            codes.trim()
            yield pd.DataFrame(rows, columns=["ids", "n_tokens", "n_hot", "hot_log", "other_log", "n_other", "rare"])

    numbered = d.withColumn("uid", F.monotonically_increasing_id()).withColumn("held_out", held_out("doc_id"))
    c = written(map_texts(numbered, coded, "ids binary, n_tokens long, n_hot long, hot_log double, other_log double, "
                          "n_other long, rare array<long>", ["doc_id", "uid", "held_out"], SLICE), "coded")

    # shards follow from the tokens alone, and their documents from a hash
    shards = max(1, round(total / SHARD))
    key = F.xxhash64("doc_id", "ids")
    t = (c.filter("not held_out").withColumn("key", key)
         .select("key", "ids", F.pmod("key", F.lit(shards)).alias("shard"),
                 F.pmod(F.xxhash64("key"), F.lit(16)).alias("lot")))
    flat, first = initial(by_id, n_other), 0
    for last, rate in rounds:
        flat, first = _round(t.filter((F.col("lot") >= first) & (F.col("lot") < last)), flat, rate, shards), last

    def scored(batches):
        for b in batches:
            ids = [np.frombuffer(x, dtype=np.int16) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(score(flat, ids) / np.log(10))], names=["uid", "net"])

    net = c.select("uid", "ids").mapInArrow(scored, "uid long, net double")
    rare = c.select("uid", F.explode("rare").alias("word")).join(counts, "word")
    found = rare.groupBy("uid").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("c") + 1)).alias("rare_log"))
    out = c.drop("ids", "rare").join(net, "uid").join(found, "uid", "left").na.fill(0, ["n_rare", "rare_log"])
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.col("n_rare")).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("hot_log") + F.col("rare_log") - F.col("n_tokens") * F.lit(float(log_base))).alias("base_score"),
        (F.col("net") + F.col("other_log") + F.col("rare_log") - F.col("n_other") * F.lit(float(log_other)))
        .alias("score"))
