"""Alignment of two tokenizers' tokens by coalescing byte intervals.

Both token sequences of a text are intervals of its bytes.  All intervals are
sorted by start, and a running maximum of their ends tells where no token of
either side reaches across: there the groups break.  Within a group the
overlapping pairs are expanded into links.  This runs on flat numpy arrays for
many documents at once.

What a pair of ids counts over the whole corpus is found in a second pass.  A
chunk of documents keeps its distinct pairs with counts, and the links as
places in that list, so only distinct pairs are summed by Spark and joined
back, and a chunk's documents meet its own lookup table, bounded by its links.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .pieces import SPACE, load

#: Tokens of a chunk, about at most (a longer document is a chunk of its own); B segments remembered by a task.
CHUNK, REMEMBERED = 500_000, 100_000
#: Fixed value: the public pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies print each byte as one character: itself where it shows, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class ByteTokens:
    """A byte-level BPE vocabulary (``tokenizers`` JSON) whose ids follow the order of its merges."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        special = {t["content"] for t in j["added_tokens"]}
        back = byte_of_char()
        self.ranks = {bytes(back[c] for c in entry): i for entry, i in j["model"]["vocab"].items() if entry not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
        order = [j["model"]["vocab"][a + b] for a, b in merges]
        if order != sorted(order) or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary's ids do not follow its merges, or lack a byte")
        self.n = max(self.ranks.values()) + 1
        self.lengths = np.zeros(self.n, dtype=np.int64)
        for b, i in self.ranks.items():
            self.lengths[i] = len(b)
        self._encode = None

    @classmethod
    def load(cls, path: str) -> ByteTokens:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def __getstate__(self):
        return self.__dict__ | {"_encode": None}

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the strings of special tokens are plain text."""
        if self._encode is None:
            import tiktoken

            self._encode = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=self.ranks,
                                             special_tokens={}).encode_ordinary
        return self._encode(text)


class PieceTokens:
    """A sentencepiece vocabulary with the bytes of its pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = f.read()  # shipped to the tasks, which need no file
        self.pieces = pieces = load(path)
        if not pieces.prefix or pieces.cut is None:
            raise ValueError("the model's pieces reach across spaces, or it puts none before a text")
        self._library = None
        self.n = len(pieces.pieces)
        self.bytes = [bytes([pieces.byte_of[i]]) if i in pieces.byte_of else p.replace(SPACE, " ").encode()
                      for i, p in enumerate(pieces.pieces)]
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)

    def __getstate__(self):
        return self.__dict__ | {"_library": None}

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """The library's ids of parts of texts that no piece reaches across.

        The library puts a space before each: it stands for a segment's own
        first space, or is cut off again with a line break put after it.
        """
        if self._library is None:
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        own = [len(s) > 1 and s[0] == SPACE for s in segments]
        texts = [s[1:] if o else "\n" + s for s, o in zip(segments, own, strict=True)]
        return [ids if o else ids[2:]
                for ids, o in zip(self._library.encode(texts, num_threads=1), own, strict=True)]

    def encode(self, text: str, known: dict) -> np.ndarray | None:
        """Ids of a text, or None where their bytes differ from a space and the text."""
        if SPACE in text:
            return None
        parts = self.pieces.segments(text)
        missing = [s for s in dict.fromkeys(parts) if s not in known]
        if missing:
            for s, ids in zip(missing, self.encode_segments(missing), strict=True):
                same = b"".join([self.bytes[i] for i in ids]) == s.replace(SPACE, " ").encode()
                known[s] = np.array(ids, dtype=np.int32).tobytes() if same else None
        got = [known[s] for s in parts]
        return None if None in got else np.frombuffer(b"".join(got), dtype=np.int32)


def coalesce(a_start, a_end, b_start, b_end):
    """Groups and links of two sequences of intervals, each in order and without overlaps of its own.

    Returns the group of every A interval, of every B interval, and the links
    as places in A and in B.  A group breaks where an interval starts at or
    after the end of all before it; links are all pairs that overlap.
    """
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), dtype=np.int64)
    fresh[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(fresh) - 1
    lo, hi = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = np.maximum(hi - lo, 0)
    link_a = np.repeat(np.arange(len(a_start)), n)
    link_b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return group[:len(a_start)], group[len(a_start):], link_a, link_b


def _digits(most: int) -> np.ndarray:
    """Decimal digits of 0 .. most as bytes, filled up with zero bytes at the left."""
    n = np.arange(most + 1)
    width = len(str(most))
    out = np.stack([(n // 10**k) % 10 + 48 for k in reversed(range(width))], axis=1).astype(np.uint8)
    for k in range(width - 1):
        out[n < 10 ** (width - 1 - k), k] = 0
    return out


def spelled(ids, side, group, doc, digits) -> tuple[np.ndarray, np.ndarray]:
    """All documents' groups ``a1,a2|b1;a3|b2,b3`` as one byte array, and where each token's part ends."""
    order = np.argsort(2 * group + side, kind="stable")  # tokens of a side stay in order
    s, g, d = side[order], group[order], doc[order]
    after = np.full(len(order), ord(","), dtype=np.uint8)
    after[:-1][s[1:] != s[:-1]] = ord("|")
    after[:-1][g[1:] != g[:-1]] = ord(";")
    after[:-1][d[1:] != d[:-1]] = 0
    after[-1:] = 0
    cells = np.concatenate([digits[ids[order]], after[:, None]], axis=1)
    return cells[cells != 0], np.cumsum((cells != 0).sum(axis=1))


def _chunk(rows, a: ByteTokens, b: PieceTokens, digits, key: int) -> dict:
    """One chunk of documents ``(id, ids of A, ids of B)``, aligned."""
    n_a, n_b = (np.array([len(r[k]) for r in rows], dtype=np.int64) for k in (1, 2))
    ids_a, ids_b = (np.concatenate([np.asarray(r[k], dtype=np.int64) for r in rows]) for k in (1, 2))
    end_a, end_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    group_a, group_b, la, lb = coalesce(end_a - a.lengths[ids_a], end_a, end_b - b.lengths[ids_b], end_b)
    doc_a, doc_b = np.repeat(np.arange(len(rows)), n_a), np.repeat(np.arange(len(rows)), n_b)
    text, ends = spelled(np.concatenate([ids_a, ids_b]), np.repeat([0, 1], [len(ids_a), len(ids_b)]),
                         np.concatenate([group_a, group_b]), np.concatenate([doc_a, doc_b]), digits)
    till = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    pairs, place, counts = np.unique(ids_a[la] * b.n + ids_b[lb], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(np.diff(group_a, prepend=-1))
    text = text.tobytes()
    return {
        "chunk": key, "doc_id": [r[0] for r in rows], "n_a": n_a, "n_b": n_b,
        "n_groups": np.bincount(doc_a[starts], minlength=len(rows)),
        "n_links": np.bincount(doc_a[la], minlength=len(rows)),
        "groups_sha256": [hashlib.sha256(text[x:y]).hexdigest() if n else ""
                          for x, y, n in zip(till[:-1], till[1:], n_a, strict=True)],
        "links": pa.compress(place.astype(np.int32).reshape(-1, 1).view(np.uint8).T.tobytes(), "zstd", asbytes=True),
        "pairs": pairs, "counts": counts,
    }


def aligned_chunks(docs: DataFrame, a: ByteTokens, b: PieceTokens, text_col="text", id_col="doc_id") -> DataFrame:
    """Chunks of aligned documents: per-document columns as arrays, links as places in ``pairs``, and ``counts``."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    schema = (f"chunk long, doc_id array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, "
              "n_links array<long>, groups_sha256 array<string>, links binary, pairs array<long>, counts array<long>")

    def cut(batches):
        digits, known, rows, size, made = _digits(max(a.n, b.n)), {}, [], 0, 0
        part = TaskContext.get().partitionId() << 32
        none = np.zeros(0, dtype=np.int32)

        def chunk():
            made_of = _chunk(rows, a, b, digits, part | made)
            made_of["doc_id"] = pa.array(made_of["doc_id"], type=id_type)
            return pa.RecordBatch.from_pydict({
                k: pa.array([v], type=pa.list_(id_type) if k == "doc_id" else None) for k, v in made_of.items()})

        for batch in batches:
            id_type = batch.column("doc_id").type
            for i, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = text.as_py()
                ids_b = b.encode(text, known) if text else None
                ids_a = none if ids_b is None else a.encode(" " + text)
                rows.append((i.as_py(), ids_a, none if ids_b is None else ids_b))
                size += len(rows[-1][1]) + len(rows[-1][2])
                if size >= CHUNK:
                    yield chunk()
                    rows, size, made = [], 0, made + 1
                if len(known) > REMEMBERED:
                    known.clear()
        if rows:
            yield chunk()

    return d.mapInArrow(cut, schema)


def align(docs: DataFrame, a: ByteTokens, b: PieceTokens, text_col="text", id_col="doc_id") -> DataFrame:
    """Tokens, groups and links of every whole text, and what its links' id pairs count over all texts.

    A encodes a space and the text, B (which adds the space) the text.
    Returns one row per row: ``doc_id, n_a, n_b, n_groups, n_links``;
    ``n_best``, links whose pair counts as much as any pair of its B id;
    ``count_sum``, the counts of its links' pairs summed; ``groups_sha256`` of
    the groups' ids.  Texts that are null, empty, or that B does not spell
    byte for byte have no tokens: zeros and an empty string.  Repeated rows
    count each; a null id stays null; other columns are not read; no rows in,
    no rows out.
    """
    t = written(aligned_chunks(docs, a, b, text_col, id_col), "chunks")
    kind = t.schema["doc_id"].dataType.elementType.simpleString()
    each = t.select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x"))
    totals = written(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("total")), "totals")
    of_b = totals.groupBy((F.col("pair") % b.n).alias("b")).agg(F.max("total").alias("most"))
    lookup = (totals.withColumn("b", F.col("pair") % b.n).join(of_b, "b")
              .select("pair", "total", (F.col("total") == F.col("most")).alias("best")))
    found = (t.select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("place", "pair")).join(lookup, "pair")
             .select("of", "place", "total", "best"))
    kept = t.drop("pairs", "counts")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0] for c in left.column_names}
        n = row["n_links"].values.to_numpy()
        order = np.argsort(right.column("place").to_numpy())
        total = right.column("total").to_numpy()[order]
        best = right.column("best").to_numpy(zero_copy_only=False)[order]
        m = int(n.sum())
        place = np.frombuffer(pa.decompress(row["links"].as_py(), m * 4, "zstd", asbytes=True),
                              dtype=np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()
        till = np.concatenate([[0], np.cumsum(n)])
        upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[till])
        return pa.table({
            **{c: row[c].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
            "n_best": upto(best[place]), "count_sum": upto(total[place]), "groups_sha256": row["groups_sha256"].values})

    return (kept.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(
        finish, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                "groups_sha256 string"))
