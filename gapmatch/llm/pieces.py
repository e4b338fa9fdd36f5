"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes segments that no piece can cross (a run of spaces with the word
after it, or a line break), and each distinct segment of a batch is encoded
once.  All segments lie in one flat array of symbols; a round looks up the
rank of every neighbouring pair, takes each segment's least rank, merges there
and compacts the array, until no segment has a pair left.

Merging the leftmost pair of least rank is what the library does.  All pairs
of that rank in a segment are merged at once where this cannot differ: where
the merged piece takes part in no better pair than its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SPACE = "▁"
_NONE = np.int32(2**31 - 1)
#: Segments remembered by a task, symbols merged in one call, texts cut into segments at a time, at most about.
REMEMBERED, FLAT, SLICE = 50_000, 2_000_000, 250


class Pieces:
    """The merge table of a BPE model with byte fallback."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], prefix: bool = True):
        """``kinds``: normal, byte, unknown or control of each piece."""
        self.pieces, self.prefix = pieces, prefix
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.byte_of = {}
        for i, k in enumerate(kinds):
            if k == "byte":
                self.byte_id[int(pieces[i][3:5], 16)] = i
                self.byte_of[i] = int(pieces[i][3:5], 16)
        # what an id that is no part of a text decodes to
        self.other = {i: " ⁇ " if k == "unknown" else "" for i, k in enumerate(kinds) if k in ("unknown", "control")}
        ids = {pieces[i]: i for i in normal}
        # characters met only inside longer pieces get symbols of their own, after the pieces
        chars = sorted({c for p in ids for c in p} - set(ids))
        symbol = ids | {c: len(pieces) + k for k, c in enumerate(chars)}
        self.n_symbols = len(pieces) + len(chars)
        self.chars = chars
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        rank = {p: order[scores[i]] for p, i in ids.items()}
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.n_symbols + b] = (rank[p], i)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()] + [_NONE], dtype=np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], dtype=np.int64)
        self.keys = np.append(self.keys, np.int64(2**62))
        # ranks whose pieces can be merged everywhere at once
        best = np.full(self.n_symbols, _NONE, dtype=np.int32)
        np.minimum.at(best, self.keys[:-1] // self.n_symbols, self.rank[:-1])
        np.minimum.at(best, self.keys[:-1] % self.n_symbols, self.rank[:-1])
        self.at_once = np.ones(len(order) + 1, dtype=bool)
        for p, i in ids.items():
            self.at_once[rank[p]] &= bool(best[i] > rank[p])
        points = np.full(0x110000, -1, dtype=np.int64)
        for c, s in symbol.items():
            if len(c) == 1:
                points[ord(c)] = s
        self.points = points
        inner = {a + b for p in ids for a, b in zip(p, p[1:])}
        long = {c for p in ids if len(p) > 1 for c in p}
        if any(x[1] == SPACE and x[0] != SPACE for x in inner):
            self.cut = None
        elif "\n" in long:
            self.cut = f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        else:
            self.cut = f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+"
        self._find = None

    def __getstate__(self):
        return self.__dict__ | {"_find": None, "points": None, "_points": np.flatnonzero(self.points >= 0),
                                "_symbols": self.points[self.points >= 0]}

    def __setstate__(self, state):
        points = np.full(0x110000, -1, dtype=np.int64)
        points[state.pop("_points")] = state.pop("_symbols")
        self.__dict__.update(state | {"points": points})

    def segments(self, text: str) -> list[str]:
        """The parts of a text that are encoded by themselves."""
        if not text:
            return []
        t = text.replace(" ", SPACE)
        t = SPACE + t if self.prefix else t
        if self.cut is None:
            return [t]
        if self._find is None:
            self._find = re.compile(self.cut).findall
        return self._find(t)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in the table of pairs of symbols, the last place where there is none."""
        key = np.where((left < 0) | (right < 0), np.int64(-1), left * self.n_symbols + right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge flat ``symbols`` of segments of ``lengths`` (each over 0); returns the same kind of arrays.

        A symbol below 0 merges with nothing.
        """
        n_seg = len(lengths)
        done_sym, done_seg = [], []
        sym, seg = symbols, np.repeat(np.arange(n_seg), lengths)
        end = np.append(seg[1:] != seg[:-1], True)
        at = self._pairs(sym, np.append(sym[1:], -1))
        at[end] = len(self.keys) - 1
        while len(sym):
            starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            r = self.rank[at]
            least = np.minimum.reduceat(r, starts)
            size = np.diff(np.append(starts, len(sym)))
            over = least == _NONE
            if over.any():
                gone = np.repeat(over, size)
                done_sym.append(sym[gone])
                done_seg.append(seg[gone])
                sym, seg, at, r = sym[~gone], seg[~gone], at[~gone], r[~gone]
                least, size = least[~over], size[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(r == np.repeat(least, size))
            first = np.append(True, seg[hit[1:]] != seg[hit[:-1]])
            # in a run of overlapping hits every other one, counted from its left end
            joined = np.append(False, (hit[1:] == hit[:-1] + 1) & ~first[1:])
            head = np.maximum.accumulate(np.where(joined, 0, np.arange(len(hit))))
            take = (np.arange(len(hit)) - head) % 2 == 0
            take &= first | self.at_once[r[hit]]
            hit = hit[take]
            sym[hit] = self.merged[at[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            new = hit - np.arange(len(hit))  # where the merged symbols go
            sym, seg, at = sym[keep], seg[keep], at[keep]
            last = np.append(seg[1:] != seg[:-1], True)
            for i in (new, new[new > 0] - 1):
                i = i[~last[i]]
                at[i] = self._pairs(sym[i], sym[i + 1])
            at[last] = len(self.keys) - 1
        sym, seg = np.concatenate([*done_sym, sym]), np.concatenate([*done_seg, seg])
        order = np.argsort(seg, kind="stable")
        return sym[order], np.bincount(seg, minlength=n_seg)

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment (none empty)."""
        out: list[list[int]] = []
        start = 0
        while start < len(segments):
            stop, size = start, 0
            while stop < len(segments) and (stop == start or size + len(segments[stop]) <= FLAT):
                size += len(segments[stop])
                stop += 1
            part = segments[start:stop]
            start = stop
            points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            symbols = self.points[points]
            symbols = np.where(symbols < 0, -1 - points.astype(np.int64), symbols)
            lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            sym, n = self.merge(symbols, lengths)
            ids, to = sym.tolist(), np.cumsum(n).tolist()
            odd = np.flatnonzero((sym < 0) | (sym >= len(self.pieces)))
            odd_seg = set(np.searchsorted(np.array(to), odd, side="right").tolist())
            for k, (a, b) in enumerate(zip([0, *to[:-1]], to, strict=True)):
                out.append(self._spelled(ids[a:b]) if k in odd_seg else ids[a:b])
        return out

    def _spelled(self, symbols: list[int]) -> list[int]:
        """Ids of symbols, those without a piece in bytes."""
        ids: list[int] = []
        for s in symbols:
            if 0 <= s < len(self.pieces):
                ids.append(s)
            else:
                c = chr(-1 - s) if s < 0 else self.chars[s - len(self.pieces)]
                ids += [int(self.byte_id[x]) for x in c.encode("utf-8", "surrogatepass")]
        return ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of whole texts (null: none)."""
        parts = [self.segments(t or "") for t in texts]
        distinct = list(dict.fromkeys(s for p in parts for s in p))
        ids = dict(zip(distinct, self.encode_segments(distinct), strict=True))
        return [[i for s in p for i in ids[s]] for p in parts]

    def spell(self, ids: list[int]) -> str:
        """The text of ids as it stands inside a text: spaces as such, bytes joined."""
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run = bytearray()
            out.append(self.other.get(i, self.pieces[i]))
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space put before a text's first piece is taken off."""
        text = self.spell(ids)
        return self.trimmed(text, ids[0] if len(ids) else -1)

    def trimmed(self, text: str, first: int) -> str:
        if self.prefix and first >= 0 and first not in self.byte_of and self.pieces[first].startswith(SPACE):
            return text[1:]
        return text


def _utf8(b: bytes) -> str:
    """Bytes as text, each byte that is not part of a character as U+FFFD."""
    try:
        return b.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(b):
            for n in range(1, 5):
                try:
                    out.append(b[k:k + n].decode())
                    k += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                k += 1
        return "".join(out)


def load(path: str) -> Pieces:
    """The merge table of a sentencepiece model file (read on the driver)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = ["byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i)
             else "normal" for i in range(n)]
    return Pieces([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds)


def encode(docs: DataFrame, pieces: Pieces, text_col="text", name="ids") -> DataFrame:
    """``docs`` with the ids of its whole texts, an array (empty for a null or empty text)."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(x, dtype=np.int32) for x in pieces.encode(texts.tolist())], dtype=object)

    return docs.withColumn(name, ids(F.col(text_col)))


def decode(docs: DataFrame, pieces: Pieces, ids_col="ids", name="decoded") -> DataFrame:
    """``docs`` with the text of an array of ids (a null array: an empty text)."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series(["" if x is None else pieces.decode(list(x)) for x in ids], dtype=object)

    return docs.withColumn(name, text(F.col(ids_col)))


def _remembered(texts: Iterator[pd.Series], pieces: Pieces, make):
    """For each series of texts, for each text, the list of ``make(ids)`` of its segments, remembered."""
    known: dict[str, tuple] = {}
    for some in texts:
        parts = [pieces.segments(t or "") for t in some]
        missing = [s for s in dict.fromkeys(s for p in parts for s in p) if s not in known]
        for s, ids in zip(missing, pieces.encode_segments(missing), strict=True):
            known[s] = make(ids)
        yield ([known[s] for s in p] for p in parts)
        if len(known) > REMEMBERED:
            known.clear()


def tokenized(docs: DataFrame, pieces: Pieces, text_col="text") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``decoded_sha256`` (of the decoded ids) of its whole texts.

    Columns of these names are replaced; a null text counts as empty.  Ids
    leave the task a few hundred texts at a time.
    """
    names = ("ids", "n_tokens", "decoded_sha256")

    def encoded(texts):
        make = lambda ids: (np.array(ids, dtype=np.int32).tobytes(), pieces.spell(ids))
        for some in _remembered(texts, pieces, make):
            rows = []
            for got in some:
                ids = np.frombuffer(b"".join([x[0] for x in got]), dtype=np.int32)
                first, sha = int(ids[0]) if len(ids) else -1, hashlib.sha256()
                for k, x in enumerate(got):
                    sha.update((x[1] if k else pieces.trimmed(x[1], first)).encode("utf-8", "surrogatepass"))
                rows.append((ids, len(ids), sha.hexdigest()))
            yield pd.DataFrame(rows, columns=list(names))

    d = docs.drop(*names)
    return map_texts(d, encoded, "ids array<int>, n_tokens long, decoded_sha256 string", d.columns, SLICE, text_col)


def round_trip(docs: DataFrame, pieces: Pieces, text_col="text", id_col="doc_id") -> DataFrame:
    """Number of ids and digests of the ids and of their decoded text, of every whole text.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per row;
    a null text counts as empty: no ids, digests of the empty string.  Other
    columns are not read.  The ids themselves stay in the task: a segment's
    ids, their decimal form and their text are kept for its next occurrence.
    """

    def digests(texts):
        make = lambda ids: (len(ids), ",".join(map(str, ids)), pieces.spell(ids), ids[0])
        for some in _remembered(texts, pieces, make):
            rows = []
            for got in some:
                text = pieces.trimmed("".join([x[2] for x in got]), got[0][3] if got else -1)
                rows.append((sum([x[0] for x in got]), hashlib.sha256(",".join([x[1] for x in got]).encode()).hexdigest(),
                             hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(d, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"], SLICE)
