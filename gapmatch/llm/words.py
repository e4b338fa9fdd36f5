"""Words and shingles of texts as numpy arrays, for code inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_BLANK = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash, remembered; ``trim`` bounds the memory."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))

    def trim(self, most: int = 400_000) -> None:
        if len(self) > most:
            self.clear()


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8; ``lower`` maps A-Z only."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return (b.lower() if lower else b).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well mixed bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(33))


def shingles(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all windows of ``width`` words; fewer words are one window, none is none."""
    n = len(h)
    if n == 0:
        return h
    if n < width:
        return shingles(h, n) ^ np.uint64(n)
    out = mix64(h[:n - width + 1] + _STEP)
    for k in range(1, width):
        out = mix64(out + h[k:n - width + 1 + k])
    return out


def statistics(text: str | None, hashes: WordHashes) -> tuple:
    """Counts of one whole text, see STATISTICS; a null text is empty."""
    text = text or ""
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    n = len(words)
    lines = text.split("\n")
    kept = [x for x in lines if x.strip(" \t\x0b\x0c\r")]
    blanks = len(b) - len(b.translate(None, _BLANK))
    repeat = 0
    if n >= 6:
        w = shingles(hashes.of(words))
        s = np.sort(w)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(w, twice))
            cover = np.zeros(n + 1, dtype=np.int32)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
            repeat = int((np.cumsum(cover[:n]) > 0).sum())
    return (n, len(text) - blanks, len(b) - len(b.translate(None, _SYMBOLS)), len(kept) - len(set(kept)), repeat,
            len(text), len(lines), len(set(words)), b)


#: What ``statistics`` counts; the last is the text in UTF-8.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines",
              "n_distinct", "utf8")
