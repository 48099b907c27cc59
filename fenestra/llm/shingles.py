"""Hashes of words and of runs of words, made in bulk inside tasks."""

from __future__ import annotations

from collections.abc import Collection

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 64-bit cells of a bitmap of repeated hashes: 16 MB. With many more hashes than bits it lets more rows through; results don't change.
CELLS = 1 << 21

#: Word hashes remembered by a worker; the table is emptied when full.
MEMO, MEMO_BYTES = 200_000, 64
_STEP, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """A map from words (bytes) to 64-bit hashes that fills itself."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h

    def of(self, words: Collection[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _STEP and of its inverse by 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 300_000)
        for k, base in enumerate((int(_STEP), pow(int(_STEP), -1, 1 << 64))):
            _powers[k] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
    return _powers[0][:n], _powers[1][:n]


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, by their first word; none if there are fewer words.

    The words' hashes are coefficients of a polynomial by 2**64, so a run's sum is a difference of two running sums.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(h))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
        return mixed((sums[width:] - sums[:n]) * down[:n] + np.uint64(width))


def texts_hashed(column, hashes: WordHashes, fold: bool = False, most: int = 150_000):
    """For runs of texts with `most` words or little more: the first text's place in the column, words of each text, and hashes of all their words.

    Many short texts share the cost of array operations. With `fold`, A-Z are lower-cased. Words are what ASCII white space separates.
    """
    start, words, sizes = 0, [], []
    for text in column:
        found = (text.as_py() or b"")
        found = found.lower().split() if fold else found.split()  # bytes: only A-Z change, only ASCII white space splits
        words += found
        sizes.append(len(found))
        if len(words) >= most:
            yield start, np.array(sizes, np.int64), hashes.of(words)
            start, words, sizes = start + len(sizes), [], []
    if sizes:
        yield start, np.array(sizes, np.int64), hashes.of(words)


def inside(sizes: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the n runs of `width` words over all texts lie in one text."""
    ends = np.repeat(np.cumsum(sizes), sizes)[:n]
    return np.arange(n) + width <= ends


def shingle_sets(column, hashes: WordHashes, width: int):
    """For each text of a column: its place there and its distinct runs of `width` lower-cased words, ascending; of fewer words, the whole sequence as one; of none, nothing."""
    for start, sizes, h in texts_hashed(column, hashes, fold=True):
        every, at = runs(h, width), 0
        for i, n in enumerate(sizes.tolist()):
            s = np.sort(every[at : at + n - width + 1] if n >= width else runs(h[at : at + n], n) if n else h[:0])
            if len(s) > 1:
                new = s[1:] != s[:-1]
                if not new.all():
                    s = s[np.concatenate([[True], new])]
            yield start + i, s
            at += n


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of rows of `hash`. The driver gets CELLS numbers at most."""
    cell, bit = F.pmod("hash", F.lit(CELLS)).cast("int"), F.expr("shiftleft(1L, int(shiftrightunsigned(hash, 58)))")
    cells = hashes.select(cell.alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(CELLS, np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def repeated(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the hashes that several documents have, from rows of hash and doc_id."""
    return bitmap(hashes.groupBy("hash").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y"))


def meets(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the bitmap; false hits occur, misses don't."""
    cell = np.mod(h.view(np.int64), CELLS)  # as pmod of the signed number
    return (bitmap[cell] >> (h >> np.uint64(58)) & np.uint64(1)).astype(bool)
