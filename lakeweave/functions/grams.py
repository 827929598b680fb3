"""Character n-grams that two texts have in common, counted for many pairs at once.

A pair's grams are numbers, made for a slice of a batch with NumPy; no array of strings
is made for a row, stored or shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Code points of a slice (a longer pair is a slice by itself), and lengths of grams.
SLICE, LENGTHS = 1 << 17, (3, 4)
SHARES = StructType([StructField(f"char{n}", DoubleType()) for n in LENGTHS])


def jaccard(one: Sequence[str], two: Sequence[str], lengths: Sequence[int] = LENGTHS) -> list[np.ndarray]:
    """For each length n, rising: of the distinct n-grams of each two texts; a shorter text is its own gram, and an empty one gives 0."""
    texts, gap = [t for pair in zip(one, two, strict=True) for t in pair], lengths[-1] - 1
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join([t + "\0" * gap for t in texts]).encode("utf-32-le"), "<u4")
    wide = length + gap
    row = np.repeat(np.arange(len(texts)), wide)
    at = np.arange(len(row)) - np.repeat(np.cumsum(wide) - wide, wide)
    # Letters are numbered from 1; 0 stands for what a short text lacks. A gram is a number to the base of the letters there are.
    letters = np.bincount(codes, minlength=1) > 0
    codes, base = np.where(at < length[row], np.cumsum(letters)[codes], 0), int(letters.sum()) + 1
    gram, top, out = codes, base, []
    for n in range(2, lengths[-1] + 1):
        if top * base * len(texts) >= 1 << 62:
            seen, gram = np.unique(gram, return_inverse=True)
            top = len(seen)
        gram, top = gram[:-1] * base + codes[n - 1 :], top * base
        if n in lengths:
            here = at[: len(gram)] < np.where(length > 0, np.maximum(length - n + 1, 1), 0)[row[: len(gram)]]
            out.append(_shares(gram[here], row[: len(gram)][here], top, length))
    return out


def _shares(gram: np.ndarray, row: np.ndarray, top: int, length: np.ndarray) -> np.ndarray:
    """Jaccard of each two rows of grams below ``top``."""
    marked = (row // 2 * top + gram) * 2 + row % 2
    marked = np.sort(marked.astype(np.uint32) if top * len(length) < 1 << 32 else marked)
    marked = marked[np.concatenate([[True], marked[1:] != marked[:-1]])] if len(marked) else marked
    gram, n = marked >> 1, len(length) // 2
    pair = (gram // top).astype(np.int64)
    both = np.bincount(pair[1:][gram[1:] == gram[:-1]], minlength=n)
    every = np.bincount(pair, minlength=n) - both
    return np.where((length[::2] > 0) & (length[1::2] > 0), both / np.maximum(every, 1), 0.0)


@F.arrow_udf(SHARES)
def shared(one: pa.Array, two: pa.Array) -> pa.Array:
    """Jaccard of the 3-grams and of the 4-grams of two texts as they stand; null counts as empty."""
    a, b = ([t or "" for t in x.to_pylist()] for x in (one, two))
    ends = np.cumsum([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), len(a)]
    found = zip(*[jaccard(a[i:j], b[i:j]) for i, j in zip(cuts, cuts[1:])], strict=True)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.float64()) for x in found], SHARES.names)
