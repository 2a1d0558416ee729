"""String similarity of the longest-matching-blocks kind: small helpers for pairs that a join has found."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def common_letters(xs: Sequence[str], ys: Sequence[str]) -> np.ndarray:
    """How many characters each of ``xs`` and each of ``ys`` have in common, repeats included (a row for each x)."""
    codes = [np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) for texts in (xs, ys)]
    letters = np.intersect1d(*codes)
    counts = []
    for texts, code in zip((xs, ys), codes, strict=True):
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        known = np.isin(code, letters)
        place = row[known] * len(letters) + np.searchsorted(letters, code[known])
        counts.append(np.bincount(place, minlength=len(texts) * len(letters)).reshape(len(texts), len(letters)))
    a, b = counts
    out = np.zeros((len(xs), len(ys)), np.float32)
    most = np.minimum(a.max(axis=0), b.max(axis=0))  # a column for the first, second, ... of each character
    letter = np.repeat(np.arange(len(letters)), most)
    nth = np.arange(len(letter)) - np.repeat(np.cumsum(most) - most, most) + 1
    for k in range(0, len(letter), 256):
        some, at = letter[k : k + 256], nth[k : k + 256]
        out += (a[:, some] >= at).astype(np.float32) @ (b[:, some] >= at).astype(np.float32).T
    return out


def _placed(texts: Sequence[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and number of the letter (len(letters) for another one) of every character of texts."""
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    at = np.searchsorted(letters, code)
    known = letters[np.minimum(at, len(letters) - 1)] == code if len(letters) else np.zeros(len(code), bool)
    return row, np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size), np.where(known, at, len(letters))


def common_sequence(xs: Sequence[str], ys: Sequence[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of xs[i] and ys[j], pair by pair; it bounds the characters in
    common blocks, which are met in the same order in both. Where a text is over 64 characters, which are the bits
    of a word, the length of the shorter text."""
    sizes = [np.array([len(t) for t in texts], dtype=np.int64) for texts in (xs, ys)]
    out = np.minimum(sizes[0][i], sizes[1][j])
    short = np.flatnonzero((sizes[0][i] <= 64) & (sizes[1][j] <= 64) & (out > 0))
    if not len(short):
        return out
    xs, ys = ([t if len(t) <= 64 else "" for t in texts] for texts in (xs, ys))
    letters = np.unique(np.frombuffer("".join(ys).encode("utf-32-le"), np.uint32))
    row, place, letter = _placed(ys, letters)
    bits = np.zeros((len(ys), len(letters) + 1), np.uint64)  # of each letter, where it stands in y
    np.bitwise_or.at(bits, (row, letter), np.uint64(1) << place.astype(np.uint64))
    row, place, letter = _placed(xs, letters)
    spelt = np.full((len(xs), 64), len(letters))
    spelt[row, place] = letter
    for k in range(0, len(short), 1 << 17):
        a, b = i[short[k : k + (1 << 17)]], j[short[k : k + (1 << 17)]]
        v = np.full(len(a), ~np.uint64(0))
        for p in range(int(sizes[0][a].max())):
            u = v & bits[b, spelt[a, p]]
            v = (v + u) | (v - u)
        out[short[k : k + (1 << 17)]] = np.bitwise_count(~v)
    return out


def ratio_column(a: Column, b: Column, least: Column) -> Column:
    """Similarity of two texts; null below ``least``. Common characters bound it, so few pairs are compared."""

    @F.pandas_udf(DoubleType())
    def of(x: pd.Series, y: pd.Series, bound: pd.Series) -> pd.Series:
        bags: dict[str, Counter] = {}
        known: dict[tuple[str, str], float] = {}
        out = []
        for s, t, low in zip(x, y, bound, strict=True):
            for text in (s, t):
                if text not in bags:
                    bags[text] = Counter(text)
            total = len(s) + len(t)
            if total and 2 * sum((bags[s] & bags[t]).values()) < (low - 1e-9) * total:
                out.append(None)
                continue
            if (s, t) not in known:
                known[s, t] = ratio(s, t)
            out.append(known[s, t] if known[s, t] >= low - 1e-9 else None)
        return pd.Series(out, dtype="float64")

    # so that a filter on it is not moved before the rows are dealt, where it would be taken a second time
    return of.asNondeterministic()(a, b, least.cast("double"))
