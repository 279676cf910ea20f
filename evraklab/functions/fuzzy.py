"""Partial string similarity as one Arrow UDF."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = 64
# A shorter string of at least this length can round up to 100 without being
# a substring, so exact containment may not stand in for the score any more.
ROUNDING_LENGTH = 100
# Windows scored in one vector step; bounds the memory of a batch.
_WINDOWS_PER_STEP = 1 << 20


def _window_lcs(masks: np.ndarray, length: int) -> np.ndarray:
    """Longest common subsequence of a pattern with every window of a text.

    ``masks[p, k]`` holds word ``k`` of the pattern positions equal to the text
    character at ``p``; a window is ``length`` consecutive characters. One row
    of bit-parallel state per window advances by a character per step, with the
    carry running through the words.
    """
    words = masks.shape[1]
    windows = masks.shape[0] - length + 1
    state = np.full((words, windows), np.uint64(0xFFFFFFFFFFFFFFFF))
    for step in range(length):
        carry = np.zeros(windows, dtype=np.uint64)
        for k in range(words):
            here = masks[step : step + windows, k]
            row = state[k]
            hit = row & here
            total = row + hit
            spill = total < hit
            total2 = total + carry
            carry = (spill | (total2 < carry)).astype(np.uint64)
            state[k] = total2 | (row & ~here)
    return np.bitwise_count(~state).astype(np.int64).sum(axis=0)


def _score_bucket(pairs: list[tuple[str, str]], length: int) -> np.ndarray:
    """Scores of pairs whose shorter string has ``length`` characters."""
    words = -(-length // _WORD)
    pad = length - 1
    values: list[list[int]] = [[] for _ in range(words)]
    lengths: list[int] = []
    for short, long in pairs:
        where: dict[str, int] = {}
        for i, ch in enumerate(short):
            where[ch] = where.get(ch, 0) | (1 << i)
        row = [where.get(ch, 0) for ch in long]
        for k in range(words):
            out = values[k]
            out.extend([0] * pad)
            out.extend(((m >> (_WORD * k)) & 0xFFFFFFFFFFFFFFFF) for m in row)
        lengths.append(len(long))
    for k in range(words):
        values[k].extend([0] * pad)
    masks = np.array(values, dtype=np.uint64).T.reshape(-1, words)
    lcs = _window_lcs(masks, length)

    # Pair i owns the windows that begin from ``pad`` before its text up to its
    # last character; windows hanging over an edge see fewer characters.
    n = np.array(lengths)
    owned = n + pad
    starts = np.concatenate(([0], np.cumsum(owned)[:-1]))
    offset = np.arange(owned.sum()) - np.repeat(starts, owned) - pad
    n_rep = np.repeat(n, owned)
    seen = np.minimum(offset + length, n_rep) - np.maximum(offset, 0)
    score = 200.0 * lcs[: owned.sum()] / (length + seen)
    return np.maximum.reduceat(score, starts)


def partial_scores(left: list[str], right: list[str]) -> np.ndarray:
    """Partial ratio (0-100, rounded) of aligned lists of strings."""
    unique: dict[tuple[str, str], int] = {}
    index = np.empty(len(left), dtype=np.int64)
    for i, (a, b) in enumerate(zip(left, right)):
        index[i] = unique.setdefault((a, b) if len(a) <= len(b) else (b, a), len(unique))
    result = np.zeros(len(unique))
    buckets: dict[int, list[tuple[int, tuple[str, str]]]] = {}
    for pair, i in unique.items():
        short, long = pair
        if not short:
            result[i] = 0.0 if long else 100.0
        else:
            buckets.setdefault(len(short), []).append((i, pair))
            if len(short) == len(long) and short != long:
                # Equal lengths may overhang on either side: take both roles.
                buckets[len(short)].append((i, (long, short)))
    for length, items in buckets.items():
        at = 0
        while at < len(items):
            size, stop = 0, at
            while stop < len(items) and (stop == at or size < _WINDOWS_PER_STEP):
                size += len(items[stop][1][1]) + length
                stop += 1
            group = items[at:stop]
            scores = _score_bucket([pair for _, pair in group], length)
            np.maximum.at(result, [i for i, _ in group], scores)
            at = stop
    return np.rint(result)[index]


@F.pandas_udf(T.DoubleType())
def _partial_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=left.index)
    known = left.notna() & right.notna()
    if known.any():
        out[known] = partial_scores(left[known].tolist(), right[known].tolist())
    return out


# Declared non-deterministic only so that a filter on the score is not pushed
# below it, which would compute every score twice.
_score_once = _partial_ratio.asNondeterministic()


def partial_ratio(left: Column, right: Column) -> Column:
    """Best similarity (0-100) of the shorter string with any stretch of the longer."""
    return _score_once(left, right)


BEST = T.ArrayType(
    T.StructType([T.StructField("score", T.DoubleType()), T.StructField("at", T.IntegerType())])
)


@F.arrow_udf(BEST)
def _best_of(targets: pa.Array, texts: pa.Array) -> pa.Array:
    per_row = targets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    lists = texts.flatten()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    wanted = targets.flatten().take(pa.array(owner)).to_pylist()
    scores = partial_scores(wanted, lists.flatten().to_pylist())
    order = np.lexsort((np.arange(len(owner)), -scores, owner))
    found, first = np.unique(owner[order], return_index=True)
    best = order[first]
    score, at, none = np.zeros(len(sizes)), np.zeros(len(sizes), np.int32), np.ones(len(sizes), bool)
    score[found], none[found] = scores[best], False
    at[found] = best - (np.cumsum(sizes) - sizes)[found]
    values = pa.StructArray.from_arrays([pa.array(score, mask=none), pa.array(at, mask=none)], ["score", "at"])
    offsets = np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


_best_once = _best_of.asNondeterministic()


def best_of(targets: Column, texts: Column) -> Column:
    """For each of ``targets`` the best partial ratio in its list of ``texts``, and where.

    array<struct(score, at)>; the earliest of equals, nulls for an empty list. Rows with
    null ``targets`` must have null ``texts`` and yield an empty array.
    """
    return _best_once(targets, texts)


def contains_exactly(left: Column, right: Column) -> Column:
    """True where one string holds the other, which alone scores a plain 100."""
    return (
        (left != "")
        & (right != "")
        & (F.contains(left, right) | F.contains(right, left))
    )


def may_reach(left: Column, right: Column, score: int) -> Column:
    """Necessary condition for a rounded partial ratio above ``score``; JVM-side.

    A ratio r of a shorter string of length m needs a common subsequence of at
    least ``m * r / (200 - r)`` characters, and characters the longer string
    lacks cannot be in it.
    """
    least = (score + 0.5) / (200.0 - (score + 0.5))

    def enough(short: Column, long: Column) -> Column:
        present = F.length(short) - F.length(F.call_function("translate", short, long, F.lit("")))
        return present >= F.length(short) * F.lit(least) - F.lit(1e-9)

    by_length = F.when(F.length(left) <= F.length(right), enough(left, right)).otherwise(
        enough(right, left)
    )
    return F.when((left != "") & (right != ""), by_length).otherwise((left == "") & (right == ""))
