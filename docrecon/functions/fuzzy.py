"""Similarities of strings as column expressions, from the length of the longest common subsequence.

The subsequence comes from the bit-parallel recurrence: one long integer holds the dynamic programme's row for the
shorter string, and each character of the longer one is a few operations on it. Strings longer than the integer take the
row as an array. ``lcs_pairs`` does the same for many pairs at once, in vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 62


def once(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: a lambda variable holds it, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ordered(a: Column, b: Column, body) -> Column:
    """``body`` of the shorter and the longer string."""
    return once(F.struct(F.when(F.length(a) > F.length(b), b).otherwise(a).alias("s"), F.when(F.length(a) > F.length(b), a).otherwise(b).alias("l")), lambda p: body(p["s"], p["l"]))


def _by_bits(short: Column, long: Column) -> Column:
    one = F.lit(1).cast("long")
    bits = F.transform(F.split(short, ""), lambda c, i: F.struct(c.alias("c"), F.call_function("shiftleft", one, i).alias("b")))

    def rows(p: Column) -> Column:
        mask = lambda ch: F.aggregate(p["bits"], F.lit(0).cast("long"), lambda m, x: F.when(x["c"] == ch, m + x["b"]).otherwise(m))
        row = F.aggregate(F.transform(F.split(long, ""), mask), p["full"], lambda r, m: (r + r.bitwiseAND(m)).bitwiseOR(r - r.bitwiseAND(m)).bitwiseAND(p["full"]))
        return F.length(short) - F.bit_count(row)

    return once(F.struct(bits.alias("bits"), (F.call_function("shiftleft", one, F.length(short)) - one).alias("full")), rows)


def _by_rows(a: Column, b: Column) -> Column:
    width = F.length(b)

    def step(row: Column, ch: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), width),
            F.array(F.lit(0)),
            lambda new, j: F.concat(new, F.array(F.when(F.substring(b, j, F.lit(1)) == ch, F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(new, -1))))),
        )

    return F.element_at(F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), width + 1), step), -1)


def _lcs_ordered(short: Column, long: Column) -> Column:
    return F.when(F.length(short) == 0, 0).when(F.length(short) <= BITS, _by_bits(short, long)).otherwise(_by_rows(long, short))


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    return _ordered(a, b, _lcs_ordered)


def ratio(a: Column, b: Column) -> Column:
    """200 times the common subsequence over both lengths; two empty strings are alike."""
    return _ordered(a, b, lambda s, l: F.when(F.length(l) == 0, 100.0).otherwise(200.0 * _lcs_ordered(s, l) / (F.length(s) + F.length(l))))


def partial_ratio(a: Column, b: Column) -> Column:
    """The best ratio of the shorter string with a window of its length of the longer, windows cut off at the ends included."""

    def best(short: Column, long: Column) -> Column:
        m, n = F.length(short), F.length(long)
        window = lambda i: F.substring(long, F.greatest(i, F.lit(1)), F.least(i + m - 1, n) - F.greatest(i, F.lit(1)) + 1)
        of = lambda w: 200.0 * F.when(F.length(short) <= BITS, _by_bits(short, w)).otherwise(_by_rows(w, short)) / (m + F.length(w))
        return F.when((m == 0) | (n == 0), F.when(m == n, 100.0).otherwise(0.0)).otherwise(F.array_max(F.transform(F.array_distinct(F.transform(F.sequence(2 - m, n), window)), of)))

    return _ordered(a, b, best)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity of the words of two normalised strings, whatever their order and with words that one has alone."""
    x, y = (F.array_distinct(F.filter(F.split(c, " "), lambda w: w != "")) for c in (a, b))
    words = lambda c: F.array_join(F.array_sort(c), " ")
    both, left, right = words(F.array_intersect(x, y)), words(F.array_except(x, y)), words(F.array_except(y, x))
    shared, n, p, q = F.size(F.array_intersect(x, y)) > 0, F.length(both), F.length(left), F.length(right)
    gap = F.when(shared, 1).otherwise(0)
    with_left, with_right = n + gap + p, n + gap + q
    apart = p + q - 2 * lcs(left, right)
    whole = with_left + with_right
    first = 100.0 * (1.0 - apart / whole)
    one = lambda part: F.when(shared, 200.0 * n / (2 * n + gap + part)).otherwise(0.0)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(shared & ((p == 0) | (q == 0)), 100.0).otherwise(F.greatest(first, one(p), one(q)))


def name_score(a: Column, b: Column) -> Column:
    """Similarity of two normalised company names: 0 if either is empty."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 100.0).otherwise(token_set_ratio(a, b))


def name_scores(a: Column, b: Column) -> Column:
    """``name_score`` of each row's two names, null where one is. For whole tables: a batch's pairs recur (a supplier's
    folder holds many of its invoices), so each is worked out once, on integers, and not as an expression for each row."""

    @F.pandas_udf("double")
    def scores(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float | None] = {}
        for pair in zip(a, b, strict=True):
            if pair not in known:
                known[pair] = None if None in pair else name_score_of(*pair)
        return pd.Series([known[pair] for pair in zip(a, b, strict=True)], dtype="float64")

    return scores(a, b)


def name_score_of(a: str, b: str) -> float:
    """``name_score`` of two strings."""
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    x, y = (list(dict.fromkeys(w for w in s.split(" ") if w)) for s in (a, b))
    if not x or not y:
        return 0.0
    both = [w for w in x if w in y]
    left, right = (" ".join(sorted(w for w in own if w not in both)) for own in (x, y))
    if both and not (left and right):
        return 100.0
    n, gap = len(" ".join(both)), min(len(both), 1)
    whole = 2 * (n + gap) + len(left) + len(right)
    one = [200.0 * n / (2 * n + gap + len(part)) if both else 0.0 for part in (left, right)]
    return max(100.0 * (1.0 - (len(left) + len(right) - 2 * _common(left, right)) / whole), *one)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer of any length."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def lcs_pairs(left: list[str], right: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common subsequences of the pairs ``left[x]``, ``right[y]``: the bit-parallel recurrence on vectors of pairs."""
    letters = {ch: i + 1 for i, ch in enumerate(sorted({c for s in (*left, *right) for c in s}))}
    masks = np.zeros((len(left), len(letters) + 1), np.uint64)
    for i, s in enumerate(left):
        if len(s) <= BITS:
            for k, ch in enumerate(s):
                masks[i, letters[ch]] |= np.uint64(1 << k)
    n = np.array([len(s) for s in left])
    width = max((len(s) for s in right), default=0)
    codes = np.zeros((len(right), width), np.int64)  # 0: past the end, which matches nothing
    for j, s in enumerate(right):
        codes[j, : len(s)] = [letters[ch] for ch in s]
    ends = np.array([len(s) for s in right], np.int64)
    full = np.where(n <= BITS, (np.uint64(1) << np.minimum(n, BITS).astype(np.uint64)) - np.uint64(1), np.uint64(0))[x]
    row = full.copy()
    for k in range(int(ends[y].max()) if len(y) else 0):
        hit = row & masks[x, codes[y, k]]
        row = (row + hit | row - hit) & full
    out = n[x] - np.bitwise_count(row).astype(np.int64)
    for p in np.flatnonzero(n[x] > BITS):
        out[p] = _common(left[x[p]], right[y[p]])
    return out
