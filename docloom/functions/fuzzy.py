"""Fuzzy equality of titles by edit distance."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType  # objects, as workers have no session to parse names

from docloom.functions.text import strip

EDIT_MAX, EDIT_RATE = 10, 0.3
#: Words that outline titles like to start with.
TITLE_STARTS = ("part", "chapter", "appendix")
#: Marks that don't count as a difference, and how many others may differ.
FREE_MARKS = ("$", " ", " ")
ALLOWED = 3
#: Rows of the table of distances that are kept for the steps back.
BAND = 64


def edit_limit(title: Column, most: int = EDIT_MAX, rate: float = EDIT_RATE) -> Column:
    return F.least(F.lit(most), F.floor(F.length(title) * F.lit(rate)).cast("int"))


def titles_match(block: Column, title: Column, most: int = EDIT_MAX, rate: float = EDIT_RATE) -> Column:
    """Equal but for case and outer white space, or within the limit (inclusive). An empty block text matches nothing."""
    a, b = F.lower(strip(block)), F.lower(strip(title))
    return (a != "") & ((a == b) | (F.levenshtein(a, b) <= edit_limit(b, most, rate)))


def joined_titles_match(upper: Column, lower: Column, title: Column, most: int = EDIT_MAX, rate: float = EDIT_RATE) -> Column:
    """The texts of two blocks, one after the other, against a title."""
    a, b = F.lower(F.concat(upper, lower)), F.lower(title)
    return (a == b) | (F.levenshtein(a, b) <= edit_limit(b, most, rate))


def may_start(block: Column, title: Column, starts: tuple[str, ...] = TITLE_STARTS) -> Column:
    """The block's text starts the title, or both start with the same usual word."""
    a, b = F.lower(block), F.lower(title)
    out = b.startswith(a)
    for s in starts:
        out = out | (a.startswith(s) & b.startswith(s))
    return out


def _table(a: str, b: str) -> np.ndarray:
    """Distances between all beginnings, by anti-diagonal-free rows: a running minimum gives the insertions of a row."""
    chars = np.array([ord(c) for c in b], np.int64)
    out = np.empty((len(a) + 1, len(b) + 1), np.int64)
    out[0] = steps = np.arange(len(b) + 1)
    for i, c in enumerate(a, 1):
        row = np.empty(len(b) + 1, np.int64)
        row[0] = i
        row[1:] = np.minimum(out[i - 1, 1:] + 1, out[i - 1, :-1] + (chars != ord(c)))
        out[i] = np.minimum.accumulate(row - steps) + steps
    return out


def _below(row: np.ndarray, c: str, chars: np.ndarray) -> np.ndarray:
    """The row of distances after one more character c; rows may be cut on the right."""
    steps = np.arange(len(row))
    out = np.empty(len(row), np.int64)
    out[0] = row[0] + 1
    out[1:] = np.minimum(row[1:] + 1, row[:-1] + (chars[: len(row) - 1] != ord(c)))
    return np.minimum.accumulate(out - steps) + steps


def edits(a: str, b: str) -> list[tuple[str, str]]:
    """How a becomes b, from the end: (character, SKIP, ADD, REPLACE or DEL). Equal characters are skipped; of equally
    short ways, deletion comes before addition before replacement.

    At most BAND rows of distances and one for each halving of a down to BAND are held at a time."""
    chars, out = np.array([ord(c) for c in b], np.int64), []

    def back(lo: int, hi: int, top: np.ndarray, j: int) -> int:
        """Steps from (hi, j) up to row lo, whose distances are top; the column reached."""
        if hi - lo > BAND:
            mid = (lo + hi) // 2
            row = top
            for c in a[lo:mid]:
                row = _below(row, c, chars)
            j = back(mid, hi, row, j)
            return back(lo, mid, top[: j + 1], j)
        d = [top]
        for c in a[lo:hi]:
            d.append(_below(d[-1], c, chars))
        i = hi
        while i > lo:
            if not j:
                step = "DEL"
            elif a[i - 1] == b[j - 1]:
                step = "SKIP"
            else:
                up, here = d[i - 1 - lo], d[i - lo]
                step = min(("DEL", up[j]), ("ADD", here[j - 1]), ("REPLACE", up[j - 1]), key=lambda x: x[1])[0]
            out.append((a[i - 1] if step in ("SKIP", "DEL") else b[j - 1], step))
            i, j = i - (step != "ADD"), j - (step != "DEL")
        return j

    j = back(0, len(a), np.arange(len(b) + 1), len(b))
    return out + [(c, "ADD") for c in reversed(b[:j])]


def same_heading(source: str, other: str, allowed: int = ALLOWED, free: tuple[str, ...] = FREE_MARKS) -> bool:
    """Equal but for outer white space, or differing by few characters, free ones not counted."""
    source, other = source.strip(), other.strip()
    if source == other:
        return True
    # each character that other has more of comes from a step of its own
    if sum(n for c, n in (Counter(other) - Counter(source)).items() if c not in free) > allowed:
        return False
    return sum(step != "SKIP" and c not in free for c, step in edits(source, other)) <= allowed


@F.pandas_udf(ArrayType(StructType([StructField("ch", StringType()), StructField("op", StringType())])))
def edit_trace(a: pd.Series, b: pd.Series) -> pd.Series:
    """All steps, SKIP too; null where either is null."""
    return pd.Series([None if x is None or y is None else [{"ch": c, "op": s} for c, s in edits(x, y)] for x, y in zip(a, b)])


@F.pandas_udf(BooleanType())
def is_same_heading(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else same_heading(x, y) for x, y in zip(a, b)])
