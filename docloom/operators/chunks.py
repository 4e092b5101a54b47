"""Chunks of Markdown within a token budget: sections at headings, then ever finer cuts; nothing is lost or added."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, TITLE = 2048, 200
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]")


def token_length(text: str) -> int:
    """The default length, which needs no vocabulary; approx_tokens is the same as an expression."""
    return len(_TOKEN.findall(text))


def sections(text: Column) -> Column:
    """array<string>: the text cut in front of each line end that a heading follows."""
    return F.split(text, r"(?=\n#{1,6} )", -1)


def header_sections(text: Column) -> Column:
    """array<string>: the text cut in front of level-one and level-two headings."""
    return F.split(text, r"(?m)(?=^#{1,2} )", -1)


def _merged(pieces: list[str], size: int, length: Callable[[str], int]) -> list[str]:
    out, held, total = [], [], 0
    for piece in pieces:
        n = length(piece)
        if held and total + n > size:
            out.append("".join(held))
            held, total = [], 0
        held.append(piece)
        total += n
    return [*out, "".join(held)] if held else out


def split_text(text: str, size: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", ""), at_end: bool = True, length: Callable[[str], int] = token_length) -> list[str]:
    """Chunks of at most size; pieces at the first separator that occurs are packed in order, those too long are cut at
    the following ones. Separators stay at a piece's end. A single character may exceed the budget."""
    if length(text) <= size:
        return [text] if text else []
    for k, mark in enumerate(separators):
        if mark == "":
            return _merged(list(text), size, length)
        if mark in text:
            pieces = re.split(f"(?<={re.escape(mark)})" if at_end else f"(?={re.escape(mark)})", text)
            break
    else:
        return [text]
    out, held = [], []
    for piece in filter(None, pieces):
        if length(piece) <= size:
            held.append(piece)
        else:
            out += _merged(held, size, length)
            out += split_text(piece, size, separators[k + 1 :], at_end, length)
            held = []
    return out + _merged(held, size, length)


def split_markdown(text: str, size: int = SIZE, title: int = TITLE, length: Callable[[str], int] = token_length) -> list[str]:
    """Sections packed up to size and title, then each cut to size. Joined, the chunks are the text."""
    parts = [p for p in re.split(r"(?=\n#{1,6} )", text) if p]
    packed: list[str] = []
    held: list[str] = []
    for p in parts:
        if length(p) <= size + title:
            held.append(p)
        else:
            packed += [*_merged(held, size + title, length), p]
            held = []
    packed += _merged(held, size + title, length)
    return [c for p in packed for c in split_text(p, size, length=length)]


def chunk(documents: DataFrame, size: int = SIZE, title: int = TITLE, length: Callable[[str], int] = token_length, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk_no (from 0), text, n_tokens; null and empty texts have no chunk."""
    @F.pandas_udf("array<struct<text: string, n_tokens: int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"text": c, "n_tokens": length(c)} for c in split_markdown(t, size, title, length)] if t else [] for t in texts])

    rows = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(cut(F.col(text_col))).alias("chunk_no", "c"))
    return rows.select("doc_id", "chunk_no", "c.text", "c.n_tokens")
