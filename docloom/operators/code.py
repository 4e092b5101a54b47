"""Fenced code in Markdown lines: where it is, and lines too long for a page."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from docloom.functions import text as T

#: Fixed values of the formatter: width, marks to cut before and after, extra indent of what follows.
WIDTH, BEFORE, AFTER, INDENT = 80, (".", "-", "+", "/", "*"), (" ", ",", "(", ")", ";", ":"), 4
FENCE = "```"


def fence_state(lines: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """lines (doc_id, line_no, line) with in_code (int): 1 where code is open after the line.

    Without languages any fence counts: a bare one toggles, one with a language opens. With languages, fences of others
    are ordinary lines; a listed one opens and a bare one closes. Running windows of a document, no Python."""
    line = T.strip(F.col("line"))
    bare = line == FENCE
    upto = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    if languages is not None:
        listed = line.isin(*[FENCE + x for x in languages])
        mark = F.when(listed, F.lit(1)).when(bare, F.lit(0))
        return lines.withColumn("in_code", F.coalesce(F.last(mark, ignorenulls=True).over(upto), F.lit(0)))
    named = line.startswith(FENCE) & ~bare
    out = lines.withColumn("__toggles", F.sum(F.when(bare, 1).otherwise(0)).over(upto))
    out = out.withColumn("__since", F.last(F.when(named, F.col("__toggles")), ignorenulls=True).over(upto))
    state = (F.when(F.col("__since").isNull(), 0).otherwise(1) + F.col("__toggles") - F.coalesce("__since", F.lit(0))) % 2
    return out.withColumn("in_code", state.cast("int")).drop("__toggles", "__since")


def cut_places(line: str, before: tuple[str, ...], after: tuple[str, ...]) -> tuple[list[int], list[int]]:
    """Where a line may be cut: in front of the marks of before, and behind those that are of after alone."""
    marks = {c: (c in before, c in after) for c in set(line)}
    return [k for k, c in enumerate(line) if marks[c][0]], [k for k, c in enumerate(line, 1) if marks[c] == (False, True)]


def wrap(line: str, width: int = WIDTH, before: tuple[str, ...] = BEFORE, after: tuple[str, ...] = AFTER, force: bool = True, indent: int = INDENT) -> list[str]:
    """A line in pieces of at most width characters. Each cut is the last one possible: in front of a mark of before
    (not at the piece's start), or behind one of after; else at the full width, or nowhere if force is off. Pieces but
    the last end in two spaces and a line feed; those after the first are indented by the line's own indent and indent
    more, and are that much shorter, but never under one character."""
    deeper = len(line) - len(line.lstrip(" ")) + indent
    fronts, backs = cut_places(line, before, after)

    def next_cut(start: int, room: int) -> int | None:
        last_front, last_back = bisect_left(fronts, start + room), bisect_right(backs, start + room)
        best = max([0, *fronts[:last_front][-1:], *backs[:last_back][-1:]])
        return best if best > start else start + room if force else None

    cuts = [0]
    room = width
    while len(line) >= width and len(line) > cuts[-1] + room and (cut := next_cut(cuts[-1], room)):
        cuts.append(cut)
        room = max(1, width - deeper)
    parts = [line[i:j] for i, j in zip(cuts, [*cuts[1:], len(line)])]
    lead = ["", *[" " * deeper] * (len(parts) - 1)]
    return [x + p + ("" if k == len(parts) else "  \n") for k, (x, p) in enumerate(zip(lead, parts), 1)]


@F.pandas_udf(ArrayType(StringType()))
def wrapped(line: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else wrap(x) for x in line])


def format_code(lines: DataFrame, languages: tuple[str, ...] | None = None, inline_limit: int = T.INLINE_LIMIT) -> DataFrame:
    """doc_id, line_no, piece_no, line: long lines of code in pieces, long inline code elsewhere without its marks.
    Lines keep their ends; a line's length counts its end. Only lines that need it reach Python."""
    state = fence_state(lines, languages)
    fence = T.strip(F.col("line")).startswith(FENCE)
    long = (F.col("in_code") == 1) & ~fence & (F.length("line") > WIDTH)
    short = state.filter(~long).select("doc_id", "line_no", F.lit(0).alias("piece_no"), F.when((F.col("in_code") == 0) & ~fence, T.clean_inline(F.col("line"), inline_limit)).otherwise(F.col("line")).alias("line"))
    pieces = state.filter(long).select("doc_id", "line_no", F.posexplode(wrapped("line")).alias("piece_no", "line"))
    return short.unionByName(pieces)


def image_links(text: Column, pattern: str = r"!\[\]\(images/\w+.jpg\)") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def repair_image_links(source: Column, translated: Column, pattern: str = r"!\[\]\(images/\w+.jpg\)") -> Column:
    """The translated text with the source's image links, in order; as it is where their numbers differ."""
    links = image_links(source, pattern)
    parts = F.split(translated, pattern, -1)
    joined = F.array_join(F.zip_with(parts, links, lambda p, l: F.concat(p, F.coalesce(l, F.lit("")))), "")
    return F.when(F.size(image_links(translated, pattern)) == F.size(links), joined).otherwise(translated)
