"""Geometry of boxes as Column expressions. A box is struct<x0, y0, x1, y1: double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that may end a line, and marks that may start one.
STOP_MARKS = (".", "!", "?", "。", "！", "？", ")", "）", '"', "”", ":", "：", ";", "；", "]", "】", "}", ">", "》", "、", ",", "，", "-", "—", "–")
START_MARKS = ("(", "（", '"', "“", "【", "{", "《", "<", "「", "『", "[")


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def overlap_share(a: Column, b: Column) -> Column:
    """Of a's area, how much b covers; a box without area has none covered."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return F.when(area(a) > 0, w * h / area(a)).otherwise(F.lit(0.0))


def row_overlap(a: Column, b: Column) -> Column:
    """Vertical overlap as a share of the lower of both heights."""
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    least = F.least(height(a), height(b))
    return F.when(least > 0, h / least).otherwise(F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def clamped(b: Column) -> Column:
    zero = lambda c: F.greatest(F.lit(0.0), c)
    return box(zero(b["x0"]), zero(b["y0"]), zero(b["x1"]), zero(b["y1"]))


def scaled(b: Column, page_w: Column, page_h: Column) -> Column:
    """Into 0 to 1000, clamped to the page, rounded half to even."""
    def one(v: Column, size: Column) -> Column:
        return F.bround(F.greatest(F.lit(0.0), F.least(v, size)) * 1000 / size, 0)

    return box(one(b["x0"], page_w), one(b["y0"], page_h), one(b["x1"], page_w), one(b["y1"], page_h))


def is_tilted(cos: Column, sin: Column) -> Column:
    """An angle of between 2 and 88 degrees either way."""
    angle = F.abs(F.degrees(F.atan2(sin, cos)))
    return (angle > 2) & (angle < 88)


def is_level(cos: Column, sin: Column) -> Column:
    return (F.abs(cos) >= 0.9) & (F.abs(sin) <= 0.1)


def glyph_in_span(glyph: Column, span: Column, mark: Column, ratio: float = 0.33) -> Column:
    """The glyph's centre lies in the span near its middle line; a stop mark may start up to a line's height before the
    span's end, a start mark may end as far after its start. All comparisons are strict."""
    cx, cy = (glyph["x0"] + glyph["x1"]) / 2, (glyph["y0"] + glyph["y1"]) / 2
    high = height(span)
    level = (cy > span["y0"]) & (cy < span["y1"]) & (F.abs(cy - (span["y0"] + span["y1"]) / 2) < high * ratio)
    inside = (cx > span["x0"]) & (cx < span["x1"])
    stop = mark.isin(*STOP_MARKS) & (glyph["x0"] > span["x1"] - high) & (glyph["x0"] < span["x1"]) & (cx > span["x0"])
    start = mark.isin(*START_MARKS) & (glyph["x1"] > span["x0"]) & (glyph["x1"] < span["x0"] + high) & (cx < span["x1"])
    return level & (inside | stop | start)


def synthetic_lines(b: Column, line_h: Column, page_w: Column, page_h: Column) -> Column:
    """array<box>: the lines a block without text lines is taken to have, top down, by its shape on the page."""
    w, h = width(b), height(b)
    def cut(n: Column, step: Column) -> Column:
        return F.struct(n.cast("int").alias("n"), step.cast("double").alias("step"))

    by_height = cut(F.floor(h / line_h) + 1, line_h)
    one, two, three = cut(F.lit(1), h), cut(F.lit(2), h / 2), cut(F.lit(3), h / 3)
    column = (h > page_h * 0.25) & (w > page_w * 0.25) & (w < page_w * 0.5)
    kind = F.when(line_h * 2 >= h, one).when(column, by_height).when(w > page_w * 0.4, three).when(w > page_w * 0.25, by_height).when(h / w > 1.2, one).otherwise(two)
    made = F.transform(F.array(kind), lambda k: F.transform(F.sequence(F.lit(0), k["n"] - 1), lambda i: box(b["x0"], b["y0"] + k["step"] * i, b["x1"], b["y0"] + k["step"] * (i + 1))))
    return made[0]


def from_crop(b: Column, crop: Column) -> Column:
    """A box of a pasted crop back on its page; crop: struct<paste_x, paste_y, xmin, ymin>."""
    x = lambda v: v - crop["paste_x"] + crop["xmin"]
    y = lambda v: v - crop["paste_y"] + crop["ymin"]
    return box(x(b["x0"]), y(b["y0"]), x(b["x1"]), y(b["y1"]))


def poly_box(poly: Column) -> Column:
    """The box of eight corner numbers: the first and the third corner."""
    at = lambda i: F.get(poly, F.lit(i))
    return box(at(0), at(1), at(4), at(5))
