"""Layout elements of pages: which glyphs, spans and blocks belong together, and in what order they are read.

Boxes are struct<x0, y0, x1, y1>. Joins are by (doc_id, page_id) first, so each page's few elements meet, and the
geometric condition is a residual of that equality.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import text as T
from docloom.operators.folds import collected, folded

PAGE = ["doc_id", "page_id"]
#: Which types of block a type of span may belong to.
BLOCKS_OF_SPAN = {
    "text": ("text", "title", "image_caption", "image_footnote", "table_caption", "table_footnote", "discarded"),
    "inline_equation": ("text", "title", "image_caption", "image_footnote", "table_caption", "table_footnote", "discarded"),
    "interline_equation": ("interline_equation",),
    "image": ("image_body",),
    "table": ("table_body",),
}


def compatible(span_type: Column, block_type: Column) -> Column:
    out = F.lit(False)
    for span, blocks in BLOCKS_OF_SPAN.items():
        out = out | ((span_type == span) & block_type.isin(*blocks))
    return out


def spans_in_blocks(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Left semi join: spans that a discarded block covers by over 0.4, or a block of their class by over 0.5 (images by
    image bodies, tables by table bodies, others by any other block). spans, blocks: doc_id, page_id, type, bbox."""
    s, b = spans.alias("s"), blocks.alias("b")
    covered = G.overlap_share(F.col("s.bbox"), F.col("b.bbox"))
    kind = F.when(F.col("b.type") == "image_body", "image").when(F.col("b.type") == "table_body", "table").otherwise("other")
    own = F.when(F.col("s.type").isin("image", "table"), F.col("s.type")).otherwise("other")
    fits = F.when(F.col("b.type") == "discarded", covered > 0.4).otherwise(F.lit(False)) | ((kind == own) & (covered > 0.5))
    return s.join(b, (F.col("s.doc_id") == F.col("b.doc_id")) & (F.col("s.page_id") == F.col("b.page_id")) & fits, "left_semi")


def first_block(spans: DataFrame, blocks: DataFrame, ratio: float = 0.5, by_type: bool = False) -> DataFrame:
    """spans (doc_id, page_id, span_no, type, bbox, ...) with block_no of the first block, in block order, that covers
    them by over ratio (and suits their type); null where none does."""
    b = blocks.select(*PAGE, F.col("block_no"), F.col("type").alias("b_type"), F.col("bbox").alias("b_bbox"))
    found = spans.join(b, PAGE).filter(G.overlap_share(F.col("bbox"), F.col("b_bbox")) > ratio)
    found = found.filter(compatible(F.col("type"), F.col("b_type"))) if by_type else found
    found = found.groupBy(*PAGE, "span_no").agg(F.min("block_no").alias("block_no"))
    return spans.join(found, [*PAGE, "span_no"], "left")


def glyphs_in_spans(glyphs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, page_id, char_no, c, g_bbox, span_no: each glyph in the first span, by top and number, that holds it."""
    g = glyphs.select(*PAGE, "char_no", "c", F.col("bbox").alias("g_bbox"))
    s = spans.select(*PAGE, "span_no", F.col("bbox").alias("s_bbox"))
    found = g.join(s, PAGE).filter(G.glyph_in_span(F.col("g_bbox"), F.col("s_bbox"), F.col("c")))
    best = F.min(F.struct(F.col("s_bbox.y0").alias("y0"), "span_no")).alias("best")
    return found.groupBy(*PAGE, "char_no").agg(best, F.first("c").alias("c"), F.first("g_bbox").alias("g_bbox")).select(*PAGE, "char_no", "c", "g_bbox", F.col("best.span_no").alias("span_no"))


def span_text(placed: DataFrame) -> DataFrame:
    """doc_id, page_id, span_no, content: glyphs by centre, a space where the gap to the next exceeds a quarter of the
    mean width and neither is one; then ligatures and replacement marks. placed: what glyphs_in_spans gives."""
    key = [*PAGE, "span_no"]
    order = W.partitionBy(*key).orderBy("cx", "char_no")
    rows = placed.withColumn("cx", (F.col("g_bbox.x0") + F.col("g_bbox.x1")) / 2)
    mean = F.avg(G.width(F.col("g_bbox"))).over(W.partitionBy(*key))
    rows = rows.withColumn("mean", mean).withColumn("next", F.lead(F.struct(F.col("g_bbox.x0").alias("x0"), "c")).over(order))
    gap = (F.col("next.x0") - F.col("g_bbox.x1") > F.col("mean") * 0.25) & (F.col("c") != " ") & (F.col("next.c") != " ")
    rows = rows.withColumn("shown", F.when(gap, F.concat("c", F.lit(" "))).otherwise(F.col("c")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cx", "char_no", "shown"))), lambda x: x["shown"]), "")
    return rows.groupBy(*key).agg(T.replacement_to_space(T.expand_ligatures(joined)).alias("content"))


def needs_reading(spans: DataFrame) -> DataFrame:
    """Spans whose text is too short for their box: length * height < width / 2."""
    return spans.filter(F.length("content") * G.height(F.col("bbox")) < G.width(F.col("bbox")) * 0.5)


def vertical_spans(spans: DataFrame) -> DataFrame:
    """Spans over three times as high as the page's median span and as they are wide."""
    h = G.height(F.col("bbox"))
    median = spans.groupBy(*PAGE).agg(F.median(h).alias("median_h"))
    return spans.join(median, PAGE).filter((h > F.col("median_h") * 3) & (h > G.width(F.col("bbox")) * 3))


def line_height(lines: DataFrame) -> DataFrame:
    """doc_id, page_id, line_h: the median of the heights' whole parts; 10 where a page has none."""
    return lines.groupBy(*PAGE).agg(F.coalesce(F.median(G.height(F.col("bbox")).cast("int")), F.lit(10.0)).alias("line_h"))


def block_index(lines: DataFrame) -> DataFrame:
    """doc_id, page_id, block_no, idx: the median position of a block's lines; lines: block_no, position."""
    return lines.groupBy(*PAGE, "block_no").agg(F.median("position").alias("idx"))


def numbered_lines(lines: DataFrame, index: DataFrame) -> DataFrame:
    """lines with line_index from 1 on each page, by their block's index, the block and their place in it."""
    order = W.partitionBy(*PAGE).orderBy("idx", "block_no", "line_no")
    return lines.join(index, [*PAGE, "block_no"]).withColumn("line_index", F.row_number().over(order))


def nested_groups(parts: DataFrame) -> DataFrame:
    """doc_id, page_id, group_id, idx (median), bbox (of the first body), blocks (array, in order) of each group.
    parts: group_id, block_no, role, bbox, idx."""
    first = F.min(F.when(F.col("role") == "body", F.struct("block_no", "bbox")))
    blocks = F.array_sort(F.collect_list(F.struct("block_no", "role", "bbox", "idx")))
    return parts.groupBy(*PAGE, "group_id").agg(F.median("idx").alias("idx"), first["bbox"].alias("bbox"), blocks.alias("blocks"))


def nearest_block(marks: DataFrame, blocks: DataFrame, both_axes: bool = False, most: float | None = None) -> DataFrame:
    """marks (doc_id, page_id, seq, x, y) with block_no and dist of the nearest block's upper left corner, the lower
    number of equal ones; NaN is near nothing."""
    b = blocks.select(*PAGE, "block_no", F.col("bbox.x0").alias("bx"), F.col("bbox.y0").alias("by"))
    dist = F.sqrt(F.pow(F.col("bx") - F.col("x"), 2) + F.pow(F.col("by") - F.col("y"), 2)) if both_axes else F.abs(F.col("y") - F.col("by"))
    found = marks.join(b, PAGE).withColumn("dist", dist).filter(~F.isnan("dist"))
    found = found.filter(F.col("dist") <= most) if most is not None else found
    best = found.groupBy(*PAGE, "seq").agg(F.min(F.struct("dist", "block_no")).alias("best"))
    return marks.join(best.select(*PAGE, "seq", "best.block_no", "best.dist"), [*PAGE, "seq"], "left")


def nearest_below(blocks: DataFrame) -> DataFrame:
    """blocks with below_no and below_dist: the nearest other block that starts at or under its end."""
    low = blocks.select(*PAGE, F.col("block_no").alias("low_no"), F.col("bbox.y0").alias("low_y"))
    found = blocks.join(low, PAGE).filter((F.col("low_no") != F.col("block_no")) & (F.col("low_y") >= F.col("bbox.y1")))
    best = found.groupBy(*PAGE, "block_no").agg(F.min(F.struct((F.col("low_y") - F.col("bbox.y1")).alias("d"), "low_no")).alias("best"))
    return blocks.join(best.select(*PAGE, "block_no", F.col("best.low_no").alias("below_no"), F.col("best.d").alias("below_dist")), [*PAGE, "block_no"], "left")


def without_code_formulas(detections: DataFrame, formulas: DataFrame) -> DataFrame:
    """Left anti join: detections without the formulas (categories 13 and 14) whose box is exactly one of formulas."""
    d = detections.withColumn("__b", G.poly_box(F.col("poly")))
    f = formulas.select(*PAGE, G.poly_box(F.col("poly")).alias("__f")).distinct()
    same = (d["doc_id"] == f["doc_id"]) & (d["page_id"] == f["page_id"]) & (F.col("__b") == F.col("__f")) & d["category_id"].isin(13, 14)
    return d.join(f, same, "left_anti").drop("__b")


def demoted_titles(blocks: DataFrame, outline: DataFrame) -> DataFrame:
    """Titles of pages that no outline entry points to become text."""
    pages = outline.select("doc_id", F.col("page").alias("page_id")).distinct().withColumn("__has", F.lit(True))
    out = blocks.join(pages, PAGE, "left")
    return out.withColumn("type", F.when((F.col("type") == "title") & F.col("__has").isNull(), "text").otherwise(F.col("type"))).drop("__has")


def promoted(blocks: DataFrame, discarded: DataFrame) -> DataFrame:
    """All discarded blocks that have become titles join the blocks, numbered after them."""
    last = blocks.groupBy(*PAGE).agg(F.max("block_no").alias("__last"))
    up = discarded.filter("type = 'title'").join(last, PAGE, "left")
    rank = F.row_number().over(W.partitionBy(*PAGE).orderBy("block_no"))
    up = up.withColumn("block_no", F.coalesce("__last", F.lit(-1)) + rank).drop("__last")
    return blocks.unionByName(up.select(blocks.columns))


def _in_row(seed: dict, other: dict) -> bool:
    """Both of one line, sharing 0.9 of the lower one's height."""
    least = min(seed["y1"] - seed["y0"], other["y1"] - other["y0"])
    shared = min(seed["y1"], other["y1"]) - max(seed["y0"], other["y0"])
    return seed["n_lines"] == other["n_lines"] == 1 and least > 0 and shared / least >= 0.9


def _title_rows(titles: list[dict]) -> list[list[dict]]:
    """Titles dealt to rows: each joins the first row whose first title it is level with, else it starts one."""
    rows: list[list[dict]] = []
    for t in titles:
        home = next((row for row in rows if _in_row(row[0], t)), None)
        if home is None:
            rows.append([t])
        else:
            home.append(t)
    return rows


def _joined_titles(row: list[dict]) -> list[dict]:
    """A row from the left: a title goes on the one before if their gap is under a tenth of the page and their heights
    agree to a twentieth."""
    out: list[dict] = []
    for t in sorted(row, key=lambda r: (r["x0"], r["block_no"])):
        last = out[-1] if out else None
        high = last["y1"] - last["y0"] if last else 0.0
        if last and t["x0"] - last["x1"] < 0.1 * last["page_w"] and 0.95 * high < t["y1"] - t["y0"] < 1.05 * high:
            union = {c: pick(last[c], t[c]) for c, pick in (("x0", min), ("y0", min), ("x1", max), ("y1", max))}
            out[-1] = {**last, **union, "content": last["content"] + t["content"]}
        else:
            out.append(t)
    return out


def merged_title_rows(titles: DataFrame) -> DataFrame:
    """doc_id, page_id, block_no, x0, y0, x1, y1, content: single-line titles side by side as one, with the number of
    the leftmost. titles: block_no, bbox, content, n_lines, page_w; a page's few titles are folded together."""
    fields = ["block_no", "x0", "y0", "x1", "y1", "content"]

    def fold(group: dict) -> Iterator[tuple]:
        for row in _title_rows(group["titles"]):
            for t in _joined_titles(row):
                yield group["doc_id"], group["page_id"], *[t[c] for c in fields]

    flat = titles.select(*[F.col(c).cast("long").alias(c) for c in (*PAGE, "block_no")], "content", F.col("n_lines").cast("int").alias("n_lines"), F.col("page_w").cast("double").alias("page_w"), "bbox.*")
    groups = collected(flat, PAGE, ["block_no"], ["x0", "y0", "x1", "y1", "content", "n_lines", "page_w"], "titles")
    return folded(groups, fold, "doc_id long, page_id long, block_no long, x0 double, y0 double, x1 double, y1 double, content string")


def reading_order(blocks: DataFrame) -> DataFrame:
    """doc_id, page_id, block_no, idx: blocks by recursive cuts along empty rows, then empty columns, of the page; what
    can't be cut goes by top and left. Ties go by number, so the order depends on the boxes alone."""
    def bands(rows: list[dict], lo: str, hi: str) -> list[list[dict]]:
        out: list[list[dict]] = []
        end = None
        for r in sorted(rows, key=lambda r: (r[lo], r[hi], r["block_no"])):
            if end is None or r[lo] >= end:
                out.append([])
                end = r[hi]
            out[-1].append(r)
            end = max(end, r[hi])
        return out

    def cut(rows: list[dict]) -> list[dict]:
        for lo, hi in (("y0", "y1"), ("x0", "x1")):
            parts = bands(rows, lo, hi)
            if len(parts) > 1:
                return [r for p in parts for r in cut(p)]
        return sorted(rows, key=lambda r: (r["y0"], r["x0"], r["block_no"]))

    def fold(group: dict) -> Iterator[tuple]:
        for k, r in enumerate(cut(group["blocks"])):
            yield group["doc_id"], group["page_id"], r["block_no"], k

    flat = blocks.select(*[F.col(c).cast("long").alias(c) for c in (*PAGE, "block_no")], G.clamped(F.col("bbox")).alias("b")).select(*PAGE, "block_no", "b.*")
    return folded(collected(flat, PAGE, ["block_no"], ["x0", "y0", "x1", "y1"], "blocks"), fold, "doc_id long, page_id long, block_no long, idx int")


def contrast(mean: Column, deviation: Column) -> Column:
    """Population deviation over mean, to two digits half to even; crops of at most 0.20 aren't read."""
    return F.bround(deviation / (mean + 1e-6), 2)


def valid_table(html: Column) -> Column:
    end = T.strip(html)
    return end.endswith("</html>") | end.endswith("</table>")
