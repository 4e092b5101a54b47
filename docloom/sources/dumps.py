"""Page contents that a PDF reader or a layout model has dumped as JSON, one string a page, as typed rows.

raw: doc_id, page_id, json. A page that doesn't parse gives no rows, like one without contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import geometry as G

#: The shape of a page's text, and of its detections.
TEXT = "struct<blocks array<struct<lines array<struct<dir array<double>, bbox array<double>, spans array<struct<text string, chars array<struct<c string, bbox array<double>>>>>>>>>>"
DETECTIONS = "array<struct<category_id int, poly array<double>, score double, html string, latex string>>"


def _box(b: Column) -> Column:
    return G.box(b[0], b[1], b[2], b[3])


def _lines(raw: DataFrame) -> Column:
    """All lines of a page, in order; image blocks have none."""
    blocks = F.from_json("json", TEXT)["blocks"]
    return F.flatten(F.transform(blocks, lambda b: F.coalesce(b["lines"], F.array().cast("array<struct<dir array<double>, bbox array<double>, spans array<struct<text string, chars array<struct<c string, bbox array<double>>>>>>>"))))


def glyphs(raw: DataFrame) -> DataFrame:
    """doc_id, page_id, char_no, c, bbox, dir_cos, dir_sin: the characters of each page in order."""
    of_line = lambda l: F.flatten(F.transform(l["spans"], lambda s: F.transform(s["chars"], lambda c: F.struct(c["c"].alias("c"), _box(c["bbox"]).alias("bbox"), l["dir"][0].alias("dir_cos"), l["dir"][1].alias("dir_sin")))))
    rows = raw.select("doc_id", "page_id", F.posexplode(F.flatten(F.transform(_lines(raw), of_line))).alias("char_no", "g"))
    return rows.select("doc_id", "page_id", "char_no", "g.*")


def text_lines(raw: DataFrame) -> DataFrame:
    """doc_id, page_id, line_no, bbox, text: the lines of each page, their spans' texts joined."""
    rows = raw.select("doc_id", "page_id", F.posexplode(_lines(raw)).alias("line_no", "l"))
    return rows.select("doc_id", "page_id", "line_no", _box(F.col("l.bbox")).alias("bbox"), F.array_join(F.transform("l.spans", lambda s: F.coalesce(s["text"], F.lit(""))), "").alias("text"))


def detections(raw: DataFrame) -> DataFrame:
    """doc_id, page_id, det_id, category_id, poly, score, html, latex: what a layout model has found on each page."""
    return raw.select("doc_id", "page_id", F.posexplode(F.from_json("json", DETECTIONS)).alias("det_id", "d")).select("doc_id", "page_id", "det_id", "d.*")


def of_categories(found: DataFrame, *categories: int) -> DataFrame:
    """doc_id, page_id, det_id, category_id, bbox, score of these categories."""
    return found.filter(F.col("category_id").isin(*categories)).select("doc_id", "page_id", "det_id", "category_id", G.poly_box(F.col("poly")).alias("bbox"), "score")


def content_list(blocks: DataFrame) -> DataFrame:
    """doc_id, json: each document's blocks in order as a list of type, text, text_level (of titles) and page_idx.
    blocks: doc_id, page_id, idx, block_no, type, content, grade."""
    item = F.struct(F.col("type"), F.col("content").alias("text"), F.col("grade").alias("text_level"), F.col("page_id").cast("long").alias("page_idx"))
    rows = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_id", "idx", "block_no", item.alias("item")))).alias("rows"))
    return rows.select("doc_id", F.to_json(F.transform("rows", lambda r: r["item"])).alias("json"))


def page_list(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, json: each document's pages with their size, blocks, discarded blocks and why they are dropped, if they are.
    pages: doc_id, page_id, page_w, page_h, need_drop, drop_reason; blocks: doc_id, page_id, block_no, type, bbox,
    content. A page without blocks has empty lists."""
    box = F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    block = F.struct("block_no", "type", box.alias("bbox"), "content")
    gone = F.col("type") == "discarded"
    on_page = blocks.groupBy("doc_id", "page_id").agg(F.sort_array(F.collect_list(F.when(~gone, block))).alias("para_blocks"), F.sort_array(F.collect_list(F.when(gone, block))).alias("discarded_blocks"))
    rows = pages.join(on_page, ["doc_id", "page_id"], "left")
    empty = lambda c: F.coalesce(c, F.array().cast("array<struct<block_no bigint, type string, bbox array<double>, content string>>")).alias(c)
    page = F.struct(F.col("page_id").alias("page_idx"), F.array("page_w", "page_h").alias("page_size"), empty("para_blocks"), empty("discarded_blocks"), "need_drop", "drop_reason")
    return rows.groupBy("doc_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(page)).alias("pdf_info"))).alias("json"))
