"""From detections and spans to the blocks of a page: which spans count, groups, texts, and what is set aside."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.operators.folds import collected, folded
from docloom.operators.layout import PAGE

#: What isn't text; overlaps from which of two spans one is dropped; gates of crops and readings.
NO_TEXT_SPANS, NO_TEXT_BLOCKS = ("interline_equation", "image", "table"), ("image_body", "table_body", "interline_equation")
SAME, INSIDE = 0.9, 0.65
CONTRAST, SCORE = 0.20, 0.5


def _shared(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def without_overlaps(spans: DataFrame) -> DataFrame:
    """Two left anti joins within pages: of spans that share over SAME of their union the less certain ones go (of equal
    ones the later), then spans of which over INSIDE lies in a larger one (of equal ones the later). spans: doc_id,
    page_id, span_no, bbox, score."""
    def dropped(rows: DataFrame, worse, overlap) -> DataFrame:
        s, t = rows.alias("s"), rows.alias("t")
        pairs = s.join(t, (F.col("s.doc_id") == F.col("t.doc_id")) & (F.col("s.page_id") == F.col("t.page_id")) & (F.col("s.span_no") != F.col("t.span_no")) & overlap & worse, "left_anti")
        return pairs.select("s.*")

    a, b = F.col("s.bbox"), F.col("t.bbox")
    later = F.col("s.span_no") > F.col("t.span_no")
    union = G.area(a) + G.area(b) - _shared(a, b)
    sure, unsure = F.coalesce("t.score", F.lit(0.0)), F.coalesce("s.score", F.lit(0.0))
    rows = dropped(spans, (unsure < sure) | ((unsure == sure) & later), _shared(a, b) > union * SAME)
    return dropped(rows, (G.area(a) < G.area(b)) | ((G.area(a) == G.area(b)) & later), _shared(a, b) > G.area(a) * INSIDE)


def text_spans(spans: DataFrame) -> DataFrame:
    return spans.filter(~F.col("type").isin(*NO_TEXT_SPANS))


def classified(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page_id, span_no, class of the text spans that over half lie in a block: by the first such block, discarded
    ones after all others, the class is vertical (far higher than wide, and than the page's median span), useful or
    unuseful (in a discarded block). spans: type, bbox; blocks: block_no, type, bbox."""
    text = text_spans(spans).select(*PAGE, "span_no", "bbox")
    h = G.height(F.col("bbox"))
    tall = text.withColumn("tall", (h > F.percentile(h, F.lit(0.5)).over(W.partitionBy(*PAGE)) * 3) & (h > G.width(F.col("bbox")) * 3))
    b = blocks.filter(~F.col("type").isin(*NO_TEXT_BLOCKS)).select(*PAGE, F.col("bbox").alias("b_bbox"), F.struct((F.col("type") == "discarded").alias("gone"), "block_no").alias("place"))
    found = tall.join(b, PAGE).filter(G.overlap_share(F.col("bbox"), F.col("b_bbox")) > 0.5)
    found = found.groupBy(*PAGE, "span_no").agg(F.min("place").alias("place"), F.first("tall").alias("tall"))
    return found.select(*PAGE, "span_no", F.when(F.col("tall"), "vertical").when(F.col("place.gone"), "unuseful").otherwise("useful").alias("class"))


def vertical_text(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, page_id, span_no, content of upright spans: the texts of the lines that over half lie in them, each line in
    the first one, in order. Spans without a line are left out. lines: line_no, bbox, text; spans: span_no, bbox."""
    s = spans.select(*PAGE, "span_no", F.col("bbox").alias("s_bbox"))
    found = lines.join(s, PAGE).filter(G.overlap_share(F.col("bbox"), F.col("s_bbox")) > 0.5)
    found = found.groupBy(*PAGE, "line_no").agg(F.min("span_no").alias("span_no"), F.first("text").alias("text"))
    texts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return found.groupBy(*PAGE, "span_no").agg(F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("content")).filter("content <> ''")


def flattened_groups(groups: DataFrame) -> DataFrame:
    """doc_id, page_id, group_id, role, bbox: bodies, captions and footnotes of each page's groups, which are numbered from
    0 in order. groups: group_no, body (bbox), captions and footnotes (arrays of bbox)."""
    number = F.row_number().over(W.partitionBy(*PAGE).orderBy("group_no")) - 1
    of = lambda role, boxes: F.transform(F.coalesce(boxes, F.array()), lambda b: F.struct(F.lit(role).alias("role"), b.alias("bbox")))
    parts = F.concat(F.array(F.struct(F.lit("body").alias("role"), F.col("body").alias("bbox"))), of("caption", F.col("captions")), of("footnote", F.col("footnotes")))
    return groups.withColumn("group_id", number).select(*PAGE, "group_id", F.inline(parts))


def all_blocks(blocks: DataFrame, discarded: DataFrame) -> DataFrame:
    """Both, the discarded ones numbered after the page's blocks. Both: doc_id, page_id, block_no and equal columns."""
    n = blocks.groupBy(*PAGE).agg(F.max("block_no").alias("__last"))
    rank = F.row_number().over(W.partitionBy(*PAGE).orderBy("block_no"))
    after = discarded.withColumn("__rank", rank).join(n, PAGE, "left").withColumn("block_no", F.coalesce("__last", F.lit(-1)) + F.col("__rank"))
    return blocks.unionByName(after.select(blocks.columns))


def appended(found: DataFrame, more: DataFrame) -> DataFrame:
    """Detections with those of another model after them: det_id goes on within each page."""
    return all_blocks(found.withColumnRenamed("det_id", "block_no"), more.withColumnRenamed("det_id", "block_no")).withColumnRenamed("block_no", "det_id")


def block_text(spans: DataFrame) -> DataFrame:
    """doc_id, page_id, block_no, content: a block's spans by line and place, joined by nothing. spans: block_no, line_no,
    span_no, content."""
    rows = spans.groupBy(*PAGE, "block_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "span_no", F.coalesce("content", F.lit("")).alias("content")))).alias("rows"))
    return rows.select(*PAGE, "block_no", F.array_join(F.transform("rows", lambda r: r["content"]), "").alias("content"))


def block_places(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page_id, block_no, idx: the median position of a block's lines, or its own where it has none. blocks:
    block_no, position; lines: block_no, position."""
    median = lines.groupBy(*PAGE, "block_no").agg(F.median("position").alias("__median"))
    return blocks.join(median, [*PAGE, "block_no"], "left").select(*PAGE, "block_no", F.coalesce("__median", F.col("position").cast("double")).alias("idx"))


def page_rows(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page_id, n_blocks, block_nos: every page, those without blocks too. blocks: doc_id, page_id, block_no."""
    own = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.col("block_no").cast("long"))).alias("block_nos"))
    none = F.array().cast("array<bigint>")
    rows = pages.select(*PAGE).join(own, PAGE, "left").withColumn("block_nos", F.coalesce("block_nos", none))
    return rows.select(*PAGE, F.size("block_nos").alias("n_blocks"), "block_nos")


def formulas_in_crops(regions: DataFrame, formulas: DataFrame, use_formulas: bool = True) -> DataFrame:
    """doc_id, page_id, det_id, n_formulas, gated: how many formulas touch each region that is read, and whether its text
    is cut around them (regions of category 1, with formulas on). regions, formulas: det_id, category_id, bbox."""
    f = formulas.select(*PAGE, F.col("bbox").alias("f_bbox"))
    touching = regions.join(f, PAGE).filter(_shared(F.col("bbox"), F.col("f_bbox")) > 0).groupBy(*PAGE, "det_id").agg(F.count("*").alias("n"))
    rows = regions.join(touching, [*PAGE, "det_id"], "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select(*PAGE, "det_id", n.cast("long").alias("n_formulas"), (F.lit(use_formulas) & (F.col("category_id") == 1) & (n > 0)).alias("gated"))


def worth_reading(contrast: Column) -> Column:
    return contrast > CONTRAST


def well_read(text: Column, score: Column) -> Column:
    return (score > SCORE) & (F.length(text) > 0)


def route(is_scan: Column, force: Column | bool = False) -> Column:
    """ocr or txt: how a document is read."""
    return F.when(F.coalesce(force if isinstance(force, Column) else F.lit(force), F.lit(False)) | is_scan, "ocr").otherwise("txt")


def unread(crops: DataFrame) -> DataFrame:
    """What goes to the dead letters: crops without a text, with a name of page and number. crops: page_id, crop_no, text."""
    return crops.filter(F.coalesce("text", F.lit("")) == "").withColumn("name", F.format_string("%04d_%04d", F.col("page_id").cast("int"), F.col("crop_no").cast("int")))


def ancestors(outline: DataFrame) -> DataFrame:
    """doc_id, seq, parents: the entries above each one, the outermost first. outline: seq, parent_seq."""
    def fold(group: dict) -> Iterator[tuple]:
        above: dict[int, list[int]] = {}
        for e in group["entries"]:
            parent = e["parent_seq"]
            above[e["seq"]] = [] if parent is None else [*above.get(parent, []), parent]
            yield group["doc_id"], e["seq"], above[e["seq"]]

    rows = outline.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("int").alias("seq"), F.col("parent_seq").cast("int").alias("parent_seq"))
    return folded(collected(rows, ["doc_id"], ["seq"], ["parent_seq"], "entries"), fold, "doc_id long, seq int, parents array<int>")


def observed(rows: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, Observation]:
    """rows with a count and sums that can be read from the observation once an action has run over them."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(k) for k, c in sums.items()]), seen
