"""Inputs that the queries derive from the given tables, each once as a DataFrame and once as SQL.

Markdown lines come from documents, by the line's number; geometry from those lines; rate data from events; memo data
from conversations; outlines from headings and from the <h1> of pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.sources import markdown


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i, line."""
    raw = markdown.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    i, line = F.col("line_no"), F.col("line")
    word = F.split_part(line, F.lit(" "), F.lit(1))
    made = (
        F.when(i % 11 == 3, F.lit("```"))
        .when(i % 11 == 7, F.lit("```python"))
        .when(i % 7 == 1, F.concat(F.when((F.col("doc_id") + i) % 2 == 0, "# ").otherwise("## "), line))
        .when(i % 13 == 4, F.concat(line, F.format_string("![](images/h%d_%d.jpg)", F.col("doc_id"), i)))
        .when(i % 5 == 2, F.concat(F.lit("`"), word, F.lit("`"), F.substr(line, F.length(word) + 1)))
        .otherwise(line)
    )
    return raw.select("doc_id", i.alias("i"), made.alias("line"))


MD_LINES = """
r as (select doc_id, i, s[i] as line from (
  select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, string_split(text, chr(10)) as s from documents))),
l as (
  select doc_id, i, case when i % 11 = 3 then '```' when i % 11 = 7 then '```python'
    when i % 7 = 1 then (case when (doc_id + i) % 2 = 0 then '# ' else '## ' end) || line
    when i % 13 = 4 then line || '![](images/h' || doc_id || '_' || i || '.jpg)'
    when i % 5 = 2 then '`' || split_part(line, ' ', 1) || '`' || substr(line, length(split_part(line, ' ', 1)) + 1)
    else line end as line from r)"""


def md_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the lines joined again."""
    return markdown.rebuilt(md_lines(spark, sf_dir), "\n", "i")


MD_TEXT = MD_LINES + ",\nt as (select doc_id, string_agg(line, chr(10) order by i) as text from l group by doc_id)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_id, block_no, type, bbox, content, n_lines, page_w: one block a line, 20 to a page."""
    i, n = F.col("i"), F.length("line")
    x0, y0 = F.col("doc_id") % 5 * 10, (i - 1) % 20 * 20
    kind = F.when(F.col("line").startswith("#"), "title").when(i % 9 == 0, "discarded").when(i % 9 == 5, "image_body").otherwise("text")
    return md_lines(spark, sf_dir).select(
        "doc_id", F.floor((i - 1) / 20).cast("long").alias("page_id"), i.cast("long").alias("block_no"), kind.alias("type"),
        G.box(x0, y0, x0 + n * 6, y0 + 12).alias("bbox"), F.regexp_replace("line", "^#+ ", "").alias("content"), F.lit(1).alias("n_lines"), F.lit(600.0).alias("page_w"),
    )


BLOCKS = (
    MD_LINES
    + """,
b as (
  select doc_id, (i - 1) // 20 as page_id, i as block_no,
    case when starts_with(line, '#') then 'title' when i % 9 = 0 then 'discarded' when i % 9 = 5 then 'image_body' else 'text' end as type,
    cast(doc_id % 5 * 10 as double) as x0, cast((i - 1) % 20 * 20 as double) as y0,
    cast(doc_id % 5 * 10 + length(line) * 6 as double) as x1, cast((i - 1) % 20 * 20 + 12 as double) as y1,
    regexp_replace(line, '^#+ ', '') as content from l)"""
)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_id, span_no, type, bbox, content: a block's content, moved by some units."""
    b = blocks(spark, sf_dir)
    shift = F.col("block_no") % 4 * 3.0
    bbox = G.box(F.col("bbox.x0") + shift * 4, F.col("bbox.y0") + shift, F.col("bbox.x1") + shift, F.col("bbox.y1") + shift)
    kind = F.when(F.col("block_no") % 6 == 5, "image").when(F.col("block_no") % 6 == 4, "interline_equation").otherwise("text")
    return b.select("doc_id", "page_id", F.col("block_no").alias("span_no"), kind.alias("type"), bbox.alias("bbox"), "content")


SPANS = (
    BLOCKS
    + """,
s as (
  select doc_id, page_id, block_no as span_no, case when block_no % 6 = 5 then 'image' when block_no % 6 = 4 then 'interline_equation' else 'text' end as type,
    x0 + block_no % 4 * 12.0 as x0, y0 + block_no % 4 * 3.0 as y0, x1 + block_no % 4 * 3.0 as x1, y1 + block_no % 4 * 3.0 as y1,
    content from b)"""
)


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, title, page, x, y, grade: heading lines, some units off; some documents have NaN places."""
    b = blocks(spark, sf_dir).filter("type = 'title'")
    nan = F.lit(float("nan"))
    y = F.when(F.col("doc_id") % 17 == 3, nan).when(F.col("doc_id") % 17 == 5, F.lit(0.0)).otherwise(F.col("bbox.y0") + F.col("doc_id") % 9)
    x = F.when(F.col("doc_id") % 13 == 2, nan).otherwise(F.col("bbox.x0") + F.col("block_no") % 3)
    grade = F.col("block_no") % 4 + 1
    return b.select("doc_id", F.col("block_no").cast("int").alias("seq"), "content", F.col("content").alias("title"), F.col("page_id").cast("int").alias("page"), x.alias("x"), y.alias("y"), grade.cast("int").alias("grade")).drop("content")


OUTLINE = (
    BLOCKS
    + """,
o as (
  select doc_id, cast(block_no as int) as seq, content as title, cast(page_id as int) as page,
    case when doc_id % 13 = 2 then 'nan'::double else x0 + block_no % 3 end as x,
    case when doc_id % 17 = 3 then 'nan'::double when doc_id % 17 = 5 then 0.0 else y0 + doc_id % 9 end as y,
    cast(block_no % 4 + 1 as int) as grade from b where type = 'title')"""
)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agent, request_id, us, tokens."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select((F.col("user_id") % 4).alias("agent"), F.col("event_id").alias("request_id"), us.alias("us"), F.floor(F.col("value") * 10).cast("long").alias("tokens"))


REQUESTS = "q as (select user_id % 4 as agent, event_id as request_id, epoch_us(ts) as us, cast(floor(value * 10) as bigint) as tokens from events)"


def memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agent, prompt, response, seq: what users say and what the assistant answers next."""
    c = table(spark, sf_dir, "conversations")
    nxt = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return c.filter("role = 'user'").join(nxt, ["conv_id", "turn"]).select(F.concat(F.lit("a"), (F.col("conv_id") % 2).cast("string")).alias("agent"), F.col("text").alias("prompt"), "response", (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))


MEMO = """
m as (
  select 'a' || (u.conv_id % 2) as agent, u.text as prompt, a.text as response, u.conv_id * 1000 + u.turn as seq
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant' where u.role = 'user')"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agent, prompt, doc_id, chunk_no: all lines."""
    lines = md_lines(spark, sf_dir)
    return lines.select(F.concat(F.lit("a"), (F.col("doc_id") % 2).cast("string")).alias("agent"), F.col("line").alias("prompt"), "doc_id", F.col("i").alias("chunk_no"))


CALLS = MD_LINES + ",\nk as (select 'a' || (doc_id % 2) as agent, line as prompt, doc_id, i as chunk_no from l)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agent, prompt, doc_id, chunk_no: what users say, asked again, in half of the conversations of the other agent."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    agent = F.concat(F.lit("a"), (F.floor(F.col("conv_id") / 2) % 2).cast("string"))
    return c.select(agent.alias("agent"), F.col("text").alias("prompt"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_no"))


ASKED = "k as (select 'a' || (conv_id // 2 % 2) as agent, text as prompt, conv_id as doc_id, turn as chunk_no from conversations where role = 'user')"


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_id, char_no, c, bbox: the characters of every benchmark item in lines of 30."""
    b = table(spark, sf_dir, "benchmark")
    rows = b.select(F.col("item_id").alias("doc_id"), F.lit(0).cast("long").alias("page_id"), F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("p", "c"))
    at, row = F.col("p") % 30, F.floor(F.col("p") / 30)
    x = at * 6 + F.when(at % 7 == 6, 3).otherwise(0)
    y = row * 20 + F.col("p") % 2
    return rows.select("doc_id", "page_id", F.col("p").cast("long").alias("char_no"), "c", G.box(x, y, x + 5, y + 10).alias("bbox"))


def glyph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_id, span_no, bbox: the lines of glyphs, in two halves that overlap."""
    n = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 15))).alias("h"))
    row, half = F.floor(F.col("h") / 2), F.col("h") % 2
    return n.select("doc_id", F.lit(0).cast("long").alias("page_id"), F.col("h").cast("long").alias("span_no"), G.box(half * 88, row * 20, half * 88 + 95, row * 20 + 11).alias("bbox"))


GLYPHS = """
g as (
  select doc_id, 0::bigint as page_id, p as char_no, c, cast(p % 30 * 6 + case when p % 30 % 7 = 6 then 3 else 0 end as double) as x0,
    cast(p // 30 * 20 + p % 2 as double) as y0 from (
    select item_id as doc_id, p, substr(text, p + 1, 1) as c from (select item_id, text, unnest(range(0, length(text))) as p from benchmark))),
h as (
  select item_id as doc_id, h as span_no, h % 2 * 88.0 as x0, h // 2 * 20.0 as y0, h % 2 * 88.0 + 95 as x1, h // 2 * 20.0 + 11 as y1
  from (select item_id, unnest(range(0, (length(text) - 1) // 15 + 1)) as h from benchmark)),
f as (
  select g.doc_id, g.page_id, g.char_no, g.c, g.x0, min((h.y0, h.span_no)) as best from g join h on g.doc_id = h.doc_id
  where g.y0 + 5 > h.y0 and g.y0 + 5 < h.y1 and abs(g.y0 + 5 - (h.y0 + h.y1) / 2) < (h.y1 - h.y0) * 0.33
    and ((g.x0 + 2.5 > h.x0 and g.x0 + 2.5 < h.x1)
      or (g.c in ('.', '!', '?', ')', '"', ':', ';', ']', '}', '>', ',', '-') and g.x0 > h.x1 - (h.y1 - h.y0) and g.x0 < h.x1 and g.x0 + 2.5 > h.x0)
      or (g.c in ('(', '"', '{', '<', '[') and g.x0 + 5 > h.x0 and g.x0 + 5 < h.x0 + (h.y1 - h.y0) and g.x0 + 2.5 < h.x1))
  group by g.doc_id, g.page_id, g.char_no, g.c, g.x0),
p as (select doc_id, page_id, char_no, c, x0, best[2] as span_no from f)"""
