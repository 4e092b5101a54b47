"""Every query of the engine's own operators, with its SQL where SQL can express it.

A query takes (spark, sf_dir) and runs over its whole tables. What a fold over a document or a page decides step by step
has no SQL here; the tests hold those against worked examples.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import fuzzy as Z
from docloom.functions import geometry as G
from docloom.functions import text as T
from docloom.operators import assembly as A
from docloom.operators import calls as C
from docloom.operators import chunks as K
from docloom.operators import code as D
from docloom.operators import headers as H
from docloom.operators import layout as L
from docloom.operators import outline as O
from docloom.plans import derived as I
from docloom.sources import dumps, files, markdown
from docloom.streaming import rate as R

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Markdown lines and headings


@_query(f"with {I.MD_LINES} select doc_id, i, line from l")
def md_lines(spark, d):
    return I.md_lines(spark, d)


_HEAD = r"regexp_matches(line, '^#{1,6} .+$')"


@_query(f"with {I.MD_LINES} select doc_id, i, line, length(regexp_extract(line, '^(#{{1,6}}) ', 1)) as grade from l where {_HEAD} and trim(substr(line, instr(line, ' '))) <> ''")
def md_headers(spark, d):
    rows = I.md_lines(spark, d).withColumnRenamed("i", "line_no")
    return markdown.headings(rows).withColumnRenamed("line_no", "i").withColumn("grade", F.col("grade").cast("long"))


@_query(f"with {I.MD_LINES} select doc_id, i, case when {_HEAD} then length(regexp_extract(line, '^(#{{1,6}}) ', 1)) else -1 end as grade from l")
def md_grade(spark, d):
    return I.md_lines(spark, d).select("doc_id", "i", T.heading_grade(F.col("line")).cast("long").alias("grade"))


@_query(f"with {I.MD_LINES} select doc_id, i, case when {_HEAD} then regexp_replace(line, '^#{{1,6}} ', '') else line end as bare from l")
def md_strip_heading(spark, d):
    return I.md_lines(spark, d).select("doc_id", "i", T.strip_heading(F.col("line")).alias("bare"))


@_query(f"with {I.MD_LINES} select doc_id, i, trim(line) || '  ' || chr(10) as heading from l where {_HEAD}")
def normalised_headings(spark, d):
    rows = I.md_lines(spark, d).withColumn("heading", T.normalised_heading(F.col("line")))
    return rows.filter("heading is not null").select("doc_id", "i", "heading")


@_query(f"with {I.MD_TEXT} select doc_id, text from t")
def md_rebuilt(spark, d):
    return I.md_text(spark, d)


@_query(f"""with {I.MD_LINES} select doc_id, i, '|@' || (i % 6 + 1) || '@|' || regexp_replace(bare, '[ \\t]+', ' ', 'g') as encoded,
  repeat('#', cast(i % 6 + 1 as int)) || ' ' || regexp_replace(bare, '[ \\t]+', ' ', 'g') as decoded
  from (select doc_id, i, regexp_replace(line, '^#{{1,6}} ', '') as bare from l where {_HEAD})""")
def title_encode_decode(spark, d):
    rows = I.md_lines(spark, d).filter(T.is_heading(F.col("line")))
    rows = rows.withColumn("encoded", T.encode_title(T.strip_heading(F.col("line")), F.col("i") % 6 + 1))
    return rows.select("doc_id", "i", "encoded", T.decode_title(F.concat(F.lit("# "), "encoded")).alias("decoded"))


@_query(f"""with {I.MD_LINES}, c as (select doc_id, i, repeat(' ', cast(i % 3 as int)) || line as v, length(line) as n, length(regexp_extract(line, '^#*')) as k from l)
  select doc_id, i, case when (case when k < n then k else k - 1 end) > 0 then '//' || substr(v, (case when k < n then k else k - 1 end) + 1) else v end as marked from c""")
def comment_mark(spark, d):
    rows = I.md_lines(spark, d).withColumn("v", F.concat(F.repeat(F.lit(" "), (F.col("i") % 3).cast("int")), "line"))
    return rows.select("doc_id", "i", T.comment_mark(F.col("v")).alias("marked"))


# Code and links


@_query(f"""with {I.MD_LINES}, a as (select *, line = '```' as bare, starts_with(line, '```') and line <> '```' as named from l),
  c as (select *, sum(case when bare then 1 else 0 end) over w as tog from a window w as (partition by doc_id order by i)),
  e as (select *, max(case when named then i end) over w as ll, max(case when named then tog end) over w as tl from c window w as (partition by doc_id order by i))
  select doc_id, i, cast((case when ll is null then 0 else 1 end + tog - coalesce(tl, 0)) % 2 as int) as in_code from e""")
def fence_state(spark, d):
    rows = I.md_lines(spark, d).withColumnRenamed("i", "line_no")
    return D.fence_state(rows).select("doc_id", F.col("line_no").alias("i"), "in_code")


@_query(f"""with {I.MD_LINES}, a as (select *, case when line = '```python' then 1 when line = '```' then 0 end as m from l)
  select doc_id, i, cast(coalesce(last_value(m ignore nulls) over (partition by doc_id order by i rows unbounded preceding), 0) as int) as in_code from a""")
def fence_state_listed(spark, d):
    rows = I.md_lines(spark, d).withColumnRenamed("i", "line_no")
    return D.fence_state(rows, ("python", "cpp")).select("doc_id", F.col("line_no").alias("i"), "in_code")


_RUN = "coalesce(list_max(list_transform(string_split(line, '`')[2:-2], lambda x: length(x))), 0)"


@_query(f"with {I.MD_LINES} select doc_id, i, {_RUN} as longest, case when {_RUN} > 8 then replace(line, '`', '') else line end as clean from l")
def inline_code_clean(spark, d):
    rows = I.md_lines(spark, d)
    return rows.select("doc_id", "i", T.longest_inline(F.col("line")).cast("long").alias("longest"), T.clean_inline(F.col("line"), 8).alias("clean"))


_LINK = r"!\[\]\(images/\w+.jpg\)"


@_query(f"""with {I.MD_TEXT}, v as (select doc_id, text, case when doc_id % 5 = 4 then '' else replace(replace(text, 'e', 'E'), 'imagEs/h', 'images/x') end as said from t),
  w as (select *, regexp_extract_all(text, '{_LINK}') as a, string_split_regex(said, '{_LINK}') as p, said as s from v)
  select doc_id, len(a) as n_links, case when len(p) - 1 = len(a) then array_to_string(list_transform(range(1, len(p) + 1), lambda k: p[k] || coalesce(a[k], '')), '') else s end as fixed from w""")
def image_link_repair(spark, d):
    said = F.when(F.col("doc_id") % 5 == 4, "").otherwise(F.replace(F.replace("text", F.lit("e"), F.lit("E")), F.lit("imagEs/h"), F.lit("images/x")))
    rows = I.md_text(spark, d).withColumn("said", said)
    return rows.select("doc_id", F.size(D.image_links(F.col("text"))).cast("long").alias("n_links"), D.repair_image_links(F.col("text"), F.col("said")).alias("fixed"))


@_query()
def code_wrap(spark, d):
    rows = I.md_lines(spark, d).select("doc_id", F.col("i").alias("line_no"), F.concat("line", F.lit("\n")).alias("line"))
    return D.format_code(rows)


# Text repairs


@_query(f"""with {I.MD_LINES} select doc_id, i, repeat(' ', cast(i % 3 as int)) || replace(trim(line), 'e', 'E') || (case when trim(line) = '' then '' else repeat(' ', cast(i % 2 as int)) end) as kept
  from l where line <> ''""")
def keep_edge_whitespace(spark, d):
    source = F.concat(F.repeat(F.lit(" "), (F.col("i") % 3).cast("int")), F.trim("line"), F.repeat(F.lit(" "), (F.col("i") % 2).cast("int")))
    rows = I.md_lines(spark, d).filter("line <> '' and trim(line) <> ''")
    return rows.select("doc_id", "i", T.keep_edges(source, F.concat(F.lit("  "), F.replace("line", F.lit("e"), F.lit("E")), F.lit(" "))).alias("kept"))


@_query(f"""with {I.MD_LINES}, v as (select doc_id, i, replace(replace(replace(line, 'fi', 'ﬁ'), 'st', 'ﬆ'), 'x', chr(65533)) as v from l)
  select doc_id, i, replace(replace(replace(v, 'ﬁ', 'fi'), 'ﬆ', 'st'), chr(65533), ' ') as clean from v""")
def ligature_clean(spark, d):
    rows = I.md_lines(spark, d).withColumn("v", F.replace(F.replace(F.replace("line", F.lit("fi"), F.lit("ﬁ")), F.lit("st"), F.lit("ﬆ")), F.lit("x"), F.lit("�")))
    return rows.select("doc_id", "i", T.replacement_to_space(T.expand_ligatures(F.col("v"))).alias("clean"))


@_query("""select doc_id, cast(quality as varchar) || case when toxic = 1 then '.包含代码' else '' end in ('1', '1.包含代码', '1包含代码') and doc_id % 3 <> 0 as has_code from labels""")
def label_parse(spark, d):
    rows = I.table(spark, d, "labels")
    answer = F.concat(F.lit("<think>x</think> "), F.when(F.col("doc_id") % 3 == 0, "\n").otherwise(""), F.col("quality").cast("string"), F.when(F.col("toxic") == 1, " .包含代码").otherwise(""))
    return rows.select("doc_id", T.is_yes(answer).alias("has_code"))


# Fuzzy titles

_PAIRS = f"""with {I.MD_LINES}, h as (select doc_id, i, regexp_replace(line, '^#+ ', '') as t from l where {_HEAD}),
  p as (select doc_id, i, t as a, lag(t) over (partition by doc_id order by i) as b from h)"""


def _title_pairs(spark, d):
    from pyspark.sql import Window as W

    rows = I.md_lines(spark, d).filter(T.is_heading(F.col("line"))).select("doc_id", "i", F.regexp_replace("line", "^#+ ", "").alias("a"))
    rows = rows.withColumn("b", F.lag("a").over(W.partitionBy("doc_id").orderBy("i")))
    return rows.filter("b is not null")


@_query()  # SQL engines count the edits of bytes
def lev_match(spark, d):
    a, b = F.col("a"), F.col("b")
    return _title_pairs(spark, d).select("doc_id", "i", F.levenshtein(F.lower(a), F.lower(b)).cast("long").alias("dist"), Z.edit_limit(T.strip(b)).alias("most"), Z.titles_match(a, b).alias("same"))


@_query(_PAIRS + """, w as (select *, lower(split_part(a, ' ', 1)) as x, lower(b) as y from p where b is not null)
  select doc_id, i, starts_with(y, x) or (starts_with(x, 'part') and starts_with(y, 'part')) or (starts_with(x, 'chapter') and starts_with(y, 'chapter')) or (starts_with(x, 'appendix') and starts_with(y, 'appendix')) as may from w""")
def prefix_match(spark, d):
    return _title_pairs(spark, d).select("doc_id", "i", Z.may_start(F.split_part("a", F.lit(" "), F.lit(1)), F.col("b")).alias("may"))


@_query()
def edit_trace(spark, d):
    b = I.table(spark, d, "benchmark").select("item_id", F.col("text").alias("a"), F.expr("substr(text, 3)").alias("b"))
    return b.select("item_id", Z.edit_trace("a", "b").alias("trace"), Z.is_same_heading("a", "b").alias("same"))


# Outlines


@_query(f"""with {I.OUTLINE} select doc_id, seq, title, cast(page - 1 + 1 as int) as page, case when isnan(x) then 0 else x end as x, case when isnan(y) then 0 else y end as y,
  cast(grade - min(grade) over (partition by doc_id order by seq rows unbounded preceding) + 1 as int) as grade from o where page + 1 between 2 and 4""")
def outline_rebase(spark, d):
    out = O.sliced(I.outline(spark, d), 2, 4)
    return out.withColumn("page", F.col("page").cast("int")).withColumn("grade", F.col("grade").cast("int"))


@_query(f"""with {I.OUTLINE}, v as (select *, case when isnan(y) then null else cast(floor(y) as bigint) end as iy from o),
  w as (select *, count(*) over u as n, list_unique(list(case when isnan(y) then -1 else iy end) over u) as ny from v window u as (partition by doc_id, page order by seq rows unbounded preceding)),
  a as (select doc_id, bool_or(isnan(y)) as nan_y, bool_or(n >= 3 * ny) as piled, bool_and(y = 0) as zero, count(distinct page) as pages, count(distinct y) as ys,
    bool_or(isnan(x)) as nan_x, count(distinct case when isnan(x) then null else floor(x) end) as xs from w group by doc_id)
  select doc_id, case when nan_y or piled or zero or (pages >= 5 and ys = 1) then 'edit_dist' else 'distance' end as match_type,
    case when nan_x or xs = 1 then 'dist_y' else 'dist_xy' end as dist_type from a""")
def outline_stats(spark, d):
    return O.placement(I.outline(spark, d))


@_query("""with p as (select page_id // 9 as doc_id, page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) as title, row_number() over (partition by page_id // 9 order by page_id) - 1 as id from pages)
  select doc_id, cast(id as int) as seq, title, cast(id as int) as page, cast(0 as double) as x, id * 10.0::double as y, case when id % 3 = 0 then 1 else 2 end as grade,
    cast(case when id % 3 > 0 then id - id % 3 end as int) as parent_seq from p""")
def outline_scan(spark, d):
    # each page's <h1> under the page before it, three to a parent, by place among the pages of its nine that are there
    from pyspark.sql import Window as W

    by_id = W.partitionBy("doc_id").orderBy("page_id")
    p = I.table(spark, d, "pages").select("page_id", F.floor(F.col("page_id") / 9).alias("doc_id"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("title"))
    p = p.withColumn("id", F.row_number().over(by_id).cast("long") - 1).withColumn("n_pages", F.count("*").over(W.partitionBy("doc_id")))
    at = lambda k: F.lead("id", k).over(by_id)
    down = F.when(F.col("id") % 3 == 0, at(1))
    nxt = F.when(F.col("id") % 3 == 0, at(3)).when(F.col("id") % 3 == 1, at(1))
    nodes = p.withColumns({"down": down, "next": nxt, "is_root": F.col("id") == 0}).drop("page_id")
    return O.scan(nodes.withColumn("internal", F.lit(True)).withColumn("page", F.col("id").cast("int")).withColumn("x", F.lit(0.0)).withColumn("y", F.col("id") * 10.0))


@_query(f"""with {I.MD_LINES}, n as (select doc_id, (max(i) - 1) // 20 + 1 as n_pages from l group by doc_id), p as (select doc_id, n_pages, unnest(range(0, n_pages)) as page_id from n)
  select doc_id, page_id, not (page_id between 1 and least(3, n_pages - 1)) as need_drop, case when page_id between 1 and least(3, n_pages - 1) then '' else 'skip page' end as reason from p""")
def page_range_stub(spark, d):
    n = I.md_lines(spark, d).groupBy("doc_id").agg((F.floor((F.max("i") - 1) / 20) + 1).alias("n_pages"))
    pages = n.select("doc_id", "n_pages", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pages") - 1)).alias("page_id"))
    return files.with_stubs(pages, 2, 4).select("doc_id", "page_id", "need_drop", F.array_join("drop_reason", ",").alias("reason"))


# Layout


@_query(f"with {I.MD_LINES} select doc_id, i from l where not (abs(degrees(atan2(i % 5 / 4.0, 1.0 - i % 7 / 7.0))) > 2 and abs(degrees(atan2(i % 5 / 4.0, 1.0 - i % 7 / 7.0))) < 88)")
def tilt_filter(spark, d):
    return I.md_lines(spark, d).filter(~G.is_tilted(F.lit(1.0) - F.col("i") % 7 / 7.0, F.col("i") % 5 / 4.0)).select("doc_id", "i")


def _tall(s):
    """Every eleventh span turned upright."""
    b = F.col("bbox")
    turned = G.box(b["x0"], b["y0"], b["x0"] + 12, b["y0"] + G.width(b))
    return s.withColumn("bbox", F.when(F.col("span_no") % 11 == 1, turned).otherwise(b))


@_query(f"""with {I.SPANS}, v as (select doc_id, page_id, span_no, x0, y0, case when span_no % 11 = 1 then x0 + 12 else x1 end as x1, case when span_no % 11 = 1 then y0 + (x1 - x0) else y1 end as y1 from s),
  m as (select doc_id, page_id, median(y1 - y0) as mh from v group by all)
  select v.doc_id, v.page_id, v.span_no from v join m using (doc_id, page_id) where y1 - y0 > mh * 3 and y1 - y0 > (x1 - x0) * 3""")
def vertical_span(spark, d):
    return L.vertical_spans(_tall(I.spans(spark, d))).select("doc_id", "page_id", "span_no")


def _wide(s):
    """Every seventh span ten times as wide."""
    b = F.col("bbox")
    wide = G.box(b["x0"], b["y0"], b["x0"] + G.width(b) * 10, b["y1"])
    return s.withColumn("bbox", F.when(F.col("span_no") % 7 == 2, wide).otherwise(b))


@_query(f"with {I.SPANS} select doc_id, page_id, span_no from s where length(content) * (y1 - y0) < (x1 - x0) * (case when span_no % 7 = 2 then 10 else 1 end) * 0.5")
def near_empty(spark, d):
    return L.needs_reading(_wide(I.spans(spark, d))).select("doc_id", "page_id", "span_no")


_OVER = "(case when (s.x1 - s.x0) * (s.y1 - s.y0) > 0 then greatest(0, least(s.x1, b.x1) - greatest(s.x0, b.x0)) * greatest(0, least(s.y1, b.y1) - greatest(s.y0, b.y0)) / ((s.x1 - s.x0) * (s.y1 - s.y0)) else 0 end)"


@_query(f"""with {I.SPANS} select s.doc_id, s.page_id, s.span_no from s where exists (select 1 from b where b.doc_id = s.doc_id and b.page_id = s.page_id and
  ((b.type = 'discarded' and {_OVER} > 0.4) or ({_OVER} > 0.5 and
    case when b.type = 'image_body' then 'image' when b.type = 'table_body' then 'table' else 'other' end = case when s.type in ('image', 'table') then s.type else 'other' end)))""")
def span_block_semijoin(spark, d):
    return L.spans_in_blocks(I.spans(spark, d), I.blocks(spark, d)).select("doc_id", "page_id", "span_no")


@_query(f"""with {I.SPANS}, f as (select s.doc_id, s.page_id, s.span_no, min(b.block_no) as block_no from s join b on b.doc_id = s.doc_id and b.page_id = s.page_id
    where {_OVER} > 0.5 and ((s.type = 'text' and b.type in ('text', 'title', 'discarded')) or (s.type = 'image' and b.type = 'image_body')) group by all)
  select s.doc_id, s.page_id, s.span_no, coalesce(f.block_no, -1) as block_no from s left join f using (doc_id, page_id, span_no)""")
def span_first_block(spark, d):
    return L.first_block(I.spans(spark, d), I.blocks(spark, d), 0.5, True).select("doc_id", "page_id", "span_no", "block_no").fillna(-1)


@_query(f"with {I.GLYPHS} select doc_id, page_id, char_no, span_no from p")
def glyph_first_match(spark, d):
    return L.glyphs_in_spans(I.glyphs(spark, d), I.glyph_spans(spark, d)).select("doc_id", "page_id", "char_no", "span_no")


@_query(f"""with {I.GLYPHS}, n as (select *, lead(x0) over w as nx, lead(c) over w as nc from p window w as (partition by doc_id, page_id, span_no order by x0, char_no))
  select doc_id, page_id, span_no, string_agg(c || case when nx - (x0 + 5) > 1.25 and c <> ' ' and nc <> ' ' then ' ' else '' end, '' order by x0, char_no) as content from n group by all""")
def span_text(spark, d):
    return L.span_text(L.glyphs_in_spans(I.glyphs(spark, d), I.glyph_spans(spark, d)))


_NEAR = """, n as (select o.doc_id, o.page as page_id, o.seq, min((abs(o.y - b.y0), b.block_no)) as best from o join b on b.doc_id = o.doc_id and b.page_id = o.page where not isnan(o.y) group by all)"""


@_query(f"with {I.OUTLINE}{_NEAR} select o.doc_id, cast(o.page as bigint) as page_id, o.seq, coalesce(best[2], -1) as block_no, coalesce(best[1], -1) as dist from o left join n on n.doc_id = o.doc_id and n.page_id = o.page and n.seq = o.seq")
def nearest_block(spark, d):
    marks = I.outline(spark, d).withColumn("page_id", F.col("page").cast("long"))
    return L.nearest_block(marks, I.blocks(spark, d)).select("doc_id", "page_id", "seq", "block_no", "dist").fillna(-1)


@_query(f"""with {I.BLOCKS}, n as (select b.doc_id, b.page_id, b.block_no, min((c.y0 - b.y1, c.block_no)) as best from b join b c on c.doc_id = b.doc_id and c.page_id = b.page_id
    and c.block_no <> b.block_no and c.y0 >= b.y1 group by all)
  select b.doc_id, b.page_id, b.block_no, coalesce(best[2], -1) as below_no, coalesce(best[1], -1) as below_dist from b left join n using (doc_id, page_id, block_no)""")
def nearest_below(spark, d):
    return L.nearest_below(I.blocks(spark, d)).select("doc_id", "page_id", "block_no", "below_no", "below_dist").fillna(-1)


@_query(f"with {I.BLOCKS} select doc_id, page_id, coalesce(median(cast(trunc(y1 - y0 + block_no % 5 / 2.0) as int)), 10) as line_h from b group by all")
def median_line_height(spark, d):
    b = F.col("bbox")
    rows = I.blocks(spark, d).withColumn("bbox", G.box(b["x0"], b["y0"], b["x1"], b["y1"] + F.col("block_no") % 5 / 2.0))
    return L.line_height(rows)


@_query(f"with {I.BLOCKS} select doc_id, page_id, block_no // 4 as block_no, median(block_no % 17) as idx from b group by all")
def block_index(spark, d):
    rows = I.blocks(spark, d).select("doc_id", "page_id", F.floor(F.col("block_no") / 4).alias("block_no"), (F.col("block_no") % 17).alias("position"))
    return L.block_index(rows)


@_query(f"""with {I.BLOCKS}, v as (select doc_id, page_id, block_no // 4 as g, block_no as line_no, block_no % 17 as position from b), k as (select doc_id, page_id, g, median(position) as idx from v group by all)
  select v.doc_id, v.page_id, g as block_no, line_no, row_number() over (partition by v.doc_id, v.page_id order by idx, g, line_no) as line_index from v join k using (doc_id, page_id, g)""")
def line_number(spark, d):
    rows = I.blocks(spark, d).select("doc_id", "page_id", F.floor(F.col("block_no") / 4).alias("block_no"), F.col("block_no").alias("line_no"), (F.col("block_no") % 17).alias("position"))
    return L.numbered_lines(rows, L.block_index(rows)).select("doc_id", "page_id", "block_no", "line_no", F.col("line_index").cast("long").alias("line_index"))


@_query(f"""with {I.BLOCKS}, v as (select doc_id, page_id, block_no // 3 as group_id, block_no, case when block_no % 3 = 1 then 'body' else 'caption' end as role, x1, block_no % 17 as idx from b)
  select doc_id, page_id, group_id, median(idx) as idx, (min((block_no, x1)) filter (role = 'body'))[2] as body_x1, string_agg(role || block_no, ',' order by block_no) as blocks from v group by all""")
def group_nest(spark, d):
    role = F.when(F.col("block_no") % 3 == 1, "body").otherwise("caption")
    parts = I.blocks(spark, d).select("doc_id", "page_id", F.floor(F.col("block_no") / 3).alias("group_id"), "block_no", role.alias("role"), "bbox", (F.col("block_no") % 17).alias("idx"))
    shown = F.array_join(F.transform("blocks", lambda x: F.concat(x["role"], x["block_no"].cast("string"))), ",")
    return L.nested_groups(parts).select("doc_id", "page_id", "group_id", "idx", F.col("bbox.x1").alias("body_x1"), shown.alias("blocks"))


@_query(f"""with {I.BLOCKS}, v as (select doc_id, block_no, x1 - x0 as w, 10.0 + block_no % 60 * 10 as h from b),
  k as (select *, case when 20 >= h then 1 when h > 200 and w > 150 and w < 300 then cast(floor(h / 10) as int) + 1 when w > 240 then 3 when w > 150 then cast(floor(h / 10) as int) + 1 when h / w > 1.2 then 1 else 2 end as n,
    case when 20 >= h then h when h > 200 and w > 150 and w < 300 then 10 when w > 240 then h / 3 when w > 150 then 10 when h / w > 1.2 then h else h / 2 end as step from v where w > 0)
  select doc_id, block_no, cast(n as int) as n_lines, round(step, 6) as step from k""")
def synthetic_lines(spark, d):
    b = F.col("bbox")
    rows = I.blocks(spark, d).filter(G.width(b) > 0)
    tall = G.box(F.lit(0.0), F.lit(0.0), G.width(b), 10.0 + F.col("block_no") % 60 * 10)
    rows = rows.withColumn("lines", G.synthetic_lines(tall, F.lit(10.0), F.lit(600.0), F.lit(800.0)))
    return rows.select("doc_id", "block_no", F.size("lines").alias("n_lines"), F.round(G.height(F.col("lines")[0]), 6).alias("step"))


def _even(v: str, size: str) -> str:
    s = f"(greatest(0, least({v}, {size})) * 1000 / {size})"
    return f"(case when {s} - floor({s}) = 0.5 then 2 * round({s} / 2) else round({s}) end)"


@_query(f"with {I.BLOCKS} select doc_id, block_no, {_even('x0', '640.0')} as x0, {_even('y0', '400.0')} as y0, {_even('x1', '640.0')} as x1, {_even('y1', '400.0')} as y1 from b")
def coord_scale(spark, d):
    return I.blocks(spark, d).select("doc_id", "block_no", G.scaled(F.col("bbox"), F.lit(640.0), F.lit(400.0)).alias("b")).select("doc_id", "block_no", "b.*")


@_query(f"""with {I.OUTLINE}, p as (select distinct doc_id, page as page_id from o where page % 2 = 0)
  select b.doc_id, b.page_id, block_no, case when type = 'title' and p.doc_id is null then 'text' else type end as type from b left join p on p.doc_id = b.doc_id and p.page_id = b.page_id""")
def title_demote(spark, d):
    return L.demoted_titles(I.blocks(spark, d), I.outline(spark, d).filter("page % 2 = 0")).select("doc_id", "page_id", "block_no", "type")


@_query(f"""with {I.BLOCKS}, k as (select doc_id, page_id, block_no, type from b where type <> 'discarded'), u as (select doc_id, page_id, block_no from b where type = 'discarded' and block_no % 2 = 0),
  m as (select doc_id, page_id, max(block_no) as last from k group by all)
  select * from k union all select u.doc_id, u.page_id, coalesce(last, -1) + row_number() over (partition by u.doc_id, u.page_id order by block_no), 'title' from u left join m using (doc_id, page_id)""")
def title_promote(spark, d):
    rows = I.blocks(spark, d).select("doc_id", "page_id", "block_no", "type")
    gone = rows.filter("type = 'discarded'").withColumn("type", F.when(F.col("block_no") % 2 == 0, "title").otherwise("discarded"))
    return L.promoted(rows.filter("type <> 'discarded'"), gone)


@_query(f"""with {I.BLOCKS}, e as (select doc_id, page_id, block_no, cast(13 + block_no % 3 as int) as category_id, x0, y0, x1, y1 from b), f as (select * from b where block_no % 4 = 0)
  select doc_id, page_id, block_no, category_id from e where not (category_id in (13, 14) and exists (select 1 from f where f.doc_id = e.doc_id and f.page_id = e.page_id and f.x0 = e.x0 and f.y0 = e.y0 and f.x1 = e.x1 and f.y1 = e.y1))""")
def formula_antijoin(spark, d):
    b = F.col("bbox")
    poly = F.array(b["x0"], b["y0"], b["x1"], b["y0"], b["x1"], b["y1"], b["x0"], b["y1"])
    rows = I.blocks(spark, d).select("doc_id", "page_id", "block_no", (F.col("block_no") % 3 + 13).cast("int").alias("category_id"), poly.alias("poly"))
    return L.without_code_formulas(rows, I.blocks(spark, d).filter("block_no % 4 = 0").select("doc_id", "page_id", poly.alias("poly"))).drop("poly")


@_query(f"with {I.BLOCKS} select doc_id, page_id, block_no * 2 as block_no, x0, y0, x0 + 110 as x1, y1, content || content as content from b where type = 'title'")
def title_row_merge(spark, d):
    b = F.col("bbox")
    pairs = I.blocks(spark, d).filter("type = 'title'")
    left = pairs.withColumn("bbox", G.box(b["x0"], b["y0"], b["x0"] + 50, b["y1"])).withColumn("block_no", F.col("block_no") * 2)
    right = pairs.withColumn("bbox", G.box(b["x0"] + 60, b["y0"], b["x0"] + 110, b["y1"])).withColumn("block_no", F.col("block_no") * 2 + 1)
    return L.merged_title_rows(left.unionByName(right))


@_query(f"with {I.BLOCKS} select doc_id, page_id, block_no, cast(row_number() over (partition by doc_id, page_id order by y0, block_no) - 1 as int) as idx from b")
def reading_order(spark, d):
    return L.reading_order(I.blocks(spark, d))


@_query()
def bookmark_match(spark, d):
    marks = I.outline(spark, d)
    return O.named_blocks(I.blocks(spark, d), marks, O.placement(marks))


def _matched(spark, d, how):
    marks = I.outline(spark, d)
    return O.named_blocks(I.blocks(spark, d), marks, O.placement(marks).withColumn("match_type", F.lit(how)))


@_query()
def bookmark_distance_match(spark, d):
    return _matched(spark, d, "distance")


@_query()
def bookmark_edit_match(spark, d):
    return _matched(spark, d, "edit_dist")


# Dumped pages, and blocks made of them


def _corners(b):
    return F.array(b["x0"], b["y0"], b["x1"], b["y1"])


@_query(f"with {I.GLYPHS} select doc_id, page_id, cast(char_no as int) as char_no, c, x0, y0, cast(1 as double) as dir_cos, cast(0 as double) as dir_sin from g")
def glyph_scan(spark, d):
    g = I.glyphs(spark, d)
    chars = F.transform(F.sort_array(F.collect_list(F.struct("char_no", "c", "bbox"))), lambda x: F.struct(x["c"].alias("c"), _corners(x["bbox"]).alias("bbox")))
    line = F.struct(F.array(F.lit(1.0), F.lit(0.0)).alias("dir"), F.array(F.struct(chars.alias("chars"))).alias("spans"))
    raw = g.groupBy("doc_id", "page_id").agg(F.to_json(F.struct(F.array(F.struct(F.array(line).alias("lines"))).alias("blocks"))).alias("json"))
    return dumps.glyphs(raw).select("doc_id", "page_id", "char_no", "c", "bbox.x0", "bbox.y0", "dir_cos", "dir_sin")


def _dumped_lines(spark, d):
    b = I.blocks(spark, d)
    line = F.transform(F.sort_array(F.collect_list(F.struct("block_no", "bbox", "content"))), lambda x: F.struct(_corners(x["bbox"]).alias("bbox"), F.array(F.struct(x["content"].alias("text"))).alias("spans")))
    return b.groupBy("doc_id", "page_id").agg(F.to_json(F.struct(F.array(F.struct(line.alias("lines"))).alias("blocks"))).alias("json"))


@_query(f"with {I.BLOCKS} select doc_id, page_id, cast(row_number() over (partition by doc_id, page_id order by block_no) - 1 as int) as line_no, x0, y0, x1, y1, content as text from b")
def text_line_scan(spark, d):
    return dumps.text_lines(_dumped_lines(spark, d)).select("doc_id", "page_id", "line_no", "bbox.*", "text")


@_query(f"""with {I.BLOCKS}, n as (select *, case type when 'title' then 0 when 'text' then 1 when 'discarded' then 2 else 3 end as category_id,
    cast(row_number() over (partition by doc_id, page_id order by block_no) - 1 as int) as det_id from b)
  select doc_id, page_id, det_id, cast(category_id as int) as category_id, x0, y0, x1, y1, det_id / 100 as score from n where category_id in (0, 1)""")
def detection_scan(spark, d):
    b = I.blocks(spark, d)
    category = F.when(F.col("type") == "title", 0).when(F.col("type") == "text", 1).when(F.col("type") == "discarded", 2).otherwise(3)
    rows = F.sort_array(F.collect_list(F.struct("block_no", category.alias("category_id"), "bbox")))
    found = F.transform(rows, lambda x, i: F.struct(x["category_id"].alias("category_id"), F.array(*[x["bbox"][c] for c in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")]).alias("poly"), (i / 100).alias("score")))
    raw = b.groupBy("doc_id", "page_id").agg(F.to_json(found).alias("json"))
    return dumps.of_categories(dumps.detections(raw), 0, 1).select("doc_id", "page_id", "det_id", "category_id", "bbox.*", "score")


_DOUBLED = f"""{I.SPANS}, v as (
    select doc_id, page_id, span_no * 2 as span_no, x0, y0, x1, y1, span_no % 5 / 10 as score from s where x1 > x0
    union all select doc_id, page_id, span_no * 2 + 1, x0, y0, case span_no % 3 when 0 then x1 when 1 then (x0 + x1) / 2 else x0 + 1 end, y1 + span_no % 3, span_no % 2 / 4 from s where x1 > x0),
  o as (select s.doc_id, s.page_id, s.span_no, s.x0, s.y0, s.x1, s.y1, s.score, t.span_no as other, t.score as o_score, (t.x1 - t.x0) * (t.y1 - t.y0) as o_area, (s.x1 - s.x0) * (s.y1 - s.y0) as area,
      greatest(0, least(s.x1, t.x1) - greatest(s.x0, t.x0)) * greatest(0, least(s.y1, t.y1) - greatest(s.y0, t.y0)) as shared
    from v s join v t on s.doc_id = t.doc_id and s.page_id = t.page_id and s.span_no <> t.span_no),
  k as (select * from v where not exists (select 1 from o where o.doc_id = v.doc_id and o.page_id = v.page_id and o.span_no = v.span_no
      and shared > (area + o_area - shared) * 0.9 and (o.score < o_score or (o.score = o_score and o.span_no > other))))"""


@_query(f"""with {_DOUBLED} select doc_id, page_id, span_no from k where not exists (select 1 from o join k j on j.doc_id = o.doc_id and j.page_id = o.page_id and j.span_no = o.other
    where o.doc_id = k.doc_id and o.page_id = k.page_id and o.span_no = k.span_no and shared > area * 0.65 and (area < o_area or (area = o_area and o.span_no > other)))""")
def span_overlap_drop(spark, d):
    s, b = I.spans(spark, d).filter("bbox.x1 > bbox.x0"), F.col("bbox")
    n = F.col("span_no")
    one = s.select("doc_id", "page_id", (n * 2).alias("span_no"), "bbox", (n % 5 / 10).alias("score"))
    right = F.when(n % 3 == 0, b["x1"]).when(n % 3 == 1, (b["x0"] + b["x1"]) / 2).otherwise(b["x0"] + 1)
    two = s.select("doc_id", "page_id", (n * 2 + 1).alias("span_no"), G.box(b["x0"], b["y0"], right, b["y1"] + n % 3).alias("bbox"), (n % 2 / 4).alias("score"))
    return A.without_overlaps(one.unionByName(two)).select("doc_id", "page_id", "span_no")


@_query(f"""with {I.SPANS}, v as (select doc_id, page_id, span_no, x0, y0, case when span_no % 11 = 1 then x0 + 12 else x1 end as x1, case when span_no % 11 = 1 then y0 + (x1 - x0) else y1 end as y1
    from s where type not in ('interline_equation', 'image', 'table')),
  m as (select *, median(y1 - y0) over (partition by doc_id, page_id) as mh from v),
  f as (select s.doc_id, s.page_id, s.span_no, any_value(y1_ - y0_ > mh * 3 and y1_ - y0_ > (x1_ - x0_) * 3) as tall, min((b.type = 'discarded', b.block_no))[1] as gone
    from (select *, x0 as x0_, x1 as x1_, y0 as y0_, y1 as y1_ from m) s join b on b.doc_id = s.doc_id and b.page_id = s.page_id and b.type not in ('image_body', 'table_body', 'interline_equation') where {_OVER} > 0.5 group by all)
  select doc_id, page_id, span_no, case when tall then 'vertical' when gone then 'unuseful' else 'useful' end as class from f""")
def span_class(spark, d):
    return A.classified(_tall(I.spans(spark, d)), I.blocks(spark, d))


@_query(f"""with {I.BLOCKS}, l2 as (select doc_id, page_id, block_no as line_no, x0, y0, x1, y1, content as text from b), v as (select doc_id, page_id, block_no // 4 as span_no, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from b group by all),
  f as (select s.doc_id, s.page_id, s.line_no, s.text, min(b.span_no) as span_no from l2 s join v b on b.doc_id = s.doc_id and b.page_id = s.page_id where {_OVER} > 0.5 group by all)
  select doc_id, page_id, span_no, string_agg(text, '' order by line_no) as content from f group by all having string_agg(text, '' order by line_no) <> ''""")
def vertical_text(spark, d):
    b = I.blocks(spark, d)
    lines = b.select("doc_id", "page_id", F.col("block_no").alias("line_no"), "bbox", F.col("content").alias("text"))
    box = G.box(F.min("bbox.x0"), F.min("bbox.y0"), F.max("bbox.x1"), F.max("bbox.y1"))
    spans = b.groupBy("doc_id", "page_id", F.floor(F.col("block_no") / 4).alias("span_no")).agg(box.alias("bbox"))
    return A.vertical_text(lines, spans)


@_query(f"""with {I.BLOCKS}, g as (select doc_id, page_id, block_no // 3 as group_no, dense_rank() over (partition by doc_id, page_id order by block_no // 3) - 1 as group_id,
    row_number() over (partition by doc_id, page_id, block_no // 3 order by block_no) as n, x0, y0, x1, y1 from b)
  select doc_id, page_id, cast(group_id as int) as group_id, case n when 1 then 'body' when 2 then 'caption' else 'footnote' end as role, x1, y0 from g""")
def group_flatten(spark, d):
    boxes = F.transform(F.sort_array(F.collect_list(F.struct("block_no", "bbox"))), lambda x: x["bbox"])
    g = I.blocks(spark, d).groupBy("doc_id", "page_id", F.floor(F.col("block_no") / 3).alias("group_no")).agg(boxes.alias("boxes"))
    g = g.select("doc_id", "page_id", "group_no", F.col("boxes")[0].alias("body"), F.slice("boxes", 2, 1).alias("captions"), F.slice("boxes", 3, 9).alias("footnotes"))
    return A.flattened_groups(g).select("doc_id", "page_id", "group_id", "role", "bbox.x1", "bbox.y0")


@_query(f"""with {I.BLOCKS}, k as (select * from b where type <> 'discarded'), m as (select doc_id, page_id, max(block_no) as last from k group by all)
  select doc_id, page_id, block_no, type, content from k
  union all select d.doc_id, d.page_id, coalesce(last, -1) + row_number() over (partition by d.doc_id, d.page_id order by d.block_no), type, content from b d left join m on m.doc_id = d.doc_id and m.page_id = d.page_id where type = 'discarded'""")
def block_union(spark, d):
    b = I.blocks(spark, d).select("doc_id", "page_id", "block_no", "type", "content")
    return A.all_blocks(b.filter("type <> 'discarded'"), b.filter("type = 'discarded'"))


@_query(f"with {I.BLOCKS} select doc_id, page_id, block_no // 4 as block_no, string_agg(content, '' order by block_no) as content from (select doc_id, page_id, block_no, content from b) t group by doc_id, page_id, block_no // 4")
def block_text(spark, d):
    b = I.blocks(spark, d)
    return A.block_text(b.select("doc_id", "page_id", F.floor(F.col("block_no") / 4).alias("block_no"), F.col("block_no").alias("line_no"), F.lit(0).alias("span_no"), "content"))


@_query(f"""with {I.BLOCKS}, v as (select doc_id, page_id, block_no // 4 as g, median(block_no % 17) filter (block_no % 3 = 0) as m, max(block_no) as own from b group by all)
  select doc_id, page_id, g as block_no, coalesce(m, own) as idx from v""")
def block_place(spark, d):
    b = I.blocks(spark, d).withColumn("g", F.floor(F.col("block_no") / 4))
    blocks = b.groupBy("doc_id", "page_id", F.col("g").alias("block_no2")).agg(F.max("block_no").alias("position")).withColumnRenamed("block_no2", "block_no")
    lines = b.filter("block_no % 3 = 0").select("doc_id", "page_id", F.col("g").alias("block_no"), (F.col("block_no") % 17).alias("position"))
    return A.block_places(blocks, lines)


@_query(f"""with {I.BLOCKS}, p as (select distinct doc_id, page_id from b), k as (select doc_id, page_id, list(block_no order by block_no) as nos from b where page_id % 2 = 0 and type = 'title' group by all)
  select p.doc_id, p.page_id, cast(coalesce(len(nos), 0) as int) as n_blocks, coalesce(array_to_string(nos, ','), '') as block_nos from p left join k using (doc_id, page_id)""")
def page_blocks(spark, d):
    b = I.blocks(spark, d)
    rows = A.page_rows(b.select("doc_id", "page_id").distinct(), b.filter("page_id % 2 = 0 and type = 'title'"))
    return rows.withColumn("block_nos", F.array_join(F.transform("block_nos", lambda x: x.cast("string")), ","))


@_query(f"""with {I.SPANS}, g as (select doc_id, page_id, block_no as det_id, block_no % 2 as category_id, x0, y0, x1, y1 from b), f as (select * from s where type = 'interline_equation'),
  n as (select g.doc_id, g.page_id, g.det_id, category_id, count(f.span_no) as n from g left join f on f.doc_id = g.doc_id and f.page_id = g.page_id
    and greatest(0, least(g.x1, f.x1) - greatest(g.x0, f.x0)) * greatest(0, least(g.y1, f.y1) - greatest(g.y0, f.y0)) > 0 group by all)
  select doc_id, page_id, det_id, n as n_formulas, category_id = 1 and n > 0 as gated from n""")
def formula_gate(spark, d):
    regions = I.blocks(spark, d).select("doc_id", "page_id", F.col("block_no").alias("det_id"), (F.col("block_no") % 2).alias("category_id"), "bbox")
    return A.formulas_in_crops(regions, I.spans(spark, d).filter("type = 'interline_equation'"))


@_query(f"""with {I.BLOCKS} select doc_id, page_id, block_no as crop_no, printf('%04d_%04d', page_id, block_no) as name from b where type = 'image_body' and content not like '%e%'""")
def dead_letters(spark, d):
    crops = I.blocks(spark, d).filter("type = 'image_body'").select("doc_id", "page_id", F.col("block_no").alias("crop_no"), F.when(F.col("content").contains("e"), F.col("content")).otherwise("").alias("text"))
    return A.unread(crops).drop("text")


@_query(f"with {I.BLOCKS} select doc_id, page_id, block_no from b where round(block_no % 7 / 20, 2) > 0.20 and block_no % 3 / 2 > 0.5 and length(content) > 0")
def reading_gates(spark, d):
    b = I.blocks(spark, d)
    kept = b.filter(A.worth_reading(F.bround(F.col("block_no") % 7 / 20, 2))).filter(A.well_read(F.col("content"), F.col("block_no") % 3 / 2))
    return kept.select("doc_id", "page_id", "block_no")


@_query("select doc_id, case when doc_id % 5 = 0 or n_chars < 200 then 'ocr' else 'txt' end as route from documents")
def read_route(spark, d):
    return I.table(spark, d, "documents").select("doc_id", A.route(F.col("n_chars") < 200, F.col("doc_id") % 5 == 0).alias("route"))


@_query("""with p as (select page_id // 9 as doc_id, row_number() over (partition by page_id // 9 order by page_id) - 1 as id from pages)
  select doc_id, cast(id as int) as seq, case when id % 3 = 0 then '' else cast(id - id % 3 as varchar) end as parents from p""")
def outline_ancestors(spark, d):
    return A.ancestors(outline_scan(spark, d)).withColumn("parents", F.array_join(F.transform("parents", lambda x: x.cast("string")), ","))


@_query(f"""with {I.BLOCKS} select doc_id, '[' || string_agg('{{"type":"' || type || '","text":' || to_json(content)::varchar || case when type = 'title' then ',"text_level":' || (block_no % 4 + 1) else '' end || ',"page_idx":' || page_id || '}}', ','
    order by page_id, block_no) || ']' as json from b group by doc_id""")
def content_list(spark, d):
    b = I.blocks(spark, d).withColumn("idx", F.col("block_no")).withColumn("grade", F.when(F.col("type") == "title", F.col("block_no") % 4 + 1))
    return dumps.content_list(b)


@_query()
def page_list(spark, d):
    b = I.blocks(spark, d)
    pages = b.select("doc_id", "page_id").distinct().select("*", F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"), (F.col("page_id") == 1).alias("need_drop"), F.array(F.lit("skip page")).alias("drop_reason"))
    return dumps.page_list(pages, b.filter("page_id <> 1"))


# Headings corrected by a model


def _headings(spark, d):
    return markdown.headings(I.md_lines(spark, d).withColumnRenamed("i", "line_no")).select("doc_id", "line_no", "line")


def _answers(spark, d):
    """The headings on other levels, some missing."""
    rows = _headings(spark, d).filter("line_no % 5 <> 3")
    level = F.repeat(F.lit("#"), (F.col("line_no") % 3 + 1).cast("int"))
    return rows.withColumn("line", F.concat(level, F.lit(" "), T.strip_heading(F.col("line"))))


_ANSWERED = f"""with recursive {I.MD_LINES}, h as (select doc_id, i as line_no, i % 3 + 1 as g, repeat('#', cast(i % 3 + 1 as int)) || ' ' || regexp_replace(line, '^#{{1,6}} ', '') as line
    from l where {_HEAD} and trim(substr(line, instr(line, ' '))) <> '' and i % 5 <> 3),
  n as (select *, row_number() over (partition by doc_id order by line_no desc) as k from h)"""
_PLACED = "select doc_id, row_number() over (partition by doc_id order by line_no) - 1 as place, line from z where keep"


@_query()
def header_merge(spark, d):
    return H.corrected_headings(_headings(spark, d), _answers(spark, d))


@_query()
def header_merge_easy(spark, d):
    return H.corrected_headings(_headings(spark, d), _answers(spark, d), easy=True)


@_query(_ANSWERED + """, z as (select doc_id, k, line_no, line, g as last, true as keep from n where k = 1
    union all select n.doc_id, n.k, n.line_no, n.line, case when z.last - n.g <= 1 then n.g else z.last end, z.last - n.g <= 1 from z join n on n.doc_id = z.doc_id and n.k = z.k + 1) """ + _PLACED)
def grade_jump_drop(spark, d):
    return H.by_document(_answers(spark, d), lambda lines: H.without_jumps(lines)[0])


@_query(_ANSWERED + """, z as (select doc_id, k, line_no, line, g as level, 4 as room, false as over, true as keep from n where k = 1
    union all select n.doc_id, n.k, n.line_no, n.line, case when not z.over and n.g < z.level then n.g else z.level end,
      case when not z.over and n.g < z.level then 4 when not z.over and n.g = z.level and z.room > 0 then z.room - 1 else z.room end,
      z.over or (n.g = z.level and z.room = 0 and z.level = 1), not z.over and (n.g < z.level or (n.g = z.level and z.room > 0)) from z join n on n.doc_id = z.doc_id and n.k = z.k + 1) """ + _PLACED)
def header_history(spark, d):
    return H.by_document(_answers(spark, d), lambda lines: H.remembered(lines, []))


# Model calls


@_query(f"""with {I.ASKED}, {I.MEMO}, b as (select agent, prompt, (max((seq, response)))[2] as response from m group by all)
  select k.doc_id, k.chunk_no, k.agent, k.prompt, b.response, b.prompt is not null as hit from k left join b using (agent, prompt)""")
def cache_lookup(spark, d):
    return C.with_memo(I.asked(spark, d), I.memo(spark, d)).select("doc_id", "chunk_no", "agent", "prompt", "response", "hit")


@_query(f"with {I.MEMO} select agent, prompt, (max((seq, response)))[2] as response, max(seq) as seq from m group by agent, prompt")
def cache_last_wins(spark, d):
    return C.compacted(I.memo(spark, d))


@_query(f"with {I.ASKED}, {I.MEMO} select doc_id, chunk_no, agent, prompt from k where not exists (select 1 from m where m.agent = k.agent and m.prompt = k.prompt)")
def cache_misses(spark, d):
    return C.misses(I.asked(spark, d), I.memo(spark, d)).select("doc_id", "chunk_no", "agent", "prompt")


@_query(f"with {I.CALLS} select doc_id, chunk_no, 'g' || ((row_number() over (partition by doc_id order by chunk_no) - 1) % 3) as agent from k")
def agent_round_robin(spark, d):
    return C.dealt(I.calls(spark, d).drop("agent"), ("g0", "g1", "g2")).select("doc_id", "chunk_no", "agent")


@_query()
def translate_mock(spark, d):
    return C.translated(I.table(spark, d, "documents").select("doc_id", "text"), agents=("a", "b"))


@_query(f"with {I.REQUESTS} select agent, request_id, count(*) over w as n_window, cast(sum(tokens) over w as bigint) as tokens_window from q window w as (partition by agent order by us range between 60999999 preceding and current row)")
def offered_load(spark, d):
    return R.offered_load(I.requests(spark, d)).select("agent", "request_id", "n_window", "tokens_window")


@_query(f"""with recursive {I.REQUESTS}, n as (select *, row_number() over (partition by agent order by us, request_id) as k from q),
  r as (select distinct agent, cast(0 as bigint) as k, cast([] as struct(u bigint, n bigint)[]) as held, cast(null as bigint) as request_id, cast(null as bigint) as us, cast(null as bigint) as tokens, false as admitted from q
    union all select agent, k, case when ok then list_append(kept, {{'u': us, 'n': tokens}}) else kept end, request_id, us, tokens, ok from (
      select *, len(held) = 0 or (coalesce(list_sum(list_transform(kept, lambda x: x.n)), 0) + tokens <= 40000 and len(kept) + 1 <= 10) as ok from (
        select n.*, r.held, list_filter(r.held, lambda x: (n.us - x.u) // 1000000 <= 60) as kept from r join n on n.agent = r.agent and n.k = r.k + 1)))
  select agent, request_id, us, tokens, admitted from r where k > 0""")
def rate_admission(spark, d):
    return R.admissions(I.requests(spark, d), rpm=10, tpm=40_000)


@_query()
def rate_retried(spark, d):
    return R.retried(I.requests(spark, d), rpm=10, tpm=40_000, wait=3600, retries=5)


class _SaysCode:
    """Answers 1 to a prompt with a fence, else 2."""

    def ask(self, prompt: str) -> str:
        return "<think>look for a fence</think> 1" if "```" in prompt else "2"


@_query(f"with {I.MD_TEXT} select doc_id, contains(text, '```') as has_code from t")
def code_classified(spark, d):
    return C.has_code(I.md_text(spark, d), _SaysCode).select("doc_id", "has_code")


class Deeper:
    """Answers with the headings of the prompt's last part, every other one a level deeper; on a later section it
    repeats those it was shown before, as models do."""

    def ask(self, prompt: str) -> str:
        *_, shown = prompt.split("alone:\n", 1)
        shown = shown.replace("-----:\n", "")
        lines = [x for x in shown.split("\n") if H.grade(x) > 0]
        return "\n".join("#" * (1 + len(H.bare(x)) % 2) + " " + H.bare(x) for x in lines)


@_query()
def header_sections_corrected(spark, d):
    return H.levels_by_model(_headings(spark, d), Deeper, size=400)


@_query()
def header_outline_corrected(spark, d):
    return H.levels_by_model(_headings(spark, d), Deeper, easy=True)


# Small functions, each over whole tables


@_query(f"with {I.MD_LINES} select doc_id, i from l where abs(1 - i % 9 / 10.0) >= 0.9 and abs(i % 4 / 20.0) <= 0.1")
def level_filter(spark, d):
    return I.md_lines(spark, d).filter(G.is_level(F.lit(1.0) - F.col("i") % 9 / 10.0, F.col("i") % 4 / 20.0)).select("doc_id", "i")


@_query(f"with {I.SPANS} select doc_id, page_id, span_no from s where type not in ('interline_equation', 'image', 'table')")
def text_span_filter(spark, d):
    return A.text_spans(I.spans(spark, d)).select("doc_id", "page_id", "span_no")


@_query(f"with {I.MD_LINES} select doc_id, i, regexp_extract(line, '^#{{1,6}} [A-Za-z0-9_À-ÿ]+ *') as strict from l where regexp_matches(line, '^#{{1,6}} [A-Za-z0-9_À-ÿ]')")
def heading_strict(spark, d):
    rows = I.md_lines(spark, d).withColumn("strict", T.strict_heading(F.col("line")))
    return rows.filter("strict is not null").select("doc_id", "i", "strict")


@_query(f"with {I.OUTLINE} select doc_id, seq from o where page - 1 >= 0 and page - 1 < 3")
def outline_valid(spark, d):
    return O.inside(I.outline(spark, d).withColumn("page", F.col("page") - 1), 3).select("doc_id", "seq")


@_query(f"""with {I.MD_LINES}, v as (select doc_id, i, '<table>' || line || case i % 4 when 0 then '</table>' when 1 then '</html> ' when 2 then '</table>x' else '' end as html from l)
  select doc_id, i, ends_with(trim(html), '</table>') or ends_with(trim(html), '</html>') as valid from v""")
def table_valid(spark, d):
    k = F.col("i") % 4
    html = F.concat(F.lit("<table>"), "line", F.when(k == 0, "</table>").when(k == 1, "</html> ").when(k == 2, "</table>x").otherwise(""))
    return I.md_lines(spark, d).select("doc_id", "i", L.valid_table(html).alias("valid"))


@_query(f"with {I.BLOCKS} select doc_id, page_id, block_no, greatest(0, x0 - 25) as x0, greatest(0, y0 - 25) as y0, greatest(0, x1 - 25) as x1, greatest(0, y1 - 25) as y1 from b")
def box_clamp(spark, d):
    b = F.col("bbox")
    moved = G.box(b["x0"] - 25, b["y0"] - 25, b["x1"] - 25, b["y1"] - 25)
    return I.blocks(spark, d).select("doc_id", "page_id", "block_no", G.clamped(moved).alias("c")).select("doc_id", "page_id", "block_no", "c.*")


@_query(f"with {I.BLOCKS} select doc_id, page_id, block_no, x0 - 50 + 7.0 as x0, y0 - 50 + block_no as y0, x1 - 50 + 7.0 as x1, y1 - 50 + block_no as y1 from b")
def crop_to_page(spark, d):
    crop = F.struct(F.lit(50.0).alias("paste_x"), F.lit(50.0).alias("paste_y"), F.lit(7.0).alias("xmin"), F.col("block_no").alias("ymin"))
    return I.blocks(spark, d).select("doc_id", "page_id", "block_no", G.from_crop(F.col("bbox"), crop).alias("c")).select("doc_id", "page_id", "block_no", "c.*")


_PREVIOUS = """, w as (select doc_id, page_id, block_no, x0, y0, x1, y1, lag(x0) over v as px0, lag(y0) over v as py0, lag(x1) over v as px1, lag(y1) over v as py1
  from b window v as (partition by doc_id, page_id order by block_no))"""


def _with_previous(spark, d):
    from pyspark.sql import Window as W

    rows = I.blocks(spark, d).withColumn("before", F.lag("bbox").over(W.partitionBy("doc_id", "page_id").orderBy("block_no")))
    return rows.filter("before is not null")


@_query(f"with {I.BLOCKS}{_PREVIOUS} select doc_id, page_id, block_no, least(x0, px0) as x0, least(y0, py0) as y0, greatest(x1, px1) as x1, greatest(y1, py1) as y1 from w where px0 is not null")
def box_union(spark, d):
    return _with_previous(spark, d).select("doc_id", "page_id", "block_no", G.union(F.col("bbox"), F.col("before")).alias("u")).select("doc_id", "page_id", "block_no", "u.*")


@_query(f"""with {I.BLOCKS}{_PREVIOUS}, k as (select *, py0 + 15 as by0, py1 + 15 as by1 from w where px0 is not null)
  select doc_id, page_id, block_no, greatest(0, least(y1, by1) - greatest(y0, by0)) / least(y1 - y0, by1 - by0) >= 0.5 as level from k""")
def row_overlap(spark, d):
    p = F.col("before")
    low = G.box(p["x0"], p["y0"] + 15, p["x1"], p["y1"] + 15)
    return _with_previous(spark, d).select("doc_id", "page_id", "block_no", (G.row_overlap(F.col("bbox"), low) >= 0.5).alias("level"))


@_query(f"with {I.MD_LINES} select doc_id, i, replace(replace(line, 'e', chr(39)), 's', chr(39)) as clean from l")
def control_quotes(spark, d):
    return I.md_lines(spark, d).select("doc_id", "i", T.quotes_for_controls(F.translate("line", "es", "\x02\x03")).alias("clean"))


@_query(f"with {I.MD_LINES}, v as (select doc_id, i, repeat(' ', cast(i % 6 as int)) || line as v from l) select doc_id, i, length(v) - length(ltrim(v, ' ')) as n from v")
def indent_width(spark, d):
    return I.md_lines(spark, d).select("doc_id", "i", T.indent_width(F.concat(F.repeat(F.lit(" "), (F.col("i") % 6).cast("int")), "line")).cast("long").alias("n"))


@_query(f"with {I.MD_LINES} select doc_id, i, 'Part ' || i || ' of ' || doc_id || ': ' || line as prompt from l")
def prompt_filled(spark, d):
    return I.md_lines(spark, d).select("doc_id", "i", T.filled("Part {i} of {doc}: {line}", i=F.col("i"), doc=F.col("doc_id"), line=F.col("line")).alias("prompt"))


@_query("select doc_id, md5(text) as md5, strlen(text) as length from documents where text is not null")
def document_md5(spark, d):
    rows = I.table(spark, d, "documents").filter("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return rows.select("doc_id", files.content_md5(F.col("content")).alias("md5"), F.octet_length("content").cast("long").alias("length"))


@_query("with p as (select page_id, list_last(string_split(url, '/')) as last from pages) select page_id, regexp_replace(last, '[.][^.]*$', '') as stem from p")
def path_stem(spark, d):
    return I.table(spark, d, "pages").select("page_id", markdown.stem(F.col("url")).alias("stem"))


@_query(f"""with {I.MD_LINES}, n as (select *, sum(case when i > 1 and regexp_matches(line, '^#{{1,2}} ') then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) as k from l),
  g as (select doc_id, k, string_agg(line, chr(10) order by i) as t, max(i) as last from n group by doc_id, k), m as (select doc_id, max(i) as n from l group by doc_id)
  select g.doc_id, cast(k as bigint) as section_no, t || case when last < m.n then chr(10) else '' end as section from g join m on m.doc_id = g.doc_id""")
def header_section_split(spark, d):
    rows = I.md_text(spark, d).select("doc_id", F.posexplode(K.header_sections(F.col("text"))).alias("section_no", "section"))
    return rows.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "section")


@_query(f"""with {I.SPANS} select s.doc_id, s.page_id, s.span_no, min(b.block_no) as block_no from s join b on b.doc_id = s.doc_id and b.page_id = s.page_id
  where b.type = 'discarded' and {_OVER} > 0.4 and s.type = 'text' group by all""")
def span_discarded_block(spark, d):
    gone = I.blocks(spark, d).filter("type = 'discarded'")
    return L.first_block(I.spans(spark, d), gone, 0.4, True).filter("block_no is not null").select("doc_id", "page_id", "span_no", "block_no")


@_query(f"with {I.BLOCKS} select doc_id, page_id, cast(count(*) as int) as n, string_agg(block_no, ',' order by block_no) as seqs from b where type = 'title' group by all")
def outline_by_page(spark, d):
    return O.by_page(I.outline(spark, d)).select("doc_id", "page_id", F.size("entries").alias("n"), F.array_join(F.transform("entries", lambda e: e["seq"].cast("string")), ",").alias("seqs"))


@_query(f"""with {I.MD_LINES}, h as (select doc_id, i, line from l where {_HEAD} and trim(substr(line, instr(line, ' '))) <> '')
  select doc_id, string_agg(line || chr(10), '' order by i) as headings from h group by doc_id""")
def heading_text(spark, d):
    return markdown.rebuilt(_headings(spark, d).withColumn("line", F.concat("line", F.lit("\n"))), "").withColumnRenamed("text", "headings")


# Chunks


@_query(f"""with {I.MD_LINES}, n as (select *, sum(case when i > 1 and regexp_matches(line, '^#{{1,6}} ') then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) as k from l)
  select doc_id, cast(k as bigint) as section_no, (case when k > 0 then chr(10) else '' end) || string_agg(line, chr(10) order by i) as section from n group by doc_id, k""")
def chunk_stage1(spark, d):
    rows = I.md_text(spark, d)
    return rows.select("doc_id", F.posexplode(K.sections(F.col("text"))).alias("section_no", "section")).withColumn("section_no", F.col("section_no").cast("long"))


@_query(r"select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n\f\v]')) as n_tokens from documents")
def chunk_tokens(spark, d):
    return I.table(spark, d, "documents").select("doc_id", T.approx_tokens(F.col("text")).cast("long").alias("n_tokens"))


@_query()
def chunk_pack(spark, d):
    return K.chunk(I.md_text(spark, d), 200, 20)
