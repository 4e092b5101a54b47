import pytest
from pyspark.sql import functions as F

from docloom.functions import fuzzy as Z
from docloom.functions import geometry as G
from docloom.functions import text as T
from docloom.operators import code as D


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("line, wanted", [("  # x", "// # x"), ("###", "//#"), ("#", "#"), ("## a", "// a"), ("a # b", "a # b"), ("", "")])
def test_comment_mark(spark, line, wanted):
    assert value(spark, T.comment_mark(F.lit(line))) == wanted


def test_titles(spark):
    assert value(spark, T.decode_title(F.lit("# |@3@|Intro\n"))) == "### Intro\n"
    assert value(spark, T.decode_title(F.lit("# |@3@|"))) == "# |@3@|"
    assert value(spark, T.encode_title(F.lit("a \t b"), F.lit(2))) == "|@2@|a b"


@pytest.mark.parametrize("answer, wanted", [("</think>\n\n1", False), ("1.包含代码", True), ("<think>2</think> 1", True), ("2", False), (None, False)])
def test_is_yes(spark, answer, wanted):
    assert value(spark, T.is_yes(F.lit(answer).cast("string"))) is wanted


def test_keep_edges(spark):
    assert value(spark, T.keep_edges(F.lit(" \n a b\t"), F.lit(" X "))) == " \n X\t"
    assert value(spark, T.keep_edges(F.lit(" \n "), F.lit("X"))) == " \n X"


def test_inline(spark):
    line = "`a` " + "x" * 61 + " `b`"
    assert value(spark, T.clean_inline(F.lit(line))) == line.replace("`", "")
    assert value(spark, T.clean_inline(F.lit("`a` and `b`"))) == "`a` and `b`"


def test_ligatures_and_space(spark):
    assert value(spark, T.expand_ligatures(F.lit("eﬃcient ﬁsh ﬅ"))) == "efficient fish ft"
    assert value(spark, T.strip(F.lit("　 a\x1f"))) == "a"
    assert value(spark, T.heading_grade(F.lit("####### x"))) == -1
    assert value(spark, T.strip_heading(F.lit("### 环境"))) == "环境"


def test_edit_distance(spark):
    a, b = "05. 1.3.1 环境搭建", "05．1.3.1环境搭建"
    assert value(spark, F.levenshtein(F.lit(a), F.lit(b))) == 3
    steps = Z.edits(a, b)
    assert sum(s != "SKIP" for _, s in steps) == 3
    assert Z.edits("", "ab") == [("b", "ADD"), ("a", "ADD")]
    assert Z.same_heading("1 a b", "1ab$$$")


def test_threshold_edges(spark):
    # ten characters allow three edits, inclusive
    assert value(spark, Z.titles_match(F.lit("abcdefgxyz"), F.lit("abcdefghij")))
    assert not value(spark, Z.titles_match(F.lit("abcdefwxyz"), F.lit("abcdefghij")))
    assert not value(spark, Z.titles_match(F.lit(" "), F.lit("")))


def test_wrap():
    line = "    " + "word, " * 30 + "\n"
    pieces = D.wrap(line)
    assert all(len(p.rstrip("\n").rstrip()) <= 80 for p in pieces)
    assert "".join(p.strip() for p in pieces).replace(" ", "") == line.strip().replace(" ", "")
    assert D.wrap("short") == ["short"]
    deep = " " * 80 + "x" * 20
    assert "".join(D.wrap(deep)).count("x") == 20  # ends, though the indent exceeds the width
    assert D.wrap("x" * 100, force=False) == ["x" * 100]


def test_fences(spark):
    rows = [(1, k, line) for k, line in enumerate(["```python", "```", "a", "```cpp", "```python", "b", "```", "c"])]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, line string")
    state = lambda out: [r.in_code for r in out.orderBy("line_no").collect()]
    assert state(D.fence_state(df)) == [1, 0, 0, 1, 1, 1, 0, 0]
    assert state(D.fence_state(df, ("cpp",))) == [0, 0, 0, 1, 1, 1, 0, 0]


def test_image_links(spark):
    src, out = "a ![](images/x1.jpg) b ![](images/x2.jpg)", "A ![](images/y.jpg) B ![](images/z.jpg)"
    assert value(spark, D.repair_image_links(F.lit(src), F.lit(out))) == "A ![](images/x1.jpg) B ![](images/x2.jpg)"
    assert value(spark, D.repair_image_links(F.lit(src), F.lit("A ![](images/y.jpg)"))) == "A ![](images/y.jpg)"


def test_geometry(spark):
    box = lambda *v: G.box(*[F.lit(float(x)) for x in v])
    assert value(spark, G.overlap_share(box(0, 0, 10, 10), box(5, 0, 20, 10))) == 0.5
    assert value(spark, G.overlap_share(box(0, 0, 0, 10), box(0, 0, 20, 10))) == 0.0
    assert value(spark, F.size(G.synthetic_lines(box(0, 0, 250, 300), F.lit(10.0), F.lit(600.0), F.lit(800.0)))) == 31
    assert value(spark, F.size(G.synthetic_lines(box(0, 0, 100, 300), F.lit(10.0), F.lit(600.0), F.lit(800.0)))) == 1
    assert value(spark, G.scaled(box(-5, 0.0625, 700, 1), F.lit(500.0), F.lit(25.0))["y0"]) == 2.0  # half to even
    stop = G.glyph_in_span(box(98, 0, 104, 10), box(0, 0, 100, 10), F.lit("."))
    assert value(spark, stop) and not value(spark, G.glyph_in_span(box(98, 0, 104, 10), box(0, 0, 100, 10), F.lit("a")))
