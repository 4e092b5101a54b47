import math
import random

from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.operators import calls as C
from docloom.operators import chunks as K
from docloom.operators import headers as H
from docloom.operators import layout as L
from docloom.operators import outline as O
from docloom.sources import files, markdown
from docloom.streaming import rate as R


def test_chunks_lose_nothing():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "\n", "\n\n", "\n## head ", "x" * 30, "é,", " "]) for _ in range(rng.randint(0, 120)))
        for size, title in ((5, 0), (20, 4), (1, 0)):
            chunks = K.split_markdown(text, size, title)
            assert "".join(chunks) == text
            assert all(K.token_length(c) <= size for c in chunks if len(c) > 1)


def test_merge_of_headings():
    own = ["# Intro\n", "# Noise\n", "# Setup\n", "# End\n"]
    assert H.merge(["# Intro", "## Setup"], own) == ["# Intro  \n", "Noise\n", "## Setup  \n", "# End\n"]
    assert H.merge(["# Intro", "## Something else entirely"], own) is None
    assert H.merge_easy(["# Intro", "## Something else entirely", "## End"], own) == ["# Intro  \n", "Noise\n", "Setup\n", "## End  \n"]
    many = [f"# {chr(97 + k) * 9}\n" for k in range(12)]
    assert H.merge([many[11].strip()], many) is None and H.merge([many[11].strip()], many, allowed=11) is not None


def test_history_and_jumps():
    assert H.without_jumps(["# a", "# b", "### c"]) == (["### c"], 2)
    assert H.without_jumps(["# a", "## b", "### c"]) == (["# a", "## b", "### c"], 0)
    assert H.remembered(["# a", "## b", "### c", "## d"], []) == ["# a", "## b", "## d"]
    assert H.remembered([f"# {k}" for k in range(9)], []) == [f"# {k}" for k in range(4, 9)]
    assert H.without_repeats(["# a one"], ["# a one", "## b two"], "# b two\n") == ["## b two"]
    assert H.without_repeats(["# alpha one"], ["# beta seven"], "# beta seven\n") == ["# beta seven"]


def test_outline_preorder():
    node = lambda i, down, nxt, page, internal=True: {"id": i, "down": down, "next": nxt, "page": page, "x": 0.0, "y": 0.0, "title": str(i), "internal": internal}
    tree = [node(0, 1, 3, 0), node(1, 2, None, 9), node(2, None, None, 1), node(3, None, None, 2)]
    assert [(r[1], r[5], r[6]) for r in O.preorder(tree, 0, 3)] == [("0", 1, None), ("2", 2, 0), ("3", 1, None)]
    assert [r[1] for r in O.preorder(tree, 0, None)] == ["0", "1", "2", "3"]
    assert [r[1] for r in O.preorder([node(0, None, 1, 0), node(1, None, 2, 0, False), node(2, None, None, 0)], 0, 3)] == ["0"]


def _marks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, seq int, title string, page int, x double, y double, grade int")


def test_placement(spark):
    nan = math.nan
    rows = [(1, 0, "a", 0, 1.0, 5.0, 1), (1, 1, "b", 0, 2.0, 90.0, 1), (2, 0, "a", 0, 1.0, nan, 1), (3, 0, "a", 0, nan, 7.0, 1), (3, 1, "b", 0, 1.0, 7.0, 1), (3, 2, "c", 0, 1.0, 7.0, 1), (4, 0, "a", 0, 0.0, 0.0, 1)]
    got = {r.doc_id: (r.match_type, r.dist_type) for r in O.placement(_marks(spark, rows)).collect()}
    assert got == {1: ("distance", "dist_xy"), 2: ("edit_dist", "dist_y"), 3: ("edit_dist", "dist_y"), 4: ("edit_dist", "dist_y")}


def _blocks(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, page_id long, block_no long, type string, y0 double, content string")
    return df.withColumn("bbox", G.box(F.lit(0.0), F.col("y0"), F.lit(100.0), F.col("y0") + 10))


def test_named_blocks(spark):
    blocks = _blocks(spark, [(1, 0, 0, "discarded", 0.0, "Chapter 1"), (1, 0, 1, "text", 12.0, "Beginnings"), (1, 0, 2, "title", 50.0, "no title"), (1, 1, 3, "title", 0.0, "left"), (2, 0, 0, "title", 0.0, "stays")])
    marks = _marks(spark, [(1, 0, "Chapter 1Beginnings", 0, 0.0, 1.0, 2), (1, 1, "x", 0, 5.0, 900.0, 1)])
    got = {(r.doc_id, r.block_no): (r.type, r.grade, r.title) for r in O.named_blocks(blocks, marks, O.placement(marks)).collect()}
    assert got[1, 1] == ("title", 2, "Chapter 1Beginnings")
    assert got[1, 0][0] == "discarded" and got[1, 2][0] == "text" and got[1, 3][0] == "text" and got[2, 0][0] == "title"


def test_matching_by_text_is_strict():
    block = lambda k, t: {"block_no": k, "y0": float(k), "type": "text", "content": t}
    mark = {"title": "abcdefghij", "grade": 1}
    assert O._by_text([block(0, "abcdefgxyz")], [mark]) == {}  # three edits of ten: not under three
    assert O._by_text([block(0, "abcdefghyz")], [mark]) == {0: (1, "abcdefghij")}
    assert O._by_text([block(0, "late one here"), block(1, "first one here")], [{"title": "first one here", "grade": 1}, {"title": "late one here", "grade": 1}]) == {1: (1, "first one here")}


def test_nearest_ties(spark):
    blocks = _blocks(spark, [(1, 0, 0, "text", 10.0, ""), (1, 0, 1, "text", 30.0, "")])
    marks = _marks(spark, [(1, 0, "a", 0, 0.0, 20.0, 1), (1, 1, "b", 0, 0.0, math.nan, 1)]).withColumn("page_id", F.lit(0).cast("long"))
    got = {r.seq: r.block_no for r in L.nearest_block(marks, blocks).collect()}
    assert got == {0: 0, 1: None}


def test_promotion_moves_all(spark):
    rows = _blocks(spark, [(1, 0, 0, "text", 0.0, "")])
    gone = _blocks(spark, [(1, 0, 5, "title", 0.0, ""), (1, 0, 6, "discarded", 0.0, ""), (1, 0, 7, "title", 0.0, "")])
    assert sorted((r.block_no, r.type) for r in L.promoted(rows, gone).collect()) == [(0, "text"), (1, "title"), (2, "title")]


def test_reading_order(spark):
    rows = [(1, 0, 0, "text", 40.0, ""), (1, 0, 1, "text", 0.0, ""), (1, 0, 2, "text", 20.0, "")]
    got = {r.block_no: r.idx for r in L.reading_order(_blocks(spark, rows)).collect()}
    assert got == {1: 0, 2: 1, 0: 2}


def test_rate_window():
    w = R.Window(rpm=2, tpm=10, gap=60)
    assert w.admit(0, 99)  # an empty window admits anything
    assert not w.admit(60_900_000, 5)  # 60.9 s: still there
    assert w.admit(61_000_000, 5) and w.admit(61_000_001, 5)
    assert not w.admit(61_000_002, 0)  # two requests
    assert R.Window(0, 0).admit(0, 1) and R.Window(0, 0).admit(0, 10**9)
    assert R.Window(rpm=1, tpm=100, records=[(0, 1)]).admit_with_retry(0, 1, wait=20, retries=5) == (True, 5, 80_000_000)


def test_rate_stream_equals_batch(spark, tmp_path):
    rows = [(k % 2, k, k * 7_000_000, 30) for k in range(60)]
    df = spark.createDataFrame(rows, "agent long, request_id long, us long, tokens long")
    want = sorted(map(tuple, R.admissions(df, rpm=5, tpm=150).collect()))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = R.admissions_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), rpm=5, tpm=150)
    q = stream.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("admitted").collect())) == want


class Failing:
    def ask(self, prompt):
        if "bad" in prompt:
            raise ValueError
        return "" if "empty" in prompt else "T"


def test_translation_keeps_failures(spark):
    docs = spark.createDataFrame([(1, " good \n"), (2, "bad"), (3, "empty")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in C.translated(docs, Failing).collect()}
    assert got == {1: " T \n", 2: "bad", 3: ""}


def test_memo(spark, tmp_path):
    memo = spark.createDataFrame([("a", "p", "old", 1), ("a", "p", "new", 2), ("b", "p", "other", 9)], "agent string, prompt string, response string, seq long")
    calls = spark.createDataFrame([("a", "p"), ("a", "q")], "agent string, prompt string")
    assert {(r.prompt, r.response, r.hit) for r in C.with_memo(calls, memo).collect()} == {("p", "new", True), ("q", None, False)}
    assert [r.prompt for r in C.misses(calls, memo).collect()] == ["q"]
    m = files.MARKS
    text = "\n".join([m["key_start"], "k", "2", m["key_end"], m["value_start"], "v", m["value_end"], "", "ignored"])
    assert files.parse_memo(text) == [("k\n2", "v")]
    (tmp_path / "memo.txt").write_text(text)
    assert [tuple(r) for r in files.import_memo(spark, str(tmp_path / "memo.txt"), "a").collect()] == [("a", "k\n2", "v", 0)]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# x\r\ny\rz\n")
    docs = markdown.read_markdown(spark, str(tmp_path / "a.md"))
    assert [r.line for r in markdown.lines(docs, keep_ends=True).orderBy("line_no").collect()] == ["# x\r\n", "y\r", "z\n"]
    found = files.read_binary(spark, str(tmp_path / "a.md"))
    assert files.pages_of(found, lambda content: [(1, 2)] * len(content)).count() == 9
    s = files.Settings({"a": {"b": 1}}, {"bee": "a.b"})
    assert s.override(bee=3, other=1) == ["other"] and s.get("a.b") == 3 and s.get("a.c", 7) == 7
