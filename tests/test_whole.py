"""Whole results where a query once left something out."""

import random
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F

from docloom.functions import fuzzy as Z
from docloom.functions import text as T
from docloom.plans import catalogue
from docloom.plans import derived as I

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, e in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
    return row[-1]


@pytest.fixture(scope="module")
def titles(spark):
    """(doc_id, i): a heading and the one before it, of every character."""
    rows = I.md_lines(spark, SF).filter(T.is_heading(F.col("line"))).orderBy("doc_id", "i").collect()
    plain = [(r.doc_id, r.i, r.line.lstrip("#").lstrip(" ")) for r in rows]
    out = {(d, i): (a, b) for (d, i, a), (e, _, b) in zip(plain[1:], plain) if d == e}
    assert any(not (a + b).isascii() for a, b in out.values())
    return out


def test_title_distances_in_code_points(spark, titles):
    got = {(r.doc_id, r.i): r for r in catalogue.QUERIES["lev_match"](spark, SF).collect()}
    assert {k: r.dist for k, r in got.items()} == {k: distance(a.lower(), b.lower()) for k, (a, b) in titles.items()}
    for k, (a, b) in titles.items():
        x, y = a.strip().lower(), b.strip().lower()
        most = min(10, int(len(y) * 0.3))
        assert (got[k].most, got[k].same) == (most, x != "" and (x == y or distance(x, y) <= most)), k


def test_all_title_prefixes(spark, titles):
    got = {(r.doc_id, r.i): r.may for r in catalogue.QUERIES["prefix_match"](spark, SF).collect()}
    starts = ("part", "chapter", "appendix")
    assert got == {k: b.lower().startswith(a.split(" ")[0].lower()) or any(a.split(" ")[0].lower().startswith(s) and b.lower().startswith(s) for s in starts) for k, (a, b) in titles.items()}


def test_edits_in_bands(monkeypatch):
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 30))) for _ in range(2))
        monkeypatch.setattr(Z, "BAND", 1000)
        whole = Z.edits(a, b)
        monkeypatch.setattr(Z, "BAND", rng.randint(1, 6))
        assert Z.edits(a, b) == whole
        assert sum(s != "SKIP" for _, s in whole) >= distance(a, b)
        assert "".join(c for c, s in reversed(whole) if s in ("SKIP", "ADD", "REPLACE")) == b


def test_edits_of_long_texts_in_little_memory():
    a = "".join(random.Random(5).choice("abcdefgh") for _ in range(4000))
    tracemalloc.start()
    assert len(Z.edits(a, a[2:])) >= 4000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6  # the whole table takes 128 MB


def test_whole_benchmark_texts_are_traced(spark):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = catalogue.QUERIES["edit_trace"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        steps = r.trace[::-1]
        assert "".join(x.ch for x in steps if x.op != "DEL") == texts[r.item_id][2:]
        assert sum(x.op != "ADD" for x in steps) == len(texts[r.item_id])


def test_near_empty_spans_by_whole_content(spark):
    want = set()
    for r in I.md_lines(spark, SF).collect():
        n, shift = len(r.line), r.i % 4 * 3
        width = (n * 6 - shift * 3) * (10 if r.i % 7 == 2 else 1)
        if len(re.sub("^#+ ", "", r.line)) * 12 < width * 0.5:
            want.add((r.doc_id, (r.i - 1) // 20, r.i))
    got = {tuple(r) for r in catalogue.QUERIES["near_empty"](spark, SF).collect()}
    assert got == want and 0 < len(got)


def test_memo_by_whole_prompts(spark):
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    memo, users = {}, {k for k, r in turns.items() if r.role == "user"}
    for c, t in sorted(users):
        if (c, t + 1) in turns and turns[c, t + 1].role == "assistant":
            memo[f"a{c % 2}", turns[c, t].text] = (turns[c, t + 1].text, c * 1000 + t)
    got = {(r.agent, r.prompt): (r.response, r.seq) for r in catalogue.QUERIES["cache_last_wins"](spark, SF).collect()}
    assert got == memo
    calls = {(c, t): (f"a{c // 2 % 2}", turns[c, t].text) for c, t in users}
    hits = {(r.doc_id, r.chunk_no): (r.agent, r.prompt, r.response, r.hit) for r in catalogue.QUERIES["cache_lookup"](spark, SF).collect()}
    assert hits == {k: (*v, memo.get(v, (None,))[0], v in memo) for k, v in calls.items()}
    missed = {(r.doc_id, r.chunk_no): (r.agent, r.prompt) for r in catalogue.QUERIES["cache_misses"](spark, SF).collect()}
    assert missed == {k: v for k, v in calls.items() if v not in memo} and 0 < len(missed) < len(calls)


def test_incomplete_groups_of_pages_are_scanned(spark, tmp_path):
    ids = [*range(9), 9, 11, 12, 14, 18]
    spark.createDataFrame([(k, f"<h1>t{k}</h1>") for k in ids], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalogue.QUERIES["outline_scan"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.title) for r in got) == sorted((k // 9, f"t{k}") for k in ids)
    assert [r.grade for r in sorted(got, key=lambda r: r.seq) if r.doc_id == 1] == [1, 2, 2, 1]
