"""Model calls under limits, heading levels section by section, folds against plain loops."""

import time

import pytest

from docloom.operators import calls as C
from docloom.operators import headers as H
from docloom.operators.code import wrap
from docloom.plans import catalogue
from docloom.streaming import rate as R

SF = "/root/testdata/sf0.001"


class Sleeper:
    def ask(self, prompt):
        if prompt == "hang":
            time.sleep(30)
        if prompt == "none":
            return None
        if prompt == "fail":
            raise ValueError
        return prompt.upper()


def test_hanging_calls_cost_their_time_alone(spark):
    began = time.time()
    prompts = ["a", "hang", "b", "fail", "hang", "c", "none"]
    rows = C.asked(spark.createDataFrame(list(enumerate(prompts)), "k int, prompt string").coalesce(1), Sleeper, 2, 0.5).collect()
    assert time.time() - began < 20
    assert [(r.response, r.status) for r in sorted(rows)] == [("A", "ok"), (None, "timeout"), ("B", "ok"), (None, "failed"), (None, "timeout"), ("C", "ok"), (None, "failed")]


def test_calls_by_agent(spark):
    rows = C.asked_by_agent(spark.createDataFrame([("u", "x"), ("s", "y"), ("?", "z"), (None, "n")], "agent string, prompt string"), C.Agents({"u": C.Upper, "s": Sleeper})).collect()
    assert {r.agent: (r.response, r.status) for r in rows} == {"u": ("X", "ok"), "s": ("Y", "ok"), "?": (None, "failed"), None: (None, "failed")}


class Clock:
    def __init__(self):
        self.now, self.slept = 1000.0, []

    def time(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


class Flaky:
    def __init__(self):
        self.asked = []

    def ask(self, prompt):
        self.asked.append(prompt)
        if self.asked.count(prompt) == 1 and prompt.startswith("no"):
            raise R.Refused
        return prompt


def test_limited_client():
    clock, inner = Clock(), Flaky()
    limited = lambda **kw: R.Limited(inner, lambda p: 30, rpm=2, tpm=70, gap=60, wait=20, retries=4, clock=clock.time, sleep=clock.sleep, memo={"known": "from the memo"}, **kw)
    client = limited()
    assert [client.ask(p) for p in ("known", "a", "b", "known")] == ["from the memo", "a", "b", "from the memo"] and not clock.slept
    assert client.ask("c") == "c" and clock.slept == [20] * 4  # admitted once the first two are 61 seconds old
    with pytest.raises(R.Refused):
        limited().ask("no 1")
    clock.slept.clear()
    assert limited(penalty=True).ask("no 2") == "no 2" and clock.slept == [20] * 4
    assert R.Limited(inner, lambda p: 1, rpm=1, tpm=9, wait=1, retries=0, clock=clock.time, sleep=clock.sleep).ask("x") == "x"
    assert R.Limited(inner, rpm=0, tpm=0).ask("y") == "y"


def test_retried_equals_simulation(spark):
    got = {(r.agent, r.request_id): (r.admitted, r.attempts, r["at"]) for r in catalogue.QUERIES["rate_retried"](spark, SF).collect()}
    requests = [tuple(r) for r in __import__("docloom.plans.derived", fromlist=["x"]).requests(spark, SF).collect()]
    for agent in {r[0] for r in requests}:
        window, waiting = R.Window(10, 40_000, 60), sorted((us, i, 1, n) for a, i, us, n in requests if a == agent)
        while waiting:
            at, i, attempt, n = waiting.pop(0)
            ok = window.admit(at, n)
            if ok or attempt == 6:
                assert got.pop((agent, i)) == (ok, attempt, at)
            else:
                waiting = sorted([*waiting, (at + 3600 * 1_000_000, i, attempt + 1, n)])
    assert not got


class Script:
    def __init__(self, *answers):
        self.answers, self.prompts = list(answers), []

    def __call__(self, prompt):
        self.prompts.append(prompt)
        return self.answers.pop(0)


def test_levels_section_by_section():
    lines = ["# Intro\n", "# Aims\n", "# Noise of a page\n", "# Method\n", "# Data\n"]
    ask = Script("# Intro\n## Aims", "# Method\n## Data")
    assert H.sections(lines, 40) == [lines[:3], lines[3:]]
    assert H.section_levels(lines, ask, 40) == ["# Intro  \n", "## Aims  \n", "Noise of a page\n", "# Method  \n", "## Data  \n"]
    assert "# Intro  \n## Aims  \n-----" in ask.prompts[1] and "-----" not in ask.prompts[0]
    repeated = Script("# Intro\n## Aims", "# Intro\n## Aims\n# Method\n## Data")
    assert H.section_levels(lines, repeated, 40) == H.section_levels(lines, Script("# Intro\n## Aims", "# Method\n## Data"), 40)
    assert H.section_levels(lines, Script("# Intro\n## Aims", None), 40) is None
    assert H.section_levels(lines, Script("# Intro\n## Aims", "# Something quite different"), 40) is None
    assert H.section_levels(lines, Script("# Intro\n## Method"), 9, easy=True) == ["# Intro  \n", "Aims\n", "Noise of a page\n", "## Method  \n", "Data\n"]
    assert H.section_levels([], Script(), 40) == []


def test_sections_query(spark):
    rows = catalogue.QUERIES["header_sections_corrected"](spark, SF).collect()
    own = catalogue._headings(spark, SF).collect()
    assert {(r.doc_id, r.line_no) for r in rows} == {(r.doc_id, r.line_no) for r in own}
    by_doc: dict = {}
    for r in sorted(own, key=lambda r: r.line_no):
        by_doc.setdefault(r.doc_id, []).append(r.line)
    got: dict = {}
    for r in sorted(rows, key=lambda r: r.line_no):
        got.setdefault(r.doc_id, []).append((r.line, r.ok))
    for doc, lines in by_doc.items():
        want = H.section_levels(lines, catalogue.Deeper().ask, 400)
        assert got[doc] == [(x, want is not None) for x in (want or lines)]
    assert sum(ok for x in got.values() for _, ok in x) > 0


def cuts(line, width, before, after, force, indent):
    """Piece by piece, by trying every cut."""
    out, rest, room, lead = [], line, width, ""
    while len(line) >= width and len(rest) > room:
        options = [k for k in range(1, room + 1) if (k < room and rest[k] in before) or (rest[k - 1] in after and rest[k - 1] not in before)]
        if not options and not force:
            break
        cut = max(options) if options else room
        out.append(lead + rest[:cut] + "  \n")
        deeper = len(line) - len(line.lstrip(" ")) + indent
        rest, lead, room = rest[cut:], " " * deeper, max(1, width - deeper)
    return [*out, lead + rest]


def test_wrap_by_trying_all_cuts(spark):
    import random

    rng = random.Random(6)
    for _ in range(3000):
        line = " " * rng.choice([0, 0, 3, 9]) + "".join(rng.choice("abcdef.-+ ,()") for _ in range(rng.randint(0, 70)))
        width, force, indent = rng.choice([8, 12, 20]), rng.random() < 0.7, rng.choice([0, 4])
        assert wrap(line, width, force=force, indent=indent) == cuts(line, width, (".", "-", "+", "/", "*"), (" ", ",", "(", ")", ";", ":"), force, indent), line
    from docloom.plans import derived as I

    whole = {}
    for r in sorted(catalogue.QUERIES["code_wrap"](spark, SF).collect(), key=lambda r: (r.line_no, r.piece_no)):
        whole.setdefault((r.doc_id, r.line_no), []).append(r.line)
    lines = {(r.doc_id, r.i): r.line for r in I.md_lines(spark, SF).collect()}
    assert set(whole) == set(lines)
    assert all("".join("".join(p).split()).replace("`", "") == "".join(lines[k].split()).replace("`", "") for k, p in whole.items())
    assert any(len(p) > 1 for p in whole.values())


def test_chunks_rebuild_their_texts(spark):
    from docloom.plans import derived as I

    texts = {r.doc_id: r.text for r in I.md_text(spark, SF).collect()}
    chunks: dict = {}
    for r in sorted(catalogue.QUERIES["chunk_pack"](spark, SF).collect(), key=lambda r: r.chunk_no):
        chunks.setdefault(r.doc_id, []).append(r.text)
    assert {k: "".join(v) for k, v in chunks.items()} == {k: v for k, v in texts.items() if v}


def by_document(rows, order, value):
    out: dict = {}
    for r in sorted(rows, key=lambda r: r[order]):
        out.setdefault(r.doc_id, []).append(r[value])
    return out


def merged(answer, originals, extra, easy):
    """By the places that the answer's headings have among the originals."""
    places, at = [], 0
    for a in answer:
        hit = next((j for j in range(at, len(originals)) if H.same_heading(originals[j][2:], H.bare(a))), None)
        if hit is None:
            if easy:
                continue
            return None
        places.append((hit, a))
        at = hit + 1
    if not easy:
        before = -1
        last = -1
        for hit, a in places:
            if hit - before - 1 > 8 + extra and last < 4:
                return None
            before, last = hit, H.grade(a)
    out = [H.bare(o) if easy or places and j < places[-1][0] else o for j, o in enumerate(originals)]
    for hit, a in places:
        out[hit] = a.rstrip() + "  \n"
    return out


def test_merges_by_places(spark):
    own = by_document(catalogue._headings(spark, SF).collect(), "line_no", "line")
    said = by_document(catalogue._answers(spark, SF).collect(), "line_no", "line")
    for name, easy in (("header_merge", False), ("header_merge_easy", True)):
        rows = catalogue.QUERIES[name](spark, SF).collect()
        got, ok = by_document(rows, "line_no", "line"), by_document(rows, "line_no", "ok")
        good = 0
        for doc, lines in own.items():
            answer, dropped = H.without_jumps(H.well_formed(said.get(doc, [])))
            want = merged(answer, lines, dropped, easy)
            assert got[doc] == (lines if want is None else want) and set(ok[doc]) == {want is not None}, (name, doc)
            good += want is not None
        assert good


def test_pages_as_a_list(spark):
    import json

    from docloom.plans import derived as I

    blocks = [r for r in I.blocks(spark, SF).collect()]
    pages: dict = {}
    for b in sorted(blocks, key=lambda b: b.block_no):
        page = pages.setdefault(b.doc_id, {}).setdefault(b.page_id, {"para_blocks": [], "discarded_blocks": []})
        if b.page_id != 1:
            box = [b.bbox.x0, b.bbox.y0, b.bbox.x1, b.bbox.y1]
            page["discarded_blocks" if b.type == "discarded" else "para_blocks"].append({"block_no": b.block_no, "type": b.type, "bbox": box, "content": b.content})
    for r in catalogue.QUERIES["page_list"](spark, SF).collect():
        want = [{"page_idx": k, "page_size": [600.0, 800.0], **p, "need_drop": k == 1, "drop_reason": ["skip page"]} for k, p in sorted(pages.pop(r.doc_id).items())]
        assert json.loads(r.json)["pdf_info"] == want
    assert not pages


def test_translation_chunk_by_chunk(spark):
    from docloom.operators import chunks as K

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in catalogue.QUERIES["translate_mock"](spark, SF).collect()}

    def edges(chunk):
        said = C.Upper().ask(C.TRANSLATE.replace("{content}", chunk))
        head, tail = len(chunk) - len(chunk.lstrip(" \r\n\t")), len(chunk) - len(chunk.rstrip(" \r\n\t"))
        return chunk[:head] + said.strip() + (chunk[len(chunk) - tail :] if tail and head < len(chunk) else "")

    want = {k: "\n".join(edges(c) for c in K.split_markdown(t, 2048, 200)) for k, t in texts.items() if t}
    assert got == want
