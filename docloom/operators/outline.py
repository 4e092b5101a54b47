"""Outlines (bookmarks): their entries, how well they are placed, and which blocks they name.

outline: doc_id, seq, title, page, x, y (NaN allowed), grade.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import fuzzy as Z
from docloom.functions import text as T
from docloom.operators.folds import collected, folded

MAX_DIST = 100.0


def preorder(entries: list[dict], root: int | None, n_pages: int | None) -> Iterator[tuple]:
    """(seq, title, page, x, y, grade, parent_seq) of a tree of entries (first child down, next sibling next), children
    before siblings. It stops at the first entry outside the document; entries on no page of it are left out (n_pages
    None: none is), but still are parents; the grade counts ancestors that are in."""
    by_id = {e["id"]: e for e in entries}
    stack: list[tuple[int, bool, int | None]] = []
    at, seq = root, 0
    seen: set = set()
    while True:
        if at is None:
            if not stack:
                return
            at = by_id[stack.pop()[0]]["next"]
            continue
        if at in seen:
            raise ValueError(f"entry {at} is met twice: the outline has a loop")
        seen.add(at)
        e = by_id[at]
        if not e["internal"]:
            return
        inside = n_pages is None or 0 <= e["page"] < n_pages
        number = None
        if inside:
            parent = next((s for _, ok, s in reversed(stack) if ok), None)
            yield seq, e["title"], e["page"], e["x"], e["y"], 1 + sum(ok for _, ok, _ in stack), parent
            number, seq = seq, seq + 1
        if e["down"] is not None:
            stack.append((at, inside, number))
            at = e["down"]
        else:
            at = e["next"]


def scan(nodes: DataFrame) -> DataFrame:
    """The outline of each document from its tree. nodes: doc_id, id, down, next, is_root, internal, title, page, x, y,
    n_pages."""
    fields = ["id", "down", "next", "is_root", "internal", "title", "page", "x", "y", "n_pages"]

    def fold(group: dict) -> Iterator[tuple]:
        entries = group["nodes"]
        root = next((e["id"] for e in entries if e["is_root"]), None)
        for row in preorder(entries, root, int(entries[0]["n_pages"])):
            yield group["doc_id"], *row

    groups = collected(nodes, ["doc_id"], ["id"], fields[1:], "nodes")
    return folded(groups, fold, "doc_id long, seq int, title string, page int, x double, y double, grade int, parent_seq int")


def inside(outline: DataFrame, n_pages) -> DataFrame:
    """The entries that point to a page of the document; pages count from 0."""
    return outline.filter((F.col("page") >= 0) & (F.col("page") < n_pages))


def by_page(outline: DataFrame) -> DataFrame:
    """doc_id, page_id, entries: the entries of each page, in order."""
    rows = outline.withColumn("page_id", F.col("page").cast("long"))
    return collected(rows, ["doc_id", "page_id"], ["seq"], ["title", "x", "y", "grade"], "entries")


def sliced(outline: DataFrame, start: int, end: int) -> DataFrame:
    """The entries of pages start to end (from 1, inclusive): pages from 1 anew, grades from the least grade so far,
    NaN places as 0. A running minimum, not that of all."""
    upto = W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    inside = outline.filter((F.col("page") + 1).between(start, end))
    zero = lambda c: F.when(F.isnan(c), F.lit(0.0)).otherwise(F.col(c)).alias(c)
    return inside.select("doc_id", "seq", "title", (F.col("page") + 2 - start).alias("page"), zero("x"), zero("y"), (F.col("grade") - F.min("grade").over(upto) + 1).alias("grade"))


def placement(outline: DataFrame) -> DataFrame:
    """doc_id, match_type (distance or edit_dist), dist_type (dist_y or dist_xy): whether places can be trusted.

    By edit distance if any y is NaN, if at some entry of a page there were three times as many entries as whole y
    values, if all y are 0, or if five pages or more have entries and all have one y. Both axes only if all x are
    numbers and several whole x occur."""
    y, x = F.floor("y").cast("long"), F.floor("x").cast("long")
    upto = W.partitionBy("doc_id", "page").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = outline.withColumn("__piled", F.count("*").over(upto) >= 3 * F.size(F.collect_set(y).over(upto)))
    got = rows.groupBy("doc_id").agg(
        F.bool_or(F.isnan("y")).alias("nan_y"), F.bool_or("__piled").alias("piled"), F.bool_and(F.col("y") == 0).alias("zero"),
        F.countDistinct("page").alias("pages"), F.countDistinct("y").alias("ys"), F.bool_or(F.isnan("x")).alias("nan_x"), F.countDistinct(x).alias("xs"),
    )
    by_edit = F.col("nan_y") | F.col("piled") | F.col("zero") | ((F.col("pages") >= 5) & (F.col("ys") == 1))
    return got.select("doc_id", F.when(by_edit, "edit_dist").otherwise("distance").alias("match_type"), F.when(F.col("nan_x") | (F.col("xs") == 1), "dist_y").otherwise("dist_xy").alias("dist_type"))


def _close(a: str, b: str, limit: int, strict: bool) -> bool:
    """Within limit edits; lengths rule out most pairs."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > limit:
        return False
    d = int(Z._table(a, b)[-1, -1])
    return d < limit if strict else d <= limit


def _limit(title: str) -> int:
    return min(Z.EDIT_MAX, int(len(title) * Z.EDIT_RATE))


def _by_place(blocks: list[dict], marks: list[dict], both_axes: bool) -> dict[int, tuple[int, str]]:
    """block_no: (grade, title). Each entry takes the nearest free block that its title suits; a discarded block that
    may start the title is read together with the block below it, which then gets the title."""
    used: set[int] = set()
    named: dict[int, tuple[int, str]] = {}

    def nearest(free: list[dict], dist) -> dict | None:
        near = [(dist(b), k) for k, b in enumerate(free) if dist(b) == dist(b)]
        return free[min(near)[1]] if near and min(near)[0] <= MAX_DIST else None

    for m in marks:
        title, bare = m["title"].strip(), m["title"].strip().lower()
        free = [b for b in blocks if b["block_no"] not in used]
        at = nearest(free, lambda b: ((b["x0"] - m["x"]) ** 2 + (b["y0"] - m["y"]) ** 2) ** 0.5 if both_axes else abs(m["y"] - b["y0"]))
        if at is None or at["type"] not in ("title", "text", "discarded"):
            continue
        text = at["content"].strip()
        if text and _close(bare, text.lower(), _limit(bare), False):
            used.add(at["block_no"])
            named[at["block_no"]] = (m["grade"], title)
        elif at["type"] == "discarded" and (bare.startswith(text.lower()) or any(text.lower().startswith(s) and bare.startswith(s) for s in Z.TITLE_STARTS)):
            low = nearest([b for b in free if b is not at and b["y0"] >= at["y1"]], lambda b: b["y0"] - at["y1"])
            if low is not None and _close(bare, (text + low["content"].strip()).lower(), _limit(bare), False):
                used |= {at["block_no"], low["block_no"]}
                named[low["block_no"]] = (m["grade"], title)
    return named


def _by_text(blocks: list[dict], marks: list[dict], ignore_starts: bool = True) -> dict[int, tuple[int, str]]:
    """block_no: (grade, title). Entries and text blocks both go downward: a block that matches takes all above it out."""
    left = sorted((b for b in blocks if b["type"] in ("title", "text")), key=lambda b: (b["y0"], b["block_no"]))
    named: dict[int, tuple[int, str]] = {}
    for m in marks:
        wanted = m["title"].strip().lower()
        limit = _limit(wanted)
        for k, b in enumerate(left):
            text = b["content"].strip().lower()
            if hit := _close(wanted, text, _limit(wanted), True):
                break
            for s in Z.TITLE_STARTS if ignore_starts else ():
                if wanted.startswith(s):  # without its usual start from here on
                    wanted = wanted[len(s) :]
                    if hit := wanted != text and _close(wanted, text, limit, True) or wanted == text and limit > 0:
                        break
            if hit:
                break
        else:
            continue
        named[b["block_no"]] = (m["grade"], m["title"].strip())
        left = left[k + 1 :]
    return named


def named_blocks(blocks: DataFrame, outline: DataFrame, kinds: DataFrame) -> DataFrame:
    """blocks with type, grade and title as the outline has them: named ones are titles, other titles become text. A
    document without an outline stays as it is. blocks: doc_id, page_id, block_no, type, bbox, content; kinds: what
    placement gives. Pages are folded one by one, as each entry's choice depends on those before."""
    schema = "doc_id long, page_id long, block_no long, type string, grade int, title string"
    cols = {"doc_id": "long", "page_id": "long"}
    b = blocks.select(*[F.col(c).cast(t).alias(c) for c, t in cols.items()], F.col("block_no").cast("long").alias("block_no"), "type", "content", "bbox.*")
    m = outline.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page_id"), "seq", "title", "x", "y", "grade")

    def fold(group: dict) -> Iterator[tuple]:
        rows, listed, how = group["blocks"], group["marks"] or [], group["match_type"]
        named: dict[int, tuple[int, str]] = {}
        if how is not None:
            named = _by_text(rows, listed) if how == "edit_dist" else _by_place(rows, listed, group["dist_type"] == "dist_xy")
        for r in rows:
            grade, title = named.get(r["block_no"], (None, None))
            kind = "title" if title is not None else "text" if r["type"] == "title" and how is not None else r["type"]
            yield group["doc_id"], group["page_id"], r["block_no"], kind, grade, title

    page = ["doc_id", "page_id"]
    groups = collected(b, page, ["block_no"], ["type", "content", "x0", "y0", "x1", "y1"], "blocks")
    marks = collected(m, page, ["seq"], ["title", "x", "y", "grade"], "marks")
    groups = groups.join(marks, page, "left").join(kinds.select(F.col("doc_id").cast("long").alias("doc_id"), "match_type", "dist_type"), "doc_id", "left")
    return folded(groups, fold, schema)


def title_text(grade, title):
    """A named block's text: its grade and title, to be decoded by decode_title in the finished Markdown."""
    return T.encode_title(title, grade)
