"""Heading levels that a model has corrected, put back into a document's own heading lines.

The folds are plain functions over a document's headings, run one group a document: each step depends on those before.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.fuzzy import same_heading
from docloom.operators.folds import collected, folded

#: Prompts of the first section, of the later ones and of an outline at once; a client is asked with them filled in.
RELEVEL = "These are headings of a document. Correct their levels, drop what is no heading, and answer with the headings alone:\n{content}"
RELEVEL_ON = "The first headings have their right levels and stay. Correct the levels of those after the line of dashes, drop what is no heading, and answer with these alone:\n{history}-----:\n{content}"
OUTLINE = "These are all headings of a document. Answer with its outline of two levels, chapters and their sections, headings alone:\n{content}"

_HEADING = re.compile(r"^(#{1,6}) (.+)$")
#: Originals that may be missed in a row, the grade from which missing ones are free, kept siblings.
ALLOW_MISS, FREE_FROM, SIBLINGS = 8, 4, 4


def filled(template: str, **values: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: values[m[1]], template)


def grade(line: str) -> int:
    m = _HEADING.match(line)
    return len(m[1]) if m else -1


def bare(line: str) -> str:
    m = _HEADING.match(line)
    return m[2] + line[m.end() :] if m else line


def well_formed(headers: list[str]) -> list[str]:
    """Headings only, each ending in two blanks and a line feed."""
    return [h if h.endswith("  \n") else h.strip() + "  \n" for h in headers if re.match(r"^#{1,6} .+$", h)]


def without_jumps(headers: list[str]) -> tuple[list[str], int]:
    """From the end, drops each heading whose kept successor is over one grade deeper; and how many were dropped."""
    kept: list[str] = []
    for h in reversed(headers):
        if not kept or grade(kept[-1]) - grade(h) <= 1:
            kept.append(h)
    return kept[::-1], len(headers) - len(kept)


def remembered(corrected: list[str], history: list[str], siblings: int = SIBLINGS) -> list[str]:
    """The headings a model is shown again: the last one, up to siblings before it on its level, their ancestors with as
    many siblings each. Deeper ones are left out; it ends when the first level is full."""
    out: list[str] = []
    level, room = 0, siblings
    for h in reversed(history + corrected):
        g = grade(h)
        if g == -1 or (out and g > level):
            continue
        if out and g == level:
            if not room:
                if level == 1:
                    break
                continue
            room -= 1
        else:
            level, room = g, siblings
        out.append(h)
    return out[::-1]


def without_repeats(history: list[str], corrected: list[str], section: str) -> list[str] | None:
    """A model's answer without the history it may repeat in front; None if it repeats it wrongly."""
    if not history or not corrected:
        return corrected
    first = section.strip().split("\n")[0]
    if not same_heading(bare(history[0]), bare(corrected[0])) and same_heading(bare(corrected[0]), bare(first)):
        return corrected
    if len(corrected) < len(history):
        return None
    if all(grade(h) == grade(c) and same_heading(h, c) for h, c in zip(history, corrected)):
        return corrected[len(history) :]
    return None


def merge(corrected: list[str], originals: list[str], extra: int = 0, allowed: int = ALLOW_MISS, free_from: int = FREE_FROM, whole: bool = True):
    """The originals with the corrected levels: both go forward together, an original that the next corrected one isn't
    loses its level. Few may do so in a row (not counted after a deep heading); else, or if a corrected one is left
    over, None. Originals left over stay; whole=False gives those that were reached, and their number."""
    out, k, missed, last = list(originals), 0, 0, -1
    for c in corrected:
        if grade(c) == -1:
            continue
        while k < len(originals) and not same_heading(originals[k][2:], bare(c)):
            if last < free_from:
                if missed >= allowed + extra:
                    return None
                missed += 1
            out[k] = bare(originals[k])
            k += 1
        if k == len(originals):
            return None
        out[k] = c.rstrip() + "  \n"
        k, missed, last = k + 1, 0, grade(c)
    return out if whole else (out[:k], k)


def merge_easy(corrected: list[str], originals: list[str]) -> list[str]:
    """The same with any number missed: a corrected heading that no later original is, is dropped; originals that none
    matches lose their level."""
    out, k = [bare(o) for o in originals], 0
    for c in corrected:
        if grade(c) == -1:
            continue
        hit = next((j for j in range(k, len(originals)) if same_heading(originals[j][2:], bare(c))), None)
        if hit is not None:
            out[hit] = c.rstrip() + "  \n"
            k = hit + 1
    return out


Ask = Callable[[str], "str | None"]


def sections(lines: list[str], size: int, length: Callable[[str], int] = len) -> list[list[str]]:
    """Headings in runs of at most size by length, one at least."""
    out: list[list[str]] = []
    held = 0
    for line in lines:
        if not out or held + length(line) > size:
            out.append([])
            held = 0
        out[-1].append(line)
        held += length(line)
    return out


def section_levels(lines: list[str], ask: Ask, size: int, length: Callable[[str], int] = len, easy: bool = False) -> list[str] | None:
    """A document's headings with the levels that a model gives section by section; None if any answer is of no use.

    From the second section on the model is shown the headings it should remember; what it repeats of them is taken off.
    Each answer is merged with the headings after those the answers before have reached. easy: one answer for all, with
    any number missed."""
    lines = [x if x.endswith("\n") else x + "\n" for x in lines]
    if easy:
        said = ask(filled(OUTLINE, content="".join(lines)))
        return merge_easy(well_formed(said.split("\n")), lines) if said else None
    out: list[str] = []
    history: list[str] = []
    reached = 0
    for part in sections(lines, size, length):
        text = "".join(part).lstrip()
        said = ask(filled(RELEVEL_ON, history="".join(history), content=text) if out else filled(RELEVEL, content=text))
        answer, dropped = without_jumps(well_formed(said.split("\n"))) if said else ([], 0)
        if out:
            answer = without_repeats(history, answer, text) or []
        if not answer:
            return None
        history = remembered(answer, history)
        got = merge(answer, lines[reached:], dropped, whole=False)
        if got is None:
            return None
        new, used = got
        out, reached = out + new, reached + used
    return out + lines[reached:]


def levels_by_model(headings: DataFrame, factory: Callable[[], object], size: int = 2048, easy: bool = False) -> DataFrame:
    """doc_id, line_no, line, ok: each document's headings with the levels that the client gives them section by section;
    as they were, with ok false, where it fails. headings: doc_id, line_no, line. One client a task."""
    made: list = []

    def fold(group: dict) -> Iterator[tuple]:
        if not made:
            made.append(factory())

        def ask(prompt: str) -> str | None:
            try:
                return made[0].ask(prompt)
            except Exception:
                return None

        own = group["own"]
        new = section_levels([r["line"] for r in own], ask, size, easy=easy)
        for k, r in enumerate(own):
            yield group["doc_id"], r["line_no"], r["line"] if new is None else new[k], new is not None

    return folded(collected(_rows(headings), ["doc_id"], ["line_no"], ["line"], "own"), fold, _MERGED)


_MERGED = "doc_id long, line_no long, line string, ok boolean"


def _rows(headings: DataFrame) -> DataFrame:
    return headings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "line")


def corrected_headings(headings: DataFrame, answers: DataFrame, easy: bool = False) -> DataFrame:
    """doc_id, line_no, line, ok: the document's headings with a model's levels; ok is false, and lines are as they
    were, where the strict merge fails. headings, answers: doc_id, line_no, line."""
    def fold(group: dict) -> Iterator[tuple]:
        answer, dropped = without_jumps(well_formed([r["line"] for r in group["said"] or ()]))
        lines = [r["line"] for r in group["own"]]
        new = merge_easy(answer, lines) if easy else merge(answer, lines, dropped)
        for r, line in zip(group["own"], lines if new is None else new):
            yield group["doc_id"], r["line_no"], line, new is not None

    own, said = (collected(_rows(d), ["doc_id"], ["line_no"], ["line"], name) for d, name in ((headings, "own"), (answers, "said")))
    return folded(own.join(said, "doc_id", "left"), fold, _MERGED)


def by_document(headings: DataFrame, function: Callable[[list[str]], list[str]]) -> DataFrame:
    """doc_id, place (from 0), line: function(list of lines) of each document's headings."""
    def fold(group: dict) -> Iterator[tuple]:
        for place, line in enumerate(function([r["line"] for r in group["own"]])):
            yield group["doc_id"], place, line

    return folded(collected(_rows(headings), ["doc_id"], ["line_no"], ["line"], "own"), fold, "doc_id long, place long, line string")
