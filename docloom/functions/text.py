"""Text expressions: white space, typographic repairs, headings, comment marks, title marks, inline code, labels.

Every function takes and returns a Column; null gives null unless said otherwise. `.` and `\\w` have their Unicode
meaning where that matters, through inline flags of the regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures and what they stand for.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
#: Answers that mean yes.
YES_LABELS = ("1", "1.包含代码", "1包含代码")
HEADING = r"(?d)^#{1,6} (.+)$"
TITLE_MARK = r"(?s)^# \|@([0-9]+)@\|(.+)$"
INLINE_LIMIT = 60


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends, and U+001C to U+001F."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+", "")


def collapse_space(c: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")


def expand_ligatures(c: Column) -> Column:
    for mark, letters in LIGATURES.items():
        c = F.replace(c, F.lit(mark), F.lit(letters))
    return c


def replacement_to_space(c: Column) -> Column:
    return F.translate(c, "�", " ")


def quotes_for_controls(c: Column) -> Column:
    """U+0002 and U+0003 as apostrophes."""
    return F.translate(c, "\u0002\u0003", "''")


def is_heading(c: Column) -> Column:
    """A line, without its end, of one to six marks, a space and something."""
    return c.rlike(HEADING)


def heading_grade(c: Column) -> Column:
    """1 to 6, or -1."""
    return F.when(c.rlike(HEADING), F.length(F.regexp_extract(c, "^(#{1,6}) ", 1))).otherwise(F.when(c.isNotNull(), F.lit(-1)))


def strip_heading(c: Column) -> Column:
    return F.regexp_replace(c, r"(?d)^#{1,6} (?=.+$)", "")


def strict_heading(c: Column) -> Column:
    """The strict form: marks, one space, a word, white space; null where the line isn't one."""
    found = F.regexp_extract(c, r"(?U)^#{1,6} \w+\s*", 0)
    return F.when(found != "", found)


def normalised_heading(c: Column) -> Column:
    """Stripped, with two spaces and a line feed; null where the line is no heading."""
    return F.when(c.rlike(r"(?d)^#{1,6} .+\n?$"), F.when(c.endswith("  \n"), c).otherwise(F.concat(strip(c), F.lit("  \n"))))


def comment_mark(c: Column) -> Column:
    """A leading run of # as //. The run is measured without leading white space and cut with it, as readers of the
    produced files expect; a run with nothing after it leaves its last mark; a lone mark stays."""
    bare = lstrip(c)
    run = F.length(F.regexp_extract(bare, "^#*", 0))
    cut = F.when(run < F.length(bare), run).otherwise(run - 1)
    return F.when(cut > 0, F.concat(F.lit("//"), F.substr(c, cut + 1))).otherwise(c)


def encode_title(title: Column, grade: Column) -> Column:
    return F.concat(F.lit("|@"), grade.cast("string"), F.lit("@|"), collapse_space(title))


def decode_title(line: Column) -> Column:
    """A level-one heading that carries a grade, at that grade; other lines as they are."""
    grade = F.regexp_extract(line, TITLE_MARK, 1)
    rest = F.regexp_extract(line, TITLE_MARK, 2)
    return F.when(line.rlike(TITLE_MARK), F.concat(F.repeat(F.lit("#"), grade.cast("int")), F.lit(" "), rest)).otherwise(line)


def keep_edges(source: Column, value: Column) -> Column:
    """value, stripped, between the blanks, tabs and line ends at both ends of source. Blank source: all at the front."""
    head = F.regexp_extract(source, r"^[ \r\n\t]*", 0)
    tail = F.when(F.length(head) < F.length(source), F.regexp_extract(source, r"[ \r\n\t]*$", 0)).otherwise(F.lit(""))
    return F.concat(head, strip(value), tail)


def longest_inline(line: Column) -> Column:
    """Length of the longest run between consecutive backticks."""
    pieces = F.split(line, "`", -1)
    inner = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
    return F.coalesce(F.array_max(F.transform(inner, F.length)), F.lit(0))


def clean_inline(line: Column, limit: int = INLINE_LIMIT) -> Column:
    return F.when(longest_inline(line) > limit, F.replace(line, F.lit("`"), F.lit(""))).otherwise(line)


def is_yes(answer: Column) -> Column:
    """A classifier's answer: what follows its reasoning, without blanks (line ends count)."""
    said = F.element_at(F.split(answer, "</think>", -1), -1)
    return F.coalesce(F.replace(said, F.lit(" "), F.lit("")).isin(*YES_LABELS), F.lit(False))


def indent_width(line: Column) -> Column:
    return F.length(F.regexp_extract(line, "^ *", 0))


def filled(template: str, **values: Column) -> Column:
    """A template with {name} places."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def approx_tokens(c: Column) -> Column:
    """A token length that needs no vocabulary: words and single other marks."""
    return F.regexp_count(c, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"))
