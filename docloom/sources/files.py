"""Binary documents, page ranges, the older memo files and settings."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The lines around a key and a value of a memo file.
MARKS = {"key_start": "|*||*||*|key_start|*||*||*|", "key_end": "|*||*||*|key_end|*||*||*|", "value_start": "|*||*||*|value_start|*||*||*|", "value_end": "|*||*||*|value_end|*||*||*|"}


def content_md5(content: Column) -> Column:
    """The name of a document: the MD5 of its bytes."""
    return F.md5(content)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, md5: one row a file, by any Hadoop file system."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content", content_md5(F.col("content")).alias("md5"))


def pages_of(files: DataFrame, parse) -> DataFrame:
    """doc_id, page_id, page_w, page_h: what parse(content) yields as (width, height) for each page of a file."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(m, k, float(w), float(h)) for m, c in zip(frame["md5"], frame["content"]) for k, (w, h) in enumerate(parse(c))]
            yield pd.DataFrame(rows, columns=["doc_id", "page_id", "page_w", "page_h"])

    return files.select("md5", "content").mapInPandas(run, "doc_id string, page_id int, page_w double, page_h double")


def in_range(page: Column, count: Column, start: int = 1, end: int | None = None) -> Column:
    """Pages counted from 0; start and end from 1, inclusive. No end, or one below 1, is the last page."""
    last = count - 1 if end is None or end < 1 else F.least(F.lit(end - 1), count - 1)
    return page.between(F.lit(start - 1), last)


def with_stubs(pages: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """All pages; those outside the range stay as stubs: need_drop, drop_reason. pages: doc_id, page_id, n_pages, ..."""
    inside = in_range(F.col("page_id"), F.col("n_pages"), start, end)
    reason = F.when(inside, F.array().cast("array<string>")).otherwise(F.array(F.lit("skip page")))
    return pages.withColumn("need_drop", ~inside).withColumn("drop_reason", reason)


def parse_memo(text: str, marks: dict[str, str] = MARKS) -> list[tuple[str, str]]:
    """(key, value) of a memo file, in order. A blank line where a key should start ends it; a mark that is missing is
    an error."""
    rows, lines, at = [], text.split("\n"), 0

    def upto(mark: str) -> str:
        nonlocal at
        first = at
        while at < len(lines) and lines[at].strip() != mark:
            at += 1
        if at == len(lines):
            raise ValueError(f"no {mark!r} after line {first}")
        at += 1
        return "\n".join(lines[first : at - 1])

    while at < len(lines) and lines[at].strip():
        if lines[at].strip() != marks["key_start"]:
            raise ValueError(f"line {at + 1}: {marks['key_start']!r} is missing")
        at += 1
        key = upto(marks["key_end"])
        if upto(marks["value_start"]).strip():
            raise ValueError(f"line {at}: text between key and value")
        rows.append((key, upto(marks["value_end"])))
    return rows


def import_memo(spark: SparkSession, path: str, agent: str) -> DataFrame:
    """agent, prompt, response, seq of old memo files, for memo.append."""
    files = spark.read.text(path, wholetext=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(agent, k, v, n) for t in frame["value"] for n, (k, v) in enumerate(parse_memo(t))]
            yield pd.DataFrame(rows, columns=["agent", "prompt", "response", "seq"])

    return files.mapInPandas(run, "agent string, prompt string, response string, seq long")


class Settings:
    """A nested map of settings with names for dotted paths."""

    def __init__(self, tree: dict[str, Any], names: dict[str, str] | None = None):
        self.tree, self.names = tree, names or {}

    @classmethod
    def load(cls, path: str, names_path: str | None = None) -> Settings:
        import yaml

        with open(path, encoding="utf-8") as f:
            tree = yaml.safe_load(f) or {}
        if names_path is None:
            return cls(tree)
        with open(names_path, encoding="utf-8") as f:
            return cls(tree, yaml.safe_load(f) or {})

    def get(self, path: str, default: Any = None) -> Any:
        at: Any = self.tree
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def put(self, path: str, value: Any) -> None:
        *parents, last = path.split(".")
        at = self.tree
        for part in parents:
            at = at.setdefault(part, {})
        at[last] = value

    def override(self, **values: Any) -> list[str]:
        """Sets what has a name; returns the names that have none."""
        for name, value in values.items():
            if name in self.names and value is not None:
                self.put(self.names[name], value)
        return [n for n in values if n not in self.names]
