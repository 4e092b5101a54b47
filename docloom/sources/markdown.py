"""Markdown as tables of lines, read from files or from text columns; and back to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's stem), text: one row a file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(stem(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))


def lines(documents: DataFrame, keep_ends: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 1), line. keep_ends leaves each line's end on it (line feed, carriage return or both);
    without it lines are what line feeds part, the last one may be empty."""
    text = F.col(text_col)
    if keep_ends:
        parts = F.filter(F.split(text, r"(?<=\r\n|\n|\r(?!\n))", -1), lambda x: x != "")
    else:
        parts = F.split(text, "\n", -1)
    return documents.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def rebuilt(rows: DataFrame, separator: str = "\n", order: str = "line_no", value: str = "line") -> DataFrame:
    """doc_id, text: the rows of each document in order, joined."""
    got = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("rows"))
    return got.select("doc_id", F.array_join(F.transform("rows", lambda r: r["v"]), separator).alias("text"))


def headings(rows: DataFrame) -> DataFrame:
    """The heading lines with their grade. A heading of blanks alone becomes an empty line and is no heading."""
    from docloom.functions import text as T

    body = F.regexp_extract("line", T.HEADING, 1)
    return rows.filter(T.is_heading(F.col("line")) & (T.strip(body) != "")).withColumn("grade", T.heading_grade(F.col("line")))


def heading_or_empty(line: Column) -> Column:
    """The line; empty if it is a heading of blanks alone."""
    from docloom.functions import text as T

    return F.when(T.is_heading(line) & (T.strip(F.regexp_extract(line, T.HEADING, 1)) == ""), F.lit("")).otherwise(line)


def write_markdown(documents: DataFrame, path: str, suffix: str = "") -> None:
    """One folder a document under path, named doc_id=<id><suffix>, holding its text; documents: doc_id, text."""
    named = documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(suffix)).alias("doc_id"), F.col("text").alias("value"))
    named.write.mode("overwrite").partitionBy("doc_id").option("lineSep", "").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Blocks or whole pages, nested as they are."""
    rows.write.mode("overwrite").json(path)
