"""From raw documents to token ids: five stages, each of them one operator over all that the stage before kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import released, table, written
from docloom.llm.decontamination import contained_items
from docloom.llm.jaccard_join import jaccard_components
from docloom.llm.line_dedup import without_repeated_lines
from docloom.llm.pieces import encode_decode
from docloom.llm.quality_classifier import quality_classifier


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows of these ids (column doc_id); rows without an id stay."""
    gone = ids.select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws.

    Null and empty texts have the least weight and go if any label is bad; rows without an id stay; rows that share an id
    go together if one of them does. An empty table stays empty; all columns are kept as they are."""
    drawn = quality_classifier(docs, table(spark, sf_dir, "labels"))
    return _without(docs, drawn.filter(~F.col("kept")))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in an earlier document go; n_chars, where there is one, follows the text.

    Documents stay, even with no line left; null texts become empty. Rows without an id keep their lines; rows that share
    an id drop nothing for each other. An empty table stays empty; other columns are kept as they are."""
    kept = without_repeated_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingle similarities of 0.8 or more connect, the one of the smallest id.

    Texts without a word and rows without an id are near nothing and stay; repeated rows of the smallest id all stay. An
    empty table stays empty; all columns are kept as they are."""
    groups = jaccard_components(docs, width=5, share=(4, 5))
    return _without(docs, groups.filter(F.col("component_id") != F.col("doc_id")))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item to 0.8 or more.

    Null and empty texts contain nothing; rows without an id stay; rows that share an id go together if one of them has
    an item. An empty table stays empty; all columns are kept as they are."""
    found = contained_items(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id").distinct())


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, one row a row: null and empty texts are the end id alone."""
    return encode_decode(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", unrepeated_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("SentencePiece encoding and decoding", token_ids),
]

#: SQL can't express the drawing of the first stage, nor the encoding; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage{k}")
        released(before)
    return STAGES[-1][1](spark, docs, sf_dir)
