"""Benchmark decontamination by size-partitioned MinHash containment search.

The items are dealt to partitions by the number s of their distinct shingles, powers of two apart, and by the words of a
shingle. An item's sketch is its b MinHash values, the b smallest hashes of its shingles, with b = s - ceil(THRESHOLD * s)
+ 1: a text that contains the share THRESHOLD of the item lacks at most b - 1 of its shingles, so it has one of the
sketch, wherever it stands in however long a text. Each partition has a bound of its own, its largest sketch value: a
text's shingles up to it, and no others, are looked up in the partition's sketches. Texts and items that share a sketch
value are candidates, which are verified by counting the item's shingles that the text contains, as strings.

DataFrame expressions only. Sketches, items and the ids of the texts to be read again are broadcast while they are under
MAX_BROADCAST bytes by their counts; beyond that they are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import WS, ascii_lower, table, written

WORDS = 5
#: Five shared shingles to four of an item's: containment of 0.8.
SHARE = (4, 5)
MAX_BROADCAST = 64 << 20
#: Bytes of a sketch value with its item, of a shingle of an item, and of an id, about.
SKETCH_BYTES, SHINGLE_BYTES, ID_BYTES = 40, 80, 16


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"[{WS}]+"), lambda w: w != "")


def _shingles(column: str, width: int) -> Column:
    """The strings of width words of an array column; none if there are fewer words."""
    n = F.size(column)
    return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.array_join(F.slice(F.col(column), i, width), " "))).otherwise(F.array().cast("array<string>"))


def _hash(words_: Column) -> Column:
    """Of an array of words: the hash of their hashes, so that a text's words are hashed once for all shingles."""
    return F.xxhash64(F.transform(words_, lambda w: F.xxhash64(w)))


def _shingle_hashes(column: str, width: int) -> Column:
    """_hash of each width words of a text; column: the hashes of its words."""
    n = F.size(column)
    return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(F.col(column), i, width)))).otherwise(F.array().cast("array<bigint>"))


def item_sketches(items: DataFrame) -> DataFrame:
    """item_id, width (words of a shingle), shingles (distinct strings), n_item, partition, sketch (hashes).

    Items of fewer than WORDS words are one shingle of their own width; those without words are left out."""
    out = items.withColumn("words", words(F.col("text"))).filter(F.size("words") > 0)
    out = out.withColumn("width", F.least(F.size("words"), F.lit(WORDS)))
    made = F.array().cast("array<string>")
    for w in range(1, WORDS + 1):
        made = F.when(F.col("width") == w, _shingles("words", w)).otherwise(made)
    out = out.select("item_id", "width", F.array_distinct(made).alias("shingles")).withColumn("n_item", F.size("shingles"))
    out = out.withColumn("partition", F.floor(F.log2("n_item")).cast("int"))
    need = F.floor((F.col("n_item") * SHARE[0] + SHARE[1] - 1) / SHARE[1]).cast("int")
    return out.withColumn("sketch", F.slice(F.sort_array(F.transform("shingles", lambda s: _hash(F.split(s, " ")))), 1, F.col("n_item") - need + 1))


def contained_items(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_item, n_common, containment: each pair of a text and an item of which it contains enough.

    Words are what ASCII white space parts, A-Z lower-cased. Null and empty texts and items contain nothing and are in
    nothing; a text or item without an id can't be named and is left out. Equal items are found each under its own id;
    rows of an equal doc_id are one text with several versions, of which the best counts; extra columns aren't carried;
    empty tables give an empty result.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    known = written(item_sketches(items.select("item_id", "text").filter("item_id is not null")), "sketches")
    # at most WORDS widths and a few dozen partitions
    bounds = known.groupBy("partition", "width").agg(F.max(F.array_max("sketch")).alias("bound"), F.sum(F.size("sketch")).alias("n"), F.sum("n_item").alias("shingles")).collect()
    if not bounds:
        return docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("item_id"), *[F.lit(0).cast("long").alias(c) for c in ("n_item", "n_common")], F.lit(0.0).alias("containment"))
    widths = sorted({r.width for r in bounds})
    by_words = docs.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))

    def looked_up(w: int) -> Column:
        """partition and hash of a text's shingles of w words that are within the partition's bound."""
        def within(hashes: Column) -> Column:
            parts = [F.transform(F.filter(hashes, lambda h: h <= F.lit(bound)), lambda h: F.struct(F.lit(part).alias("partition"), h.alias("hash"))) for part, bound in own]  # noqa: B023
            return F.flatten(F.array(*parts))

        own = sorted((r.partition, r.bound) for r in bounds if r.width == w)
        return F.transform(F.array(_shingle_hashes("words", w)), within)[0]

    met = by_words.select("doc_id", F.inline(F.flatten(F.array(*[looked_up(w) for w in widths]))))
    sketches = known.select("item_id", "partition", F.explode("sketch").alias("hash"))
    sketches = F.broadcast(sketches) if sum(r.n for r in bounds) * SKETCH_BYTES <= MAX_BROADCAST else sketches
    candidates = written(met.join(sketches, ["partition", "hash"]).select("doc_id", "item_id").distinct(), "candidates")
    ids = candidates.select("doc_id").distinct()
    again = docs.join(F.broadcast(ids) if ids.count() * ID_BYTES <= MAX_BROADCAST else ids, "doc_id", "left_semi")
    wanted = known.select("item_id", "width", "shingles", "n_item")
    wanted = F.broadcast(wanted) if sum(r.shingles for r in bounds) * SHINGLE_BYTES <= MAX_BROADCAST else wanted
    asked = candidates.join(wanted, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "width", "n_item", "shingles")).alias("asked"))
    again = again.join(asked, "doc_id").select("doc_id", "asked", words(F.col("text")).alias("words"))
    by_width = F.array(*[F.struct(F.lit(w).alias("width"), F.array_distinct(_shingles("words", w)).alias("own")) for w in widths])
    again = again.select("doc_id", "asked", by_width.alias("by_width"))

    def counted(x: Column) -> Column:
        own = F.filter("by_width", lambda y: y["width"] == x["width"])[0]["own"]
        return F.struct(x["item_id"].alias("item_id"), x["n_item"].cast("long").alias("n_item"), F.size(F.array_intersect(x["shingles"], own)).cast("long").alias("n_common"))

    pairs = again.select("doc_id", F.inline(F.transform("asked", counted)))
    pairs = pairs.filter(F.col("n_common") * SHARE[1] >= F.col("n_item") * SHARE[0])
    pairs = pairs.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_common").alias("n_common"))
    return pairs.withColumn("containment", F.col("n_common") / F.col("n_item"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
b as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark),
i as (select distinct item_id, k, array_to_string(w[p : p + k - 1], ' ') as s
  from (select item_id, w, least(len(w), 5) as k, unnest(range(1, len(w) - least(len(w), 5) + 2)) as p from b where len(w) > 0)),
n as (select item_id, count(*) as n_item from i group by item_id),
s as (select distinct doc_id, k, array_to_string(w[p : p + k - 1], ' ') as s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from i) where len(w) >= k)),
c as (select doc_id, item_id, count(*) as n_common from s join i using (k, s) group by doc_id, item_id)
select doc_id, item_id, n_item, n_common, n_common / n_item as containment from c join n using (item_id) where n_common * 5 >= n_item * 4"""
