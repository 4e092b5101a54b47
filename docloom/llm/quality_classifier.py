"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: one of target texts (labelled as good) and one of all raw texts.
A text's log importance weight is the mean log ratio of its n-grams' probabilities under the two, times a standard
length, so that long texts don't outweigh short ones. Adding independent Gumbel noise to the log weights and keeping the
top k draws k texts without replacement in proportion to their weights.

Tokens are runs of letters and digits or of other marks; n-grams are single tokens and pairs, a token after itself being
a pair of its own kind, whatever the token. Counts are over all documents. The target's texts and the cut that sets k
come from a bounded sample of labelled rows: the LABELLED ones of the smallest id hash. k is the number of documents
whose weight reaches the cut that separates good from bad best in that sample.

The k-th largest key is found by radix selection: each round counts keys by their next bits, so neither a total sort
nor the keys themselves ever meet in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textvec as V
from docloom.llm.common import table, written

BUCKETS = 1 << 14
#: Bound of the labelled sample.
LABELLED = 20_000
#: N-grams of the length that weights are scaled to.
LENGTH = 64.0
SMOOTHING = 1.0
SEED = 17
BITS = 12
#: A sample must have as many labels of each kind, or all documents are kept.
LEAST_LABELS = 5
_SAME = np.uint64(0x5851F42D4C957F2D)


def ngram_buckets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bucket of each n-gram, its row from 0) of slices of a batch."""
    for lo, hi, body, off in V.slices(texts):
        body = V.LOWER[body]
        start, end, row = V.runs(V.WORD_PUNCT[body], off)
        h = V.short_hashes(V.prefix_sums(body), start, end)  # goes to one of BUCKETS anyway
        pair = V.mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
        pair[h[:-1] == h[1:]] = _SAME
        inside = row[1:] == row[:-1]
        grams = np.concatenate([h, pair[inside]])
        yield lo, hi, (grams % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([row, row[1:][inside]])


def _counts(target: np.ndarray):
    """target: ids of the sample's good documents, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good = pc.is_in(batch.column(0), pa.array(target)).to_numpy(zero_copy_only=False)  # null: not good
            for lo, _, bucket, row in ngram_buckets(batch.column(1)):
                sums[0] += np.bincount(bucket, minlength=BUCKETS)
                sums[1] += np.bincount(bucket[good[row + lo]], minlength=BUCKETS)
        kind, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kind.astype(np.int32)), "bucket": pa.array(bucket.astype(np.int32)), "n": pa.array(sums[kind, bucket])})

    return run


def _weights(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            total, count = np.zeros(n), np.zeros(n, np.int64)
            for lo, hi, bucket, row in ngram_buckets(batch.column(1)):
                total[lo:hi] = np.bincount(row, weights=ratio[bucket], minlength=hi - lo)
                count[lo:hi] = np.bincount(row, minlength=hi - lo)
            weight = np.where(count > 0, total / np.maximum(count, 1) * LENGTH, -1e6)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_grams": pa.array(count), "log_weight": pa.array(weight)})

    return run


def log_ratio(documents: DataFrame, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket; documents: doc_id, text."""
    rows = documents.mapInArrow(_counts(target), "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    sums = np.zeros((2, BUCKETS))
    for r in rows.collect():  # at most 2 * BUCKETS rows
        sums[r.kind, r.bucket] = r.n
    share = (sums + SMOOTHING) / (sums + SMOOTHING).sum(axis=1, keepdims=True)
    return np.log(share[1]) - np.log(share[0])


def _ordered_bits(x: Column) -> Column:
    """A long, 0 or more, in the order of the double x."""
    # doubles here are clipped and scaled to integers of 48 bits: ties go by id
    return F.least(F.greatest((x + 4096.0) * F.lit(float(1 << 35)), F.lit(0.0)), F.lit(float((1 << 48) - 1))).cast("long")


def top_k(keys: DataFrame, k: int) -> Column:
    """The condition that the k rows of largest (rank, tie) meet; keys: rank (long, 0 to 2**48 - 1), tie (long, distinct)."""
    def bound(df: DataFrame, value: Column, want: int, bits: int) -> tuple[int, int]:
        """(the want-th largest of value's low bits, read as unsigned; how many of the rows with it are wanted)."""
        prefix, done = 0, 0
        while done < bits:
            step = min(BITS, bits - done)
            rest = bits - done - step
            near = df.filter(F.shiftrightunsigned(value, rest + step) == prefix) if done else df
            digit = F.shiftrightunsigned(value, rest).bitwiseAND(F.lit((1 << step) - 1))
            counts = {r.d: r.n for r in near.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()}  # at most 2**BITS rows
            for d in sorted(counts, reverse=True):
                if want <= counts[d]:
                    prefix = prefix << step | d
                    break
                want -= counts[d]
            done += step
        return prefix, want

    if k <= 0:
        return F.lit(False)
    rank, want = bound(keys, F.col("rank"), k, 48)
    least = -(1 << 63)
    # with the sign bit turned, unsigned order is the order of signed numbers
    tie, _ = bound(keys.filter(F.col("rank") == rank), F.col("tie").bitwiseXOR(F.lit(least)), want, 64)
    return (F.col("rank") > rank) | ((F.col("rank") == rank) & (F.col("tie") >= F.lit(tie + least)))


def best_cut(scored: list[tuple[float, int]]) -> float:
    """The weight that separates good from bad with the least balanced error; of equal ones the middle of the gap that
    is widest."""
    good = sum(q for _, q in scored)
    bad = len(scored) - good
    if good < LEAST_LABELS or bad < LEAST_LABELS:
        return -np.inf
    scored = sorted(scored)
    options, lost, caught = [(1.0, 0.0, -np.inf)], 0, 0
    for (w, q), (after, _) in zip(scored, scored[1:]):
        lost, caught = lost + q, caught + (1 - q)
        if after > w:
            # a lost good text weighs twice a bad one that stays
            options.append((2 * lost / good + 1 - caught / bad, w - after, (w + after) / 2))
    return min(options)[2]


def quality_classifier(documents: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_grams, log_weight, gumbel_key, kept (k of them true).

    labels: doc_id, quality (1 good, 0 bad; null: unlabelled). Without enough labels of both kinds all documents are
    kept. Null and empty texts have no n-grams and the least weight. Equal texts have equal weights and noise by their
    ids; rows that share an id share its noise and label, and rows equal in id and weight stand or fall together, so that
    more than k may be kept then; rows without an id are unlabelled and share one noise. Extra columns aren't carried; an
    empty table gives an empty result.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    sample = [(r.doc_id, r.quality) for r in labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(LABELLED).collect()]
    quality = dict(sample)
    target = np.array(sorted(i for i, q in quality.items() if q), np.int64)
    ratio = log_ratio(docs, target)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    gumbel = -F.log(-F.log(uniform))
    scored = docs.mapInArrow(_weights(ratio), "doc_id long, n_grams long, log_weight double").withColumn("gumbel_key", F.col("log_weight") + gumbel)
    scored = written(scored.withColumn("rank", _ordered_bits(F.col("gumbel_key"))).withColumn("tie", F.coalesce("doc_id", F.lit(-(1 << 63)))), "weights")
    if k is None:
        own = docs.sparkSession.createDataFrame([(int(i),) for i in quality], "doc_id long")
        weights = scored.select("doc_id", "log_weight").join(F.broadcast(own), "doc_id").collect() if quality else []  # at most LABELLED rows
        cut = best_cut([(r.log_weight, quality[r.doc_id]) for r in weights])
        k = scored.filter(F.col("log_weight") >= F.lit(float(cut))).count() if np.isfinite(cut) else scored.count()
    kept = top_k(scored, k) if k < scored.count() else F.lit(True)
    return scored.select("doc_id", "n_grams", "log_weight", "gumbel_key", kept.alias("kept"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
