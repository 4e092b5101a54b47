"""Line dedup by a sharded minimal perfect hash.

The 128-bit hashes of the keys of all lines are counted, with pre-aggregation, by documents that hold them. Those of at
least two documents are the index: they are dealt to shards by hash, about SHARD_KEYS each, and a shard is one row with
a minimal perfect hash (a level of seeds for buckets of keys) over three compact arrays: fingerprint, count and the
smallest document. Documents' line hashes go to their shard and probe its arrays; an unknown line is told by its
fingerprint. No line is joined with a line, and no text is shuffled but once, to be rebuilt beside its dropped lines.

The probes of a shard are dealt to blocks of about BLOCK_PROBES, by document, and each block has its own copy of the
arrays; so a line that very many documents have only makes more blocks of its shard. Probes stream past the arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.llm.common import table, written

MIN_KEY = 10
MIN_DOCS = 2
SHARD_KEYS = 20_000
#: Probes that meet one copy of a shard's arrays, about.
BLOCK_PROBES = 250_000
#: Bytes of the table of blocks by shard up to which it is broadcast, 24 each.
MAX_BROADCAST = 32 << 20
SPACES = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}
_PER_BUCKET = 4


def line_key(line: str) -> str:
    return line.strip(SPACES).translate(_LOWER)


def key_hash(key: str) -> tuple[int, int]:
    """Two signed 64-bit numbers."""
    d = hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Minimal perfect hash of n distinct 64-bit keys onto range(n): a seed for each bucket of about 4 keys sends them
    to places that are free; large buckets choose first."""

    MOST = 1 << 20  # seeds to try

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @staticmethod
    def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
        return (_mix(keys ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)

    @staticmethod
    def _at(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
        return (_mix(keys + _mix(seeds.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        buckets = max(1, n // _PER_BUCKET)
        bucket = cls._bucket(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        keys, bucket = keys[order], bucket[order]
        size = np.bincount(bucket, minlength=buckets)
        first = np.concatenate([[0], np.cumsum(size)])
        seeds, taken = np.zeros(buckets, np.int64), np.zeros(n, bool)
        for b in np.argsort(-size, kind="stable").tolist():
            if not size[b]:
                break
            own, seed = keys[first[b] : first[b + 1]], 0
            while True:
                if seed >= cls.MOST:
                    raise ValueError("no seed parts these keys")
                # many seeds at once
                tried = np.arange(seed, seed + 64)
                at = cls._at(np.tile(own, 64), np.repeat(tried, len(own)), n).reshape(64, len(own))
                free = ~taken[at].any(axis=1)
                if len(own) > 1:
                    free &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
                good = np.flatnonzero(free)
                if len(good):
                    seeds[b] = tried[good[0]]
                    taken[at[good[0]]] = True
                    break
                seed += 64
        return cls(seeds, n)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return self._at(keys, self.seeds[self._bucket(keys, len(self.seeds))], self.n)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct key of a text: its hashes and its lines' numbers. Rows: doc_id, row, text."""
    for batch in batches:
        a, b, at_row, lines = [], [], [], []
        for n, text in enumerate(batch.column(2)):
            own: dict[str, list[int]] = {}
            for k, line in enumerate((text.as_py() or "").split("\n")):
                if len(line) >= MIN_KEY and len(key := line_key(line)) >= MIN_KEY:
                    own.setdefault(key, []).append(k)
            for key, at in own.items():
                x, y = key_hash(key)
                a.append(x)
                b.append(y)
                at_row.append(n)
                lines.append(at)
        here = pa.array(at_row, pa.int64())
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "doc_id": batch.column(0).take(here), "row": batch.column(1).take(here), "lines": pa.array(lines, pa.list_(pa.int32()))})


def _mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of both halves of a hash."""
    return a.view(np.uint64) ^ _mix(b.view(np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15))


def _shard(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
    for salt in range(64):
        both = _mixed(a, b, salt)
        if len(np.unique(both)) < len(both):
            continue  # another salt parts the two
        try:
            mph = PerfectHash.build(both)
            break
        except ValueError:
            continue
    else:
        raise ValueError("no salt parts the keys of a shard")
    at = mph.place(both)
    out = [np.zeros(mph.n, t) for t in (np.int64, np.int32, np.int64)]
    for array, column in zip(out, (b, np.minimum(rows["n"].to_numpy(), 2**31 - 1), rows["first"].to_numpy())):
        array[at] = column
    seeds = np.concatenate([[salt], mph.seeds]).astype(np.int32)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "seeds": [seeds.tobytes()], "fingerprints": [out[0].tobytes()], "counts": [out[1].tobytes()], "firsts": [out[2].tobytes()]})


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row, lines: the lines that go. Rows: shard, block, is_probe in the order of these, so that a block's
    arrays come first; then arrays and probes, each null in the other's rows."""
    home, arrays = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, block, probe = (batch.column(k).to_numpy() for k in range(3))
        cut = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (block[1:] != block[:-1]) | (probe[1:] != probe[:-1])]))
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(shard)]):
            own = batch.slice(lo, hi - lo)
            if not probe[lo]:
                home = (shard[lo], block[lo])
                field = lambda c, t: np.frombuffer(own.column(c)[0].as_py(), t)  # noqa: B023,E731
                seeds = field("seeds", np.int32).astype(np.int64)
                arrays = (int(seeds[0]), seeds[1:], field("fingerprints", np.int64), field("counts", np.int32), field("firsts", np.int64))
            elif home == (shard[lo], block[lo]):
                salt, seeds, fingerprints, counts, firsts = arrays
                a, b, doc = (own.column(c).to_numpy() for c in ("a", "b", "doc_id"))
                at = PerfectHash(seeds, len(counts)).place(_mixed(a, b, salt))
                goes = (fingerprints[at] == b) & (counts[at] >= MIN_DOCS) & (firsts[at] != doc)
                yield own.filter(pa.array(goes)).select(["doc_id", "row", "lines"])


def dropped_lines(documents: DataFrame) -> DataFrame:
    """doc_id, row, lines (array<int>, places of lines that go); documents: doc_id (not null), row (of the text), text."""
    rows = written(documents.mapInArrow(_line_rows, "a long, b long, doc_id long, row long, lines array<int>"), "lines")
    index = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter(F.col("n") >= MIN_DOCS)
    index = written(index, "line-index")
    total, keys = rows.count(), index.count()
    shards = max(1, keys // SHARD_KEYS)
    shard = F.pmod(F.col("a"), F.lit(shards))
    index = index.withColumn("shard", shard)
    # probes of the keys of the index, and a share of the others
    blocks = index.groupBy("shard").agg((F.floor((F.sum("n") + total / shards) / BLOCK_PROBES) + 1).cast("int").alias("blocks"))
    blocks = F.broadcast(blocks) if shards * 24 <= MAX_BROADCAST else blocks
    arrays = index.groupBy("shard").applyInArrow(_shard, "shard long, seeds binary, fingerprints binary, counts binary, firsts binary").join(blocks, "shard")
    arrays = arrays.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("is_probe"), "seeds", "fingerprints", "counts", "firsts")
    probes = rows.withColumn("shard", shard).join(blocks, "shard")  # a shard without keys drops nothing
    probes = probes.select("shard", F.pmod(F.xxhash64("doc_id", "row"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("is_probe"), "a", "b", "doc_id", "row", "lines")
    both = arrays.unionByName(probes, allowMissingColumns=True).repartition("shard", "block").sortWithinPartitions("shard", "block", "is_probe")
    return both.mapInArrow(_probe, "doc_id long, row long, lines array<int>")


def _rebuilt(full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, sha, kept = [], [], [], []
            for text, gone in zip(batch.column("text"), batch.column("gone")):
                text, gone = text.as_py() or "", set(gone.as_py() or ())
                lines = text.split("\n")
                new = "\n".join([x for k, x in enumerate(lines) if k not in gone]) if gone else text
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
                if full:
                    kept.append(new)
                else:
                    sha.append(hashlib.sha256(new.encode()).hexdigest())
            columns = {"doc_id": batch.column("doc_id"), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            columns |= {"kept": pa.array(kept, pa.string()), "carried": batch.column("carried")} if full else {"kept_sha256": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _lines_left(documents: DataFrame, full: bool, id_col: str, text_col: str) -> DataFrame:
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text_col]).alias("carried")] * full)
    # ids needn't tell rows apart: lines are numbered within a text
    docs = docs.withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = dropped_lines(docs.filter("doc_id is not null").select("doc_id", "row", "text")).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("lines")).alias("gone"))
    joined = docs.join(gone, ["doc_id", "row"], "left")
    made = StructType().add("doc_id", "long").add("n_lines", "long").add("n_dropped", "long")
    made = made.add("kept", "string").add("carried", docs.schema["carried"].dataType) if full else made.add("kept_sha256", "string")
    return joined.mapInArrow(_rebuilt(full), made)


def line_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256.

    Keys of at least MIN_KEY code points in at least two documents lose all their lines but in the smallest doc_id that
    holds them; there all stay. Null and empty texts are one empty line. A document of which every line goes keeps the
    empty text. A row without an id keeps all its lines and is no other's earlier document. Rows that share an id are
    one document in this, so they drop nothing for each other; repeated rows are kept, each with the same result. Extra
    columns aren't carried; an empty table gives an empty result.
    """
    return _lines_left(documents, False, id_col, text_col)


def without_repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, in their order, the text being what line_dedup leaves (null: empty)."""
    out = _lines_left(documents, True, id_col, text_col)
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col("carried").getField(c).alias(c) for c in documents.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
with l as (
  select doc_id, i, s[i] as line from (
    select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents))),
k as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key, count(distinct doc_id) as n, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select k.doc_id, k.i, k.line, c.key is not null and c.first <> k.doc_id as gone from k left join c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by doc_id"""
