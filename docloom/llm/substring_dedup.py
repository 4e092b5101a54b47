"""Repeated strings of LENGTH bytes, by threshold-bounded interval expansion on Burrows-Wheeler transforms.

Each window of LENGTH bytes belongs to an anchor: the place of the least hash among its strings of GRAM bytes. Equal
windows have equal anchors at equal offsets, so they share a key, a hash of a core: bytes that all windows on one side
of the anchor have. Runs of windows with one anchor and side are the rows that are counted; those of a key that occurs
once are unique. Runs equal as a whole, by 128 bits of all their bytes, are collapsed to one with a multiplicity. A key
with one distinct run of multiplicity two or more is repeated throughout.

The distinct runs of the other keys, where copies begin and end, go with their multiplicities to shards of whole keys,
each core shortened to one symbol of its own. A shard sorts the suffixes of its runs, takes their Burrows-Wheeler
transform and derives common prefixes by increasing value: the boundaries of value l, extended backward by each
character that occurs right of them, give those of value l + 1, breadth first, until the length of a window. What is
then undivided are classes of equal windows; those of a multiplicity of two or more are repeated.

A key of over HOT distinct runs (a very common passage in ever other surroundings) would fill one shard. The windows of
its distinct runs are keyed by 128 bits of all of their bytes instead, and counted with pre-aggregation.

Keys, runs and windows that over one in HEAVY rows have are dealt to SALTS tasks in joins; there can't be over HEAVY.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textvec as V
from docloom.llm.common import released, table, written

LENGTH = 400
GRAM = 64
#: Distinct runs of a key that meet in one shard.
HOT = 1000
#: Bytes of runs that are sorted together; a key's runs are never parted.
SHARD_BYTES = 1 << 20
#: Bytes of runs that are sorted in one task, about.
TASK_BYTES = 2 << 20
HEAVY, SALTS = 1000, 64
#: Bytes of places up to which they are broadcast to the texts, PLACE_BYTES each; more are joined by shuffle.
MAX_BROADCAST, PLACE_BYTES = 32 << 20, 80
_LONG = 1 << 22  # bytes of a long text that are taken at once
_PLACE = np.uint64((1 << 24) - 1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of width values."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _parts(texts: pa.Array, overlap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, offset in its text, bytes, offsets); only the part of a long text, which is alone, has an offset."""
    for lo, hi, body, off in V.slices(texts):
        if hi - lo > 1 or len(body) <= _LONG + overlap:
            yield lo, 0, body, off
        else:
            for at in range(0, len(body) - overlap, _LONG):
                part = body[at : at + _LONG + overlap]
                yield lo, at, part, np.array([0, len(part)])


def core_length(length: int, gram: int) -> int:
    return (length - gram + 1) // 2 + gram


def _runs(length: int, gram: int):
    """key, run (two numbers), doc, row, start, windows, core (its offset in the run): one row for each run of windows
    with one anchor, on one side of it. Rows: doc, row, text."""
    width, half = length - gram + 1, (length - gram + 1) // 2
    shared = core_length(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hashes_of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, base, body, off in _parts(batch.column(2), length - 1):
                if len(body) < length:
                    continue
                sums = V.prefix_sums(body)
                n = len(body) - gram + 1
                _, inv = V.powers(len(body))
                hashes = V.mix((sums[gram:] - sums[:-gram]) * inv[:n])
                at = (sliding_least((hashes & ~_PLACE) | np.arange(n, dtype=np.uint64), width) & _PLACE).astype(np.int64)
                size = np.diff(off)
                room = np.repeat(off[1:] - length, size)[: len(at)]
                start = np.flatnonzero(np.arange(len(at)) <= room)
                if not len(start):
                    continue
                anchor = at[start]
                left = anchor - start >= half
                new = np.ones(len(start), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | (start[1:] != start[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(start)) - 1
                s0, s1, anchor, left = start[first], start[last], anchor[first], left[first]
                # what every window on that side of the anchor has
                core = np.where(left, anchor - half, anchor)
                key = V.short_hashes(sums, core, core + shared)  # only brings runs together
                key ^= np.where(left, np.uint64(0), np.uint64(0x5851F42D4C957F2D))
                raw = memoryview(np.ascontiguousarray(body))
                whole = b"".join([xxhash.xxh3_128_digest(raw[a:b], d) for a, b, d in zip(s0.tolist(), (s1 + length).tolist(), (anchor - s0).tolist())])
                whole = np.frombuffer(whole, np.int64).reshape(-1, 2)
                row = np.searchsorted(off, s0, side="right") - 1
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key.view(np.int64)), "r1": pa.array(whole[:, 0]), "r2": pa.array(whole[:, 1]), "doc": pa.array(docs[row + lo]), "row": pa.array(hashes_of[row + lo]),
                    "start": pa.array(s0 - off[row] + base), "windows": pa.array((s1 - s0 + 1).astype(np.int32)), "core": pa.array((core - s0).astype(np.int32)),
                })

    return run


def _cut(length: int, gram: int):
    """key, run, n, core (128 bits), before, after (bytes on either side of the core) of each asked run."""
    shared = core_length(length, gram)
    kinds = {"key": pa.int64(), "r1": pa.int64(), "r2": pa.int64(), "n": pa.int64(), "core": pa.binary(), "before": pa.binary(), "after": pa.binary()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(kinds), kinds.values())], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, asked in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = text.as_py().encode()
                for a in asked:
                    core = a["start"] + a["core"]
                    rows.append((a["key"], a["r1"], a["r2"], a["n"], xxhash.xxh3_128_digest(raw[core : core + shared]), raw[a["start"] : core], raw[core + shared : a["start"] + a["windows"] - 1 + length]))
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

    return run


def _each_window(length: int):
    """key, run, n, at, w1, w2 (128 bits of all its bytes) of each window of the asked runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = memoryview(text.as_py().encode())
                for lo in range(0, len(asked), 64):
                    some = asked[lo : lo + 64]
                    n = np.array([a["windows"] for a in some])
                    made = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[k : k + length]) for a in some for k in range(a["start"], a["start"] + a["windows"])]), np.int64).reshape(-1, 2)
                    columns = {c: pa.array(np.repeat(np.array([a[c] for a in some], np.int64), n)) for c in ("key", "r1", "r2", "n")}
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield pa.RecordBatch.from_pydict(columns | {"at": pa.array(at.astype(np.int32)), "w1": pa.array(made[:, 0]), "w2": pa.array(made[:, 1])})

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a text of codes in the order of their suffixes' first depth codes; codes are under 2**21."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank, h = text.astype(np.int64), 1
    bits = max(1, int(rank.max()).bit_length()) if n else 1
    pack = max(1, 62 // (bits + 1))
    key = np.zeros(n, np.int64)
    for k in range(pack):  # the first codes at once; past the end there is 0
        key <<= bits + 1
        if k < n:
            key[: n - k] += rank[k:] + 1
    h = pack
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[False], ordered[1:] != ordered[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if h >= depth or (n and new[1:].all()):
            return order
        step = min(h, depth - h)
        key = (rank + 1) << 31
        if step < n:
            key[: n - step] += rank[step:] + 1
        h += step


def undivided(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The class of each place of the order; classes are parted where neighbours' common prefix is below depth.

    Backward extension on the Burrows-Wheeler transform: boundary i of value l lies, for a character c, between the
    last suffix before i and the first one j from i on that c precedes; put c before both, and they are neighbours with
    common prefix l + 1, unless a boundary of a lower value lies between them, which has then parted them earlier.
    """
    n = len(text)
    before = text[order - 1]
    by_char = np.argsort(before, kind="stable")
    back = np.empty(n, np.int64)  # where the suffix one character longer stands
    back[by_char] = np.arange(n)
    last = np.full(n, -1, np.int64)  # the place before that the same character precedes
    same = before[by_char[1:]] == before[by_char[:-1]]
    last[by_char[1:][same]] = by_char[:-1][same]
    first = text[order]
    value = np.full(n + 1, -1, np.int32)
    value[n] = 0
    front = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    value[front] = 0
    for level in range(depth - 1):
        if not len(front):
            break
        made = []
        since, at, width = front, front, 4
        while len(since):
            spots = at[:, None] + np.arange(width)
            np.minimum(spots, n, out=spots)
            known = value[spots]
            stop = (known >= 0) & (known <= level) & (spots > since[:, None])
            open_ = np.cumsum(stop, axis=1) == 0
            spots_ = np.where(open_, spots, 0)
            take = open_ & (last[spots_] < since[:, None])
            target = back[spots_[take]]
            target = target[value[target] < 0]
            value[target] = level + 1
            made.append(target)
            more = open_[:, -1]
            since, at, width = since[more], at[more] + width, min(2 * width, 1024)
        front = np.unique(np.concatenate(made))
    return np.cumsum(value[:n] >= 0) - 1


def repeated_windows(sides: list[tuple[bytes, bytes]], cores: list, counts: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each run, which of its windows of depth symbols occur at least twice in all, runs counting as often as given.
    A run is the bytes before its core, the core as one symbol, and the bytes after it."""
    size = np.array([len(a) + len(b) + 1 for a, b in sides])
    at = np.array([len(a) for a, _ in sides])
    ends = np.cumsum(size + 1) - 1
    begins = ends - size
    text = np.frombuffer(b"".join([x for a, b in sides for x in (a, b"\0", b, b"\0")]), np.uint8).astype(np.int64)
    used = np.zeros(256, np.int64)
    used[text] = 1
    text = np.cumsum(used)[text]  # bytes as 1, 2, ... in order
    text[ends] = 0  # no window has this
    symbols: dict = {}
    text[begins + at] = used.sum() + 1 + np.array([symbols.setdefault(c, len(symbols)) for c in cores])
    order = suffix_order(text, depth)
    classes = undivided(text, order, depth)
    owner = np.repeat(np.arange(len(sides)), size + 1)
    window = np.arange(len(text)) <= ends[owner] - depth
    weight = np.where(window[order], counts[owner[order]], 0)
    total = np.bincount(classes, weights=weight)
    twice = np.zeros(len(text), bool)
    twice[order] = total[classes] >= 2
    twice &= window
    return [twice[a : e - depth + 1] for a, e in zip(begins.tolist(), ends.tolist())]


_SPANS = "key long, r1 long, r2 long, spans array<int>"


def _shards(depth: int):
    """Of each run, spans: first and last window + 1 of stretches of repeated windows, flat. Rows come by key."""
    def decide(rows: list[tuple]) -> pa.RecordBatch:
        keys, r1, r2, counts, cores, before, after = zip(*rows)
        spans = []
        for flags in repeated_windows(list(zip(before, after)), list(cores), np.array(counts), depth):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            spans.append(edge.astype(np.int32))
        some = [k for k, s in enumerate(spans) if len(s)]
        columns = {c: pa.array([x[k] for k in some], pa.int64()) for c, x in (("key", keys), ("r1", r1), ("r2", r2))}
        return pa.RecordBatch.from_pydict(columns | {"spans": pa.array([spans[k] for k in some], pa.list_(pa.int32()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held >= SHARD_BYTES and row[0] != rows[-1][0]:
                    yield decide(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[5]) + len(row[6]) + 2
        if rows:
            yield decide(rows)

    return run


def _beside(docs: DataFrame, places: DataFrame) -> DataFrame:
    """text, asked (array of what places has for the document)."""
    few = places.count() * PLACE_BYTES <= MAX_BROADCAST
    asked = places.groupBy("doc", "row").agg(F.collect_list(F.struct(*[c for c in places.columns if c not in ("doc", "row")])).alias("asked"))
    return docs.join(F.broadcast(asked) if few else asked, ["doc", "row"]).select("text", "asked")


def _dealt_join(many: DataFrame, one: DataFrame, on: list[str], heavy: DataFrame) -> DataFrame:
    """many joined with one; what heavy lists, at most HEAVY keys, is dealt to SALTS tasks."""
    flags = F.broadcast(heavy.select(*on, F.lit(True).alias("__heavy")))
    is_heavy = F.coalesce("__heavy", F.lit(False))
    many = many.join(flags, on, "left").withColumn("__salt", F.when(is_heavy, F.pmod(F.xxhash64(*many.columns), F.lit(SALTS))).otherwise(0).cast("int")).drop("__heavy")
    salts = F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    one = one.join(flags, on, "left").withColumn("__salt", F.explode(salts)).drop("__heavy")
    return many.join(one, [*on, "__salt"]).drop("__salt")


def _hot_spans(docs: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """As _shards gives them, for runs of keys with too many for one shard."""
    windows = written(_beside(docs, hot).mapInArrow(_each_window(length), "key long, r1 long, r2 long, n long, at int, w1 long, w2 long"), "windows")
    by = ["key", "w1", "w2"]
    twice = written(windows.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("rows")).filter("n >= 2"), "twice")
    heavy = twice.filter(F.col("rows") > windows.count() // HEAVY)
    found = _dealt_join(windows.drop("n"), twice.select(*by), by, heavy)
    return found.groupBy("key", "r1", "r2").agg(F.flatten(F.collect_list(F.array("at", F.col("at") + 1))).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc, row, start, end: stretches of bytes that repeated windows cover, overlapping; docs: doc, row, text."""
    rows = written(docs.mapInArrow(_runs(length, gram), "key long, r1 long, r2 long, doc long, row long, start long, windows int, core int"), "runs")
    total = rows.count()
    by = ["key", "r1", "r2"]
    by_run = rows.groupBy(*by).agg(F.count("*").alias("n"))
    keys = written(by_run.groupBy("key").agg(F.count("*").alias("runs"), F.sum("n").alias("total")).filter("total >= 2"), "keys")
    again = written(_dealt_join(rows, keys.select("key", "runs"), ["key"], keys.filter(F.col("total") > total // HEAVY)), "again")
    released(rows)
    sure = again.filter("runs = 1").select("doc", "row", "start", (F.col("start") + F.col("windows") - 1 + length).alias("end"))
    mixed = again.filter("runs > 1")
    distinct = mixed.groupBy(*by).agg(F.count("*").alias("n"), F.max("runs").alias("runs"), F.min(F.struct("doc", "row", "start", "windows", "core")).alias("one"))
    distinct = written(distinct.select(*by, "n", "runs", "one.*"), "distinct")
    cold, hot = distinct.filter(F.col("runs") <= HOT).drop("runs"), distinct.filter(F.col("runs") > HOT).drop("runs")
    bodies = _beside(docs, cold).mapInArrow(_cut(length, gram), "key long, r1 long, r2 long, n long, core binary, before binary, after binary")
    held = cold.agg(F.coalesce(F.sum(F.col("windows") + length), F.lit(0))).first()[0]
    decided = bodies.repartition(1 + held // TASK_BYTES, "key").sortWithinPartitions("key").mapInArrow(_shards(length - core_length(length, gram) + 1), _SPANS)
    if not hot.isEmpty():
        decided = decided.unionByName(_hot_spans(docs, hot, length))
    decided = written(decided, "decided")
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct(F.get("spans", i).alias("a"), F.get("spans", i + 1).alias("b")))
    partly = _dealt_join(mixed.select(*by, "doc", "row", "start"), decided, by, distinct.filter(F.col("n") > total // HEAVY))
    partly = partly.select("doc", "row", "start", F.explode(pairs).alias("s"))
    return sure.unionByName(partly.select("doc", "row", (F.col("start") + F.col("s.a")).alias("start"), (F.col("start") + F.col("s.b") - 1 + length).alias("end")))


def _without(full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw, out, end, removed, count = (text.as_py() or "").encode(), [], 0, 0, 0
                spans = sorted((s["start"], s["end"]) for s in spans.as_py()) if spans.is_valid else []
                joined: list[list[int]] = []
                for a, b in spans:
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                for a, b in joined:
                    out.append(raw[end:a])
                    removed, count, end = removed + b - a, count + 1, b
                out.append(raw[end:])
                rest = b"".join(out)
                n_bytes.append(len(raw))
                n_removed.append(removed)
                n_spans.append(count)
                sha.append(hashlib.sha256(rest).hexdigest())
                if full:
                    kept.append(rest)
            columns = {"doc_id": batch.column(0), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            columns["has_repeats"] = pa.array([n > 0 for n in n_removed], pa.bool_())
            if full:
                columns["kept"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def substring_dedup(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, full: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats (n_removed > 0); full=True
    adds kept (binary: what stays may cut a character).

    Each byte goes that a string of length bytes covers which starts anywhere else too, in this or another text; all
    are judged on the input. Null texts are empty; texts shorter than length stay whole. Every row is a text of its own:
    repeated rows are copies of each other, rows may share an id, and rows without an id are judged like others. Extra
    columns aren't carried; an empty table gives an empty result.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # ids needn't tell rows apart: the key is id and text hash, never null
    docs = docs.withColumn("doc", F.coalesce("doc_id", F.lit(-1))).withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    spans = repeated_spans(docs.select("doc", "row", "text"), length, gram).groupBy("doc", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = docs.join(spans, ["doc", "row"], "left").select("doc_id", "text", "spans")
    made = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, has_repeats boolean"
    return joined.mapInArrow(_without(full), made + (", kept binary" if full else ""))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


ORACLE = f"""
with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, p, md5_number(substr(x, 2 * p + 1, {2 * LENGTH})) as k from (select doc_id, x, unnest(range(0, length(x) // 2 - {LENGTH - 1})) as p from h)),
d as (select doc_id, p from (select doc_id, p, count(*) over (partition by k) as n from w) where n > 1),
i as (select doc_id, p, sum(case when q is null or p > q + {LENGTH} then 1 else 0 end) over (partition by doc_id order by p) as g from (select doc_id, p, lag(p) over (partition by doc_id order by p) as q from d)),
s as (select doc_id, g, min(p) as a, max(p) + {LENGTH} as b from i group by doc_id, g),
l as (select doc_id, [0] || list(b order by a) as f, list(a order by a) as t from s group by doc_id),
o as (select h.doc_id, x, length(x) // 2 as n, coalesce(f, [0]) as f, coalesce(t, []) || [length(x) // 2] as t from h left join l on h.doc_id = l.doc_id),
c as (select doc_id, n, len(f) - 1 as n_spans, list_transform(range(1, len(f) + 1), lambda k: substr(x, 2 * f[k] + 1, 2 * (t[k] - f[k]))) as kept from o)
select doc_id, n as n_bytes, n - length(array_to_string(kept, '')) // 2 as n_removed, n_spans, sha256(unhex(array_to_string(kept, ''))) as kept_sha256, n > length(array_to_string(kept, '')) // 2 as has_repeats from c"""
