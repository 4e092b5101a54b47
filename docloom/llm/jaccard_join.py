"""N-gram Jaccard join by vertical partitioning.

Texts are sets of hashed word shingles. Two sets of the wanted similarity share a shingle of their prefixes in any one
global order; here rare shingles come first, so that a passage which other texts have too makes no candidates of texts
that also have words of their own. It is done twice. First the order is: the shingles of one range of hashes by the
number of texts that have them, then the others by hash, then those that blocks of texts show to be very common; the
range, REGION times the dissimilarity, is what prefixes are mostly taken from, and all that has to be counted. Then the
texts that share a prefix shingle with another one of a fitting size are ordered again, among themselves and by all of
their shingles. What no other of these texts has comes first, and can't be shared.

The hashes are cut into fragments. A candidate pair's overlap is counted in each fragment apart, by other tasks, and the
partial counts are summed. Pairs are dealt by where they come from, so that a set goes to few tasks, however many pairs
it has.

Texts of equal sets (by 128 bits) are one node from the start, so exact copies make no pairs. In a prefix bucket each
set is at first paired with one leader only, the set that has the fewest rarer shingles, so the middle of a group of
near copies; the verified links are closed to components. Then each bucket that still has several components gives its pairs
between different components, less those that sizes and places in the order rule out and those that meet in an earlier
bucket. Pairs inside a component can't change it, so no component is lost, and a large group of near copies costs about
one pair a copy. A bucket of over BUCKET sets is dealt to parts, which are paired with each other's sets through their
leaders at first, and part with part after that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm import textvec as V
from docloom.llm.common import released, table, written

#: Fragments of the hashes, a power of 2.
FRAGMENTS = 4
#: Share of the hashes that is counted, as a multiple of 1 - share.
REGION = 1.6
#: Slices of texts that are counted together to find very common shingles, and the texts that make one common there.
BLOCK_SLICES = 48
FREQUENT = 3
#: Common shingles that are known to all tasks, 16 bytes each; the most common ones, as any order gives right results.
MAX_FREQUENT = 1_000_000
#: Sets of a bucket that meet in one part.
BUCKET = 20_000
#: Pairs of one leader, and sets on one side of a bucket's pairs, that are counted in one group.
DEALT, SIDE = 256, 512
#: Shingles before its place that a set of a bucket is known by.
EARLY = 4
#: Bytes of hashes that are counted in one group, about.
GROUP_BYTES = 64 << 20
#: Bytes of (document, set) rows up to which texts are chosen by broadcast, beyond that by shuffle; 40 bytes a row.
MAX_BROADCAST = 64 << 20
#: Shingles that are looked up, and pairs that are tested, at once.
LOOKED_UP = 2_000_000
_OTHERS, _COMMON = 1 << 40, 1 << 41


def _sets(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, distinct shingle hashes by row and then size, first of each row and the end)."""
    for lo, hi, body, off in V.slices(texts):
        body = V.LOWER[body]
        start, end, row = V.runs((~V.SPACE[body]).view(np.uint8), off)
        made, rows = V.shingles(V.span_hashes(body, start, end), row, hi - lo, width)
        order = np.argsort(made, kind="stable")
        made, rows = made[order], rows[order]
        order = np.argsort(rows, kind="stable")
        made, rows = made[order], rows[order]
        new = np.ones(len(made), bool)
        new[1:] = (made[1:] != made[:-1]) | (rows[1:] != rows[:-1])
        made, rows = made[new], rows[new]
        yield lo, hi, made, np.searchsorted(rows, np.arange(hi - lo + 1))


def _set_ids(made: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two signed numbers a row."""
    raw = memoryview(np.ascontiguousarray(made)).cast("B")
    cut = (first * 8).tolist()
    return np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(cut[:-1], cut[1:])]), np.int64).reshape(-1, 2)


def _describe(width: int):
    """kind 0: doc_id, hi and lo of its set, n = size; kind 1: hi = a shingle that is common in a block, n = its sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[np.ndarray] = []
        slices, seen = 0, set()

        def common() -> pa.RecordBatch:
            every = np.concatenate([np.zeros(0, np.uint64), *block])
            block.clear()
            every.sort()
            found = np.unique(every[FREQUENT - 1 :][every[FREQUENT - 1 :] == every[: len(every) - FREQUENT + 1]])
            n = np.searchsorted(every, found, side="right") - np.searchsorted(every, found)
            return _described(1, pa.nulls(len(n), pa.int64()), found.view(np.int64), np.zeros(len(n), np.int64), n)

        for batch in batches:
            n_of, set_of = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 2), np.int64)
            for lo, hi, made, first in _sets(batch.column(1), width):
                n_of[lo:hi] = np.diff(first)
                set_of[lo:hi] = _set_ids(made, first)
                fresh = np.ones(hi - lo, bool)  # copies count once
                for k, s in enumerate(map(tuple, set_of[lo:hi].tolist())):
                    fresh[k] = s not in seen
                    seen.add(s)
                block.append(made[np.repeat(fresh, n_of[lo:hi])])
                slices += 1
                if slices == BLOCK_SLICES:
                    yield common()
                    slices, seen = 0, set()
            yield _described(0, batch.column(0), set_of[:, 0], set_of[:, 1], n_of)
        yield common()

    return run


def _described(kind: int, doc, hi, lo, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(n), kind, np.int32)), "doc_id": doc, "hi": pa.array(hi), "lo": pa.array(lo), "n": pa.array(n)})


def _prefix_length(n, share: tuple[int, int]):
    return n - (share[0] * n + share[1] - 1) // share[1] + 1


def _offered(width: int, share: tuple[int, int], common, bound: int, known_sets: bool):
    """hash, set, often, size: of each set its shingles in the region of hashes under bound, and the next ones in the
    order if these are fewer than its prefix. often: sets, of a common shingle; set: the first half of its id. One more
    row a set, with often -1, has its size: n << 32 | shingles in the region.

    Rows: text; each set once a task. With known_sets: text, hi, lo, node; a text whose set is another one's, as rows
    may share an id, gives nothing, and the node is the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, texts = common.value
        seen: set[tuple[int, int]] = set()
        limit = np.uint64(bound)
        for batch in batches:
            if known_sets:
                wanted, nodes = np.stack([batch.column(k).to_numpy() for k in (1, 2)], axis=1), batch.column(3).to_numpy()
            for lo, hi, made, first in _sets(batch.column(0), width):
                n, ids = np.diff(first), _set_ids(made, first)
                row = np.repeat(np.arange(hi - lo), n)
                weight = np.zeros(len(made), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, made), len(known) - 1)
                    weight = np.where(known[at] == made, texts[at], 0)
                region = (weight == 0) & (made >> np.uint64(32) < limit)
                if weight.any():
                    order = np.lexsort((weight, row))  # stable: by hash within
                    made, weight, region = made[order], weight[order], region[order]
                held = np.bincount(row[region], minlength=hi - lo)
                if known_sets:
                    length = np.where((ids == wanted[lo:hi]).all(axis=1), n, 0)
                    names = nodes[lo:hi]
                else:
                    names = ids[:, 0]
                    length = np.where(n > 0, np.maximum(held, _prefix_length(n, share)), 0)
                    for k, s in enumerate(map(tuple, ids.tolist())):
                        if s in seen:
                            length[k] = 0
                        seen.add(s)
                at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length - first[:-1], length)
                has = np.flatnonzero(length)
                none = np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_pydict({
                    "hash": pa.array(np.concatenate([made[at].view(np.int64), names[has]])), "set": pa.array(np.concatenate([np.repeat(names, length), names[has]])),
                    "often": pa.array(np.concatenate([weight[at], np.full(len(has), -1)])), "size": pa.array(np.concatenate([none, (n << 32 | held)[has]])),
                })

    return run


def _ordered(offered: DataFrame, share: tuple[int, int], bound: int) -> DataFrame:
    """set, n, alone, own, found: of each set that can be similar to another one, the offered shingles that others have,
    in the order (structs of weight and hash); alone: how many come before, as no other has them; own: how many of found
    are of the prefix."""
    # a common shingle isn't counted; its rows are dealt by set as well
    spread = F.when(F.col("often") > 0, F.pmod(F.xxhash64("set"), F.lit(1024))).otherwise(0)
    one = W.partitionBy("hash", "spread")
    several = F.min("set").over(one) != F.max("set").over(one)
    rows = offered.withColumn("spread", spread).select("hash", "set", "often", "size", F.count(F.lit(1)).over(one).alias("sets"), several.alias("several"))
    weight = F.when(F.col("often") > 0, F.lit(_COMMON) + F.col("often")).when(F.shiftrightunsigned("hash", 32) < bound, F.col("sets")).otherwise(F.lit(_OTHERS))
    rows = rows.filter("often <> 0 or several").select("set", "size", F.when(F.col("often") >= 0, F.struct(weight.alias("weight"), "hash")).alias("one"))
    sets = rows.groupBy("set").agg(F.sort_array(F.collect_set("one")).alias("found"), F.max("size").alias("size"))
    sets = sets.select("set", "found", F.shiftright("size", 32).alias("n"), F.col("size").bitwiseAND(F.lit((1 << 32) - 1)).alias("held"))
    counted = F.size(F.filter("found", lambda x: x["weight"] < _OTHERS))
    sets = sets.withColumn("alone", F.greatest(F.col("held") - counted, F.lit(0)).cast("int"))
    length = F.expr(f"n - ({share[0]} * n + {share[1] - 1}) div {share[1]} + 1")
    return sets.withColumn("own", (length - F.col("alone")).cast("int")).filter("own > 0").select("set", "n", "alone", "own", "found")


def _prefixes(sets: DataFrame) -> DataFrame:
    """bucket, hash, node, n, place, parts, part: the prefix of each set. place: the shingle's rank in its set, or
    less; bucket: its hash, or of one that very many sets have a part by set."""
    out = sets.select("node", "n", "alone", F.posexplode(F.slice("found", F.lit(1), F.col("own"))).alias("at", "one"))
    texts = F.when(F.col("one.weight") >= _COMMON, F.col("one.weight") - _COMMON).when(F.col("one.weight") < _OTHERS, F.col("one.weight")).otherwise(0)
    out = out.select(F.col("one.hash").alias("hash"), "node", "n", (F.col("alone") + F.col("at")).alias("place"), (F.lit(1) + F.floor(texts / BUCKET)).cast("int").alias("parts"))
    out = out.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    bucket = F.when(F.col("parts") == 1, F.col("hash")).otherwise(F.xxhash64("hash", "part"))
    return out.select(bucket.alias("bucket"), "hash", "node", "n", "place", "parts", "part")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of stretches of rows that start and end with a whole group of the first column; rows come in its order."""
    kept: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, new = batch.schema.names[0], {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
        cut = int(np.searchsorted(new[key], new[key][-1]))  # start of the last group
        if cut or (kept and kept[-1][key][-1] != new[key][0]):
            kept.append({c: v[:cut] for c, v in new.items()})
            yield {c: np.concatenate([k[c] for k in kept]) for c in new}
            kept = []
        kept.append({c: v[cut:] for c, v in new.items()})
    if kept:
        yield {c: np.concatenate([k[c] for k in kept]) for c in kept[0]}


def _possible(share: tuple[int, int], n1, p1, n2, p2):
    """Sizes and places of a shared shingle allow the similarity."""
    need = -((-share[0] * (n1 + n2)) // (share[0] + share[1]))
    return np.minimum(n1 - p1, n2 - p2) >= need


def _fitting(share: tuple[int, int]):
    """node: sets of a bucket beside which another one of it (or another part) has a size and place that allow the
    similarity, and perhaps some more. Rows: bucket, hash, node, n, place, parts, part by bucket and n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            n, place = g["n"].astype(np.int64), g["place"].astype(np.int64)
            least = -(-n * share[0] // share[1])  # size of the smallest set that can be similar
            own = _possible(share, n, place, least, np.zeros(len(n), np.int64))
            key, node, n, parts = g["bucket"][own], g["node"][own], n[own], g["parts"][own]
            near = np.zeros(len(n), bool)  # the next larger or smaller one fits by size
            near[1:] = (key[1:] == key[:-1]) & (n[1:] * share[0] <= n[:-1] * share[1])
            near[:-1] |= near[1:]
            yield pa.RecordBatch.from_pydict({"node": pa.array(np.unique(node[near | (parts > 1)]))})

    return run


_PAIR = "a long, b long, n_a long, n_b long, label long, salt int"


def _pairs(a, b, n_a, n_b, label, salt) -> dict[str, pa.Array]:
    longs = {"a": a, "b": b, "n_a": n_a, "n_b": n_b, "label": label}
    return {c: pa.array(x, pa.int64()) for c, x in longs.items()} | {"salt": pa.array(salt, pa.int32())}


def _dealt(nodes: np.ndarray, ways: np.ndarray) -> np.ndarray:
    return (V.mix(nodes.view(np.uint64)) % ways.astype(np.uint64)).astype(np.int64)


def _buckets(share: tuple[int, int]):
    """kind 0: a pair of the bucket's leader a with b; 1: a = hash, b = a set, n_b and place, of each bucket with several
    sets or parts; 2: the leader b of a part of the bucket of hash a; salt of these two is the part. Rows: bucket, hash,
    node, n, place, parts, part by bucket and node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            first = np.flatnonzero(np.concatenate([[True], g["bucket"][1:] != g["bucket"][:-1]]))
            size = np.diff(np.append(first, len(g["bucket"])))
            many = np.repeat(size > 1, size) | (g["parts"] > 1)
            size = size[many[first]]
            if not len(size):
                continue
            key, node, n, place, parts, part = (g[c][many].astype(np.int64) for c in ("hash", "node", "n", "place", "parts", "part"))
            # the leader: the fewest rarer shingles, then least node
            order = np.lexsort((node, place / n, np.repeat(np.arange(len(size)), size)))
            top = order[np.cumsum(size) - size]
            lead = np.repeat(top, size)
            pair = (node[lead] != node) & _possible(share, n[lead], place[lead], n, place)
            over = top[parts[top] > 1]
            k = (int(pair.sum()), len(node), len(over))
            zero = [np.zeros(x, np.int64) for x in k]
            salt = _dealt(node, np.repeat(size, size) // DEALT + 1)[pair]
            columns = _pairs(
                np.concatenate([node[lead][pair], key, key[over]]), np.concatenate([node[pair], node, node[over]]), np.concatenate([n[lead][pair], zero[1], zero[2]]),
                np.concatenate([n[pair], n, n[over]]), np.concatenate([node[lead][pair], zero[1], zero[2]]), np.concatenate([salt, part, part[over]]),
            )
            columns["place"] = pa.array(np.concatenate([zero[0], place, place[over]]).astype(np.int32))
            columns["parts"] = pa.array(np.concatenate([zero[0], parts, parts[over]]).astype(np.int32))
            columns["kind"] = pa.array(np.repeat(np.array([0, 1, 2], np.int32), k))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _crossing(share: tuple[int, int]):
    """Pairs of different components of a cell (a bucket, or two parts of one) that sizes and places allow and that
    share none of the early shingles, as they meet there then. Rows: cell, node, n, place, component, part, within (1:
    pairs of one part count), known (of the early shingles), e0 to e3 by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            order = np.lexsort((g["n"], g["cell"]))
            cell, c, n, place, node, part, within, known = (g[x][order].astype(np.int64) for x in ("cell", "component", "n", "place", "node", "part", "within", "known"))
            early = np.stack([g[f"e{k}"][order] for k in range(EARLY)])
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            size = np.diff(np.append(first, len(cell)))
            after = np.repeat(first + size, size) - 1 - np.arange(len(cell))  # larger ones of the cell
            side = np.repeat(size // SIDE + 1, size)
            upto, lo = np.cumsum(after), 0
            while lo < len(cell):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + LOOKED_UP, side="right")))
                own = after[lo:hi]
                i = np.repeat(np.arange(lo, hi), own)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
                lo = hi
                fits = (c[i] != c[j]) & ((within[i] > 0) | (part[i] != part[j])) & (n[j] * share[0] <= n[i] * share[1])
                i, j = i[fits], j[fits]
                fits = _possible(share, n[i], place[i], n[j], place[j])
                i, j = i[fits], j[fits]
                met = np.zeros(len(i), bool)
                for x in range(EARLY):
                    for y in range(EARLY):
                        met |= (early[x][i] == early[y][j]) & (x < known[i]) & (y < known[j])
                i, j = i[~met], j[~met]
                if len(i):
                    salt = _dealt(node[i], side[i]) * side[i] + _dealt(node[j], side[j])
                    yield pa.RecordBatch.from_pydict(_pairs(node[i], node[j], n[i], n[j], cell[i], salt))

    return run


def _overlaps(key: tuple[pa.Scalar, ...], pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Partial overlaps of pairs (a, b), all of one task and fragment; sets: their nodes and hashes."""
    hashes = sets["hashes"].combine_chunks()
    nodes, values, ends = sets["node"].to_numpy(), hashes.flatten().to_numpy(), hashes.value_lengths().to_numpy().cumsum()
    order = np.argsort(nodes)
    nodes, size, first = nodes[order], np.diff(np.concatenate([[0], ends]))[order], np.concatenate([[0], ends])[:-1][order]
    every, column = np.unique(values, return_inverse=True)
    a, b = (np.searchsorted(nodes, pairs[c].to_numpy()) for c in ("a", "b"))
    order = np.argsort(a, kind="stable")
    common, wide = np.zeros(len(a), np.int64), max(1, 4 * LOOKED_UP // max(1, len(every)))
    lo = 0
    while lo < len(a):  # some of the sets a at once, as rows of a table of all hashes, and pairs of bounded size
        hi = int(np.searchsorted(a[order], a[order[lo]] + wide))
        upto = np.cumsum(size[b[order[lo:hi]]])
        hi = max(lo + 1, min(hi, lo + int(np.searchsorted(upto, LOOKED_UP, side="right"))))
        here = order[lo:hi]
        lo = hi
        sets_, row = np.unique(a[here], return_inverse=True)
        has = np.zeros((len(sets_), len(every)), bool)
        for r, k in enumerate(sets_.tolist()):
            has[r, column[first[k] : first[k] + size[k]]] = True
        own = size[b[here]]
        at = np.arange(own.sum()) + np.repeat(first[b[here]] - np.cumsum(own) + own, own)
        common[here] = np.bincount(np.repeat(np.arange(len(here)), own), weights=has[np.repeat(row, own), column[at]], minlength=len(here))
    return pa.table({"a": pairs["a"], "b": pairs["b"], "common": pa.array(common)})


def _fragment(hash_: Column) -> Column:
    return F.shiftrightunsigned(hash_, 64 - FRAGMENTS.bit_length() + 1)


def _verified(sets: DataFrame, pairs: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of sets that are similar; pairs: written, each once; sets: what _ordered gives, with node."""
    total = pairs.agg(F.coalesce(F.sum(F.col("n_a") + F.col("n_b")), F.lit(0))).first()[0]
    task = F.pmod(F.xxhash64("label", "salt"), F.lit(1 + total * 8 // GROUP_BYTES))
    dealt = pairs.select("a", "b", task.alias("task"))
    # shingles that a set has alone are in no overlap
    shared = sets.select("node", F.transform("found", lambda x: x["hash"]).alias("hashes"))
    here = dealt.select(F.col("task").alias("task"), F.explode(F.array("a", "b")).alias("node")).distinct().join(shared, "node")
    fragments = F.transform(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)), lambda k: F.struct(k.alias("fragment"), F.filter("hashes", lambda x: _fragment(x) == k).alias("hashes")))
    parts = here.select("task", "node", F.inline(fragments))
    every = dealt.select("a", "b", "task", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    # fragments are counted apart, then summed
    partial = every.groupBy("task", "fragment").cogroup(parts.groupBy("task", "fragment")).applyInArrow(_overlaps, "a long, b long, common long")
    found = partial.groupBy("a", "b").agg(F.sum("common").alias("common")).join(pairs.select("a", "b", "n_a", "n_b"), ["a", "b"])
    return written(found.filter(F.col("common") * share[1] >= (F.col("n_a") + F.col("n_b") - F.col("common")) * share[0]).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node it is connected with), of every node of links (a, b): large and small stars in
    turn, until nothing changes. Every round is written, minima are pre-aggregated."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        closer = written(small.filter("u <> v").distinct(), "edges")
        released(edges, large)
        edges = closer
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state.n, state.s) == before:
            break
        before = (state.n, state.s)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select("component").distinct().select(F.col("component").alias("node"), "component"))


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair in one direction."""
    one = F.min(F.struct("label", "salt", "a", "b", "n_a", "n_b")).alias("one")
    return pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(one).select("one.*")


def jaccard_components(documents: DataFrame, width: int = 4, share: tuple[int, int] = (85, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id it is linked with by any chain).

    Texts link when their sets of width-word shingles (A-Z lower-cased, words parted by ASCII white space; fewer words
    make one shingle) have a Jaccard similarity of at least share. Null, empty and blank texts have no shingle and link
    with nothing; their component is their own id. A row without an id has its number of shingles, no component, and
    links with nothing. Repeated rows are kept, each with the same result; rows that share an id but not a text have the
    component of their own text. Extra columns aren't carried; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    info = written(docs.mapInArrow(_describe(width), "kind int, doc_id long, hi long, lo long, n long"), "sets")
    docs = docs.filter("doc_id is not null")
    own = info.filter("kind = 0").select("doc_id", "hi", "lo", "n")
    classes = own.filter("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay

    often = written(info.filter("kind = 1").groupBy("hi").agg(F.sum("n").alias("n")), "often")
    least, held = 0, 0
    for r in often.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("shingles")).orderBy(F.desc("n")).collect():  # at most 10000 rows
        if held + r.shingles > MAX_FREQUENT:
            least = r.n + 1
            break
        held += r.shingles
    listed = often.filter(F.col("n") >= least).orderBy("hi").toPandas()
    known = listed["hi"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    common = spark.sparkContext.broadcast((known[order], listed["n"].to_numpy(np.int64)[order]))

    rows = "hash long, set long, often long, size long"
    bound = min(1 << 32, int(REGION * (share[1] - share[0]) / share[1] * (1 << 32)))
    sets = _ordered(docs.select("text").mapInArrow(_offered(width, share, common, bound, False), rows), share, bound)
    first = _prefixes(sets.join(classes.select(F.col("hi").alias("set"), "node"), "set"))
    near = first.repartition("bucket").sortWithinPartitions("bucket", "n").mapInArrow(_fitting(share), "node long")
    # sets that half of the id doesn't tell apart stay too
    twins = classes.groupBy("hi").agg(F.collect_list("node").alias("nodes")).filter(F.size("nodes") > 1).select(F.explode("nodes").alias("node"))
    near = near.unionByName(twins).distinct()
    near = written(near.join(classes, "node").select("node", "hi", "lo", F.col("doc_id").alias("wanted")), "near")
    # the texts that are left, by all of their shingles
    near_ = F.broadcast(near) if near.count() * 40 <= MAX_BROADCAST else near
    texts = docs.join(near_, F.col("doc_id") == F.col("wanted")).select("text", "hi", "lo", "node")
    sets = _ordered(texts.mapInArrow(_offered(width, share, common, 1 << 32, True), rows), share, 1 << 32)
    sets = written(sets.withColumnRenamed("set", "node"), "ordered")
    columns = _PAIR + ", place int, parts int, kind int"
    met = _prefixes(sets).repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_buckets(share), columns)
    met = written(met, "buckets")
    stars = met.filter("kind = 0").select("a", "b", "n_a", "n_b", "label", "salt")
    # parts of one bucket, through their leaders
    leaders = met.filter("kind = 2").select(F.col("a").alias("bucket"), F.col("a").alias("hash"), F.col("b").alias("node"), F.col("n_b").alias("n"), "place", F.lit(1).alias("parts"), F.col("salt").alias("part"))
    between = leaders.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_buckets(share), columns)
    stars = written(_once(stars.unionByName(between.filter("kind = 0").select(*stars.columns))), "pairs")
    links = _verified(sets, stars, share)
    nodes = components(links)

    members = met.filter("kind = 1").select(F.col("a").alias("hash"), F.col("b").alias("node"), F.col("n_b").alias("n"), "place", "parts", F.col("salt").alias("part"))
    members = written(members.join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node")), "members")
    several = members.groupBy("hash").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("parts").alias("of")).filter("x <> y")
    several = several.select("hash", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("part"))
    # beside each set of such a bucket, the first of its shingles before that are of such buckets too
    held_in = F.sort_array(F.collect_list(F.struct("place", "hash", "parts", "part"))).alias("held_in")
    left = members.join(several, ["hash", "part"]).groupBy("node", "n", "component").agg(held_in)
    cells = left.select("node", "n", "component", F.transform(F.slice("held_in", 1, EARLY), lambda x: x["hash"]).alias("early"), F.posexplode("held_in").alias("at", "one"))
    cells = cells.select("node", "n", "component", "early", F.least("at", F.lit(EARLY)).alias("known"), "one.*").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.when(F.col("parts") == 1, F.col("hash")).otherwise(F.xxhash64("hash", F.least("part", "other"), F.greatest("part", "other")))
    within = (F.col("other") == F.col("part")).cast("int").alias("within")
    cells = cells.select(cell.alias("cell"), "node", "n", "place", "component", "part", within, "known", *[F.coalesce(F.get("early", F.lit(k)), F.lit(0)).alias(f"e{k}") for k in range(EARLY)])
    crossing = cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_crossing(share), _PAIR)
    tested = stars.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    crossing = _once(crossing).withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
    crossing = written(crossing.join(tested, ["x", "y"], "left_anti").drop("x", "y"), "crossing")
    if not crossing.isEmpty():
        more = _verified(sets, crossing, share)
        if not more.isEmpty():
            nodes = components(links.unionByName(more))
        released(more)
    released(often, near, sets, met, stars, links, members, crossing)

    # each set's smallest document, and the smallest of its component
    placed = classes.join(nodes, "node", "left").select("hi", "lo", "doc_id", F.coalesce("component", "node").alias("component"))
    first = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = placed.join(first, "component").select("hi", "lo", "component_id")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return own.join(placed, ["hi", "lo"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[p : p + least(len(w), 4) - 1], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
l as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 85 * (na.n + nb.n - k)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.b) as component_id
from d left join n on n.doc_id = d.doc_id join r on r.a = d.doc_id group by d.doc_id, n.n"""
