"""URL filter by a cascade of Bloom filters.

The listed keys are encoded at level 1. Over the complete key universe of the corpus (every key any of its URLs could
be looked up by), level 2 encodes the keys that level 1 holds wrongly, level 3 the listed keys that level 2 holds
wrongly, and so on until a level holds no key wrongly. A key of that universe is listed if the first level that
doesn't hold it is an even one, so membership is exact and no URL row is joined with any list.

A filter is a bigint array of at most MAX_BITS bits. Level 1 is sized by the list; every later level only holds wrong
positives of the level before, which a cascade shrinks geometrically. A list of over PART_KEYS keys, given as a
DataFrame, is cut into parts by hash, each with a cascade of its own over its part of the universe. The filters are
literals in the plan, about 10 bits a listed key and as many a wrong one. All of it is DataFrame expressions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, table, written

#: Keys of one cascade.
PART_KEYS = 1_000_000
#: Listed keys up to which the universe is marked by a literal list.
FEW_KEYS = 1000
MAX_BITS = 1 << 25
HASHES = 4
BITS_PER_KEY = 10

#: The rules (action, host, path) of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Hosts that are blocked, with their subdomains, where no rule fits.
BLOCKED_HOSTS = (
    "ads-track.example.com", "ads-track.example.net", "ads-track.example.org",
    "adult-x.example.com", "adult-x.example.net", "adult-x.example.org",
    "casino-win.example.com", "casino-win.example.net", "casino-win.example.org",
    "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org",
    "free-bets.example.com", "free-bets.example.net", "free-bets.example.org",
    "spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org",
)


@dataclass(frozen=True)
class Level:
    depth: int  # each level hashes in its own way, or wrong keys would stay wrong
    bits: int
    words: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        """True for every encoded key and for a few others."""
        field = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")  # folded to one literal
        test = F.lit(True)
        for i in range(HASHES):
            at = F.pmod(F.xxhash64(F.lit(self.depth * HASHES + i), key), F.lit(self.bits))
            test = test & (F.call_function("shiftright", F.get(field, (at / 64).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return test


def _encoded(keys: DataFrame, n: int, depth: int) -> Level:
    bits = min(MAX_BITS, 64 * -(-max(64, n * BITS_PER_KEY) // 64))
    spots = keys.select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(depth * HASHES + i), "key"), F.lit(bits)) for i in range(HASHES)])).alias("at"))
    found = spots.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))).alias("v")).collect()
    words = [0] * (bits // 64)
    for r in found:  # at most bits / 64 rows
        words[r.word] = r.v
    return Level(depth, bits, tuple(words))


class Cascade:
    """Exact membership in a list for all keys of a universe."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: list[str] | DataFrame, universe: DataFrame, max_levels: int = 64) -> Cascade:
        """universe: column key, distinct, with every key that will be asked for; null keys are in no list. listed: the
        keys, or a DataFrame of them (column key, distinct, not null)."""
        universe = universe.filter("key is not null")
        if isinstance(listed, DataFrame):
            keys, n = listed, listed.count()
            universe = universe.join(keys.withColumn("listed", F.lit(True)), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
        else:
            values = sorted(set(listed))
            keys, n = universe.sparkSession.createDataFrame([(k,) for k in values], "key string"), len(values)
            universe = universe.withColumn("listed", F.col("key").isin(values))
        # only listed keys that occur in the universe matter; the others are encoded at level 1 all the same
        levels = [_encoded(keys, max(1, n), 0)]
        wrong = universe.filter(~F.col("listed") & levels[0].holds(F.col("key")))
        against = universe.filter("listed")
        for _ in range(max_levels):
            n = wrong.count()
            if not n:
                return cls(levels)
            levels.append(_encoded(wrong, n, len(levels)))
            # next: keys of the other side that this level holds wrongly
            wrong, against = against.filter(levels[-1].holds(F.col("key"))), wrong
        raise ValueError("the cascade doesn't end; give more bits a key")

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe; null: false."""
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            out = F.when(~self.levels[depth - 1].holds(key), F.lit(depth % 2 == 0)).otherwise(out)
        return F.coalesce(out, F.lit(False)) & key.isNotNull()


class Cascades:
    """Exact membership in a list of any length: a cascade for each part of its keys, by hash."""

    def __init__(self, parts: list[Cascade]):
        self.parts = parts

    @staticmethod
    def _part(key: Column, parts: int) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))

    @classmethod
    def build(cls, listed: list[str] | tuple[str, ...] | DataFrame, universe: DataFrame) -> Cascades:
        if not isinstance(listed, DataFrame):
            if len(set(listed)) <= FEW_KEYS:
                return cls([Cascade.build(list(listed), universe)])
            listed = universe.sparkSession.createDataFrame([(k,) for k in set(listed)], "key string")
        keys = written(listed.select("key").filter("key is not null").distinct(), "listed")
        n = max(1, -(-keys.count() // PART_KEYS))
        own = lambda df, p: df.filter(cls._part(F.col("key"), n) == p)
        return cls([Cascade.build(own(keys, p), own(universe, p)) for p in range(n)])

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe; null: false."""
        out = F.lit(False)
        for p, cascade in enumerate(self.parts):
            out = F.when(self._part(key, len(self.parts)) == p, cascade.contains(key)).otherwise(out) if len(self.parts) > 1 else cascade.contains(key)
        return F.coalesce(out, F.lit(False))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for URLs without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def suffixes(host: Column) -> Column:
    """The host and all its parent domains, longest first; empty for an empty host."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    )


def url_filter(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    blocked_hosts: tuple[str, ...] | DataFrame = BLOCKED_HOSTS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict. blocked_hosts: host names, or a DataFrame of them (key).

    The longest rule whose host is the URL's host or a parent of it, and whose path starts the URL's path, decides;
    of equally long ones the first in string order. Where none fits, the verdict is block for listed hosts and their
    subdomains, else allow. Null or odd URLs have an empty host and path, no rule and verdict allow; repeated rows stay;
    other columns of the input, whatever their names, aren't carried. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    base = base.withColumn("above", suffixes(F.col("host")))
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)
    # a rule's key: its host and its path; a URL is looked up by each parent domain with each path head of a rule's length
    heads = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull())
    asked = F.flatten(F.transform(F.col("above"), lambda h: F.transform(F.col("heads"), lambda p: F.concat(h, p))))
    base = base.withColumn("heads", heads).withColumn("asked", asked)
    universe = written(base.select(F.explode("asked").alias("key")).distinct(), "url-keys")
    hosts = written(base.select(F.explode("above").alias("key")).distinct(), "url-hosts")
    in_rules = Cascades.build([h + p for _, h, p in rules], universe)
    in_blocks = Cascades.build([h + p for a, h, p in rules if a == "block"], universe)
    in_hosts = Cascades.build(blocked_hosts, hosts)
    fits = F.filter(F.col("asked"), lambda k: in_rules.contains(k))
    best = F.array_sort(F.transform(fits, lambda k: F.struct((-F.length(k)).alias("l"), k.alias("k"))))
    base = base.withColumn("rule", F.get(best, F.lit(0))["k"])
    listed = F.exists(F.col("above"), lambda h: in_hosts.contains(h))
    verdict = F.when(F.col("rule").isNotNull(), F.when(in_blocks.contains(F.col("rule")), "block").otherwise("allow")).when(listed, "block").otherwise("allow")
    return base.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    blocked = " or ".join(f"host = '{h}' or host like '%.{h}'" for h in BLOCKED_HOSTS)
    return f"""
with r(action, h, p) as (values {rules}),
u as (
  select page_id, case when url is not null and instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
c as (
  select b.page_id, b.host, b.path, r.h || r.p as rule, r.action,
    row_number() over (partition by b.page_id order by length(r.h || r.p) desc nulls last, r.h || r.p) as n
  from b left join r on (b.host = r.h or ends_with(b.host, '.' || r.h)) and starts_with(b.path, r.p))
select page_id, host, path, rule, coalesce(action, case when {blocked} then 'block' else 'allow' end) as verdict from c where n = 1"""


ORACLE = _oracle()
