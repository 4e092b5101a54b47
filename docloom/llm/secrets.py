"""Secret scan with multipart credential linking.

Base secrets are reported wherever they stand: assignments of long values, access identifiers, long hexadecimal runs.
Weak parts (user names, short secrets, oddly named ones of any length, endpoints) are ordinary text by themselves. They
are reported only where complementary parts co-occur in a scope of SCOPE code points: an identifier beside a secret, a
secret beside an identifier, an endpoint beside both. The interval join of the parts of a document is done by two ordered
windows, which give each part the nearest part of each role before and after it; no pairs are made, however many parts a
text has.

A pattern's places follow from the lengths of what lies between its matches and of the matches themselves. Only texts
that hold a pattern's necessary characters are searched for it, and only found parts are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import table

SCOPE = 200


def _any_case(words: str) -> str:
    """Letters in either case, ASCII only, in a form that both engines read alike."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""
#: Keys under which long values are base secrets; PARTS' most length holds under these only.
_BASE_KEYS = _any_case("password|passwd|secret|token|api_?key")
#: (kind, role, pattern, group whose length counts, least length, most length); base kinds first, in the contract's order.
PARTS = (
    ("assign", "secret", f"({_any_case('password|passwd|secret|token|api_?key')}){_ASSIGNED}([A-Za-z0-9+/_.=-]+)", 2, 12, None),
    ("access", "id", "AKIA[A-Z0-9]+", 0, 18, None),
    ("hex", "secret", "[0-9a-f]+", 0, 16, None),
    ("user", "id", f"({_any_case('username|user|login|account|client_?id|access_?key_?id')}){_ASSIGNED}([A-Za-z0-9@._-]+)", 2, 3, None),
    ("weak", "secret", f"({_any_case('password|passwd|secret|token|api_?key|passphrase|pwd|pass')}){_ASSIGNED}([A-Za-z0-9+/_.=-]+)", 2, 4, 11),
    ("endpoint", "endpoint", f"({_any_case('https?|ftp|ssh|jdbc|postgres|mysql|redis|mongodb|amqp')})://([^\\x20\\x09-\\x0D\"'<>]+)", 2, 4, None),
)
BASE = 3
#: What a text must contain to be searched (any of them).
_NEEDS = {"assign": ("=", ":"), "access": ("AKIA",), "hex": (), "user": ("=", ":"), "weak": ("=", ":"), "endpoint": ("://",)}


def _found(text: Column, k: int) -> Column:
    """array<struct<kind, i, gap, len, size, bound>>: all matches, failing ones too, with what lies before each; bound tells
    whether the most length holds."""
    kind, _, pattern, group, least, most = PARTS[k]
    may = F.lit(False)
    for s in _NEEDS[kind]:
        may = may | (F.instr(text, s) > 0)
    if not _NEEDS[kind]:
        pattern = f"[0-9a-f]{{{least},}}"  # runs are maximal, so the short ones needn't be matched
        may = text.rlike(pattern)
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
    rows = F.transform(
        F.arrays_zip(match.alias("m"), sized.alias("v"), F.split(text, pattern, -1).alias("p")),
        lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["v"]).alias("size"),
            (F.lit(False) if most is None else x["m"].rlike(f"^({_BASE_KEYS})")).alias("bound")),
    )
    rows = F.filter(rows, lambda x: x["len"].isNotNull())  # after the last match there is one more piece
    return F.when(may, rows)


def _with_row(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (null: empty), row: ids needn't tell texts apart."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.withColumn("row", F.xxhash64("text"))


def secret_parts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (hash of the text), kind (place in PARTS), start, end (code points, end exclusive), linked: one row for
    each part of each distinct text of an id."""
    docs = _with_row(documents, id_col, text_col)
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,size:int,bound:boolean>>")
    every = F.concat(*[F.coalesce(_found(F.col("text"), k), empty) for k in range(len(PARTS))])
    rows = docs.select("doc_id", "row", F.explode(every).alias("x")).select("doc_id", "row", "x.*").distinct()
    upto = W.partitionBy("doc_id", "row", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.col("end") - F.col("len"))
    role, passes = F.lit(None).cast("string"), F.lit(False)
    for k, (_, r, _, _, least, most) in enumerate(PARTS):
        role = F.when(F.col("kind") == k, r).otherwise(role)
        passes = F.when(F.col("kind") == k, (F.col("size") >= least) & (~F.col("bound") | (F.col("size") <= (most or 0)))).otherwise(passes)
    rows = rows.filter(passes).withColumn("role", role)
    before = W.partitionBy("doc_id", "row").orderBy("start", "end", "kind").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("doc_id", "row").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    for r in ("id", "secret"):
        own = F.col("role") == r
        rows = rows.withColumn(f"{r}_before", F.max(F.when(own, F.col("end"))).over(before))
    for r in ("id", "secret"):
        own = F.col("role") == r
        rows = rows.withColumn(f"{r}_after", F.min(F.when(own, F.col("start"))).over(after))
    near = {r: F.coalesce(F.col("start") - F.col(f"{r}_before") <= SCOPE, F.lit(False)) | F.coalesce(F.col(f"{r}_after") - F.col("end") <= SCOPE, F.lit(False)) for r in ("id", "secret")}
    linked = F.when(F.col("role") == "id", near["secret"]).when(F.col("role") == "secret", near["id"]).otherwise(near["id"] & near["secret"])
    return rows.select("doc_id", "row", "kind", "start", "end", linked.alias("linked"))


def secret_scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    spans has the base spans and the linked weak ones as kind:start:end, by start and then kind. Null texts are empty
    and have no spans. Each row is a text of its own: ids may repeat or be null, and repeated rows are scanned alike.
    Extra columns aren't carried; an empty table gives an empty result.
    """
    parts = secret_parts(documents, id_col, text_col).filter((F.col("kind") < BASE) | F.col("linked"))
    names = F.array(*[F.lit(p[0]) for p in PARTS])
    text = F.concat_ws(":", F.get(names, F.col("kind")), F.col("start").cast("string"), F.col("end").cast("string"))
    parts = parts.withColumn("span", F.struct("start", "kind", text.alias("text")))
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{PARTS[k][0]}")
    by_doc = parts.groupBy(F.col("doc_id").alias("of"), F.col("row").alias("of_row")).agg(*[count(k) for k in range(BASE)], F.count(F.when(F.col("kind") >= BASE, 1)).alias("n_linked"), F.array_sort(F.collect_list("span")).alias("all"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), ",")
    by_doc = by_doc.withColumn("spans", joined(F.col("all"))).withColumn("base", joined(F.filter("all", lambda x: x["kind"] < BASE)))
    ids = _with_row(documents, id_col, text_col).select("doc_id", "row")
    out = ids.join(by_doc, ids["doc_id"].eqNullSafe(by_doc["of"]) & (ids["row"] == by_doc["of_row"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_linked"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    found = " union all ".join(
        f"""select doc_id, {k} as kind, i, length(p[i]) as gap, length(m[i]) as len, length(v[i]) as size,
          {least} as least, {most if most is not None else 1000000000} as most, '{role}' as role
        from (select doc_id, m, v, p, unnest(range(1, len(m) + 1)) as i from (
          select doc_id, regexp_extract_all(t, {quoted(pattern)}, 0) as m, regexp_extract_all(t, {quoted(pattern)}, {group}) as v,
            string_split_regex(t, {quoted(pattern)}) as p from d))"""
        for k, (_, role, pattern, group, least, most) in enumerate(PARTS)
    )
    names = "case kind " + " ".join(f"when {k} then '{p[0]}'" for k, p in enumerate(PARTS)) + " end"
    near = {
        r: f"(coalesce(start - {r}_before <= {SCOPE}, false) or coalesce({r}_after - stop <= {SCOPE}, false))" for r in ("id", "secret")
    }
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({found}),
s as (select *, sum(gap + len) over (partition by doc_id, kind order by i) as stop from f),
g as (select doc_id, kind, role, stop - len as start, stop from s where size >= least and size <= most),
n as (
  select *,
    max(case when role = 'id' then stop end) over b as id_before, max(case when role = 'secret' then stop end) over b as secret_before,
    min(case when role = 'id' then start end) over a as id_after, min(case when role = 'secret' then start end) over a as secret_after
  from g window b as (partition by doc_id order by start, stop, kind rows between unbounded preceding and 1 preceding),
    a as (partition by doc_id order by start, stop, kind rows between 1 following and unbounded following)),
r as (
  select doc_id, kind, start, {names} || ':' || cast(start as bigint) || ':' || cast(stop as bigint) as txt from n
  where kind < {BASE} or case role when 'id' then {near["secret"]} when 'secret' then {near["id"]} else {near["id"]} and {near["secret"]} end),
a as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    count(*) filter (kind >= {BASE}) as n_linked,
    string_agg(txt, ',' order by start, kind) as spans, string_agg(txt, ',' order by start, kind) filter (kind < {BASE}) as base
  from r group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_linked, 0) as n_linked
from d left join a on d.doc_id = a.doc_id"""


ORACLE = _oracle()
