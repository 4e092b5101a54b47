"""Quality rules: counts a text must pass, then the divergence of its histograms from those of its language.

Each document gets two histograms: of character classes (lower-case and other letters, capitals, digits, white space,
symbols, bytes beyond ASCII) and of its language's commonest function words (and all other words). The reference of a
language is the mean histogram of all its documents that pass the base rules. A document is kept if the Jensen-Shannon
distance (base 2, so from 0 to 1) of each histogram to its language's reference is small; a histogram only counts from
a minimum length on. DataFrame expressions only; one scan of the texts, whose counts are written once and read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import WS, table, written

#: Frequent function words by language.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "las", "un"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une"),
}
MIN_CHARS = 200
MIN_WORDS = 100
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.28
SYMBOLS = "[#*$%&|<>]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def _repeated(windows: str) -> Column:
    """Words in 3-word windows found twice or more: windows in order have equal neighbours, their places are merged.
    windows names a column of (window, place) in order."""
    near = lambda k: F.get(F.col(windows), k)["g"]
    twice = F.filter(windows, lambda x, k: F.coalesce(near(k - 1) == x["g"], F.lit(False)) | F.coalesce(near(k + 1) == x["g"], F.lit(False)))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    merged = F.aggregate(places, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")))
    return merged["n"].cast("long")


def features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The base counts and both histograms of every document (null text: no words; null language: one of its own)."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"))
    docs = docs.withColumn("words", _words(F.col("text")))
    at = lambda i: F.get(F.col("words"), i)
    docs = docs.withColumn("n", F.size("words"))
    grams = F.when(F.col("n") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{WS}]"))
    common = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    docs = docs.select(
        "doc_id", "lang", "n",
        grams.alias("grams"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length("text").alias("chars"),
        F.octet_length("text").alias("bytes"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("capitals"),
        F.regexp_count("text", F.lit("[0-9]")).alias("digits"),
        lines.alias("lines"),
        F.filter("words", lambda w: w.isin(common)).alias("common"),
    )
    # only texts with some window twice have anything to sort
    windows = F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    docs = docs.withColumn("windows", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), windows))
    repeated = F.coalesce(_repeated("windows"), F.lit(0).cast("long"))
    count = lambda w: F.size(F.filter("common", lambda x: x == w))
    by_lang = F.array(F.col("n"))
    for lang, words in COMMON_WORDS.items():
        own = F.array(*[count(w) for w in words])
        by_lang = F.when(F.col("lang") == lang, own).otherwise(by_lang)
    space = F.col("chars") - F.col("word_chars")
    far = F.col("bytes") - F.col("chars")
    letters = F.greatest(F.lit(0), F.col("word_chars") - F.col("n_symbols") - F.col("capitals") - F.col("digits"))
    return docs.select(
        "doc_id", "lang",
        F.col("n").cast("long").alias("n_words"),
        "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        "chars",
        F.transform(F.array(letters, F.col("capitals"), F.col("digits"), space, F.col("n_symbols"), far), lambda x: x.cast("double")).alias("classes"),
        F.transform(by_lang, lambda x: x.cast("double")).alias("common"),
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two share arrays of equal length; null if one is null."""
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def quality_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, word_distance.

    base_failed: under 50 words, or more than half of the words in repeated 3-word windows. kept is false for those; the
    others are kept unless a distance whose guard (MIN_CHARS characters, MIN_WORDS words) is met exceeds its limit. A
    language without any passing document, or without a word list, has no such limit. Null and empty texts fail;
    repeated rows are judged alike; extra columns aren't carried; an empty table gives an empty result.
    """
    f = written(features(documents, id_col, text_col, lang_col), "quality")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    f = f.withColumn("base_failed", failed)
    rest = lambda c: F.greatest(F.lit(0.0), F.col("n_words") - F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    f = f.withColumn("p", _shares(F.col("classes")))
    f = f.withColumn("w", F.when(F.col("lang").isin(sorted(COMMON_WORDS)), _shares(F.concat(F.col("common"), F.array(rest(F.col("common")))))))
    width = {"p": 6, "w": len(COMMON_WORDS["en"]) + 1}
    # one row a language
    means = [F.avg(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in width.items() for i in range(n)]
    ref = f.filter(~F.col("base_failed")).groupBy(F.col("lang").alias("ref_lang")).agg(*means)
    ref = ref.select("ref_lang", *[F.array(*[F.col(f"{c}{i}") for i in range(n)]).alias(f"ref_{c}") for c, n in width.items()])
    f = f.join(ref, f["lang"] == ref["ref_lang"], "left")
    f = f.withColumn("class_distance", js_distance(F.col("p"), F.col("ref_p")))
    f = f.withColumn("word_distance", F.when(F.forall("ref_w", lambda x: x.isNotNull()), js_distance(F.col("w"), F.col("ref_w"))))
    far = lambda c, guard, limit: F.coalesce(guard & (F.col(c) > limit), F.lit(False))
    odd = far("class_distance", F.col("chars") >= MIN_CHARS, MAX_CLASS_DISTANCE) | far("word_distance", F.col("n_words") >= MIN_WORDS, MAX_WORD_DISTANCE)
    return f.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"), "class_distance", "word_distance")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def _oracle() -> str:
    def shares(column: str) -> str:
        return f"list_transform({column}, lambda x: case when list_sum({column}) > 0 then x / list_sum({column}) else 0 end)"

    def distance(p: str, q: str) -> str:
        part = "(case when {0} > 0 then {0} * log2({0} / ((z[1] + z[2]) / 2)) else 0 end)"
        return f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {part.format('z[1]')} + {part.format('z[2]')})) / 2))"

    common = " ".join(
        f"when lang = '{lang}' then [" + ", ".join(f"cast(len(list_filter(w, lambda x: x = '{word}')) as double)" for word in words) + "]"
        for lang, words in COMMON_WORDS.items()
    )
    n = len(COMMON_WORDS["en"]) + 1
    mean = lambda c, k: "[" + ", ".join(f"avg({c}[{i}])" for i in range(1, k + 1)) + "]"
    return f"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as lang from documents),
a as (select *, list_filter(string_split_regex(t, '[{WS}]+'), lambda x: x <> '') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{WS}]')) as lines from d),
g as (select doc_id, p, w[p : p + 2] as gram from (select doc_id, w, unnest(range(1, len(w) - 1)) as p from a where len(w) > 2)),
h as (select doc_id, p, count(*) over (partition by doc_id, gram) as n from g),
r as (select doc_id, count(distinct q) as n_repeat_words from (select doc_id, unnest([p, p + 1, p + 2]) as q from h where n > 1) group by doc_id),
f as (
  select a.doc_id, lang, len(w) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, len(regexp_extract_all(t, '{SYMBOLS}')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, length(t) as chars,
    strlen(t) - length(t) as far, len(regexp_extract_all(t, '[A-Z]')) as capitals, len(regexp_extract_all(t, '[0-9]')) as digits,
    case {common} end as own
  from a left join r on a.doc_id = r.doc_id),
e as (
  select *, n_words < 50 or n_repeat_words * 100 > n_words * 50 as base_failed,
    [cast(greatest(0, word_chars - n_symbols - capitals - digits) as double), capitals, digits, chars - word_chars, n_symbols, far] as classes,
    list_append(own, greatest(0, n_words - list_sum(own))) as counts from f),
s as (select *, {shares("classes")} as p, case when own is not null then {shares("counts")} end as q from e),
m as (select lang, {mean("p", 6)} as ref_p, {mean("q", n)} as ref_q from s where not base_failed group by lang),
j as (
  select s.*, {distance("p", "ref_p")} as class_distance, case when q is not null then {distance("q", "ref_q")} end as word_distance, ref_p is not null as has
  from s left join m on s.lang = m.lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (has and ((chars >= {MIN_CHARS} and class_distance > {MAX_CLASS_DISTANCE})
    or coalesce(n_words >= {MIN_WORDS} and word_distance > {MAX_WORD_DISTANCE}, false))) as kept
from j"""


ORACLE = _oracle()
