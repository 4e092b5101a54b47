"""Null and repeated ids, repeated rows, structured strings, hot groups; each result is the docstring's."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import decontamination, jaccard_join, line_dedup, pieces, pii, quality_classifier, quality_rules, secrets, substring_dedup, textvec, url_filter
from tests.llm import brute
from tests.llm.test_operators import WORDS, corpus, frame, rows

FAR = 9007199254740993  # no double


def thue_morse(k):
    s = "a"
    for _ in range(k):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("k", [9, 10, 11, 12])
def test_structured_strings_hash_apart(k):
    import numpy as np

    raw = np.frombuffer("".join(thue_morse(k)).encode(), np.uint8)
    h = textvec.span_hashes(raw, np.array([0, 1 << k]), np.array([1 << k, 2 << k]))
    assert h[0] != h[1]


def test_structured_strings(spark):
    import sentencepiece

    texts = [t for k in (10, 11, 12) for t in thue_morse(k)]
    docs = frame(spark, list(enumerate(texts)))
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path(pieces.MODEL))
    for r in pieces.encode_decode(docs, full=True).collect():
        assert r.ids == library.encode(texts[r.doc_id], add_eos=True) and r.decoded == texts[r.doc_id]
    assert rows(jaccard_join.jaccard_components(docs), "component_id") == {k: (k,) for k in range(6)}
    assert rows(substring_dedup.substring_dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.substrings(list(enumerate(texts)), 400)


def test_chunks_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa

    encoder = pieces.Encoder(pieces.model_path(pieces.MODEL), True)
    monkeypatch.setattr(textvec, "span_hashes", lambda body, start, end: np.zeros(len(start), np.uint64))
    texts = ["one two three", "two one", "", "three four"]
    for lo, hi, index, first in encoder.chunk_index(pa.array(texts)):
        for row in range(lo, hi):
            got = b"".join(encoder.surface[i] for i in index[first[row - lo] : first[row - lo + 1]])
            assert got == (" " + texts[row]).encode()


LINE = "a line that several documents hold"
TEXT = " ".join(f"word{k}" for k in range(120))
ODD = [(None, TEXT + "\n" + LINE), (None, None), (5, TEXT + "\n" + LINE), (5, TEXT + "\n" + LINE), (7, LINE + "\nsomething else entirely"), (7, "x " * 300), (FAR, TEXT + " more\n" + LINE), (9, "")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"row": F.lit(1), "node": F.lit(2), "set": F.lit("x"), "n_chars": F.lit(3)})


def in_order(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_ids_of_jaccard(spark):
    got = in_order(jaccard_join.jaccard_components(odd(spark)), "doc_id", "component_id")
    assert got == sorted([(None, None), (None, None), (5, 5), (5, 5), (7, 7), (7, 7), (FAR, 5), (9, 9)], key=str)


def test_ids_of_substrings(spark):
    want = brute.substrings(list(enumerate(t for _, t in ODD)), 400)
    got = in_order(substring_dedup.substring_dedup(odd(spark)), "doc_id", "n_bytes", "n_removed", "kept_sha256", "has_repeats")
    assert got == sorted([(i, want[k][0], want[k][1], want[k][3], want[k][1] > 0) for k, (i, _) in enumerate(ODD)], key=str)


def test_ids_of_lines(spark):
    got = in_order(line_dedup.line_dedup(odd(spark)), "doc_id", "n_lines", "n_dropped")
    # 5 holds both lines first; 7 and FAR drop the shared line; rows without an id keep theirs
    assert got == sorted([(None, 2, 0), (None, 1, 0), (5, 2, 0), (5, 2, 0), (7, 2, 1), (7, 1, 0), (FAR, 2, 1), (9, 1, 0)], key=str)


def test_ids_of_items(spark):
    items = spark.createDataFrame([(1, TEXT), (1, TEXT), (None, TEXT)], "item_id long, text string")
    assert in_order(decontamination.contained_items(odd(spark), items), "doc_id", "item_id") == sorted([(5, 1), (FAR, 1)], key=str)


def test_ids_of_the_others(spark):
    docs, n = odd(spark), len(ODD)
    labels = spark.createDataFrame([(5, 1), (FAR, 0), (None, 1)], "doc_id long, quality int")
    assert quality_classifier.quality_classifier(docs, labels).filter("kept").count() == n
    assert in_order(pieces.encode_decode(docs), "doc_id") == sorted([(i,) for i, _ in ODD], key=str)
    assert secrets.secret_scan(docs).count() == pii.pseudonymise(docs, "k").count() == n
    assert quality_rules.quality_rules(docs.withColumn("lang", F.lit("en"))).count() == n
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/x").alias("url"))
    assert url_filter.url_filter(pages).count() == n


def test_stages_on_odd_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = odd(spark).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "kept": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, sf)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == table.columns, name
            assert out.count() <= table.count(), name


@pytest.mark.parametrize("bucket", [20_000, 2])
def test_large_groups_of_near_copies(spark, monkeypatch, bucket):
    """Groups whose members link with some of the others alone, in buckets of one part and of several."""
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    rng = random.Random(11)
    docs = []
    for g in range(3):
        base = [rng.choice(WORDS) for _ in range(90)]
        for k in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            docs.append((100 * g + k, " ".join(w)))
    docs += [(1000 + i, t) for i, t in corpus(5)]
    for width, share in ((4, (85, 100)), (5, (4, 5))):
        got = rows(jaccard_join.jaccard_components(frame(spark, docs), width, share), "n_shingles", "component_id")
        assert got == brute.jaccard_components(docs, width, share)


def test_repeats_about_the_length(spark):
    """Passages of just under and over the length, with and without words around, one of them very common."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [text(n) for n in (398, 399, 400, 401, 640)]
    hot = text(450)
    docs = []
    for k in range(120):
        parts = [text(rng.randint(0, 300)), hot if k % 2 else passages[k % 5], text(rng.randint(0, 300))]
        docs.append((k, "".join(parts)))
    docs += [(500, hot), (501, hot), (502, passages[0]), (503, text(399)), (504, text(401))]
    want = brute.substrings(docs, 400)
    for hot_runs in (1000, 10):
        kept, substring_dedup.HOT = substring_dedup.HOT, hot_runs
        got = rows(substring_dedup.substring_dedup(frame(spark, docs)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
        substring_dedup.HOT = kept
        assert got == want


def test_phones_stay_valid(spark):
    import re

    docs = [(k, f"call +1 ({a}) {e}-{n:04d} or {a}.{e}.{n:04d}") for k, (a, e, n) in enumerate([(200, 999, 0), (912, 210, 9999), (310, 555, 1234), (312, 455, 17), (999, 200, 1)])]
    docs += [(9, "411-555-1234 123-555-1234 555-911-1234")]
    out = {r.doc_id: r for r in pii.pseudonymise(frame(spark, docs), "k").collect()}
    assert out[9].text == docs[-1][1] and out[9].n_phone == 0
    for k, t in docs[:-1]:
        one, two = re.fullmatch(r"call \+1 \((\d{3}\) \d{3}-\d{4}) or (\d{3}\.\d{3}\.\d{4})", out[k].text).groups()
        assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) and out[k].n_phone == 2 and out[k].text != t
        assert all(code[0] in "23456789" and code[1:] != "11" for code in (two[:3], two[4:7]))
    assert len({r.text for r in out.values()}) == len(docs)


def test_phone_codes_are_permuted(spark):
    area = [a for a in range(200, 1000) if a % 100 != 11]
    docs = frame(spark, [(a, f"{a}-{b}-0000") for a in area[::7] for b in (200, 310, 312, 999)])
    out = [r.text for r in pii.pseudonymise(docs, "k").select("text").collect()]
    assert len(set(out)) == len(out) == 4 * len(area[::7])


def test_beyond_the_broadcast_bounds(spark, monkeypatch):
    """The same results where nothing is small enough to be broadcast by count."""
    for module in (jaccard_join, substring_dedup, decontamination, line_dedup):
        monkeypatch.setattr(module, "MAX_BROADCAST", -1)
    docs = corpus(17)
    assert rows(jaccard_join.jaccard_components(frame(spark, docs)), "n_shingles", "component_id") == brute.jaccard_components(docs, 4, (85, 100))
    assert rows(substring_dedup.substring_dedup(frame(spark, docs), length=100, gram=16), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.substrings(docs, 100)
    assert rows(line_dedup.line_dedup(frame(spark, docs)), "n_lines", "n_dropped", "kept_sha256") == brute.lines(docs)
    items = [(0, " ".join(brute.words(docs[60][1])[10:40])), (1, "two words"), (2, " ".join(brute.words(docs[73][1])[1000:1050]))]
    found = decontamination.contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.n_item, r.n_common) for r in found.collect()} == brute.contained(docs, items)


def test_very_long_texts(spark):
    """One text of two million characters beside short ones."""
    rng = random.Random(2)
    long = " ".join(rng.choice(WORDS) for _ in range(400_000))
    docs = [(1, long), (2, long[:-7]), (3, long[5000:9000]), (4, "short")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jaccard_join.jaccard_components(df), "component_id") == {1: (1,), 2: (1,), 3: (3,), 4: (4,)}
    got = rows(substring_dedup.substring_dedup(df), "n_bytes", "n_removed")
    assert got[1][1] >= len(long) - 7 and got[2] == (len(long) - 7, len(long) - 7) and got[3] == (4000, 4000)
    assert rows(line_dedup.line_dedup(df), "n_lines", "n_dropped") == {1: (1, 0), 2: (1, 0), 3: (1, 0), 4: (1, 0)}
    item = " ".join(long.split(" ")[300_000:300_040])
    assert {r.doc_id for r in decontamination.contained_items(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()} == {1, 2}
    assert rows(pieces.encode_decode(df, check=False), "n_tokens")[1][0] > 400_000
    assert rows(secrets.secret_scan(df.union(spark.createDataFrame([(5, long + " token=abcdefghijklmnop")], df.schema))), "n_assign")[5] == (1,)
    assert rows(pii.pseudonymise(df, "k"), "n_found")[1] == (0,)
    assert quality_rules.quality_rules(df.withColumn("lang", F.lit("en"))).count() == 4
    assert quality_classifier.quality_classifier(df, spark.createDataFrame([], "doc_id long, quality int")).filter("kept").count() == 4
    pages = spark.createDataFrame([(1, "http://a.org/" + "x" * 100_000), (2, "http://" + "a." * 500 + "org/es/")], "page_id long, url string")
    assert rows(url_filter.url_filter(pages).withColumnRenamed("page_id", "doc_id"), "verdict") == {1: ("allow",), 2: ("allow",)}
