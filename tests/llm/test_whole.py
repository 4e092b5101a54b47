"""Whole results where an operator once left something out."""

import pytest

from docloom.llm import pii, secrets


@pytest.mark.parametrize("key", ["pwd", "pass", "Passphrase"])
def test_long_oddly_named_secret_is_linked(spark, key):
    weak = f"{key}=S3cretLongValue99"
    text = f"user=admin {weak} https://db.example/x"
    docs = [(1, text), (2, weak), (3, "user=admin token=S3cretLongValue99")]
    got = {r.doc_id: r for r in secrets.secret_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    end = 11 + len(weak)
    assert got[1].spans == f"user:0:10,weak:11:{end},endpoint:{end + 1}:{len(text)}" and got[1].n_linked == 3
    assert got[2].spans == ""
    assert got[3].spans == "user:0:10,assign:11:34"  # no second, weak span under a base key


def test_cards_beside_other_digits(spark):
    card, amex = "4111 1111 1111 1111", "378282246310005"
    texts = [
        card, f"card {card} 12/25", "4111111111111111 123", f"123 {card} 12/25", f"1234 5678 {card}", f"12 345 4111111111111111 99 {amex}-7 x",
        f"{card} 2020-01-31", f"{card} {card}", "1 2 3 4 5 6 7 8 9 0 1 2 3", "4111-1111-1111-1112 2",
    ]
    got = [r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    new = got[0].text
    assert new != card and [len(x) for x in new.split(" ")] == [4, 4, 4, 4]
    solid = new.replace(" ", "")
    assert got[1].text == f"card {new} 12/25" and got[2].text == f"{solid} 123"
    assert got[3].text == f"123 {new} 12/25" and got[4].text == f"1234 5678 {new}"
    assert got[5].text.startswith(f"12 345 {solid} 99 ") and got[5].text.endswith("-7 x") and amex not in got[5].text
    assert got[6].text.startswith(new + " ") and (got[6].n_card, got[6].n_date) == (1, 1)
    assert got[7].text == f"{new} {new}"
    assert got[8].text == texts[8] and got[9].text == texts[9]
    assert [r.n_card for r in got] == [1, 1, 1, 1, 1, 2, 1, 2, 0, 0]


def test_long_digit_runs(spark):
    texts = ["1 " * 5000, "7" * 20000, "12-" * 5000]
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    assert all(len(r.text) == len(texts[r.doc_id]) for r in got)
