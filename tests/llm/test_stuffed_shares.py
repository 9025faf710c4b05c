"""Capitals, prices and odd lines in a stuffed page do not hide it."""

import pytest

from mesoflow.llm import stuffing

ODD = {
    "one long line with a capital": "cheap Zorbo " + "best zorbo buy zorbo online zorbo sale " * 40,
    "capitals and prices in lists": "\n".join("Cheap Zorbo, men's zorbo, 50% off, best zorbo price $9, buy Zorbo now" for _ in range(12)),
    "named links": "\n".join(f"Cheap Zorbo https://a{i}.example/x" for i in range(30)),
    "tags with an apostrophe": "\n".join("#Zorbo #cheap_zorbo #men's #buyzorbo #zorbosale" for _ in range(8)),
}
PLAIN = {
    "capitalised text": "\n\n".join(["The reader takes one file, and the writer makes another. Nothing else is changed, moved, or lost on Monday."] * 20),
    "calls": "\n".join("draw(Left, Right, Upper, Lower, width, height, colour, depth)" for _ in range(40)),
    "rows": "\n".join(f"Alice Smith,{i},New York,Blue,{i * 3},{i % 7}" for i in range(60)),
}


def pages(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"] for r in stuffing.stuffed_pages(df).collect()}


@pytest.mark.parametrize("name", list(ODD))
def test_shares_decide(spark, name):
    assert pages(spark, [ODD[name]]) == {0}


def test_text_code_and_rows_stay(spark):
    assert pages(spark, list(PLAIN.values())) == set()


def test_small_odd_shapes_do_not_hide_a_page(spark):
    seps = ["", ",", "|"]
    odd = [f"{a}{s} {' '.join(['zorbo'] * k)}{t}" for a in ("zorbo", "#zorbo #zorbo #zorbo #zorbo", "zorbo https://a.example/x") for s in seps for k in (1, 3, 6) for t in ("", " <b>")]
    text = "\n".join(["cheap zorbo best zorbo buy zorbo online zorbo sale cheap zorbo deal"] * 300 + odd)
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert stuffing.stuffed_pages(df, few=2).count() == 1
