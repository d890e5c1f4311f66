"""Hand-made values for the row-level functions."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reviewatlas.functions import columns as C


def values(spark, expr, inputs, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, c {ddl}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_rating(spark):
    texts = ["4.0 out of 5 stars", None, "none", "5", "3.", "v4.5.6"]
    assert values(spark, C.rating_number("c", 0.0), texts) == [4.0, 0.0, 0.0, 5.0, 3.0, 4.5]
    assert values(spark, C.rating_number("c"), texts)[1:3] == [None, None]
    assert values(spark, C.rating_token("c"), ["4.6 out", "x", None, "3"]) == [4.6, 0.0, 0.0, 3.0]


def test_review_date(spark):
    texts = ["Reviewed in the United States on March 5, 2025", "March 05, 2025", "on soon", None, "on 2025-03-05"]
    day = dt.date(2025, 3, 5)
    assert values(spark, C.review_date("c"), texts) == [day, day, None, None, None]


def test_booleans_and_ints(spark):
    assert values(spark, C.text_bool("c"), ["TRUE", "true", "no", None, "1"]) == [True, True, False, False, False]
    assert values(spark, C.int_or("c", 0), ["7", None, "x"]) == [7, 0, None]


def test_brand(spark):
    brands = ["Visit the Acme Store", "Brand: Acme", "by Jo Lee (Author)", "By Jo (Author) (Illustrator)", None, "Store Store Store"]
    assert values(spark, C.clean_brand("c"), brands) == ["Acme", "Acme", "Jo Lee", "Jo (Illustrator)", None, "Store Store"]
    assert values(spark, C.clean_brand("c", "detail"), ["‎Acme Store‎", "Visit the Visit the X"]) == ["Acme", "X"]
    assert values(spark, C.clean_brand("c", "credit"), ["by Jo Lee (Author)", "N/A", "Acme"]) == ["Jo Lee", "N/A", "Acme"]
    assert values(spark, C.clean_brand("c", "prefix"), ["Brand: A", "X Brand: A", "A Store"]) == ["A", "X Brand: A", "A"]
    with pytest.raises(ValueError):
        C.clean_brand("c", "other")


@pytest.mark.parametrize(
    ("text", "total", "one"),
    [
        (None, None, None), ("", None, None), ("{}", None, None), ("bad", None, None),
        ('{"1": "5", "5": 95}', 100.0, 5.0), ('{"1": "x", "5": 95}', 95.0, 0.0), ('{"5": 0, "1": 0}', 0.0, 0.0),
        ('{"5": 10, "7": 3}', 13.0, 0.0),
    ],
)
def test_breakdown(spark, text, total, one):
    bd = C.breakdown_map("c")
    df = spark.createDataFrame([(text,)], "c string")
    assert tuple(df.select(C.map_total(bd), F.when(bd.isNotNull(), C.star_value(bd, 1))).first()) == (total, one)


def test_sentiment_and_quote(spark):
    assert values(spark, C.sentiment_from_rating("c"), [5.0, 4.0, 3.0, 2.0, 0.0, None], "double") == [
        "Positive", "Positive", "Neutral", "Negative", "Neutral", "Neutral"
    ]
    assert values(spark, C.sentiment_from_code("c"), ["Pos", "Neg", "Neu", "?", None]) == ["Positive", "Negative", "Neutral", "Neutral", "Neutral"]
    assert values(spark, C.quote("c"), ["x" * 150, "", None]) == ["x" * 100, "N/A", "N/A"]
    assert values(spark, C.prompt_record(F.lit("r1"), "c"), ['say "hi"\nnow']) == ["ID: r1\nText: say 'hi' now\n---\n"]


def test_family(spark):
    df = spark.createDataFrame(
        [("x/dp/B000000001?a", "B000000002", None), ("x/dp/B000000001", "", "P"), (None, "B000000002", "P"), (None, None, None)],
        "url string, asin string, parent string",
    )
    child, parent = C.resolve_family("url", "asin")
    scraped, requested = C.resolve_family("url", "asin", "parent")
    got = [tuple(r) for r in df.select(child, parent, scraped, requested).collect()]
    assert got == [
        ("B000000002", "B000000001", "B000000002", "B000000001"), ("B000000001", "B000000001", None, "B000000001"),
        ("B000000002", "B000000002", "B000000002", "P"), (None, None, None, None),
    ]


def test_labels(spark):
    assert values(spark, C.aspect_label("c", F.lit("raw")), ["Std", None]) == ["✅ Std", "⏳ raw"]
    label = C.product_label(F.lit("A1"), "c", F.lit(4.25), F.lit(12345))
    assert values(spark, label, ["a" * 26, "short"]) == [f"[A1] {'a' * 25}... | ⭐4.3 (12,345)", "[A1] short | ⭐4.3 (12,345)"]


def test_a_prompt_record_is_not_rebuilt_by_character(frame):
    df = frame([("k", 'a "b"\n\nc\u00e9\U0001f600"'), ("e", ""), ("n", None)], "k string, t string").select("k", C.prompt_record("k", "t").alias("r"))
    assert rows(df) == [("e", "ID: e\nText: \n---\n"), ("k", "ID: k\nText: a 'b'  c\u00e9\U0001f600'\n---\n"), ("n", None)]
    assert "translate" not in df._jdf.queryExecution().analyzed().toString().lower()
