"""Bidirectional text: levels that the algorithm's rules give, stated by hand."""

import pytest
from pyspark.sql import functions as F

from quillframe.functions import bidi
from quillframe.operators import documents

A, B, C = "א", "ב", "ג"  # right to left
N, M = "١", "٢"  # Arabic digits
AL = "ا"


@pytest.mark.parametrize(
    ("text", "paragraph", "made"),
    [
        ("abc", 0, "000"), ("abc", 1, "222"), (f"a {A}{B} c", 0, "001100"), (f"{A} a", 1, "112"), (f"{A}12", 0, "122"), (f"a12{A}", 0, "0001"), (f"{AL}1,2", 0, "1222"), (f"{A}{N}{M}", 0, "122"),
        (f"{A}1+2", 0, "1222"), (f"{A}1-{B}", 0, "1211"), (f"{A}$1", 0, "122"), (f"{A}!{B}!", 0, "1110"), (f"{A}! a", 1, "1112"),
        ("‫a‬b", 0, "0220"), ("‮ab‬", 0, "0111"), (f"a⁧b{A}⁩c", 0, "002100"), (f"{A}⁦b⁩{B}", 0, "11211"),
        (f"a ({A}) b", 0, "0001000"), (f"{A} (a {B}) c", 1, "111211112"), (f"à{A}̀", 0, "0011"), ("", 0, ""),
    ],
)
def test_levels(text, paragraph, made):
    found = bidi.levels(text, paragraph)
    assert "".join(map(str, found)) == made


def test_order():
    assert bidi.visual(f"a {A}{B} 12 c") == f"a 12 {B}{A} c" and bidi.visual(f"{A}{B} ", 1) == f" {B}{A}" and bidi.visual(f"{A}{B} ", 0) == f"{B}{A} "
    assert bidi.visual_order([]) == [] and bidi.visual_order([2, 2, 1, 1]) == [3, 2, 0, 1]
    assert bidi.needs_reordering(A) and not bidi.needs_reordering("abc (1)")


def test_visual_texts(spark):
    df = spark.createDataFrame([(1, f"a {A}{B}"), (2, "plain"), (3, None)], "k int, t string")
    found = {r.k: r.visual for r in documents.visual_texts(df, "k", "t").collect()}
    assert found == {1: f"a {B}{A}", 2: "plain", 3: None}
    assert documents.visual_texts(df.where(F.lit(False)), "k", "t").count() == 0
