"""Formulas over long cells against stated values, and wildcards that are data."""

import pytest
from pyspark.sql import functions as F

from quillframe.functions import values as v
from quillframe.functions.formula import UnsupportedFormula
from quillframe.functions.worksheet import Context, compile_formula
from quillframe.operators import ranges

DDL = "book string, key string, sheet string, row int, col int, kind string, num double, text string, bool boolean, err string"


def _cells(spark):
    made = []
    for book in ("a", None):
        for r, n in enumerate([3.0, 1.0, 9.0, 4.0], 1):
            made.append((book, "x", "S", r, 1, "num", n, None, None, None))
        made += [(book, "x", "S", r, 2, "text", None, t, None, None) for r, t in ((1, "Red"), (2, ""), (4, "red~"))]
        made += [(book, "x", "S", 1_048_576, 1, "num", 0.5, None, None, None), (book, "x", "T", 2, 2, "num", 10.0, None, None, None)]
    made += [("b", "x", "S", 2, 1, "err", None, None, None, "#N/A"), ("b", "x", "S", 3, 1, "err", None, None, None, "#REF!"), ("b", "x", "S", 4, 3, "bool", None, None, True, None)]
    return spark.createDataFrame(made, DDL)


FORMULAS = {
    "sum": ("=SUM(A:A)", ["17.5", "#N/A"]), "more": ('=SUM(A:A,2,"3")', ["22.5", "#N/A"]), "both": ("=SUM(A1:A2,A2:A3)", ["14", "#N/A"]), "count": ("=COUNT(A:A)", ["5", "0"]),
    "blank": ("=COUNTBLANK(A1:C4)", ["6", "9"]), "all": ("=COUNTBLANK(B:B)", ["1048574", "1048576"]), "mean": ("=IFERROR(AVERAGE(T!B:B),-1)", ["10", "-1"]), "least": ("=MIN(A:B)", ["0.5", "#N/A"]),
    "if": ('=SUMIF(B1:B4,"red*",A1:A4)', ["7", "0"]), "ifs": ('=COUNTIFS(A1:A4,"<>9",B1:B4,"")', ["1", "4"]), "shape": ('=COUNTIFS(A1:A4,">1",B1:B3,"x")', ["#VALUE!", "#VALUE!"]), "met": ('=SUMIF(A:A,">2")', ["16", "0"]),
    "product": ("=SUMPRODUCT(A1:A3,A2:A4)", ["48", "#N/A"]), "cell": ("=A1+T!B2", ["13", "0"]), "small": ("=VLOOKUP(9,A1:B4,1,FALSE)", ["9", "#N/A"]), "any": ("=OR(C:C,FALSE)", None), "rows": ("=ROWS(A:A)", ["1048576", "1048576"]),
    "none": ('=AVERAGEIF(C:C,">1")', ["#DIV/0!", "#DIV/0!"]), "or": ("=OR(C:C)", ["#VALUE!", "TRUE"]), "power": ("=PRODUCT(A1:A3)", ["27", "#N/A"]),
}


def test_formulas_over_long_cells(spark):
    cells = _cells(spark)
    asked = {n: f for n, (f, shown) in FORMULAS.items() if shown}
    found = ranges.evaluate(cells, ["book", "key"], asked, "s")
    rows = {r["book"]: r for r in found.select("book", *[v.to_json_text(F.col(n)).alias(n) for n in asked]).collect()}
    assert set(rows) == {"a", None, "b"}
    for n in asked:
        assert [rows["a"][n], rows[None][n], rows["b"][n]] == [FORMULAS[n][1][0], FORMULAS[n][1][0], FORMULAS[n][1][1]], n
    assert ranges.evaluate(cells.where("false"), ["book", "key"], {n: asked[n] for n in ("sum", "ifs")}, "S").count() == 0
    whole = ranges.evaluate(cells.where("book = 'a'"), [], {"n": "=COUNT(A:A)"}, "S")
    assert whole.columns == ["n"] and whole.first()["n"]["n"] == 5
    for refused in (FORMULAS["any"][0], "=A1:A100&1", "=COUNTIF(A:A,B1)", "=AVERAGE(A:A,3)"):
        with pytest.raises(UnsupportedFormula):
            ranges.evaluate(cells, ["book"], {"x": refused}, "S")


@pytest.mark.parametrize("value, place", [("a?c", "2"), ("~*", "3"), ("*z", "4"), ("A.C", "1"), ("\\Q*", "5"), ("q~", "6"), ("~~", "7"), ("none*x", "#N/A")])
def test_wildcards_that_are_data(spark, value, place):
    held = ["a.c", "axc", "*", "xyz", "\\Qe", "q~", "~"]
    if value == "a?c":
        held[0] = "a.cc"
    cells = {f"A{i}": v.text(t) for i, t in enumerate(held, 1)}
    row = spark.createDataFrame([(value,)], "s string")
    context = Context({**cells, "B1": v.from_column(F.col("s"), "text")})
    made = {"m": "=MATCH(B1,A1:A7,0)", "x": "=XLOOKUP(B1,A1:A7,{1;2;3;4;5;6;7},NA(),2)"}
    assert row.select(*[v.to_json_text(compile_formula(f, context)).alias(n) for n, f in made.items()]).first() == (place, place)
