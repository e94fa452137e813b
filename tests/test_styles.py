"""Styles, wrapped lines, records as cells and lifted functions against stated values."""

from pyspark.sql import functions as F

from quillframe.functions import values as v
from quillframe.functions.worksheet import Context, compile_formula
from quillframe.operators import conversions, sheets, styles


def test_chains_of_styles(spark):
    rows = [("d", "a", None, {"x": "1"}), ("d", "b", "a", {"y": "2"}), ("d", "c", "b", {"x": "3"}), ("d", "p", "q", {"u": "p"}), ("d", "q", "p", {"u": "q", "w": "q"}), ("d", "lost", "nowhere", None), ("d", "c", "z", {"x": "4"}), (None, "b", "a", {"k": "0"}), ("d", None, "a", {})]
    rows += [("long", str(i), str(i - 1), {"first": "yes"} if i == 0 else {}) for i in range(40)]
    found = {(r.doc, r.style): r.props for r in styles.resolved_styles(spark.createDataFrame(rows, "doc string, style string, based_on string, props map<string,string>"), ["doc"]).collect()}
    assert found["d", "c"] == {"x": "3", "y": "2"} and found["d", "p"] == {"u": "p", "w": "q"} and found["d", "q"] == {"u": "q", "w": "q"}
    assert found["d", "lost"] == {} and found[None, "b"] == {"k": "0"} and ("d", None) not in found
    assert found["long", "31"] == {"first": "yes"} and found["long", "32"] == {}
    classes = styles.style_classes(spark.createDataFrame([("d", 3, "b"), ("d", 1, None), ("d", 2, "a"), ("d", 4, "a"), ("e", 9, "a")], "doc string, at int, f string"), ["doc"], "at", ["f"])
    assert sorted((r.doc, r["class"], r.f) for r in classes.collect()) == [("d", "c1", None), ("d", "c2", "a"), ("d", "c3", "b"), ("e", "c1", "a")]


def test_wrapped_lines(spark):
    def plain(text, limit, width):
        lines, line, used = [], "", 0
        for w in text.split():
            size = sum(width.get(c, 1) for c in w)
            if line and used + 1 + size <= limit:
                line, used = f"{line} {w}", used + 1 + size
            else:
                lines += [line] if line else []
                line, used = w, size
        return lines + ([line] if line else [])

    texts = ["", "  ", "one", "mm mm mm", "a bb ccc dddd eeeee ffffffffffffffffff g", "word " * 5000, "i l m w " * 30]
    width = {"m": 2, "i": 0.5, "l": 0.5}
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", styles.wrapped(F.col("t"), 10, styles.table_width(width, 1)).alias("lines"))
    assert {r.t: r.lines for r in df.collect()} == {None: None, **{t: plain(t, 10, width) for t in texts}}


def test_records_as_cells(spark):
    df = spark.createDataFrame([("k", 1, ["1", "-2.5e3", "1e999", "", " 4", None, "1,5", ".5", "NaN"]), ("k", 2, []), ("k", 3, None)], "file string, row int, fields array<string>")
    found = [(r.row, r.col, r.kind, r.num, r.text) for r in conversions.record_cells(df, ["file"]).orderBy("row", "col").collect()]
    assert found == [(1, 1, "num", 1.0, None), (1, 2, "num", -2500.0, None), (1, 3, "text", None, "1e999"), (1, 4, "text", None, ""), (1, 5, "text", None, " 4"), (1, 6, "text", None, ""), (1, 7, "text", None, "1,5"), (1, 8, "num", 0.5, None), (1, 9, "text", None, "NaN")]


def test_lifted_functions(spark):
    cells = {"A1": v.number(-1.0), "A2": v.number(2.6), "A3": v.text("x"), "B1": v.number(10.0)}
    made = {"SUMPRODUCT(ABS(A1:A2))": "3.6", "SUM(INT(A1:A2))": "1", "SUMPRODUCT(-A1:A2)": "-1.6", "SUMPRODUCT(IF(ISNUMBER(A1:A3),1,0))": "2", "SUM(ROUND(A1:A2,{0,1}))": "3.6", "SUMPRODUCT(LEN({\"ab\",\"c\"}))": "3", "SUM(MOD({5;6;7},{2;4}))": "#N/A", "SUM(A1:A2%)": "0.016", "MAX(IF(A1:A2>0,B1:B1,0))": "10"}
    row = spark.range(1).select(*[v.to_json_text(compile_formula(f, Context(cells))).alias(str(i)) for i, f in enumerate(made)]).first()
    assert dict(zip(made, row, strict=True)) == made


def test_lists_fold_one_character_for_one(spark):
    left, keys = spark.createDataFrame([("STRASSE",), ("STRAßE",), ("X",)], "s string"), spark.createDataFrame([("Straße",), ("x",), (None,)], "k string")
    assert sorted(r.s for r in sheets.in_list(left, "s", keys, "k").collect()) == ["STRAßE", "X"]
