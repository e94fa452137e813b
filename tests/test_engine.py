"""The document and worksheet engine: functions against stated values, sources by round trip, queries against SQL."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.functions import cells, csvtext, diff, formats, html, images, markdown, packages, tolerant
from quillframe.functions import values as v
from quillframe.functions.formula import FormulaError, UnsupportedFormula, parse
from quillframe.functions.worksheet import FUNCTIONS, Context, compile_formula
from quillframe.operators import sheets
from quillframe.sources import files

FORMULAS = {
    "-2^2": "4", "2^3^2": "64", "SUM(A1:A5)": "15", 'SUM("5",TRUE)': "6", "AVERAGE(C1:C5)": "1.3", "0.1+0.2": "0.3", "1/0": "#DIV/0!", "0^0": "#NUM!", "IF(A1>2,1)": "FALSE", 'IFERROR(D1,"e")': "e", 'COUNTIF(B1:B5,"app*")': "2", 'SUMIF(A1:A5,">2")': "12",
    "ROUND(2.675,2)": "2.68", "ROUND(-2.5,0)": "-3", "ROUNDUP(2.1,0)": "3", "MOD(3,-2)": "-1", "CEILING(2.5,1)": "3", "FLOOR(2.5)": "2", 'RIGHT("hello",3)': "llo", 'MID("hello",0,2)': "#VALUE!", "PROPER(\"o'neil mc-donald 2nd\")": "O'Neil Mc-Donald 2Nd", 'TRIM("  a   b ")': "a b",
    'SUBSTITUTE("aaa","a","b",2)': "aba", 'REPLACE("abcdef",2,3,"X")': "aXef", 'FIND("l","hello",4)': "4", 'SEARCH("L?O","hello")': "3", 'VALUE("1,234.5")': "1234.5", 'TEXT(1234.567,"#,##0.00")': "1,234.57", 'TEXT(45000,"yyyy-mm-dd")': "2023-03-15", "DATE(2024,2,29)": "45351", "DAY(60)": "29",
    "WEEKDAY(45351)": "5", "EDATE(45322,1)": "45351", 'DATEDIF(45000,45351,"M")': "11", "VLOOKUP(3,A1:B5,2,FALSE)": "APPLE", "VLOOKUP(3.5,A1:B5,2)": "APPLE", 'MATCH("cherry pie",B1:B4,0)': "4", "INDEX(A1:A5,3)": "3", 'XLOOKUP(2.5,A1:A5,A1:A5,"none",1)': "3", "XOR(TRUE,TRUE)": "FALSE",
    'SWITCH(2,1,"x",2,"y")': "y", "SUMPRODUCT(A1:A5,A1:A5)": "55", 'TEXTJOIN("-",TRUE,B1:B5)': "Apple-banana-APPLE-cherry pie", '"A"="a"': "TRUE", "C4=0": "TRUE", "FOO(1)": "#NAME?", "COUNT(C1:C5)": "2", "COUNTBLANK(C1:C5)": "1", 'LEN("\U0001f600")': "2", "1E20*1": "1E+20", "SUM({1,2;3,4})": "10",
    'AVERAGEIF(A1:A5,">9")': "#DIV/0!", "ROWS(A1:B5)": "5", "HLOOKUP(1,A1:E2,2,FALSE)": "2", "IFS(FALSE,1)": "#N/A", "ABS(1,2)": "#VALUE!",
}


def test_formulas(spark):
    sheet = {f"A{i}": v.number(float(i)) for i in range(1, 6)}
    sheet |= {"B1": v.text("Apple"), "B2": v.text("banana"), "B3": v.text("APPLE"), "B4": v.text("cherry pie"), "C1": v.number(2.5), "C2": v.text("x"), "C3": v.boolean(True), "C5": v.number(0.1), "D1": v.err(v.DIV0)}
    names = list(FORMULAS)
    got = {}
    for k in range(0, len(names), 12):
        part = names[k : k + 12]
        row = spark.range(1).select(*[v.to_json_text(compile_formula(t, Context(sheet))).alias(f"c{i}") for i, t in enumerate(part)]).first()
        got |= dict(zip(part, row, strict=True))
    assert got == FORMULAS
    assert len(FUNCTIONS) == 101


def test_formula_syntax():
    for bad in ("1+", "(1", "{1,2;3}", "SUM(1"):
        with pytest.raises(FormulaError):
            parse(bad)
    for odd in ("Name1+1", "T[x]"):
        with pytest.raises(UnsupportedFormula):
            parse(odd)


@pytest.mark.parametrize(("n", "fmt", "shown"), [(1234.5, "#,##0.00", "1,234.50"), (-5, "0;(0)", "(5)"), (0, "0;-0;zero", "zero"), (0.256, "0.0%", "25.6%"), (12345, "0.00E+00", "1.23E+04"), (1.5, "# ?/?", "1 1/2"), (0.5, "#.##", ".5"), (45000.75, "d mmm yyyy h:mm AM/PM", "15 Mar 2023 6:00 PM"), (1.5, "[h]:mm", "36:00"), (150, '[>100]"big";0', "big"), (-1, "yyyy", "########"), (1e15, "General", "1E+15"), (2.675, "0.00", "2.68")])
def test_number_formats(spark, n, fmt, shown):
    assert spark.range(1).select(formats.format_number(F.lit(float(n)), fmt)).first()[0] == shown


def test_tolerant_parsing(spark):
    amounts = {"1 234,56": "1234.5600000000", "1.234,56": "1234.5600000000", "1,234.56": "1234.5600000000", "1'234.5": "1234.5000000000", "12-": "-12.0000000000", "-": None, "": None, "abc": None, "1.234.567": "1234567.0000000000", "1,5": "1.5000000000"}
    df = spark.createDataFrame([(a,) for a in amounts], "a string")
    assert {r.a: None if r.d is None else str(r.d) for r in df.select("a", tolerant.tolerant_decimal(F.col("a")).alias("d")).collect()} == amounts
    one = spark.range(1)
    got = one.select(tolerant.duration_seconds(F.lit("25:30")), tolerant.duration_seconds(F.lit("1,5")), tolerant.roman(F.lit(1994)), tolerant.delimiter_of(F.lit('a;"b,c,d";e')), tolerant.colour(F.lit("#ff00aa")), tolerant.neutralised(F.lit(" =1+1")), tolerant.neutralised(F.lit("-5")), cells.number_to_letters(F.lit(16384)), tolerant.axis_step(F.lit(0.0), F.lit(37.0))).first()
    assert tuple(got) == (91800.0, 5400.0, "mcmxciv", ";", "FF00AA", "' =1+1", "-5", "XFD", 10.0)
    assert tolerant.page_ranges("1-3,5", 9) == [1, 2, 3, 5]


def test_csv_records():
    text = '﻿a,b\r\n"x ""q""\r\ny",2\n\n,\r3,"a"b'
    assert list(csvtext.records(text)) == [(1, ["a", "b"]), (2, ['x "q"\r\ny', "2"]), (5, ["", ""]), (6, ["3", "ab"])]
    with pytest.raises(csvtext.CsvError):
        list(csvtext.records('a\n"b'))
    assert csvtext.decoded(b"\xe9") == "é" and csvtext.decoded("é".encode("utf-16")) == "é"


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Name;n\nä;1\nb\n".encode("cp1252"))
    found = files.with_header(files.csv_records(files.files(spark, str(tmp_path)))).orderBy("record").collect()
    assert [r["values"] for r in found] == [{"Name": "ä", "n": "1"}, {"Name": "b", "n": ""}]


def test_workbook_round_trip(spark):
    rows = [("w", "S", 0, 1, 1, "text", None, "a\x01_x0041_", None, None, None, None), ("w", "S", 0, 2, 1, "num", 45000.0, None, None, None, None, "yyyy-mm-dd"), ("w", "S", 0, 2, 2, "num", 3.0, None, None, None, "A2+1", None), ("w", "T", 1, 1, 1, "bool", None, None, True, None, None, None), ("w", "T", 1, 1, 3, "err", None, None, None, "#N/A", None, None)]
    df = spark.createDataFrame(rows, "path string, sheet string, sheet_ix int, row int, col int, kind string, num double, text string, bool boolean, err string, formula string, number_format string")
    back = files.workbook_cells(files.workbooks(df)).orderBy("sheet_ix", "row", "col").collect()
    assert [(r.sheet, r.row, r.col, r.kind, r.num, r.text, r.bool, r.err, r.formula) for r in back] == [(r[1], r[3], r[4], r[5], r[6], r[7], r[8], r[9], r[10]) for r in rows]
    assert [r.is_date for r in back] == [False, True, False, False, False]
    assert packages.shift_formula('A1+$B$2&"A1"', 1, 1) == 'B2+$B$2&"A1"' and packages.shift_formula("A1", -1, 0) == "#REF!"
    broken = spark.createDataFrame([("x", bytearray(b"no zip"))], "path string, content binary")
    assert files.workbook_cells(broken).count() == 0 and files.problems(broken, "workbook").first().reason == "no package"


def test_document_round_trip(spark):
    made = packages.write_document([("Heading1", "Title"), (None, "a\tb\nc"), (None, "")])
    df = spark.createDataFrame([("d", bytearray(made))], "path string, content binary")
    found = files.paragraphs(df).orderBy("para_ix").collect()
    assert [(r.style, r.text) for r in found] == [("Heading1", "Title"), (None, "a\tb\nc"), (None, "")]
    assert packages.replace_all("aab", {"a": "b", "aa": "x"}) == "xb"


def test_html():
    root = html.parse("<p>a<p class='x y'>b &amp; c<ul><li>1<li>2</ul><table><td>t</table><script>var a='</p>';</script>")
    select = lambda s: [n.text_content() for n in html.Selector(s).select(root)]
    assert select("p") == ["a", "b & c"] and select("p.y") == ["b & c"] and select("ul > li:first-child, td") == ["1", "t"] and select("p + p") == ["b & c"]
    assert select("li:nth-child(even)") == ["2"] and select("p:not(.x)") == ["a"] and select("tbody tr td") == ["t"] and select("[class~=x]") == ["b & c"]
    assert html.sanitise('<a href=" java\tscript:x" onclick=y>t</a><script>z</script><b>ok</b><custom>in</custom>') == "<a>t</a><b>ok</b>in"
    r = random.Random(1)
    for _ in range(300):
        html.serialize(html.parse("".join(r.choice("<>/\"'=ab &;!-p") for _ in range(r.randint(0, 200)))))


@pytest.mark.parametrize(
    ("source", "made"),
    [
        ("# a *b* **c**", "<h1>a <em>b</em> <strong>c</strong></h1>\n"), ("a\n===", "<h1>a</h1>\n"), ("- a\n- b", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n"), ("1) x\n\n2) y", "<ol>\n<li>\n<p>x</p>\n</li>\n<li>\n<p>y</p>\n</li>\n</ol>\n"), ("> q\nr", "<blockquote>\n<p>q\nr</p>\n</blockquote>\n"),
        ("```py\na<b\n```", '<pre><code class="language-py">a&lt;b\n</code></pre>\n'), ("[t](/u \"v\") ![i](x.png)", '<p><a href="/u" title="v">t</a> <img src="x.png" alt="i" /></p>\n'), ("[r]\n\n[r]: /x", '<p><a href="/x">r</a></p>\n'), ("[j](javascript:x)", "<p>j</p>\n"), ("a  \nb", "<p>a<br />\nb</p>\n"),
        ("| a | b |\n|--|:-:|\n| 1 | 2 |", '<table>\n<thead>\n<tr>\n<th>a</th>\n<th align="center">b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td align="center">2</td>\n</tr>\n</tbody>\n</table>\n'), ("~~x~~ `c` \\*", "<p><del>x</del> <code>c</code> *</p>\n"), ("***a***", "<p><em><strong>a</strong></em></p>\n"), ("<b>", "<p>&lt;b&gt;</p>\n"), ("foo_bar_baz", "<p>foo_bar_baz</p>\n"),
    ],
)
def test_markdown(source, made):
    assert markdown.to_html(source) == made


def test_rounding_at_the_edges(spark):
    cases = [("=ROUND(2.5,-400)", 0.0), ("=ROUND(15,-1.5)", 20.0), ("=ROUND(-1.5,0.9)", -2.0), ("=ROUND(1.005,2)", 1.01), ("=ROUNDUP(2.1,-400)", 1e308), ("=ROUNDDOWN(2.9,-400)", 0.0), ("=ROUNDUP(1E-12,0)", 1.0), ("=TRUNC(-7.89,1)", -7.8), ("=ROUND(1.5,400)", 1.5), ("=CEILING(0,0)", 0.0), ("=FLOOR(7,2)", 6.0), ("=CEILING(-7,2)", -6.0), ("=CEILING(0.7,0.1)", 0.7)]
    made = [compile_formula(f, Context({}))["n"].alias(f"c{k}") for k, (f, _) in enumerate(cases)]
    assert list(spark.range(1).select(*made).first()) == [x for _, x in cases]
    assert [spark.range(1).select(compile_formula(f, Context({}))["e"].alias("e")).first().e for f in ("=CEILING(5,0)", "=FLOOR(5,0)", "=CEILING(5,-1)")] == ["#DIV/0!", "#DIV/0!", "#NUM!"]


def test_texts_fold_one_character_for_one(spark):
    row = spark.range(1).select(*[compile_formula(f, Context({}))["b"].alias(f"c{k}") for k, f in enumerate(('="STRASSE"="Straße"', '="ΣΑΣ"="σας"', '="Ä"="ä"', '="a"<"B"', '="STRASSE"<>"Straße"'))], compile_formula('=UPPER("straße")', Context({}))["s"].alias("u")).first()
    assert list(row) == [False, True, True, True, True, "STRAßE"]
    left = spark.createDataFrame([("STRASSE", "mine"), ("STRAßE", "x"), (None, "y")], "word string, _key string")
    table = spark.createDataFrame([("Straße", 1, "hit")], "k string, pos int, r string")
    found = sheets.exact_lookup(left, "word", table, "k", "pos", "r")
    assert sorted(map(tuple, found.collect()), key=repr) == [("STRASSE", "mine", "#N/A"), ("STRAßE", "x", "hit"), (None, "y", "#N/A")]


def test_diff_is_shortest():
    r = random.Random(3)
    for _ in range(300):
        a = [r.randint(0, 3) for _ in range(r.randint(0, 30))]
        b = [r.randint(0, 3) for _ in range(r.randint(0, 30))]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        found = diff.blocks(a, b)
        assert sum(k[1] + k[3] for k in found) == len(a) + len(b) - 2 * table[-1, -1]
        rebuilt, at = [], 0
        for p, deleted, q, inserted in found:
            rebuilt += a[at:p] + b[q : q + inserted]
            at = p + deleted
        assert rebuilt + a[at:] == b


def test_images():
    r = np.random.default_rng(0)
    for channels in (1, 2, 3, 4):
        pixels = r.integers(0, 256, (7, 5, channels)).astype(np.uint8)
        data = images.encode_png(pixels)
        assert images.identify(data)[:3] == ("png", 5, 7) and (images.decode_png(data) == pixels).all()
    assert images.scaled_size(400, 100, 200) == (200, 50) and images.scale(np.full((8, 8, 3), 9, np.uint8), 4).shape == (4, 4, 3)
    a = np.zeros((10, 10, 3), np.uint8)
    b = a.copy()
    b[2:8, 2:8] = 255
    assert images.compare(a, a)[0] == 0 and images.compare(a, b)[0] >= 16


def test_queries_match_their_sql(spark):
    import duckdb

    from quillframe.plans import catalog, formatting, ordered, scalars, worksheets  # noqa: F401

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in catalog.SQL.items():
        df = catalog.QUERIES[name](spark, sf)
        names = sorted(df.columns)
        mine = sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))
        theirs = sorted(map(repr, con.sql(f"select {', '.join(names)} from ({sql})").fetchall()))
        assert mine == theirs, name


def test_sheet_records_take_the_first_line_in_the_file(spark, tmp_path):
    import duckdb

    from quillframe.plans import catalog, ordered

    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    con = duckdb.connect()
    con.sql("set threads = 1")
    top = 1 << 33
    # The later file is the larger one, which Spark reads first; its row groups hold the same places again.
    con.sql(f"copy (select * from (values ('A', {top}, 1, 'F'), ('A', {top}, 2, null), ('A', {top + 3}, 3, '=1,'), (null, {top}, 1, 'F'), ('A', null, 4, 'F'), ('A', {top + 5}, null, 'F'), ('N', 5, null, 'F')) t(l_returnflag, l_orderkey, l_linenumber, l_linestatus)) to '{folder}/a.parquet'")
    con.sql(f"copy (select 'A' as l_returnflag, {top} + i % 5 as l_orderkey, (i % 2 + 1)::int as l_linenumber, chr((65 + i // 10 % 26)::int) as l_linestatus from range(20000) t(i)) to '{folder}/b.parquet' (row_group_size 2048)")
    con.sql(f"create view lineitem as from read_parquet('{folder}/*.parquet')")
    theirs = sorted(con.sql(catalog.SQL["sheet_records"]).fetchall())
    mine = ordered.sheet_records(spark, str(tmp_path)).select("l_returnflag", "row_at", "record")
    assert sorted(tuple(r) for r in mine.collect()) == theirs and theirs[0] == ("A", top, "F,A,,")


def test_titles_of_all_pages(spark, tmp_path):
    from html.parser import HTMLParser

    import __spark_entry__ as e

    class Titles(HTMLParser):
        inside, found = False, ""

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "title"

        def handle_endtag(self, tag):
            self.inside &= tag != "title"

        def handle_data(self, data):
            self.found += data if self.inside else ""

    def brute(page):
        reader = Titles()
        reader.feed(page or "")
        return reader.found.strip()

    pages = ["<title>plain</title>", "<head><title>a &amp; b &#233; &lt;c&gt;</title></head>", '<title lang="en">with attribute</title>', "<TITLE>Upper</TITLE>", "<p>none</p>", "", None, "<title> \n</title>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.title for r in e.queries()["html_page_titles"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(page) for i, page in enumerate(pages)}


def test_lines_of_all_texts(spark, tmp_path):
    import __spark_entry__ as e

    lines = {"a\r\nb\rc\nd": 4, "a\r\n": 1, "a\r": 1, "\r\r\n": 2, "a\n\nb": 3, "\n": 1, "a": 1, "": 1, None: None}
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_lines for r in e.queries()["text_lines"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(lines.values()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pdf_letters_to_text(spark):
    from quillframe.functions import pdf
    from quillframe.operators import layout

    made = pdf.write_text([["Hello (wide) world", "second line"], ["Page two", "café"]])
    df = spark.createDataFrame([("p", bytearray(made)), ("bad", bytearray(b"x"))], "path string, content binary")
    letters = files.pdf_letters(df).withColumnRenamed("path", "doc")
    got = {r.page: r.text for r in layout.page_text(layout.words_of_letters(letters)).collect()}
    assert got == {1: "Hello (wide) world\nsecond line", 2: "Page two\ncafé"}
    assert [tuple(r)[1:] for r in files.pdf_pages(df).orderBy("page").collect()] == [(k, 0.0, 0.0, 612.0, 792.0, 0) for k in (1, 2)]
    data = bytes(range(256)) * 3
    assert pdf.run_length(b"\x02abc\xfed\x80") == b"abcddd" and pdf.inflated(__import__("zlib").compress(data)[:-3] + b"zzz")[:256] == data[:256]
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"
    areas = spark.createDataFrame([("p", 1, 0.0, 700.0, 700.0, 800.0)], "doc string, page int, l double, b double, r double, t double")
    left = layout.redacted_letters(letters, areas)
    assert {r.page: r.text for r in layout.page_text(layout.words_of_letters(left)).collect()} == {2: "Page two\ncafé"}


def test_list_counters(spark):
    from quillframe.operators import layout

    levels = [0, 1, 1, 0, 1, 2, 1, 0]
    items = spark.createDataFrame([("d", "l", i, k) for i, k in enumerate(levels)], "doc string, list string, pos int, level int")
    labelled = layout.list_labels(layout.list_counters(items), ["%1.", "%1.%2", "%1.%2%3"], ["decimal", "decimal", "lowerLetter"])
    assert [r.label for r in labelled.orderBy("pos").collect()] == ["1.", "1.1", "1.2", "2.", "2.1", "2.1a", "2.2", "3."]


def test_layout_rules(spark):
    from quillframe.operators import layout

    points = spark.createDataFrame([("c", "a", 1, 2.0), ("c", "a", 2, -1.0), ("c", "a", 3, 3.0), ("c", "b", 1, None)], "chart string, category string, series int, value double")
    assert sorted((r.category, r.series, r.low, r.high) for r in layout.stacked(points).collect()) == [("a", 1, 0.0, 2.0), ("a", 2, -1.0, 0.0), ("a", 3, 2.0, 5.0), ("b", 1, 0.0, 0.0)]
    lines = spark.createDataFrame([("d", p, t) for p in (1, 2, 3) for t in (f"Report {p}", f"text {chr(96 + p)}", f"- {p} -")], "doc string, page int, text string")
    assert {r.text for r in layout.decorations(lines).where("decoration").collect()} == {f"Report {p}" for p in (1, 2, 3)} | {f"- {p} -" for p in (1, 2, 3)}
    numbers = ["7", "- 7 -", "Page 7", "page 7 of 12", "7/12", "Page - 3", "3 sur 9", "1 of 20000000000000", "page", "7 8", "chapter 7", "7 of", "", None]
    alone = spark.createDataFrame([(f"d{k}", 1, t) for k, t in enumerate(numbers)], "doc string, page int, text string")
    assert [r.decoration for r in sorted(layout.decorations(alone).collect(), key=lambda r: int(r.doc[1:]))] == [True] * 7 + [False] * 7
    loose = spark.createDataFrame([("d", None, 1, 10, "x"), ("d", None, 1, 20, "y"), (None, 1, 1, 5, None)], "doc string, section int, page int, pos int, note string")
    assert sorted((r.pos, r.number) for r in layout.note_numbers(loose, "section").collect()) == [(5, 1), (10, 1), (20, 2)]
    refs = spark.createDataFrame([("d", 1, 1, 10, "x"), ("d", 1, 1, 20, "y"), ("d", 2, 2, 30, "x")], "doc string, section int, page int, pos int, note string")
    assert [r.number for r in layout.note_numbers(refs).orderBy("pos").collect()] == [1, 2, 1] and [r.number for r in layout.note_numbers(refs, "section").orderBy("pos").collect()] == [1, 2, 1]


def test_streams_give_what_batches_give(spark, tmp_path):
    from quillframe.streaming import feeds

    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.csv").write_text(f"a,b\n{k},x\n")
    query = files.csv_records(feeds.arriving_files(spark, str(folder))).writeStream.format("memory").queryName("csv_records_stream").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("csv_records_stream").count() == files.csv_records(files.files(spark, str(folder))).count() == 6
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/events")
    made = feeds.windowed_counts(feeds.arriving_rows(spark, f"{tmp_path}/events", events.schema), "10 minutes", "1 hour", "ts", "event_type")
    query = made.writeStream.outputMode("complete").format("memory").queryName("hourly_stream").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("hourly_stream").agg({"n": "sum"}).first()[0] == events.count()


def test_recalculation_order_cycles_and_reports(spark):
    from quillframe.operators import recalculation as rc

    order = rc.plan({"C1": "=B1+1", "B1": "=SUM(A1:A9)", "A2": "=1", "D1": "=Name+1", "E1": "=Other!A1"})
    assert order.levels == [["A2"], ["B1"], ["C1"]] and set(order.unsupported) == {"D1", "E1"}
    with pytest.raises(rc.CycleError) as e:
        rc.plan({"A1": "=B1", "B1": "=C1+1", "C1": "=A1", "D1": "=1"})
    assert sorted(e.value.cells) == ["A1", "B1", "C1"]
    cells_ = spark.createDataFrame([("w", 1, 1, "num", 2.0, None, None, None), ("w", 2, 1, "text", None, "x", None, None)], "wb string, row int, col int, kind string, num double, text string, bool boolean, err string")
    wide = rc.wide_cells(cells_, "wb", ["A1", "A2", "A3"])
    rows = rc.recalculate(wide.select("wb", *[F.col(a).alias(f"in_{a}") for a in ("A1", "A2", "A3")]), {a: F.col(f"in_{a}") for a in ("A1", "A2", "A3")}, {"B1": "=A1*2", "B2": "=B1&A2", "B3": "=COUNTBLANK(A1:A3)", "B4": "=NOPE(1)"})
    got = rows.select(*[v.to_json_text(F.col(a)) for a in ("B1", "B2", "B3", "B4")]).first()
    assert tuple(got) == ("4", "4x", "1", "#NAME?") and rc.unknown_functions({"B4": "=1+NOPE(1)"}) == {"B4": "NOPE"}
