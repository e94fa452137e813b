"""Queries over the shared tables that exercise the engine's operators, each with its SQL where SQL can say it.

Every query reads whole tables. ``QUERIES`` maps a name to (spark, sf_dir) -> DataFrame and ``SQL`` to
DuckDB SQL over views of the same names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells, formats, tolerant
from ..functions import values as v
from ..functions.worksheet import Context, compile_formula
from ..operators import documents, recalculation, sheets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _formula(text: str, **cells_: v.Column):
    return compile_formula(text, Context(cells_))


def _n(text: str, **cells_):
    """The number of a formula's value."""
    return _formula(text, **cells_)["n"]


def _s(text: str, **cells_):
    return v.to_json_text(_formula(text, **cells_))


def num(c: str):
    return v.from_column(F.col(c), "num")


def txt(c: str):
    return v.from_column(F.col(c), "text")


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 8) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def summary(spark, sf_dir):
    """The flagship report: worksheet aggregates by flag and status."""
    rows = _read(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    price = F.col("l_extendedprice")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(sheets.sum_(F.col("l_quantity")), 2).alias("sum_qty"), F.round(sheets.sum_(price), 2).alias("sum_price"), F.round(sheets.sumproduct(price, 1 - F.col("l_discount")), 2).alias("sum_disc_price"), F.round(sheets.average(F.col("l_discount"))["n"], 8).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_returnflag,
       count(*) FILTER (l_quantity >= 30) AS n_big, count(*) FILTER (l_quantity < 10 AND l_linestatus = 'F') AS n_small_f,
       round(coalesce(sum(l_extendedprice) FILTER (l_quantity >= 30), 0), 2) AS price_big, round(avg(l_discount) FILTER (l_tax > 0.02), 8) AS avg_taxed,
       count(*) FILTER (l_linestatus <> 'O') AS n_not_o
FROM lineitem GROUP BY ALL
""")
def criteria_aggregates(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem")
    big = sheets.matching(F.col("l_quantity"), "num", ">=30")
    out = [sheets.countifs(big).alias("n_big"), sheets.countifs(sheets.matching(F.col("l_quantity"), "num", "<10"), sheets.matching(F.col("l_linestatus"), "text", "f")).alias("n_small_f")]
    out += [F.round(sheets.sumifs(F.col("l_extendedprice"), big), 2).alias("price_big"), F.round(sheets.averageifs(F.col("l_discount"), sheets.matching(F.col("l_tax"), "num", ">0.02"))["n"], 8).alias("avg_taxed"), sheets.countifs(sheets.matching(F.col("l_linestatus"), "text", "<>o")).alias("n_not_o")]
    return rows.groupBy("l_returnflag").agg(*out)


@query("""
SELECT p_brand, count(*) FILTER (p_name ILIKE '%a%e%') AS n_ae, count(*) FILTER (lower(p_type) LIKE 'standard%') AS n_standard, count(*) FILTER (NOT p_name ILIKE '_o%') AS n_not_o
FROM part GROUP BY ALL
""")
def wildcard_criteria(spark, sf_dir):
    rows = _read(spark, sf_dir, "part")
    test = lambda c, crit: sheets.countifs(sheets.matching(F.col(c), "text", crit))
    return rows.groupBy("p_brand").agg(test("p_name", "*a*e*").alias("n_ae"), test("p_type", "STANDARD*").alias("n_standard"), test("p_name", "<>?o*").alias("n_not_o"))


@query("SELECT c_custkey, coalesce(n_name, '#N/A') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def exact_lookup(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation").withColumn("pos", F.col("n_nationkey"))
    return sheets.exact_lookup(_read(spark, sf_dir, "customer"), "c_nationkey", nation, "n_nationkey", "pos", "n_name", out="nation").select("c_custkey", "nation")


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN '#N/A' WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'middle' WHEN o_totalprice < 300000 THEN 'large' ELSE 'huge' END AS band
FROM orders
""")
def approximate_lookup(spark, sf_dir):
    steps = spark.createDataFrame([(1000.0, "small"), (50000.0, "middle"), (150000.0, "large"), (300000.0, "huge")], "at double, name string")
    return sheets.as_of_lookup(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", steps, "at", "name", out="band").select("o_orderkey", "band")


@query("SELECT p_partkey, CASE WHEN p_type ILIKE '%brass' THEN 'brass' WHEN p_type ILIKE '%steel' THEN 'steel' WHEN p_type ILIKE 'ECO%' THEN 'economy' ELSE '#N/A' END AS metal FROM part")
def wildcard_lookup(spark, sf_dir):
    return sheets.wildcard_lookup(_read(spark, sf_dir, "part"), {"brass": "*brass", "steel": "*steel", "economy": "eco*"}, "p_type", out="metal").select("p_partkey", "metal")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def not_in_list(spark, sf_dir):
    large = _read(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").cast("string").alias("o_custkey"))
    return sheets.in_list(_read(spark, sf_dir, "customer"), "c_custkey", large, "o_custkey", anti=True).select("c_custkey")


@query("""
WITH first AS (SELECT lower(p_type) AS k, min_by(p_name, p_partkey) AS shown FROM part GROUP BY ALL)
SELECT p_partkey, coalesce(shown, '#N/A') AS first_name FROM part LEFT JOIN first ON k = lower(CASE WHEN p_partkey % 3 = 0 THEN p_type || '?' ELSE upper(p_type) END)
""")
def folded_lookup(spark, sf_dir):
    """A lookup without regard to case, with misses."""
    parts = _read(spark, sf_dir, "part")
    asked = parts.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("?"))).otherwise(F.upper("p_type")).alias("asked"))
    return sheets.exact_lookup(asked, "asked", parts, "p_type", "p_partkey", "p_name", out="first_name").select("p_partkey", "first_name")


@query("""
SELECT l_orderkey, l_linenumber, q BETWEEN 0 AND 1e9 AS is_num, (l_linenumber = 1) AS is_err, (l_linenumber % 2 = 1) AS odd,
       (l_returnflag = 'N' OR l_linenumber = 7) AS either, NOT (l_returnflag = 'N') AS no, t + f AS together,
       (q + t + l_linenumber) / 3 AS mean, CAST(3 AS DOUBLE) AS n, q * t AS product, CASE WHEN q > 20 THEN q ELSE 0 END + CASE WHEN l_linenumber > 20 THEN l_linenumber ELSE 0 END AS above
FROM (SELECT *, l_quantity AS q, l_tax AS t, CAST(length(l_returnflag) AS DOUBLE) AS f FROM lineitem)
""")
def list_aggregates(spark, sf_dir):
    """Information functions, logic and aggregates over a row's range."""
    a = {"A1": num("l_quantity"), "A2": num("l_tax"), "A3": v.from_column(F.col("l_linenumber").cast("double"), "num"), "B1": txt("l_returnflag")}
    flags = {"is_num": "=ISNUMBER(A1)", "is_err": "=ISERROR(1/(A3-1))", "odd": "=ISODD(A3)", "either": '=OR(B1="n",A3=7)', "no": '=NOT(B1="N")'}
    numbers = {"together": "=A2+LEN(B1)", "mean": "=AVERAGE(A1:A3)", "n": "=COUNT(A1:B3)", "product": "=PRODUCT(A1:A2)", "above": '=SUMIF(A1:A3,">20")'}
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[_formula(f, **a)["b"].alias(k) for k, f in flags.items()], *[_n(f, **a).alias(k) for k, f in numbers.items()])


@query("""
SELECT o_orderkey, CASE WHEN m <= 2 THEN 'low' WHEN m <= 5 THEN 'mid' ELSE 'high' END AS near, CASE m WHEN 3 THEN 'three' WHEN 7 THEN 'seven' ELSE '#N/A' END AS exact,
       CAST(CASE m WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE -1 END AS DOUBLE) AS place, CASE WHEN m <= 3 THEN 'three' WHEN m <= 7 THEN 'seven' ELSE 'none' END AS larger, CASE WHEN m < 3 THEN 'none' WHEN m < 7 THEN 'three' ELSE 'seven' END AS smaller
FROM (SELECT *, month(o_orderdate) AS m FROM orders)
""")
def small_lookups(spark, sf_dir):
    """Lookups in small ranges of a sheet: VLOOKUP, INDEX with MATCH, XLOOKUP with the next larger and the next smaller key."""
    a = {"A1": v.from_column(F.month("o_orderdate").cast("double"), "num")}
    made = {"near": '=VLOOKUP(A1,{1,"low";3,"mid";6,"high"},2)', "exact": '=VLOOKUP(A1,{3,"three";7,"seven"},2,FALSE)', "larger": '=XLOOKUP(A1,{3,7},{"three","seven"},"none",1)', "smaller": '=XLOOKUP(A1,{3,7},{"three","seven"},"none",-1)'}
    return _read(spark, sf_dir, "orders").select("o_orderkey", *[_s(f, **a).alias(k) for k, f in made.items()], _n("=IFERROR(INDEX({1,2},MATCH(A1,{3,7},0)),-1)", **a).alias("place"))


@query("""
SELECT o_orderkey, floor(o_totalprice / 1000) AS thousands, o_totalprice - 7 * floor(o_totalprice / 7) AS mod7, abs(-o_totalprice) AS absolute,
       sqrt(o_totalprice) AS root, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, o_totalprice * 2 / 4 AS half
FROM orders
""")
def math_functions(spark, sf_dir):
    a = num("o_totalprice")
    return _read(spark, sf_dir, "orders").select("o_orderkey", _n("=INT(A1/1000)", A1=a).alias("thousands"), _n("=MOD(A1,7)", A1=a).alias("mod7"), _n("=ABS(-A1)", A1=a).alias("absolute"), _n("=SQRT(A1)", A1=a).alias("root"), _s('=IF(A1>100000,"big","small")', A1=a).alias("size"), _n("=A1*2/4", A1=a).alias("half"))


@query("""
SELECT p_partkey, left(p_name, 3) AS l3, right(p_name, 2) AS r2, substr(p_name, 2, 4) AS m4, CAST(length(p_name) AS DOUBLE) AS n, upper(p_name) AS up,
       replace(p_name, 'a', '@') AS sub, CASE WHEN position('e' IN p_name) = 0 THEN '#VALUE!' ELSE CAST(position('e' IN p_name) AS VARCHAR) END AS at_e,
       p_brand || '-' || p_type AS joined, repeat('ab', 3) AS rep
FROM part
""")
def text_functions(spark, sf_dir):
    a = {"A1": txt("p_name"), "B1": txt("p_brand"), "C1": txt("p_type")}
    made = {"l3": "=LEFT(A1,3)", "r2": "=RIGHT(A1,2)", "m4": "=MID(A1,2,4)", "up": "=UPPER(A1)", "sub": '=SUBSTITUTE(A1,"a","@")', "at_e": '=FIND("e",A1)', "joined": '=B1&"-"&C1', "rep": '=REPT("ab",3)'}
    return _read(spark, sf_dir, "part").select("p_partkey", _n("=LEN(A1)", **a).alias("n"), *[_s(f, **a).alias(n) for n, f in made.items()])


@query("""
SELECT o_orderkey, CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS DOUBLE) AS serial, CAST(year(o_orderdate) AS DOUBLE) AS y, CAST(month(o_orderdate) AS DOUBLE) AS m,
       CAST(dayofweek(o_orderdate) + 1 AS DOUBLE) AS weekday, CAST(date_diff('day', DATE '1899-12-30', last_day(CAST(o_orderdate AS DATE))) AS DOUBLE) AS month_end, strftime(o_orderdate, '%Y-%m-%d') AS shown
FROM orders
""")
def date_functions(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").withColumn("serial", F.floor(cells.date_to_serial(F.col("o_orderdate"))).cast("double"))
    a = num("serial")
    return rows.select("o_orderkey", "serial", _n("=YEAR(A1)", A1=a).alias("y"), _n("=MONTH(A1)", A1=a).alias("m"), _n("=WEEKDAY(A1)", A1=a).alias("weekday"), _n("=EOMONTH(A1,0)", A1=a).alias("month_end"), _s('=TEXT(A1,"yyyy-mm-dd")', A1=a).alias("shown"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS total, greatest(l_quantity, l_tax) AS most, CAST((l_quantity > 10 AND l_tax > 0.01) AS VARCHAR) = 'true' AS both_true,
       CASE WHEN l_discount = 0 THEN '#DIV/0!' ELSE 'ok' END AS ratio
FROM lineitem
""")
def range_functions(spark, sf_dir):
    a = {"A1": num("l_quantity"), "A2": num("l_tax"), "B1": num("l_discount")}
    ratio = _formula('=IF(ISERROR(A1/B1),A1/B1,"ok")', **a)
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _n("=SUM(A1:A2)", **a).alias("total"), _n("=MAX(A1:A2)", **a).alias("most"), _formula("=AND(A1>10,A2>0.01)", **a)["b"].alias("both_true"), v.to_json_text(ratio).alias("ratio"))


@query("""
SELECT n_nationkey, format('{:03d}', n_nationkey) AS three, CAST(n_nationkey AS VARCHAR) || '.00' AS money, CASE WHEN n_nationkey = 0 THEN 'none' ELSE CAST(n_nationkey AS VARCHAR) || ' pcs' END AS pieces, CAST(n_nationkey * 100 AS VARCHAR) || '%' AS share
FROM nation
""")
def number_formats(spark, sf_dir):
    n = F.col("n_nationkey").cast("double")
    made = {"three": "000", "money": "#,##0.00", "pieces": '0" pcs";-0;"none"', "share": "0%"}
    return _read(spark, sf_dir, "nation").select("n_nationkey", *[formats.format_number(n, f).alias(k) for k, f in made.items()])


@query("SELECT n_nationkey, chr(65 + n_nationkey) AS letters, CAST(n_nationkey + 1 AS INTEGER) AS back FROM nation")
def cell_addresses(spark, sf_dir):
    letters = cells.number_to_letters(F.col("n_nationkey") + 1)
    return _read(spark, sf_dir, "nation").select("n_nationkey", letters.alias("letters"), cells.letters_to_number(letters).alias("back"))


@query("""
SELECT doc_id, '"' || replace(text, '"', '""') || '"' AS quoted, CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) OR contains(text, chr(13)) OR regexp_matches(text, '^[ \\t\\n\\x0B\\f\\r]') OR regexp_matches(text, '[ \\t\\n\\x0B\\f\\r]$') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field
FROM documents
""")
def csv_fields(spark, sf_dir):
    t = F.col("text")
    return _read(spark, sf_dir, "documents").select("doc_id", tolerant.csv_field(t, quoting="always").alias("quoted"), tolerant.csv_field(t).alias("field"))


@query("""
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS INTEGER) AS n_lines
FROM documents WHERE NOT contains(text, chr(13)) AND text <> ''
""")
def text_lines(spark, sf_dir):
    """Lines of every document at CRLF, LF or CR: one of an empty text, null of a null. The SQL counts line feeds, of texts without CR that are not empty."""
    t = F.col("text")
    return _read(spark, sf_dir, "documents").select("doc_id", F.when(t == "", 1).when(t.isNotNull(), F.size(tolerant.split_lines(t))).alias("n_lines"))


@query("""
SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR) || '.' AS label FROM events
""")
def list_labels(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return _read(spark, sf_dir, "events").select("event_id", "user_id", F.concat(tolerant.list_label(n, "decimal"), F.lit(".")).alias("label"))


@query("""
WITH lines AS (SELECT doc_id, trim(regexp_replace(line, '[0-9]+', '#', 'g')) AS masked FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
n AS (SELECT masked, count(DISTINCT doc_id) AS docs FROM lines WHERE masked <> '' GROUP BY masked)
SELECT masked, docs FROM n WHERE docs >= 3
""")
def repeated_lines(spark, sf_dir):
    """Lines, with digits masked, that three documents or more have."""
    return documents.repeated_lines(_read(spark, sf_dir, "documents"), 3)


@query("""
SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages WHERE regexp_matches(html, '<title>[^<&]*</title>')
""")
def html_titles(spark, sf_dir):
    """Titles without an entity in a plain tag, the pages whose titles SQL can read; ``html_page_titles`` takes all pages."""
    rows = _read(spark, sf_dir, "pages").where(F.col("html").rlike("<title>[^<&]*</title>"))
    return documents.html_titles(rows, "page_id", "html")


@query()
def html_page_titles(spark, sf_dir):
    """The title of every page, entities decoded; empty if it has none or its html is null."""
    return documents.html_titles(_read(spark, sf_dir, "pages"), "page_id", "html")


@query()
def html_nodes(spark, sf_dir):
    """Nodes of every page as a table."""
    return documents.html_nodes(_read(spark, sf_dir, "pages"), "page_id", "html")


@query()
def html_select(spark, sf_dir):
    """Paragraphs and list items of every page, by selector, in document order."""
    return documents.html_select(_read(spark, sf_dir, "pages"), "page_id", "html", "p, ul > li:not(.ad)")


@query()
def html_sanitised(spark, sf_dir):
    return documents.html_sanitised(_read(spark, sf_dir, "pages"), "page_id", "html")


@query()
def markdown_html(spark, sf_dir):
    """Every document read as Markdown and rendered."""
    return documents.markdown_html(_read(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def turn_diffs(spark, sf_dir):
    """Words deleted and inserted between one turn of a conversation and the next."""
    turns = _read(spark, sf_dir, "conversations")
    after = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.select("conv_id", "turn", F.col("text").alias("old"), F.lead("text").over(after).alias("new")).where("new is not null")
    return documents.word_diff(pairs, ["conv_id", "turn"], "old", "new")


@query("""
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL
""")
def hourly_events(spark, sf_dir):
    return _read(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""
SELECT CAST(r1 AS INTEGER) AS r1, CAST(c1 AS INTEGER) AS c1, CAST(r2 AS INTEGER) AS r2, CAST(c2 AS INTEGER) AS c2, l_returnflag AS sheet
FROM (SELECT l_returnflag, min(l_quantity) AS r1, min(l_linenumber) AS c1, max(l_quantity) AS r2, max(l_linenumber) AS c2 FROM lineitem GROUP BY l_returnflag)
""")
def used_ranges(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sheet"), F.col("l_quantity").cast("int").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_tax").alias("value"), F.lit(None).cast("string").alias("formula"))
    return sheets.used_range(rows, "sheet")


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross,
       CASE WHEN l_quantity >= 25 THEN 'bulk' ELSE 'single' END AS size
FROM lineitem
""")
def recalculated_lines(spark, sf_dir):
    """A sheet of dependent formulas, recalculated for every line item."""
    inputs = {"A1": num("l_quantity"), "B1": num("l_extendedprice"), "C1": num("l_discount"), "D1": num("l_tax")}
    formulas = {"G1": '=IF(A1>=25,"bulk","single")', "F1": "=E1*(1+D1)", "E1": "=B1*(1-C1)"}
    rows = recalculation.recalculate(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), inputs, formulas)
    return rows.select("l_orderkey", "l_linenumber", F.col("E1.n").alias("net"), F.col("F1.n").alias("gross"), v.to_json_text(F.col("G1")).alias("size"))
