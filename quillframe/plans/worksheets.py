"""Queries of worksheet functions by family: information, conditional counts, texts, clock times, places in a sheet, lookups in ranges, whole columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import cells
from ..functions import values as v
from ..functions.worksheet import Context, compile_formula
from ..operators import ranges
from .catalog import _formula, _n, _read, _s, num, query, txt


def _whole(c):
    return v.from_column(c.cast("double"), "num")


def _flag(text: str, **cells_):
    return _formula(text, **cells_)["b"]


@query("""
SELECT o_orderkey, k IS NULL AS blank, k IS NOT NULL AS number, true AS has_text, k IS NOT NULL AS not_text, o_totalprice > 100000 AS logical, k IS NULL OR k = 0 AS failed,
       o_orderstatus = 'F' AS missing, coalesce(k, 0) % 2 = 0 AS even, coalesce(k, 0) % 2 = 1 AS odd, NOT o_totalprice > 100000 AS no, o_orderstatus = 'F' OR o_totalprice > 100000 AS either
FROM (SELECT *, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 7 END AS k FROM orders)
""")
def is_family(spark, sf_dir):
    """The kinds of a number that may be blank, a text, a comparison and errors."""
    k = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 7)
    a = {"A1": _whole(k), "B1": txt("o_orderstatus"), "C1": num("o_totalprice")}
    made = {
        "blank": "=ISBLANK(A1)", "number": "=ISNUMBER(A1)", "has_text": "=ISTEXT(B1)", "not_text": "=IF(ISBLANK(A1),ISNONTEXT(B1),ISNONTEXT(A1))", "logical": "=AND(ISLOGICAL(C1>100000),C1>100000)",
        "failed": "=ISERR(1/A1)", "missing": '=ISNA(IF(B1="F",NA(),1))', "even": "=ISEVEN(A1)", "odd": "=ISODD(A1)", "no": "=NOT(C1>100000)", "either": '=OR(B1="f",C1>100000,FALSE())',
    }
    return _read(spark, sf_dir, "orders").select("o_orderkey", *[_flag(f, **a).alias(n) for n, f in made.items()])


@query("""
SELECT l_orderkey, l_linenumber, CAST(3 + CASE WHEN l_tax > 0.03 THEN 1 ELSE 0 END AS DOUBLE) AS filled, CAST(CASE WHEN l_tax > 0.03 THEN 0 ELSE 1 END AS DOUBLE) AS blanks,
       CAST(CAST(q > 4 AS INTEGER) + CAST(n > 4 AS INTEGER) AS DOUBLE) AS above, CAST(CAST(q > 4 AND l_returnflag <> 'N' AS INTEGER) + CAST(n > 4 AS INTEGER) AS DOUBLE) AS both_met,
       CASE WHEN q > 4 AND l_returnflag = 'R' THEN q ELSE 0 END AS summed, CASE WHEN q > 4 AND n > 4 THEN (q + n) / 2 WHEN q > 4 THEN q WHEN n > 4 THEN n ELSE -1 END AS mean_above,
       CASE WHEN l_returnflag = 'R' THEN q ELSE -1 END AS mean_met, q * n + n * q AS products, greatest(q, n) AS most, least(q, n) AS fewest
FROM (SELECT *, l_quantity AS q, CAST(l_linenumber AS DOUBLE) AS n FROM lineitem)
""")
def conditional_counts(spark, sf_dir):
    """Counts and sums with criteria over a row's ranges; A3 is blank or a number by the tax."""
    a = {"A1": num("l_quantity"), "A2": _whole(F.col("l_linenumber")), "B1": txt("l_returnflag"), "B2": txt("l_linestatus")}
    b = {**a, "A3": v.from_column(F.when(F.col("l_tax") > 0.03, F.col("l_tax")), "num"), "A4": txt("l_returnflag"), "C1": a["A2"], "C2": a["A1"]}
    made = {
        "filled": "=COUNTA(A1:A4)", "blanks": "=COUNTBLANK(A1:A4)", "above": '=COUNTIF(A1:A2,">4")', "both_met": '=COUNTIFS(A1:A2,">4",B1:B2,"<>n")', "summed": '=SUMIFS(A1:A2,A1:A2,">4",B1:B2,"R")', "mean_above": '=IFERROR(AVERAGEIF(A1:A2,">4"),-1)',
        "mean_met": '=IFERROR(AVERAGEIFS(A1:A2,B1:B2,"r"),-1)', "products": "=SUMPRODUCT(A1:A2,C1:C2)", "most": "=MAX(A1:A2)", "fewest": "=MIN(A1:A2)",
    }
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[_n(f, **b).alias(n) for n, f in made.items()])


@query("""
SELECT p_partkey, chr(65 + p_size % 26) AS letter, CAST(ascii(p_name) AS DOUBLE) AS code, p_brand || '/' || CAST(p_size AS VARCHAR) AS joined, p_brand || p_type || 'TRUE' AS chained,
       p_brand || ', ' || p_type AS listed, trim(regexp_replace(p_type, ' +', ' ', 'g')) AS trimmed, CAST(p_size AS DOUBLE) + 0.5 AS parsed, p_name AS kept, '' AS dropped
FROM part
""")
def text_building(spark, sf_dir):
    a = {"A1": txt("p_name"), "B1": txt("p_brand"), "C1": txt("p_type"), "D1": _whole(F.col("p_size"))}
    made = {
        "letter": "=CHAR(65+MOD(D1,26))", "joined": '=CONCATENATE(B1,"/",D1)', "chained": "=CONCAT(B1:C1,TRUE())", "listed": '=TEXTJOIN(", ",TRUE,B1:C1,"")',
        "trimmed": '=TRIM("  "&SUBSTITUTE(C1," ","   ")&" ")', "kept": "=T(A1)", "dropped": "=T(D1)",
    }
    numbers = {"code": "=CODE(A1)", "parsed": '=VALUE(D1&".5")'}
    return _read(spark, sf_dir, "part").select("p_partkey", *[_s(f, **a).alias(n) for n, f in made.items()], *[_n(f, **a).alias(n) for n, f in numbers.items()])


@query("""
SELECT event_id, CAST(hour(t) AS DOUBLE) AS h, CAST(minute(t) AS DOUBLE) AS m, CAST(second(t) AS DOUBLE) AS s, CAST(day(t) AS DOUBLE) AS d,
       CAST(hour(t) * 3600 + minute(t) * 60 + second(t) AS BIGINT) AS clock, CAST(date_diff('day', CAST(t AS DATE), DATE '2030-06-15') AS DOUBLE) AS days_left, true AS later
FROM (SELECT event_id, date_trunc('second', ts) AS t FROM events)
""")
def times_of_day(spark, sf_dir):
    """Parts of a serial, a time put together again, and a clock that stands at noon of 15 June 2030."""
    rows = _read(spark, sf_dir, "events").select("event_id", cells.date_to_serial(F.date_trunc("second", "ts")).alias("serial"))
    at = Context({"A1": num("serial")}, dt.datetime(2030, 6, 15, 12))
    made = {"h": "=HOUR(A1)", "m": "=MINUTE(A1)", "s": "=SECOND(A1)", "d": "=DAY(A1)", "days_left": "=TODAY()-INT(A1)"}
    clock = compile_formula("=ROUND(TIME(HOUR(A1),MINUTE(A1),SECOND(A1))*86400,0)", at)["n"].cast("long")
    return rows.select("event_id", *[compile_formula(f, at)["n"].alias(n) for n, f in made.items()], clock.alias("clock"), compile_formula("=NOW()-TODAY()=0.5", at)["b"].alias("later"))


@query("""
SELECT p_partkey, round(exp(p_size / 10.0), 6) AS e, round(log10(p_retailprice), 9) AS lg, round(pi() * p_size * p_size, 6) AS area, CAST(p_size * p_size AS DOUBLE) AS squared,
       CAST(trunc(p_retailprice / 10) * 10 AS DOUBLE) AS tens, CAST(7 AS DOUBLE) AS at_row, CAST(3 AS DOUBLE) AS at_column, CAST(p_size * 12 AS DOUBLE) AS size, CAST(2 + 5 AS DOUBLE) AS of_reference
FROM part
""")
def powers_and_places(spark, sf_dir):
    at = Context({"A1": num("p_retailprice"), "B1": _whole(F.col("p_size"))}, row=7, column=3)
    rounded = {"e": ("=EXP(B1/10)", 6), "lg": ("=LOG10(A1)", 9), "area": ("=PI()*POWER(B1,2)", 6)}
    made = {"squared": "=POWER(B1,2)", "tens": "=ROUNDDOWN(A1,-1)", "at_row": "=ROW()", "at_column": "=COLUMN()", "size": "=B1*ROWS(D1:F4)*COLUMNS(D1:F4)", "of_reference": "=ROW(E2)+COLUMN(E2)"}
    return _read(spark, sf_dir, "part").select("p_partkey", *[F.round(compile_formula(f, at)["n"], k).alias(n) for n, (f, k) in rounded.items()], *[compile_formula(f, at)["n"].alias(n) for n, f in made.items()])


@query("""
SELECT o_orderkey, CASE WHEN m < 4 THEN 'first' WHEN m < 7 THEN 'second' WHEN m < 10 THEN 'third' ELSE 'fourth' END AS quarter, CASE WHEN o_orderpriority LIKE '1%' THEN 'now' WHEN o_orderpriority LIKE '2%' THEN 'soon' ELSE '#N/A' END AS urgency,
       CASE WHEN m > 9 THEN '#N/A' WHEN m > 6 THEN '1' WHEN m > 3 THEN '2' ELSE '3' END AS falling, CASE WHEN m > 3 THEN '#REF!' ELSE CAST(m * 10 AS VARCHAR) END AS cell
FROM (SELECT *, month(o_orderdate) AS m FROM orders)
""")
def range_lookups(spark, sf_dir):
    """HLOOKUP by steps, VLOOKUP by wildcard key, MATCH in a falling range, INDEX beyond its range."""
    a = {"A1": _whole(F.month("o_orderdate")), "B1": txt("o_orderpriority")}
    made = {
        "quarter": '=HLOOKUP(A1,{1,4,7,10;"first","second","third","fourth"},2)', "urgency": '=IF(LEFT(B1,1)="1",VLOOKUP("1*",{"1-urgent","now";"2-high","soon"},2,FALSE),VLOOKUP(LEFT(B1,1)&"-high",{"1-urgent","now";"2-high","soon"},2,FALSE))',
        "falling": "=MATCH(A1,{9,6,3},-1)", "cell": "=INDEX({10;20;30},A1)",
    }
    return _read(spark, sf_dir, "orders").select("o_orderkey", *[_s(f, **a).alias(n) for n, f in made.items()])


@query("""
WITH o AS (SELECT o_orderkey // 1000000 AS book, o_totalprice AS p, o_orderstatus AS s, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END AS c, o_orderkey % 1000000 + 1 AS r FROM orders)
SELECT book, round(sum(p), 2) AS total, round(max(p) - min(p), 2) AS spread, round(avg(p), 6) AS mean, CAST(1048576 - count(c) AS DOUBLE) AS blanks, CAST(count(p) + count(s) + count(c) AS DOUBLE) AS filled,
       CAST(count(*) FILTER (p > 100000 AND s = 'F') AS DOUBLE) AS large, round(coalesce(sum(p) FILTER (s = 'F'), 0), 2) AS filled_total, CAST(1048576 - count(*) FILTER (s = 'F') AS DOUBLE) AS not_f,
       CASE WHEN count(c) = 0 THEN -1 ELSE round(avg(p) FILTER (c > 50), 6) END AS mean_met, round(coalesce(sum(p * c) FILTER (c IS NOT NULL), 0), -3) AS products, round(sum(p) * 1.25, 2) AS rated, coalesce(sum(p) FILTER (r <= 500), 0) > 0 AS any_first
FROM o GROUP BY book
""")
def whole_columns(spark, sf_dir):
    """Formulas over whole columns of sheets of a million rows, one of them of another sheet."""
    o = _read(spark, sf_dir, "orders")
    stored = lambda col, kind, num, text: F.struct(F.lit("Orders").alias("sheet"), F.lit(col).alias("col"), F.lit(kind).alias("kind"), num.cast("double").alias("num"), text.alias("text"))
    none = F.lit(None).cast("string")
    row = [stored(1, "num", F.col("o_totalprice"), none), stored(2, "text", F.lit(None), F.col("o_orderstatus")), F.when(F.col("o_custkey") % 4 != 0, stored(3, "num", F.col("o_custkey"), none))]
    book = F.floor(F.col("o_orderkey") / 1_000_000).alias("book")
    cells_ = o.select(book, (F.col("o_orderkey") % 1_000_000 + 1).alias("row"), F.explode(F.array_compact(F.array(*row))).alias("x")).select("book", "row", "x.*")
    rates = o.select(book).distinct().select("book", F.lit(2).cast("long").alias("row"), F.lit("Rates").alias("sheet"), F.lit(1).alias("col"), F.lit("num").alias("kind"), F.lit(1.25).alias("num"), none.alias("text"))
    every = cells_.unionByName(rates).withColumn("bool", F.lit(None).cast("boolean")).withColumn("err", none)
    made = {
        "total": "=ROUND(SUM(A:A),2)", "spread": "=ROUND(MAX(A:A)-MIN(A:A),2)", "mean": "=ROUND(AVERAGE(A:A),6)", "blanks": "=COUNTBLANK(C1:C1048576)", "filled": "=COUNTA(A:C)", "large": '=COUNTIFS(A:A,">100000",B:B,"f")',
        "filled_total": '=ROUND(SUMIF(B:B,"F",A:A),2)', "not_f": '=COUNTIF(B:B,"<>F")', "mean_met": '=IF(COUNT(C:C)=0,-1,ROUND(AVERAGEIFS(A:A,C:C,">50"),6))', "products": "=ROUND(SUMPRODUCT(A:A,C:C),-3)", "rated": "=ROUND(SUM(A:A)*Rates!A2,2)",
    }
    found = ranges.evaluate(every, ["book"], made | {"any_first": "=SUM(A1:A500)>0"}, "Orders")
    return found.select("book", *[F.col(f"{n}.n").alias(n) for n in made], F.col("any_first.b").alias("any_first"))
