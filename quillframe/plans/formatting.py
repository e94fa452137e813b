"""Queries of styles, wrapped lines, text order and records read as cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import conversions, styles
from .catalog import _n, _read, num, query


@query("""
WITH RECURSIVE s AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 2 THEN p_partkey // 2 END AS up, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS size, CASE WHEN p_partkey % 4 = 1 THEN p_brand END AS colour FROM part),
chain(id, above, depth, size, colour) AS (
  SELECT id, up, 0, size, colour FROM s
  UNION ALL SELECT c.id, s.up, c.depth + 1, coalesce(c.size, s.size), coalesce(c.colour, s.colour) FROM chain c JOIN s ON c.above = s.id WHERE c.depth < 31)
SELECT id, CAST(arg_max(size, depth) AS VARCHAR) AS size, arg_max(colour, depth) AS colour FROM (SELECT id, depth, coalesce(size, -1) AS size, coalesce(colour, '') AS colour FROM chain) GROUP BY id
""")
def style_chains(spark, sf_dir):
    """Each part is a style based on the one of half its number; -1 and an empty text stand for what no style of a chain sets."""
    k = F.col("p_partkey")
    pairs = F.map_from_entries(F.array_compact(F.array(F.when(k % 3 == 0, F.struct(F.lit("size").alias("k"), F.col("p_size").cast("string").alias("v"))), F.when(k % 4 == 1, F.struct(F.lit("colour").alias("k"), F.col("p_brand").alias("v"))))))
    table = _read(spark, sf_dir, "part").select(F.lit(1).alias("doc"), k.alias("style"), F.when(k >= 2, F.floor(k / 2)).alias("based_on"), pairs.alias("props"))
    found = styles.resolved_styles(table, ["doc"])
    shown = lambda name, none: F.coalesce(F.try_element_at("props", F.lit(name)), F.lit(none)).alias(name)
    return found.select(F.col("style").cast("long").alias("id"), shown("size", "-1"), shown("colour", ""))


@query("""
WITH f AS (SELECT o_custkey, o_orderstatus AS weight, o_orderpriority AS colour, min(o_orderkey) AS first_at FROM orders GROUP BY ALL)
SELECT o_custkey, weight, colour, 'c' || CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY first_at, weight, colour) AS VARCHAR) AS class FROM f
""")
def shared_classes(spark, sf_dir):
    """Equal formats of a customer's orders share a class, numbered by first use."""
    runs = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("weight"), F.col("o_orderpriority").alias("colour"))
    return styles.style_classes(runs, ["o_custkey"], "o_orderkey", ["weight", "colour"])


@query(r"""
WITH w AS (SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(text, '[ \t\r\n\x0B\f]+'), lambda x: x <> ''), lambda x: {'n': 1, 'used': len(x) + len(regexp_replace(x, '[^mw]', '', 'g')), 'most': 0}) AS words FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN len(words) > 0 THEN list_reduce(words, lambda a, x: CASE WHEN a.used + 1 + x.used <= 48 THEN {'n': a.n, 'used': a.used + 1 + x.used, 'most': 0} ELSE {'n': a.n + 1, 'used': x.used, 'most': 0} END) END AS x FROM w)
SELECT conv_id, turn, CAST(coalesce(x.n, 0) AS INTEGER) AS n_lines, CAST(coalesce(x.used, 0) AS DOUBLE) AS last_width FROM r
""")
def wrapped_lines(spark, sf_dir):
    """Turns wrapped at 48 units, where m and w are two wide."""
    measure = styles.table_width({"m": 2.0, "w": 2.0}, 1.0)
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(styles.wrapped(F.col("text"), 48.0, measure), F.array().cast("array<string>")).alias("lines"))
    last = F.coalesce(measure(F.get("lines", F.size("lines") - 1)), F.lit(0.0))
    return rows.select("conv_id", "turn", F.size("lines").alias("n_lines"), last.alias("last_width"))


@query("""
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY upper(shown), p_partkey) AS INTEGER) AS place FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS shown FROM part)
""")
def text_order(spark, sf_dir):
    """Names in the order of worksheets, without regard to case."""
    shown = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(v.sorting(shown)["u"], "p_partkey"))
    return _read(spark, sf_dir, "part").select("p_partkey", place.alias("place"))


@query("""
SELECT o_orderkey, i AS col, CASE WHEN i IN (1, 3) THEN 'num' ELSE 'text' END AS kind, CASE i WHEN 1 THEN CAST(o_orderkey AS DOUBLE) WHEN 3 THEN CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS DOUBLE) END AS num,
       CASE i WHEN 2 THEN o_orderstatus WHEN 4 THEN '1e999' WHEN 5 THEN '' END AS text
FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS i)
""")
def record_cells(spark, sf_dir):
    """Fields of records as cells of a sheet: numbers where a field is a finite number."""
    fields = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_totalprice").cast("decimal(15,2)").cast("string"), F.lit("1e999"), F.lit(""))
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("row"), fields.alias("fields"))
    return conversions.record_cells(rows, ["o_orderkey"]).select("o_orderkey", "col", "kind", "num", "text")


@query("""
SELECT l_orderkey, l_linenumber, abs(q - 25) + abs(n - 4) AS apart, CAST(floor(p / 1000) + floor(q / 10) AS DOUBLE) AS floors, -(q + n) AS negated, CAST((q > 10) AS INTEGER) + CAST((n > 2) AS INTEGER) + 0e0 AS flags
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, CAST(l_linenumber AS DOUBLE) AS n, l_extendedprice AS p FROM lineitem)
""")
def lifted_functions(spark, sf_dir):
    """Scalar functions and signs over ranges, cell by cell."""
    a = {"A1": num("l_quantity"), "A2": v.from_column(F.col("l_linenumber").cast("double"), "num"), "B1": num("l_extendedprice"), "B2": num("l_quantity")}
    made = {"apart": "=SUMPRODUCT(ABS(A1:A2-{25;4}))", "floors": "=SUMPRODUCT(INT(B1:B2/{1000;10}))", "negated": "=SUM(-A1:A2)", "flags": "=SUMPRODUCT(IF(A1:A2>{10;2},1,0))"}
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[_n(f, **a).alias(n) for n, f in made.items()])
