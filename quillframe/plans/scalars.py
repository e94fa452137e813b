"""Queries of row-wise operators: worksheet functions, formats, tolerant parsing, CSV text, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells, formats, tolerant
from ..functions import values as v
from ..operators import sheets
from .catalog import _formula, _n, _read, _s, num, query, txt


@query("""
SELECT l_orderkey, l_linenumber, CAST(round(x, 1) AS DOUBLE) AS nearest, CAST(trunc(x * 10) / 10 AS DOUBLE) AS cut,
       CAST(ceil(x * 10) / 10 AS DOUBLE) AS up, CAST(round(x / 100, 0) * 100 AS DOUBLE) AS hundreds
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(15, 2)) AS x FROM lineitem)
""")
def rounding(spark, sf_dir):
    a = num("l_extendedprice")
    made = {"nearest": "=ROUND(A1,1)", "cut": "=TRUNC(A1,1)", "up": "=ROUNDUP(A1,1)", "hundreds": "=ROUND(A1,-2)"}
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[_n(f, A1=a).alias(k) for k, f in made.items()])


@query("""
SELECT l_orderkey, l_linenumber, d - 7 * floor(d / 7) AS floored, trunc(d / 7) + 0.0 AS quotient, CAST(sign(d) AS DOUBLE) AS sgn, CAST(ceil(l_quantity / 5) * 5 AS DOUBLE) AS up5, CAST(floor(l_quantity / 5) * 5 AS DOUBLE) AS down5
FROM (SELECT *, l_quantity - 25 AS d FROM lineitem)
""")
def signs_and_multiples(spark, sf_dir):
    a = num("l_quantity")
    made = {"floored": "=MOD(A1-25,7)", "quotient": "=TRUNC((A1-25)/7)", "sgn": "=SIGN(A1-25)", "up5": "=CEILING(A1,5)", "down5": "=FLOOR(A1,5)"}
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[_n(f, A1=a).alias(k) for k, f in made.items()])


@query("""
SELECT p_partkey, round(ln(p_retailprice), 9) AS ln_price, round(log10(p_retailprice), 9) AS log_price, round(pow(p_size, 3), 3) AS cube,
       CASE WHEN p_size < 25 THEN '#NUM!' ELSE 'ok' END AS root, CASE WHEN p_size = 25 THEN '#NUM!' ELSE 'ok' END AS zero_power
FROM part
""")
def powers(spark, sf_dir):
    a = {"A1": num("p_retailprice"), "B1": v.from_column(F.col("p_size").cast("double"), "num")}
    rounded = {"ln_price": ("=LN(A1)", 9), "log_price": ("=LOG(A1)", 9), "cube": ("=B1^3", 3)}
    shown = {"root": '=IF(SQRT(B1-25)>=0,"ok")', "zero_power": '=IF((B1-25)^0=1,"ok")'}
    return _read(spark, sf_dir, "part").select("p_partkey", *[F.round(_n(f, **a), k).alias(n) for n, (f, k) in rounded.items()], *[_s(f, **a).alias(n) for n, f in shown.items()])


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN '#DIV/0!' WHEN l_linenumber = 2 THEN '#VALUE!' ELSE 'fine' END AS first_error,
       CASE WHEN l_linenumber <= 2 THEN 'none' ELSE 'fine' END AS caught, CASE WHEN l_linenumber = 3 THEN 'missing' WHEN l_linenumber > 4 THEN 'many' ELSE 'few' END AS na_caught
FROM lineitem
""")
def error_values(spark, sf_dir):
    a = {"A1": v.from_column(F.col("l_linenumber").cast("double"), "num"), "B1": txt("l_returnflag")}
    first = '=IF(A1=2,IF(1+B1,"no"),IF(1/(A1-1)>=0,"fine"))'
    made = {"first_error": first, "caught": f'=IFERROR({first[1:]},"none")', "na_caught": '=IFNA(IF(A1=3,NA(),IF(A1>4,"many","few")),"missing")'}
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[_s(f, **a).alias(n) for n, f in made.items()])


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'A' WHEN o_totalprice >= 100000 THEN 'B' ELSE 'C' END AS grade,
       CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'other' END AS status,
       CASE month(o_orderdate) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' ELSE 'later' END AS month_name,
       (o_totalprice > 100000) <> (o_orderstatus = 'F') AS either
FROM orders
""")
def conditionals(spark, sf_dir):
    a = {"A1": num("o_totalprice"), "B1": txt("o_orderstatus"), "C1": v.from_column(F.month("o_orderdate").cast("double"), "num")}
    made = {"grade": '=IFS(A1>=200000,"A",A1>=100000,"B",TRUE,"C")', "status": '=SWITCH(B1,"F","filled","O","open","other")', "month_name": '=CHOOSE(MIN(C1,4),"Jan","Feb","Mar","later")'}
    return _read(spark, sf_dir, "orders").select("o_orderkey", *[_s(f, **a).alias(n) for n, f in made.items()], _formula('=XOR(A1>100000,B1="f")', **a)["b"].alias("either"))


@query("""
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS proper,
       CASE WHEN position('A' IN upper(p_name)) = 0 THEN '#VALUE!' ELSE CAST(position('A' IN upper(p_name)) AS VARCHAR) END AS found,
       left(p_name, 1) || '*' || substr(p_name, 4) AS replaced, p_name = lower(p_name) AS same
FROM part
""")
def text_cases(spark, sf_dir):
    a = {"A1": txt("p_name")}
    made = {"proper": "=PROPER(A1)", "found": '=SEARCH("a",A1)', "replaced": '=REPLACE(A1,2,2,"*")'}
    return _read(spark, sf_dir, "part").select("p_partkey", *[_s(f, **a).alias(n) for n, f in made.items()], _formula("=EXACT(A1,LOWER(A1))", **a)["b"].alias("same"))


@query("""
SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey) AS nations FROM nation GROUP BY n_regionkey
""")
def joined_names(spark, sf_dir):
    """TEXTJOIN of short lists in order."""
    return _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(v.to_json_text(sheets.text_join("; ", F.col("n_name"), F.col("n_nationkey"))).alias("nations"))


@query("""
SELECT o_orderkey, CAST(date_diff('day', DATE '1899-12-30', CAST(d + INTERVAL 3 MONTH AS DATE)) AS DOUBLE) AS in_three, CAST(datesub('month', d, DATE '2030-06-15') AS DOUBLE) AS whole_months,
       CAST(date_diff('day', d, DATE '2030-06-15') AS DOUBLE) AS days, CAST(ceil(month(d) / 3) AS DOUBLE) AS quarter
FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)
""")
def date_arithmetic(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").withColumn("serial", F.floor(cells.date_to_serial(F.col("o_orderdate"))).cast("double"))
    a = num("serial")
    made = {"in_three": "=EDATE(A1,3)", "whole_months": '=DATEDIF(A1,DATE(2030,6,15),"M")', "days": "=DAYS(DATE(2030,6,15),A1)", "quarter": "=ROUNDUP(MONTH(A1)/3,0)"}
    return rows.select("o_orderkey", *[_n(f, A1=a).alias(k) for k, f in made.items()])


@query("""
SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') AS day_first, strftime(ts, '%b %y') AS month_name, strftime(ts, '%I:%M %p') AS clock
FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)
""")
def date_formats(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", cells.date_to_serial(F.date_trunc("second", "ts")).alias("serial"))
    made = {"day_first": "dd/mm/yyyy hh:mm:ss", "month_name": "mmm yy", "clock": "hh:mm AM/PM"}
    return rows.select("event_id", *[formats.format_number(F.col("serial"), f).alias(k) for k, f in made.items()])


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN contains(t, '.') THEN rtrim(rtrim(t, '0'), '.') ELSE t END AS shown
FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) AS VARCHAR) AS t FROM lineitem)
""")
def general_numbers(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.general(F.col("l_extendedprice")).alias("shown"))


_AMOUNT = "concat(format_string('%,.2f', o_totalprice), if(o_orderstatus = 'F', '-', ''))"


@query("""
SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(15, 2)) AS amount,
       CAST(o_totalprice AS DECIMAL(15, 2)) AS continental, CAST(o_orderdate AS DATE) AS day, CAST(o_custkey % 60 * 60 + 3600 * 30 AS DOUBLE) AS seconds
FROM orders
""")
def tolerant_fields(spark, sf_dir):
    """Amounts, dates and durations read back from texts that other programs write."""
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_AMOUNT).alias("a"), F.expr("translate(format_string('%,.2f', o_totalprice), ',.', ' ,')").alias("c"), F.date_format("o_orderdate", "yyyyMMdd").alias("d"), F.expr("format_string('30:%02d', o_custkey % 60)").alias("t"))
    amount = lambda c: tolerant.tolerant_decimal(F.col(c)).cast("decimal(15,2)")
    return rows.select("o_orderkey", amount("a").alias("amount"), amount("c").alias("continental"), tolerant.compact_date(F.col("d")).alias("day"), tolerant.duration_seconds(F.col("t")).alias("seconds"))


@query("""
SELECT conv_id, turn, CASE WHEN greatest(s, c, p) = 0 THEN ',' WHEN s = greatest(s, c, p) THEN ';' WHEN c = greatest(s, c, p) THEN ',' ELSE '|' END AS delimiter
FROM (SELECT conv_id, turn, length(l) - length(replace(l, ';', '')) AS s, length(l) - length(replace(l, ',', '')) AS c, length(l) - length(replace(l, '|', '')) AS p
      FROM (SELECT *, regexp_replace(replace(replace(text, chr(9), ' '), ' ', CASE WHEN turn % 2 = 0 THEN ';' ELSE ' ' END), '"[^"]*"?', '', 'g') AS l FROM conversations))
""")
def delimiters(spark, sf_dir):
    text = F.when(F.col("turn") % 2 == 0, F.replace(F.replace("text", F.lit("\t"), F.lit(" ")), F.lit(" "), F.lit(";"))).otherwise(F.replace("text", F.lit("\t"), F.lit(" ")))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", tolerant.delimiter_of(text).alias("delimiter"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN '''' || t ELSE t END AS safe
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '=' || event_type WHEN 1 THEN ' @' || event_type WHEN 2 THEN '-' || CAST(event_id AS VARCHAR) ELSE event_type END AS t FROM events)
""")
def neutralised_fields(spark, sf_dir):
    """Fields that a spreadsheet would run as a formula get an apostrophe; plain numbers do not."""
    k, kind = F.col("event_id") % 4, F.col("event_type")
    text = F.when(k == 0, F.concat(F.lit("="), kind)).when(k == 1, F.concat(F.lit(" @"), kind)).when(k == 2, F.concat(F.lit("-"), F.col("event_id").cast("string"))).otherwise(kind)
    return _read(spark, sf_dir, "events").select("event_id", tolerant.neutralised(text).alias("safe"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16-le' ELSE 'windows-1252' END AS encoding FROM documents WHERE text IS NOT NULL
""")
def encodings(spark, sf_dir):
    raw, k = F.encode("text", "UTF-8"), F.col("doc_id") % 4
    content = F.when(k == 0, raw).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw)).when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.concat(F.unhex(F.lit("E920")), raw))
    return _read(spark, sf_dir, "documents").where("text is not null").select("doc_id", tolerant.encoding_of(content).alias("encoding"))


@query("""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[ \\t\\n\\x0B\\f\\r.,;:!?()\\[\\]{}"'']|[^ \\t\\n\\x0B\\f\\r.,;:!?()\\[\\]{}"'']+')) AS INTEGER) AS n_pieces FROM documents WHERE text IS NOT NULL
""")
def pieces_of_words(spark, sf_dir):
    return _read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(tolerant.word_pieces(F.col("text"))).alias("n_pieces"))


@query("""
WITH n AS (SELECT p_partkey, CAST(p_size AS INTEGER) AS k FROM part)
SELECT p_partkey, repeat('l', k // 50) || repeat('xl', k % 50 // 40) || repeat('x', k % 50 % 40 // 10) || repeat('ix', k % 10 // 9) || repeat('v', k % 10 % 9 // 5) || repeat('iv', k % 10 % 9 % 5 // 4) || repeat('i', k % 10 % 9 % 5 % 4) AS roman,
       repeat(chr(97 + (k - 1) % 26), (k - 1) // 26 + 1) AS letter,
       CAST(k AS VARCHAR) || CASE WHEN k % 100 BETWEEN 11 AND 13 THEN 'th' WHEN k % 10 = 1 THEN 'st' WHEN k % 10 = 2 THEN 'nd' WHEN k % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
       CASE WHEN k < 10 THEN '0' ELSE '' END || CAST(k AS VARCHAR) AS padded
FROM n
""")
def label_formats(spark, sf_dir):
    kinds = {"roman": "lowerRoman", "letter": "lowerLetter", "ordinal": "ordinal", "padded": "decimalZero"}
    return _read(spark, sf_dir, "part").select("p_partkey", *[tolerant.list_label(F.col("p_size"), f).alias(k) for k, f in kinds.items()])


@query("""
SELECT o_orderkey, CAST(299 * r + 587 * g + 114 * b + 500 AS BIGINT) // 1000 AS grey, upper(printf('%02x%02x%02x', r, g, b)) AS rgb
FROM (SELECT o_orderkey, CAST(o_orderkey % 256 AS INTEGER) AS r, CAST(o_custkey % 256 AS INTEGER) AS g, CAST(day(o_orderdate) AS INTEGER) AS b FROM orders)
""")
def colours(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 256).alias("r"), (F.col("o_custkey") % 256).alias("g"), F.dayofmonth("o_orderdate").alias("b"))
    return rows.select("o_orderkey", tolerant.luma(F.col("r"), F.col("g"), F.col("b")).cast("long").alias("grey"), tolerant.colour(F.format_string("#ff%02x%02x%02x", "r", "g", "b")).alias("rgb"))


@query("""
WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, CAST(greatest(8, least(80, max(length(text)))) AS INTEGER) AS width FROM t GROUP BY conv_id
""")
def fitted_columns(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("col"), F.col("text").alias("shown"))
    return sheets.column_widths(rows).select(F.col("col").alias("conv_id"), "width")
