"""Conversions between tables of cells, paragraphs and nodes, and text; reading order of page blocks; gap messages.

What becomes one text (a sheet's CSV or HTML, a document's Markdown) is one row by nature and bounded by
the limits of its file; the sheet's cap is checked before anything is laid out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tolerant import csv_field, neutralised
from ..functions.values import let

MAX_CELLS = 100_000_000
#: Rows of a used range that are laid out from one row.
ROWS_AT_ONCE = 1 << 16


def grid(cells: DataFrame, keys: list[str], most: int | None = MAX_CELLS) -> DataFrame:
    """cells (keys, row, col, shown, kind) with every cell of each used range, empty ones included: keys, row and ``line``, the array of (col, shown, kind) in order.

    A used range of more than ``most`` cells (None: any) raises before it is laid out. Rows are made of the cells they
    have, so only the keys and rows are exchanged, never empty cells. Null keys are a sheet of their own; a
    cell without a row or column lies in no line, though what it has of the two counts for the range.
    """
    used = cells.groupBy(*keys).agg(F.min("row").cast("long").alias("_r1"), F.max("row").cast("long").alias("_r2"), F.min("col").alias("_c1"), F.max("col").alias("_c2")).where(F.col("_c1").isNotNull())
    if most is not None:
        size = (F.col("_r2") - F.col("_r1") + 1) * (F.col("_c2") - F.col("_c1") + 1)
        used = used.withColumn("_c2", F.when(size > most, F.raise_error(F.concat(F.lit("a used range of more cells than allowed: "), size.cast("string"))).cast("int")).otherwise(F.col("_c2")))
    # Spans are dealt out before they become rows: a large sheet is not laid out by one task. A given number of partitions is kept.
    spans = used.select(*keys, "_c1", "_c2", "_r2", F.explode(F.sequence("_r1", "_r2", F.lit(ROWS_AT_ONCE).cast("long"))).alias("_at"))
    spans = spans.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_at")
    last = F.col("_at") + F.least(F.col("_r2") - F.col("_at"), F.lit(ROWS_AT_ONCE - 1))
    row_type = dict(cells.dtypes)["row"]
    rows = spans.select(*keys, F.explode(F.sequence("_at", last).cast(f"array<{row_type}>")).alias("row"), "_c1", "_c2", F.lit(None).alias("_cell"))
    had = cells.where(F.col("row").isNotNull() & F.col("col").isNotNull()).select(*keys, "row", F.lit(None).alias("_c1"), F.lit(None).alias("_c2"), F.struct("col", F.struct(F.coalesce("shown", F.lit("")).alias("shown"), "kind")).alias("_cell"))
    lines = rows.union(had).groupBy(*keys, "row").agg(F.max("_c1").alias("_c1"), F.max("_c2").alias("_c2"), F.map_from_entries(F.collect_list("_cell")).alias("_had"))
    empty = F.struct(F.lit("").alias("shown"), F.lit("blank").alias("kind"))
    line = F.transform(F.sequence("_c1", "_c2"), lambda c: let(F.coalesce(F.try_element_at("_had", c), empty), lambda x: F.struct(c.alias("col"), x["shown"].alias("shown"), x["kind"].alias("kind"))))
    return lines.select(*keys, "row", line.alias("line"))


def _whole(rows: DataFrame, keys: list[str], position: str, text: Column, joiner: str, out: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), text.alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), joiner).alias(out))


def sheet_csv(cells: DataFrame, keys: list[str], delimiter: str = ",", neutralise: bool = True, most: int | None = MAX_CELLS, quoting: str = "needed") -> DataFrame:
    """keys, row and ``record``: a sheet's used range as CSV records, cells as shown. Texts that would run as formulas are neutralised, numbers never; fields are quoted as in ``csv_field``."""

    def field(x: Column) -> Column:
        shown = F.when(x["kind"] == "text", neutralised(x["shown"])).otherwise(x["shown"]) if neutralise else x["shown"]
        return csv_field(shown, delimiter, quoting)

    return grid(cells, keys, most).select(*keys, "row", F.array_join(F.transform("line", field), delimiter).alias("record"))


def record_cells(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, col, kind, num, text: the array ``fields`` of each record as cells. A field that is a plain finite number (digits with a point, a sign, an exponent) is one, any other a text; a null is empty text, a record without fields has no cell."""
    field = F.coalesce("field", F.lit(""))
    number = F.when(field.rlike("^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), field.try_cast("double"))
    finite = F.when(F.abs(number) < F.lit(float("inf")), number)
    rows = records.select(*keys, "row", F.posexplode("fields").alias("at", "field"))
    return rows.select(*keys, "row", (F.col("at") + 1).alias("col"), F.when(finite.isNotNull(), "num").otherwise("text").alias("kind"), finite.alias("num"), F.when(finite.isNull(), field).alias("text"))


def _escaped(c: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def sheet_html(cells: DataFrame, keys: list[str], most: int = MAX_CELLS) -> DataFrame:
    """keys and ``html``: a table of a sheet's used range, numbers and dates on the right."""
    cell = lambda x: F.concat(F.when(x["kind"] == "num", F.lit('<td class="n">')).otherwise(F.lit("<td>")), _escaped(x["shown"]), F.lit("</td>"))
    line = F.concat(F.lit("<tr>"), F.array_join(F.transform("line", cell), ""), F.lit("</tr>"))
    made = _whole(grid(cells, keys, most), keys, "row", line, "", "_rows")
    return made.select(*keys, F.concat(F.lit("<table>"), "_rows", F.lit("</table>")).alias("html"))


def markdown_escape(s: Column) -> Column:
    """Text that Markdown shows as it is, at the start of a line: blanks before it go, line ends become blanks."""
    flat = F.regexp_replace(F.regexp_replace(s, "^[ \\t]+", ""), "[\\r\\n]", " ")
    marked = F.regexp_replace(flat, "([\\\\`*_\\[\\]<>&|~])", "\\\\$1")
    return F.regexp_replace(F.regexp_replace(marked, "^([#+=-])", "\\\\$1"), "^([0-9]+)([.)])", "$1\\\\$2")


def document_markdown(paragraphs: DataFrame, key: str = "path") -> DataFrame:
    """key and ``markdown`` of the main parts' paragraphs: headings by outline level or a style named Heading (a # at the end escaped), list items by level, other text escaped; empty paragraphs are left out."""
    main = paragraphs.where(F.col("part").endswith("document.xml") & (F.trim("text") != ""))
    named = F.regexp_extract(F.coalesce("style", F.lit("")), "^Heading ?([1-6])$", 1)
    level = F.coalesce(F.when(F.col("outline").between(0, 5), F.col("outline") + 1), F.when(named != "", named.cast("int")))
    shown = F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.regexp_replace(markdown_escape(F.col("text")), "(?<!\\\\)#$", "\\\\#"))).when(F.col("list_level").isNotNull(), F.concat(F.repeat(F.lit("  "), F.col("list_level")), F.lit("- "), markdown_escape(F.col("text")))).otherwise(markdown_escape(F.col("text")))
    return _whole(main, [key], "para_ix", shown, "\n\n", "markdown")


def contents_rows(paragraphs: DataFrame, deepest: int = 3) -> DataFrame:
    """Rows of a table of contents: path, para_ix, level from 1 and text of headings down to ``deepest``."""
    named = F.regexp_extract(F.coalesce("style", F.lit("")), "^Heading ?([1-9])$", 1)
    level = F.coalesce(F.col("outline") + 1, F.when(named != "", named.cast("int")))
    return paragraphs.select("path", "para_ix", level.alias("level"), F.trim("text").alias("text")).where(F.col("level").between(1, deepest) & (F.col("text") != ""))


def gap_messages(gaps: DataFrame, templates: DataFrame, culture: str = "en") -> DataFrame:
    """gaps (key columns, code, arguments) with ``message``: the template (code, culture, template) of the culture, English where it has none, with {0}, {1} ... replaced; null for an unknown code. Codes are few; the join is an equi-join on them."""
    picked = templates.where(F.col("culture").isin(culture, "en")).groupBy("code").agg(F.max_by("template", (F.col("culture") == culture).cast("int")).alias("_template"))
    # A value is never searched for places again: the template is cut at its places first.
    pieces = F.regexp_extract_all("_template", F.lit("\\{[0-9]\\}|[^{]+|\\{"), F.lit(0))
    filled = F.transform(pieces, lambda p: F.when(p.rlike("^\\{[0-9]\\}$"), F.coalesce(F.get("arguments", F.substring(p, 2, 1).try_cast("int")), F.lit(""))).otherwise(p))
    return gaps.join(picked, "code", "left").withColumn("message", F.array_join(filled, "")).drop("_template")


def gap_union(described: DataFrame, key: str, position: str) -> DataFrame:
    """key and message, each once, in the place of its first report."""
    return described.groupBy(key, "message").agg(F.min(position).alias(position))


def pdf_date(s: Column) -> Column:
    """Timestamp (UTC) of D:YYYYMMDDHHmmSSOHH'mm', all after the year optional and held within bounds; null without a year or for a day that its month lacks."""

    def made(t: Column) -> Column:
        part = lambda at, n, d: F.coalesce(F.when(F.substring(t, at, n).rlike(f"^[0-9]{{{n}}}$"), F.substring(t, at, n).cast("int")), F.lit(d))
        clamp = lambda x, a, b: F.least(F.greatest(x, F.lit(a)), F.lit(b))
        year = part(1, 4, 0)
        day = F.try_to_date(F.format_string("%04d-%02d-%02d", year, clamp(part(5, 2, 1), 1, 12), clamp(part(7, 2, 1), 1, 31)), "yyyy-MM-dd")
        sign = F.substring(t, 15, 1)
        offset = F.when(sign.isin("+", "-"), (part(16, 2, 0) * 3600 + part(19, 2, 0) * 60) * F.when(sign == "-", -1).otherwise(1)).otherwise(0)
        seconds = F.unix_date(day).cast("long") * 86_400 + clamp(part(9, 2, 0), 0, 23) * 3600 + clamp(part(11, 2, 0), 0, 59) * 60 + clamp(part(13, 2, 0), 0, 59) - offset
        return F.when(year >= 1, F.timestamp_seconds(seconds))

    return let(F.regexp_replace(F.trim(s), "^D:", ""), made)


def reading_order(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """blocks (keys, left, bottom, right, top and others) with ``place`` from 1 in reading order: cut at white bands, the wider kind first, rows before columns on a tie; without a band, top first, then left.

    A page's blocks are gathered in a row; a batch of pages goes to Python, and only with its boxes.
    """
    order = F.pandas_udf(_places, "array<int>")
    box = ["left", "bottom", "right", "top"]
    rest = [c for c in blocks.columns if c not in keys and c not in box]
    page = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*box, *rest))).alias("_blocks"))
    sides = [F.col("_blocks")[c].cast("array<double>") for c in box]
    each = page.withColumn("_places", order(*sides)).select(*keys, F.posexplode("_blocks").alias("_at", "_block"), "_places")
    return each.select(*keys, "_block.*", F.get("_places", F.col("_at")).alias("place")).select(*blocks.columns, "place")


def _places(left: pd.Series, bottom: pd.Series, right: pd.Series, top: pd.Series) -> pd.Series:
    return pd.Series([_page_places(*(list(x) for x in page)) for page in zip(left, bottom, right, top, strict=True)])


def _page_places(left: list[float], bottom: list[float], right: list[float], top: list[float]) -> list[int]:
    x0, x1 = np.array(left, float), np.array(right, float)
    depth0, depth1 = (np.max(top, initial=0.0) - np.array(c, float) for c in (top, bottom))
    parts, whole = [np.arange(len(x0))], []
    while len(whole) != len(parts):  # each round cuts every part that has a band, where it stands
        whole = parts
        parts = [p for part in whole for p in _cut(part, depth0, depth1, x0, x1)]
    order = np.concatenate([part[np.lexsort((part, x0[part], depth0[part]))] for part in parts])
    places = np.empty(len(order), int)
    places[order] = np.arange(1, len(order) + 1)
    return places.tolist()


def _cut(part: np.ndarray, depth0: np.ndarray, depth1: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> list[np.ndarray]:
    """A part at its white bands, rows or columns, whichever has the widest one; rows on a tie."""
    rows, row_band = _at_bands(part, depth0, depth1)
    columns, column_band = _at_bands(part, x0, x1)
    return rows if row_band >= column_band else columns


def _at_bands(part: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Boxes between the white bands of one axis: a band lies where the next box begins behind all before it; and the widest band, 0 for none."""
    part = part[np.argsort(begin[part], kind="stable")]
    bands = begin[part][1:] - np.maximum.accumulate(end[part])[:-1]
    return np.split(part, np.flatnonzero(bands > 0) + 1), float(bands.max(initial=0.0))
