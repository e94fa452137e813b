"""Ordered operators: list counters, note and page numbers, stacking, and the layout of page letters, by windows.

A window's partition here is a document, a list, a page or a category, never a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tolerant import list_label

LEVELS = 9


def list_counters(items: DataFrame, starts: list[int] | None = None, restart_after: list[int | None] | None = None) -> DataFrame:
    """items (doc, list, pos, level from 0) with ``counters``, the numbers of levels 0 to its own.

    A level counts on from its start; an item of an outer level resets it, unless its restart_after is 0,
    and only if the outer level is at most restart_after - 1 where that is given. A level that was not used yet shows its start.
    """
    starts, restart = starts or [1] * LEVELS, restart_after or [None] * LEVELS
    per = Window.partitionBy("doc", "list").orderBy("pos")
    upto = per.rowsBetween(Window.unboundedPreceding, 0)
    rows = items
    for k in range(LEVELS):
        rule = restart[k]
        resets = F.lit(False) if rule == 0 or k == 0 else (F.col("level") < k) if rule is None else F.col("level") <= rule - 1
        rows = rows.withColumn(f"_s{k}", F.sum(resets.cast("int")).over(upto))
    for k in range(LEVELS):
        within = Window.partitionBy("doc", "list", f"_s{k}").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        used = F.sum((F.col("level") == k).cast("int")).over(within)
        rows = rows.withColumn(f"_n{k}", F.greatest(used, F.lit(1)) + starts[k] - 1)
    counters = F.slice(F.array(*[F.col(f"_n{k}") for k in range(LEVELS)]), 1, F.col("level") + 1)
    return rows.withColumn("counters", counters).select(*items.columns, "counters")


def list_labels(counted: DataFrame, templates: list[str], kinds: list[str]) -> DataFrame:
    """counted with ``label``: the template of its level, in which %1 to %9 are the numbers of its levels."""
    made = F.lit(None).cast("string")
    for level, template in reversed(list(enumerate(templates))):
        text: Column = F.lit(template)
        for k in range(level + 1):
            text = F.replace(text, F.lit(f"%{k + 1}"), list_label(F.get("counters", F.lit(k)), kinds[k]))
        made = F.when(F.col("level") == level, text).otherwise(made)
    return counted.withColumn("label", made)


def note_numbers(references: DataFrame, restart: str = "doc") -> DataFrame:
    """references (doc, section, page, pos, note) with ``number``: notes in order of their first reference, restarting by document, section or page."""
    keys = {"doc": ["doc"], "section": ["doc", "section"], "page": ["doc", "section", "page"]}[restart]
    first = references.groupBy(*keys, "note").agg(F.min("pos").alias("_first"))
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))).drop("_first")
    return _joined(references, numbered, [*keys, "note"])


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right at equal keys, where null equals null."""
    other = right.select(*[F.col(k).alias(f"{k}*") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(other[f"{k}*"])
    return left.join(other, same).drop(*[f"{k}*" for k in keys])


def page_fields(pages: DataFrame) -> DataFrame:
    """pages (doc, section, page_ix) with page, num_pages and section_pages."""
    return pages.withColumn("page", F.row_number().over(Window.partitionBy("doc").orderBy("section", "page_ix"))).withColumn("num_pages", F.count(F.lit(1)).over(Window.partitionBy("doc"))).withColumn("section_pages", F.count(F.lit(1)).over(Window.partitionBy("doc", "section")))


def stacked(points: DataFrame, percent: bool = False) -> DataFrame:
    """points (chart, category, series, value) with low and high: positive values stack up, negative ones down; percent is of the sum of absolutes."""
    value = F.coalesce(F.col("value"), F.lit(0.0))
    if percent:
        total = F.sum(F.abs(value)).over(Window.partitionBy("chart", "category"))
        value = F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(value * 100, total))
    rows = points.withColumn("_v", value).withColumn("_up", F.col("_v") >= 0)
    upto = Window.partitionBy("chart", "category", "_up").orderBy("series").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("_v").over(upto)
    return rows.withColumn("_end", end).select(*points.columns, F.least("_end", F.col("_end") - F.col("_v")).alias("low"), F.greatest("_end", F.col("_end") - F.col("_v")).alias("high"))


def overflow(cells: DataFrame, last_column: int) -> DataFrame:
    """cells (sheet, row, col, text) with ``until``: the last column that a text may run over, before the next filled cell of its row."""
    after = Window.partitionBy("sheet", "row").orderBy("col")
    filled = cells.where("text is not null and text <> ''")
    return filled.withColumn("until", F.coalesce(F.lead("col").over(after) - 1, F.lit(last_column)))


def lines_of_letters(letters: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """letters (doc, page, value, x, y, width, size) with ``line``, from top to bottom: a letter whose base line lies more than tolerance of its size below the one before begins a line."""
    down = Window.partitionBy("doc", "page").orderBy(F.desc("y"), "x")
    gap = F.lag("y").over(down) - F.col("y")
    rows = letters.withColumn("_new", F.coalesce(gap > tolerance * F.col("size"), F.lit(False)).cast("int"))
    return rows.withColumn("line", 1 + F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def words_of_letters(letters: DataFrame, space: float = 0.25) -> DataFrame:
    """Words (doc, page, line, word, text, box, modal size): a gap of more than space of the size, or a blank, parts letters of a line."""
    across = Window.partitionBy("doc", "page", "line").orderBy("x")
    rows = letters if "line" in letters.columns else lines_of_letters(letters)
    rows = rows.withColumn("_end", F.lag(F.col("x") + F.col("width")).over(across)).withColumn("_blank", F.lag(F.trim("value") == "").over(across))
    apart = F.col("_end").isNull() | (F.col("x") - F.col("_end") > space * F.col("size")) | F.coalesce("_blank", F.lit(False))
    rows = rows.withColumn("_new", apart.cast("int")).withColumn("word", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("x", "value"))), lambda c: c["value"])
    box = [F.min("x").alias("left"), F.min("y").alias("bottom"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("size")).alias("top")]
    found = rows.where(F.trim("value") != "").groupBy("doc", "page", "line", "word").agg(F.array_join(ordered, "").alias("text"), *box, F.mode(F.round("size", 1)).alias("font_size"))
    return found.withColumn("word", F.row_number().over(Window.partitionBy("doc", "page", "line").orderBy("left")))


def page_text(words: DataFrame) -> DataFrame:
    """Plain text of each page: words by blanks, lines by line feeds; a page is one row by nature."""
    line = words.groupBy("doc", "page", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda c: c["text"]), " ").alias("text"))
    return line.groupBy("doc", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda c: c["text"]), "\n").alias("text"))


#: Words that stand before a page's number, or between it and the number of pages.
PAGE_WORDS, NUMBER_JOINERS = ("page",), ("/", "of", "sur", "de")
#: Characters of a page number's line at most.
PAGE_NUMBER_LENGTH = 15


def page_number(text: Column) -> Column:
    """Whether a short line is a page's number: after a word for it or not, with the number of pages or not, dashes around or between."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[0-9]+|\\p{L}+|[^\\s0-9\\p{L}]"), F.lit(0))
    sign = lambda t: F.when(t.rlike("[0-9]"), F.lit("9")).when(t.isin(*PAGE_WORDS), F.lit("p")).when(t.isin(*NUMBER_JOINERS), F.lit("j")).otherwise(F.lit("?"))
    shape = F.array_join(F.transform(F.filter(tokens, lambda t: ~t.isin("-", "\u2013")), sign), "")
    return (F.length(F.trim(text)) <= PAGE_NUMBER_LENGTH) & shape.isin("9", "p9", "9j9", "p9j9")


def decorations(lines: DataFrame) -> DataFrame:
    """lines (doc, page, text) with ``decoration``: digits masked, the same line stands on max(2, half) of the document's pages, or it is a page number. A null text is none."""
    masked = lines.select(F.struct(*[F.col(f"`{c}`") for c in lines.columns]).alias("row"), "doc", "page", F.trim(F.regexp_replace("text", "[0-9]+", "#")).alias("key"))
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    keys = masked.groupBy("doc", "key").agg(F.count_distinct("page").alias("on"))
    joined = _joined(_joined(masked, keys, ["doc", "key"]), pages, ["doc"])
    often = F.col("key").isNotNull() & (F.col("on") >= F.greatest(F.lit(2), F.ceil(F.col("pages") / 2)))
    return joined.select(*[F.col("row")[c].alias(c) for c in lines.columns], (often | F.coalesce(page_number(F.col("row")["text"]), F.lit(False))).alias("decoration"))


def redacted_letters(letters: DataFrame, areas: DataFrame) -> DataFrame:
    """Letters whose box meets no area of their page: an equi-join on document and page with a box test, areas first gathered per page, as many as a page has."""
    boxes = areas.groupBy("doc", "page").agg(F.collect_list(F.struct("l", "b", "r", "t")).alias("_areas"))
    met = F.exists("_areas", lambda a: (F.col("x") < a["r"]) & (F.col("x") + F.col("width") > a["l"]) & (F.col("y") < a["t"]) & (F.col("y") + F.col("size") > a["b"]))
    return letters.join(boxes, ["doc", "page"], "left").where(~F.coalesce(met, F.lit(False))).select(*letters.columns)


def filled_controls(controls: DataFrame, values: DataFrame) -> DataFrame:
    """controls (doc, tag) joined with values (tag, value), first of a tag: filled ones with their value, others null."""
    first = values.groupBy("tag").agg(F.first("value", ignorenulls=True).alias("value"))
    return controls.join(first, "tag", "left")


def class_styles(rules: DataFrame) -> DataFrame:
    """rules (class, property, value, position): the last declaration of each property of a class wins."""
    return rules.groupBy("class", "property").agg(F.max_by("value", "position").alias("value"))


def split_pages(pages: DataFrame, every: int) -> DataFrame:
    """pages (doc, page from 1) with ``part`` and ``part_page`` of documents of so many pages."""
    return pages.withColumn("part", F.ceil(F.col("page") / every).cast("int")).withColumn("part_page", (F.pmod(F.col("page") - 1, F.lit(every)) + 1).cast("int"))


def merged_pages(documents: list[DataFrame]) -> DataFrame:
    """Pages of several documents one after the other, with ``doc_ord``."""
    out = None
    for k, d in enumerate(documents):
        numbered = d.withColumn("doc_ord", F.lit(k))
        out = numbered if out is None else out.unionByName(numbered, allowMissingColumns=True)
    return out
