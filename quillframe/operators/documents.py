"""Document operators over tables of texts: HTML and Markdown by Arrow batches, lines and diffs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tolerant import split_lines, word_pieces

NODE_DDL = "node_id int, parent_id int, ord int, depth int, kind string, tag string, attrs map<string,string>, text string"


def per_row(df: DataFrame, keys: list[str], columns: list[str], ddl: str, body: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Rows that body makes of each row's columns, with its keys before them; a batch of the result holds about a thousand rows."""
    schema = ", ".join([*(f"`{k}` {dict(df.dtypes)[k]}" for k in keys), ddl])
    source = df.select(*keys, *[F.col(c).alias(f"_in{i}") for i, c in enumerate(columns)])
    arrow = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            inputs = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*inputs, strict=True):
                head = row[: len(keys)]
                held += [(*head, *made) for made in body(*row[len(keys) :])]
                if len(held) >= 1000:
                    yield _batch(held, arrow)
                    held = []
        if held:
            yield _batch(held, arrow)

    return source.mapInArrow(run, schema)


def _arrow_schema(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def html_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row per node: its number in document order, parent, place among siblings, depth, kind, tag, attributes, text."""

    def body(text: str | None) -> Iterator[tuple]:
        from ..functions import html as h

        return h.rows(h.parse(text or ""))

    return per_row(pages, [key], [html], NODE_DDL, body)


def html_select(pages: DataFrame, key: str, html: str, selector: str) -> DataFrame:
    """Elements that match a selector, in document order, with their text content."""
    from ..functions import html as h

    chosen = h.Selector(selector)

    def body(text: str | None) -> Iterator[tuple]:
        return ((n, e.tag, e.text_content()) for n, e in enumerate(chosen.select(h.parse(text or "")), 1))

    return per_row(pages, [key], [html], "match int, tag string, content string", body)


def html_titles(pages: DataFrame, key: str, html: str) -> DataFrame:
    def body(text: str | None) -> Iterator[tuple]:
        from ..functions import html as h

        yield (h.title(h.parse(text or "")),)

    return per_row(pages, [key], [html], "title string", body)


def html_sanitised(pages: DataFrame, key: str, html: str) -> DataFrame:
    def body(text: str | None) -> Iterator[tuple]:
        from ..functions import html as h

        yield (h.sanitise(text or ""),)

    return per_row(pages, [key], [html], "clean string", body)


def markdown_html(docs: DataFrame, key: str, text: str) -> DataFrame:
    def body(source: str | None) -> Iterator[tuple]:
        from ..functions import markdown

        yield (markdown.to_html(source or ""),)

    return per_row(docs, [key], [text], "html string", body)


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows over all partitions: a diff's work is out of proportion to its bytes, by which adaptive execution would merge partitions."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def word_diff(pairs: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """Counts of deleted and inserted pieces of a shortest edit script over words and separators."""

    def body(a: list[str] | None, b: list[str] | None) -> Iterator[tuple]:
        from ..functions import diff

        blocks = diff.blocks(a or [], b or [])
        yield (sum(k[1] for k in blocks), sum(k[3] for k in blocks), len(blocks))

    cut = _dealt(pairs.select(*keys, word_pieces(F.col(old)).alias("_old"), word_pieces(F.col(new)).alias("_new")), keys)
    return per_row(cut, keys, ["_old", "_new"], "n_deleted int, n_inserted int, n_blocks int", body)


def line_diff(pairs: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """Unchanged, deleted and inserted lines in order, with old and new line numbers."""

    def body(a: list[str] | None, b: list[str] | None) -> Iterator[tuple]:
        from ..functions import diff

        return iter(diff.inline(a or [], b or []))

    cut = _dealt(pairs.select(*keys, split_lines(F.col(old)).alias("_old"), split_lines(F.col(new)).alias("_new")), keys)
    return per_row(cut, keys, ["_old", "_new"], "change string, line string, old_line int, new_line int", body)


def repeated_lines(docs: DataFrame, least: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines, digits masked and blanks trimmed, that ``least`` documents or more have; a document counts once, combined before the shuffle."""
    lines = docs.select(key, F.explode(F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[0-9]+", "#"))))).alias("masked"))
    found = lines.where("masked <> ''").groupBy("masked").agg(F.count(F.lit(1)).alias("docs"))
    return found.where(F.col("docs") >= least)


def visual_texts(docs: DataFrame, key: str, text: str, paragraph: int = 0) -> DataFrame:
    """key and ``visual``: each text as one line, in the order in which it stands. Only texts with anything to reorder are sent through the algorithm, which a built-in pattern tells; a null stays null."""

    def body(source: str | None, reorders: bool) -> Iterator[tuple]:
        from ..functions import bidi

        yield (bidi.visual(source, paragraph) if source is not None and (reorders or paragraph) else source,)

    strong = F.coalesce(F.col(text).rlike("[֐-ࣿיִ-﷿ﹰ-﻿‏‫‮⁧⁨\\x{10800}-\\x{10FFF}\\x{1E800}-\\x{1EFFF}]"), F.lit(False))
    return per_row(docs.withColumn("_reorders", strong), [key], [text, "_reorders"], "visual string", body)
