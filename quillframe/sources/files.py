"""Document files as tables and back. Files are rows of (path, content), as Spark's ``binaryFile`` source gives them.

A file is parsed by one task, within the package limits; a file that cannot be read gives no rows here
and one row in ``problems``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import csvtext, images, package_edit, packages, pdf, pdf_edit, rasters
from ..operators.conversions import pdf_date
from ..operators.documents import per_row

CELLS_DDL = "sheet string, sheet_ix int, row int, col int, kind string, num double, text string, bool boolean, err string, formula string, number_format string, is_date boolean"
PARAGRAPHS_DDL = "part string, para_ix int, address string, style string, outline int, in_table boolean, list_level int, text string"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of the files below a path of any file system that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _each(read: Callable[[bytes], Iterable[tuple]]) -> Callable[[bytes | None], Iterator[tuple]]:
    def body(content: bytes | None) -> Iterator[tuple]:
        try:
            yield from list(read(content or b""))
        except ValueError:
            return

    return body


def workbook_cells(source: DataFrame) -> DataFrame:
    """Cells of workbooks, a row each."""
    return per_row(source, ["path"], ["content"], CELLS_DDL, _each(packages.workbook_cells))


def paragraphs(source: DataFrame) -> DataFrame:
    """Paragraphs of word-processing documents with stable addresses."""
    return per_row(source, ["path"], ["content"], PARAGRAPHS_DDL, _each(packages.document_paragraphs))


def tracked_changes(source: DataFrame) -> DataFrame:
    return per_row(source, ["path"], ["content"], "part string, kind string, id string, author string, date string, text string", _each(packages.tracked_changes))


def content_controls(source: DataFrame) -> DataFrame:
    return per_row(source, ["path"], ["content"], "part string, tag string, alias string, id string, text string", _each(packages.content_controls))


def image_headers(source: DataFrame) -> DataFrame:
    """format, width, height and dpi of images, from headers only."""

    def read(content: bytes) -> Iterator[tuple]:
        found = images.identify(content)
        if found:
            yield found

    return per_row(source, ["path"], ["content"], "format string, width int, height int, dpi_x double, dpi_y double", _each(read))


def csv_records(source: DataFrame, delimiter: str | None = None, quote: str | None = '"', trim: bool = False) -> DataFrame:
    """record, line and fields of CSV files by the lenient rules; encoding and (if not given) delimiter are detected. A broken file's last row holds the error."""

    def read(content: bytes | None) -> Iterator[tuple]:
        text = csvtext.decoded(content or b"")
        n = 0
        try:
            for n, (line, fields) in enumerate(csvtext.records(text, delimiter or csvtext.delimiter_of(text), quote, trim), 1):
                yield n, line, fields, None
        except csvtext.CsvError as e:
            yield n + 1, e.line, [], e.what

    return per_row(source, ["path"], ["content"], "record int, line int, fields array<string>, error string", read)


def with_header(records: DataFrame) -> DataFrame:
    """Records after the first as maps from header to field; a short record reads as empty texts, the first of equal headers counts."""
    head = records.where("record = 1 and error is null").select("path", F.transform("fields", lambda x: F.trim(x)).alias("_header"))
    rows = records.where("record > 1 and error is null").join(head, "path")
    first = F.filter(F.sequence(F.lit(0), F.size("_header") - 1), lambda i: F.array_position("_header", F.get("_header", i)) == i + 1)
    entries = F.transform(first, lambda i: F.struct(F.get("_header", i), F.coalesce(F.get("fields", i), F.lit(""))))
    return rows.select("path", "record", "line", F.map_from_entries(entries).alias("values"))


def workbooks(cells: DataFrame, key: str = "path") -> DataFrame:
    """key and content (bytes) of a workbook per key; a workbook is made whole in one task, as its package has to be."""

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["sheet_ix", "row", "col"]).astype(object).where(lambda d: d.notna(), None)
        rows = ordered[["sheet", "row", "col", "kind", "num", "text", "bool", "err", "formula", "number_format"]].itertuples(index=False)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [packages.write_workbook(rows)]})

    return cells.groupBy(key).applyInPandas(made, f"`{key}` {dict(cells.dtypes)[key]}, content binary")


def problems(source: DataFrame, kind: str) -> DataFrame:
    """path and reason of the files that a reader refuses."""
    read = {"workbook": packages.workbook_cells, "document": packages.document_paragraphs}[kind]

    def body(content: bytes | None) -> Iterator[tuple]:
        try:
            for _ in read(content or b""):
                pass
        except ValueError as e:
            yield (str(e),)

    return per_row(source, ["path"], ["content"], "reason string", body)


def pdf_letters(source: DataFrame, password: str = "") -> DataFrame:
    """Letters of PDF files in drawing order: the fact table of the layout operators. Encrypted files open with the user's or the owner's password."""
    return per_row(source, ["path"], ["content"], "page int, ord int, value string, x double, y double, width double, size double, font string, mode int", _each(lambda content: pdf.letters(content, password)))


def pdf_pages(source: DataFrame) -> DataFrame:
    """Boxes and rotation of pages."""
    return per_row(source, ["path"], ["content"], "page int, `left` double, bottom double, `right` double, top double, rotation int", _each(pdf.page_boxes))


def pdf_information(source: DataFrame) -> DataFrame:
    """Title, author and so on, dates as written and read."""
    found = per_row(source, ["path"], ["content"], "title string, author string, subject string, keywords string, creator string, producer string, created_text string, changed_text string", _each(pdf_edit.information))
    return found.withColumn("created", pdf_date(F.col("created_text"))).withColumn("changed", pdf_date(F.col("changed_text")))


def pdf_form_fields(source: DataFrame) -> DataFrame:
    return per_row(source, ["path"], ["content"], "name string, kind string, value string, flags int, options array<string>", _each(pdf_edit.form_fields))


def pdf_parts(source: DataFrame, every: int) -> DataFrame:
    """Files of so many pages each: path, part from 1, content."""

    def cut(content: bytes) -> Iterator[tuple]:
        n = len(pdf.Document(content).pages())
        for part, first in enumerate(range(1, n + 1, every), 1):
            yield part, pdf_edit.extracted(content, range(first, min(first + every, n + 1)))

    return per_row(source, ["path"], ["content"], "part int, pages binary", _each(cut)).withColumnRenamed("pages", "content")


def chart_points(source: DataFrame) -> DataFrame:
    """Points of the charts of workbooks, a row each."""
    return per_row(source, ["path"], ["content"], "sheet string, chart int, kind string, title string, series int, name string, formula string, point int, category string, value double", _each(package_edit.chart_points))


def edited_workbooks(source: DataFrame, edits: DataFrame) -> DataFrame:
    """Workbooks with edits (path, sheet, ref, kind, value as text, position) applied in order of position; a refused edit leaves its file out and gives ``problem``."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "sheet", "ref", "kind", "value")))
    joined = source.join(edits.groupBy("path").agg(ordered.alias("_edits")), "path", "left")

    def body(content: bytes | None, changes: list | None) -> Iterator[tuple]:
        value = lambda e: float(e["value"]) if e["kind"] == "num" else e["value"].lower() == "true" if e["kind"] == "bool" else e["value"]
        try:
            yield package_edit.edited_workbook(content or b"", [(e["sheet"], e["ref"], e["kind"], value(e)) for e in changes or []]), None
        except ValueError as e:
            yield None, str(e)

    return per_row(joined, ["path"], ["content", "_edits"], "edited binary, problem string", body)


def settled_documents(source: DataFrame, accept: bool = True) -> DataFrame:
    """Documents with their tracked changes accepted or rejected."""
    return per_row(source, ["path"], ["content"], "settled binary", _each(lambda c: [(package_edit.settled_document(c, accept),)]))


def decoded_images(source: DataFrame) -> DataFrame:
    """width, height, channels and pixels (row by row) of PNG, BMP, GIF and TIFF images."""

    def read(content: bytes) -> Iterator[tuple]:
        pixels = rasters.decode(content)
        yield pixels.shape[1], pixels.shape[0], pixels.shape[2], pixels.tobytes()

    return per_row(source, ["path"], ["content"], "width int, height int, channels int, pixels binary", _each(read))
