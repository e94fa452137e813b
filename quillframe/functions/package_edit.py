"""Edits of office packages in place: only parts that change are written anew. Charts of workbooks as points."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.dom import minidom
from xml.etree import ElementTree
from xml.parsers.expat import ExpatError

from .cells import column_letters, parse_reference
from .packages import REL_DOC, Package, PackageError

# The chart elements that hold series, and what a chart may hold.
CHARTS = ("barChart", "bar3DChart", "lineChart", "line3DChart", "pieChart", "pie3DChart", "doughnutChart")
MAX_SERIES_POINTS, MAX_CHART_POINTS = 100_000, 1_000_000


def _dom(package: Package, part: str) -> minidom.Document:
    data = package.part(part)
    if b"<!DOCTYPE" in data[:4096]:
        raise PackageError(f"part {part} declares a document type")
    try:
        return minidom.parseString(data)
    except ExpatError as e:
        raise PackageError(f"part {part} is no XML") from e


def _with_parts(package: Package, changed: dict[str, bytes | None]) -> bytes:
    """The package with parts replaced, or left out where they are None."""
    folded = {k.lower(): v for k, v in changed.items()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, entry in package.names.items():
            data = folded.get(name, package.part(name)) if name in folded else package.part(name)
            if data is not None:
                z.writestr(zipfile.ZipInfo(entry.filename, entry.date_time), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _sheet_parts(package: Package) -> list[tuple[str, str]]:
    main = package.main()
    rels = package.relations(main)
    sheets = [s for s in package.xml(main).iter() if s.tag.rpartition("}")[2] == "sheet"]
    return [(s.get("name", ""), rels.get(s.get(f"{{{REL_DOC}}}id", ""), ("", ""))[0]) for s in sheets]


def _children(e: minidom.Element, name: str | None = None) -> list[minidom.Element]:
    return [c for c in e.childNodes if c.nodeType == c.ELEMENT_NODE and (name is None or c.localName == name)]


def _made(doc: minidom.Document, name: str, text: str | None = None) -> minidom.Element:
    root = doc.documentElement
    e = doc.createElementNS(root.namespaceURI, f"{root.prefix}:{name}" if root.prefix else name)
    if text is not None:
        e.appendChild(doc.createTextNode(text))
    return e


def edited_workbook(content: bytes, edits: Iterable[tuple[str, str, str, object]]) -> bytes:
    """Edits (sheet, A1 reference, kind, value), kind one of num, text, bool, blank and formula; the last of a cell counts.

    A cell keeps its style. A formula that a cell held goes; the head of a shared formula and a cell of
    an array formula are refused. Formulas are computed anew when a program opens the file.
    """
    package = Package(content)
    targets = dict(_sheet_parts(package))
    changed: dict[str, bytes | None] = {}
    by_sheet: dict[str, dict[tuple[int, int], tuple[str, object]]] = {}
    for sheet, at, kind, value in edits:
        if sheet not in targets:
            raise PackageError(f"no sheet {sheet}")
        row, col, _, _ = parse_reference(at)
        by_sheet.setdefault(sheet, {})[row, col] = kind, value
    formulas_moved = False
    for sheet, cells in by_sheet.items():
        doc = _dom(package, targets[sheet])
        data = _children(doc.documentElement, "sheetData")[0]
        rows = {int(r.getAttribute("r") or 0): r for r in _children(data, "row")}
        for (row, col), (kind, value) in sorted(cells.items()):
            if row not in rows:
                rows[row] = made = _made(doc, "row")
                made.setAttribute("r", str(row))
                data.insertBefore(made, rows[after] if (after := min((r for r in rows if r > row), default=None)) else None)
            places = {parse_reference(c.getAttribute("r"))[1]: c for c in _children(rows[row], "c")}
            cell = places.get(col)
            if cell is None:
                if kind == "blank":
                    continue
                cell = _made(doc, "c")
                cell.setAttribute("r", f"{column_letters(col)}{row}")
                rows[row].insertBefore(cell, places[after] if (after := min((c for c in places if c > col), default=None)) else None)
            formulas_moved |= _set(doc, cell, kind, value)
        changed[targets[sheet]] = doc.toxml(encoding="UTF-8")
    if formulas_moved:
        main = package.main()
        book = _dom(package, main)
        pr = _children(book.documentElement, "calcPr")
        if not pr:
            pr = [_made(book, "calcPr")]
            later = [c for c in _children(book.documentElement) if c.localName in ("oleSize", "customWorkbookViews", "pivotCaches", "smartTagPr", "smartTagTypes", "webPublishing", "fileRecoveryPr", "webPublishObjects", "extLst")]
            book.documentElement.insertBefore(pr[0], later[0] if later else None)
        pr[0].setAttribute("fullCalcOnLoad", "1")
        changed[main] = book.toxml(encoding="UTF-8")
        chain = next((t for t, k in package.relations(main).values() if k == "calcChain"), None)
        if chain:
            changed[chain] = None
            folder, _, file = main.rpartition("/")
            for part, tag in ((f"{folder}/_rels/{file}.rels", "Relationship"), ("[Content_Types].xml", "Override")):
                doc = _dom(package, part)
                for e in _children(doc.documentElement, tag):
                    if e.getAttribute("Type").endswith("/calcChain") or e.getAttribute("PartName").lstrip("/").lower() == chain.lower():
                        doc.documentElement.removeChild(e)
                changed[part] = doc.toxml(encoding="UTF-8")
    return _with_parts(package, changed)


def _set(doc: minidom.Document, cell: minidom.Element, kind: str, value: object) -> bool:
    """Sets a cell's content; true if formulas changed."""
    had = False
    for old in _children(cell):
        if old.localName == "f":
            if old.getAttribute("t") == "shared" and old.hasAttribute("ref") or old.getAttribute("t") == "array":
                raise PackageError(f"{cell.getAttribute('r')} heads a shared formula or lies in an array formula")
            had = True
        if old.localName in ("f", "v", "is"):
            cell.removeChild(old)
    if cell.hasAttribute("t"):
        cell.removeAttribute("t")
    if kind == "num":
        cell.appendChild(_made(doc, "v", repr(float(value)).removesuffix(".0")))
    elif kind == "bool":
        cell.setAttribute("t", "b")
        cell.appendChild(_made(doc, "v", str(int(bool(value)))))
    elif kind == "text":
        if len(str(value)) > 32_767 or re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", str(value)):
            raise PackageError("a text that a cell cannot hold")
        cell.setAttribute("t", "inlineStr")
        holder, t = _made(doc, "is"), _made(doc, "t", str(value))
        t.setAttribute("xml:space", "preserve")
        holder.appendChild(t)
        cell.appendChild(holder)
    elif kind == "formula":
        cell.appendChild(_made(doc, "f", str(value).removeprefix("=")))
        return True
    elif kind != "blank":
        raise PackageError(f"no kind of content {kind}")
    return had


def settled_document(content: bytes, accept: bool = True) -> bytes:
    """A document with its tracked insertions, deletions, moves and property changes accepted or rejected, in all text parts.

    Of what is taken back (deleted text when accepting, inserted text when rejecting) runs, rows and
    paragraph marks go; a paragraph whose mark goes takes in the content of the next one.
    """
    package = Package(content)
    main = package.main()
    parts = [main, *sorted(t for t, k in package.relations(main).values() if k in ("header", "footer", "footnotes", "endnotes", "comments") and package.has(t))]
    gone, kept = (("del", "moveFrom"), ("ins", "moveTo")) if accept else (("ins", "moveTo"), ("del", "moveFrom"))
    changed: dict[str, bytes | None] = {}
    for part in parts:
        doc = _dom(package, part)
        marks: list[minidom.Element] = []
        every = [e for e in doc.getElementsByTagName("*") if e.localName in (*gone, *kept) or e.localName.endswith("PrChange") or "RangeStart" in e.localName and "move" in e.localName or "RangeEnd" in e.localName and "move" in e.localName]
        for e in every:
            above = e.parentNode
            if above is None:
                continue
            if e.localName.endswith("PrChange"):
                if not accept:
                    former = _children(e)
                    for c in list(above.childNodes):
                        if c is not e and not (c.nodeType == c.ELEMENT_NODE and c.localName in ("rPr", "sectPr", "ins", "del")):
                            above.removeChild(c)
                    for c in list(former[0].childNodes) if former else []:
                        above.insertBefore(c, e)
                above.removeChild(e)
            elif above.localName == "rPr" and above.parentNode.localName == "pPr":  # a paragraph mark
                if e.localName in gone:
                    marks.append(above.parentNode.parentNode)
                above.removeChild(e)
            elif above.localName == "trPr":
                row = above.parentNode
                above.removeChild(e)
                if e.localName in gone and row.parentNode is not None:
                    row.parentNode.removeChild(row)
            elif e.localName in kept:
                for c in list(e.childNodes):
                    above.insertBefore(c, e)
                above.removeChild(e)
            else:
                above.removeChild(e)
        for t in list(doc.getElementsByTagName("*")):
            if not accept and t.localName in ("delText", "delInstrText"):
                t.tagName = t.nodeName = t.tagName.replace(t.localName, "t" if t.localName == "delText" else "instrText")
        for p in reversed(marks):
            after = p.nextSibling
            while after is not None and after.nodeType != after.ELEMENT_NODE:
                after = after.nextSibling
            if after is None or after.localName != "p":
                continue
            for c in list(after.childNodes):
                if not (c.nodeType == c.ELEMENT_NODE and c.localName == "pPr"):
                    p.appendChild(c)
            after.parentNode.removeChild(after)
        if every:
            changed[part] = doc.toxml(encoding="UTF-8")
    return _with_parts(package, changed)


def chart_points(content: bytes) -> Iterator[tuple]:
    """(sheet, chart, kind, title, series, name, formula, point, category, value) of the charts of a workbook.

    Bars, lines, pies and doughnuts give a row per cached point, or one without a point where a series
    has no cache (its formula then names the cells to join); other charts give one row with their kind.
    Points beyond the limits are left out, charts that cannot be read as well.
    """
    package = Package(content)
    for sheet, part in _sheet_parts(package):
        if not package.has(part):
            continue
        number = 0
        for drawing in [t for t, k in package.relations(part).values() if k == "drawing" and package.has(t)]:
            try:
                root, rels = package.xml(drawing), package.relations(drawing)
            except PackageError:
                continue
            for e in root.iter():
                if e.tag.rpartition("}")[2] != "chart" or e.get(f"{{{REL_DOC}}}id") not in rels:
                    continue
                number += 1
                target = rels[e.get(f"{{{REL_DOC}}}id")][0]
                try:
                    yield from ((sheet, number, *row) for row in _points(package.xml(target)))
                except (PackageError, ValueError):
                    continue


def _find(e: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for name in path:
        e = next((c for c in e if c.tag.rpartition("}")[2] == name), None) if e is not None else None
    return e


def _cache(e: ElementTree.Element | None) -> tuple[str | None, dict[int, str]]:
    """Formula and cached texts by place of a reference or a literal."""
    if e is None or not len(e):
        return None, {}
    ref = e[0]
    f = _find(ref, "f")
    holder = next((c for c in ref if c.tag.rpartition("}")[2] in ("strCache", "numCache")), ref)
    points = {}
    for p in holder:
        if p.tag.rpartition("}")[2] == "pt" and int(p.get("idx", "0")) < MAX_SERIES_POINTS:
            v = _find(p, "v")
            points[int(p.get("idx", "0"))] = v.text or "" if v is not None else ""
    return f.text if f is not None else None, points


def _points(root: ElementTree.Element) -> Iterator[tuple]:
    title = _find(root, "chart", "title")
    shown = "".join(t.text or "" for t in title.iter() if t.tag.rpartition("}")[2] in ("t", "v")) if title is not None else None
    area = _find(root, "chart", "plotArea")
    groups = [g for g in area if g.tag.rpartition("}")[2].endswith("Chart")] if area is not None else []
    if not any(g.tag.rpartition("}")[2] in CHARTS for g in groups):
        yield (groups[0].tag.rpartition("}")[2] if groups else "", shown, *[None] * 6)
        return
    count = series = 0
    for group in groups:
        kind = group.tag.rpartition("}")[2]
        for s in group if kind in CHARTS else []:
            if s.tag.rpartition("}")[2] != "ser":
                continue
            series += 1
            name = _cache(_find(s, "tx"))[1].get(0)
            labels = _cache(_find(s, "cat"))[1]
            formula, values = _cache(_find(s, "val"))
            if not values:
                yield kind, shown, series, name, formula, None, None, None
            for k in sorted(values):
                count += 1
                if count > MAX_CHART_POINTS:
                    return
                try:
                    value = float(values[k])
                except ValueError:
                    value = None
                yield kind, shown, series, name, formula, k, labels.get(k), value
