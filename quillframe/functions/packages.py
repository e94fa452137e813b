"""Office packages as plain functions: guarded zip access, workbook and document readers, workbook and document writers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from . import formats
from .cells import column_letters, parse_reference

# What a package may hold.
MAX_ENTRIES, MAX_PART, MAX_TOTAL, MAX_RATIO, RATIO_FROM = 2000, 256 << 20, 1 << 30, 200, 1 << 20
# Number formats that have a number and no text in a style sheet.
BUILT_IN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yyyy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yyyy h:mm", 37: "#,##0;-#,##0", 38: "#,##0;-#,##0", 39: "#,##0.00;-#,##0.00", 40: "#,##0.00;-#,##0.00", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@"}
REL_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
REL_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


class PackageError(ValueError):
    """The bytes are no package that may be read."""


class Package:
    """Parts of a zip, read within the limits; a document type declaration in a part is refused."""

    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            raise PackageError("no package") from e
        entries = self.zip.infolist()
        if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_TOTAL:
            raise PackageError("the package is too large")
        self.names = {e.filename.lstrip("/").lower(): e for e in entries}
        self.read_bytes = 0

    def has(self, name: str) -> bool:
        return name.lstrip("/").lower() in self.names

    def part(self, name: str) -> bytes:
        entry = self.names.get(name.lstrip("/").lower())
        if entry is None:
            raise PackageError(f"part {name} is missing")
        if entry.file_size > MAX_PART or entry.file_size > RATIO_FROM and entry.file_size > MAX_RATIO * max(entry.compress_size, 1):
            raise PackageError(f"part {name} is too large")
        try:
            with self.zip.open(entry) as f:
                data = f.read(MAX_PART + 1)
        except (zipfile.BadZipFile, OSError, RuntimeError, EOFError, NotImplementedError) as e:
            raise PackageError(f"part {name} is damaged") from e
        self.read_bytes += len(data)
        if len(data) > MAX_PART or self.read_bytes > MAX_TOTAL:
            raise PackageError("the package is too large")
        return data

    def xml(self, name: str) -> ElementTree.Element:
        data = self.part(name)
        if b"<!DOCTYPE" in data[:4096]:
            raise PackageError(f"part {name} declares a document type")
        try:
            return ElementTree.fromstring(data)
        except ElementTree.ParseError as e:
            raise PackageError(f"part {name} is no XML") from e

    def relations(self, name: str) -> dict[str, tuple[str, str]]:
        """Target part and type by id; the first of an id counts."""
        folder, _, file = name.rpartition("/")
        rels = f"{folder}/_rels/{file}.rels".lstrip("/")
        if not self.has(rels):
            return {}
        out: dict[str, tuple[str, str]] = {}
        for r in self.xml(rels):
            target = r.get("Target", "")
            steps: list[str] = [] if target.startswith("/") else folder.split("/") if folder else []
            for step in target.split("/"):
                if step == "..":
                    steps = steps[:-1]
                elif step not in ("", "."):
                    steps.append(step)
            out.setdefault(r.get("Id", ""), ("/".join(steps), r.get("Type", "").rpartition("/")[2]))
        return out

    def main(self) -> str:
        for target, kind in self.relations("").values():
            if kind == "officeDocument":
                return target
        raise PackageError("no main part")


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ElementTree.Element | None) -> str:
    """Text of a string item, without phonetic runs."""
    if e is None:
        return ""
    return "".join(t.text or "" for part in e if _local(part) in ("t", "r") for t in ([part] if _local(part) == "t" else [x for x in part if _local(x) == "t"]))


def unescaped(s: str) -> str:
    """Text with _xHHHH_ escapes resolved."""
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), s)


def shift_formula(text: str, rows: int, columns: int) -> str:
    """A shared formula's text moved to another cell; a reference that leaves the sheet becomes #REF!."""

    def moved(m: re.Match) -> str:
        if m["string"] or m["call"]:
            return m[0]
        c = m["c"] if m["ca"] else _shifted_column(m["c"], columns)
        r = m["r"] if m["ra"] else str(int(m["r"]) + rows)
        if c is None or not 1 <= int(r) <= 1_048_576:
            return "#REF!"
        return f"{m['ca']}{c}{m['ra']}{r}"

    pattern = r"(?P<string>\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'!)|(?P<call>[A-Za-z_][\w.]*(?=\())|(?<![\w.$])(?P<ca>\$?)(?P<c>[A-Za-z]{1,3})(?P<ra>\$?)(?P<r>[0-9]{1,7})(?![\w(.])"
    return re.sub(pattern, moved, text)


def _shifted_column(letters: str, by: int) -> str | None:
    from .cells import column_number

    n = column_number(letters) + by
    return column_letters(n) if 1 <= n <= 16_384 else None


def workbook_cells(content: bytes) -> Iterator[tuple]:
    """(sheet, sheet_ix, row, col, kind, num, text, bool, err, formula, number_format, is_date) of every stored cell, by sheet, row and column."""
    package = Package(content)
    main = package.main()
    book, rels = package.xml(main), package.relations(main)
    by_kind = {kind: target for target, kind in reversed(rels.values())}
    strings = [unescaped(_text(si)) for si in package.xml(by_kind["sharedStrings"])] if "sharedStrings" in by_kind and package.has(by_kind["sharedStrings"]) else []
    shown = _formats(package.xml(by_kind["styles"])) if "styles" in by_kind and package.has(by_kind["styles"]) else ["General"]
    sheets = [s for group in book if _local(group) == "sheets" for s in group]
    for ix, s in enumerate(sheets):
        target = rels.get(s.get(f"{{{REL_DOC}}}id", ""), ("", ""))[0]
        if not package.has(target):
            continue
        groups: dict[str, tuple[int, int, str]] = {}
        row = 0
        for data in package.xml(target):
            if _local(data) != "sheetData":
                continue
            for r in data:
                row = int(r.get("r") or row + 1)
                col = 0
                for c in r:
                    if ref := c.get("r"):
                        row, col, _, _ = parse_reference(ref)
                    else:
                        col += 1
                    made = _cell(c, row, col, strings, shown, groups)
                    if made is not None:
                        yield (s.get("name"), ix, row, col, *made)


def _formats(styles: ElementTree.Element) -> list[str]:
    own = {int(f.get("numFmtId", 0)): f.get("formatCode", "General") for group in styles if _local(group) == "numFmts" for f in group}
    return [own.get(k := int(x.get("numFmtId", 0))) or BUILT_IN.get(k, "General") for group in styles if _local(group) == "cellXfs" for x in group] or ["General"]


def _cell(c, row, col, strings, shown, groups) -> tuple | None:
    kind = c.get("t", "n")
    value = next((x.text or "" for x in c if _local(x) == "v"), None)
    f = next((x for x in c if _local(x) == "f"), None)
    formula = None
    if f is not None:
        formula = f.text or ""
        if f.get("t") == "shared":
            if formula:
                groups[f.get("si", "")] = (row, col, formula)
            elif f.get("si", "") in groups:
                r0, c0, text = groups[f.get("si", "")]
                formula = shift_formula(text, row - r0, col - c0)
    style = int(c.get("s") or 0)
    fmt = shown[style] if style < len(shown) else "General"
    out = {"num": None, "text": None, "bool": None, "err": None}
    tag, dated = "blank", False
    if kind == "inlineStr":
        tag, out["text"] = "text", unescaped(_text(next((x for x in c if _local(x) == "is"), None)))
    elif value is not None and value != "":
        if kind == "s":
            tag, out["text"] = "text", strings[int(value)] if value.isdigit() and int(value) < len(strings) else ""
        elif kind == "str":
            tag, out["text"] = "text", unescaped(value)
        elif kind == "b":
            tag, out["bool"] = "bool", value in ("1", "true")
        elif kind == "e":
            tag, out["err"] = "err", value
        elif kind == "d":
            tag, out["text"], dated = "text", value, True
        else:
            try:
                tag, out["num"] = "num", float(value)
            except ValueError:
                tag, out["text"] = "text", value
            dated = tag == "num" and formats.is_date(fmt) and 0 <= out["num"] <= 2_958_466
    if tag == "blank" and formula is None:
        return None
    return tag, out["num"], out["text"], out["bool"], out["err"], formula, fmt, dated


def write_workbook(cells: Iterable[tuple], title: str = "") -> bytes:
    """A workbook of (sheet, row, col, kind, num, text, bool, err, formula, number_format), ordered within sheets by the writer."""
    sheets: dict[str, dict[int, dict[int, tuple]]] = {}
    kinds: dict[str, int] = {"General": 0}
    for sheet, row, col, *rest in cells:
        sheets.setdefault(sheet, {}).setdefault(row, {})[col] = rest
        kinds.setdefault(rest[6] or "General", len(kinds))
    sheets = sheets or {"Sheet1": {}}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def put(name: str, text: str) -> None:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text, zipfile.ZIP_DEFLATED)

        n = len(sheets)
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, n + 1))
        put("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{types}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="{REL_PKG}"><Relationship Id="rId1" Type="{REL_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{SHEET_NS}" xmlns:r="{REL_DOC}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(sheets, 1)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{REL_PKG}">' + "".join(f'<Relationship Id="rId{k}" Type="{REL_DOC}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, n + 1)) + f'<Relationship Id="rId{n + 1}" Type="{REL_DOC}/styles" Target="styles.xml"/></Relationships>')
        own = {f: 163 + k for k, f in enumerate(kinds) if k}
        put("xl/styles.xml", f'<styleSheet xmlns="{SHEET_NS}">' + (f'<numFmts count="{len(own)}">' + "".join(f'<numFmt numFmtId="{i}" formatCode={quoteattr(f)}/>' for f, i in own.items()) + "</numFmts>" if own else "") + '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs>' + "".join(f'<xf numFmtId="{own.get(f, 0)}" applyNumberFormat="1"/>' for f in kinds) + "</cellXfs></styleSheet>")
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(_cell_xml(r, c, *rows[r][c], kinds) for c in sorted(rows[r])) + "</row>" for r in sorted(rows))
            put(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{SHEET_NS}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _cell_xml(r, c, kind, num, text, flag, error, formula, fmt, kinds) -> str:
    at, style = f"{column_letters(c)}{r}", kinds[fmt or "General"]
    f = f"<f>{escape(formula.lstrip('='))}</f>" if formula else ""
    clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", lambda m: f"_x{ord(m[0]):04X}_", re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text or ""))
    if kind == "text" and not f:
        return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'
    value, t = {"num": (repr(num), ""), "text": (escape(clean), ' t="str"'), "bool": (str(int(bool(flag))), ' t="b"'), "err": (escape(error or ""), ' t="e"')}.get(kind, ("", ""))
    return f'<c r="{at}" s="{style}"{t}>{f}' + (f"<v>{value}</v>" if value else "") + "</c>"


def document_paragraphs(content: bytes) -> Iterator[tuple]:
    """(part, index, address, style, outline, in_table, list_level, text) of each paragraph: body, headers, footers, footnotes, endnotes, comments. Deleted text is left out."""
    package = Package(content)
    main = package.main()
    order = {"header": 1, "footer": 2, "footnotes": 3, "endnotes": 4, "comments": 5}
    extra = sorted({(order[k], t) for t, k in package.relations(main).values() if k in order and package.has(t)})
    w = f"{{{WORD_NS}}}"
    for part in [main, *(t for _, t in extra)]:
        stack: list[tuple] = [(package.xml(part), False)]
        index = 0
        while stack:
            e, table = stack.pop()
            name = _local(e)
            if name == "p":
                p = e.find(f"{w}pPr")
                style = p.find(f"{w}pStyle").get(f"{w}val") if p is not None and p.find(f"{w}pStyle") is not None else None
                outline = p.find(f"{w}outlineLvl") if p is not None else None
                level = p.find(f"{w}numPr/{w}ilvl") if p is not None else None
                yield part, index, f"{part}#{index}", style, int(outline.get(f"{w}val")) if outline is not None else None, table, int(level.get(f"{w}val")) if level is not None else None, _paragraph_text(e)
                index += 1
            elif name not in ("del", "moveFrom"):
                stack += [(c, table or name == "tbl") for c in reversed(list(e))]


def _paragraph_text(p: ElementTree.Element) -> str:
    out: list[str] = []
    stack = list(reversed(list(p)))
    while stack:
        e = stack.pop()
        name = _local(e)
        if name == "t":
            out.append(e.text or "")
        elif name == "tab":
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
        elif name not in ("pPr", "rPr", "del", "moveFrom", "delText", "instrText", "Fallback"):
            stack += reversed(list(e))
    return "".join(out)


def tracked_changes(content: bytes) -> Iterator[tuple]:
    """(part, kind, id, author, date, text) of insertions, deletions, moves and property changes."""
    package = Package(content)
    main = package.main()
    w = f"{{{WORD_NS}}}"
    for part in [main, *sorted(t for t, k in package.relations(main).values() if k in ("header", "footer", "footnotes", "endnotes", "comments") and package.has(t))]:
        for e in package.xml(part).iter():
            name = _local(e)
            if name in ("ins", "del", "moveFrom", "moveTo") or name.endswith("PrChange"):
                text = "".join(t.text or "" for t in e.iter() if _local(t) in ("t", "delText"))
                yield part, name, e.get(f"{w}id"), e.get(f"{w}author"), e.get(f"{w}date"), text


def content_controls(content: bytes) -> Iterator[tuple]:
    """(part, tag, alias, id, text) of content controls."""
    package = Package(content)
    part = package.main()
    w = f"{{{WORD_NS}}}"
    for e in package.xml(part).iter(f"{w}sdt"):
        pr = e.find(f"{w}sdtPr")
        get = lambda n: pr.find(f"{w}{n}").get(f"{w}val") if pr is not None and pr.find(f"{w}{n}") is not None else None  # noqa: B023, E731
        yield part, get("tag"), get("alias"), get("id"), "".join(t.text or "" for t in e.iter(f"{w}t"))


def replace_all(text: str, pairs: dict[str, str]) -> str:
    """Several replacements in one pass: leftmost, then longest; a value is never searched again."""
    keys = sorted((k for k in pairs if k), key=len, reverse=True)
    return re.sub("|".join(map(re.escape, keys)), lambda m: pairs[m[0]], text) if keys else text


def write_document(paragraphs: Iterable[tuple[str | None, str]]) -> bytes:
    """A document of (style, text) paragraphs; tabs and line feeds become their elements."""
    body = []
    for style, text in paragraphs:
        runs = "".join("<w:tab/>" if x == "\t" else "<w:br/>" if x == "\n" else f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in re.split(r"([\t\n])", text or "") if x)
        body.append("<w:p>" + (f"<w:pPr><w:pStyle w:val={quoteattr(style)}/></w:pPr>" if style else "") + (f"<w:r>{runs}</w:r>" if runs else "") + "</w:p>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
        for name, data in {
            "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
            "_rels/.rels": f'<Relationships xmlns="{REL_PKG}"><Relationship Id="rId1" Type="{REL_DOC}/officeDocument" Target="word/document.xml"/></Relationships>',
            "word/document.xml": f'<w:document xmlns:w="{WORD_NS}"><w:body>{"".join(body)}</w:body></w:document>',
        }.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), head + data, zipfile.ZIP_DEFLATED)
    return out.getvalue()
