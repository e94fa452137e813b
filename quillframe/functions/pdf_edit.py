"""PDF files put together from pages of others, their description and form fields."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from .pdf import Document, Name, Ref, Stream


def _written(v, number) -> bytes:
    """A value as PDF text; number gives a reference's new number, or None for an object that is not taken along."""
    if isinstance(v, Ref):
        n = number(v)
        return b"null" if n is None else b"%d 0 R" % n
    if isinstance(v, Name):
        return b"/" + re.sub(rb"[^!-~]|[#/%()<>\[\]{}]", lambda m: b"#%02X" % m[0][0], v.encode("latin-1"))
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        return (f"{v:.6f}".rstrip("0").rstrip(".") or "0").encode()
    if isinstance(v, (bytes, str)):
        return b"<" + (v if isinstance(v, bytes) else v.encode("latin-1", "replace")).hex().encode() + b">"
    if isinstance(v, dict):
        return b"<<" + b"".join(_written(Name(k), number) + b" " + _written(x, number) for k, x in v.items()) + b">>"
    return b"[" + b" ".join(_written(x, number) for x in v) + b"]"


def assembled(pages: Iterable[tuple[Document, dict, int]]) -> bytes:
    """A file of pages, each (its document, its dictionary as ``Document.pages`` gives it, degrees to turn it by).

    What a page needs is taken along once per document. References to other pages, page trees and
    catalogues become null, so links between pages are lost.
    """
    bodies: list[bytes | None] = [None, None]  # the catalogue and the page tree
    known: dict[tuple[int, int], int | None] = {}
    waiting: list[tuple[Document, int, int]] = []
    kids: list[int] = []

    def numbers(doc: Document):
        def number(ref: Ref) -> int | None:
            key = (id(doc), ref[0])
            if key not in known:
                found = doc.get(ref)
                taken = found is not None and not (isinstance(found, dict) and found.get("Type") in ("Page", "Pages", "Catalog"))
                if taken:
                    bodies.append(None)
                    waiting.append((doc, ref[0], len(bodies)))
                known[key] = len(bodies) if taken else None
            return known[key]

        return number

    held: list[Document] = []  # keeps documents alive, whose ids are keys
    for doc, page, turn in pages:
        held.append(doc)
        own = {k: v for k, v in page.items() if k != "Parent"}
        own |= {"Type": Name("Page"), "Parent": None, "Rotate": (int(doc.get(page.get("Rotate")) or 0) + turn) % 360}
        bodies.append(None)
        place = len(bodies)
        kids.append(place)
        bodies[place - 1] = _written(own, numbers(doc)).replace(b"/Parent null", b"/Parent 2 0 R")
        while waiting:
            source, old, new = waiting.pop()
            value = source.get(Ref((old, 0)))
            if isinstance(value, Stream):
                bodies[new - 1] = _written({**value, "Length": len(value.data)}, numbers(source)) + b"\nstream\n" + value.data + b"\nendstream"
            else:
                bodies[new - 1] = _written(value, numbers(source))
    bodies[0] = b"<</Type/Catalog/Pages 2 0 R>>"
    bodies[1] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = bytearray(b"%PDF-1.7\n"), []
    for n, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, start))


def merged(contents: Iterable[bytes]) -> bytes:
    return assembled((doc, page, 0) for doc in map(Document, contents) for page in doc.pages())


def extracted(content: bytes, numbers: Iterable[int], turn: int = 0) -> bytes:
    """The pages of these numbers (from 1) in the order given, turned."""
    doc = Document(content)
    pages = doc.pages()
    wanted = list(numbers)
    if any(not 1 <= n <= len(pages) for n in wanted):
        raise ValueError(f"a page outside 1 to {len(pages)}")
    return assembled((doc, pages[n - 1], turn) for n in wanted)


def text_of(value: object) -> str | None:
    """A text string: UTF-16 or UTF-8 by mark, else Latin."""
    if not isinstance(value, bytes):
        return None
    if value[:2] == b"\xfe\xff":
        return value[2:].decode("utf-16-be", "replace")
    if value[:3] == b"\xef\xbb\xbf":
        return value[3:].decode("utf-8", "replace")
    return value.decode("latin-1")


def information(content: bytes) -> Iterator[tuple]:
    """One row: title, author, subject, keywords, creator, producer, creation and change date as written."""
    doc = Document(content)
    refs = re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", content)
    info = doc.get(Ref((int(refs[-1]), 0))) if refs else None
    info = info if isinstance(info, dict) else {}
    yield tuple((text_of(doc.get(info.get(k))) or "").rstrip("\0") or None for k in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate"))


def form_fields(content: bytes) -> Iterator[tuple]:
    """(name, kind, value, flags, options) of each terminal field; a name is the path of partial names, joined by periods; kind, value and flags are inherited."""
    doc = Document(content)
    catalog = next((o for o in (doc.get(Ref((n, 0))) for n in sorted({*doc.at, *doc.packed}, reverse=True)) if isinstance(o, dict) and o.get("Type") == "Catalog"), {})
    form = doc.get(catalog.get("AcroForm")) or {}
    stack = [(f, "", {}) for f in reversed(doc.get(form.get("Fields")) or [])]
    seen: set[int] = set()
    while stack:
        ref, path, inherited = stack.pop()
        if isinstance(ref, Ref):
            if ref[0] in seen:
                continue
            seen.add(ref[0])
        field = doc.get(ref)
        if not isinstance(field, dict):
            continue
        part = text_of(doc.get(field.get("T")))
        name = path if part is None else f"{path}.{part}" if path else part
        own = inherited | {k: field[k] for k in ("FT", "V", "Ff", "Opt") if k in field}
        kids = [k for k in doc.get(field.get("Kids")) or [] if isinstance(doc.get(k), dict) and "T" in doc.get(k)]
        if kids:
            stack += [(k, name, own) for k in reversed(kids)]
            continue
        value = doc.get(own.get("V"))
        shown = str(value) if isinstance(value, Name) else "\n".join(text_of(doc.get(x)) or "" for x in value) if isinstance(value, list) else text_of(value)
        options = [text_of(doc.get(o[-1] if isinstance(o, list) else o)) or "" for o in map(doc.get, doc.get(own.get("Opt")) or [])]
        yield name, str(own.get("FT") or ""), shown, int(doc.get(own.get("Ff")) or 0), options
