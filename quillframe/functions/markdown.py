"""Markdown to HTML: block structure first, then inlines; tables, task lists, strikethrough and bare links as extensions.

Raw HTML is shown as text; links with a scheme that is not allowed lose their target.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from dataclasses import dataclass, field
from urllib.parse import quote

MAX_DEPTH = 128
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
BULLET = re.compile(r"( {0,3})([-+*])(?:([ \t]+)|$)")
ORDERED = re.compile(r"( {0,3})(\d{1,9})([.)])(?:([ \t]+)|$)")
REFERENCE = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.){1,999})\]:\s*(?:<([^<>\n]*)>|(\S+))(?:\s+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)))?\s*$")
DELIMITER_ROW = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class Block:
    kind: str
    lines: list[str] = field(default_factory=list)
    children: list[Block] = field(default_factory=list)
    level: int = 0
    info: str = ""
    start: int = 1
    tight: bool = True
    cells: list[list[str]] = field(default_factory=list)
    align: list[str] = field(default_factory=list)


def to_html(source: str) -> str:
    references: dict[str, tuple[str, str]] = {}
    text = source.replace("\x00", "�").replace("\r\n", "\n").replace("\r", "\n")
    found = blocks([_untabbed(line) for line in text.split("\n")], references, 0)
    return "".join(_render(b, references) for b in found)


def _untabbed(line: str) -> str:
    """Leading tabs as blanks to the next column of four."""
    out = ""
    for i, c in enumerate(line):
        if c == "\t":
            out += " " * (4 - len(out) % 4)
        elif c == " ":
            out += " "
        else:
            return out + line[i:]
    return out


def split_row(line: str) -> list[str]:
    """Cells of a table's row; an escaped pipe belongs to its cell."""
    bare = line.strip()
    bare = bare[1:] if bare.startswith("|") else bare
    bare = bare[:-1] if bare.endswith("|") and not bare.endswith("\\|") else bare
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", bare)]


def _starts_block(line: str) -> bool:
    """Whether a line ends a paragraph before it."""
    ordered = ORDERED.match(line)
    bullet = BULLET.match(line)
    return bool(RULE.match(line) or ATX.match(line) or FENCE.match(line) or re.match(r" {0,3}>", line) or (bullet and line[bullet.end() :].strip()) or (ordered and int(ordered[2]) == 1 and line[ordered.end() :].strip()))


def blocks(lines: list[str], references: dict, depth: int) -> list[Block]:
    out: list[Block] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif line.startswith("    "):
            j = i
            while j < len(lines) and (lines[j].startswith("    ") or not lines[j].strip()):
                j += 1
            body = [x[4:] for x in lines[i:j]]
            while body and not body[-1].strip():
                body.pop()
            out.append(Block("code", body))
            i = j
        elif m := FENCE.match(line):
            indent, fence, j = len(line) - len(line.lstrip(" ")), m[1], i + 1
            close = re.compile(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$")
            while j < len(lines) and not close.match(lines[j]):
                j += 1
            out.append(Block("code", [re.sub(rf"^ {{0,{indent}}}", "", x) for x in lines[i + 1 : j]], info=m[2].strip()))
            i = j + 1
        elif m := ATX.match(line):
            out.append(Block("heading", [m[2] or ""], level=len(m[1])))
            i += 1
        elif RULE.match(line):
            out.append(Block("rule"))
            i += 1
        elif re.match(r" {0,3}>", line) and depth < MAX_DEPTH:
            body, j, lazy = [], i, False
            while j < len(lines):
                if re.match(r" {0,3}>", lines[j]):
                    body.append(_untabbed(re.sub(r"^ {0,3}> ?", "", lines[j])))
                    lazy = bool(body[-1].strip()) and not _starts_block(body[-1]) and not body[-1].startswith("    ")
                elif lazy and lines[j].strip() and not _starts_block(lines[j]):
                    body.append(lines[j].lstrip())
                else:
                    break
                j += 1
            out.append(Block("quote", children=blocks(body, references, depth + 1)))
            i = j
        elif (BULLET.match(line) or ORDERED.match(line)) and depth < MAX_DEPTH:
            i = _list(lines, i, out, references, depth)
        elif (m := REFERENCE.match(line)) and "[" not in m[1]:
            key = _label(m[1])
            references.setdefault(key, (_unescape(m[2] if m[2] is not None else m[3]), _unescape(next((g for g in m.groups()[3:] if g is not None), ""))))
            i += 1
        elif i + 1 < len(lines) and "|" in line + lines[i + 1] and DELIMITER_ROW.match(lines[i + 1]) and len(split_row(line)) == len(split_row(lines[i + 1])):
            i = _table(lines, i, out)
        else:
            j, level = i + 1, 0
            while j < len(lines) and lines[j].strip():
                if m := re.match(r" {0,3}(=+|-+)[ \t]*$", lines[j]):
                    level = 1 if m[1][0] == "=" else 2
                    break
                if _starts_block(lines[j]):
                    break
                j += 1
            body = [x.lstrip() for x in lines[i:j]]
            out.append(Block("heading", ["\n".join(body).strip()], level=level) if level else Block("paragraph", body))
            i = j + (1 if level else 0)
    return out


def _list(lines: list[str], i: int, out: list[Block], references: dict, depth: int) -> int:
    first_bullet = BULLET.match(lines[i])
    first = first_bullet or ORDERED.match(lines[i])
    mark = first[2] if first_bullet else first[3]
    block = Block("bullets" if first_bullet else "numbers", start=1 if first_bullet else int(first[2]))
    loose = False
    while i < len(lines):
        bullet, ordered = BULLET.match(lines[i]), ORDERED.match(lines[i])
        m = bullet if first_bullet else ordered
        if not m or (m[2] if first_bullet else m[3]) != mark or RULE.match(lines[i]):
            break
        space = m[3] if first_bullet else m[4]
        width = m.end() if space and len(space) <= 4 else m.end() - len(space or "") + 1
        body, j, blank = [lines[i][width:] if len(lines[i]) >= width else ""], i + 1, False
        inner_blank = False
        while j < len(lines):
            if not lines[j].strip():
                body.append("")
                blank = True
            elif lines[j].startswith(" " * width):
                inner_blank |= blank
                body.append(lines[j][width:])
                blank = False
            elif not blank and not _starts_block(lines[j]) and not (BULLET.match(lines[j]) or ORDERED.match(lines[j])) and body[-1].strip():
                body.append(lines[j].lstrip())
            else:
                break
            j += 1
        more = j < len(lines) and (BULLET if first_bullet else ORDERED).match(lines[j]) is not None
        children = blocks(body, references, depth + 1)
        loose |= (blank and more) or (inner_blank and len(children) > 1 and not (len(children) == 2 and children[1].kind in ("bullets", "numbers")))
        block.children.append(Block("item", children=children))
        i = j
    block.tight = not loose
    out.append(block)
    return i


def _table(lines: list[str], i: int, out: list[Block]) -> int:
    align = ["center" if c.startswith(":") and c.endswith(":") else "right" if c.endswith(":") else "left" if c.startswith(":") else "" for c in split_row(lines[i + 1])]
    rows, j = [split_row(lines[i])], i + 2
    while j < len(lines) and lines[j].strip() and not _starts_block(lines[j]):
        cells = split_row(lines[j])
        rows.append((cells + [""] * len(align))[: len(align)])
        j += 1
    out.append(Block("table", cells=rows, align=align))
    return j


def _render(b: Block, references: dict) -> str:
    inline = lambda s: inlines(s, references)
    if b.kind == "heading":
        return f"<h{b.level}>{inline(b.lines[0])}</h{b.level}>\n"
    if b.kind == "paragraph":
        return f"<p>{inline(chr(10).join(b.lines).rstrip())}</p>\n"
    if b.kind == "code":
        language = b.info.split()[0] if b.info else ""
        kind = f' class="language-{_escape(_unescape(language))}"' if language else ""
        return f"<pre><code{kind}>{_escape(''.join(x + chr(10) for x in b.lines))}</code></pre>\n"
    if b.kind == "rule":
        return "<hr />\n"
    if b.kind == "quote":
        return "<blockquote>\n" + "".join(_render(c, references) for c in b.children) + "</blockquote>\n"
    if b.kind == "table":
        cell = lambda tag, k, s: f"<{tag}" + (f' align="{b.align[k]}"' if b.align[k] else "") + f">{inline(s)}</{tag}>\n"
        row = lambda tag, cells: "<tr>\n" + "".join(cell(tag, k, s) for k, s in enumerate(cells)) + "</tr>\n"
        body = "<tbody>\n" + "".join(row("td", r) for r in b.cells[1:]) + "</tbody>\n" if len(b.cells) > 1 else ""
        return "<table>\n<thead>\n" + row("th", b.cells[0]) + "</thead>\n" + body + "</table>\n"
    tag = "ul" if b.kind == "bullets" else "ol"
    start = f' start="{b.start}"' if b.kind == "numbers" and b.start != 1 else ""
    return f"<{tag}{start}>\n" + "".join(_item(c, b.tight, references) for c in b.children) + f"</{tag}>\n"


def _item(item: Block, tight: bool, references: dict) -> str:
    task = ""
    first = item.children[0] if item.children else None
    if first is not None and first.kind == "paragraph" and (m := re.match(r"\[([ xX])\]\s", first.lines[0])):
        task = f'<input{" checked=" + chr(34) + chr(34) if m[1] in "xX" else ""} disabled="" type="checkbox"> '
        first.lines[0] = first.lines[0][m.end() :]
    parts = []
    for c in item.children:
        made = _render(c, references)
        if tight and c.kind == "paragraph":
            made = made[3:-5]
            parts.append(made if c is item.children[-1] else made + "\n")
        else:
            parts.append(made if parts and parts[-1].endswith("\n") else "\n" + made)
    return f"<li>{task}{''.join(parts)}</li>\n"


def _escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _unescape(s: str) -> str:
    return entities.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", s))


def _label(s: str) -> str:
    return " ".join(s.split()).casefold()


def safe_url(url: str, image: bool = False) -> bool:
    """http, https, mailto and relative targets; images also as data of common types."""
    bare = re.sub(r"[\x00-\x20\x7f]", "", url)
    if image and re.match(r"data:image/(?:png|gif|jpeg|webp)[;,]", bare, re.I):
        return True
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", bare)
    return not m or m[1].lower() in ("http", "https", "mailto")


def normalised_url(url: str) -> str:
    return quote(url, safe="%!#$&'()*+,-./:;=?@_~[]").replace("[", "%5B").replace("]", "%5D")


@dataclass
class _Run:
    """A run of delimiters that may open or close emphasis."""

    text: str
    opens: bool
    closes: bool


def inlines(s: str, references: dict) -> str:
    out: list = []
    brackets: list[tuple[int, int, bool]] = []  # place in out, place in s, image
    i = 0
    while i < len(s):
        c = s[i]
        if c == "\\" and i + 1 < len(s):
            if s[i + 1] == "\n":
                out.append("<br />\n")
                i += 2
                while i < len(s) and s[i] == " ":
                    i += 1
            else:
                out.append(_escape(s[i + 1]) if s[i + 1] in PUNCTUATION else "\\" + _escape(s[i + 1]))
                i += 2
        elif c == "`":
            n = len(re.match(r"`+", s[i:])[0])
            close = re.compile(rf"(?<!`)`{{{n}}}(?!`)").search(s, i + n)
            if close:
                code = s[i + n : close.start()].replace("\n", " ")
                if code.startswith(" ") and code.endswith(" ") and code.strip(" "):
                    code = code[1:-1]
                out.append(f"<code>{_escape(code)}</code>")
                i = close.end()
            else:
                out.append("`" * n)
                i += n
        elif c in "*_~":
            n = len(re.match(re.escape(c) + "+", s[i:])[0])
            out.append(_run(s, i, n))
            i += n
        elif c == "!" and s[i + 1 : i + 2] == "[":
            brackets.append((len(out), i + 2, True))
            out.append("![")
            i += 2
        elif c == "[":
            brackets.append((len(out), i + 1, False))
            out.append("[")
            i += 1
        elif c == "]" and brackets:
            i = _bracket(s, i, out, brackets, references)
        elif c == "<" and (m := re.match(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>|<([\w.+-]+@[\w-]+(?:\.[\w-]+)+)>", s[i:])):
            target = m[1] or "mailto:" + m[2]
            out.append(f'<a href="{_escape(normalised_url(target))}">{_escape(m[1] or m[2])}</a>' if safe_url(target) else _escape(m[0][1:-1]))
            i += m.end()
        elif c == "&" and (m := re.match(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", s[i:])):
            plain = entities.unescape(m[0])
            out.append(_escape(plain))
            i += m.end()
        elif c == "\n":
            hard = bool(out) and isinstance(out[-1], str) and out[-1].endswith("  ")
            if out and isinstance(out[-1], str):
                out[-1] = out[-1].rstrip(" ")
            out.append("<br />\n" if hard else "\n")
            i += 1
            while i < len(s) and s[i] == " ":
                i += 1
        elif (i == 0 or not s[i - 1].isalnum()) and (m := re.match(r"(?:https?://|www\.)[\w-]+(?:\.[\w-]+)+[^\s<]*", s[i:])) and not brackets:
            text = re.sub(r"[?!.,:*_~'\"]+$", "", m[0])
            while text.endswith(")") and text.count(")") > text.count("("):
                text = text[:-1]
            target = text if "://" in text else "http://" + text
            out.append(f'<a href="{_escape(normalised_url(target))}">{_escape(text)}</a>')
            i += len(text)
        else:
            m = re.compile(r"[^\\`*_~!\[\]<&\nhw]+|.", re.S).match(s, i)
            out.append(_escape(m[0]))
            i = m.end()
    return "".join(_emphasised(out))


def _run(s: str, i: int, n: int) -> _Run:
    before, after = s[i - 1] if i else " ", s[i + n] if i + n < len(s) else " "
    blank = lambda c: c.isspace()
    mark = lambda c: unicodedata.category(c)[0] in "PS"
    left = not blank(after) and (not mark(after) or blank(before) or mark(before))
    right = not blank(before) and (not mark(before) or blank(after) or mark(after))
    if s[i] == "_":
        return _Run(s[i] * n, left and (not right or mark(before)), right and (not left or mark(after)))
    return _Run(s[i] * n, left and (s[i] != "~" or n <= 2), right and (s[i] != "~" or n <= 2))


def _bracket(s: str, i: int, out: list, brackets: list, references: dict) -> int:
    at, begin, image = brackets.pop()
    m = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)))?\s*\)").match(s, i + 1)
    if m:
        target, end = (_unescape(m[1] if m[1] is not None else m[2]), _unescape(next((g for g in m.groups()[2:] if g is not None), ""))), m.end()
    else:
        r = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(s, i + 1)
        target, end = references.get(_label(r[1] or s[begin:i])) if r else None, r.end() if r else i + 1
        if target is None:
            target, end = references.get(_label(s[begin:i])), i + 1
    if target is None:
        out.append("]")
        return i + 1
    url, title = target
    inside = "".join(_emphasised(out[at + 1 :]))
    del out[at:]
    shown = f' title="{_escape(title)}"' if title else ""
    if image:
        alt = re.sub(r"<[^>]*>", "", re.sub(r'<img [^>]*alt="([^"]*)"[^>]*>', r"\1", inside))
        out.append(f'<img src="{_escape(normalised_url(url))}" alt="{alt}"{shown} />' if safe_url(url, True) else alt)
    elif safe_url(url):
        out.append(f'<a href="{_escape(normalised_url(url))}"{shown}>{inside}</a>')
        brackets[:] = [b for b in brackets if b[2]]
    else:
        out.append(inside)
    return end


def _emphasised(items: list) -> list[str]:
    """Text with the delimiter runs paired: closers look back for the nearest opener of their kind."""
    parts: list = [[x.text, x] if isinstance(x, _Run) else x for x in items]
    lengths = {k: len(p[0]) for k, p in enumerate(parts) if isinstance(p, list)}
    before: dict[int, str] = {k: "" for k in lengths}
    after: dict[int, str] = {k: "" for k in lengths}
    runs, k = sorted(lengths), 0
    live: list[int] = []
    while k < len(runs):
        closer = runs[k]
        c = parts[closer][1]
        found = None
        if c.closes and lengths[closer]:
            for o in reversed(live):
                opener = parts[o][1]
                if opener.text[0] != c.text[0] or not lengths[o]:
                    continue
                if c.text[0] == "~":
                    if len(opener.text) == len(c.text):
                        found = o
                        break
                    continue
                if (opener.closes or c.opens) and (len(opener.text) + len(c.text)) % 3 == 0 and (len(opener.text) % 3 or len(c.text) % 3):
                    continue
                found = o
                break
        if found is None:
            if c.opens:
                live.append(closer)
            k += 1
            continue
        if c.text[0] == "~":
            n, tag = lengths[closer], "del"
        else:
            n = 2 if min(lengths[found], lengths[closer]) >= 2 else 1
            tag = "strong" if n == 2 else "em"
        after[found] = f"<{tag}>" + after[found]
        before[closer] += f"</{tag}>"
        lengths[found] -= n
        lengths[closer] -= n
        live = [o for o in live if o <= found and lengths[o]]
        if not lengths[closer]:
            k += 1
    return [before[k] + p[0][0] * lengths[k] + after[k] if isinstance(p, list) else p for k, p in enumerate(parts)]
