"""CSV records by the lenient rules: quotes inside fields, any line end, exact record and line numbers."""

from __future__ import annotations

from collections.abc import Iterator

#: Characters of a record at most.
MAX_RECORD = 64 << 20


class CsvError(ValueError):
    """An open quote or a record that is too long, with the line where the record begins."""

    def __init__(self, what: str, line: int):
        super().__init__(f"{what} in the record at line {line}")
        self.what, self.line = what, line


def records(text: str, delimiter: str = ",", quote: str | None = '"', trim: bool = False, most: int = MAX_RECORD) -> Iterator[tuple[int, list[str]]]:
    """(line from 1, fields) of each record. A doubled quote is one; text after a closing quote stays; blank lines are no records; trim applies to unquoted fields."""
    i, n, line = 0, len(text), 1
    if text.startswith("﻿"):
        i = 1
    while i < n:
        begin, first, fields = i, line, []
        field: list[str] = []
        quoted = started = False
        while True:
            if i >= n:
                break
            c = text[i]
            if c == quote and not field and not quoted:
                quoted = started = True
                i += 1
                while True:
                    j = text.find(quote, i)
                    if j < 0:
                        raise CsvError("unterminated quote", first)
                    part = text[i:j]
                    field.append(part)
                    line += part.count("\n") + part.count("\r") - part.count("\r\n")
                    i = j + 1
                    if text[i : i + 1] == quote:
                        field.append(quote)
                        i += 1
                    else:
                        break
            elif c == delimiter:
                fields.append(_field(field, quoted, trim))
                field, quoted, started = [], False, True
                i += 1
            elif c in "\r\n":
                i += 2 if text[i : i + 2] == "\r\n" else 1
                line += 1
                break
            else:
                started = True
                field.append(c)
                i += 1
            if i - begin > most:
                raise CsvError("too many characters", first)
        if started:
            fields.append(_field(field, quoted, trim))
            yield first, fields


def _field(parts: list[str], quoted: bool, trim: bool) -> str:
    text = "".join(parts)
    return text.strip() if trim and not quoted else text


def decoded(content: bytes) -> str:
    """Text of a file by its byte-order mark, as UTF-8 if valid, else Windows-1252."""
    # Byte-order marks, longest first where one begins another.
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


def delimiter_of(text: str) -> str:
    """The most frequent of tab ; , | outside quotes on the first line; comma where there is none."""
    outside, counts = True, dict.fromkeys("\t;,|", 0)
    for c in text:
        if c == '"':
            outside = not outside
        elif c in "\r\n" and outside:
            break
        elif outside and c in counts:
            counts[c] += 1
    best = max(counts, key=lambda c: counts[c])
    return best if counts[best] else ","


def field_of(header: list[str], *aliases: str) -> int:
    """Place of the first column that meets an alias, without regard to case and blanks; -1 where none does."""
    wanted = {a.strip().casefold() for a in aliases}
    return next((k for k, h in enumerate(header) if h.strip().casefold() in wanted), -1)
