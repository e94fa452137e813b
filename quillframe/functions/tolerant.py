"""Tolerant typed parsing and small text rules, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import let, lets

#: Characters of an amount's text at most.
LONGEST = 128


def tolerant_decimal(s: Column) -> Column:
    """decimal(38,10) of an amount: blanks and apostrophes group, the last of , and . is the decimal point unless it occurs twice, a trailing minus counts; else null."""

    def made(t: Column) -> Column:
        negative = t.rlike("^-.*|.*-$")
        bare = F.regexp_replace(F.regexp_replace(t, "^[+-]|-$", ""), "[\\s  ’']", "")
        comma, dot = F.length(F.regexp_replace(bare, "[^,]", "")), F.length(F.regexp_replace(bare, "[^.]", ""))
        last_comma = F.length(bare) - F.length(F.substring_index(bare, ",", -1)) > F.length(bare) - F.length(F.substring_index(bare, ".", -1))
        mark = F.when(last_comma & (comma == 1), F.lit(",")).when(~last_comma & (dot == 1), F.lit("."))
        whole = F.when(mark.isNull(), bare).otherwise(F.call_function("substring_index", bare, mark, F.lit(1)))
        part = F.when(mark.isNull(), F.lit("")).otherwise(F.call_function("substring_index", bare, mark, F.lit(-1)))
        plain = F.concat(F.regexp_replace(whole, "[.,]", ""), F.lit("."), part)
        fits = bare.rlike("^[0-9.,]*[0-9][0-9.,]*$") & ~part.rlike("[.,]") & (F.length(s) <= LONGEST)
        value = F.when(fits, plain).try_cast("decimal(38,10)")
        return F.when(negative, -value).otherwise(value)

    return let(F.regexp_replace(s, "^[\\s  ]+|[\\s  ]+$", ""), made)


def compact_date(s: Column) -> Column:
    """The date of yyyyMMdd, blanks around it allowed; else null."""
    t = F.trim(s)
    return F.try_to_date(F.when(t.rlike("^[0-9]{8}$"), t), "yyyyMMdd")


def duration_seconds(s: Column) -> Column:
    """Seconds of h:mm, h:mm:ss (hours may pass 24) or of decimal hours of zero or more; else null."""

    def made(t: Column, parts: Column) -> Column:
        clock = F.get(parts, F.lit(0)).try_cast("double") * 3600 + F.get(parts, F.lit(1)).try_cast("double") * 60 + F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0))
        hours = F.when(t.rlike("^[0-9]+([.,][0-9]+)?$"), F.replace(t, F.lit(","), F.lit("."))).try_cast("double") * 3600
        return F.when(t.rlike("^[0-9]+:[0-5]?[0-9](:[0-5]?[0-9])?$"), clock).otherwise(hours)

    return lets([F.trim(s), F.split(F.trim(s), ":")], made)


def neutralised(s: Column) -> Column:
    """A CSV field that a spreadsheet would not take for a formula: an apostrophe goes before a leading tab, line end, or (after blanks) = + - @, unless the text is a plain number."""
    number = s.rlike("^\\s*[+-]?[0-9]+([.,][0-9]+)*\\s*$")
    return F.when(s.rlike("^[\\t\\r\\n]") | (s.rlike("^[\\s\\x00-\\x1F]*[=+\\-@]") & ~number), F.concat(F.lit("'"), s)).otherwise(s)


def csv_field(s: Column, delimiter: str = ",", quoting: str = "needed") -> Column:
    """A field as CSV text; a null is empty."""
    value = F.coalesce(s, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    if quoting == "always":
        return quoted
    if quoting == "never":
        return value
    return F.when(value.contains(delimiter) | value.rlike('["\\r\\n]') | value.rlike("^\\s|\\s$"), quoted).otherwise(value)


def csv_record(columns: list[Column], delimiter: str = ",", quoting: str = "needed", line_end: str = "\r\n") -> Column:
    return F.concat(F.concat_ws(delimiter, *[csv_field(c, delimiter, quoting) for c in columns]), F.lit(line_end))


def delimiter_of(first_line: Column) -> Column:
    """The most frequent of tab ; , | outside quotes, ties to the earlier; comma where there is none."""
    bare = F.regexp_replace(first_line, '"[^"]*"?', "")
    count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))

    def made(tab: Column, semicolon: Column, comma: Column, pipe: Column) -> Column:
        most = F.greatest(tab, semicolon, comma, pipe)
        return F.when(most == 0, F.lit(",")).when(tab == most, F.lit("\t")).when(semicolon == most, F.lit(";")).when(comma == most, F.lit(",")).otherwise(F.lit("|"))

    return lets([count("\t"), count(";"), count(","), count("|")], made)


def encoding_of(content: Column) -> Column:
    """The encoding of a file's bytes: by byte-order mark, else UTF-8 if valid, else Windows-1252."""
    head = F.hex(F.substring(content, 1, 4))
    marks = F.when(head.startswith("EFBBBF"), F.lit("utf-8-sig")).when(head == "FFFE0000", F.lit("utf-32-le")).when(head == "0000FEFF", F.lit("utf-32-be")).when(head.startswith("FFFE"), F.lit("utf-16-le")).when(head.startswith("FEFF"), F.lit("utf-16-be"))
    return F.coalesce(marks, F.when(F.is_valid_utf8(content.cast("string")), F.lit("utf-8")).otherwise(F.lit("windows-1252")))


# What Windows-1252 has at 80 to 9F, in order; U+FFFD where it has nothing.
WINDOWS_1252_HIGH = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"


def decode_1252(content: Column) -> Column:
    """Text of Windows-1252 bytes."""
    latin = F.decode(content, "ISO-8859-1")
    return F.translate(latin, "".join(map(chr, range(0x80, 0xA0))), WINDOWS_1252_HIGH)


def split_lines(s: Column) -> Column:
    """Lines of a text at CRLF, LF or CR, without an empty piece after a last line end."""
    lines = F.split(s, "\r\n|\n|\r")
    return F.when(F.get(lines, F.size(lines) - 1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def word_pieces(s: Column) -> Column:
    """Words and separators of a text, each separator a piece of its own."""
    return F.regexp_extract_all(s, F.lit("[\\s.,;:!?()\\[\\]{}\"']|[^\\s.,;:!?()\\[\\]{}\"']+"), F.lit(0))


def colour(s: Column) -> Column:
    """Upper-case RRGGBB of #RRGGBB, RRGGBB or AARRGGBB; else null."""
    hex6 = F.regexp_extract(F.trim(s), "^#?(?:[0-9A-Fa-f]{2})?([0-9A-Fa-f]{6})$", 1)
    return F.when(hex6 != "", F.upper(hex6))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000).cast("int")


def page_ranges(expression: str, pages: int) -> list[int]:
    """Page numbers of an expression such as 1-3,5; a page outside raises."""
    found: list[int] = []
    for part in expression.split(","):
        a, _, b = part.strip().partition("-")
        first, last = int(a), int(b or a)
        if not 1 <= first <= last <= pages:
            raise ValueError(f"pages {part.strip()} of {pages}")
        found += range(first, last + 1)
    return found


def roman(n: Column) -> Column:
    """Lower-case roman numeral of 1 to 3999; the decimal number outside."""
    # Numerals by size.
    numerals = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
    pieces, rest = [], n
    for size, text in numerals:
        pieces.append(F.repeat(F.lit(text), F.floor(rest / size).cast("int")))
        rest = rest % size
    return F.when((n >= 1) & (n <= 3999), F.concat(*pieces)).otherwise(n.cast("string"))


def letters_label(n: Column) -> Column:
    """a to z, then aa to zz: a letter repeated."""
    return F.repeat(F.char(F.lit(97) + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))


def list_label(n: Column, fmt: str) -> Column:
    """A list number in decimal, decimalZero, lower/upperLetter, lower/upperRoman, ordinal, chicago or none."""
    ordinal = F.when((n % 100).between(11, 13), F.lit("th")).when(n % 10 == 1, F.lit("st")).when(n % 10 == 2, F.lit("nd")).when(n % 10 == 3, F.lit("rd")).otherwise(F.lit("th"))
    marks = F.array(*[F.lit(m) for m in "*†‡§"])
    made = {
        "decimal": lambda: n.cast("string"),
        "decimalZero": lambda: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string")),
        "lowerLetter": lambda: letters_label(n),
        "upperLetter": lambda: F.upper(letters_label(n)),
        "lowerRoman": lambda: roman(n),
        "upperRoman": lambda: F.upper(roman(n)),
        "ordinal": lambda: F.concat(n.cast("string"), ordinal),
        "chicago": lambda: F.repeat(F.get(marks, ((n - 1) % 4).cast("int")), (F.floor((n - 1) / 4) + 1).cast("int")),
        "none": lambda: F.lit(""),
    }
    return made[fmt]()


def axis_step(low: Column, high: Column) -> Column:
    """A step of 1, 2 or 5 times a power of ten that gives about five intervals."""

    def made(raw: Column) -> Column:
        base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
        ratio = raw / base
        return F.when(ratio <= 1, base).when(ratio <= 2, base * 2).when(ratio <= 5, base * 5).otherwise(base * 10)

    return F.when(high > low, let((high - low) / 5.0, made)).otherwise(F.lit(1.0))
