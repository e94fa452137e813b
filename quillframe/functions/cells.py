"""Cell addresses and date serials, as plain functions (plan time) and as Columns (data)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A sheet's limits and the last serial (31 December 9999).
MAX_ROW, MAX_COLUMN, MAX_SERIAL = 1_048_576, 16_384, 2_958_465


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def parse_reference(text: str) -> tuple[int, int, int, int]:
    """(r1, c1, r2, c2), normalised, of A1, A1:B2, A:C or 1:3; $ has no effect."""
    bare = text.replace("$", "")
    if m := re.fullmatch(r"([A-Za-z]{1,3})(\d+)(?::([A-Za-z]{1,3})(\d+))?", bare):
        r, c = [int(m[2]), int(m[4] or m[2])], [column_number(m[1]), column_number(m[3] or m[1])]
    elif m := re.fullmatch(r"([A-Za-z]{1,3}):([A-Za-z]{1,3})", bare):
        r, c = [1, MAX_ROW], [column_number(m[1]), column_number(m[2])]
    elif m := re.fullmatch(r"(\d+):(\d+)", bare):
        r, c = [int(m[1]), int(m[2])], [1, MAX_COLUMN]
    else:
        raise ValueError(f"no reference: {text}")
    if min(r) < 1 or max(r) > MAX_ROW or max(c) > MAX_COLUMN:
        raise ValueError(f"outside the sheet: {text}")
    return min(r), min(c), max(r), max(c)


def letters_to_number(letters: Column) -> Column:
    """A column's number from its letters; null where they are none or beyond the sheet."""
    n = F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))
    return F.when(letters.rlike("^[A-Za-z]{1,3}$") & (n <= MAX_COLUMN), n)


def number_to_letters(n: Column) -> Column:
    """Letters of a column's number from 1 to 16384; null outside."""
    a, b = F.floor((n - 1) / 26), F.floor((n - 703) / 676)
    char = lambda k: F.char(65 + k)
    third = F.when(n > 702, char(b)).otherwise(F.lit(""))
    second = F.when(n > 702, char(F.floor((n - 703 - b * 676) / 26))).when(n > 26, char(a - 1)).otherwise(F.lit(""))
    return F.when((n >= 1) & (n <= MAX_COLUMN), F.concat(third, second, char(F.pmod(n - 1, F.lit(26)))))


def address(row: Column, column: Column) -> Column:
    return F.concat(number_to_letters(column), row.cast("string"))


def address_row(a1: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(a1, "\\$", ""), "^[A-Za-z]+([0-9]+)$", 1).try_cast("int")


def address_column(a1: Column) -> Column:
    return letters_to_number(F.regexp_extract(F.regexp_replace(a1, "\\$", ""), "^([A-Za-z]+)[0-9]+$", 1))


def serial_to_date(serial: Column, date1904: bool = False) -> Column:
    """The date of a serial's whole days; serials 1 to 59 lie a day later than the epoch says, 60 (which never was) reads as 28 February; null outside."""
    days = F.floor(serial).cast("int")
    if date1904:
        return F.when((days >= 0) & (days <= MAX_SERIAL - 1462), F.date_add(F.lit("1904-01-01").cast("date"), days))
    shifted = F.when(days < 60, days + 1).when(days == 60, F.lit(60) - 1 + 1).otherwise(days)
    return F.when((days >= 0) & (days <= MAX_SERIAL), F.date_add(F.lit("1899-12-30").cast("date"), F.when(days == 60, 60).otherwise(shifted)))


def date_to_serial(date: Column, date1904: bool = False) -> Column:
    """Whole days of a date or timestamp, and its time as a fraction rounded to milliseconds."""
    day = date.cast("date")
    if date1904:
        whole = F.datediff(day, F.lit("1904-01-01").cast("date"))
    else:
        days = F.datediff(day, F.lit("1899-12-30").cast("date"))
        whole = F.when(days < 61, days - 1).otherwise(days)
    millis = F.unix_millis(date.cast("timestamp")) - F.unix_millis(day.cast("timestamp"))
    return whole + millis / F.lit(86_400_000.0)
