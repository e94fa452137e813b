"""Number and date formats: the format's text is taken apart when the plan is made, its sections become Columns.

Up to four sections (positive, negative, zero, text) or bracket conditions; placeholders ``0 # ?``,
grouping and scaling commas, percent, exponents, literals, currency brackets, dates, elapsed times,
fractions, ``General`` and ``@``. What a format cannot show (a negative date) is ``########``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as v
from .cells import MAX_SERIAL, serial_to_date

TOO_WIDE = "########"
TOKEN = re.compile(r'"(?P<quoted>[^"]*)"?|\\(?P<escaped>.)|_(?P<skip>.)|\*(?P<fill>.)|\[(?P<bracket>[^\]]*)\]|(?P<general>General)|(?P<ampm>AM/PM|A/P)|(?P<date>[yY]+|[mM]+|[dD]+|[hH]+|[sS]+)|(?P<exponent>[eE][+-])|(?P<digit>[0#?])|(?P<other>.)', re.S)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


def sections(fmt: str) -> list[str]:
    """The sections of a format, cut at semicolons outside quotes, brackets and escapes."""
    found, now = [], ""
    for m in re.finditer(r'"[^"]*"?|\\.|\[[^\]]*\]|;|.', fmt, re.S):
        if m[0] == ";":
            found.append(now)
            now = ""
        else:
            now += m[0]
    return [*found, now]


def tokenize(section: str) -> list[Token]:
    out = []
    for m in TOKEN.finditer(section):
        kind = m.lastgroup
        text = m[kind] if kind else ""
        if kind == "quoted" or kind == "escaped":
            out.append(Token("literal", text))
        elif kind == "skip":
            out.append(Token("literal", " "))
        elif kind == "bracket":
            if re.fullmatch(r"[hH]+|[mM]+|[sS]+", text):
                out.append(Token("elapsed", text.lower()))
            elif text.startswith("$"):
                out.append(Token("literal", text[1:].split("-")[0]))
        elif kind != "fill":
            out.append(Token(kind or "other", text))
    return out


def is_date(fmt: str) -> bool:
    """Whether the first section shows a date or time."""
    return any(t.kind in ("date", "ampm") for t in tokenize(sections(fmt)[0])) and not is_elapsed(fmt)


def is_elapsed(fmt: str) -> bool:
    return any(t.kind == "elapsed" for t in tokenize(sections(fmt)[0]))


def condition(section: str):
    """A test of a number from a bracket condition such as [>=100], or None."""
    if m := re.search(r"\[(<=|>=|<>|=|<|>)\s*([+-]?[0-9.]+)\]", section):
        n = float(m[2])
        return {"<": lambda x: x < n, ">": lambda x: x > n, "<=": lambda x: x <= n, ">=": lambda x: x >= n, "=": lambda x: x == n, "<>": lambda x: x != n}[m[1]]
    return None


def format_value(x: Column, fmt: str) -> Column:
    """The text of a value under a format; booleans and errors show as they are, blanks as nothing."""
    shown = sections(fmt)
    texts = [s for s in shown if "@" in s]
    text_section = shown[3] if len(shown) > 3 else texts[0] if texts else None
    plain = F.when(x["k"] == "err", x["e"]).when(x["k"] == "bool", F.when(x["b"], F.lit("TRUE")).otherwise(F.lit("FALSE"))).when(x["k"] == "blank", F.lit(""))
    as_text = x["s"] if text_section is None else F.concat(*[x["s"] if t.kind == "other" and t.text == "@" else F.lit(t.text) for t in tokenize(text_section)], F.lit(""))
    return plain.when(x["k"] == "text", as_text).otherwise(format_number(x["n"], fmt))


def format_number(n: Column, fmt: str) -> Column:
    parts = [s for s in sections(fmt)[:3] if "@" not in s] or ["General"]
    tests = [condition(s) for s in parts]
    one = lambda s, x, negative: v.let(x, lambda y: _section(y, s, negative))
    if any(tests):
        out = None
        for s, test in zip(parts, tests, strict=True):
            shown = one(s, n, True)
            if test is not None:
                out = F.when(test(n), shown) if out is None else out.when(test(n), shown)
            elif out is not None:
                return out.otherwise(shown)
        return out.otherwise(F.lit(TOO_WIDE))
    if len(parts) == 1:
        return one(parts[0], n, True)
    negative = one(parts[1], F.abs(n), False)
    if len(parts) == 2:
        return F.when(n < 0, negative).otherwise(one(parts[0], n, True))
    return F.when(n < 0, negative).when(n == 0, one(parts[2], n, False)).otherwise(one(parts[0], n, True))


def _section(x: Column, section: str, negative: bool) -> Column:
    """One section over a number; ``negative`` asks for a minus sign where the number is below zero."""
    if section == "":
        return F.lit("")
    found = tokenize(section)
    if any(t.kind in ("date", "ampm", "elapsed") for t in found):
        return _dated(x, found)
    if any(t.kind == "general" for t in found):
        return F.concat(*[v.general(x) if t.kind == "general" else F.lit(t.text) for t in found], F.lit(""))
    text = "".join(t.text for t in found if t.kind in ("digit", "other"))
    if re.search(r"[0#?]\s*/\s*[0-9#?]", text):
        return _fraction(x, found, negative)
    return _decimal(x, found, negative)


def _decimal(x: Column, found: list[Token], negative: bool) -> Column:
    percent = sum(t.kind == "other" and t.text == "%" for t in found)
    digits = [i for i, t in enumerate(found) if t.kind == "digit"]
    if not digits:
        sign = F.when((x < 0) & F.lit(negative), F.lit("-")).otherwise(F.lit(""))
        return F.concat(sign, *[F.lit(t.text) for t in found])
    point = next((i for i, t in enumerate(found) if t.kind == "other" and t.text == "."), None)
    exponent = next((i for i, t in enumerate(found) if t.kind == "exponent"), None)
    end = exponent if exponent is not None else len(found)
    whole = [i for i in digits if i < (point if point is not None else end)]
    decimals = [i for i in digits if point is not None and point < i < end]
    after = [i for i in digits if exponent is not None and i > exponent]
    last = max([*whole, -1])
    commas = [i for i, t in enumerate(found) if t.kind == "other" and t.text == "," and i < end]
    grouping = any(whole and whole[0] < i < last for i in commas)
    scaling = sum(1 for i in commas if i > last and all(found[j].text in ",." for j in range(last + 1, i + 1)))
    places = len(decimals)
    scaled = F.abs(x) * (100.0**percent) / (1000.0**scaling)
    if exponent is not None:
        return _scientific(x, found, scaled, len(whole), places, len(after), exponent, negative)

    def made(shown: Column) -> Column:
        # Fixed text of the value rounded half away from zero at its 15 significant digits.
        left, right = F.substring_index(shown, ".", 1), F.when(shown.contains("."), F.substring_index(shown, ".", -1)).otherwise(F.lit(""))
        least = sum(found[i].text == "0" for i in whole)
        body = F.when((left == "0") & F.lit(least == 0), F.lit("")).otherwise(F.lpad(left, F.greatest(F.length(left), F.lit(least)), "0"))
        blanks = sum(found[i].text == "?" for i in whole)
        if blanks:
            body = F.lpad(body, F.greatest(F.length(body), F.lit(len([i for i in whole if found[i].text != "#"]))), " ")
        if grouping:
            body = F.regexp_replace(body, "(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")
        kept = max([k + 1 for k, i in enumerate(decimals) if found[i].text == "0"], default=0)
        tail = F.concat(F.substring(right, F.lit(1), F.lit(kept)), F.regexp_replace(F.substring(right, F.lit(kept + 1), F.lit(max(places - kept, 0))), "0+$", "")) if places else F.lit("")
        if any(found[i].text == "?" for i in decimals):
            tail = F.rpad(tail, places, " ")
        out, done_whole, done_tail = [], False, False
        for i, t in enumerate(found):
            if i in whole:
                if not done_whole:
                    out.append(body)
                done_whole = True
            elif i == point:
                if not done_whole:
                    out.append(F.when(left == "0", F.lit("")).otherwise(left))
                    done_whole = True
                out.append(F.lit("."))
            elif i in decimals:
                if not done_tail:
                    out.append(tail)
                done_tail = True
            elif i not in commas:
                out.append(F.lit(t.text))
        zero = ~shown.rlike("[1-9]")
        sign = F.when((x < 0) & ~zero & F.lit(negative), F.lit("-")).otherwise(F.lit(""))
        return F.concat(sign, *out)

    return v.let(_fixed(scaled, places), made)


def _fixed(n: Column, places: int) -> Column:
    """A number of zero or more as plain digits with so many decimals, rounded half up on its 15 significant digits."""
    if places > 15:
        return F.format_string(f"%.{places}f", n)
    near = F.format_string("%.14e", n)
    exact = F.when(n < 1e15, F.round(near.try_cast("double").cast("decimal(38,18)"), places).cast(f"decimal(38,{places})").cast("string"))
    return F.coalesce(exact, F.format_string(f"%.{places}f", n))


def _scientific(x, found, scaled, whole, places, after, at, negative) -> Column:
    def made(t: Column) -> Column:
        mantissa, e = F.substring_index(t, "e", 1), F.substring_index(t, "e", -1).cast("int")
        step = max(whole, 1)
        shift = F.pmod(e, F.lit(step)) if step > 1 else F.lit(0)
        m = _fixed(mantissa.cast("double") * F.pow(F.lit(10.0), shift), places)
        power = F.lpad(F.abs(e - shift).cast("string"), F.greatest(F.length(F.abs(e - shift).cast("string")), F.lit(max(after, 1))), "0")
        sign = F.when(e - shift < 0, F.lit("-")).otherwise(F.lit("+" if found[at].text[1] == "+" else ""))
        literals_before = [F.lit(k.text) for k in found[:at] if k.kind == "literal"]
        literals_after = [F.lit(k.text) for k in found[at + 1 :] if k.kind == "literal"]
        return F.concat(F.when((x < 0) & F.lit(negative), F.lit("-")).otherwise(F.lit("")), *literals_before, m, F.lit("E"), sign, power, *literals_after)

    return v.let(F.format_string(f"%.{min(max(places + max(whole, 1) - 1, 0), 14)}e", scaled), made)


def _fraction(x: Column, found: list[Token], negative: bool) -> Column:
    text = "".join(t.text if t.kind in ("digit", "other") else " " for t in found)
    m = re.search(r"(?:(?P<whole>[0#?]+)\s+)?(?P<num>[0#?]+)\s*/\s*(?P<den>[0-9#?]+)", text)
    fixed = int(m["den"]) if m["den"].isdigit() and int(m["den"]) else None
    most = fixed or 10 ** min(len(m["den"]), 3) - 1
    value = F.abs(x)
    base = F.floor(value) if m["whole"] else F.lit(0).cast("long")

    def best(part: Column) -> Column:
        candidates = F.array(F.lit(fixed)) if fixed else F.sequence(F.lit(1), F.lit(most))
        options = F.transform(candidates, lambda d: F.struct(F.abs(part - F.round(part * d) / d).alias("err"), d.alias("d"), F.round(part * d).cast("long").alias("n")))
        return F.array_min(options)

    def shown(f: Column) -> Column:
        carry = F.lit(bool(m["whole"])) & (f["n"] == f["d"])
        whole, n = F.when(carry, base + 1).otherwise(base), F.when(carry, F.lit(0).cast("long")).otherwise(f["n"])
        width = len(m["den"])
        fraction = F.concat(F.lpad(n.cast("string"), len(m["num"]), " "), F.lit("/"), F.rpad(f["d"].cast("string"), width, " "))
        blank = F.repeat(F.lit(" "), len(m["num"]) + 1 + width)
        sign = F.when((x < 0) & F.lit(negative), F.lit("-")).otherwise(F.lit(""))
        if m["whole"]:
            lead = F.when((whole == 0) & (n != 0) & F.lit("0" not in m["whole"]), F.lit("")).otherwise(whole.cast("string"))
            return F.concat(sign, lead, F.lit(" "), F.when(n == 0, blank).otherwise(fraction))
        return F.concat(sign, fraction)

    return v.let(best(value - base), shown)


def _dated(x: Column, found: list[Token]) -> Column:
    clock12 = any(t.kind == "ampm" for t in found)
    elapsed = any(t.kind == "elapsed" for t in found)
    fraction = 0
    for i, t in enumerate(found):
        if t.kind == "other" and t.text == "." and i and found[i - 1].text.lower().startswith("s"):
            fraction = sum(1 for k in found[i + 1 : i + 4] if k.kind == "digit" and k.text == "0")

    def made(millis: Column) -> Column:
        # The time of day, to the shown part of a second.
        days = F.floor(millis / 86_400_000)
        rest = millis - days * 86_400_000
        date = serial_to_date(days)
        hour, minute, second = F.floor(rest / 3_600_000), F.floor(rest / 60_000) % 60, F.floor(rest / 1000) % 60
        out, i = [], 0
        two = lambda c, n: F.lpad(c.cast("string"), 2, "0") if n > 1 else c.cast("string")
        while i < len(found):
            t = found[i]
            low = t.text.lower()
            if t.kind == "elapsed":
                unit = {"h": 3_600_000, "m": 60_000, "s": 1000}[low[0]]
                total = F.floor(millis / unit).cast("string")
                out.append(F.lpad(total, F.greatest(F.length(total), F.lit(len(low))), "0"))
            elif t.kind == "ampm":
                am, pm = ("AM", "PM") if len(t.text) > 3 else ("A", "P")
                out.append(F.when(hour < 12, F.lit(am)).otherwise(F.lit(pm)))
            elif t.kind == "date" and low[0] == "m" and _minutes(found, i):
                out.append(two(minute, len(low)))
            elif t.kind == "date":
                n = len(low)
                day = F.when(days == 60, 29).otherwise(F.day(date))
                month = F.when(days == 60, 2).otherwise(F.month(date))
                if low[0] == "y":
                    out.append(F.year(date).cast("string") if n > 2 else F.lpad((F.year(date) % 100).cast("string"), 2, "0"))
                elif low[0] == "m":
                    name = F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM")
                    out.append(two(month, n) if n < 3 else F.substring(name, F.lit(1), F.lit(3)) if n == 3 else F.substring(name, F.lit(1), F.lit(1)) if n == 5 else name)
                elif low[0] == "d":
                    out.append(two(day, n) if n < 3 else F.date_format(date, "EEE" if n == 3 else "EEEE"))
                elif low[0] == "h":
                    out.append(two(F.when(F.lit(clock12), (hour + 11) % 12 + 1).otherwise(hour), n))
                else:
                    out.append(two(second, n))
            elif t.kind == "other" and t.text == "." and fraction and i + 1 < len(found) and found[i + 1].kind == "digit":
                out.append(F.concat(F.lit("."), F.substring(F.lpad((rest % 1000).cast("string"), 3, "0"), F.lit(1), F.lit(fraction))))
                while i + 1 < len(found) and found[i + 1].kind == "digit":
                    i += 1
            else:
                out.append(F.lit(t.text))
            i += 1
        return F.when((x < 0) | (x >= MAX_SERIAL + 1), F.lit(TOO_WIDE)).otherwise(F.concat(*out))

    step = {0: 1000, 1: 100, 2: 10}.get(fraction, 1)
    rounding = F.floor(F.round(x * 86_400_000) / step) * step if elapsed else F.round(x * 86_400_000 / step) * step
    return v.let(rounding.cast("long"), made)


def _minutes(found: list[Token], at: int) -> bool:
    """An m is minutes right after hours or right before seconds."""
    dates = [(i, t) for i, t in enumerate(found) if t.kind in ("date", "elapsed")]
    k = next(k for k, (i, _) in enumerate(dates) if i == at)
    if len(found[at].text) > 2:
        return False
    return (k > 0 and dates[k - 1][1].text[0].lower() == "h") or (k + 1 < len(dates) and dates[k + 1][1].text[0].lower() == "s")
