"""Worksheet values as Columns: a struct tagged blank, num, text, bool or err.

Errors are values that travel through expressions, blanks compare as the empty value of their
counterpart, numbers are finite doubles without negative zero. Nothing here raises under ANSI mode.

A value that is made here is a ``Value``: it knows which kinds it can have and holds its fields as
expressions of their own, so formulas over typed columns become plain expressions that code generation
takes; the struct is only built where a value leaves for a column or an array. ``when`` merges values field by field.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

TYPE = "struct<k:string,n:double,s:string,b:boolean,e:string>"
# The error codes of worksheets.
DIV0, VALUE, REF, NAME, NUM, NA, NULL = "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#NULL!"
ERRORS = (DIV0, VALUE, REF, NAME, NUM, NA, NULL, "#GETTING_DATA")
MAX_TEXT = 32767


#: Length of an expression, as text, up to which it is repeated rather than bound.
LIGHT_VALUE, LIGHT = 2500, 160
#: Expressions that are bound at any length: a row pays much for each.
DEAR = re.compile("format_string|lambda|split|transform|filter|aggregate|date_format", re.I)
FIELDS = {"n": ("num", "double"), "s": ("text", "string"), "b": ("bool", "boolean"), "e": ("err", "string")}
KINDS = frozenset({"blank", "num", "text", "bool", "err"})


class Value(ClassicColumn):
    """A value by its possible kinds and its fields, of which one at most is not null; all are for blank."""

    def __init__(self, kinds, **fields: Column):
        self.kinds = frozenset(kinds)
        self.fields = {f: fields.get(f) if FIELDS[f][0] in self.kinds else None for f in FIELDS}
        self._struct = None

    @property
    def _jc(self):
        if self._struct is None:
            self._struct = F.struct(self["k"].alias("k"), *[self[f].cast(t).alias(f) for f, (_, t) in FIELDS.items()])
        return self._struct._jc

    def __getitem__(self, name: str) -> Column:
        if name != "k":
            found = self.fields[name]
            return F.lit(None).cast(FIELDS[name][1]) if found is None else found
        if len(self.kinds) == 1:
            return F.lit(next(iter(self.kinds)))
        tests = [(k, self.fields[f]) for f, (k, _) in FIELDS.items() if k in self.kinds]
        last = "blank" if "blank" in self.kinds else tests.pop()[0]
        out = F.when(tests[0][1].isNotNull(), F.lit(tests[0][0]))
        for k, c in tests[1:]:
            out = out.when(c.isNotNull(), F.lit(k))
        return out.otherwise(F.lit(last))

    def is_(self, kind: str) -> Column:
        """Whether the value is of a kind."""
        if kind not in self.kinds or len(self.kinds) == 1:
            return F.lit(kind in self.kinds)
        held = {k: f for f, (k, _) in FIELDS.items()}
        return self.fields[held[kind]].isNotNull() if kind in held else self["k"] == kind

    def light(self) -> bool:
        shown = [str(c._jc) for c in self.fields.values() if c is not None]
        return sum(map(len, shown)) <= LIGHT_VALUE and not any(map(DEAR.search, shown))


class Case(ClassicColumn):
    """``F.when`` over values; with ``otherwise`` it is a value again."""

    def __init__(self, branches: list[tuple[Column, Column]]):
        self.branches = branches

    @property
    def _jc(self):
        return self._chain()._jc

    def _chain(self) -> Column:
        out = F.when(*self.branches[0])
        for c, x in self.branches[1:]:
            out = out.when(c, x)
        return out

    def when(self, condition: Column, value: Column) -> Column:
        return Case([*self.branches, (condition, value)])

    def otherwise(self, value: Column) -> Column:
        made = [x for _, x in self.branches] + [value]
        if not all(isinstance(x, Value) for x in made):
            return self._chain().otherwise(value)
        fields = {}
        for f in FIELDS:
            if any(x.fields[f] is not None for x in made):
                out = F.when(self.branches[0][0], made[0][f])
                for (c, _), x in zip(self.branches[1:], made[1:], strict=False):
                    out = out.when(c, x[f])
                fields[f] = out.otherwise(value[f])
        return Value(frozenset().union(*[x.kinds for x in made]), **fields)


def when(condition: Column, value: Column) -> Column:
    """``F.when``, for values too."""
    return Case([(condition, value)]) if isinstance(value, Value) else F.when(condition, value)


def of_struct(c: Column, kinds=KINDS) -> Value:
    """A value out of a struct column."""
    return Value(kinds, **{f: c[f] for f in FIELDS})


def kinds_of(v: Column) -> frozenset[str]:
    return v.kinds if isinstance(v, Value) else KINDS


def _is_light(value) -> bool:
    if isinstance(value, Value):
        return value.light()
    shown = str(value._jc)
    return len(shown) <= LIGHT and not DEAR.search(shown)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body mentions it; a short expression is repeated instead."""
    if _is_light(value):
        return body(value)
    return F.transform(F.array(value), lambda x: body(of_struct(x, value.kinds) if isinstance(value, Value) else x))[0]


def lets(values: list[Column], body: Callable[..., Column]) -> Column:
    """let for several values: those that are long travel as fields of one struct."""
    bound = [i for i, c in enumerate(values) if not _is_light(c)]
    if not bound:
        return body(*values)

    def made(x: Column) -> Column:
        back = {i: of_struct(x[f"v{i}"], values[i].kinds) if isinstance(values[i], Value) else x[f"v{i}"] for i in bound}
        return body(*[back.get(i, c) for i, c in enumerate(values)])

    return F.transform(F.array(F.struct(*[values[i].alias(f"v{i}") for i in bound])), made)[0]


def blank() -> Column:
    return Value({"blank"})


def err(code: str | Column) -> Column:
    return Value({"err"}, e=F.lit(code) if isinstance(code, str) else code)


def text(c: Column | str) -> Column:
    return Value({"text"}, s=F.lit(c) if isinstance(c, str) else c)


def boolean(c: Column | bool) -> Column:
    return Value({"bool"}, b=F.lit(c) if isinstance(c, bool) else c)


def number(c: Column | float) -> Column:
    """A number; #NUM! where it is null or not finite; minus zero becomes zero."""
    if isinstance(c, int | float):
        return Value({"num"}, n=F.lit(float(c) + 0.0))

    def made(x: Column) -> Column:
        finite = F.abs(x) < float("inf")
        return Value({"num", "err"}, n=F.when(finite, x + F.lit(0.0)), e=F.when(~F.coalesce(finite, F.lit(False)), F.lit(NUM)))

    return let(c.cast("double"), made)


def from_column(c: Column, kind: str) -> Column:
    """The value of a table's column: NULL is blank."""
    if kind != "num":
        return Value({"blank", kind}, **{"s" if kind == "text" else "b": c})
    finite = F.abs(c.cast("double")) < float("inf")
    return Value({"blank", "num", "err"}, n=F.when(finite, c.cast("double") + F.lit(0.0)), e=F.when(~finite, F.lit(NUM)))


def to_json_text(v: Column) -> Column:
    """A value as one text, for results: numbers to 15 digits, TRUE/FALSE, error codes, empty for blank."""

    def made(x: Column) -> Column:
        return F.when(_is(x, "err"), x["e"]).otherwise(_plain(x)) if "err" in kinds_of(x) else _plain(x)

    return let(v, made)


def _is(x: Column, kind: str) -> Column:
    return x.is_(kind) if isinstance(x, Value) else x["k"] == kind


def general(x: Column) -> Column:
    """A number in General format: 15 significant digits, fixed for exponents from -10 to 14, else scientific."""

    def with_digits(sign: Column, digits: Column, e: Column) -> Column:
        point = e + 1
        whole = F.when(e >= 0, F.rpad(F.substring(digits, F.lit(1), point), point, "0")).otherwise(F.lit("0"))
        part = F.when(e >= 0, F.substring(digits, point + 1, F.lit(20))).otherwise(F.concat(F.repeat(F.lit("0"), -e - 1), digits))
        fixed = F.concat(whole, F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part)))
        rest = F.substring(digits, F.lit(2), F.lit(20))
        science = F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("."), rest)), F.when(e < 0, F.lit("E-")).otherwise(F.lit("E+")), F.lpad(F.abs(e).cast("string"), F.greatest(F.length(F.abs(e).cast("string")), F.lit(2)), "0"))
        return F.concat(sign, F.when((e >= -10) & (e <= 14) & (F.length(fixed) <= 20), fixed).otherwise(science))

    def made(t: Column) -> Column:
        sign = F.when(t.startswith("-"), F.lit("-")).otherwise(F.lit(""))
        bare = F.regexp_replace(t, "^-", "")
        digits = F.regexp_replace(F.regexp_replace(F.substring_index(bare, "e", 1), "\\.", ""), "0+$", "")
        e = F.substring_index(bare, "e", -1).cast("int")
        return lets([sign, digits, e], with_digits)

    return F.when(x == 0, F.lit("0")).otherwise(let(F.format_string("%.14e", x), made))


def _plain(x: Column) -> Column:
    kinds = kinds_of(x)
    shown = {"num": lambda: general(x["n"]), "text": lambda: x["s"], "bool": lambda: F.when(x["b"], F.lit("TRUE")).otherwise(F.lit("FALSE"))}
    out = F.lit("")
    for kind, show in shown.items():
        if kind in kinds:
            out = show() if kinds == {kind} else F.when(_is(x, kind), show()).otherwise(out)
    return out


def parse_number(s: Column) -> Column:
    """The number that a text reads as (percent, thousands, scientific, currency sign, parentheses for negatives), or null."""

    def made(t: Column) -> Column:
        negative = t.rlike("^\\(.*\\)$")
        core = F.when(negative, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
        core = F.regexp_replace(core, "^([+-]?)\\s*\\$\\s*", "$1")
        percent = core.rlike("%$")
        core = F.regexp_replace(core, "\\s*%$", "")
        fits = core.rlike("^[+-]?(\\d+(,\\d{3})*(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d{1,4})?$")
        value = F.when(fits, F.regexp_replace(core, ",", "")).try_cast("double")
        signed = F.when(negative, -value).otherwise(value)
        return F.when(F.abs(value) < float("inf"), F.when(percent, signed / 100).otherwise(signed))

    return let(F.trim(s), made)


def to_number(v: Column) -> Column:
    """A value coerced to a number value: blank 0, booleans 1 and 0, text if it reads as a number, else #VALUE!; errors stay."""

    def made(x: Column) -> Column:
        kinds = kinds_of(x)
        if kinds <= {"num", "err"}:
            return x
        if "text" not in kinds:
            n = [x["n"]] if "num" in kinds else []
            n += [x["b"].cast("double")] if "bool" in kinds else []
            n += [F.when(~_is(x, "err"), F.lit(0.0)) if "err" in kinds else F.lit(0.0)] if "blank" in kinds else []
            return Value({"num"} | kinds & {"err"}, n=F.coalesce(*n), e=x["e"])
        from_text = let(parse_number(x["s"]), lambda n: when(n.isNull(), err(VALUE)).otherwise(number(n)))
        out = from_text
        for kind, value in (("blank", number(0.0)), ("bool", number(x["b"].cast("double"))), ("num", Value({"num"}, n=x["n"])), ("err", err(x["e"]))):
            out = when(_is(x, kind), value).otherwise(out) if kind in kinds else out
        return out

    return let(v, made)


def to_text(v: Column) -> Column:
    """A value coerced to a text value; errors stay."""

    def made(x: Column) -> Column:
        if kinds_of(x) <= {"text", "err"}:
            return x
        return when(_is(x, "err"), err(x["e"])).otherwise(text(_plain(x))) if "err" in kinds_of(x) else text(_plain(x))

    return let(v, made)


def to_bool(v: Column) -> Column:
    """A value coerced to a boolean value: numbers by not zero, text only TRUE and FALSE, blank FALSE; errors stay."""

    def made(x: Column) -> Column:
        kinds = kinds_of(x)
        if kinds <= {"bool", "err"}:
            return x
        word = F.upper(x["s"])
        out = when(word.isin("TRUE", "FALSE"), boolean(word == "TRUE")).otherwise(err(VALUE)) if "text" in kinds else None
        for kind, value in (("blank", boolean(False)), ("num", boolean(x["n"] != 0)), ("bool", boolean(x["b"])), ("err", err(x["e"]))):
            if kind in kinds:
                out = value if out is None else when(_is(x, kind), value).otherwise(out)
        return out

    return let(v, made)


def first_error(values: list[Column], body: Callable[..., Column]) -> Column:
    """The first value that is an error, else body of the values; each is computed once."""

    def made(*xs: Column) -> Column:
        out = body(*xs)
        for x in reversed(xs):
            if "err" in kinds_of(x):
                out = when(_is(x, "err"), err(x["e"])).otherwise(out)
        return out

    return lets(values, made)


def on_numbers(values: list[Column], body: Callable[..., Column]) -> Column:
    """body of plain doubles, after coercion; the first error else."""
    return first_error([to_number(v) for v in values], lambda *xs: body(*[x["n"] for x in xs]))


def on_texts(values: list[Column], body: Callable[..., Column]) -> Column:
    return first_error([to_text(v) for v in values], lambda *xs: body(*[x["s"] for x in xs]))


def upper(s: Column) -> Column:
    """Capitals, character by character: one that would become several, such as a sharp s, stays."""
    one = F.array_join(F.transform(F.split(s, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")
    return F.when(F.length(F.upper(s)) == F.length(s), F.upper(s)).otherwise(one)


def fold(s: Column) -> Column:
    """A text without its case, one character for one: texts are equal without regard to case if these are."""
    return F.translate(F.lower(s), "\u03c2", "\u03c3")


def sorting(s: Column) -> Column:
    """What texts are ordered by without regard to case; equal only where the folded texts are."""
    return F.struct(F.upper(s).alias("u"), fold(s).alias("f"))


def _rank(x: Column) -> Column:
    return F.when(_is(x, "num"), 0).when(_is(x, "text"), 1).otherwise(2)


def compare(a: Column, b: Column, op: str) -> Column:
    """A boolean value: numbers before texts before booleans, texts without regard to case, blank as the other's empty value; the first error else."""

    tests = {"=": lambda f, g: f == g, "<>": lambda f, g: f != g, "<": lambda f, g: f < g, ">": lambda f, g: f > g, "<=": lambda f, g: f <= g, ">=": lambda f, g: f >= g}

    def made(x: Column, y: Column) -> Column:
        kinds = (kinds_of(x) | kinds_of(y)) - {"err"}
        if kinds <= {"num", "blank"}:
            return boolean(tests[op](*[F.coalesce(p["n"], F.lit(0.0)) if "blank" in kinds_of(p) else p["n"] for p in (x, y)]))
        if kinds <= {"text", "blank"}:
            key = fold if op in ("=", "<>") else sorting
            return boolean(tests[op](*[key(F.coalesce(p["s"], F.lit("")) if "blank" in kinds_of(p) else p["s"]) for p in (x, y)]))

        def filled(p: Column, q: Column) -> Column:
            if "blank" not in kinds_of(p):
                return p
            empty = when(_is(q, "text"), text("")).when(_is(q, "bool"), boolean(False)).otherwise(number(0.0))
            return when(_is(p, "blank"), empty).otherwise(p)

        def ordered(p: Column, q: Column) -> Column:
            sign = F.when(_rank(p) != _rank(q), F.when(_rank(p) < _rank(q), -1).otherwise(1))
            by = lambda f, g: F.when(f < g, -1).when(f > g, 1).otherwise(0)
            sign = sign.when(_is(p, "num"), by(p["n"], q["n"])).when(_is(p, "text"), by(sorting(p["s"]), sorting(q["s"])))
            return boolean(tests[op](sign.otherwise(by(p["b"].cast("int"), q["b"].cast("int"))), F.lit(0)))

        return lets([filled(x, y), filled(y, x)], ordered)

    return first_error([a, b], made)


def arithmetic(a: Column, b: Column, op: str) -> Column:
    """+ - * / ^ on coerced numbers, with the worksheet's errors."""

    def made(x: Column, y: Column) -> Column:
        if op == "/":
            return when(y == 0, err(DIV0)).otherwise(number(F.try_divide(x, y)))
        if op == "^":
            return power(x, y)
        return number({"+": x + y, "-": x - y, "*": x * y}[op])

    return on_numbers([a, b], made)


def power(x: Column, y: Column) -> Column:
    fraction = y != F.floor(y)
    return when((x == 0) & (y == 0), err(NUM)).when((x == 0) & (y < 0), err(DIV0)).when((x < 0) & fraction, err(NUM)).otherwise(number(F.pow(x, y)))


def concatenate(a: Column, b: Column) -> Column:
    return on_texts([a, b], lambda x, y: text(F.concat(x, y)))


def wildcard_regex(pattern: str) -> str:
    """The Java regex of a pattern with * ? and ~ as escape, over the whole text, without regard to case."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern):
            i += 1
            out.append(_quoted(pattern[i]))
        else:
            out.append({"*": ".*", "?": "."}.get(c) or _quoted(c))
        i += 1
    return "(?is)^" + "".join(out) + "$"


def wildcard_pattern(s: Column) -> Column:
    """wildcard_regex of a text that is data."""
    quoted = F.regexp_replace(s, r"(?s)~(.)|([^*?])", r"\\Q$1$2\\E")
    return F.concat(F.lit("(?is)^"), F.regexp_replace(F.regexp_replace(quoted, r"(?<!\\Q)\*", ".*"), r"(?<!\\Q)\?", "."), F.lit("$"))


def _quoted(c: str) -> str:
    return c if c.isalnum() or ord(c) > 127 else "\\" + c
