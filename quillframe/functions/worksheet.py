"""Formulas compiled to Columns: the tree of a formula over a row's cells, with the closed set of worksheet functions.

``compile_formula`` binds each reference to a Column value (see ``values``), or a range to a grid of
them, and returns one Column, which stays in the JVM: no Python runs on data. An unknown function is
``#NAME?``, a wrong number of arguments ``#VALUE!``; branches are only evaluated where taken.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import formats
from . import values as v
from .cells import column_letters, serial_to_date
from .criteria import criterion_of
from .formula import ArrayConstant, Binary, Call, Constant, Percent, Reference, Unary, parse

Grid = list[list[Column]]


@dataclass
class Context:
    """Cells by address (``A1``), each a value; ``now`` is the clock; ``row`` and ``column`` place the formula."""

    cells: Mapping[str, Column] = field(default_factory=dict)
    now: dt.datetime = dt.datetime(2000, 1, 1)
    row: int = 1
    column: int = 1

    def grid(self, ref: Reference) -> Grid:
        """The cells of a reference within the bound ones; unbound cells are blank."""
        return [[self.cells.get(f"{column_letters(c)}{r}", v.blank()) for c in range(ref.c1, ref.c2 + 1)] for r in range(ref.r1, ref.r2 + 1)]


def compile_formula(text: str, context: Context) -> Column:
    """The value of a formula as a Column; a blank result reads as 0."""
    return compile_tree(parse(text), context)


def compile_tree(tree, context: Context) -> Column:
    """compile_formula of a formula's tree."""
    return v.let(scalar(tree, context), _shown)


def _shown(x: Column) -> Column:
    """A blank reads as 0."""
    if "blank" not in v.kinds_of(x):
        return x
    if isinstance(x, v.Value):
        return v.Value(x.kinds - {"blank"} | {"num"}, **{**x.fields, "n": v.when(x.is_("blank"), F.lit(0.0)).otherwise(x["n"])})
    return v.when(x["k"] == "blank", v.number(0.0)).otherwise(x)


@dataclass(frozen=True)
class Bound:
    """A node that already is a value."""

    value: Column


def scalar(node, x: Context) -> Column:
    if isinstance(node, Bound):
        return node.value
    if isinstance(node, Constant):
        if node.error:
            return v.err(node.error)
        if node.value is None:
            return v.blank()
        return v.boolean(node.value) if isinstance(node.value, bool) else v.text(node.value) if isinstance(node.value, str) else v.number(node.value)
    if isinstance(node, Reference | ArrayConstant):
        return grid(node, x)[0][0]
    if isinstance(node, Unary):
        return v.on_numbers([scalar(node.operand, x)], lambda a: v.number(-a)) if node.op == "-" else scalar(node.operand, x)
    if isinstance(node, Percent):
        return v.on_numbers([scalar(node.operand, x)], lambda a: v.number(a / 100))
    if isinstance(node, Binary):
        a, b = scalar(node.left, x), scalar(node.right, x)
        if node.op == "&":
            return v.concatenate(a, b)
        return v.arithmetic(a, b, node.op) if node.op in "+-*/^" else v.compare(a, b, node.op)
    function = FUNCTIONS.get(node.name)
    if function is None:
        return v.err(v.NAME)
    least, most, body = function
    if not least <= len(node.args) <= most:
        return v.err(v.VALUE)
    return body(list(node.args), x)


def grid(node, x: Context) -> Grid:
    """A range, array constant or element-wise expression over them as rows of values."""
    if isinstance(node, Reference):
        return x.grid(node)
    if isinstance(node, ArrayConstant):
        return [[scalar(c, x) for c in row] for row in node.rows]
    if isinstance(node, Binary):
        a, b = grid(node.left, x), grid(node.right, x)
        rows, columns = max(len(a), len(b)), max(len(a[0]), len(b[0]))

        def at(g: Grid, r: int, c: int) -> Column:
            r, c = (0 if len(g) == 1 else r), (0 if len(g[0]) == 1 else c)
            return g[r][c] if r < len(g) and c < len(g[0]) else v.err(v.NA)

        def one(p: Column, q: Column) -> Column:
            return v.concatenate(p, q) if node.op == "&" else v.arithmetic(p, q, node.op) if node.op in "+-*/^" else v.compare(p, q, node.op)

        return [[one(at(a, r, c), at(b, r, c)) for c in range(columns)] for r in range(rows)]
    if isinstance(node, Unary | Percent | Call) and _is_range(node):
        return _lifted(node, x)
    return [[scalar(node, x)]]


def _lifted(node, x: Context) -> Grid:
    """A sign, percent or scalar function over ranges, cell by cell; a single row or column is repeated, what a range does not cover is #N/A."""
    if isinstance(node, Call):
        least, most, body = FUNCTIONS[node.name]
        if not least <= len(node.args) <= most:
            return [[v.err(v.VALUE)]]
        parts, make = node.args, lambda nodes: Call(node.name, nodes)
    else:
        parts, make = (node.operand,), lambda nodes: Unary(node.op, *nodes) if isinstance(node, Unary) else Percent(*nodes)
    grids = [grid(p, x) if _is_range(p) else None for p in parts]
    rows, columns = (max(size(g) for g in grids if g) for size in (len, lambda g: len(g[0])))
    made: Grid = []
    for r in range(rows):
        made.append([])
        for c in range(columns):
            at = [g and (0 if len(g) == 1 else r, 0 if len(g[0]) == 1 else c) for g in grids]
            if any(g and (i[0] >= len(g) or i[1] >= len(g[0])) for g, i in zip(grids, at, strict=True)):
                made[-1].append(v.err(v.NA))
                continue
            made[-1].append(scalar(make(tuple(Bound(g[i[0]][i[1]]) if g else p for g, i, p in zip(grids, at, parts, strict=True))), x))
    return made


def _is_range(node) -> bool:
    if isinstance(node, Binary):
        return _is_range(node.left) or _is_range(node.right)
    if isinstance(node, Unary | Percent):
        return _is_range(node.operand)
    if isinstance(node, Call):
        return node.name in LIFTED and any(map(_is_range, node.args))
    return isinstance(node, Reference | ArrayConstant)


def _flat(node, x: Context) -> list[Column]:
    return [c for row in grid(node, x) for c in row]


def _items(args: list, x: Context) -> Column:
    """An array of struct (v value, d direct): d tells an argument that is written in the call itself."""
    made = [F.struct(c.alias("v"), F.lit(d).alias("d")) for a in args for c, d in ([(c, False) for c in _flat(a, x)] if _is_range(a) else [(scalar(a, x), True)])]
    return F.array(*made)


#: Cells up to which an aggregate is written out as one plain expression rather than run over an array.
FEW = 16


def _plain(cells: list[Column]) -> bool:
    return 0 < len(cells) <= FEW and all(isinstance(c, v.Value) and c.light() for c in cells)


def _written_out(cells: list[Column], chosen: list[Column] | None, finish) -> Column:
    """finish of the numbers of a few cells, of the chosen ones if given; the first error among them else."""
    pick = lambda c, i, f: c[f] if chosen is None else F.when(chosen[i], c[f])
    errors = [pick(c, i, "e") for i, c in enumerate(cells) if "err" in c.kinds]
    numbers = [pick(c, i, "n") for i, c in enumerate(cells) if "num" in c.kinds]
    made = PLAIN[finish](numbers or [F.lit(None).cast("double")])
    if not errors:
        return made
    error = F.coalesce(*errors)
    return v.when(error.isNotNull(), v.Value({"err"}, e=error)).otherwise(made)


def _numbers(args: list, x: Context, body: Callable[[Column], Column]) -> Column:
    """body of the array of numbers: of ranges only numbers count, direct arguments are coerced; the first error else."""
    if body in PLAIN:
        cells = [c for a in args for c in (_flat(a, x) if _is_range(a) else [v.to_number(scalar(a, x))])]
        if _plain(cells):
            return _written_out(cells, None, body)
    coerced = F.transform(_items(args, x), lambda i: v.when(i["d"], v.to_number(i["v"])).otherwise(i["v"]))

    def made(found: Column) -> Column:
        bad = F.filter(found, lambda i: i["k"] == "err")
        numbers = F.transform(F.filter(found, lambda i: i["k"] == "num"), lambda i: i["n"])
        return v.when(F.size(bad) > 0, F.get(bad, F.lit(0))).otherwise(v.let(numbers, body))

    return v.let(coerced, made)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, n: s + n)


def _average(a: Column) -> Column:
    return v.when(F.size(a) == 0, v.err(v.DIV0)).otherwise(v.number(F.try_divide(_total(a), F.size(a))))


def _sum(a: Column) -> Column:
    return v.number(_total(a))


def _product(a: Column) -> Column:
    return v.number(F.aggregate(a, F.lit(1.0), lambda p, q: p * q))


def _least(a: Column) -> Column:
    return v.number(F.coalesce(F.array_min(a), F.lit(0.0)))


def _greatest(a: Column) -> Column:
    return v.number(F.coalesce(F.array_max(a), F.lit(0.0)))


def _added(numbers: list[Column]) -> Column:
    out = F.lit(0.0)
    for n in numbers:
        out = out + F.coalesce(n, F.lit(0.0))
    return out


def _mean(numbers: list[Column]) -> Column:
    count = F.lit(0)
    for n in numbers:
        count = count + n.isNotNull().cast("int")
    return v.when(count == 0, v.err(v.DIV0)).otherwise(v.number(F.try_divide(_added(numbers), count)))


def _multiplied(numbers: list[Column]) -> Column:
    out = F.lit(1.0)
    for n in numbers:
        out = out * F.coalesce(n, F.lit(1.0))
    return v.number(out)


#: What an aggregate of an array is over a few numbers, any of which may be null.
PLAIN: dict[Callable, Callable[[list[Column]], Column]] = {
    _sum: lambda n: v.number(_added(n)),
    _average: _mean,
    _product: _multiplied,
    _least: lambda n: v.number(F.coalesce(F.least(*n) if len(n) > 1 else n[0], F.lit(0.0))),
    _greatest: lambda n: v.number(F.coalesce(F.greatest(*n) if len(n) > 1 else n[0], F.lit(0.0))),
}


def _logical(fold: Callable[[Column], Column]):
    def body(args: list, x: Context) -> Column:
        coerced = F.transform(_items(args, x), lambda i: v.when(i["d"], v.to_bool(i["v"])).when(i["v"]["k"] == "num", v.to_bool(i["v"])).otherwise(i["v"]))

        def made(found: Column) -> Column:
            bad = F.filter(found, lambda i: i["k"] == "err")
            flags = F.transform(F.filter(found, lambda i: i["k"] == "bool"), lambda i: i["b"])
            return v.when(F.size(bad) > 0, F.get(bad, F.lit(0))).when(F.size(flags) == 0, v.err(v.VALUE)).otherwise(v.boolean(fold(flags)))

        return v.let(coerced, made)

    return body


def _count(test: Callable[[Column], Column]):
    return lambda args, x: v.number(F.size(F.filter(_items(args, x), test)))


def _conditional(args: list, x: Context, values, pairs: list, finish: Callable[[Column], Column]) -> Column:
    """finish of the array of values whose aligned criteria all hold; a selected error is returned."""
    ranges = [_flat(r, x) for r, _ in pairs]
    columns = ranges[0] if values is None else _flat(values, x)[: len(ranges[0])]
    columns = columns + [v.blank()] * (len(ranges[0]) - len(columns))
    if any(len(r) != len(columns) for r in ranges):
        return v.err(v.VALUE)
    tests = [criterion_of(scalar(c, x) if not isinstance(c, Constant) else c) for _, c in pairs]
    if tests and finish in PLAIN and _plain(columns) and all(map(_plain, ranges)):
        return _written_out(columns, [_all([t(r[i]) for t, r in zip(tests, ranges, strict=True)]) for i in range(len(columns))], finish)
    rows = F.array(*[F.struct(columns[i].alias("v"), F.lit(True).alias("d") if not tests else _all([t(r[i]) for t, r in zip(tests, ranges, strict=True)]).alias("d")) for i in range(len(columns))])
    chosen = F.transform(F.filter(rows, lambda i: i["d"]), lambda i: i["v"])

    def made(found: Column) -> Column:
        bad = F.filter(found, lambda i: i["k"] == "err")
        numbers = F.transform(F.filter(found, lambda i: i["k"] == "num"), lambda i: i["n"])
        return v.when(F.size(bad) > 0, F.get(bad, F.lit(0))).otherwise(v.let(numbers, finish))

    return v.let(chosen, made)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _pairs(args: list) -> list | None:
    return [(args[i], args[i + 1]) for i in range(0, len(args), 2)] if len(args) % 2 == 0 else None


def _countifs(args: list, x: Context) -> Column:
    pairs = _pairs(args)
    if pairs is None:
        return v.err(v.VALUE)
    ranges = [_flat(r, x) for r, _ in pairs]
    if len({len(r) for r in ranges}) > 1:
        return v.err(v.VALUE)
    tests = [criterion_of(scalar(c, x) if not isinstance(c, Constant) else c) for _, c in pairs]
    hits = [_all([t(r[i]) for t, r in zip(tests, ranges, strict=True)]).cast("int") for i in range(len(ranges[0]))]
    if all(map(_plain, ranges)):
        return v.number(sum(hits[1:], hits[0]).cast("double"))
    return v.number(F.aggregate(F.array(*hits), F.lit(0), lambda a, b: a + b))


def _ifs(finish):
    return lambda args, x: _conditional(args, x, args[0], _pairs(args[1:]), finish) if len(args) % 2 else v.err(v.VALUE)


def _if(finish):
    return lambda args, x: _conditional(args, x, args[2] if len(args) > 2 else None, [(args[0], args[1])], finish)


def _sumproduct(args: list, x: Context) -> Column:
    grids = [grid(a, x) for a in args]
    if len({(len(g), len(g[0])) for g in grids}) > 1:
        return v.err(v.VALUE)
    cells = [[c for row in g for c in row] for g in grids]
    rows = F.array(*[F.array(*[g[i] for g in cells]) for i in range(len(cells[0]))])
    flat = F.flatten(rows)

    def made(found: Column) -> Column:
        bad = F.filter(found, lambda i: i["k"] == "err")
        product = lambda row: F.aggregate(row, F.lit(1.0), lambda a, c: a * v.when(c["k"] == "num", c["n"]).otherwise(0.0))
        return v.when(F.size(bad) > 0, F.get(bad, F.lit(0))).otherwise(v.number(F.aggregate(rows, F.lit(0.0), lambda a, row: a + product(row))))

    return v.let(flat, made)


# Numbers


def digits15(n: Column) -> Column:
    """A number at 15 significant digits."""
    return F.format_string("%.14e", n).cast("double")


def _scaled(n: Column, d: Column, rounded: Callable[[Column, Column], Column]) -> Column:
    """rounded(size of n in units of its last digit kept, the power of ten); n itself where a double has no such digit."""
    places = v.when(d < 0, F.ceil(F.greatest(d, F.lit(-308.0)))).otherwise(F.floor(F.least(d, F.lit(308.0)))).cast("double")

    def made(scale: Column) -> Column:
        size = F.abs(n) * scale
        return v.when((size >= 1e15) | (scale > 1e28), n).otherwise(F.try_divide(F.signum(n) * rounded(size, scale), scale))

    return v.let(F.pow(F.lit(10.0), places), made)


def _round(n: Column, d: Column) -> Column:
    """Half away from zero on the 15-digit value; digits are cut to whole ones."""
    return _scaled(n, d, lambda size, scale: F.floor(digits15(size) + 0.5).cast("double"))


def _toward(n: Column, d: Column, up: bool) -> Column:
    """Away from zero or towards it, on the value at nine decimals; the least remainder counts upwards."""
    whole = (lambda x: F.ceil(F.greatest(F.round(x, 9), v.when(x > 0, F.lit(1e-9)).otherwise(F.lit(0.0))))) if up else (lambda x: F.floor(F.round(x, 9)))
    return _scaled(n, d, lambda size, scale: whole(size).cast("double"))


def _multiple(up: bool):
    def made(n: Column, s: Column) -> Column:
        ratio = F.try_divide(n, s)
        q = F.round(ratio, 9)
        whole = v.when(F.abs(ratio) >= 1e15, ratio).otherwise((F.ceil(q) if up else F.floor(q)).cast("double")) * s
        kept = v.when((F.abs(whole) >= 1e-9) & (F.abs(whole) < 1e15), digits15(whole)).otherwise(whole)
        return v.when(s == 0, v.when(n == 0, v.number(0.0)).otherwise(v.err(v.DIV0))).when((n > 0) & (s < 0), v.err(v.NUM)).otherwise(v.number(kept))

    return made


def _math(body: Callable[..., Column], *defaults: float):
    """A function of numbers; trailing arguments may be left out."""

    def call(args: list, x: Context) -> Column:
        given = [scalar(a, x) for a in args]
        missing = len(defaults) - max(0, len(given) - 1)
        return v.on_numbers([*given, *[v.number(d) for d in defaults[len(defaults) - missing :]]] if missing > 0 else given, body)

    return call


def _mod(a: Column, b: Column) -> Column:
    return v.when(b == 0, v.err(v.DIV0)).otherwise(v.number(a - b * F.floor(F.try_divide(a, b))))


def _log(a: Column, b: Column) -> Column:
    return v.when((a <= 0) | (b <= 0) | (b == 1), v.err(v.NUM)).otherwise(v.number(F.try_divide(F.ln(a), F.ln(b))))


# Logic


def _iff(args: list, x: Context) -> Column:
    yes, no = scalar(args[1], x), scalar(args[2], x) if len(args) > 2 else v.boolean(False)
    zero = lambda c: v.let(c, _shown)
    return v.first_error([v.to_bool(scalar(args[0], x))], lambda t: v.when(t["b"], zero(yes)).otherwise(zero(no)))


def _ifs_branches(args: list, x: Context) -> Column:
    if len(args) % 2:
        return v.err(v.VALUE)
    out = v.err(v.NA)
    for i in range(len(args) - 2, -1, -2):
        out = (lambda rest, i: v.first_error([v.to_bool(scalar(args[i], x))], lambda t: v.when(t["b"], scalar(args[i + 1], x)).otherwise(rest)))(out, i)
    return out


def _choose(args: list, x: Context) -> Column:
    def made(n: Column) -> Column:
        out = v.when(F.lit(False), v.blank())
        for i, a in enumerate(args[1:], 1):
            out = out.when(F.floor(n) == i, scalar(a, x))
        return out.otherwise(v.err(v.VALUE))

    return v.on_numbers([scalar(args[0], x)], made)


def _switch(args: list, x: Context) -> Column:
    default = scalar(args[-1], x) if len(args) % 2 == 0 else v.err(v.NA)
    pairs = [(args[i], args[i + 1]) for i in range(1, len(args) - 1, 2)]

    def made(s: Column) -> Column:
        out = v.when(F.lit(False), v.blank())
        for key, value in pairs:
            k = scalar(key, x)
            out = out.when((s["k"] == k["k"]) & v.compare(s, k, "=")["b"], scalar(value, x))
        return out.otherwise(default)

    return v.first_error([scalar(args[0], x)], made)


def _is(test: Callable[[Column], Column]):
    return lambda args, x: v.let(scalar(args[0], x), lambda c: v.boolean(test(c)))


def _parity(odd: bool):
    return lambda args, x: v.on_numbers([scalar(args[0], x)], lambda n: v.boolean(F.pmod(F.floor(F.abs(n)), F.lit(2)) == int(odd)))


# Texts


def _units(s: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def _text(body: Callable[..., Column], kinds: str, *defaults: float):
    """A function of texts (t) and numbers (n) by position."""

    def call(args: list, x: Context) -> Column:
        given = [v.to_text(scalar(a, x)) if kinds[i] == "t" else v.to_number(scalar(a, x)) for i, a in enumerate(args)]
        rest = len(kinds) - len(given)
        given += [v.number(d) for d in defaults[len(defaults) - rest :]] if rest else []
        return v.first_error(given, lambda *cs: body(*[c["s"] if kinds[i] == "t" else c["n"] for i, c in enumerate(cs)]))

    return call


def _left(s: Column, n: Column) -> Column:
    return v.when(n < 0, v.err(v.VALUE)).otherwise(v.text(F.substring(s, F.lit(1), F.floor(n).cast("int"))))


def _right(s: Column, n: Column) -> Column:
    k = F.least(F.floor(n).cast("int"), F.length(s))
    return v.when(n < 0, v.err(v.VALUE)).otherwise(v.text(F.substring(s, F.length(s) - k + 1, k)))


def _mid(s: Column, start: Column, n: Column) -> Column:
    return v.when((F.floor(start) < 1) | (n < 0), v.err(v.VALUE)).otherwise(v.text(F.substring(s, F.floor(start).cast("int"), F.floor(n).cast("int"))))


def _proper(s: Column) -> Column:
    """A capital after anything that is no letter."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("letter"))
    step = lambda a, c: F.struct(F.concat(a["out"], v.when(a["letter"], F.lower(c)).otherwise(F.upper(c))).alias("out"), c.rlike("\\p{L}").alias("letter"))
    return v.text(F.aggregate(F.split(s, ""), start, step)["out"])


def _rept(s: Column, n: Column) -> Column:
    k = F.floor(n).cast("int")
    return v.when((k < 0) | (F.length(s).cast("double") * n > v.MAX_TEXT), v.err(v.VALUE)).otherwise(v.text(F.repeat(s, k)))


def _substitute(args: list, x: Context) -> Column:
    texts = [v.to_text(scalar(a, x)) for a in args[:3]]
    if len(args) == 3:
        return v.first_error(texts, lambda s, o, n: v.text(v.when(o["s"] == "", s["s"]).otherwise(F.replace(s["s"], o["s"], n["s"]))))

    def nth(s: Column, o: Column, n: Column, k: Column) -> Column:
        s, o, n, k = s["s"], o["s"], n["s"], F.floor(k["n"])
        # Starts of all matches, overlapping ones too, since the next search begins one character on.
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substring(s, i, F.length(o)) == o)
        at = F.get(starts, (k - 1).cast("int"))
        changed = F.concat(F.substring(s, F.lit(1), at - 1), n, F.substring(s, at + F.length(o), F.length(s)))
        return v.when(k < 1, v.err(v.VALUE)).when((o == "") | at.isNull(), v.text(s)).otherwise(v.text(changed))

    return v.first_error([*texts, v.to_number(scalar(args[3], x))], nth)


def _replace(s: Column, start: Column, n: Column, new: Column) -> Column:
    a, k = F.floor(start).cast("int"), F.floor(n).cast("int")
    out = F.concat(F.substring(s, F.lit(1), a - 1), new, F.substring(s, F.least(a, F.length(s) + 1) + k, F.greatest(F.length(s), F.lit(1))))
    return v.when((a < 1) | (k < 0), v.err(v.VALUE)).otherwise(v.text(out))


def _find(what: Column, s: Column, start: Column) -> Column:
    a = F.floor(start).cast("int")
    at = v.when(what == "", a).otherwise(F.call_function("locate", what, s, a))
    return v.when((a < 1) | (a > F.length(s) + 1), v.err(v.VALUE)).when(at == 0, v.err(v.VALUE)).otherwise(v.number(at))


def _search(what: Column, s: Column, start: Column) -> Column:
    """The first match from start of a pattern with wildcards, without regard to case."""
    a = F.floor(start).cast("int")
    quoted = F.regexp_replace(what, "([\\\\^$.|+()\\[\\]{}])", "\\\\$1")
    # A tilde takes the next character as it is; other stars and marks are wildcards.
    regex = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, "(?<!~)\\*", ".*?"), "(?<!~)\\?", "."), "~([*?~])", "\\\\$1")
    tail = F.substring(s, a, F.greatest(F.length(s), F.lit(1)))
    before = F.call_function("regexp_extract", tail, F.concat(F.lit("(?is)^(.*?)"), regex), F.lit(1))
    found = F.regexp_like(tail, F.concat(F.lit("(?is)"), regex))
    return v.when((a < 1) | (a > F.length(s) + 1) | ~found, v.err(v.VALUE)).otherwise(v.number(a + F.length(before)))


def _concat(args: list, x: Context) -> Column:
    return _joined(F.transform(_items(args, x), lambda i: v.to_text(i["v"])), F.lit(""), F.lit(False))


def _joined(items: Column, delimiter: Column, skip: Column) -> Column:
    def made(found: Column) -> Column:
        bad = F.filter(found, lambda i: i["k"] == "err")
        texts = F.filter(F.transform(found, lambda i: i["s"]), lambda s: ~skip | (s != ""))
        whole = F.array_join(texts, "\u0000")
        out = F.replace(whole, F.lit("\u0000"), delimiter)
        return v.when(F.size(bad) > 0, F.get(bad, F.lit(0))).when(F.length(out) > v.MAX_TEXT, v.err(v.VALUE)).otherwise(v.text(out))

    return v.let(items, made)


def _textjoin(args: list, x: Context) -> Column:
    items = F.transform(_items(args[2:], x), lambda i: v.to_text(i["v"]))
    return v.first_error([v.to_text(scalar(args[0], x)), v.to_bool(scalar(args[1], x))], lambda d, s: _joined(items, d["s"], s["b"]))


def _exact(args: list, x: Context) -> Column:
    return v.lets([v.to_text(scalar(a, x)) for a in args], lambda a, b: v.when((a["k"] == "err") | (b["k"] == "err"), v.err(v.VALUE)).otherwise(v.boolean(a["s"] == b["s"])))


def _value(args: list, x: Context) -> Column:
    return v.let(scalar(args[0], x), lambda c: v.when(c["k"] == "bool", v.err(v.VALUE)).otherwise(v.to_number(c)))


def _text_format(args: list, x: Context) -> Column:
    if not isinstance(args[1], Constant) or not isinstance(args[1].value, str):
        return v.err(v.VALUE)
    return v.let(scalar(args[0], x), lambda c: v.when(c["k"] == "err", c).otherwise(v.text(formats.format_value(c, args[1].value))))


# Dates


def _date(y: Column, m: Column, d: Column) -> Column:
    year = F.floor(y) + v.when(F.floor(y) < 1900, 1900).otherwise(0)
    months = (year - 1900) * 12 + F.floor(m) - 1
    inside = (months >= 0) & (months < 8100 * 12) & (F.abs(d) < 4_000_000)
    first = F.date_add(F.add_months(F.lit("1900-01-01").cast("date"), v.when(inside, months).otherwise(0).cast("int")), v.when(inside, F.floor(d) - 1).otherwise(0).cast("int"))
    days = F.datediff(first, F.lit("1899-12-30").cast("date"))
    serial = v.when(days < 61, days - 1).otherwise(days)
    return v.when(~inside | (serial < 0) | (serial > 2_958_465), v.err(v.NUM)).otherwise(v.number(serial))


def _on_date(body: Callable[[Column, Column], Column]):
    """A function of a serial: body gets its date and its whole days."""

    def call(args: list, x: Context) -> Column:
        return v.on_numbers([scalar(args[0], x)], lambda n: v.lets([serial_to_date(n), F.floor(n)], lambda d, days: v.when(d.isNull(), v.err(v.NUM)).otherwise(v.number(body(d, days)))))

    return call


def _on_time(divide: int, of: int):
    """Hours, minutes or seconds of a serial's fraction, rounded to milliseconds."""
    return lambda args, x: v.on_numbers([scalar(args[0], x)], lambda n: v.when(n < 0, v.err(v.NUM)).otherwise(v.number(F.pmod(F.floor(F.round((n - F.floor(n)) * 86_400_000) / (divide * 1000)), F.lit(of)))))


def _weekday(n: Column, kind: Column) -> Column:
    sunday = F.pmod(F.floor(n) + 6, F.lit(7))  # 0 for Sunday, also before 1 March 1900
    k = F.floor(kind)
    day = v.when(k == 1, sunday + 1).when(k == 2, F.pmod(sunday + 6, F.lit(7)) + 1).when(k == 3, F.pmod(sunday + 6, F.lit(7)))
    return v.when(day.isNull() | (n < 0) | (n > 2_958_465), v.err(v.NUM)).otherwise(v.number(day))


def _edate(end: bool):
    def made(n: Column, months: Column) -> Column:
        moved = F.add_months(serial_to_date(n), v.when(F.abs(months) < 120_000, months).otherwise(0).cast("int"))
        moved = F.last_day(moved) if end else moved
        days = F.datediff(moved, F.lit("1899-12-30").cast("date"))
        serial = v.when(days < 61, days - 1).otherwise(days)
        return v.when((F.abs(months) >= 120_000) | serial.isNull() | (serial < 0) | (serial > 2_958_465), v.err(v.NUM)).otherwise(v.number(serial))

    return made


def _datedif(args: list, x: Context) -> Column:
    def made(a: Column, b: Column, u: Column) -> Column:
        start, end, unit = serial_to_date(a["n"]), serial_to_date(b["n"]), F.upper(u["s"])
        months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - (F.day(end) < F.day(start)).cast("int")
        out = v.when(unit == "Y", F.floor(months / 12)).when(unit == "M", months).when(unit == "D", F.floor(b["n"]) - F.floor(a["n"]))
        return v.when((a["n"] > b["n"]) | out.isNull(), v.err(v.NUM)).otherwise(v.number(out))

    return v.first_error([v.to_number(scalar(args[0], x)), v.to_number(scalar(args[1], x)), v.to_text(scalar(args[2], x))], made)


def _now_serial(x: Context) -> float:
    since = x.now - dt.datetime(1899, 12, 30)
    return since.days + since.seconds / 86_400


def _days(args: list, x: Context) -> Column:
    def made(e: Column, s: Column) -> Column:
        return v.when((e["k"] == "err") | (s["k"] == "err"), v.err(v.VALUE)).otherwise(v.number(F.floor(e["n"]) - F.floor(s["n"])))

    return v.lets([v.to_number(scalar(a, x)) for a in args], made)


# Lookups over the cells of a row's grid


def _matches(value: Column, cell: Column, wild: bool) -> Column:
    """Equality of one kind; texts without regard to case and, if wild, a value with * ? or ~ as a pattern."""
    same = (value["k"] == cell["k"]) & F.coalesce(v.compare(value, cell, "=")["b"], F.lit(False))
    if not wild or "text" not in v.kinds_of(value) & v.kinds_of(cell):
        return same
    return F.when(F.coalesce(value["s"].rlike("[*?~]"), F.lit(False)), F.coalesce(F.regexp_like(cell["s"], v.wildcard_pattern(value["s"])), F.lit(False))).otherwise(same)


def _exact_place(value: Column, cells: list[Column], wild: bool = True) -> Column:
    out = v.when(F.lit(False), F.lit(0))
    for i, c in enumerate(cells, 1):
        out = out.when(_matches(value, c, wild), i)
    return out


def _scan_place(value: Column, cells: list[Column], ascending: bool = True) -> Column:
    """The last cell of the value's kind not past it, before the first past one; equality ends the scan."""
    past = ">" if ascending else "<"
    if isinstance(value, v.Value) and all(isinstance(c, v.Value) and len(c.kinds) == 1 for c in cells):
        return _scan_written_out(value, cells, past)
    state = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"))
    numbered = F.array(*[F.struct(F.lit(i).alias("i"), c.alias("c")) for i, c in enumerate(cells, 1)])

    def step(a: Column, e: Column) -> Column:
        same = e["c"]["k"] == value["k"]
        over = same & F.coalesce(v.compare(e["c"], value, past)["b"], F.lit(False))
        equal = same & F.coalesce(v.compare(e["c"], value, "=")["b"], F.lit(False))
        at = v.when(a["done"] | ~same | over, a["at"]).otherwise(e["i"])
        return F.struct(at.alias("at"), (a["done"] | over | equal).alias("done"))

    return F.nullif(F.aggregate(numbered, state, step)["at"], F.lit(0))


def _scan_written_out(value: v.Value, cells: list[v.Value], past: str) -> Column:
    """The same scan where the kind of each cell is known."""
    none, out = F.lit(None).cast("int"), F.when(F.lit(False), F.lit(0))
    for field, (kind, _) in v.FIELDS.items():
        found = [(i, c) for i, c in enumerate(cells, 1) if c.kinds == {kind}]
        if kind == "err" or kind not in value.kinds or not found:
            continue
        one, last, chain = v.Value({kind}, **{field: value[field]}), none, F.when(F.lit(False), none)
        for i, c in found:
            chain = chain.when(v.compare(c, one, past)["b"], last).when(v.compare(c, one, "=")["b"], F.lit(i))
            last = F.lit(i)
        out = out.when(value.is_(kind), chain.otherwise(last))
    return out


def _pick(cells: list[Column], place: Column) -> Column:
    found = F.get(F.array(*cells), (place - 1).cast("int"))
    return v.when(place.isNull(), v.err(v.NA)).when(found["k"] == "blank", v.number(0.0)).otherwise(found)


def _picked(cells: list[Column], place: Column) -> Column:
    return v.let(place, lambda p: _pick(cells, p))


def _vlookup(across: bool):
    def call(args: list, x: Context) -> Column:
        g = grid(args[1], x)
        lines = [list(row) for row in zip(*g, strict=True)] if not across else g
        near = scalar(args[3], x) if len(args) > 3 else v.boolean(True)

        def made(value: Column, index: Column, approximate: Column) -> Column:
            place = v.when(approximate["b"], _scan_place(value, lines[0])).otherwise(_exact_place(value, lines[0]))
            k = F.floor(index["n"])
            out = v.when(k < 1, v.err(v.VALUE)).when(k > len(lines), v.err(v.REF))
            for i, line in enumerate(lines, 1):
                out = out.when(k == i, _picked(line, place))
            return out

        return v.first_error([scalar(args[0], x), v.to_number(scalar(args[2], x)), v.to_bool(near)], made)

    return call


def _match(args: list, x: Context) -> Column:
    g = grid(args[1], x)
    if len(g) > 1 and len(g[0]) > 1:
        return v.err(v.NA)
    cells = [c for row in g for c in row]
    kind = scalar(args[2], x) if len(args) > 2 else v.number(1.0)

    def made(value: Column, k: Column) -> Column:
        place = v.when(k["n"] == 0, _exact_place(value, cells)).when(k["n"] > 0, _scan_place(value, cells)).otherwise(_scan_place(value, cells, ascending=False))
        return v.let(place, lambda p: v.when(p.isNull(), v.err(v.NA)).otherwise(v.number(p)))

    return v.first_error([scalar(args[0], x), v.to_number(kind)], made)


def _index(args: list, x: Context) -> Column:
    g = grid(args[0], x)
    one = v.number(1.0)
    row, column = scalar(args[1], x), scalar(args[2], x) if len(args) > 2 else None
    if column is None:
        row, column = (one, row) if len(g) == 1 else (row, one)

    def made(r: Column, c: Column) -> Column:
        r, c = F.greatest(F.floor(r), F.lit(1)), F.greatest(F.floor(c), F.lit(1))
        inside = (r <= len(g)) & (c <= len(g[0]))
        found = F.get(F.array(*[cell for line in g for cell in line]), v.when(inside, (r - 1) * len(g[0]) + c - 1).otherwise(0).cast("int"))
        return v.when(~inside, v.err(v.REF)).when(found["k"] == "blank", v.number(0.0)).otherwise(found)

    return v.on_numbers([row, column], made)


def _xlookup(args: list, x: Context) -> Column:
    keys, out = grid(args[1], x), grid(args[2], x)
    if len(keys) > 1 and len(keys[0]) > 1:
        return v.err(v.VALUE)
    cells = [c for row in keys for c in row]
    returns = [row[0] for row in out] if len(keys[0]) == 1 else out[0]
    if len(returns) != len(cells):
        return v.err(v.VALUE)
    mode = scalar(args[4], x) if len(args) > 4 else v.number(0.0)
    fallback = scalar(args[3], x) if len(args) > 3 and args[3] != Constant(None) else v.err(v.NA)

    def nearest(value: Column, larger: bool) -> Column:
        op = ">=" if larger else "<="
        kept = [v.when((c["k"] == value["k"]) & v.compare(c, value, op)["b"], F.struct(c["n"].alias("n"), v.sorting(c["s"]).alias("s"), c["b"].alias("b"), F.lit(i).alias("i"))) for i, c in enumerate(cells, 1)]
        found = F.filter(F.array(*kept), lambda e: e.isNotNull())
        return F.coalesce(_exact_place(value, cells, wild=False), (F.array_min(found) if larger else F.array_max(found))["i"])

    def made(value: Column, m: Column) -> Column:
        place = v.when(m["n"] == -1, nearest(value, False)).when(m["n"] == 1, nearest(value, True)).when(m["n"] == 2, _exact_place(value, cells)).otherwise(_exact_place(value, cells, wild=False))
        return v.let(place, lambda p: v.when(p.isNull(), fallback).otherwise(_pick(returns, p)))

    return v.first_error([scalar(args[0], x), v.to_number(mode)], made)


def _place(size: bool, row: bool):
    def call(args: list, x: Context) -> Column:
        if size:
            g = grid(args[0], x)
            return v.number(len(g) if row else len(g[0]))
        if args and not isinstance(args[0], Reference):
            return v.err(v.VALUE)
        return v.number((args[0].r1 if row else args[0].c1) if args else (x.row if row else x.column))

    return call


#: Functions of single values, which a range takes cell by cell.
LIFTED = frozenset(
    "ROUND ROUNDUP ROUNDDOWN TRUNC INT ABS SIGN SQRT EXP LN LOG10 LOG POWER MOD CEILING FLOOR IF IFERROR IFNA NOT ISBLANK ISNUMBER ISTEXT ISNONTEXT ISLOGICAL ISERROR ISERR ISNA "
    "ISEVEN ISODD LEFT RIGHT MID LEN UPPER LOWER PROPER TRIM REPT EXACT SUBSTITUTE REPLACE FIND SEARCH VALUE TEXT CHAR CODE T DATE TIME YEAR MONTH DAY HOUR MINUTE SECOND WEEKDAY EDATE EOMONTH DAYS DATEDIF".split()
)
MANY = 255
#: Name: fewest and most arguments, and the body.
FUNCTIONS: dict[str, tuple[int, int, Callable[[list, Context], Column]]] = {
    "SUM": (1, MANY, lambda a, x: _numbers(a, x, _sum)),
    "PRODUCT": (1, MANY, lambda a, x: _numbers(a, x, _product)),
    "AVERAGE": (1, MANY, lambda a, x: _numbers(a, x, _average)),
    "MIN": (1, MANY, lambda a, x: _numbers(a, x, _least)),
    "MAX": (1, MANY, lambda a, x: _numbers(a, x, _greatest)),
    "COUNT": (1, MANY, _count(lambda i: v.when(i["d"], v.to_number(i["v"])["k"] == "num").otherwise(i["v"]["k"] == "num"))),
    "COUNTA": (1, MANY, _count(lambda i: i["d"] | (i["v"]["k"] != "blank"))),
    "COUNTBLANK": (1, 1, _count(lambda i: (i["v"]["k"] == "blank") | F.coalesce(i["v"]["s"] == "", F.lit(False)))),
    "COUNTIF": (2, 2, _countifs),
    "COUNTIFS": (2, MANY, _countifs),
    "SUMIF": (2, 3, _if(_sum)),
    "SUMIFS": (3, MANY, _ifs(_sum)),
    "AVERAGEIF": (2, 3, _if(_average)),
    "AVERAGEIFS": (3, MANY, _ifs(_average)),
    "SUMPRODUCT": (1, MANY, _sumproduct),
    "ROUND": (2, 2, _math(lambda n, d: v.number(_round(n, d)))),
    "ROUNDUP": (2, 2, _math(lambda n, d: v.number(_toward(n, d, True)))),
    "ROUNDDOWN": (2, 2, _math(lambda n, d: v.number(_toward(n, d, False)))),
    "TRUNC": (1, 2, _math(lambda n, d: v.number(_toward(n, d, False)), 0.0)),
    "INT": (1, 1, _math(lambda n: v.number(F.floor(n)))),
    "ABS": (1, 1, _math(lambda n: v.number(F.abs(n)))),
    "SIGN": (1, 1, _math(lambda n: v.number(F.signum(n)))),
    "SQRT": (1, 1, _math(lambda n: v.when(n < 0, v.err(v.NUM)).otherwise(v.number(F.sqrt(n))))),
    "EXP": (1, 1, _math(lambda n: v.number(F.exp(n)))),
    "LN": (1, 1, _math(lambda n: v.number(F.ln(n)))),
    "LOG10": (1, 1, _math(lambda n: v.number(F.log10(n)))),
    "LOG": (1, 2, _math(_log, 10.0)),
    "POWER": (2, 2, _math(v.power)),
    "MOD": (2, 2, _math(_mod)),
    "PI": (0, 0, lambda a, x: v.number(3.141592653589793)),
    "CEILING": (1, 2, _math(_multiple(True), 1.0)),
    "FLOOR": (1, 2, _math(_multiple(False), 1.0)),
    "IF": (2, 3, _iff),
    "IFS": (2, MANY, _ifs_branches),
    "IFERROR": (2, 2, lambda a, x: v.let(scalar(a[0], x), lambda c: v.when(c["k"] == "err", scalar(a[1], x)).otherwise(c))),
    "IFNA": (2, 2, lambda a, x: v.let(scalar(a[0], x), lambda c: v.when(F.coalesce(c["e"] == v.NA, F.lit(False)), scalar(a[1], x)).otherwise(c))),
    "AND": (1, MANY, _logical(lambda b: F.forall(b, lambda i: i))),
    "OR": (1, MANY, _logical(lambda b: F.exists(b, lambda i: i))),
    "XOR": (1, MANY, _logical(lambda b: F.pmod(F.size(F.filter(b, lambda i: i)), F.lit(2)) == 1)),
    "NOT": (1, 1, lambda a, x: v.first_error([v.to_bool(scalar(a[0], x))], lambda t: v.boolean(~t["b"]))),
    "TRUE": (0, 0, lambda a, x: v.boolean(True)),
    "FALSE": (0, 0, lambda a, x: v.boolean(False)),
    "CHOOSE": (2, MANY, _choose),
    "SWITCH": (3, MANY, _switch),
    "NA": (0, 0, lambda a, x: v.err(v.NA)),
    "ISBLANK": (1, 1, _is(lambda c: c["k"] == "blank")),
    "ISNUMBER": (1, 1, _is(lambda c: c["k"] == "num")),
    "ISTEXT": (1, 1, _is(lambda c: c["k"] == "text")),
    "ISNONTEXT": (1, 1, _is(lambda c: c["k"] != "text")),
    "ISLOGICAL": (1, 1, _is(lambda c: c["k"] == "bool")),
    "ISERROR": (1, 1, _is(lambda c: c["k"] == "err")),
    "ISERR": (1, 1, _is(lambda c: (c["k"] == "err") & (c["e"] != v.NA))),
    "ISNA": (1, 1, _is(lambda c: F.coalesce(c["e"] == v.NA, F.lit(False)))),
    "ISEVEN": (1, 1, _parity(False)),
    "ISODD": (1, 1, _parity(True)),
    "VLOOKUP": (3, 4, _vlookup(False)),
    "HLOOKUP": (3, 4, _vlookup(True)),
    "MATCH": (2, 3, _match),
    "INDEX": (2, 3, _index),
    "XLOOKUP": (3, 5, _xlookup),
    "ROW": (0, 1, _place(False, True)),
    "COLUMN": (0, 1, _place(False, False)),
    "ROWS": (1, 1, _place(True, True)),
    "COLUMNS": (1, 1, _place(True, False)),
    "CONCATENATE": (1, MANY, lambda a, x: _joined(F.array(*[v.to_text(scalar(i, x)) for i in a]), F.lit(""), F.lit(False))),
    "CONCAT": (1, MANY, _concat),
    "TEXTJOIN": (3, MANY, _textjoin),
    "LEFT": (1, 2, _text(_left, "tn", 1.0)),
    "RIGHT": (1, 2, _text(_right, "tn", 1.0)),
    "MID": (3, 3, _text(_mid, "tnn")),
    "LEN": (1, 1, _text(lambda s: v.number(_units(s)), "t")),
    "UPPER": (1, 1, _text(lambda s: v.text(v.upper(s)), "t")),
    "LOWER": (1, 1, _text(lambda s: v.text(F.lower(s)), "t")),
    "PROPER": (1, 1, _text(_proper, "t")),
    "TRIM": (1, 1, _text(lambda s: v.text(F.regexp_replace(F.regexp_replace(s, "^ +| +$", ""), " +", " ")), "t")),
    "REPT": (2, 2, _text(_rept, "tn")),
    "EXACT": (2, 2, _exact),
    "SUBSTITUTE": (3, 4, _substitute),
    "REPLACE": (4, 4, _text(_replace, "tnnt")),
    "FIND": (2, 3, _text(_find, "ttn", 1.0)),
    "SEARCH": (2, 3, _text(_search, "ttn", 1.0)),
    "VALUE": (1, 1, _value),
    "TEXT": (2, 2, _text_format),
    "CHAR": (1, 1, _math(lambda n: v.when((F.floor(n) < 1) | (F.floor(n) > 255), v.err(v.VALUE)).otherwise(v.text(F.char(F.floor(n)))))),
    "CODE": (1, 1, _text(lambda s: v.when(s == "", v.err(v.VALUE)).otherwise(v.number(F.ascii(s))), "t")),
    "T": (1, 1, lambda a, x: v.let(scalar(a[0], x), lambda c: v.when(c["k"].isin("text", "err"), c).otherwise(v.text("")))),
    "DATE": (3, 3, _math(_date)),
    "TIME": (3, 3, _math(lambda h, m, s: v.let(F.floor(h) * 3600 + F.floor(m) * 60 + F.floor(s), lambda t: v.when(t < 0, v.err(v.NUM)).otherwise(v.number(F.pmod(t, F.lit(86_400)) / 86_400))))),
    "TODAY": (0, 0, lambda a, x: v.number(float(int(_now_serial(x))))),
    "NOW": (0, 0, lambda a, x: v.number(_now_serial(x))),
    "YEAR": (1, 1, _on_date(lambda d, n: v.when(n == 0, 1900).otherwise(F.year(d)))),
    "MONTH": (1, 1, _on_date(lambda d, n: v.when(n == 0, 1).when(n == 60, 2).otherwise(F.month(d)))),
    "DAY": (1, 1, _on_date(lambda d, n: v.when(n == 0, 0).when(n == 60, 29).otherwise(F.day(d)))),
    "HOUR": (1, 1, _on_time(3600, 24)),
    "MINUTE": (1, 1, _on_time(60, 60)),
    "SECOND": (1, 1, _on_time(1, 60)),
    "WEEKDAY": (1, 2, _math(_weekday, 1.0)),
    "EDATE": (2, 2, _math(_edate(False))),
    "EOMONTH": (2, 2, _math(_edate(True))),
    "DAYS": (2, 2, _days),
    "DATEDIF": (3, 3, _datedif),
}
