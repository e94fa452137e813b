"""Formulas over sheets of any size: cells stay rows, ranges become aggregates.

``evaluate`` takes the long table of cells (keys, sheet, row, col, kind, num, text, bool, err; a sheet has a cell
once) and gives a row per key with the value of each formula. An aggregate over ranges is computed
where the cells lie, combined before its shuffle: a whole column costs a filter, not a Column per cell, and blank
cells that are not stored are counted from the range's size. Ranges may name other sheets. What is
left of a formula is compiled by ``worksheet`` over the aggregates and the single cells it reads.

Aggregates of one range or more whose cells are independent (SUM, COUNTBLANK, ...) share one grouping of the
cells by key; those that pair the cells of equal ranges (COUNTIFS, SUMIFS, SUMPRODUCT, ...) group them
by place first. A range of many cells elsewhere in a formula, and a criterion that is not constant, are refused
as ``UnsupportedFormula``. A key without cells has no row.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as v
from ..functions.cells import MAX_ROW, column_letters
from ..functions.criteria import criterion_of
from ..functions.formula import Binary, Call, Constant, Percent, Reference, Unary, UnsupportedFormula, parse
from ..functions.worksheet import Context, compile_tree

#: Cells of a range up to which it may stand where no aggregate reads it.
FEW = 64
INDEPENDENT = {"SUM", "PRODUCT", "AVERAGE", "MIN", "MAX", "COUNT", "COUNTA", "COUNTBLANK", "AND", "OR", "XOR"}
PAIRED = {"COUNTIF", "COUNTIFS", "SUMIF", "SUMIFS", "AVERAGEIF", "AVERAGEIFS", "SUMPRODUCT"}


def _size(r: Reference) -> int:
    return (r.r2 - r.r1 + 1) * (r.c2 - r.c1 + 1)


def _inside(r: Reference, home: str) -> Column:
    return (F.lower("sheet") == (r.sheet or home).lower()) & F.col("row").between(r.r1, r.r2) & F.col("col").between(r.c1, r.c2)


def _value() -> v.Value:
    """The value of a stored cell."""
    kind = F.col("kind")
    of = {"n": ("num", "num"), "s": ("text", "text"), "b": ("bool", "bool"), "e": ("err", "err")}
    return v.Value(v.KINDS, **{f: F.when(kind == k, F.col(c)) for f, (k, c) in of.items()})


def _independent(name: str, ranges: list[Reference], home: str) -> Column:
    """The value of an aggregate over the cells of a group; an error is the first by argument, row and column."""
    x = _value()
    within = [_inside(r, home) for r in ranges]
    times = reduce(lambda a, b: a + b, [w.cast("int") for w in within])
    weight = F.when(times > 0, times)
    n = F.when(weight.isNotNull(), x["n"])
    filled = F.coalesce(F.sum(F.when(x["k"] != "blank", weight)), F.lit(0))
    if name == "COUNT":
        return v.number(F.coalesce(F.sum(F.when(x["n"].isNotNull(), weight)), F.lit(0)).cast("double"))
    if name == "COUNTA":
        return v.number(filled.cast("double"))
    if name == "COUNTBLANK":
        full = F.coalesce(F.sum(F.when((x["k"] != "blank") & (F.coalesce(x["s"], F.lit("x")) != ""), weight)), F.lit(0))
        return v.number(F.lit(float(sum(map(_size, ranges)))) - full)
    errors = [F.min(F.when(w & x["e"].isNotNull(), F.struct(F.col("row").alias("r"), F.col("col").alias("c"), x["e"].alias("e"))))["e"] for w in within]
    error = F.coalesce(*errors)
    if name in ("AND", "OR", "XOR"):
        flag = F.when(weight.isNotNull(), F.coalesce(x["b"], x["n"] != 0))
        made = {"AND": F.bool_and(flag), "OR": F.bool_or(flag), "XOR": F.pmod(F.coalesce(F.sum(F.when(flag, weight)), F.lit(0)), F.lit(2)) == 1}[name]
        return v.when(error.isNotNull(), v.Value({"err"}, e=error)).when(F.count(flag) == 0, v.err(v.VALUE)).otherwise(v.boolean(made))
    count = F.sum(F.when(n.isNotNull(), weight))
    total = F.sum(n * weight)
    if name == "AVERAGE":
        body = v.when(count.isNull(), v.err(v.DIV0)).otherwise(v.number(F.try_divide(total, count)))
    elif name == "PRODUCT":
        body = v.number(F.coalesce(F.product(F.pow(n, weight)), F.lit(1.0)))
    else:
        body = v.number(F.coalesce({"SUM": total, "MIN": F.min(n), "MAX": F.max(n)}[name], F.lit(0.0)))
    return v.when(error.isNotNull(), v.Value({"err"}, e=error)).otherwise(body)


def _paired(cells: DataFrame, name: str, args: tuple, home: str) -> tuple[DataFrame, Column, Column]:
    """The cells by place (key, a value a range), the aggregate's value over them, and the value over a key without a place."""
    values, pairs = None, []
    if name == "SUMPRODUCT":
        ranges = list(args)
    elif name in ("SUMIF", "AVERAGEIF"):
        values = args[2] if len(args) > 2 else args[0]
        pairs = [(args[0], args[1])]
        ranges = [values, args[0]]
    else:
        rest = args if name == "COUNTIFS" or name == "COUNTIF" else args[1:]
        values = None if rest is args else args[0]
        if len(rest) % 2 or not rest:
            return _constant(cells, v.VALUE)
        pairs = [(rest[i], rest[i + 1]) for i in range(0, len(rest), 2)]
        ranges = ([values] if values else []) + [r for r, _ in pairs]
    if not all(isinstance(r, Reference) for r in ranges):
        raise UnsupportedFormula(f"{name} over what is not a range")
    if not all(isinstance(c, Constant) for _, c in pairs):
        raise UnsupportedFormula("a criterion that is not constant")
    if len({(r.r2 - r.r1, r.c2 - r.c1) for r in ranges}) > 1:
        if name in ("SUMIF", "AVERAGEIF"):
            raise UnsupportedFormula(f"{name} over ranges of unequal shape")
        return _constant(cells, v.VALUE)

    distinct = list({(r.sheet or home, r.r1, r.c1): r for r in ranges}.values())
    slot = {(r.sheet or home, r.r1, r.c1): i for i, r in enumerate(distinct)}
    x = _value()
    # A cell stands at a place of each range that holds it.
    places = [F.when(_inside(r, home), F.struct((F.col("row") - r.r1).alias("r"), (F.col("col") - r.c1).alias("c"), F.lit(i).alias("i"))) for i, r in enumerate(distinct)]
    read = cells.where(reduce(lambda a, b: a | b, [_inside(r, home) for r in distinct]))
    at = read.select("key", F.explode(F.array_compact(F.array(*places))).alias("at"), x.alias("x"))
    by_place = at.groupBy("key", F.col("at.r").alias("r"), F.col("at.c").alias("c")).agg(*[F.max(F.when(F.col("at.i") == i, F.col("x"))).alias(f"x{i}") for i in range(len(distinct))])

    def of(r: Reference) -> v.Value:
        c = F.col(f"x{slot[(r.sheet or home, r.r1, r.c1)]}")
        return v.of_struct(c)

    if name == "SUMPRODUCT":
        product = reduce(lambda a, b: a * b, [F.coalesce(of(r)["n"], F.lit(0.0)) for r in ranges])
        error = F.min(F.when(F.coalesce(*[of(r)["e"] for r in ranges]).isNotNull(), F.struct("r", "c", F.coalesce(*[of(r)["e"] for r in ranges]).alias("e"))))["e"]
        made = v.when(error.isNotNull(), v.Value({"err"}, e=error)).otherwise(v.number(F.coalesce(F.sum(product), F.lit(0.0))))
        return by_place, made, v.number(0.0)
    tests = [(criterion_of(c), r) for r, c in pairs]
    hit = reduce(lambda a, b: a & b, [t(of(r)) for t, r in tests])
    # Blank places that no range stores all meet the criteria or none does.
    blank = reduce(lambda a, b: a & b, [t(v.blank()) for t, _ in tests])
    size = _size(ranges[0])
    if values is None:
        made = F.count_if(hit) + F.when(F.first(blank), F.lit(size) - F.count(F.lit(1))).otherwise(0)
        return by_place, v.number(made.cast("double")), v.number(F.when(blank, F.lit(float(size))).otherwise(0.0))
    n, e = F.when(hit, of(values)["n"]), F.when(hit, of(values)["e"])
    error = F.min(F.when(e.isNotNull(), F.struct("r", "c", e.alias("e"))))["e"]
    if name.startswith("SUM"):
        body, empty = v.number(F.coalesce(F.sum(n), F.lit(0.0))), v.number(0.0)
    else:
        body, empty = v.when(F.count(n) == 0, v.err(v.DIV0)).otherwise(v.number(F.avg(n))), v.err(v.DIV0)
    return by_place, v.when(error.isNotNull(), v.Value({"err"}, e=error)).otherwise(body), empty


def _constant(cells: DataFrame, code: str) -> tuple[DataFrame, Column, Column]:
    return cells, v.Value({"err"}, e=F.max(F.lit(code))), v.err(code)


class _Slots:
    """What a row must bind: aggregates and cells by an address below every sheet."""

    def __init__(self, home: str):
        self.home = home
        self.made: dict[tuple, Reference] = {}

    def slot(self, *what) -> Reference:
        if what not in self.made:
            row = MAX_ROW + 1 + len(self.made)
            self.made[what] = Reference(None, row, 1, row, 1, f"A{row}")
        return self.made[what]

    def rewritten(self, node):
        """The tree with aggregates over ranges and single cells replaced by slots."""
        if isinstance(node, Call):
            refs = tuple(a for a in node.args if isinstance(a, Reference))
            if node.name in PAIRED and refs:
                return self.slot(node.name, node.args)
            if node.name in INDEPENDENT and refs:
                if len(refs) == len(node.args):
                    return self.slot(node.name, refs)
                if node.name in ("SUM", "PRODUCT"):
                    rest = tuple(self.rewritten(a) for a in node.args if not isinstance(a, Reference))
                    return Call(node.name, (self.slot(node.name, refs), *rest))
            if node.name in ("ROW", "COLUMN", "ROWS", "COLUMNS"):
                return self.measured(node, refs)
            return Call(node.name, tuple(self.rewritten(a) for a in node.args))
        if isinstance(node, Unary):
            return Unary(node.op, self.rewritten(node.operand))
        if isinstance(node, Percent):
            return Percent(self.rewritten(node.operand))
        if isinstance(node, Binary):
            return Binary(node.op, self.rewritten(node.left), self.rewritten(node.right))
        if not isinstance(node, Reference):
            return node
        if node.single:
            return self.slot("", (node,))
        if _size(node) > FEW or node.sheet not in (None, self.home):
            raise UnsupportedFormula(f"the range {node.text} outside an aggregate")
        for r in range(node.r1, node.r2 + 1):
            for c in range(node.c1, node.c2 + 1):
                self.slot("", (Reference(None, r, c, r, c, f"{column_letters(c)}{r}"),))
        return node

    @staticmethod
    def measured(node: Call, refs: tuple):
        if len(refs) != 1 or len(node.args) != 1:
            return node
        r = refs[0]
        return Constant(float({"ROW": r.r1, "COLUMN": r.c1, "ROWS": r.r2 - r.r1 + 1, "COLUMNS": r.c2 - r.c1 + 1}[node.name]))


def evaluate(cells: DataFrame, keys: list[str], formulas: Mapping[str, str], home: str) -> DataFrame:
    """keys and a value column per formula, for every key that has a cell; ``home`` is the sheet that unqualified references mean."""
    slots = _Slots(home)
    trees = {name: slots.rewritten(parse(text)) for name, text in formulas.items()}
    key = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = cells.select(key.alias("key"), "sheet", "row", "col", "kind", "num", "text", "bool", "err")
    here, paired = {}, {}
    for (name, args), at in slots.made.items():
        if name in PAIRED:
            paired[at.text] = _paired(rows, name, args, home)
        elif name:
            here[at.text] = _independent(name, list(args), home)
        else:
            inside = _inside(args[0], home)
            here[at.text] = v.Value(v.KINDS, **{f: F.max(F.when(inside, _value()[f])) for f in "nsbe"})
    made = rows.groupBy("key").agg(F.lit(1).alias("one"), *[x.alias(f"v{a}") for a, x in here.items()])
    bound = {a: v.of_struct(F.col(f"v{a}"), v.kinds_of(x)) for a, x in here.items()}
    for a, (places, x, empty) in paired.items():
        found = places.groupBy(F.col("key").alias(f"key{a}")).agg(x.alias(f"v{a}"))
        made = made.join(found, made["key"].eqNullSafe(found[f"key{a}"]), "left").drop(f"key{a}")
        missing = F.col(f"v{a}").isNull()
        bound[a] = v.when(missing, empty).otherwise(v.of_struct(F.col(f"v{a}"), v.kinds_of(x)))
    for (name, args), at in slots.made.items():
        if not name and args[0].sheet in (None, home):
            bound.setdefault(f"{column_letters(args[0].c1)}{args[0].r1}", bound[at.text])
    context = Context(bound)
    return made.select(*[F.col("key")[k].alias(k) for k in keys], *[compile_tree(tree, context).alias(name) for name, tree in trees.items()])
