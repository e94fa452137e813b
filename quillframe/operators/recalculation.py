"""Recalculation of a sheet of formulas for every row of a table, in dependency order.

A row binds the sheet's input cells; each formula cell is a Column over them. Formulas are ordered so
that each comes after those it reads, and each level of that order is one projection, so a formula that
many others read is computed once. A formula in an unsupported form keeps its stored value and is reported; a cycle
is refused with its cells.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as v
from ..functions.cells import column_letters, parse_reference
from ..functions.formula import FormulaError, UnsupportedFormula, parse, references
from ..functions.worksheet import FUNCTIONS, Context, compile_formula

#: Formulas of one projection at most: code for more does not fit a method of the JVM.
WIDE = 20


class CycleError(ValueError):
    """Formulas that read each other."""

    def __init__(self, cells: list[str]):
        super().__init__("formulas read each other: " + ", ".join(cells))
        self.cells = cells


@dataclass(frozen=True)
class Plan:
    """Levels of formula cells, and the cells whose formulas are not evaluated with the reason."""

    levels: list[list[str]]
    unsupported: dict[str, str]


def plan(formulas: Mapping[str, str]) -> Plan:
    """The order of a sheet's formulas."""
    reads: dict[str, set[str]] = {}
    unsupported: dict[str, str] = {}
    places = {a: parse_reference(a)[:2] for a in formulas}
    for address, text in formulas.items():
        try:
            tree = parse(text)
        except (FormulaError, UnsupportedFormula, ValueError) as e:
            unsupported[address] = str(e)
            continue
        areas = references(tree)
        if any(r.sheet for r in areas):
            unsupported[address] = "another sheet"
            continue
        reads[address] = {a for a, (r, c) in places.items() if any(x.r1 <= r <= x.r2 and x.c1 <= c <= x.c2 for x in areas)}
    for address in reads:
        reads[address] -= unsupported.keys()
    levels: list[list[str]] = []
    done: set[str] = set()
    while len(done) < len(reads):
        ready = sorted((a for a, needs in reads.items() if a not in done and needs <= done), key=places.__getitem__)
        if not ready:
            raise CycleError(_cycle(reads, done))
        levels += [ready[k : k + WIDE] for k in range(0, len(ready), WIDE)]
        done.update(ready)
    return Plan(levels, unsupported)


def _cycle(reads: dict[str, set[str]], done: set[str]) -> list[str]:
    path: list[str] = []
    at = min(a for a in reads if a not in done)
    while at not in path:
        path.append(at)
        at = min(a for a in reads[at] if a not in done)
    return path[path.index(at) :]


def recalculate(table: DataFrame, inputs: Mapping[str, Column], formulas: Mapping[str, str], stored: Mapping[str, Column] | None = None, now=None) -> DataFrame:
    """table with a value column per formula cell, named by its address. ``inputs`` and ``stored`` are value Columns over table."""
    order = plan(formulas)
    kept = {a: (stored or {}).get(a, v.blank()) for a in order.unsupported}
    rows = table.select("*", *[c.alias(f"_{a}") for a, c in {**inputs, **kept}.items()])
    known = {a: v.of_struct(F.col(f"_{a}"), v.kinds_of(c)) for a, c in {**inputs, **kept}.items()}
    for level in order.levels:
        made = {}
        for address in level:
            r, c, _, _ = parse_reference(address)
            context = Context(known, row=r, column=c) if now is None else Context(known, now, r, c)
            made[f"_{address}"] = compile_formula(formulas[address], context)
        rows = rows.withColumns(made)
        known |= {a: v.of_struct(F.col(f"_{a}"), v.kinds_of(made[f"_{a}"])) for a in level}
    return rows.select(*table.columns, *[F.col(f"_{a}").alias(a) for a in formulas])


def unknown_functions(formulas: Mapping[str, str]) -> dict[str, str]:
    """Formula cells that call a name which is no function, with the name."""
    found = {}
    for address, text in formulas.items():
        for name in _calls(text):
            if name not in FUNCTIONS:
                found.setdefault(address, name)
    return found


def _calls(text: str) -> list[str]:
    from ..functions.formula import ArrayConstant, Binary, Call, Percent, Unary

    try:
        stack = [parse(text)]
    except ValueError:
        return []
    out = []
    while stack:
        n = stack.pop()
        if isinstance(n, Call):
            out.append(n.name)
            stack += n.args
        elif isinstance(n, Unary | Percent):
            stack.append(n.operand)
        elif isinstance(n, Binary):
            stack += [n.left, n.right]
        elif isinstance(n, ArrayConstant):
            continue
    return out


def wide_cells(cells: DataFrame, key: str, addresses: list[str]) -> DataFrame:
    """Long cells (key, row, col, kind, num, text, bool, err) of one sheet a key as a row a key with a value column per address; other cells are left out."""
    picked = []
    for a in addresses:
        r, c, _, _ = parse_reference(a)
        value = F.when(F.col("kind") == "num", v.number(F.col("num"))).when(F.col("kind") == "text", v.text(F.col("text"))).when(F.col("kind") == "bool", v.boolean(F.col("bool"))).when(F.col("kind") == "err", v.err(F.col("err"))).otherwise(v.blank())
        picked.append(F.coalesce(F.max(F.when((F.col("row") == r) & (F.col("col") == c), value)), v.blank()).alias(f"{column_letters(c)}{r}"))
    return cells.groupBy(key).agg(*picked)
