"""Criteria such as ``">=10"``, ``"<>x*"`` or a plain value, as predicates over value Columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as v
from .formula import Constant

PREFIX = re.compile(r"^(<=|>=|<>|=|<|>)?(.*)$", re.S)
NUMBER = re.compile(r"\s*([+-]?(?:\d+(?:,\d{3})*(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)\s*(%?)\s*$")


def criterion_of(criterion) -> Callable[[Column], Column]:
    """A predicate (never null) from a literal text, number or boolean, a formula constant, or a value Column."""
    if isinstance(criterion, Constant):
        criterion = criterion.error or ("" if criterion.value is None else criterion.value)
    if isinstance(criterion, Column):
        return lambda x: _dynamic(criterion, x)
    return lambda x: F.coalesce(v.let(x, lambda c: _literal(criterion, c)), F.lit(False))


def _literal(criterion: float | str | bool, x: Column) -> Column:
    if isinstance(criterion, bool):
        return (x["k"] == "bool") & (x["b"] == criterion)
    if isinstance(criterion, int | float):
        return _equal_number(F.lit(float(criterion)), x)
    op, operand = PREFIX.match(criterion).groups()
    if operand == "":
        empty = (x["k"] == "blank") | ((x["k"] == "text") & (x["s"] == ""))
        return {None: empty, "=": x["k"] == "blank" if op == "=" else empty, "<>": ~empty}.get(op, F.lit(False)) if op in (None, "=", "<>") else F.lit(False)
    if m := NUMBER.match(operand):
        n = float(m[1].replace(",", "")) / (100 if m[2] else 1)
        if op in (None, "=", "<>"):
            same = F.coalesce(_equal_number(F.lit(n), x), F.lit(False))
            return ~same if op == "<>" else same
        return (x["k"] == "num") & {"<": x["n"] < n, ">": x["n"] > n, "<=": x["n"] <= n, ">=": x["n"] >= n}[op]
    if operand.upper() in ("TRUE", "FALSE"):
        same = F.coalesce((x["k"] == "bool") & (x["b"] == (operand.upper() == "TRUE")), F.lit(False))
        return ~same if op == "<>" else same if op in (None, "=") else F.lit(False)
    if operand.upper() in v.ERRORS:
        same = F.coalesce((x["k"] == "err") & (x["e"] == operand.upper()), F.lit(False))
        return ~same if op == "<>" else same if op in (None, "=") else F.lit(False)
    if op in (None, "=", "<>"):
        same = F.coalesce((x["k"] == "text") & x["s"].rlike(v.wildcard_regex(operand)), F.lit(False))
        return ~same if op == "<>" else same
    a, b = v.sorting(x["s"]), v.sorting(F.lit(operand))
    return (x["k"] == "text") & {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def _equal_number(n: Column, x: Column) -> Column:
    """Numbers, and texts that read as that number."""
    return ((x["k"] == "num") & (x["n"] == n)) | ((x["k"] == "text") & (v.parse_number(x["s"]) == n))


def _dynamic(criterion: Column, x: Column) -> Column:
    """A criterion that is data: operator and operand are taken apart row by row."""

    def made(c: Column, y: Column) -> Column:
        whole = F.when(c["k"] == "text", c["s"]).otherwise(v.to_text(c)["s"])
        op = F.regexp_extract(whole, "^(<=|>=|<>|=|<|>)?", 1)
        operand = F.regexp_replace(whole, "^(<=|>=|<>|=|<|>)", "")
        n = v.parse_number(operand)
        empty = (y["k"] == "blank") | ((y["k"] == "text") & (y["s"] == ""))
        same = F.when(operand == "", empty).when(n.isNotNull(), _equal_number(n, y)).when(F.upper(operand).isin("TRUE", "FALSE"), (y["k"] == "bool") & (y["b"] == (F.upper(operand) == "TRUE"))).otherwise((y["k"] == "text") & F.regexp_like(F.coalesce(y["s"], F.lit("")), v.wildcard_pattern(operand)))
        same = F.coalesce(same, F.lit(False))
        sign = F.when(n.isNotNull() & (y["k"] == "num"), F.signum(y["n"] - n)).when(n.isNull() & (y["k"] == "text"), F.when(v.sorting(y["s"]) < v.sorting(operand), -1.0).when(v.sorting(y["s"]) > v.sorting(operand), 1.0).otherwise(0.0))
        ordered = F.when(op == "<", sign < 0).when(op == ">", sign > 0).when(op == "<=", sign <= 0).when(op == ">=", sign >= 0)
        return F.coalesce(F.when(op.isin("", "="), same).when(op == "<>", ~same).otherwise(ordered), F.lit(False))

    return v.lets([criterion, x], made)
