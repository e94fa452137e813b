"""Formula text to a tree: a recursive-descent parser that runs when a plan is made.

Precedence, tightest first: range, unary sign, percent, power, product, sum, concatenation,
comparison. Power groups to the left and a sign binds tighter than it, so ``-2^2`` is 4.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .cells import parse_reference
from .values import ERRORS

MAX_DEPTH = 256


class FormulaError(ValueError):
    """The text is no formula."""


class UnsupportedFormula(ValueError):
    """The formula uses a form that is kept as stored and reported: names, structured or 3-D references."""


@dataclass(frozen=True)
class Constant:
    value: float | str | bool | None
    error: str | None = None


@dataclass(frozen=True)
class ArrayConstant:
    rows: tuple[tuple[Constant, ...], ...]


@dataclass(frozen=True)
class Reference:
    sheet: str | None
    r1: int
    c1: int
    r2: int
    c2: int
    text: str

    @property
    def single(self) -> bool:
        return (self.r1, self.c1) == (self.r2, self.c2)


@dataclass(frozen=True)
class Unary:
    op: str
    operand: object


@dataclass(frozen=True)
class Percent:
    operand: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


TOKEN = re.compile(
    r"""\s*(?:
      (?P<error>\#(?:DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A|NULL!|GETTING_DATA))
    | (?P<string>"(?:[^"]|"")*")
    | (?P<ref>(?:(?:'(?:[^']|'')+'|[A-Za-z_][\w.]*)!)?(?:\$?[A-Za-z]{1,3}\$?[0-9]{1,7}(?::\$?[A-Za-z]{1,3}\$?[0-9]{1,7})?|\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}|\$?[0-9]{1,7}:\$?[0-9]{1,7})(?![\w(.!]))
    | (?P<number>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
    | (?P<name>[A-Za-z_\\][\w.]*)
    | (?P<op><>|<=|>=|[-+*/^&=<>%(),;{}\[\]:!])
    )""",
    re.X,
)


def tokens(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise FormulaError(f"unexpected character at {at + 1}")
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*found, ("end", "")]


LEVELS = [("=", "<>", "<", ">", "<=", ">="), ("&",), ("+", "-"), ("*", "/"), ("^",)]


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.depth = tokens(text), 0, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.tokens[self.at]
        if value is not None and token[1] != value:
            raise FormulaError(f"expected {value}")
        self.at += 1
        return token

    def expression(self, level: int = 0):
        self.depth += 1
        if self.depth > MAX_DEPTH * (len(LEVELS) + 2):
            raise UnsupportedFormula("nested too deep")
        try:
            if level == len(LEVELS):
                return self.percent()
            left = self.expression(level + 1)
            while self.peek()[0] == "op" and self.peek()[1] in LEVELS[level]:
                op = self.take()[1]
                left = Binary(op, left, self.expression(level + 1))
            return left
        finally:
            self.depth -= 1

    def percent(self):
        node = self.unary()
        while self.peek() == ("op", "%"):
            self.take()
            node = Percent(node)
        return node

    def unary(self):
        if self.peek()[0] == "op" and self.peek()[1] in "+-":
            op = self.take()[1]
            return Unary(op, self.unary())
        return self.primary()

    def primary(self):
        kind, value = self.take()
        if kind == "number":
            return Constant(float(value))
        if kind == "string":
            return Constant(value[1:-1].replace('""', '"'))
        if kind == "error":
            assert value in ERRORS
            return Constant(None, value)
        if kind == "ref":
            return self.reference(value)
        if kind == "name":
            return self.named(value)
        if value == "(":
            node = self.expression()
            self.take(")")
            return node
        if value == "{":
            return self.array()
        raise UnsupportedFormula("structured reference") if value == "[" else FormulaError(f"unexpected {value or 'end'}")

    @staticmethod
    def reference(value: str) -> Reference:
        sheet, _, area = value.rpartition("!")
        sheet = sheet[1:-1].replace("''", "'") if sheet.startswith("'") else sheet
        return Reference(sheet or None, *parse_reference(area), area.replace("$", "").upper())

    def named(self, name: str):
        upper = re.sub(r"^(_XLFN\.|_XLWS\.)+", "", name.upper())
        if self.peek() == ("op", "("):
            self.take()
            return Call(upper, tuple(self.arguments()))
        if upper in ("TRUE", "FALSE"):
            return Constant(upper == "TRUE")
        raise UnsupportedFormula("3-D reference" if self.peek()[1] in (":", "!") else f"name {name}")

    def arguments(self) -> list:
        found = []
        if self.peek() == ("op", ")"):
            self.take()
            return found
        while True:
            found.append(Constant(None) if self.peek()[1] in (",", ")") else self.expression())
            if self.take()[1] == ")":
                return found
            if self.tokens[self.at - 1][1] != ",":
                raise FormulaError("expected , or )")

    def array(self) -> ArrayConstant:
        rows, row = [], []
        while True:
            sign = -1 if self.peek() == ("op", "-") else 1
            if self.peek()[1] in "+-" and self.peek()[0] == "op":
                self.take()
            node = self.primary()
            if not isinstance(node, Constant):
                raise FormulaError("an array holds constants")
            row.append(Constant(sign * node.value) if isinstance(node.value, float) else node)
            end = self.take()[1]
            if end in (";", "}"):
                rows.append(tuple(row))
                row = []
                if end == "}":
                    if len({len(r) for r in rows}) > 1:
                        raise FormulaError("rows of an array have one length")
                    return ArrayConstant(tuple(rows))
            elif end != ",":
                raise FormulaError("expected , ; or }")


def parse(text: str):
    """The tree of a formula, with or without its leading =."""
    p = _Parser(text[1:] if text.startswith("=") else text)
    node = p.expression()
    if p.peek()[0] != "end":
        raise FormulaError(f"unexpected {p.peek()[1]}")
    return node


def references(node) -> list[Reference]:
    """References of a tree, in order."""
    if isinstance(node, Reference):
        return [node]
    kids = {Unary: lambda: [node.operand], Percent: lambda: [node.operand], Binary: lambda: [node.left, node.right], Call: lambda: list(node.args)}.get(type(node), list)()
    return [r for k in kids for r in references(k)]
