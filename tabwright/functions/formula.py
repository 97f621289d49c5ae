"""Formulas and row conditions as Spark columns.

The text is read with Python's own ``ast`` and only the node kinds listed here
are turned into expressions, so no user text is ever executed.  Rules that
differ from plain SQL:

* division by zero gives NULL;
* a comparison with a missing value is false, except ``!=``, which is true.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class FormulaError(ValueError):
    """The text is not an allowed formula over the given columns."""


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "expm1": F.expm1,
    "log": F.ln, "log1p": F.log1p, "log10": F.log10,
    "floor": F.floor, "ceil": F.ceil, "round": F.round, "power": F.pow,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "arctan2": F.atan2,
    "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh,
    "minimum": F.least, "maximum": F.greatest,
}

_ARITHMETIC: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)),
    ast.Mod: lambda a, b: a - b * F.floor(F.try_divide(a, b)),
    ast.Pow: F.pow,
}

_COMPARISONS: dict[type, Callable[[Column, Column], Column]] = {
    ast.Eq: lambda a, b: a == b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}

_TABLE_NAMES = {"data", "df"}


class _Translator:
    def __init__(self, columns: Sequence[str], logic: bool):
        self.columns = set(columns)
        self.logic = logic
        self.quoted: list[str] = []

    def parse(self, text: str) -> ast.expr:
        def hide(match: re.Match) -> str:
            self.quoted.append(match.group(1))
            return f"__quoted_{len(self.quoted) - 1}"

        try:
            return ast.parse(re.sub(r"`([^`]+)`", hide, text).strip(), mode="eval").body
        except (SyntaxError, ValueError) as error:
            raise FormulaError(f"cannot read {text!r}: {error}") from error

    def column(self, name: str) -> Column:
        if name.startswith("__quoted_"):
            name = self.quoted[int(name.removeprefix("__quoted_"))]
        if name not in self.columns:
            raise FormulaError(f"unknown column {name!r}")
        return F.col(f"`{name}`")

    def value(self, node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=bool() | int() | float() | str()):
                return F.lit(node.value)
            case ast.Name(id=name):
                return self.column(name)
            case ast.Subscript(value=ast.Name(id=table), slice=ast.Constant(value=str() as name)) if table in _TABLE_NAMES:
                return self.column(name)
            case ast.Attribute(value=ast.Name(id=table), attr=name) if table in _TABLE_NAMES:
                return self.column(name)
            case ast.BinOp(op=ast.BitAnd() | ast.BitOr()):
                return self.truth(node, strict=True)
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _ARITHMETIC:
                return _ARITHMETIC[type(op)](self.value(left), self.value(right))
            case ast.UnaryOp(op=ast.USub(), operand=operand):
                return -self.value(operand)
            case ast.UnaryOp(op=ast.UAdd(), operand=operand):
                return self.value(operand)
            case ast.Call(func=func, args=args, keywords=[]):
                return self.call(func, args)
            case ast.Compare() | ast.BoolOp() | ast.UnaryOp(op=ast.Not() | ast.Invert()):
                return self.truth(node, strict=True)
        raise FormulaError(f"{type(node).__name__} is not allowed in a formula")

    def call(self, func: ast.expr, args: list[ast.expr]) -> Column:
        match func:
            case ast.Name(id=name) | ast.Attribute(value=ast.Name(id="np" | "numpy" | "math"), attr=name):
                pass
            case _:
                raise FormulaError("only plain function calls are allowed")
        if name not in FUNCTIONS:
            raise FormulaError(f"function {name!r} is not allowed")
        if name == "round" and len(args) == 2:
            if not isinstance(args[1], ast.Constant) or not isinstance(args[1].value, int):
                raise FormulaError("round takes a whole number of digits")
            return F.round(self.value(args[0]), args[1].value)
        try:
            return FUNCTIONS[name](*[self.value(a) for a in args])
        except TypeError as error:
            raise FormulaError(f"wrong arguments for {name!r}") from error

    def truth(self, node: ast.expr, strict: bool) -> Column:
        """A boolean column.

        ``strict`` turns "unknown" into false.  It is only needed below a
        negation or in a stored value; a filter drops unknown rows anyway, and
        the bare comparison can be pushed into the scan.
        """
        if not self.logic:
            raise FormulaError("comparisons are not allowed in an arithmetic formula")
        match node:
            case ast.BoolOp(op=op, values=values):
                parts = [self.truth(v, strict) for v in values]
                return _fold(parts, isinstance(op, ast.And))
            case ast.BinOp(left=left, op=ast.BitAnd() | ast.BitOr() as op, right=right):
                return _fold([self.truth(left, strict), self.truth(right, strict)], isinstance(op, ast.BitAnd))
            case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=operand):
                return ~self.truth(operand, strict=True)
            case ast.Compare(left=left, ops=ops, comparators=rights):
                parts = []
                for op, right in zip(ops, rights):
                    parts.append(self.compare(left, op, right, strict))
                    left = right
                return _fold(parts, True)
            case ast.Constant(value=bool()):
                return F.lit(node.value)
            case _:
                bare = self.value(node)
                return F.coalesce(bare, F.lit(False)) if strict else bare

    def compare(self, left: ast.expr, op: ast.cmpop, right: ast.expr, strict: bool) -> Column:
        known = (lambda c: F.coalesce(c, F.lit(False))) if strict else (lambda c: c)
        match op:
            case ast.In() | ast.NotIn():
                if not isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                    raise FormulaError("'in' needs a list of values")
                member = self.value(left).isin(*[self.value(v) for v in right.elts])
                if isinstance(op, ast.In):
                    return known(member)
                return ~F.coalesce(member, F.lit(False))
            case ast.NotEq():
                return F.coalesce(self.value(left) != self.value(right), F.lit(True))
        if type(op) not in _COMPARISONS:
            raise FormulaError(f"{type(op).__name__} is not allowed in a condition")
        return known(_COMPARISONS[type(op)](self.value(left), self.value(right)))


def _fold(parts: list[Column], conjunction: bool) -> Column:
    whole = parts[0]
    for part in parts[1:]:
        whole = (whole & part) if conjunction else (whole | part)
    return whole


def formula(text: str, columns: Sequence[str]) -> Column:
    """An arithmetic formula such as ``price * (1 - discount)``."""
    reader = _Translator(columns, logic=False)
    return reader.value(reader.parse(text))


def expression(text: str, columns: Sequence[str]) -> Column:
    """A formula that may also compare, as used for generated features."""
    reader = _Translator(columns, logic=True)
    return reader.value(reader.parse(text))


def condition(text: str, columns: Sequence[str]) -> Column:
    """A row condition such as ``qty > 30 and flag != 'R'``."""
    reader = _Translator(columns, logic=True)
    return reader.truth(reader.parse(text), strict=False)
