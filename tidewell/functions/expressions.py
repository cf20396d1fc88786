"""Expressions in Python's syntax as columns.

The operators of data-frame expressions: arithmetic with `**`, `//` and `%`, chained comparisons, `in`,
`and`, `or`, `not`, and `&`, `|` with the precedence of `and` and `or`; names in backticks may hold any
character. A comparison with a missing value is false, and `!=` true; undefined numbers are NULL.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.frames import FrameError
from tidewell.functions import math as m

ARITHMETIC: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a.cast("double"), b),
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a.cast("double"), b)),
    ast.Mod: m.floored_modulo,
    ast.Pow: m.power,
}
COMPARISONS: dict[type, Callable[[Column, Column], Column]] = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}
# Names of the functions that such expressions may call.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": m.absolute, "sqrt": m.square_root, "exp": m.exponential, "log": m.natural_log,
    "log10": lambda x: m.log_to_base(x, F.lit(10.0)), "expm1": lambda x: m.defined(F.expm1(x)), "log1p": F.log1p,
    "sin": m.sine, "cos": m.cosine, "tan": m.tangent, "arcsin": m.arc_sine, "arccos": m.arc_cosine,
    "arctan": m.arc_tangent, "arctan2": F.atan2, "sinh": lambda x: m.defined(F.sinh(x)),
    "cosh": lambda x: m.defined(F.cosh(x)), "tanh": F.tanh, "floor": F.floor, "ceil": F.ceil,
}
_WORDS = {"&": "and", "|": "or"}


def to_column(expression: str, names: Mapping[str, Column]) -> Column:
    """The expression over the named columns."""
    quoted: list[str] = []

    def hide(match: re.Match) -> str:
        quoted.append(match[1])
        return f"_quoted_{len(quoted) - 1}"

    try:
        text = re.sub(r"`([^`]+)`", hide, expression.strip())
        tokens = tokenize.generate_tokens(io.StringIO(text).readline)
        words = [(tokenize.NAME, _WORDS[t.string]) if t.string in _WORDS else (t.type, t.string) for t in tokens]
        tree = ast.parse(tokenize.untokenize(words).strip(), mode="eval")
    except (SyntaxError, tokenize.TokenError) as error:
        raise FrameError(f"{expression!r} is not an expression: {error}") from None
    known = {**names, **{f"_quoted_{i}": names[q] for i, q in enumerate(quoted) if q in names}}
    return _build(tree.body, known, expression)


def _compare(test: ast.cmpop, left: ast.expr, right: ast.expr, build: Callable[[ast.expr], Column]) -> Column:
    if isinstance(test, (ast.In, ast.NotIn)) and isinstance(right, (ast.List, ast.Tuple)):
        among = reduce(lambda a, b: a | b, [F.coalesce(build(left) == build(x), F.lit(False)) for x in right.elts], F.lit(False))
        return ~among if isinstance(test, ast.NotIn) else among
    if type(test) not in COMPARISONS:
        raise FrameError(f"comparison {type(test).__name__} is not supported")
    return F.coalesce(COMPARISONS[type(test)](build(left), build(right)), F.lit(isinstance(test, ast.NotEq)))


def _build(node: ast.expr, names: Mapping[str, Column], text: str) -> Column:
    def build(part: ast.expr) -> Column:
        return _build(part, names, text)

    match node:
        case ast.Constant(value=bool() | int() | float() | str()):
            return F.lit(node.value)
        case ast.Name() if node.id in names:
            return names[node.id]
        case ast.BinOp() if type(node.op) in ARITHMETIC:
            return ARITHMETIC[type(node.op)](build(node.left), build(node.right))
        case ast.UnaryOp(op=ast.USub()):
            return -build(node.operand)
        case ast.UnaryOp(op=ast.UAdd()):
            return build(node.operand)
        case ast.UnaryOp(op=ast.Not() | ast.Invert()):
            return ~build(node.operand)
        case ast.BoolOp():
            join = (lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b)
            return reduce(join, map(build, node.values))
        case ast.Compare():
            sides = [node.left, *node.comparators]
            tests = [_compare(op, a, b, build) for op, a, b in zip(node.ops, sides, sides[1:], strict=False)]
            return reduce(lambda a, b: a & b, tests)
        case ast.Call(func=ast.Name()) if node.func.id in FUNCTIONS and not node.keywords:
            return FUNCTIONS[node.func.id](*map(build, node.args))
    raise FrameError(f"{ast.unparse(node)!r} in {text!r} is not a known name, function or operator")
