"""Rule strings compiled to columns.

A rule is parsed, never evaluated: names of columns, numbers, comparisons,
arithmetic, & | ~ and a few functions become a Column; anything else is an
error.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.functions.windows import true

Condition = str | Column | Callable[[DataFrame], Column]

_BINARY = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b),
    ast.Mod: lambda a, b: F.try_mod(a, b), ast.Pow: lambda a, b: F.pow(a, b), ast.BitAnd: lambda a, b: true(a) & true(b), ast.BitOr: lambda a, b: true(a) | true(b),
}
_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}
_CALLS: dict[str, tuple[int, Callable]] = {
    "abs": (1, F.abs), "log": (1, F.ln), "sqrt": (1, F.sqrt), "exp": (1, F.exp), "sign": (1, F.signum), "isnan": (1, lambda x: x.isNull() | F.isnan(x)),
    "maximum": (2, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))), "minimum": (2, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))),
    "floor": (1, F.floor), "ceil": (1, F.ceil), "round": (1, lambda x: F.bround(x)), "log1p": (1, F.log1p), "isfinite": (1, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
    "power": (2, F.pow), "clip": (3, lambda x, a, b: F.when(x.isNotNull(), F.greatest(F.least(x, b), a))), "square": (1, lambda x: x * x),
    "where": (3, lambda c, a, b: F.when(true(c), a).otherwise(b)),
}


def compile_rule(rule: str, columns: list[str]) -> Column:
    """The rule as a boolean column; ValueError if it isn't one over these columns."""
    try:
        tree = ast.parse(rule.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"Bad expression {rule!r}: {e.msg}") from None
    names: set[str] = set()

    def walk(node: ast.AST) -> Column:
        if isinstance(node, ast.Name):
            if node.id not in columns:
                raise ValueError(f"Unknown name {node.id!r}; columns are {sorted(columns)}")
            names.add(node.id)
            return F.col(node.id)
        if isinstance(node, ast.Constant) and isinstance(node.value, bool | int | float):
            return F.lit(node.value)
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd | ast.Invert):
            x = walk(node.operand)
            return ~true(x) if isinstance(node.op, ast.Invert) else -x if isinstance(node.op, ast.USub) else x
        if isinstance(node, ast.Compare) and all(type(op) in _COMPARE for op in node.ops):
            parts = [walk(x) for x in (node.left, *node.comparators)]
            out = _COMPARE[type(node.ops[0])](parts[0], parts[1])
            for op, a, b in zip(node.ops[1:], parts[1:], parts[2:], strict=False):
                out = out & _COMPARE[type(op)](a, b)
            return out
        if isinstance(node, ast.Call) and not node.keywords:
            f = node.func
            name = f.attr if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "np" else f.id if isinstance(f, ast.Name) else None
            if name in _CALLS and len(node.args) == _CALLS[name][0]:
                return _CALLS[name][1](*map(walk, node.args))
        raise ValueError(f"Bad expression {rule!r}: {type(node).__name__} is not allowed here")

    out = walk(tree)
    if not names:
        raise ValueError(f"Bad expression {rule!r}: it names no column")
    return out


def condition(c: Condition, df: DataFrame) -> Column:
    """A rule string, a column or a function of the frame, as a column in which null is false."""
    if isinstance(c, str):
        return true(compile_rule(c, df.columns))
    out = c(df) if callable(c) and not isinstance(c, Column) else c
    if not isinstance(out, Column):
        raise ValueError(f"a condition must give a Column, not {type(out).__name__}")
    return true(out)


def parse_indicators(text: str) -> tuple[list[tuple[str, dict]], list[str], list[str]]:
    """(specs, column names, errors) of lines like ``rsi:14``; a missing value takes the default, unknown names are errors."""
    settings = {"sma": ("window", 20), "ewma": ("span", 20), "std": ("window", 20), "zscore": ("window", 20), "rsi": ("window", 14), "atr": ("window", 14), "ret": ("periods", 1)}
    specs, names, errors = [], [], []
    for line in filter(None, map(str.strip, text.splitlines())):
        name, _, value = (part.strip() for part in line.partition(":"))
        name = name.lower()
        if name not in settings:
            errors.append(f"unknown indicator {name!r}")
            continue
        key, default = settings[name]
        try:
            n = int(float(value)) if value else default
        except ValueError:
            errors.append(f"bad value {value!r} for {name}")
            continue
        specs.append((name, {key: n}))
        names.append(f"{name}_{n}")
    return specs, names, errors
