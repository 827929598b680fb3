"""A small arithmetic language over features, compiled to one native Column.

An expression is parsed once on the driver, checked against the allowed features
and functions, and becomes a Column that Catalyst generates code for. Arithmetic
is that of IEEE doubles with NumPy's rules: comparisons with NaN are false,
minima and maxima carry it on, division is guarded, and a result that isn't
finite is replaced at the end.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column

CONSTANTS = {"pi": math.pi, "e": math.e}
#: How infinities end, bounds of powers, and of the logistic function.
HUGE, BASE, EXPONENT, LOGIT, EPS = 1e6, 1e6, 8.0, 40.0, 1e-6


class ExpressionError(ValueError):
    """An expression that the language does not take."""


def _nan(*xs: Column) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | F.isnan(x)
    return out


def _guarded(f: Callable[..., Column]) -> Callable[..., Column]:
    """NaN in, NaN out; the function itself sees none."""
    return lambda *xs: F.when(_nan(*xs), float("nan")).otherwise(f(*xs))


def _least(*xs: Column) -> Column:
    return F.least(*xs)


def _clip(x: Column, lo: Column | float, hi: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(x, as_col(lo)), as_col(hi))


def _safe_div(a: Column, b: Column, eps: float = EPS) -> Column:
    den = F.when(F.abs(b) < eps, F.when(b < 0, -abs(eps)).otherwise(abs(eps))).otherwise(b)
    return F.when(_nan(a, b), float("nan")).otherwise(a / F.when(den != 0, den).otherwise(abs(eps)))


def _mean(*xs: Column) -> Column:
    total = xs[0]
    for x in xs[1:]:
        total = total + x
    return total / len(xs)


def _truth(x: Column) -> Column:
    return ~F.isnan(x) & (x > 0)


def _number(cond: Column) -> Column:
    return cond.cast("double")


#: name: (fewest arguments, most, function)
FUNCTIONS: dict[str, tuple[int, int | None, Callable[..., Column]]] = {
    "abs": (1, 1, F.abs),
    "min": (2, None, _guarded(_least)),
    "max": (2, None, _guarded(lambda *xs: F.greatest(*xs))),
    "clip": (3, 3, _guarded(_clip)),
    "sigmoid": (1, 1, _guarded(lambda x: 1 / (1 + F.exp(-_clip(x, -LOGIT, LOGIT))))),
    "relu": (1, 1, _guarded(lambda x: F.greatest(x, F.lit(0.0)))),
    "tanh": (1, 1, F.tanh),
    "exp": (1, 1, F.exp),
    "square": (1, 1, lambda x: x * x),
    "log": (1, 1, _guarded(lambda x: F.log(F.greatest(x, F.lit(1e-12))))),
    "log1p": (1, 1, _guarded(lambda x: F.log1p(F.greatest(x, F.lit(-0.999999))))),
    "sqrt": (1, 1, _guarded(lambda x: F.sqrt(F.greatest(x, F.lit(0.0))))),
    "safe_div": (2, 3, _safe_div),
    "avg": (2, None, _mean),
    "where": (3, 3, lambda c, x, y: F.when(_truth(c), x).otherwise(y)),
}
_COMPARE = {ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


def _power(a: Column, b: Column) -> Column:
    return F.pow(_clip(a, -BASE, BASE), _clip(b, -EXPONENT, EXPONENT))


def _modulo(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign."""
    d = F.when(b != 0, b)
    return F.coalesce(a - F.floor(a / d).cast("double") * d, F.lit(float("nan")))


_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: _safe_div, ast.Pow: _guarded(_power), ast.Mod: _guarded(_modulo)}


@dataclass(frozen=True)
class Program:
    """A checked expression and the features it reads, in order of appearance."""

    source: str
    tree: ast.expr
    features: tuple[str, ...]

    def column(self, features: dict[str, Column] | None = None, hint: tuple[float, float] | None = None, fallback: float = 0.0) -> Column:
        """The value for each row, finite, within ``hint`` if there is one."""
        known = {n: (features or {}).get(n, F.col(n)).cast("double") for n in self.features}
        try:
            x = _compile(self.tree, known)
        except ExpressionError:  # passes the check, can't be computed
            x = F.lit(float(fallback))
        x = F.when(x.isNull() | F.isnan(x), 0.0).when(x == float("inf"), HUGE).when(x == float("-inf"), -HUGE).otherwise(x)
        return _clip(x, *hint) if hint else x


def parse(source: str, allowed: Iterable[str]) -> Program:
    """Check an expression; unknown names, functions and syntax raise."""
    try:
        tree = ast.parse(source.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {e.msg}") from e
    names, known = [], set(allowed)
    _check(tree, known, names)
    return Program(source, tree, tuple(dict.fromkeys(names)))


def _check(node: ast.AST, known: set[str], names: list[str]) -> None:
    match node:
        case ast.Constant(value=bool() | int() | float()):
            pass
        case ast.Name(id=name):
            if name in known:
                names.append(name)
            elif name not in CONSTANTS:
                raise ExpressionError(f"unknown feature: {name}")
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
            _check(a, known, names), _check(b, known, names)
        case ast.UnaryOp(op=ast.USub() | ast.UAdd(), operand=a):
            _check(a, known, names)
        case ast.BoolOp(values=parts):
            for part in parts:
                _check(part, known, names)
        case ast.Compare(left=a, ops=ops, comparators=rest) if all(type(o) in _COMPARE for o in ops):
            for part in (a, *rest):
                _check(part, known, names)
        case ast.IfExp(test=t, body=a, orelse=b):
            for part in (t, a, b):
                _check(part, known, names)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
            least, most, _ = FUNCTIONS[name]
            if len(args) < least or most is not None and len(args) > most:
                raise ExpressionError(f"{name} takes {least}{'' if most == least else ' or more' if most is None else f' to {most}'} arguments, not {len(args)}")
            for part in args:
                _check(part, known, names)
        case _:
            raise ExpressionError(f"not allowed here: {type(node).__name__}")


def _compile(node: ast.AST, known: dict[str, Column]) -> Column:
    go = lambda n: _compile(n, known)
    match node:
        case ast.Constant(value=v):
            return F.lit(float(v))
        case ast.Name(id=name):
            return known[name] if name in known else F.lit(CONSTANTS[name])
        case ast.BinOp(left=a, op=op, right=b):
            return _BINARY[type(op)](go(a), go(b))
        case ast.UnaryOp(op=op, operand=a):
            return -go(a) if isinstance(op, ast.USub) else go(a)
        case ast.BoolOp(op=op, values=parts):
            out = _truth(go(parts[0]))
            for part in parts[1:]:
                out = out & _truth(go(part)) if isinstance(op, ast.And) else out | _truth(go(part))
            return _number(out)
        case ast.Compare(left=a, ops=[op], comparators=[b]):
            x, y = go(a), go(b)
            if isinstance(op, ast.NotEq):
                return _number(_nan(x, y) | (x != y))
            return _number(~_nan(x, y) & _COMPARE[type(op)](x, y))
        case ast.IfExp(test=t, body=a, orelse=b):
            return F.when(_truth(go(t)), go(a)).otherwise(go(b))
        case ast.Call(func=ast.Name(id="safe_div"), args=[a, b, eps]):
            return _safe_div(go(a), go(b), abs(_scalar(eps)))
        case ast.Call(func=ast.Name(id=name), args=args):
            return FUNCTIONS[name][2](*map(go, args))
    raise ExpressionError(f"can't be computed: {type(node).__name__}")


def _scalar(node: ast.AST) -> float:
    match node:
        case ast.Constant(value=v):
            return float(v)
        case ast.UnaryOp(op=ast.USub(), operand=a):
            return -_scalar(a)
    raise ExpressionError("eps is one number")
