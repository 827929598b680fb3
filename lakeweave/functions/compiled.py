"""User-written features as native columns.

A feature's checked syntax tree is walked once, with a column for each of its names.
Conditions become choices, loops become folds of an array whose state is what the body
changes, sets and maps become arrays and Spark's maps. An error in Python is a null here:
a division by 0, a missing field or key, a number taken of nothing make everything
that needs them null, and a null result gives the fallback. All numbers are
doubles. What has no such form (a loop that is left early, a text made of a number)
raises ``Unsupported`` while compiling, and the feature runs in Arrow batches instead.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as ty

from . import generated
from . import text as T


class Unsupported(Exception):
    """Code that has no native form."""


@dataclass(frozen=True)
class Kind:
    """number, text, flag, list, set, map, side, helpers, helper, context or empty; ``of`` is what a container holds."""

    name: str
    of: Kind | None = None


NUMBER, TEXT, FLAG = Kind("number"), Kind("text"), Kind("flag")
SQL = {"number": "double", "text": "string", "flag": "boolean"}


def sql(kind: Kind) -> str:
    if kind.name in ("list", "set"):
        if kind.of is None:
            raise Unsupported("nothing tells what it holds")
        return f"array<{sql(kind.of)}>"
    if kind.name == "map":
        return f"map<string,{sql(kind.of)}>"
    if kind.name not in SQL:
        raise Unsupported(kind.name)
    return SQL[kind.name]


@dataclass(frozen=True)
class Value:
    kind: Kind
    col: Column | None = None
    fields: dict | None = None
    #: Of what is read from a profile, where null is None and no error: whether there is a profile.
    given: Column | None = None


def _array(x: Value) -> Column:
    if x.kind.name not in ("list", "set"):
        raise Unsupported("not a list or a set")
    return F.array().cast("array<string>") if x.kind.of is None else x.col


def _truth(x: Value) -> Column:
    if x.kind.name == "flag":
        found = x.col
    elif x.kind.name == "number":
        found = x.col != 0
    elif x.kind.name == "text":
        found = x.col != ""
    elif x.kind.name in ("list", "set"):
        found = F.lit(False) if x.kind.of is None else F.size(x.col) > 0
    elif x.kind.name == "map":
        found = F.size(x.col) > 0
    else:
        raise Unsupported("no truth of it")
    if x.given is not None:
        return F.when(x.given, F.coalesce(found, F.lit(False)))
    return F.when((x.col if x.col is not None else F.lit(0)).isNotNull(), found)


def _choose(test: Column, yes: Value, no: Value) -> Value:
    """One of two values; null if the test is an error."""
    if yes.kind != no.kind:
        if {yes.kind.name, no.kind.name} == {"number", "flag"}:
            yes, no = (Value(NUMBER, x.col.cast("double")) for x in (yes, no))
        elif yes.kind.name == no.kind.name and None in (yes.kind.of, no.kind.of):
            kind = yes.kind if yes.kind.of is not None else no.kind
            yes, no = (x if x.kind == kind else Value(kind, F.array().cast(sql(kind))) for x in (yes, no))
        else:
            raise Unsupported("a choice of different kinds")
    if yes.kind.name in ("side", "helpers", "helper", "context") or yes.kind.of is None and yes.kind.name in ("list", "set"):
        return yes
    return Value(yes.kind, F.when(test, yes.col).when(~test, no.col))


def _number(x: Value) -> Column:
    if x.kind.name not in ("number", "flag"):
        raise Unsupported("not a number")
    return x.col.cast("double")


def _whole(x: Column) -> Column:
    """A number without its fraction; an error of what isn't finite."""
    return F.when(F.abs(x) < float("inf"), F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))).cast("double")


def _every(cols: list[Column], found: Column) -> Column:
    """``found``, or null if one of ``cols`` is."""
    known = F.lit(True)
    for c in cols:
        known = known & c.isNotNull()
    return F.when(known, found)


def _overlap(a: Column, b: Column, per: Callable[[Column, Column], Column]) -> Column:
    both = F.size(F.array_intersect(a, b))
    ratio = F.transform(F.array(both), lambda n: F.when((F.size(a) > 0) & (F.size(b) > 0), n / per(n, F.size(a) + F.size(b) - n)).otherwise(0.0))[0]
    return _every([a, b], ratio)


def _helper(name: str, args: list[Value]) -> Value:
    sets = lambda: [F.array_distinct(_array(x)) for x in args[:2]]
    texts, n = [x.col for x in args[:2]] if all(x.kind == TEXT for x in args[:2]) else None, len(args)
    if name in ("set_jaccard", "token_jaccard") and n == 2 or name == "weighted_jaccard" and n == 2:
        return Value(NUMBER, _overlap(*sets(), lambda both, either: either))
    if name == "numeric_overlap_max" and n == 2:
        a, b = sets()
        return Value(NUMBER, _overlap(a, b, lambda both, either: F.least(F.size(a), F.size(b))))
    if name in ("safe_ratio_float", "safe_ratio_int") and n == 2:
        a, b = map(_number, args)
        return Value(NUMBER, _every([a, b], F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(0.0)))
    if name == "clip01" and n == 1:
        x = _number(args[0])
        return Value(NUMBER, _every([x], F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))))
    if name == "normalized_edit_similarity" and n == 2 and texts:
        a, b = texts
        return Value(NUMBER, _every([a, b], T.edit_similarity(a, b)))
    if name == "char_ngram_jaccard" and n == 3 and texts and args[2].kind == NUMBER and isinstance(args[2].fields, dict):
        a, b = texts
        return Value(NUMBER, _every([a, b], T.ngram_jaccard(a, b, int(args[2].fields["constant"]))))
    if name == "cosine_similarity" and n == 2:
        a, b = (_array(x) for x in args)
        return Value(NUMBER, _every([a, b], T.cosine(a, b)))
    raise Unsupported(f"helper {name}")


class Compiler:
    def __init__(self, sides: dict[str, dict[str, Value]], vectors: dict[str, Value]):
        self.context = {"helpers": Value(Kind("helpers")), **{k: Value(Kind("side"), fields=v) for k, v in sides.items()}, **vectors}

    # ---- expressions

    def read(self, node: ast.expr, env: dict[str, Value]) -> Value:
        method = getattr(self, f"read_{type(node).__name__}", None)
        if method is None:
            raise Unsupported(type(node).__name__)
        return method(node, env)

    def read_Name(self, node, env):
        if node.id == "ctx":
            return Value(Kind("context"))
        if node.id not in env:
            raise Unsupported(f"{node.id} may not be known")
        return env[node.id]

    def read_Constant(self, node, env):
        v = node.value
        if isinstance(v, bool):
            return Value(FLAG, F.lit(v))
        if isinstance(v, int | float):
            return Value(NUMBER, F.lit(float(v)), {"constant": v})
        if isinstance(v, str):
            return Value(TEXT, F.lit(v), {"constant": v})
        raise Unsupported("a constant")

    def read_Subscript(self, node, env):
        of = self.read(node.value, env)
        if isinstance(node.slice, ast.Slice):
            raise Unsupported("slices")
        key = self.read(node.slice, env)
        name = (key.fields or {}).get("constant")
        if of.kind.name == "context" and name in self.context:
            return self.context[name]
        if of.kind.name == "side":
            if name not in of.fields:
                raise Unsupported(f"no field {name}")
            return of.fields[name]
        if of.kind.name == "helpers":
            return Value(Kind("helper"), fields={"constant": name})
        if of.kind.name == "map" and key.kind == TEXT:
            return Value(of.kind.of, F.try_element_at(of.col, key.col))
        if of.kind.name == "list" and of.kind.of is not None and isinstance(name, int):
            return Value(of.kind.of, F.try_element_at(of.col, F.lit(name + 1 if name >= 0 else name)))
        raise Unsupported("a subscript")

    def read_UnaryOp(self, node, env):
        if isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant) and isinstance(node.operand.value, int | float):
            return self.read(ast.Constant(-node.operand.value), env)
        if isinstance(node.op, ast.Not):
            return Value(FLAG, ~self.test(node.operand, env))
        x = self.read(node.operand, env)
        return Value(NUMBER, -_number(x) if isinstance(node.op, ast.USub) else _number(x))

    def read_BoolOp(self, node, env):
        parts = [self.read(v, env) for v in node.values]
        out = parts[-1]
        for x in reversed(parts[:-1]):
            out = _choose(_truth(x), out, x) if isinstance(node.op, ast.And) else _choose(_truth(x), x, out)
        return out

    def read_BinOp(self, node, env):
        a, b = self.read(node.left, env), self.read(node.right, env)
        if isinstance(node.op, ast.Add):
            if a.kind == b.kind == TEXT:
                return Value(TEXT, F.concat(a.col, b.col))
            if a.kind.name == b.kind.name == "list" and a.kind == b.kind:
                return Value(a.kind, F.concat(a.col, b.col))
        x, y = _number(a), _number(b)
        ops = {ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Div: lambda: F.when(y != 0, x / F.when(y != 0, y)), ast.Mod: lambda: F.when(y != 0, x - y * F.floor(x / F.when(y != 0, y))), ast.Pow: lambda: F.when((x != 0) | (y >= 0), F.pow(x, y))}
        if type(node.op) not in ops:
            raise Unsupported("an operation")
        return Value(NUMBER, ops[type(node.op)]())

    def test(self, node: ast.expr, env: dict[str, Value]) -> Column:
        """Whether a condition holds, whatever its parts are."""
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~self.test(node.operand, env)
        if not isinstance(node, ast.BoolOp):
            return _truth(self.read(node, env))
        parts = [self.test(v, env) for v in node.values]
        out = parts[-1]
        for x in reversed(parts[:-1]):
            out = F.when(x, out).when(~x, F.lit(False)) if isinstance(node.op, ast.And) else F.when(x, F.lit(True)).when(~x, out)
        return out

    def read_IfExp(self, node, env):
        return _choose(self.test(node.test, env), self.read(node.body, env), self.read(node.orelse, env))

    def read_Compare(self, node, env):
        left, out = self.read(node.left, env), None
        for op, right_node in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, ast.Is | ast.IsNot):
                if not (isinstance(right_node, ast.Constant) and right_node.value is None and left.given is not None):
                    raise Unsupported("is")
                found, right = F.when(left.given, left.col.isNull() if isinstance(op, ast.Is) else left.col.isNotNull()), left
            else:
                right = self.read(right_node, env)
                found = self.compared(op, left, right)
            out = found if out is None else F.when(out, found).when(~out, F.lit(False))
            left = right
        return Value(FLAG, out)

    def compared(self, op: ast.cmpop, a: Value, b: Value) -> Column:
        if isinstance(op, ast.In | ast.NotIn):
            if b.kind.name in ("list", "set"):
                found = F.lit(False) if b.kind.of is None else F.exists(b.col, lambda x: x.eqNullSafe(a.col)) if a.kind == b.kind.of else None
            elif b.kind.name == "map" and a.kind == TEXT:
                found = F.map_contains_key(b.col, a.col)
            else:
                found = F.contains(b.col, a.col) if a.kind == b.kind == TEXT else None
            if found is None:
                raise Unsupported("in")
            return ~found if isinstance(op, ast.NotIn) else found
        if {a.kind.name, b.kind.name} <= {"number", "flag"}:
            x, y = _number(a), _number(b)
        elif a.kind == b.kind == TEXT:
            x, y = a.col, b.col
        else:
            raise Unsupported("a comparison")
        ops = {ast.Eq: lambda: x == y, ast.NotEq: lambda: x != y, ast.Lt: lambda: x < y, ast.LtE: lambda: x <= y, ast.Gt: lambda: x > y, ast.GtE: lambda: x >= y}
        return ops[type(op)]()

    def read_List(self, node, env):
        parts = [self.read(e, env) for e in node.elts]
        if not parts:
            return Value(Kind("list"))
        if len({p.kind for p in parts}) > 1:
            raise Unsupported("a list of several kinds")
        return Value(Kind("list", parts[0].kind), F.array(*[p.col for p in parts]))

    def read_ListComp(self, node, env):
        if len(node.generators) != 1 or not isinstance(node.generators[0].target, ast.Name):
            raise Unsupported("a comprehension of several")
        g = node.generators[0]
        of = self.items(self.read(g.iter, env))
        inside = lambda x: env | {g.target.id: Value(of.kind.of, x)}
        kind: list[Kind] = []

        def make(x: Column) -> Column:
            got = self.read(node.elt, inside(x))
            kind.append(got.kind)
            return got.col

        kept = of.col
        if g.ifs:
            kept = F.filter(kept, lambda x: self.test(g.ifs[0] if len(g.ifs) == 1 else ast.BoolOp(ast.And(), g.ifs), inside(x)))
        made = F.transform(kept, make)
        return Value(Kind("list", kind[0]), made)

    def items(self, x: Value) -> Value:
        """What a loop over a value goes through."""
        if x.kind.name == "map":
            return Value(Kind("list", TEXT), F.map_keys(x.col))
        if x.kind.name in ("list", "set") and x.kind.of is not None:
            return Value(Kind("list", x.kind.of), x.col)
        raise Unsupported("a loop over it")

    def read_Call(self, node, env):
        if isinstance(node.func, ast.Attribute):
            return self.method(node, env)
        if isinstance(node.func, ast.Name) and node.func.id not in env:
            return self.builtin(node.func.id, [self.read(a, env) for a in node.args])
        f = self.read(node.func, env)
        if f.kind.name != "helper":
            raise Unsupported("a call")
        return _helper(f.fields["constant"], [self.read(a, env) for a in node.args])

    def method(self, node, env):
        of, name, args = self.read(node.func.value, env), node.func.attr, [self.read(a, env) for a in node.args]
        if name == "keys" and of.kind.name == "map" and not args:
            return Value(Kind("list", TEXT), F.map_keys(of.col))
        if name == "get" and of.kind.name == "map" and args and args[0].kind == TEXT:
            if len(args) != 2 or args[1].kind != of.kind.of:
                raise Unsupported("get")
            return Value(of.kind.of, _every([of.col, args[0].col], F.coalesce(F.try_element_at(of.col, args[0].col), args[1].col)))
        if name in ("intersection", "union") and of.kind.name == "set" and len(args) == 1 and args[0].kind.name in ("list", "set"):
            known = of.kind.of or args[0].kind.of
            if known is None or {of.kind.of or known, args[0].kind.of or known} != {known}:
                raise Unsupported("sets of different kinds")
            a, b = (x.col if x.kind.of is not None else F.array().cast(f"array<{sql(known)}>") for x in (of, args[0]))
            return Value(Kind("set", known), F.array_intersect(a, b) if name == "intersection" else F.array_union(a, b))
        raise Unsupported(f".{name}")

    def builtin(self, name, args):
        n = len(args)
        if name in ("float", "abs", "int") and n == 1:
            x = _number(args[0])
            return Value(NUMBER, x if name == "float" else F.abs(x) if name == "abs" else _whole(x))
        if name == "bool" and n == 1:
            return Value(FLAG, _truth(args[0]))
        if name == "str" and n == 1 and args[0].kind == TEXT:
            return args[0]
        if name == "len" and n == 1:
            x = args[0]
            if x.kind == TEXT:
                return Value(NUMBER, F.char_length(x.col).cast("double"))
            if x.kind.name == "map" or x.kind.name in ("list", "set") and x.kind.of is not None:
                return Value(NUMBER, _every([x.col], F.size(x.col)).cast("double"))
            if x.kind.name in ("list", "set"):
                return Value(NUMBER, F.lit(0.0))
        if name in ("min", "max"):
            if n > 1:
                cols = [_number(a) for a in args]
                return Value(NUMBER, _every(cols, (F.least if name == "min" else F.greatest)(*cols)))
            if n == 1 and args[0].kind.of == NUMBER:
                return Value(NUMBER, (F.array_min if name == "min" else F.array_max)(_array(args[0])))
        if name == "sum" and n == 1 and args[0].kind.of in (NUMBER, FLAG):
            return Value(NUMBER, F.aggregate(_array(args[0]), F.lit(0.0), lambda s, x: s + x.cast("double")))
        if name in ("list", "tuple", "set", "sorted"):
            if not n and name != "sorted":
                return Value(Kind("set" if name == "set" else "list"))
            if n == 1:
                of = self.items(args[0])
                return Value(Kind("set" if name == "set" else "list", of.kind.of), F.array_distinct(of.col) if name == "set" else F.array_sort(of.col) if name == "sorted" else of.col)
        if name == "range" and n == 1:
            x = _number(args[0])
            return Value(Kind("list", NUMBER), F.when(x <= 0, F.array().cast("array<double>")).when(x > 0, F.transform(F.sequence(F.lit(0), F.greatest(x, F.lit(1)).cast("int") - 1), lambda i: i.cast("double"))))
        raise Unsupported(name)

    # ---- statements

    def block(self, body: list[ast.stmt], env: dict[str, Value]) -> Value | None:
        """What a block returns; None if it ends without. ``env`` is changed as the block does."""
        for k, node in enumerate(body):
            if isinstance(node, ast.Return):
                if node.value is None:
                    raise Unsupported("a return of nothing")
                return self.read(node.value, env)
            if isinstance(node, ast.If):
                test = self.test(node.test, env)
                if _returns(node):
                    rest = body[k + 1 :]
                    yes, no = self.block([*node.body, *rest], dict(env)), self.block([*node.orelse, *rest], dict(env))
                    if yes is None or no is None:
                        raise Unsupported("an end without a return")
                    return _choose(test, yes, no)
                yes, no = dict(env), dict(env)
                self.block(node.body, yes), self.block(node.orelse, no)
                for name in {*yes, *no}:
                    if name in yes and name in no:
                        env[name] = yes[name] if yes[name] is no[name] else _choose(test, yes[name], no[name])
            else:
                self.statement(node, env)
        return None

    def statement(self, node: ast.stmt, env: dict[str, Value]) -> None:
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            got = self.read(node.value, env)
            env[node.targets[0].id] = got if got.kind != NUMBER and got.kind != TEXT else replace(got, fields=None)
        elif isinstance(node, ast.AugAssign) and isinstance(node.target, ast.Name):
            env[node.target.id] = self.read(ast.BinOp(ast.Name(node.target.id, ast.Load()), node.op, node.value), env)
        elif isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant):
            pass
        elif isinstance(node, ast.Expr) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Attribute) and isinstance(node.value.func.value, ast.Name) and node.value.func.attr in ("add", "append") and len(node.value.args) == 1:
            name, x = node.value.func.value.id, self.read(node.value.args[0], env)
            of = self.read(node.value.func.value, env)
            if of.kind.name != {"add": "set", "append": "list"}[node.value.func.attr] or of.kind.of not in (None, x.kind):
                raise Unsupported("an addition")
            kind = Kind(of.kind.name, x.kind)
            held = of.col if of.kind.of is not None else F.array().cast(sql(kind))
            env[name] = Value(kind, _every([held, x.col], (F.array_union if of.kind.name == "set" else F.concat)(held, F.array(x.col))))
        elif isinstance(node, ast.For) and isinstance(node.target, ast.Name) and not node.orelse:
            self.loop(node, env)
        else:
            raise Unsupported(type(node).__name__)

    def loop(self, node: ast.For, env: dict[str, Value]) -> None:
        """A fold whose state has the names that the body changes; those it makes are its own."""
        if any(isinstance(x, ast.Return | ast.Break | ast.Continue) for s in node.body for x in ast.walk(s)):
            raise Unsupported("a loop that is left")
        of = self.items(self.read(node.iter, env))
        # The body once on null: which names it changes, and of what kind they are after it.
        trial = env | {node.target.id: Value(of.kind.of, F.lit(None).cast(sql(of.kind.of)))}
        before = dict(trial)
        self.block(node.body, trial)
        changed = [n for n in env if n != node.target.id and trial[n] is not before[n]]
        kinds = {n: trial[n].kind for n in changed}
        for n in changed:
            if env[n].kind != kinds[n] and not (env[n].kind.name == kinds[n].name and env[n].kind.of is None):
                raise Unsupported("a loop that changes a kind")
        if not changed:
            return
        start = F.struct(*[(F.array().cast(sql(kinds[n])) if env[n].kind.of is None and env[n].kind.name in ("list", "set") else env[n].col).cast(sql(kinds[n])).alias(f"v{i}") for i, n in enumerate(changed)])

        def step(state: Column, x: Column) -> Column:
            inside = env | {n: Value(kinds[n], state[f"v{i}"]) for i, n in enumerate(changed)} | {node.target.id: Value(of.kind.of, x)}
            self.block(node.body, inside)
            return F.struct(*[inside[n].col.cast(sql(kinds[n])).alias(f"v{i}") for i, n in enumerate(changed)])

        end = F.aggregate(of.col, start, step)
        for i, n in enumerate(changed):
            env[n] = Value(kinds[n], end[f"v{i}"])


def _returns(node: ast.AST) -> bool:
    return any(isinstance(x, ast.Return) for x in ast.walk(node))


def _kind(name: str, of: ty.DataType) -> tuple[Kind, str | None] | None:
    """What user code sees of a profile's field, and the type to cast it to."""
    if isinstance(of, ty.NumericType):
        return NUMBER, "double"
    if isinstance(of, ty.StringType):
        return TEXT, None
    if isinstance(of, ty.BooleanType):
        return FLAG, None
    if isinstance(of, ty.ArrayType):
        inner = _kind(name[: -len("s")] if name.endswith("_sets") else "", of.elementType)
        return inner and (Kind("set" if name.endswith("_set") else "list", inner[0]), f"array<{sql(inner[0])}>")
    if isinstance(of, ty.MapType) and isinstance(of.keyType, ty.StringType):
        inner = _kind("", of.valueType)
        return inner and (Kind("map", inner[0]), f"map<string,{sql(inner[0])}>")
    return None


def _fields(struct: str, kind: ty.StructType) -> dict[str, Value]:
    out = {}
    for f in kind.fields:
        if known := _kind(f.name, f.dataType):
            col = F.col(struct)[f.name]
            out[f.name] = Value(known[0], col.cast(known[1]) if known[1] else col, given=F.col(struct).isNotNull())
    return out


def native(feature: generated.Feature, pairs: DataFrame) -> Column:
    """A feature of pairs (with profiles ``pa`` and ``pb``) as a column; raises ``Unsupported`` if it has no such form."""
    sides = {f"stats_{s}": _fields(f"p{s}", pairs.schema[f"p{s}"].dataType) for s in "ab"}
    vectors = {f"emb_{s}": sides[f"stats_{s}"]["embedding"] for s in "ab" if "embedding" in sides[f"stats_{s}"]}
    function = next(n for n in ast.walk(ast.parse(feature.code.strip())) if isinstance(n, ast.FunctionDef))
    found = Compiler(sides, vectors).block(function.body, {})
    if found is None or found.kind.name not in ("number", "flag"):
        raise Unsupported("no number is returned")
    x = found.col.cast("double")
    fine = x.isNotNull() & (F.abs(x) < float("inf"))
    kept = F.least(F.lit(feature.hint[1]), F.greatest(F.lit(feature.hint[0]), x)) if feature.hint else x
    return F.when(fine, kept).otherwise(feature.fallback).alias(feature.name)


def split(features: Iterable[generated.Feature], pairs: DataFrame) -> tuple[dict[str, Column], list[generated.Feature]]:
    """Features with a native form by their names, and the rest."""
    columns, rest = {}, []
    for f in features:
        try:
            columns[f.name] = native(f, pairs)
        except Unsupported:
            rest.append(f)
    return columns, rest


def compute(pairs: DataFrame, features: Iterable[generated.Feature], keys: list[str]) -> DataFrame:
    """All features of pairs: native columns, and Arrow batches for those that have no such form."""
    features = list(features)
    columns, rest = split(features, pairs)
    if not rest:
        return pairs.select(*keys, *columns.values())
    held = pairs.select(*keys, *columns.values(), "pa", "pb")
    return generated.compute(held, rest, [*keys, *columns]).select(*keys, *[f.name for f in features])
