"""User-written pair features: checked source that runs per row, in Arrow batches.

A feature is a document with the source of ``compute_feature(ctx)``. Its syntax
tree is checked against what is allowed, it runs with a few builtins only, and
whatever goes wrong gives the fallback value. ``ctx`` has both sides' profiles
(``stats_a``, ``stats_b``, with sets as sets) and ``helpers``.
"""

from __future__ import annotations

import ast
import hashlib
import json
import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import partial
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as ty

from .text import EXACT_EDIT

NAME = re.compile(r"^[a-z][a-z0-9_]{1,63}$")
#: Scopes of the tasks, and what a feature's code may use.
SCOPES = {"entity_matching": "row_pair", "joinable_table_search": "column_pair", "schema_matching": "column_pair", "union_table_search": "table_pair"}
BUILTINS = {f.__name__: f for f in (abs, min, max, range, float, int, len, sum, sorted, bool, list, set, tuple, str, enumerate)}
METHODS = {"add", "append", "get", "keys", "intersection", "union"}
SYNTAX = (
    ast.Add, ast.And, ast.Assign, ast.Attribute, ast.AugAssign, ast.BinOp, ast.BoolOp, ast.Break, ast.Call, ast.Compare, ast.Constant, ast.Continue,
    ast.Dict, ast.Div, ast.Eq, ast.Expr, ast.For, ast.FunctionDef, ast.Gt, ast.GtE, ast.If, ast.IfExp, ast.In, ast.Is, ast.IsNot, ast.List,
    ast.ListComp, ast.Load, ast.Lt, ast.LtE, ast.Mod, ast.Module, ast.Mult, ast.Name, ast.Not, ast.NotEq, ast.NotIn, ast.Or, ast.Pow, ast.Return,
    ast.Slice, ast.Store, ast.Sub, ast.Subscript, ast.Tuple, ast.UAdd, ast.USub, ast.UnaryOp, ast.arg, ast.arguments, ast.comprehension,
)


class FeatureError(ValueError):
    """A document that is not a valid feature."""


@dataclass(frozen=True)
class Feature:
    name: str
    task: str
    scope: str
    version: str
    description: str
    inputs: tuple[str, ...]
    code: str
    fallback: float
    hint: tuple[float, float] | None
    based_on: tuple[str, ...]
    digest: str = field(default="")


def check_code(code: str) -> None:
    """Raise unless the source is one plain function of ``ctx`` in allowed syntax."""
    try:
        tree = ast.parse(code.strip())
    except SyntaxError as e:
        raise FeatureError(f"not Python: {e.msg}") from e
    functions = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)]
    if len(functions) != 1 or functions[0].name != "compute_feature" or tree.body != functions:
        raise FeatureError("the code is one function, compute_feature")
    f = functions[0]
    a = f.args
    if [x.arg for x in a.args] != ["ctx"] or a.posonlyargs or a.kwonlyargs or a.vararg or a.kwarg or a.defaults or f.decorator_list:
        raise FeatureError("compute_feature takes ctx only and has no decorators")
    helpers = {"helpers"}
    for node in ast.walk(tree):
        if not isinstance(node, SYNTAX):
            raise FeatureError(f"not allowed: {type(node).__name__}")
        if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name) and _helper(node.value, helpers):
            helpers.add(node.targets[0].id)
    for node in ast.walk(tree):
        if isinstance(node, ast.Attribute) and node.attr not in METHODS:
            raise FeatureError(f"not allowed: .{node.attr}")
        if isinstance(node, ast.Name) and node.id.startswith("__"):
            raise FeatureError(f"not allowed: {node.id}")
        if isinstance(node, ast.Call):
            named = isinstance(node.func, ast.Name) and (node.func.id in BUILTINS or node.func.id in helpers)
            if node.keywords or not (named or isinstance(node.func, ast.Attribute) or _helper(node.func, helpers)):
                raise FeatureError("only builtins, helpers and plain methods are called, without keywords")


def _helper(node: ast.AST, helpers: set[str]) -> bool:
    """ctx["helpers"], a name for it, or something taken out of either."""
    if isinstance(node, ast.Name):
        return node.id in helpers
    if isinstance(node, ast.Subscript):
        key = node.slice
        own = isinstance(node.value, ast.Name) and node.value.id == "ctx" and isinstance(key, ast.Constant) and key.value == "helpers"
        return own or _helper(node.value, helpers)
    return False


def validate(doc: dict, task: str = "entity_matching") -> Feature:
    if not isinstance(doc, dict):
        raise FeatureError("a feature is an object")
    text = lambda k, d="": str(doc.get(k, d)).strip()
    name, scope, code = text("feature_name"), text("scope", SCOPES[task]), text("code")
    if not NAME.match(name):
        raise FeatureError(f"not a name: {name!r}")
    if text("task", task) != task or scope != SCOPES[task]:
        raise FeatureError(f"the task is {task} and its scope {SCOPES[task]}")
    if not code:
        raise FeatureError("code is missing")
    check_code(code)
    fallback, hint = float(doc.get("fallback_value", 0.0)), doc.get("range_hint")
    if not math.isfinite(fallback):
        raise FeatureError("the fallback is finite")
    if hint is not None and not (isinstance(hint, list | tuple) and len(hint) == 2 and float(hint[0]) < float(hint[1])):
        raise FeatureError("a range hint is [low, high]")
    names = lambda k: tuple(str(x) for x in doc.get(k) or [])
    return Feature(name, task, scope, text("version", "v1"), text("description"), names("inputs_used"), code, fallback, tuple(map(float, hint)) if hint else None, names("example_based_on"), hashlib.sha256(code.encode()).hexdigest())


def load(path: str | Path, task: str = "entity_matching") -> list[Feature]:
    """Features of a file or of all ``*.json`` in a folder; each holds one, a list, or ``{"features": […]}``."""
    path, out, seen = Path(path), [], set()
    for p in sorted(path.glob("*.json")) if path.is_dir() else [path]:
        doc = json.loads(p.read_text(encoding="utf-8"))
        doc = doc.get("features", doc) if isinstance(doc, dict) else doc
        for one in doc if isinstance(doc, list) else [doc]:
            f = validate(one, task)
            if f.name in seen:
                raise FeatureError(f"two features have the name {f.name}")
            seen.add(f.name)
            out.append(f)
    return out


def save(features: Iterable[Feature], path: str | Path) -> None:
    docs = [{"feature_name": f.name, "task": f.task, "scope": f.scope, "version": f.version, "description": f.description, "inputs_used": list(f.inputs), "code": f.code, "fallback_value": f.fallback, "range_hint": list(f.hint) if f.hint else None, "example_based_on": list(f.based_on)} for f in features]
    Path(path).write_text(json.dumps({"features": docs}, ensure_ascii=False, indent=2), encoding="utf-8")


def fingerprint(features: Iterable[Feature]) -> str:
    return hashlib.sha1("|".join(sorted(f"{f.name}:{f.digest}" for f in features)).encode()).hexdigest()[:16]


def examples(features: Iterable[Feature], wanted: Iterable[str]) -> list[Feature]:
    """Features based on any atom wanted; all if none is named."""
    wanted = set(wanted)
    return [f for f in features if not wanted or wanted & set(f.based_on)]


def _safe_ratio(a: float, b: float) -> float:
    return min(a, b) / max(a, b) if a > 0 and b > 0 else 0.0


def _jaccard(a: Iterable, b: Iterable) -> float:
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def _weighted(a: Iterable, b: Iterable, weights: dict | None = None) -> float:
    a, b, w = set(a), set(b), weights or {}
    total = sum(w.get(t, 1.0) for t in a | b)
    return sum(w.get(t, 1.0) for t in a & b) / total if a and b and total > 0 else 0.0


def _grams(text: str, n: int = 3) -> set[str]:
    return {text[i : i + n] for i in range(max(len(text) - n + 1, 1))}


def _edit(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    size = max(len(a), len(b))
    if size > EXACT_EDIT:
        return _jaccard(_grams(a), _grams(b))
    codes, at = np.array([ord(c) for c in b]), np.arange(len(b) + 1)
    costs = at.copy()
    for c in a:  # a whole row at once: insertions are a running minimum of costs less their place
        costs = np.append(costs[0] + 1, np.minimum(costs[1:] + 1, costs[:-1] + (codes != ord(c))))
        costs = np.minimum.accumulate(costs - at) + at
    return 1.0 - int(costs[-1]) / size


def _text_grams(a: str, b: str, n: int) -> float:
    """Jaccard of the n-grams of trimmed lower-cased texts; a short text is its own."""
    one, two = ({t} if 0 < len(t) <= n else _grams(t, n) if t else set() for t in (str(x or "").strip(" ").lower() for x in (a, b)))
    return _jaccard(one, two)


def _cosine(a: Iterable[float], b: Iterable[float]) -> float:
    if a is None or b is None:
        raise TypeError("no vector")
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    size = float(np.linalg.norm(a)) * float(np.linalg.norm(b))
    return float(a @ b) / size if size > 0 else 0.0


def _overlap(a: Iterable, b: Iterable) -> float:
    a, b = set(a), set(b)
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


HELPERS: dict[str, Callable] = {"safe_ratio_float": _safe_ratio, "safe_ratio_int": _safe_ratio, "set_jaccard": _jaccard, "token_jaccard": _jaccard, "weighted_jaccard": _weighted, "normalized_edit_similarity": _edit, "numeric_overlap_max": _overlap, "char_ngram_jaccard": _text_grams, "cosine_similarity": _cosine, "clip01": lambda x: min(1.0, max(0.0, float(x)))}


class Registry:
    """Compiled features. What isn't a finite number, or raises, gives the fallback; the rest is kept in range."""

    def __init__(self, features: Iterable[Feature]):
        self.features = list(features)
        self.compiled: dict[str, Callable] = {}

    def __getstate__(self) -> dict:
        return {"features": self.features, "compiled": {}}

    def compute(self, ctx: dict[str, Any]) -> dict[str, float]:
        out = {}
        for f in self.features:
            if f.name not in self.compiled:
                scope: dict[str, Any] = {"__builtins__": dict(BUILTINS)}
                exec(compile(f.code, f.name, "exec"), scope)
                self.compiled[f.name] = scope["compute_feature"]
            try:
                value = float(self.compiled[f.name](ctx))
                if not math.isfinite(value):
                    raise ValueError("not finite")
                out[f.name] = min(f.hint[1], max(f.hint[0], value)) if f.hint else value
            except Exception:  # user code: whatever it raises, the row gets the fallback
                out[f.name] = f.fallback
        return out


def _side(stats: dict | None) -> dict:
    """A profile as user code sees it: sets as sets, lists of lists as lists of sets, maps as dicts."""
    def one(k: str, v: Any) -> Any:
        if isinstance(v, list) and k.endswith("_sets"):
            return [set(x) for x in v]
        if isinstance(v, list) and k.endswith("_set"):
            return set(v)
        return dict(v) if k == "header_to_value" and v is not None else v

    return {k: one(k, v) for k, v in (stats or {}).items()}


def _run(batches, registry: Registry, keys: list[str], schema: pa.Schema):
    for batch in batches:
        rows = [registry.compute({"stats_a": _side(a), "stats_b": _side(b), "emb_a": (a or {}).get("embedding"), "emb_b": (b or {}).get("embedding"), "helpers": HELPERS}) for a, b in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(schema.field(k).type) for k in keys), *(pa.array([r[f.name] for r in rows], pa.float64()) for f in registry.features)], schema=schema)


def compute(pairs: DataFrame, features: Iterable[Feature], keys: list[str]) -> DataFrame:
    """The features of pairs that have both profiles as structs ``pa`` and ``pb``."""
    registry = Registry(features)
    out = ty.StructType([*(pairs.schema[k] for k in keys), *(ty.StructField(f.name, ty.DoubleType()) for f in registry.features)])
    from pyspark.sql.pandas.types import to_arrow_schema

    return pairs.select(*keys, "pa", "pb").mapInArrow(partial(_run, registry=registry, keys=keys, schema=to_arrow_schema(out)), out)


#: name: (helper, field of both profiles, atom it resembles); the features made without a model.
MADE = {
    "entity_matching": {"value_overlap": ("set_jaccard", "value_set", "row_value_jaccard"), "field_balance": ("safe_ratio_float", "nonempty_count", "row_nonempty_ratio"), "serial_overlap": ("token_jaccard", "serial_token_set", "row_serial_token_jaccard"), "serial_edit": ("normalized_edit_similarity", "serial_text", "row_serial_edit_similarity"), "number_overlap": ("numeric_overlap_max", "numeric_value_set", "row_numeric_value_overlap"), "cross_overlap": ("token_jaccard", "header_value_token_set", "row_header_token_jaccard")},
    "joinable_table_search": {"unique_balance": ("safe_ratio_float", "unique_ratio", "unique_ratio_sim"), "length_balance": ("safe_ratio_float", "avg_len", "avg_len_ratio_sim"), "header_overlap": ("token_jaccard", "header_tokens", "header_token_jaccard")},
    "schema_matching": {"header_overlap": ("token_jaccard", "header_tokens", "header_token_jaccard"), "header_edit": ("normalized_edit_similarity", "header_text", "header_edit_similarity"), "number_balance": ("safe_ratio_float", "numeric_ratio", "numeric_ratio_sim")},
    "union_table_search": {"header_overlap": ("token_jaccard", "header_tokens", "header_jaccard"), "width_balance": ("safe_ratio_float", "n_cols", "col_count_ratio"), "height_balance": ("safe_ratio_float", "n_rows", "row_count_ratio")},
}


def dry_run(task: str, n: int | None = None) -> list[Feature]:
    """``n`` valid features made without a model, by default one of each kind; beyond that they come again under new names."""
    kinds, out = list(MADE[task].items()), []
    for i in range(len(kinds) if n is None else n):
        name, (helper, key, atom) = kinds[i % len(kinds)]
        code = f"def compute_feature(ctx):\n    helper = ctx['helpers']['{helper}']\n    return helper(ctx['stats_a']['{key}'], ctx['stats_b']['{key}'])\n"
        again = f"_{i // len(kinds) + 1}" if i >= len(kinds) else ""
        out.append(validate({"feature_name": name + again, "task": task, "code": code, "inputs_used": [key], "range_hint": [0.0, 1.0], "example_based_on": [atom]}, task))
    return out


def generate(ask: Callable[[str], str], task: str, tries: int = 3) -> Feature:
    """A feature from text that ``ask`` answers with; what was wrong with the last answer is passed on."""
    wrong = ""
    for _ in range(tries):
        text = re.sub(r"(?m)^\s*```.*$", "", ask(wrong))
        try:
            return validate(json.loads(text[text.index("{") : text.rindex("}") + 1]), task)
        except (ValueError, KeyError) as e:
            wrong = str(e)
    raise FeatureError(f"no valid feature in {tries} tries: {wrong}")
