"""Rules that raise or lower a score, compiled to one Column.

A policy is a document of rules, each a list of conditions on evidence and a
delta. How many conditions must hold, which ones always must, and where a rule
may act, are options; the whole policy becomes a single expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, replace

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..operators.atoms import evidence
from ..operators.evaluate import quantiles

OPERATORS = (">", ">=", "<", "<=", "between", "in_top_band")


class PolicyError(ValueError):
    """A document that is not a valid policy."""


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str
    value: float | tuple[float, float]


@dataclass(frozen=True)
class Rule:
    id: str
    conditions: tuple[Condition, ...]
    delta: float
    intent: str = ""


@dataclass(frozen=True)
class Policy:
    task: str
    features: tuple[str, ...]
    rules: tuple[Rule, ...]


@dataclass(frozen=True)
class Options:
    """``match``: strict, partial or guarded_partial; ``combine``: sum or hard_override."""

    match: str = "strict"
    ratio: float = 1.0
    ratio_positive: float | None = None
    ratio_negative: float | None = None
    guards: tuple[str, ...] = ()
    positive_boundary_only: bool = False
    positive_margin: float = 1.0
    negative_margin: float = 1.0
    scale_by_match: bool = False
    combine: str = "sum"
    override_eps: float = 1e-3
    relax: float = 0.0
    shift_prior: bool = False


def _condition(rule: str, raw, named: bool, allowed: set[str]) -> Condition:
    if named and isinstance(raw, dict):
        feature, op, value = str(raw.get("feature", "")), str(raw.get("operator", "")), raw.get("value")
    elif not named and isinstance(raw, list) and len(raw) == 3:
        feature, op, value = str(raw[0]), str(raw[1]), raw[2]
    else:
        raise PolicyError(f"{rule}: a condition is [feature, operator, value]")
    if feature not in allowed or op not in OPERATORS:
        raise PolicyError(f"{rule}: unknown feature or operator: {feature} {op}")
    if op == "between":
        if not isinstance(value, list) or len(value) != 2:
            raise PolicyError(f"{rule}: between takes [low, high]")
        return Condition(feature, op, (float(value[0]), float(value[1])))
    value = float(value)
    if op == "in_top_band" and not 0 < value <= 1:
        raise PolicyError(f"{rule}: a band is above 0 and at most 1")
    return Condition(feature, op, value)


def validate(doc: dict, task: str, allowed: Iterable[str]) -> Policy:
    """A policy from its document; keys that aren't known are left out."""
    if not isinstance(doc, dict):
        raise PolicyError("a policy is an object")
    allowed = set(map(str, allowed))
    if str(doc.get("task", "")).strip() != task or int(doc.get("version", 1)) != 1:
        raise PolicyError(f"a policy of version 1 for {task} is expected")
    selected, rules = doc.get("selected_features") or [], doc.get("rules", [])
    if not isinstance(selected, list) or not isinstance(rules, list):
        raise PolicyError("selected_features and rules are lists")
    if unknown := [f for f in map(str, selected) if f not in allowed]:
        raise PolicyError(f"unknown features: {unknown}")
    out = []
    for i, raw in enumerate(rules):
        if not isinstance(raw, dict):
            raise PolicyError(f"rule {i} is an object")
        name, named = str(raw.get("id", f"rule_{i}")), raw.get("if") is None
        conditions = raw.get("conditions" if named else "if", [])
        if not isinstance(conditions, list) or not conditions:
            raise PolicyError(f"{name} has no conditions")
        then = raw.get("then", raw)
        if not isinstance(then, dict) or "delta" not in then:
            raise PolicyError(f"{name} has no delta")
        out.append(Rule(name, tuple(_condition(name, c, named, allowed) for c in conditions), float(then["delta"]), str(raw.get("intent", "")).strip()))
    return Policy(task, tuple(map(str, selected)), tuple(out))


def relaxed(policy: Policy, by: float) -> Policy:
    """Every bound moved outwards."""
    def one(c: Condition) -> Condition:
        match c.op:
            case ">" | ">=":
                return replace(c, value=c.value - by)
            case "<" | "<=":
                return replace(c, value=c.value + by)
            case "between":
                return replace(c, value=(c.value[0] - by, c.value[1] + by))
        return replace(c, value=min(1.0, c.value + by))

    return policy if abs(by) < 1e-12 else replace(policy, rules=tuple(replace(r, conditions=tuple(map(one, r.conditions))) for r in policy.rules))


def shifted(policy: Policy, threshold: float, feature: str = "s_prior") -> Policy:
    """Bounds on the score itself moved along with its threshold, kept within 0 to 1."""
    move = lambda v: max(0.0, min(1.0, v + threshold - 0.5))

    def one(c: Condition) -> Condition:
        if c.feature != feature or c.op == "in_top_band":
            return c
        return replace(c, value=tuple(sorted(map(move, c.value))) if c.op == "between" else move(c.value))

    return replace(policy, rules=tuple(replace(r, conditions=tuple(map(one, r.conditions))) for r in policy.rules))


def required(n: int, ratio: float) -> int:
    return max(1, min(math.ceil(max(0.0, min(1.0, ratio)) * n), n))


def _holds(c: Condition, cutoffs: dict[tuple[str, float], float | None]) -> Column:
    x = F.col(c.feature)
    match c.op:
        case ">":
            held = x > c.value
        case ">=":
            held = x >= c.value
        case "<":
            held = x < c.value
        case "<=":
            held = x <= c.value
        case "between":
            held = (x >= c.value[0]) & (x <= c.value[1])
        case _:
            cut = cutoffs[(c.feature, c.value)]
            held = F.lit(False) if cut is None else x >= cut
    return F.coalesce(held, F.lit(False))


def _fires(rule: Rule, o: Options, held: list[Column], threshold: float) -> tuple[Column, Column]:
    total = sum((h.cast("int") for h in held), F.lit(0))
    ratio = o.ratio_positive if rule.delta >= 0 else o.ratio_negative
    need = required(len(held), o.ratio if ratio is None else ratio)
    guards = [i for i, c in enumerate(rule.conditions) if any(c.feature.startswith(g) for g in o.guards if g and g != "none")]
    if o.match == "strict":
        mask = total >= len(held)
    elif o.match == "partial" or o.match == "guarded_partial" and not guards:
        mask = total >= need
    elif o.match == "guarded_partial":
        soft = sum((h.cast("int") for i, h in enumerate(held) if i not in guards), F.lit(0))
        mask = soft >= max(0, need - len(guards)) if len(guards) < len(held) else F.lit(True)
        for i in guards:
            mask = mask & held[i]
    else:
        raise ValueError(f"unknown way to match: {o.match}")
    near = F.abs(F.col("s_prior") - threshold)
    if rule.delta >= 0 and o.positive_boundary_only and o.positive_margin < 1:
        mask = mask & (near <= o.positive_margin)
    elif rule.delta < 0 and o.negative_margin < 1:
        mask = mask & (near <= o.negative_margin)
    return mask, total


def delta_column(policy: Policy, options: Options = Options(), threshold: float = 0.5, cutoffs: dict[tuple[str, float], float | None] | None = None) -> Column:
    """What the policy adds to ``s_prior`` in each row."""
    policy = relaxed(policy, options.relax)
    if options.shift_prior and abs(threshold - 0.5) >= 1e-12:
        policy = shifted(policy, threshold)
    out = F.col("s_prior") if options.combine == "hard_override" else F.lit(0.0)
    for rule in policy.rules:
        mask, total = _fires(rule, options, [_holds(c, cutoffs or {}) for c in rule.conditions], threshold)
        if options.combine == "hard_override":
            aim = min(1.0, threshold + options.override_eps) if rule.delta >= 0 else max(0.0, threshold - options.override_eps)
            out = F.when(mask, aim).otherwise(out)
        else:
            step = rule.delta * total / len(rule.conditions) if options.scale_by_match else F.lit(rule.delta)
            out = out + F.when(mask, step).otherwise(0.0)
    return out - F.col("s_prior") if options.combine == "hard_override" and policy.rules else out


def replay(stored: DataFrame, policy: Policy, options: Options = Options(), threshold: float = 0.5, name: str = "delta") -> DataFrame:
    """Deltas worked out anew from an archive's scores, degrees and atoms: evidence that was derived from them is derived again."""
    derived = ("uncertainty", "degree_ratio")
    return apply(evidence(stored.drop(*derived)), policy, options, threshold, name)


def apply(rows: DataFrame, policy: Policy, options: Options = Options(), threshold: float = 0.5, name: str = "delta") -> DataFrame:
    """Adds the delta; bands are over all rows, their cut-offs found by rank."""
    bands = sorted({(c.feature, c.value) for r in relaxed(policy, options.relax).rules for c in r.conditions if c.op == "in_top_band"})
    cutoffs = {}
    if bands:
        for f in sorted({f for f, _ in bands}):
            own = {v: max(0.0, 1 - v) for g, v in bands if g == f}
            got = {r["share"]: r["quantile"] for r in quantiles(rows, f, sorted(set(own.values()))).collect()}  # a row for each cut-off
            cutoffs |= {(f, v): got.get(share) for v, share in own.items()}
    return rows.withColumn(name, delta_column(policy, options, threshold, cutoffs))
