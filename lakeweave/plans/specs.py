"""Documents that describe a feature as one expression (v1) or weighted channels (v2)."""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .expression import LOGIT, ExpressionError, parse

#: Most channels, decisions, and names that a postprocess goes by.
MOST_CHANNELS = 32
DECISIONS = (">=", ">", "<=", "<")
POSTPROCESS = {"sigmoid": {"sigmoid", "logistic"}, "clip01": {"clip01", "clip", "clip_01", "clip0to1", "clip_0_1", "clamp01", "clamp"}}


class SpecError(ValueError):
    """A document that is not a valid spec."""


@dataclass(frozen=True)
class Channel:
    name: str
    role: str
    expression: str
    hint: tuple[float, float] | None
    rationale: str
    features: tuple[str, ...]


@dataclass(frozen=True)
class Spec:
    version: str
    task: str
    pool: tuple[str, ...]
    channels: tuple[Channel, ...]
    weights: tuple[float, ...]
    bias: float
    postprocess: str
    output_name: str
    hint: tuple[float, float] | None
    threshold: float
    positive_if: str
    notes: str
    digest: str

    @property
    def spec_id(self) -> str:
        return f"{self.task}:{self.digest[:12]}"

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(f for c in self.channels for f in c.features))


def _text(doc: dict, key: str, default: str = "") -> str:
    return str(doc.get(key, default)).strip()


def _hint(raw: Any) -> tuple[float, float] | None:
    if raw is None:
        return None
    if not isinstance(raw, list | tuple) or len(raw) != 2 or not float(raw[0]) < float(raw[1]):
        raise SpecError("a range hint is [low, high]")
    return float(raw[0]), float(raw[1])


def _decision(raw: Any) -> tuple[float, str]:
    raw = {} if raw is None else raw
    if not isinstance(raw, dict):
        raise SpecError("decision is an object")
    threshold, op = float(raw.get("threshold", 0.5)), _text(raw, "positive_if", ">=") or ">="
    if not 0 <= threshold <= 1 or op not in DECISIONS:
        raise SpecError("a decision has a threshold from 0 to 1 and one of " + " ".join(DECISIONS))
    return threshold, op


def postprocess(raw: Any) -> str:
    token = str(raw if raw is not None else "none").strip().lower()
    return next((k for k, names in POSTPROCESS.items() if token in names), "none")


def _program(expression: str, allowed: Iterable[str]):
    try:
        return parse(expression, allowed)
    except ExpressionError as e:
        raise SpecError(str(e)) from e


def _channels(doc: dict, allowed: list[str]) -> tuple[Channel, ...]:
    raw = doc.get("channels")
    if not isinstance(raw, list) or not 1 <= len(raw) <= MOST_CHANNELS:
        raise SpecError(f"channels is a list of 1 to {MOST_CHANNELS}")
    same_features = os.environ.get("SYMBOLIC_ALLOW_DUP_SIGNATURE", "").strip().lower() in ("1", "true", "yes", "on")
    out, seen = [], set()

    def once(kind: str, value: Any) -> None:
        if (kind, value) in seen:
            raise SpecError(f"two channels have the same {kind}: {value}")
        seen.add((kind, value))

    for i, one in enumerate(raw):
        if not isinstance(one, dict):
            raise SpecError(f"channel {i} is an object")
        name, role, expression = _text(one, "name") or f"ch_{i + 1}", _text(one, "role"), _text(one, "expression")
        if not role or not expression:
            raise SpecError(f"channel {i} needs a role and an expression")
        features = tuple(sorted(_program(expression, allowed).features))
        if not features:
            raise SpecError(f"channel {i} reads no feature")
        once("name", name), once("role", role.lower()), once("expression", "".join(expression.split()))
        if not same_features:
            once("features", features)
        out.append(Channel(name, role, expression, _hint(one.get("output_range_hint")), _text(one, "rationale"), features))
    return tuple(out)


def _aggregation(raw: Any, n: int) -> tuple[tuple[float, ...], float, str]:
    raw = {} if raw is None else raw
    if not isinstance(raw, dict):
        raise SpecError("aggregation is an object")
    if (_text(raw, "method", "weighted_sum").lower() or "weighted_sum") != "weighted_sum":
        raise SpecError("the aggregation method is weighted_sum")
    given = raw.get("weights")
    if given is not None and not isinstance(given, list):
        raise SpecError("weights is a list")
    weights = [1 / n] * n if given is None or len(given) not in (1, n) else [float(w) for w in given] * (n if len(given) == 1 < n else 1)
    bias = float(raw.get("bias", 0.0))
    if not all(map(math.isfinite, (*weights, bias))):
        raise SpecError("weights and bias are finite")
    return tuple(weights), bias, postprocess(raw.get("postprocess", "none"))


def validate(doc: dict, allowed: Iterable[str], task: str | None = None) -> Spec:
    """A spec from its document, or a SpecError."""
    if not isinstance(doc, dict):
        raise SpecError("a spec is an object")
    allowed, version, own_task = list(allowed), _text(doc, "spec_version", "v1") or "v1", _text(doc, "task")
    if version not in ("v1", "v2"):
        raise SpecError(f"unknown version: {version}")
    if not own_task or task and own_task != task:
        raise SpecError(f"the task is {task or 'missing'}, not {own_task!r}")
    pool, (threshold, op), hint = [str(x) for x in doc.get("feature_pool_used") or []], _decision(doc.get("decision")), _hint(doc.get("output_range_hint"))
    output_name, notes = _text(doc, "output_name"), _text(doc, "notes")
    if version == "v1":
        expression = _text(doc, "expression")
        if not expression:
            raise SpecError("expression is missing")
        features = _program(expression, allowed).features
        if len(features) < 2:
            raise SpecError("an expression reads two features at least")
        channels, weights, bias, post = (Channel(output_name or "score", "score", expression, None, "", tuple(features)),), (1.0,), 0.0, "none"
    else:
        channels = _channels(doc, allowed)
        weights, bias, post = _aggregation(doc.get("aggregation", {}), len(channels))
    used = sorted({f for c in channels for f in c.features})
    pool = sorted(pool) or used
    if missing := set(used) - set(pool):
        raise SpecError("not declared: " + ", ".join(sorted(missing)))
    if unknown := set(pool) - set(allowed):
        raise SpecError("unknown features: " + ", ".join(sorted(unknown)))
    canonical: dict[str, Any] = {"spec_version": version, "task": own_task, "feature_pool_used": pool, "output_name": output_name, "output_range_hint": list(hint) if hint else None, "decision": {"threshold": threshold, "positive_if": op}, "notes": notes}
    if version == "v1":
        canonical["expression"] = channels[0].expression
    else:
        canonical["channels"] = [{"name": c.name, "role": c.role, "expression": c.expression, "output_range_hint": list(c.hint) if c.hint else None, "rationale": c.rationale} for c in channels]
        canonical["aggregation"] = {"method": "weighted_sum", "weights": list(weights), "bias": bias, "postprocess": post}
    digest = hashlib.sha256(json.dumps(canonical, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return Spec(version, own_task, tuple(pool), channels, weights, bias, post, output_name, hint, threshold, op, notes, digest)


def load(path: str | Path, allowed: Iterable[str], task: str | None = None) -> Spec:
    return validate(json.loads(Path(path).read_text(encoding="utf-8")), allowed, task)


def channel_columns(spec: Spec, allowed: Iterable[str], features: dict[str, Column] | None = None) -> list[Column]:
    allowed = list(allowed)
    return [parse(c.expression, allowed).column(features, c.hint).alias(c.name) for c in spec.channels]


def score_column(spec: Spec, allowed: Iterable[str], features: dict[str, Column] | None = None) -> Column:
    """The weighted sum of all channels, postprocessed, finite and within the spec's range."""
    total = F.lit(spec.bias)
    for weight, channel in zip(spec.weights, channel_columns(spec, allowed, features), strict=True):
        total = total + weight * channel
    if spec.postprocess == "sigmoid":
        total = 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-LOGIT)), F.lit(LOGIT))))
    elif spec.postprocess == "clip01":
        total = F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))
    return F.least(F.greatest(total, F.lit(spec.hint[0])), F.lit(spec.hint[1])) if spec.hint else total


def representation(rows: DataFrame, spec: Spec, kind: str = "auto", repeat: int = 1, train: Column | None = None, name: str = "channels") -> DataFrame:
    """Adds an array of what a decoder reads of a spec: its channels (``concat``) or their score (``aggregation``), one after another, ``repeat`` times over.

    ``auto`` takes the channels of a spec of version 2, else the score. Features of the
    spec that ``rows`` has no column for, and nulls, count as 0. With ``train`` every number is less its mean over
    those rows, over its deviation there.
    """
    from ..operators.evaluate import standardise

    kind = ("concat" if spec.version == "v2" else "aggregation") if kind == "auto" else kind
    if kind not in ("concat", "aggregation"):
        raise ValueError(f"unknown kind: {kind}")
    features = {f: F.coalesce(F.col(f), F.lit(0.0)) if f in rows.columns else F.lit(0.0) for f in spec.features}
    made = channel_columns(spec, features, features) if kind == "concat" else [score_column(spec, features, features)]
    names = [f"__channel_{i}" for i in range(len(made))]
    out = rows.withColumns(dict(zip(names, made, strict=True)))
    out = out if train is None else standardise(out, names, train)
    return out.withColumn(name, F.flatten(F.array_repeat(F.array(*names), max(1, repeat)))).drop(*names)


def decision_column(spec: Spec, score: Column) -> Column:
    from ..operators.evaluate import decide

    return decide(score, spec.threshold, spec.positive_if)


def audit(spec: Spec, exact: int | None = None, least: int | None = None, passthrough: tuple[float, float] = (0.0, 1.0), repeated: int = 3) -> list[str]:
    """What is odd about a spec: its number of channels, bare features, features in many channels."""
    n, bare = len(spec.channels), sum(c.expression.strip() in c.features for c in spec.channels)
    found = [f"{n} channels, not {exact}"] * (exact is not None and n != exact) + [f"{n} channels, fewer than {least}"] * (least is not None and n < least)
    if not passthrough[0] <= bare / n <= passthrough[1]:
        found.append(f"{bare} of {n} channels are bare features")
    counts: dict[str, int] = {}
    for c in spec.channels:
        for f in c.features:
            counts[f] = counts.get(f, 0) + 1
    return found + [f"{f} is in {k} channels" for f, k in sorted(counts.items()) if k >= repeated]


def dry_run(task: str, features: list[str], channels: int) -> dict:
    """A valid v2 document made without a model: feature pairs at growing distance, each set of features once."""
    n, made, seen = len(features), [], set()
    for shift in range(n):
        for i, a in enumerate(features):
            b = features[(i + shift) % n]
            key = frozenset((a, b))
            if key not in seen and len(made) < channels:
                seen.add(key)
                made.append({"name": f"ch_{len(made) + 1}", "role": f"role_{len(made) + 1:02d}", "expression": a if a == b else f"avg({a}, {b})"})
    return {"spec_version": "v2", "task": task, "feature_pool_used": sorted({f for k in seen for f in k}), "channels": made, "aggregation": {"method": "weighted_sum", "postprocess": "clip01"}, "output_name": f"sym_{task}", "decision": {"threshold": 0.5, "positive_if": ">="}}


def distinct_features(doc: dict, allowed: list[str]) -> dict:
    """The document with a term of weight 0 added where two channels read the same features."""
    seen, out = set(), []
    for c in doc["channels"]:
        features = set(parse(c["expression"], allowed).features)
        for extra in allowed:
            if frozenset(features) not in seen:
                break
            if extra not in features:
                c, features = c | {"expression": f"({c['expression']}) + (0.0 * {extra})"}, features | {extra}
        seen.add(frozenset(features))
        out.append(c)
    return doc | {"channels": out, "feature_pool_used": sorted(set(doc.get("feature_pool_used") or []) | {f for s in seen for f in s})}


def with_retries(make, allowed: Iterable[str], task: str, tries: int = 3) -> Spec:
    """Ask ``make(violation)`` for a document until it is valid; what was wrong is passed on."""
    violation, allowed = "", list(allowed)
    for _ in range(tries):
        try:
            return validate(make(violation), allowed, task)
        except (SpecError, ValueError) as e:
            violation = str(e)
    raise SpecError(f"no valid spec in {tries} tries: {violation}")


def report(paths: Iterable[str | Path], allowed: Iterable[str]) -> list[dict]:
    """(path, ok, spec_id or what is wrong) of each file."""
    out, allowed = [], list(allowed)
    for p in sorted(map(str, paths)):
        try:
            out.append({"path": p, "ok": True, "detail": load(p, allowed).spec_id})
        except (ValueError, OSError) as e:
            out.append({"path": p, "ok": False, "detail": str(e)})
    return out
