import math

import numpy as np
import pyspark.sql.functions as F
import pytest

from lakeweave.functions import generated
from lakeweave.plans import catalog, policy, specs
from lakeweave.plans.expression import ExpressionError, parse

NAMES = ["f1", "f2", "f3"]
ROWS = [(0.2, 0.4, 0.7), (0.6, 0.5, 0.3), (0.9, 0.2, 0.8), (float("nan"), 0.0, -1.0), (float("inf"), -2.0, 0.0)]


def run(spark, source, hint=None):
    df = spark.createDataFrame(ROWS, "f1 double, f2 double, f3 double")
    return [r["x"] for r in df.select(parse(source, NAMES).column(hint=hint).alias("x")).collect()]


def tidy(values):
    return [0.0 if math.isnan(v) else 1e6 if v == math.inf else -1e6 if v == -math.inf else v for v in map(float, values)]


@pytest.mark.parametrize(
    ("source", "f"),
    [
        ("f1 + f2 * f3", lambda a, b, c: a + b * c),
        ("min(f1, f2)", lambda a, b, c: np.minimum(a, b)),
        ("max(f1, f2, f3)", lambda a, b, c: np.maximum(np.maximum(a, b), c)),
        ("f1 > f2", lambda a, b, c: float(a > b)),
        ("f1 != f1", lambda a, b, c: float(a != a)),
        ("f1 < 0.5 or f3 < 0", lambda a, b, c: float(a < 0.5 or c < 0)),
        ("f2 if f1 > 0.5 else f3", lambda a, b, c: b if a > 0.5 else c),
        ("f3 % f2", lambda a, b, c: np.mod(c, b) if b else math.nan),
        ("f1 / f3", lambda a, b, c: a / (c if abs(c) >= 1e-6 else 1e-6 if c >= 0 else -1e-6)),
        ("safe_div(f1, f2, 0.5)", lambda a, b, c: a / (b if abs(b) >= 0.5 else 0.5 if b >= 0 else -0.5)),
        ("sigmoid(f2)", lambda a, b, c: 1 / (1 + math.exp(-b))),
        ("log(f2) + sqrt(f3) + log1p(f3)", lambda a, b, c: math.log(max(b, 1e-12)) + math.sqrt(max(c, 0)) + math.log1p(max(c, -0.999999))),
        ("where(f3, f2, pi)", lambda a, b, c: b if c > 0 else math.pi),
        ("-f2 ** 2", lambda a, b, c: -(b**2)),
        ("clip(f1, 0, 1)", lambda a, b, c: min(max(a, 0), 1) if a == a else math.nan),
    ],
)
def test_expression_has_numpy_semantics(spark, source, f):
    with np.errstate(all="ignore"):
        assert run(spark, source) == pytest.approx(tidy([f(*r) for r in ROWS]))


@pytest.mark.parametrize("source", ["f9 + 1", "open(f1)", "f1.real", "not f1", "[f1]", "min(f1)", "clip(f1, 0)", "f1 +", "'a'", "abs(x=f1)"])
def test_expression_rejects(source):
    with pytest.raises(ExpressionError):
        parse(source, NAMES)


def test_chained_comparison_gives_the_fallback(spark):
    assert run(spark, "0 < f1 < 1") == [0.0] * len(ROWS)


def v2(*channels, **more):
    return {"spec_version": "v2", "task": "entity_matching", "channels": [{"role": f"r{i}", "expression": e} for i, e in enumerate(channels)]} | more


@pytest.mark.parametrize(
    "doc",
    [
        {"task": "t", "expression": "f1 + f2", "decision": {"threshold": 1.2}},
        {"task": "t", "expression": "f1 * 2"},
        {"task": "t", "expression": "f1 + f2", "feature_pool_used": ["f1"]},
        v2("f1 + f2", "f2 - f1"),
        v2("f1 + f2", " f1+f2 "),
        v2(),
        v2(*["f1"] * 33),
        v2("f1", aggregation={"method": "median"}),
        v2("f1", aggregation={"bias": float("inf")}),
        v2("f1") | {"channels": [{"role": "A", "expression": "f1"}, {"role": "a", "expression": "f2"}]},
        v2("f1", output_range_hint=[1, 0]),
        v2("1 + 2"),
        {"task": "t", "spec_version": "v3", "expression": "f1 + f2"},
    ],
)
def test_bad_specs(doc):
    with pytest.raises(specs.SpecError):
        specs.validate(doc, NAMES)


def test_spec_identity_and_weights():
    spec = specs.validate(v2("f1", "f2", aggregation={"weights": [2.0], "postprocess": "odd"}), NAMES)
    assert spec.weights == (2.0, 2.0) and spec.postprocess == "none" and spec.pool == ("f1", "f2")
    assert specs.validate(v2("f1", "f2", aggregation={"weights": [1.0, 2.0, 3.0]}), NAMES).weights == (0.5, 0.5)
    assert spec.spec_id == f"entity_matching:{spec.digest[:12]}"
    assert spec.digest == specs.validate(v2("f1", "f2", aggregation={"weights": [2.0], "postprocess": "odd"}), NAMES).digest


def test_channels_are_finite(spark):
    spec = specs.validate(v2("f1 / f2", "exp(f1) * f3", aggregation={"postprocess": "sigmoid"}), NAMES)
    df = spark.createDataFrame(ROWS, "f1 double, f2 double, f3 double")
    rows = df.select(*specs.channel_columns(spec, NAMES), specs.score_column(spec, NAMES).alias("s")).collect()
    assert all(math.isfinite(v) for r in rows for v in r) and all(0 <= r["s"] <= 1 for r in rows)


def test_made_and_repaired_specs():
    made = specs.dry_run("entity_matching", NAMES, 5)
    assert len(specs.validate(made, NAMES).channels) == 5
    twice = v2("f1 + f2", "f1 * f2")
    assert len(specs.validate(specs.distinct_features(twice, NAMES), NAMES).channels) == 2
    docs = iter([{}, twice, v2("f1", "f2")])
    assert specs.with_retries(lambda _: next(docs), NAMES, "entity_matching").features == ("f1", "f2")
    assert specs.audit(specs.validate(v2("f1", "f1 + f2", "f1 + f3"), NAMES), exact=2, passthrough=(0.0, 0.1))


EV = ["s_prior", "uncertainty", "src_degree", "dst_degree", "degree_ratio"]


def doc(*rules, **more):
    return {"task": "t", "version": 1, "rules": list(rules)} | more


@pytest.mark.parametrize(
    "bad",
    [
        {"task": "u", "rules": []},
        doc(version=2),
        doc({"if": [], "delta": 1}),
        doc({"if": [["nope", ">", 1]], "delta": 1}),
        doc({"if": [["s_prior", "~", 1]], "delta": 1}),
        doc({"if": [["s_prior", "between", 1]], "delta": 1}),
        doc({"if": [["s_prior", "in_top_band", 0]], "delta": 1}),
        doc({"if": [["s_prior", ">", 1]]}),
        doc({"if": [["s_prior", ">"]], "delta": 1}),
        doc(selected_features=["nope"]),
    ],
)
def test_bad_policies(bad):
    with pytest.raises(policy.PolicyError):
        policy.validate(bad, "t", EV)


def deltas(spark, p, options=policy.Options(), threshold=0.5):
    rows = [(0.1, 0.2, 1, 2, 0.5), (0.5, 1.0, 3, 3, 1.0), (0.7, 0.6, 0, 5, 0.0)]
    df = spark.createDataFrame(rows, "s_prior double, uncertainty double, src_degree int, dst_degree int, degree_ratio double")
    return [round(r["delta"], 9) for r in policy.apply(df, policy.validate(p, "t", EV), options, threshold).collect()]


def test_policy_modes(spark):
    rule = {"if": [["s_prior", ">=", 0.5], ["uncertainty", ">=", 0.9], ["degree_ratio", "<", 0.1]], "delta": 0.3}
    assert deltas(spark, doc(rule)) == [0, 0, 0]
    assert deltas(spark, doc(rule), policy.Options(match="partial", ratio=0.6)) == [0, 0.3, 0.3]
    assert deltas(spark, doc(rule), policy.Options(match="partial", ratio=0.6, scale_by_match=True)) == [0, 0.2, 0.2]
    guarded = policy.Options(match="guarded_partial", ratio=0.6, guards=("uncert",))
    assert deltas(spark, doc(rule), guarded) == [0, 0.3, 0]
    override = policy.Options(match="partial", ratio=0.6, combine="hard_override")
    assert deltas(spark, doc(rule), override) == [0, 0.001, round(0.501 - 0.7, 9)]
    assert deltas(spark, doc({"if": [["uncertainty", "in_top_band", 0.5]], "delta": 1.0})) == [0, 1, 1]
    assert deltas(spark, doc(rule), policy.Options(relax=0.5)) == [0, 0, 0.3]
    assert deltas(spark, doc({"if": [["s_prior", ">=", 0.5]], "delta": 1.0}), policy.Options(shift_prior=True), 0.7) == [0, 0, 1]


GOOD = "def compute_feature(ctx):\n    h = ctx['helpers']\n    total = 0.0\n    for x in ctx['stats_a']['value_set']:\n        total += 1.0\n    return h['safe_ratio_float'](total, float(len(ctx['stats_b']['value_set'])))\n"


def feature(code=GOOD, **more):
    return {"feature_name": "my_feature", "code": code, "fallback_value": 0.25, "range_hint": [0, 1]} | more


@pytest.mark.parametrize(
    "code",
    [
        "import os\ndef compute_feature(ctx):\n    return 1",
        "def compute_feature(ctx):\n    return ctx.__class__",
        "def compute_feature(ctx):\n    return open('x')",
        "def compute_feature(ctx, y):\n    return 1",
        "def other(ctx):\n    return 1",
        "def compute_feature(ctx):\n    return sorted([1], key=None)",
        "def compute_feature(ctx):\n    while True:\n        pass",
        "def compute_feature(ctx):\n    return (lambda: 1)()",
        "x = 1",
        "def compute_feature(ctx)",
        "def compute_feature(ctx):\n    return __import__('os')",
    ],
)
def test_bad_feature_code(code):
    with pytest.raises(generated.FeatureError):
        generated.validate(feature(code))


@pytest.mark.parametrize("more", [{"feature_name": "A"}, {"scope": "column_pair"}, {"task": "x"}, {"fallback_value": float("nan")}, {"range_hint": [1, 0]}])
def test_bad_feature_documents(more):
    with pytest.raises(generated.FeatureError):
        generated.validate(feature(**more))


def test_features_run_and_fall_back(spark, tmp_path):
    bad = feature("def compute_feature(ctx):\n    return 1 / 0", feature_name="broken")
    far = feature("def compute_feature(ctx):\n    return 7", feature_name="far")
    features = [generated.validate(f) for f in (feature(), bad, far)]
    generated.save(features, tmp_path / "f.json")
    assert generated.load(tmp_path / "f.json") == features and generated.fingerprint(features) == generated.fingerprint(features[::-1])
    side = "struct<value_set:array<string>>"
    df = spark.createDataFrame([(1, (["a"],), (["b", "c"],)), (2, None, (["b"],))], f"k int, pa {side}, pb {side}")
    got = {r["k"]: r for r in generated.compute(df, features, ["k"]).collect()}
    assert (got[1]["my_feature"], got[1]["broken"], got[1]["far"]) == (0.5, 0.25, 1.0)
    assert got[2]["my_feature"] == 0.25


def test_resolver():
    from lakeweave.operators.atoms import resolve

    groups = {"both": ("coverage_b", "coverage_a")}
    assert resolve("joinable_table_search", ["both", "jaccard", "jaccard"], groups) == ["jaccard", "coverage_a", "coverage_b"]
    assert resolve("entity_matching", ["row_emb_cosine"] * 2) == ["row_emb_cosine"] * 2
    with pytest.raises(ValueError):
        resolve("schema_matching", ["nope"])


def test_policies_keep_all_rows(spark):
    assert catalog.p8_r4_r7_r10_policy(spark, "/root/testdata/sf0.001").where(F.col("delta").isNull()).count() == 0
