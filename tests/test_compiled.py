"""Features as native columns give what they give in Arrow batches."""

import random

import pytest

from lakeweave.functions import compiled, generated

TYPE = "struct<value_set:array<string>,token_set:array<string>,numeric_value_set:array<string>,serial_text:string,nonempty_count:int,numeric_median:double,header_to_value:map<string,string>,column_value_sets:array<array<string>>,header_tokens:array<string>,embedding:array<float>>"
WORDS = ["a", "b", "c", "d", "5", "07", "x y"]


def profile(rng):
    some = lambda k: rng.sample(WORDS, rng.randint(0, k))
    return (some(6), some(6), some(3), " ".join(some(6)) * rng.choice([1, 1, 30]), rng.randint(0, 5), rng.choice([None, 0.0, -2.5, 7.0, 1e6]), {k: rng.choice("uv") for k in some(5)}, [some(4) for _ in range(rng.randint(0, 4))], some(4) + some(2), [rng.gauss(0, 1) for _ in range(3)])


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(8)
    rows = [(i, profile(rng), profile(rng)) for i in range(60)] + [(100, None, profile(rng)), (101, profile(rng), None), (102, None, None)]
    return spark.createDataFrame(rows, f"id long, pa {TYPE}, pb {TYPE}").cache()


def feature(body, **options):
    code = "def compute_feature(ctx):\n    a = ctx['stats_a']\n    b = ctx['stats_b']\n    h = ctx['helpers']\n" + "\n".join("    " + line for line in body.strip("\n").split("\n"))
    return generated.validate({"feature_name": "made", "code": code, "fallback_value": -7.0, **options})


BODIES = {
    "jaccard": "s = a['value_set']\nt = b['value_set']\nif not s and not t:\n    return 0.0\nn = len(s.union(t))\nreturn len(s.intersection(t)) / n",
    "containment": "s = a['value_set']\nt = b['value_set']\nn = len(s.intersection(t))\nx = n / len(s) if len(s) > 0 else 0.0\ny = float(n) / len(t) if t else 0.0\nif y > x:\n    return y\nreturn x",
    "medians": "x = float(a['numeric_median'])\ny = float(b['numeric_median'])\nreturn 1.0 / (1.0 + abs(x - y) / max(abs(x), abs(y), 1.0))",
    "no median": "x = a['numeric_median']\nif x is None:\n    return 2\nif not x:\n    return 3\nreturn x",
    "division by 0": "return a['nonempty_count'] / b['nonempty_count']",
    "exact headers": "m = a['header_to_value']\nk = b['header_to_value']\nshared = list(set(m.keys()).intersection(set(k.keys())))\nn = 0\nfor key in shared:\n    if str(m.get(key, '')) == k.get(key, ''):\n        n += 1\nreturn n / len(shared) if shared else 0.5",
    "fields as sets": "s = set()\nt = set()\nfor key in a['header_to_value'].keys():\n    s.add(key + '=' + a['header_to_value'][key])\nfor key in b['header_to_value']:\n    t.add(str(key) + '=' + b['header_to_value'].get(key, ''))\nreturn h['set_jaccard'](s, t)",
    "best columns": "total = 0.0\nused = 0\nfor one in a['column_value_sets']:\n    best = 0.0\n    for two in b['column_value_sets']:\n        score = h['set_jaccard'](one, two)\n        if score > best:\n            best = score\n    total += best\n    used += 1\nreturn total / used if used > 0 else 0.0",
    "helpers": "return h['clip01'](0.3 * h['token_jaccard'](list(a['token_set']), b['token_set']) + 0.3 * h['safe_ratio_float'](a['nonempty_count'], b['nonempty_count']) + 0.5 * h['numeric_overlap_max'](a['numeric_value_set'], b['numeric_value_set']))",
    "texts": "return h['normalized_edit_similarity'](a['serial_text'], b['serial_text']) + h['char_ngram_jaccard'](a['serial_text'], b['serial_text'], 3)",
    "vectors": "return (1 + h['cosine_similarity'](ctx['emb_a'], ctx['emb_b'])) / 2",
    "weights": "return h['weighted_jaccard'](a['token_set'], b['token_set'])",
    "comprehension": "long = [len(x) for x in a['token_set'] if x not in b['token_set'] and x != '5']\nreturn sum(long) + (max(long) if long else 0) - len(sorted(b['header_tokens']))",
    "lists": "out = []\nfor i in range(a['nonempty_count']):\n    out.append(i * 2.0)\nreturn sum(out) + len(out) ** 2 - len(out) % 3 + (out[-1] if out else 0)",
    "missing key": "return len(a['header_to_value']['a'])",
    "and, or": "return 1.0 if a['value_set'] and b['value_set'] or a['nonempty_count'] >= 3 else 0.25",
    "chain": "return 1 if 0 < a['nonempty_count'] <= b['nonempty_count'] else 0",
    "whole numbers": "return int(-2.7) + int(a['nonempty_count'] / 2) + float(bool(a['value_set']))",
    "assigned in branches": "x = 1.0\nif a['nonempty_count'] > 2:\n    x = x + 1\n    y = 3\nelse:\n    y = 4\nif b['value_set']:\n    return x * y\nreturn x - y",
}


@pytest.mark.parametrize("name", sorted(BODIES))
@pytest.mark.parametrize("options", [{}, {"range_hint": [0.0, 0.75]}], ids=["free", "hint"])
def test_native_equals_arrow(pairs, name, options):
    f = feature(BODIES[name], **options)
    columns, rest = compiled.split([f], pairs)
    assert not rest
    want = {r["id"]: r["made"] for r in generated.compute(pairs, [f], ["id"]).collect()}
    got = {r["id"]: r["made"] for r in pairs.select("id", columns["made"]).collect()}
    assert len(set(want.values())) > 1 or options or name == "missing key"
    assert got == pytest.approx(want)


@pytest.mark.parametrize("body", ["for x in a['value_set']:\n    return 1\nreturn 0", "return len(str(a['nonempty_count']))", "n = 0\nfor x in a['token_set']:\n    if x == 'a':\n        break\n    n += 1\nreturn n", "return a['nothing']", "return len(a['serial_text'][1:3])"])
def test_the_rest_runs_in_batches(pairs, body):
    f, fine = feature(body), generated.dry_run("entity_matching", 1)[0]
    columns, rest = compiled.split([f, fine], pairs)
    assert rest == [f] and list(columns) == [fine.name]
    both = compiled.compute(pairs, [f, fine], ["id"])
    assert both.columns == ["id", "made", fine.name]
    want, got = generated.compute(pairs, [f, fine], ["id"]).collect(), both.collect()
    for name in ("made", fine.name):
        assert {r["id"]: r[name] for r in got} == pytest.approx({r["id"]: r[name] for r in want})


def test_native_features_run_no_python(pairs):
    plan = compiled.compute(pairs, [feature(BODIES["best columns"])], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
