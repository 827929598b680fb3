import numpy as np
import pytest

from lakeweave.operators import atoms, encoder, evaluate, learn
from lakeweave.plans import catalog, roles
from lakeweave.sources import files


def softmaxed(s):
    e = np.exp(s - s.max())
    return e / e.sum()


def lin(w, x):
    return np.array(w[0]) @ x + np.array(w[1])


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(1)
    x = {i: rng.normal(size=4) for i in range(6)}
    edges = [(0, 1), (2, 1), (3, 1), (1, 2), (4, 4), (0, 3), (2, 3)]
    e = {k: rng.normal(size=2) for k in edges}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "node long, embedding array<double>")
    graph = spark.createDataFrame([(a, b, e[a, b].tolist()) for a, b in edges], "src long, dst long, edge array<double>")
    return x, e, vectors, graph


def arrays(df):
    return {r["node"]: np.array(r["embedding"]) for r in df.collect()}


def test_attention_equals_its_definition(small):
    x, e, vectors, graph = small
    w = {n: catalog.fixed_weights(4, 2 if n == "edge" else 4, k) for k, n in enumerate(("q", "k", "v", "edge", "out"))}
    got = arrays(encoder.attend(graph, vectors, w, 2))
    for t in x:
        into, sums = [k for k in e if k[1] == t], np.zeros(4)
        for h in (slice(0, 2), slice(2, 4)):
            if into:
                s = np.array([(lin(w["q"], x[t])[h] * (lin(w["k"], x[a])[h] + lin(w["edge"], e[a, t])[h])).sum() / np.sqrt(2) for a, _ in into])
                sums[h] = sum(p * lin(w["v"], x[a])[h] for p, (a, _) in zip(softmaxed(s), into, strict=True))
        assert got[t] == pytest.approx(lin(w["out"], sums))


def test_graph_attention_equals_its_definition(small):
    x, e, vectors, graph = small
    w = {n: catalog.fixed_weights(4, 2 if n == "edge" else 4, k) for k, n in enumerate(("left", "right", "edge"))}
    score, bias = [[0.3, -0.2], [0.1, 0.4]], [0.1, 0.2, 0.3, 0.4]
    got = arrays(encoder.graph_attention(graph, vectors, w, score, bias, 2))
    for t in x:
        into = {a: v for (a, b), v in e.items() if b == t and a != t}
        into[t] = np.mean(list(into.values()), 0) if into else np.zeros(2)
        want = np.array(bias)
        for h in range(2):
            part = slice(2 * h, 2 * h + 2)
            m = [lin(w["left"], x[a]) + lin(w["right"], x[t]) + lin(w["edge"], v) for a, v in into.items()]
            s = np.array([(np.where(y > 0, y, 0.2 * y)[part] * score[h]).sum() for y in m])
            want[part] += sum(p * lin(w["left"], x[a])[part] for p, a in zip(softmaxed(s), into, strict=True))
        assert got[t] == pytest.approx(want)


def test_gate_and_neighbour_mean(small):
    x, e, vectors, graph = small
    own, others = catalog.fixed_weights(4, 4, 1), catalog.fixed_weights(4, 4, 2)
    out = encoder.neighbour_mean(graph, vectors, own, others)
    got = arrays(out)
    for t in x:
        into = [x[a] for a, b in e if b == t]
        assert got[t] == pytest.approx(lin(own, x[t]) + lin(others, np.mean(into, 0) if into else np.zeros(4)))
    gate = [0.1, -0.2, 0.3, 0.0, 0.2, -0.1, 0.1, 0.05]
    mixed = arrays(encoder.gated(vectors, out, gate, 0.1))
    for t in x:
        y = np.maximum((got[t] - got[t].mean()) / np.sqrt(got[t].var() + 1e-5), 0)
        g = 1 / (1 + np.exp(-(np.append(x[t], y) @ gate + 0.1)))
        assert mixed[t] == pytest.approx(g * y + (1 - g) * x[t])


def test_kept_atoms():
    assert atoms.keep_places("schema_matching", ["value_jaccard", "header_token_jaccard"], ["header_token_jaccard"]) == [1]
    assert atoms.keep_places("entity_matching", ["row_value_jaccard"] * 2, ["row_value_jaccard"] * 2) == [0, 1]
    assert atoms.keep_places("entity_matching", ["row_value_jaccard"], ["none", " "]) == []
    with pytest.raises(ValueError):
        atoms.keep_places("entity_matching", ["row_value_jaccard"], ["row_value_overlap"])
    assert atoms.resolve("union_table_search", []) == list(atoms.ATOMS["union_table_search"])


def test_roles_and_counts():
    assert roles.channel_roles("schema_matching", 2) == ["header_semantic", "value_overlap"]
    assert roles.channel_roles("other", 6) == ["signal_core", "supporting_evidence", "robustness", "calibration", "role_01", "role_02"]
    assert roles.channel_roles("x", 2, [" a ", "b"]) == ["a", "b"]
    for bad in (["a"], ["a", "A"]):
        with pytest.raises(ValueError):
            roles.channel_roles("x", 2, bad)
    assert roles.channel_count(9) == (0, 9) and roles.channel_count(9, least=2) == (0, 2) and roles.channel_count(9, roles=3) == (3, 3) and roles.channel_count(9, 4, 2, 3) == (4, 4)
    with pytest.raises(ValueError):
        roles.channel_count(9, exact=2, least=3)
    doc = {"output_range_hint": [0, 1], "channels": [{"name": "c", "output_range_hint": [0, 1]}]}
    assert roles.without_hints(doc, "entity_matching") == {"channels": [{"name": "c"}]} and roles.without_hints(doc, "schema_matching") == doc


def test_early_stopping_keeps_the_best(spark):
    rng = np.random.default_rng(3)
    rows = [(int(y), float(y + rng.normal() / 2), float(rng.normal())) for y in rng.integers(0, 2, 300)]
    df = spark.createDataFrame(rows, "label int, a double, b double")
    weights, history = learn.train_early(df, df, ["a", "b"], epochs=12, patience=2)
    assert history[-1]["loss"] < history[0]["loss"] and len(weights) == 3
    best = max(h["f1"] for h in history)
    assert len(history) == 12 or max(h["f1"] for h in history[-2:]) <= max(h["f1"] for h in history[:-2])
    z = np.array([[a, b, 1] for _, a, b in rows]) @ weights
    y, on = np.array([r[0] for r in rows]) == 1, z >= 0
    assert 2 * (y & on).sum() / ((y & on).sum() * 2 + (y != on).sum()) == pytest.approx(best)


def test_running_totals_and_best_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(0, 30)) if i % 3 else 7.0, int(rng.integers(0, 2))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, score double, label int")
    got = {r["score"]: r["upto"] for r in evaluate.running(df.groupBy("score").count(), "score", {"upto": "count"}).collect()}
    assert got == {s: sum(x <= s for _, x, _ in rows) for _, s, _ in rows}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (0, 1, 100, 350, 500, 900):
        assert sorted(r["id"] for r in evaluate.best(df, k).collect()) == sorted(r[0] for r in order[:k])
    named = df.withColumn("id", df["id"].cast("string"))
    want = sorted((str(i), s) for i, s, _ in rows)
    want = [i for i, _ in sorted(want, key=lambda r: (-r[1], r[0]))[:100]]
    assert sorted(r["id"] for r in evaluate.best(named, 100).collect()) == sorted(want)


def test_archives_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "id long, s_prior double")
    files.write_archive(df, str(tmp_path), "eval", {"threshold": 0.4})
    rows, settings = files.read_archive(spark, str(tmp_path), "eval")
    assert rows.collect() == df.collect() and settings == {"threshold": 0.4}
