import json

import numpy as np
import pyspark.sql.functions as F
import pytest

from lakeweave.functions import generated
from lakeweave.operators import graph, learn, rerank
from lakeweave.plans import catalog, config
from lakeweave.sources import files

SF = "/root/testdata/sf0.001"


def test_task_settings():
    assert config.merge({"a": 1, "b": 2}, {"schema_matching": {"b": 3}}, "schema_matching") == {"a": 1, "b": 3}
    with pytest.raises(ValueError):
        config.merge({}, {}, "other")
    assert config.wire([], ["x"], False) == (["x"], ["x"])
    assert config.wire(["y"], ["x", "y"], True) == (["y", "x"], ["y", "x"])
    assert config.spec_path("t", "d", "{task}/{dataset}.json", "p") == "t/d.json" and config.spec_path("t", "d", None, "p") == "p"


@pytest.mark.parametrize("task", sorted(generated.MADE))
def test_made_features_are_valid(task):
    made = generated.dry_run(task, 8)
    assert len({f.name for f in made}) == 8
    assert generated.examples(made, [made[0].based_on[0]]) and generated.examples(made, []) == made


def test_features_from_answers():
    good = {"feature_name": "one", "code": "def compute_feature(ctx):\n    return 1.0"}
    answers = iter(["nothing", json.dumps(good | {"code": "import os"}), f"```json\n{json.dumps(good)}\n```"])
    asked = []
    assert generated.generate(lambda wrong: asked.append(wrong) or next(answers), "entity_matching").name == "one"
    assert asked[0] == "" and all(asked[1:])
    with pytest.raises(generated.FeatureError):
        generated.generate(lambda _: "{}", "entity_matching", 2)


def test_scores_are_written_by_task_and_split(spark, tmp_path):
    df = spark.createDataFrame([("a", "test", 0.5), ("b", "val", 0.1)], "task string, split string, score double")
    files.write_scores(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("task = 'b'").first()["score"] == 0.1
    assert (tmp_path / "s/task=a/split=test").is_dir()


def test_capped_edges_are_stable(spark):
    e = spark.range(100).withColumnRenamed("id", "edge_id")
    one, two = ([r["edge_id"] for r in graph.cap_edges(e.repartition(k), 10, 3).collect()] for k in (1, 5))
    assert one == two == sorted(one) and len(one) == 10
    assert graph.identity(spark, 3).count() == 3


def test_attention_with_given_vectors(spark):
    g = spark.createDataFrame([(1, 3), (2, 3)], "src long, dst long")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0])], "node long, embedding array<double>")
    got = {r["pos"]: r["x"] for r in graph.attend(g, v, v, v, 1.0).collect()}
    w = np.exp([2.0, 0.0]) / np.exp([2.0, 0.0]).sum()
    assert [got[0], got[1]] == pytest.approx(w.tolist())


def test_layers(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "u array<double>, v array<double>")
    r = df.select(learn.dense(F.col("u"), [[1.0, 1.0], [0.0, 2.0]], [0.5, 0.0]).alias("d"), learn.layer_norm(F.col("u")).alias("n"), learn.interactions(F.col("u"), F.col("v")).alias("i"), learn.unit(F.col("v")).alias("e")).first()
    assert r["d"] == [3.5, 4.0] and r["i"] == [1, 2, 3, 4, 2, 2, 3, 8] and r["e"] == pytest.approx([0.6, 0.8])
    assert r["n"] == pytest.approx([-1, 1], abs=1e-4)


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(50, 2)), rng.uniform(0.5, 2, 50)
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=50) / 10
    df = spark.createDataFrame([(*map(float, a), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], "a double, b double, y double, w double")
    z = np.c_[np.ones(50), x]
    want = np.linalg.solve((z * w[:, None]).T @ z + np.diag([0, 1, 1]), (z * w[:, None]).T @ y)
    assert rerank.normal_equations(df, ["a", "b"], "y", "w") == pytest.approx(want.tolist(), rel=1e-6)


def test_benefit_needs_both_kinds(spark):
    one = spark.createDataFrame([(0.4, 0.2, 1, 1, 1)], "s double, delta double, label int, src_degree int, dst_degree int")
    assert learn.train_benefit(one, 0.5) is None
    with pytest.raises(ValueError):
        rerank.benefit(rerank.Setting(min_benefit=0.5), None)
    assert catalog.k7_benefit_model(spark, SF).count() == 150
