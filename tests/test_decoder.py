import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from lakeweave.operators import decoder, encoder, learn
from lakeweave.plans import catalog

LOSSES = [decoder.Loss(), decoder.Loss(positive=3.0), decoder.Loss("focal", alpha=0.3, gamma=1.5)]


@pytest.mark.parametrize("loss", LOSSES)
def test_slopes_equal_finite_differences(loss):
    rng = np.random.default_rng(1)
    model, x, y = decoder.Model(3, 5, seed=2), rng.normal(size=(7, 3)), rng.integers(0, 2, 7)
    slope, value = model.slopes(x, y, loss)
    at = lambda v: loss(decoder.Model(3, 5, v).forward(x)[2], y)[0].sum()
    assert value == pytest.approx(at(model.vector))
    step = 1e-6 * np.eye(len(model.vector))
    assert slope == pytest.approx(np.array([(at(model.vector + s) - at(model.vector - s)) / 2e-6 for s in step]), abs=1e-5)


def table(spark, x, y, parts=5):
    rows = [(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, label int, x array<double>").repartition(parts, "id")


@pytest.mark.parametrize("loss", LOSSES[1:])
def test_gradient_over_tasks_and_pieces(spark, monkeypatch, loss):
    monkeypatch.setattr(decoder, "PIECE", 10)
    rng = np.random.default_rng(3)
    x, y, model = rng.normal(size=(200, 4)), rng.integers(0, 2, 200), decoder.Model(4, 6, seed=1)
    slope, value, n = decoder.gradient(table(spark, x, y), model, loss)
    want, lost = model.slopes(x, y, loss)
    assert n == 200 and slope == pytest.approx(want / 200) and value == pytest.approx(lost / 200)
    monkeypatch.setattr(decoder, "BLOCK", 7)
    for parts in (1, 6):
        slopes = [decoder.gradient(b, model, loss)[0] for b in decoder.batches_of(table(spark, x, y, parts), 2, 0, rows_of_slice=20)]
        assert parts == 1 or all((a == b).all() for a, b in zip(slopes, before, strict=True))
        before = slopes
    assert decoder.gradient(table(spark, x, y).where("false"), model, loss)[2] == 0


def squares(n, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 2))
    return x, (x[:, 0] * x[:, 1] > 0).astype(int)


def test_hidden_layers_learn_what_a_line_cannot(spark):
    rows = table(spark, *squares(800))
    model, threshold, history = decoder.train(rows.where("id % 4 > 0"), rows.where("id % 4 = 0"), hidden=16, epochs=16, patience=16, batches=2, rate=0.1)
    assert max(h["f1"] for h in history) > 0.9 and history[-1]["loss"] < history[0]["loss"]
    flat = rows.withColumns({"a": F.col("x")[0], "b": F.col("x")[1]})
    line = learn.score(learn.train_decoder(flat.where("id % 4 > 0"), ["a", "b"]), flat.where("id % 4 = 0"))
    right = lambda df, t: df.select(F.avg(((F.col("score") >= t).cast("int") == F.col("label")).cast("double"))).first()[0]
    assert right(decoder.score(rows.where("id % 4 = 0"), model), threshold) > right(line, 0.5) + 0.2


def test_a_restart_in_the_middle_gives_the_same_weights(spark, tmp_path):
    rows = table(spark, *squares(120))
    settings = {"hidden": 4, "batches": 3, "patience": 9, "rate": 0.02}
    straight, t1, _ = decoder.train(rows, rows, epochs=4, **settings)
    decoder.train(rows, rows, epochs=2, checkpoints=str(tmp_path / "c"), **settings)
    (tmp_path / "c" / "epoch=3").mkdir()  # begun, not written whole
    resumed, t2, history = decoder.train(rows, rows, epochs=4, checkpoints=str(tmp_path / "c"), **settings)
    assert [h["epoch"] for h in history] == [3, 4]
    assert (straight.vector == resumed.vector).all() and t1 == t2


def test_batches_are_all_rows_once(spark):
    rows = table(spark, *squares(100))
    dealt = decoder.batches_of(rows, 7, 3)
    assert sum(b.count() for b in dealt) == 100 and sum(b.count() > 0 for b in dealt) > 4
    assert [b.count() for b in decoder.batches_of(rows.repartition(2), 7, 3)] == [b.count() for b in dealt]


def test_patience_ends_training(spark):
    x, _ = squares(60)
    rows = table(spark, x, [0] * 60)
    _, _, history = decoder.train(rows, rows, hidden=3, epochs=30, patience=2, batches=2)
    assert len(history) == 3


def test_replay_columns_and_projection(spark):
    rows = table(spark, *squares(10))
    model = decoder.Model(2, 8, seed=4)
    got = decoder.score(rows, model, replay=True).collect()
    for r in got:
        _, hidden, logit = model.forward(np.array([r["x"]]))
        assert r["edge_hidden"] == pytest.approx(hidden[0].tolist()) and r["score"] == pytest.approx(1 / (1 + np.exp(-logit[0])))
        assert r["decoder_input"] == r["x"] and r["projection"] == pytest.approx(model.project(hidden)[0].tolist()) and len(r["projection"]) == 2


def test_pair_input(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 1.0], [0.5, None])], "u array<double>, v array<double>, f array<double>")
    assert row.select(decoder.pair_input(F.col("u"), F.col("v"), F.col("f"))).first()[0] == [1, 2, 3, 1, 0.5, 0]
    assert row.select(decoder.pair_input(F.col("u"), F.col("v"), None, True)).first()[0] == [1, 2, 3, 1, 2, 1, 3, 2]


def test_encoder_over_hops_equals_the_whole(spark):
    rng = random.Random(6)
    edges = spark.createDataFrame([(a, b, [a % 3 / 3, 0.5]) for a, b in {(rng.randrange(25), rng.randrange(25)) for _ in range(60)}], "src long, dst long, edge array<double>")
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(25)], "node long, embedding array<double>")
    model, seeds = catalog.fixed_encoder(), vectors.where("node % 6 = 1").select("node")
    whole = {r["node"]: r["embedding"] for r in model.whole(edges, vectors).collect()}
    some = {r["node"]: r["embedding"] for r in model.sampled(edges, vectors, seeds, (100, 100)).collect()}
    assert set(some) == {1, 7, 13, 19} and all(some[n] == pytest.approx(whole[n]) for n in some)
    few = model.sampled(edges, vectors, seeds, (1, 1)).collect()
    assert {r["node"] for r in few} == set(some)
    assert encoder.sample_edges(edges, seeds, 2).groupBy("dst").count().where("count > 2").isEmpty()


def test_layer_norm_with_weights(spark):
    x = spark.createDataFrame([([1.0, 2.0, 4.0],)], "x array<double>").select(learn.layer_norm(F.col("x"), weight=[1.0, 2.0, 3.0], bias=[0.5, 0.0, -1.0]))
    v = np.array([1.0, 2.0, 4.0])
    assert x.first()[0] == pytest.approx(((v - v.mean()) / np.sqrt(v.var() + 1e-5) * [1, 2, 3] + [0.5, 0, -1]).tolist())


def test_contrastive_loss_has_a_size_check(spark):
    rows = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 1, [0.6, 0.8]), (0, 0, [0.0, 1.0]), (0, -1, [9.0, 9.0]), (1, 1, [1.0, 0.0])], "b int, label int, embedding array<double>")
    sims = np.array([[1, 0.6, 0], [0.6, 1, 0.8]]) / 0.1
    total = np.log(np.exp(sims).sum(1))
    want = -np.mean([(sims[0, 1] - total[0]), (sims[1, 0] - total[1])])
    got = {r["b"]: r["loss"] for r in learn.contrastive_loss(rows, "b").collect()}
    assert got[0] == pytest.approx(want, abs=1e-6) and got[1] == 0
    with pytest.raises(ValueError, match="batch has 3 rows"):
        learn.contrastive_loss(rows, "b", most=2)
