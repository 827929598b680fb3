import json
import os
import threading

import numpy as np
import pyspark.sql.functions as F
import pytest

from lakeweave.operators import evaluate
from lakeweave.sources import files


def entry(tmp_path):
    return [p for p in (tmp_path / "c").iterdir() if not p.name.startswith(".")]


def test_an_entry_is_made_once_and_has_a_manifest(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(5)
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "c"), {"a": 1, "flags": [True]}, make).count() == 5
    assert files.cached(spark, str(tmp_path / "c"), {"a": 2, "flags": [True]}, make).count() == 5 and len(calls) == 2
    said = json.loads(next((entry(tmp_path)[0] / "manifest").glob("part-*")).read_text())
    assert said["rows"] == 5 and said["version"] == files.VERSION and said["schema"]["fields"][0]["name"] == "id"


@pytest.mark.parametrize("damage", ["half-written", "rows", "version", "text"])
def test_a_broken_entry_is_put_aside(spark, tmp_path, monkeypatch, damage):
    files.cached(spark, str(tmp_path / "c"), {}, lambda: spark.range(4))
    own = entry(tmp_path)[0]
    if damage == "half-written":
        for p in (own / "manifest").iterdir():
            p.unlink()
        (own / "manifest").rmdir()
    elif damage == "rows":
        spark.range(1).write.mode("append").parquet(str(own / "data"))
    elif damage == "text":
        for p in (own / "manifest").iterdir():
            p.unlink()
        (own / "manifest" / "part-0").write_text("{")
    else:
        monkeypatch.setattr(files, "VERSION", 99)
    assert files.cached(spark, str(tmp_path / "c"), {}, lambda: spark.range(7)).count() == 7
    assert len(entry(tmp_path)) == 1


def test_of_two_writers_one_wins(spark, tmp_path):
    gate, got = threading.Barrier(2, timeout=60), {}

    def run(k):
        def make():
            gate.wait()  # both have seen that there is no entry
            return spark.range(3).withColumn("by", F.lit(k))

        got[k] = {r["by"] for r in files.cached(spark, str(tmp_path / "c"), {}, make).collect()}

    threads = [threading.Thread(target=run, args=(k,)) for k in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got[1] == got[2] and len(got[1]) == 1
    assert [p.name for p in (tmp_path / "c").iterdir()] == [entry(tmp_path)[0].name]


def test_profile_of_phases(spark, tmp_path):
    events = files.Events(spark, every=0.05)
    with events.phase("work"):
        rows = spark.range(20_000).withColumn("k", F.col("id") % 100)
        rows.repartition(3, "k").groupBy("k").count().write.parquet(str(tmp_path / "out"))
    with events.phase("nothing"):
        pass
    events.write(str(tmp_path / "events"))
    found = {r["phase"]: r for r in spark.read.schema(events.SCHEMA).json(str(tmp_path / "events")).collect()}
    work = found["work"]
    assert work["rows_shuffled"] == 20_000 and work["rows_written"] == 100 and work["stages"] >= 2
    assert work["shuffle_bytes"] > 0 and work["cpu_ns"] > 0 and work["peak_resident"] > 10**7 and work["samples"] >= 1
    assert found["nothing"]["stages"] == 0 and found["nothing"]["rows_written"] == 0
    assert files.summarise_events(spark.createDataFrame(events.rows, events.SCHEMA)).where("phase = 'work'").first()["n"] == 1


@pytest.mark.parametrize("range_rows", [3, 1 << 16])
def test_running_totals_over_ranges(spark, monkeypatch, range_rows):
    monkeypatch.setattr(evaluate, "RANGE_ROWS", range_rows)
    rows = spark.createDataFrame([(g, f"k{i:03d}", i % 5) for g in ("a", "b") for i in range(40)] + [("b", None, 2)], "g string, k string, n int")
    got = {(r["g"], r["k"]): r["t"] for r in evaluate.running(rows, "k", {"t": "n"}, ("g",)).collect()}
    for g, start in (("a", 0), ("b", 2)):
        total = start
        for i in range(40):
            total += i % 5
            assert got[g, f"k{i:03d}"] == total


@pytest.mark.parametrize("range_rows", [4, 1 << 16])
def test_quantiles_by_rank(spark, monkeypatch, range_rows):
    monkeypatch.setattr(evaluate, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.normal(size=57).round(1)] + [("b", 3.0), ("c", None), ("d", 1.0), ("d", 2.0)]
    table, shares = spark.createDataFrame(rows, "g string, x double"), [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    got = {(r["g"], r["share"]): r["quantile"] for r in evaluate.quantiles(table, "x", shares, ("g",)).collect()}
    for g in "abd":
        own = [x for k, x in rows if k == g]
        assert [got[g, q] for q in shares] == pytest.approx(np.quantile(own, shares).tolist())
    every = [x for _, x in rows if x is not None]
    whole = {r["share"]: r["quantile"] for r in evaluate.quantiles(table, "x", shares).collect()}
    assert [whole[q] for q in shares] == pytest.approx(np.quantile(every, shares).tolist())
    assert "percentile" not in evaluate.summary(table, "x", ("g",))._jdf.queryExecution().optimizedPlan().toString()


def test_what_was_written_can_be_removed(spark, monkeypatch):
    from lakeweave.sources import shared

    monkeypatch.setattr(shared, "_MADE", [])
    table = shared.written(spark.range(3), "some")
    assert table.count() == 3 and len(shared._MADE) == 1
    path = shared._MADE[0].removeprefix("file:")
    shared.clean(spark)
    assert not shared._MADE and not os.path.exists(path)
