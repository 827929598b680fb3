import json

import pyspark.sql.functions as F
import pytest

from lakeweave.operators import evaluate, graph, profile, report
from lakeweave.sources import files, lake
from lakeweave.streaming import scoring


def test_csv_lake(spark, tmp_path):
    (tmp_path / "one.csv").write_text("id ,myName,empty\n1,Ann,\n2.0,N/A,-\n3,ann,unknown\n", encoding="utf-8")
    (tmp_path / "none.csv").write_text("a,b\n", encoding="utf-8")
    cells = lake.csv_cells(spark, str(tmp_path), ["one", "none.csv", "missing"])
    assert cells.count() == 9 and {r["column_name"] for r in cells.collect()} == {"id", "myName", "empty"}
    own = {r["column_name"]: r for r in profile.schema_columns(cells).collect()}
    assert own["empty"]["missing_ratio"] == 1 and own["empty"]["n_distinct"] == 0 and own["empty"]["avg_len"] == 0
    assert own["myName"]["header_tokens"] == ["my", "name"] and own["myName"]["unique_ratio"] == 0.5
    assert own["id"]["numeric_ratio"] == 1
    join = {r["column_name"]: r for r in profile.join_columns(cells).collect()}
    assert join["myName"]["n_values"] == 3 and join["myName"]["n_distinct"] == 2
    row = profile.entity_rows(cells).where("row_idx = 1").first()
    assert row["value_set"] == ["2"] and row["numeric_median"] == 2 and row["nonempty_count"] == 1
    assert row["serial_text"] == "col id val 2"
    assert profile.union_tables(cells).first()["n_rows"] == 3


def test_wide_rows_are_capped(spark):
    cells = spark.createDataFrame([("t", 0, i, f"h{i}", f"v{i} w{i} x{i}") for i in range(70)], lake.CELLS)
    row = profile.entity_rows(cells).first()
    assert row["value_set"] == [f"v{i} w{i} x{i}" for i in range(64)]
    assert row["token_set"] == [f"{c}{i}" for i in range(43) for c in "vwx"][:128]
    assert len(row["serial_text"]) == 512 and row["nonempty_count"] == 70


def test_table_values_are_the_first(spark):
    cells = spark.createDataFrame([("t", i, 0, "c", f"v{i // 2}") for i in range(2100)], lake.CELLS)
    got = {r["v"] for r in profile.union_values(cells).collect()}
    assert got == {f"v{i}" for i in range(1024)}


def test_node_dictionary(spark, tmp_path):
    doc = {"row": {"('t one', 3)": 1, "bad": 2}, "column": {"('t','c')": 3}, "table": {"t": 4}}
    (tmp_path / "nodes.json").write_text(json.dumps(doc), encoding="utf-8")
    rows = {tuple(r) for r in files.node_dictionary(spark, str(tmp_path / "nodes.json")).collect()}
    assert rows == {(1, "row", "t one", None, 3), (3, "column", "t", "c", None), (4, "table", "t", None, None)}


def test_edge_files(spark, tmp_path):
    for name, lines in {"edge_lists": ["1\t2", "3\t4\t5\t6\t7"], "edge_labels": ["1", "0"], "edge_type": ["row_table", "cell_row"], "train_mask": ["1"], "validate_mask": ["0", "1"], "test_mask": []}.items():
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n" * bool(lines), encoding="utf-8")
    rows = [tuple(r) for r in files.edge_files(spark, str(tmp_path)).orderBy("edge_id").collect()]
    assert rows == [(0, 1, [1, 2], 2, "row_table", True, False, False), (1, 0, [3, 4, 5, 6], 4, "cell_row", False, True, False)]
    assert files.count_lines(spark, str(tmp_path / "edge_lists.txt")) == 2


def test_caches_pools_and_events(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "cache"), {"a": 1}, make).count() == 3
    assert len(calls) == 1
    assert files.feature_pool("a, b,a,") == ["a", "b"] and files.feature_pool([], ["x"]) == ["x"]
    events = files.Events(spark)
    with events.phase("load"):
        pass
    events.write(str(tmp_path / "events"))
    assert files.summarise_events(spark.read.json(str(tmp_path / "events"))).first()["n"] == 1
    one = spark.createDataFrame([(1, 2), (4, 3)], "a long, b long")
    two = spark.createDataFrame([(3, 4), (2, 1)], "a long, b long")
    assert files.pair_digest(one).first() == files.pair_digest(two).first()


def test_logs_and_tables(spark, tmp_path):
    (tmp_path / "run.log").write_text("x\nTraining for task: entity_matching\n[Validation] selected threshold=0.42 f1=0.8\nTest Metrics (threshold=0.42): {'link_auc': 0.9, 'link_f1': 0.7}\nTraining for task: schema_matching\n[Validation] selected threshold=0.5 f1=0.6\n", encoding="utf-8")
    rows = {r["task"]: r for r in report.read_logs(spark, str(tmp_path / "run.log")).collect()}
    assert tuple(rows["entity_matching"])[3:] == (0.42, 0.8, 0.7, None, 0.9) and rows["entity_matching"]["file"] == "run"
    assert tuple(rows["schema_matching"])[3:] == (0.5, 0.6, None, None, None)
    table = "| k | c1 | c2 |\n|---|---|---|\n| a | 0.5±0.1 | N/A |\n"
    got = {(r["key"], r["column"]): (r["mean"], r["std"]) for r in report.read_markdown_table(table, spark).collect()}
    assert got == {("a", "c1"): (0.5, 0.1), ("a", "c2"): (None, None)}
    assert report.markdown([{"a": 1}], ["a", "b"]).splitlines()[2] == "| 1 |  |"


def scored(spark, rows):
    return spark.createDataFrame(rows, "id long, score double, label int")


def test_evaluation_corner_cases(spark):
    one = scored(spark, [(1, 0.3, 1), (2, 0.3, 1)])
    assert evaluate.auc(one).first()["auc"] != evaluate.auc(one).first()["auc"]
    assert evaluate.elbow(one).first()["elbow"] == 0.3
    assert evaluate.elbow(scored(spark, [(1, 0.2, 1), (2, 0.9, 0)])).first()["elbow"] == 0.2
    tied = scored(spark, [(1, 0.5, 1), (2, 0.5, 0), (3, 0.1, 0), (4, float("nan"), 0)]).where("not isnan(score)")
    assert evaluate.auc(tied).first()["auc"] == 0.75
    assert evaluate.take_ratio(10, 0.25) == 3 and evaluate.take_ratio(10, 0) == 0 and evaluate.take_ratio(10, 2) == 10
    assert evaluate.confusion(scored(spark, []), 0.5).first()["f1"] == 0
    with pytest.raises(ValueError):
        evaluate.decide(F.col("score"), 0.5, "~")


def test_graph_corner_cases(spark):
    g = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 2, 0)], "src long, dst long, type_id int")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    assert {r["node"]: r["degree"] for r in graph.degrees(g, nodes).collect()} == {1: 4, 2: 2, 3: 0}
    assert {tuple(r) for r in graph.append(g.where("false"), g, undirected=True).collect()} == {(1, 1, 0), (1, 2, 0), (2, 1, 0)}
    assert {tuple(r) for r in graph.cycle_pairs(nodes).collect()} and graph.cycle_pairs(nodes).count() == 3
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [5.0, 6.0])], "node long, embedding array<float>")
    pooled = {r["node"]: r["embedding"] for r in graph.pool(g, v).collect()}
    assert pooled == {1: [1.0, 2.0], 2: [1.0, 2.0], 3: [5.0, 6.0]}
    assert graph.splits("train, val") == ["train", "val"]
    with pytest.raises(ValueError):
        graph.splits("dev")


def test_streams_give_what_tables_give(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = scoring.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    want = {(r["start"], r["event_type"], r["n"]) for r in scoring.windowed(events).collect()}
    assert {(r["start"], r["event_type"], r["n"]) for r in spark.table("windows").collect()} == want
    assert scoring.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_pairs_of_a_stream_are_scored(spark, tmp_path):
    spark.createDataFrame([(1, 2), (1, 9)], "a long, b long").write.parquet(str(tmp_path / "pairs"))
    profiles = spark.createDataFrame([(1, 4.0), (2, 8.0)], "id long, n double")
    stream = spark.readStream.schema("a long, b long").parquet(str(tmp_path / "pairs"))
    from lakeweave.functions.text import safe_ratio

    out = scoring.score_stream(stream, profiles, F.coalesce(safe_ratio("pa.n", "pb.n"), F.lit(0.0)))
    q = out.writeStream.format("memory").queryName("scores").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("scores").collect()} == {(1, 2, 0.5), (1, 9, 0.0)}


def test_split_rows_are_all_there(spark):
    split = spark.range(500_001).selectExpr("'a.csv' as ltable_name", "id as l_id", "'b' as rtable_name", "0 as r_id")
    assert files.split_rows(split).count() == 500_002 and files.split_rows(split, 10).count() == 10
