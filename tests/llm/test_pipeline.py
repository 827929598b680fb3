import pyspark.sql.functions as F
import pytest

import corpus_pipeline
from lakeweave.llm import decontam, isoforest, kneser_ney
from tests.llm.test_documents import brute_fingerprint, roots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        rows = got.collect()
        out.append((name, docs, got.columns, rows))
        if name != "best_fit_packing":
            docs = spark.createDataFrame(rows, docs.schema)
    return {name: x for name, *x in out}


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_order_and_columns(stages):
    assert list(stages) == ["quality_classifier", "quality_rules", "near_duplicates", "decontamination", "best_fit_packing"]
    for name, (docs, columns, rows) in stages.items():
        if name != "best_fit_packing":
            assert columns == docs.columns and 0 < len(rows) <= docs.count()


def test_classifier_and_rules_keep_what_they_judge_good(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs, _, rows = stages["quality_classifier"]
    judged = kneser_ney.judge(docs, kneser_ney.fit(docs, labels)).where("kept")
    assert ids(rows) == ids(judged.collect())
    docs, _, rows = stages["quality_rules"]
    judged = isoforest.judge(docs, isoforest.fit(docs, labels)).where("kept")
    assert ids(rows) == ids(judged.collect())


def test_one_document_of_each_group_stays(stages):
    docs, _, rows = stages["near_duplicates"]
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert ids(rows) == sorted(set(roots(fps, linked).values()))


def test_contaminated_documents_go(spark, stages):
    docs, _, rows = stages["decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontam.words_of(r["text"].encode())
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = []
    for r in docs.collect():
        w, hit = decontam.words_of(r["text"].encode()), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            want.append(r["doc_id"])
    assert ids(rows) == sorted(want)


def test_packed_sequences_hold_everything(stages):
    docs, _, rows = stages["best_fit_packing"]
    assert {r["doc_id"] for r in rows} == set(ids(docs.select("doc_id", F.lit(1)).collect()))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= 2048


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages["best_fit_packing"][2])


def test_run_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    corpus_pipeline.run(spark, SF)
    assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == before


CLASHING = ("block", "data", "row_hash", "kept_id", "kept_hash", "fp", "first", "root", "score", "counts", "good", "part", "length", "rank", "key")


def test_stages_take_odd_rows_and_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None), (None, "a null id with some words of its own and more"), (1, None), (2, ""), (3, " \n "), (4, "word " * 60_000), (5, "same row"), (5, "same row")]
    odd = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as bigint) as n_chars")
    docs = docs.unionByName(odd.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)], F.array(F.lit(1)).alias("list"), F.create_map(F.lit("a"), F.lit(1)).alias("map"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        rows = got.collect()
        if name == "best_fit_packing":
            ids_in = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows if r["piece"] == 0) == ids_in
        else:
            assert got.columns == docs.columns and rows
            assert len([r for r in rows if r["doc_id"] == 5 and r["text"] == "same row"]) in ((1,) if name == "near_duplicates" else (0, 2))
        assert stage(spark, docs.where("false"), SF).count() == 0
