import hashlib
import random
import re

import pyspark.sql.functions as F

from lakeweave.llm import fim


def brute(doc_id, text):
    """form, output, prefix_chars, middle_chars, n"""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", text, None, None, n
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle), n
    return "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle), n


def compare(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as form", "2 as k1", "3 as part", "'o' as ordinal", "5 as number")
    found = fim.fill_in_middle(docs, **options).withColumn("again", fim.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"], r["n"]) for r in found), key=key) == sorted(((i, *brute(i, t)) for i, t in rows), key=key)
    assert all(r["again"] == r["text"] for r in found)
    return found


def test_equals_brute_force(spark):
    rng = random.Random(2)
    pieces = ["word", "A", " ", "\n", "é", "𝒳", "1", "<", "<P", "S>", ">", "M", "日本", "\t", "x" * 50]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    found = compare(spark, rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a<P>b"), (4, "<S>"), (5, "x<M>"), (None, "one two"), (None, None), (7, "a"), (8, " "), (9, "\n\n"), (-5, "minus one")]
    compare(spark, rows)


def test_equal_rows_each_give_a_row(spark):
    rows = [(3, "the same text again")] * 500 + [(3, "another text")] * 3 + [(i, "the same text again") for i in range(50)]
    compare(spark, rows)


def test_very_long_text(spark):
    rng = random.Random(3)
    text = "".join(rng.choice(["ab", " ", "é", "zzz"]) for _ in range(300_000))
    compare(spark, [(i, text[: 200_000 + i]) for i in range(4)], partitions=2)


def test_empty_table(spark):
    compare(spark, [])


def test_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = fim.fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # texts, and requests without texts
