import math
import random

import pyspark.sql.functions as F
import pytest

from lakeweave.functions import text as T


def value(spark, column, **values):
    schema = {str: "string", float: "double", int: "bigint", list: "array<string>"}
    names = ", ".join(f"{k} {schema[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "norm"), [("5.0", "5"), ("5.00", "5.00"), ("ABC.0", "abc"), ("", ""), (" A ", " a ")])
def test_normalise(spark, raw, norm):
    assert value(spark, T.normalise("s"), s=raw) == norm


@pytest.mark.parametrize("raw", ["", " ", "nan", "None", "NULL", "N/A", "na", "unknown", "-", "unknown_cell"])
def test_missing(spark, raw):
    assert value(spark, T.is_missing(T.normalise(F.trim("s"))), s=raw)


def test_numeric_is_what_float_takes(spark):
    rng = random.Random(3)
    texts = ["1_000", "1e5", "1.0d", "+nan", "inf", "-Infinity", " 5 ", "1f", "", ".", "1__0", "1.", ".5", "0x1"]
    texts += ["".join(rng.choice("0123456789.eE+-_ naif") for _ in range(rng.randint(0, 6))) for _ in range(3000)]

    def ok(t):
        try:
            float(t)
        except ValueError:
            return False
        return True

    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.is_numeric("s").alias("x"), T.as_number("s").alias("n")).collect()
    assert all(r["x"] == ok(r["s"]) for r in rows)
    assert all(not r["x"] or (r["n"] == float(r["s"]) or math.isnan(float(r["s"]))) for r in rows)


@pytest.mark.parametrize(("header", "tokens"), [("myColName2", ["my", "col", "name", "2"]), ("HTTPServer", ["http", "server"]), ("l_order/key 10", ["l", "order", "key", "10"]), ("", [])])
def test_header_tokens(spark, header, tokens):
    assert value(spark, T.header_tokens("s"), s=header) == tokens


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *[0] * len(b)] if not (last := row) else [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("a", "b"), [("kitten", "sitting"), ("é", "e"), ("", ""), ("", "x"), ("same", "same")])
def test_edit_similarity(spark, a, b):
    want = 1.0 if a == b else 0.0 if not a or not b else 1 - levenshtein(a, b) / max(len(a), len(b))
    assert value(spark, T.edit_similarity("a", "b"), a=a, b=b) == pytest.approx(want)


@pytest.mark.parametrize("n", [127, 128, 129])
def test_long_texts_use_grams(spark, n):
    a, b = "ab" * 64 + "c" * (n - 128) if n >= 128 else "ab" * 63 + "c", "ab" * 60
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    want = len(grams(a) & grams(b)) / len(grams(a) | grams(b)) if n > 128 else 1 - levenshtein(a, b) / max(len(a), len(b))
    assert value(spark, T.edit_similarity("a", "b"), a=a, b=b) == pytest.approx(want)


def test_disjoint_tokens_have_the_least_js_similarity(spark):
    assert value(spark, T.js_similarity("a", "b"), a=["x", "y"], b=["z"]) == pytest.approx(1 - math.log(2))
    assert value(spark, T.js_similarity("a", "b"), a=["x"], b=["x"]) == pytest.approx(1)
    assert value(spark, T.js_similarity("a", "b"), a=[], b=["x"]) == 0


def test_ratios(spark):
    assert value(spark, T.safe_ratio("a", "b"), a=2.0, b=4.0) == 0.5
    assert value(spark, T.safe_ratio("a", "b"), a=0.0, b=4.0) == 0
    assert value(spark, T.relative_closeness("a", "b"), a=1.0, b=3.0) == pytest.approx(0.6)
    assert value(spark, T.row_index("s"), s="7.0") == 7 and value(spark, T.row_index("s"), s="x") is None


def test_small_helpers(spark):
    assert value(spark, T.path_token("s"), s="a/b c!") == "a_b_c" and value(spark, T.path_token("s"), s="??") == "item"
    got = value(spark, T.mean_std("s"), s="0.81±0.02")
    assert (got["mean"], got["std"]) == (0.81, 0.02)
    assert value(spark, T.mean_std("s"), s="N/A")["mean"] is None
    assert value(spark, T.json_object("s"), s='```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'
    assert value(spark, T.flag_value("s", "seed"), s="run --seed 7 --x 1") == "7"
    assert value(spark, T.cost_usd("a", "b", 0.15, 0.60), a=1000, b=100) == pytest.approx(0.00021)
    assert value(spark, T.without_sentences("s", ("teacher pool",)), s="Good one. From the teacher pool. Fine.") == "Good one. Fine."


@pytest.mark.parametrize("n", [3, 4])
def test_char_ngrams(spark, n):
    assert value(spark, T.char_ngrams("s", n), s="") == []
    assert value(spark, T.char_ngrams("s", n), s="ab") == ["ab"]
    assert set(value(spark, T.char_ngrams("s", n), s=" ABcab ")) == {"abcab"[i : i + n] for i in range(6 - n)}


def test_long_texts_are_compared_as_they_stand(spark):
    assert value(spark, T.edit_similarity("a", "b"), a="Ab" * 80, b="aB" * 80) == 0.0
    assert value(spark, T.edit_similarity("a", "b"), a="AB" * 80, b="ab" * 80) == 0.0
    assert value(spark, T.edit_similarity("a", "b"), a="x" * 129, b="ab") == 0.0


def test_user_features_use_the_same_edit_similarity():
    import random

    from lakeweave.functions.generated import HELPERS

    edit, rng = HELPERS["normalized_edit_similarity"], random.Random(3)
    for _ in range(60):
        a, b = ("".join(rng.choice("abC") for _ in range(rng.randint(1, 12))) for _ in range(2))
        assert edit(a, b) == pytest.approx(1 - levenshtein(a, b) / max(len(a), len(b)))
    assert edit("AB" * 80, "ab" * 80) == 0.0 and edit("", "a") == 0.0 and edit("", "") == 1.0
