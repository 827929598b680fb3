"""Steps whose tasks must stay as large as they are when tables grow."""

import pytest

from lakeweave.plans import catalog
from lakeweave.sources import shared

SF = "/root/testdata/sf0.001"


def dealt(df):
    """How often the plan deals rows into a number of parts that it was given."""
    return df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM")


def test_parts_grow_with_rows(spark):
    t = spark.range(1000)
    assert shared.parts(t, rows=10) == 100 and shared.parts(t, t, rows=10) == 200 and shared.parts(t) >= 4


def test_names_are_compared_once_and_by_many_tasks(spark):
    assert dealt(catalog.f8_f9_text_similarity(spark, SF)) == 1


def test_texts_are_dealt_out_before_they_are_cut(spark):
    assert dealt(catalog.f10_js_similarity(spark, SF)) == 2


def test_values_are_counted_per_column_and_dealt_by_value(spark):
    counted = catalog.counted(spark, SF)
    assert dealt(counted) == 1
    cells = catalog.cells(spark, SF).groupBy("table_name", "col_idx", "column_name", "raw").agg({"row_idx": "min", "*": "count"}).collect()
    assert sorted((r["table_name"], r["col_idx"], r["column_name"], r["raw"], r["count(1)"], r["min(row_idx)"]) for r in cells) == sorted(map(tuple, counted.collect()))


def test_values_of_wide_columns_meet_in_parts(spark, monkeypatch):
    from lakeweave.operators import atoms

    asked = []
    monkeypatch.setattr(atoms, "parts", lambda *t: asked.append([d.count() for d in t]) or 7)
    values = spark.createDataFrame([(i, str(v)) for i in "ab" for v in range(20)] + [("c", "1")], "id string, v string")
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    assert [tuple(r) for r in atoms.shared_values(pairs, values).collect()] == [("a", "b", 20)] and asked == [[40]]


def test_first_values_are_ranked_in_parts(spark):
    from lakeweave.operators import profile

    cells = spark.range(3000).selectExpr("'t' as table_name", "id as row_idx", "0 as col_idx", "'c' as column_name", "concat('v', id % 2000) as raw")
    found = profile.union_values(cells, 1500)
    assert sorted(r["v"] for r in found.collect()) == sorted(f"v{i}" for i in range(1500))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2


@pytest.mark.parametrize(("name", "times"), [("w5_neighbour_sampling", 2), ("w5_first_hop", 4), ("j9_not_an_edge", 2), ("s18_log_sections", 3)])
def test_edges_and_lines_are_dealt_by_their_number(spark, name, times):
    assert dealt(catalog.QUERIES[name](spark, SF)) >= times


def test_only_rows_in_pairs_are_profiled_and_no_grams_are_stored(spark, monkeypatch):
    from lakeweave.operators import atoms

    seen, real = {}, atoms.written
    monkeypatch.setattr(atoms, "written", lambda df, name: seen.setdefault(name, real(df, name)))
    found = catalog.j4_f6_f13_em_atoms(spark, SF)
    ids = {x for r in catalog.entity_pairs(spark, SF).collect() for x in r}
    assert sorted(r["id"] for r in seen["profiles"].select("id").collect()) == sorted(ids)
    assert not [c for c in seen["profiles"].columns if c.startswith("char")] and dealt(found) >= 4


@pytest.mark.parametrize("letters", ["ab\0", "abcdefghij é😀", None])
def test_shared_grams_are_those_of_brute_force(letters):
    import random

    from lakeweave.functions import grams

    rng = random.Random(5)
    one = lambda: rng.choice(letters) if letters else chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)]))
    text = lambda most: "".join(one() for _ in range(rng.randrange(most)))
    sets = lambda t, n: {t[i : i + n] for i in range(max(len(t) - n + 1, 1))} if t else set()
    a = [text(40) for _ in range(500)]
    b = [t if rng.random() < 0.3 else t[rng.randrange(5) :] + text(6) for t in a]
    for n, found in zip((3, 4), grams.jaccard(a, b), strict=True):
        want = [len(sets(x, n) & sets(y, n)) / len(sets(x, n) | sets(y, n)) if x and y else 0.0 for x, y in zip(a, b, strict=True)]
        assert found.tolist() == want


def test_row_atoms_at_the_edges(spark):
    """A text cut at a blank, a long one against a short one, a row without values, one without a profile, tokens without a weight."""
    from lakeweave.operators import atoms, profile
    from lakeweave.sources import lake

    cut = "y" * (512 - len("col c val x ; col d val ") - 1)
    cells = [("t", 0, "x", f"{cut} z"), ("t", 1, "x", f"{cut}z z"), ("t", 2, "-", ""), ("t", 3, "x", "y")]
    cells = spark.createDataFrame([(t, r, i, h, v) for t, r, *vs in cells for i, (h, v) in enumerate(zip("cd", vs, strict=True))], lake.CELLS)
    rows = profile.entity_rows(cells).selectExpr("concat('t', row_idx) as id", "*")
    text = {r["id"]: r["serial_text"] for r in rows.collect()}
    assert text["t0"].endswith(" ") and len(text["t0"]) == 512 and text["t2"] == ""
    pairs = spark.createDataFrame([("t0", "t1"), ("t0", "t2"), ("t0", "t3"), ("t0", "t9")], "a string, b string")
    names = ["row_serial_edit_similarity", "row_serial_char3_jaccard", "row_token_idf_jaccard", "row_header_jaccard"]
    weights = spark.createDataFrame([("x", 3.0)], "token string, idf double")
    found = {r["b"]: r for r in atoms.entity(pairs, rows, weights, tokens=names).collect()}
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    share = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    for b in ("t1", "t3"):
        assert found[b][names[0]] == share(text["t0"], text[b]) and found[b][names[1]] == share(text["t0"].strip(), text[b].strip())
    assert found["t3"][names[2]] == 3 / 6 and found["t1"][names[2]] == 4 / 6
    assert [found["t2"][n] for n in names] == [0, 0, 0, 1] and [found["t9"][n] for n in names] == [0, 0, 0, 0]
    same = atoms.entity(pairs, rows, tokens=["row_serial_char4_jaccard", "row_serial_char4_jaccard", "row_token_idf_jaccard"])
    assert len(same.columns) == 5 and [r[4] for r in same.where("b = 't3'").collect()] == [1 / 4]


def test_lower_headers_have_the_words_of_any_header(spark):
    import pyspark.sql.functions as F

    from lakeweave.functions import text as T

    headers = ["myColName2", "HTTP_x/9", "_ /", "", "é", "a\nb", "a ", "\n", "--", "x y"]
    low = F.lower("s")
    was = F.when(F.size(T.header_tokens(low)) > 0, T.header_tokens(low)).otherwise(T.value_tokens(low))
    rows = spark.createDataFrame([(h,) for h in headers], "s string").select("s", was.alias("was"), T.row_header_tokens("s").alias("now")).collect()
    assert [r["now"] for r in rows] == [r["was"] for r in rows]
