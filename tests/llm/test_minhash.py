import random

import numpy as np
import pytest

from lakeweave.llm import minhash


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join("\n" if c in " \t\n\v\f\r" else c for c in low).split("\n") if w]
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows, percent=85):
    """(doc_id, n, component) of each row, ids being unique."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        r = find(k)
        least[r] = min(least.get(r, doc_id), doc_id)
    return [(doc_id, len(sets[k]), least[find(k)]) for k, (doc_id, _) in enumerate(rows)]


def near_copies(bases, copies, seed=5, words=120):
    """Texts in groups: each is a base with a share of its words changed, from none to a tenth."""
    rng, rows = random.Random(seed), []
    for b in range(bases):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(words)]
        for k in range(copies):
            text, most = list(base), rng.choice([0, 1, 2, 3, 4, 6, 12])
            for _ in range(most):
                text[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
            rows.append((1000 * b + k, " ".join(text).upper() if rng.random() < 0.2 else " ".join(text)))
    rng.shuffle(rows)
    return rows


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as n", "'x' as labels", "3 as family", "'y' as part", "4 as own_id")
    return minhash.near_duplicates(docs, **options).collect()


def compare(spark, rows, **options):
    found = run(spark, rows, **options)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(brute(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_equals_brute_force(spark):
    compare(spark, near_copies(40, 8) + [(10**6 + k, f"word{k} word{k + 1}") for k in range(20)])


@pytest.mark.parametrize("options", [{"block": 7}, {"block": 4, "most": 3, "crowd": 5}, {"shingles": 500}])
def test_small_blocks_give_the_same(spark, options):
    compare(spark, near_copies(3, 50) + near_copies(5, 3, 6), **options)


def test_equal_labels_beyond_all_levels_meet_at_their_centre(spark):
    base = [f"w{k}" for k in range(5000)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(40)]
    assert {r["component_id"] for r in run(spark, rows, block=2, most=1)} == {0}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (8, "two one"), (9, "a b c"), (10, "a b c d"), (11, "A\x0bB\x0cC")]
    compare(spark, rows)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (7, "other text here"), (None, None), (None, "alone as can be")]
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in run(spark, rows))
    assert found == sorted([("None", 2, "7", False)] * 2 + [("7", 2, "7", True)] * 2 + [("7", 1, "7", True), ("None", 0, "None", True), ("None", 2, "None", True)])


def test_many_copies_are_one_node(spark):
    rows = [(k, "the very same text in all of these rows") for k in range(3000)] + [(9000, "another text that is not like it")]
    found = run(spark, rows)
    assert sum(r["component_id"] == 0 for r in found) == 3000 and sum(r["kept"] for r in found) == 2


def test_very_long_texts(spark):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(150_000)]
    compare(spark, [(1, " ".join(words)), (2, " ".join(words[:140_000])), (3, " ".join(words[:100_000])), (4, " ".join(words[60_000:]))])


def test_empty_table(spark):
    assert run(spark, []) == []


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 0.95):
        both = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both[: int(1000 * share)], rng.integers(0, 1 << 63, int(500 * (1 - share)), dtype=np.uint64)])) for _ in range(2))
        jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = (minhash.signature(a).view(np.uint8) == minhash.signature(b).view(np.uint8)).mean()
        assert abs(same - jaccard) < 0.1


def test_common_bytes():
    a = np.array([0, 1, -1, 1 << 56, 0x0102030405060708], np.int64)
    b = np.array([0, 0, 0, 0, 0x0102030405060707], np.int64)
    assert minhash._common_bytes(a, b).tolist() == [8, 7, 0, 0, 7]


def test_links_at_the_limit_are_kept(spark):
    words = [f"w{k}" for k in range(202)]
    text = " ".join(words)
    near = " ".join(words[:17] + [f"w{k}" for k in range(17, 202)][:153])
    n, m = len(shingles(text)), len(shingles(near))
    both = len(shingles(text) & shingles(near))
    assert (100 * both >= 85 * (n + m - both)) == ({r["component_id"] for r in run(spark, [(1, text), (2, near)])} == {1})


@pytest.mark.parametrize("block", [2, 5])
def test_links_that_regions_take_apart_are_found(spark, block):
    """All labels are the same, so only the smallest document and chance meet the others of a region."""
    sets = [np.arange(1000 * (k // 4), 1000 * (k // 4) + 100 + k % 4, dtype=np.uint64) for k in range(60)]
    members = spark.createDataFrame([(k, 1, len(s), [0] * minhash.TREES) for k, s in enumerate(sets)], "node long, family long, n long, labels array<long>")
    rows = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "node long, shingles binary")
    roots = {r["node"]: r["root"] for r in minhash.links(members, rows, 85, block=block, most=1).collect()}
    assert roots == {k: k - k % 4 for k in range(60)}
    apart = minhash.deal(members, block=block, most=1).join(rows, "node").groupBy("part", "low", "high").applyInArrow(minhash._compare(85), minhash.LINK)
    assert {r["node"]: r["root"] for r in minhash.components(apart).collect()} != roots
