import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest
import xxhash

from lakeweave.llm import decontam, graph, isoforest, kneser_ney, langid, simhash

WORDS = ["alpha", "Beta", "gamma", "été", "x1", "delta", "|", "the", "of", "#tag"]


def texts(n, seed=1, most=60):
    rng = random.Random(seed)
    return [rng.choice([" ", "\n", "  "]).join(rng.choice(WORDS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def frame(spark, rows):
    """Documents with other columns whose names operators use inside."""
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as fp", "true as kept", "2L as id", "'k' as key", "0.5D as score")


# ---- decontamination


def brute_hits(text, items, size):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, hit, found = words.findall(low(text)), set(), set()
    for name, item in items:
        v = words.findall(low(item))
        n = min(size, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for k in range(len(w) - n + 1):
                if w[k : k + n] == v[i : i + n]:
                    hit |= set(range(k, k + n))
                    found.add(name)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, block_bytes):
    items = [(1, "alpha beta gamma delta"), (2, "the of"), (10, "x1"), (3, None), (None, "été alpha x1"), (1, "gamma gamma gamma gamma"), (4, ""), (5, "alpha beta gamma delta")]
    docs = [(i, t) for i, t in enumerate(texts(120))] + [(None, "the of the"), (7, None), (7, "")]
    found = decontam.judge(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 3, 4, block_bytes=block_bytes).collect()
    named = [("" if i is None else str(i), t) for i, t in items]
    want = []
    for i, t in docs:
        n, hit, names = brute_hits(t, named, 3)
        want.append((str(i), n, hit, names, hit > 0 and 4 * hit >= n))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in found) == sorted(want)


def test_benchmark_blocks_are_compact_and_seen_one_by_one(spark):
    import pickle

    rng = random.Random(5)
    items = [(str(i), " ".join("%x" % rng.randrange(1 << 20) for _ in range(400)).encode()) for i in range(400)]
    text = sum(len(t) for _, t in items)
    assert len(pickle.dumps(decontam.Windows(items, 13))) < 12 * text
    docs = [(i, " ".join(t.decode().split()[k : k + 30])) for i, (_, t) in enumerate(items) for k in (0, 200)] + [(-1, "x " * 300_000 + items[3][1].decode())]
    bench = spark.createDataFrame([(int(i), t.decode()) for i, t in items], "item_id long, text string")
    clashing = frame(spark, docs).withColumns({c: F.lit("1") for c in ("__hit", "__found", "items")})
    got = decontam.judge(clashing, bench, 13, 20, block_bytes=text // 7).collect()
    assert all(r["n_hit"] == (30 if r["doc_id"] >= 0 else 400) and r["items"] == [str(r["doc_id"] if r["doc_id"] >= 0 else 3)] for r in got)
    kept = decontam.decontaminate(clashing, bench, 13, 20, block_bytes=text // 7)
    assert kept.columns == clashing.columns and [r["doc_id"] for r in kept.collect()] == [-1]


def test_decontamination_removes(spark):
    bench = spark.createDataFrame([(1, "the of alpha")], "item_id long, text string")
    docs = frame(spark, [(1, "Say: THE of, alpha! and more words that are not hit at all"), (2, "the of alpha"), (3, None), (4, "clean")])
    cut = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, bench, 3, 2, remove="spans").collect()}
    assert cut == {1: "Say:  ,  and more words that are not hit at all".replace(":  ,  ", ":  , ! "), 2: "  ", 3: None, 4: "clean"}
    kept = decontam.decontaminate(docs, bench, 3, 2)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4}
    assert decontam.decontaminate(docs, bench.where("false")).count() == 4
    assert decontam.judge(docs.where("false"), bench).count() == 0


# ---- quality rules


def test_rule_counts(spark):
    rows = list(enumerate(texts(150, 2, 80))) + [(None, None), (1, ""), (1, " \n\t"), (2, "a b c d e a b c d e"), (3, "x " * 5000)]
    got = isoforest.judge(frame(spark, rows), isoforest.Rules(None, 1.0)).collect()
    want = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
        c, hit = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
        for k in range(len(w) - 4):
            if c[tuple(w[k : k + 5])] > 1:
                hit |= set(range(k, k + 5))
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed, not failed))
    assert sorted((str(r["doc_id"]), *(r[c] for c in isoforest.COUNTS), r["base_failed"], r["kept"]) for r in got) == sorted(want)


def test_forest_finds_what_is_far():
    rng = np.random.default_rng(0)
    good, far = rng.normal(0, 1, (2000, 4)), rng.normal(0, 1, (50, 4)) + 12
    forest = isoforest.Forest(good[:1000])
    assert np.quantile(forest.score(good[1000:]), 0.99) < forest.score(far).min()


def test_rules_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = isoforest.fit(docs, labels)
    kept = isoforest.keep_good(docs, rules)
    assert kept.columns == docs.columns
    by = {(r["quality"], r["toxic"]): r["share"] for r in labels.join(kept.select("doc_id", F.lit(1).alias("k")), "doc_id", "left").groupBy("quality", "toxic").agg(F.avg(F.coalesce("k", F.lit(0))).alias("share")).collect()}
    assert by[(1, 0)] > 0.96 and by[(0, 0)] < 0.15
    assert isoforest.fit(docs, labels.where("false")).forest is None
    assert isoforest.judge(docs.where("false"), rules).count() == 0


# ---- perplexity


def brute_kn(texts, order, scored):
    """Cross entropy of whole texts under interpolated modified Kneser-Ney over bytes, from the definition."""
    marked = lambda t: b"\n" + b" ".join(t.encode().split()) + b"\n"
    raw, grams = collections.Counter(), collections.defaultdict(collections.Counter)
    for s in map(marked, texts):
        for i in range(1, len(s)):
            raw[s[max(0, i + 1 - order) : i + 1]] += 1
    for g, n in raw.items():
        grams[len(g)][g] += n
    for k in range(order - 1, 0, -1):
        left = collections.Counter(x[1:] for x in grams[k + 1])
        grams[k].update(left)
    cuts = {}
    for k, c in grams.items():
        n = collections.Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [max(0.05, min(0.95 * i, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else max(0.05, min(0.95 * i, 0.5 * i)) for i in (1, 2, 3)]
        cuts[k] = lambda a, d=d: d[min(a, 3) - 1]
    rows = collections.defaultdict(dict)
    for k, c in grams.items():
        for g, a in c.items():
            rows[k, g[:-1]][g] = a

    def p(g):
        if not g:
            return 1 / 256
        k, row = len(g), rows.get((len(g), g[:-1]))
        if not row:
            return p(g[1:])
        total = sum(row.values())
        own = (row[g] - cuts[k](row[g])) / total if g in row else 0
        return own + sum(map(cuts[k], row.values())) / total * p(g[1:])

    out = []
    for s in map(marked, scored):
        out.append(-sum(math.log(p(s[max(0, i + 1 - order) : i + 1])) for i in range(1, len(s))) / (len(s) - 1))
    return out


def is_held(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    return {r["id"] for r in df.where(F.pmod(F.xxhash64("id"), F.lit(10)) == 0).collect()}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    docs = [(i, rng.choice([" ", "\n", " \t "]).join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(400)]
    docs += [(7000, None), (7001, " \n"), (7002, "zé qq " * 3), (None, "lost " + words[0]), (3, "twice " + words[1]), (3, "twice " + words[1])]
    labels = [(i, 1, 0) for i in range(300)] + [(7, 0, 0), (9, 1, 1), (None, 1, 0)]
    return docs, labels, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("shard_rows", "block_bytes"), [(10**9, 1 << 20), (60, 300)])
def test_kneser_ney_equals_its_definition(spark, spoken, shard_rows, block_bytes):
    """Perplexity, limit and verdict of whole documents; the same for one shard and block as for many."""
    docs, _, labels = spoken
    df = frame(spark, docs).withColumn("part", F.lit(1)).withColumn("block", F.lit("x"))
    model = kneser_ney.fit(df, labels, order=4, lose=0.1, least_docs=10**6, shard_rows=shard_rows, block_bytes=block_bytes)
    trusted = [(i, t) for i, t in docs if i is not None and i < 300 and i not in {7, 9}]
    held = is_held(spark, {i for i, _ in trusted})
    trained = [t for i, t in trusted if i not in held]
    fine = [(i, t) for i, t in docs if t and t.strip()]
    want = dict(zip(map(str, fine), brute_kn(trained, 4, [t for _, t in fine]), strict=True))
    levels = sorted(math.floor(want[str(x)] * kneser_ney.STEPS) for x in trusted if x[0] in held)
    limit = (levels[math.ceil(0.9 * len(levels)) - 1] + 1) / kneser_ney.STEPS
    assert model.limits == {"": pytest.approx(limit)}
    got = kneser_ney.judge(df, model, block_bytes=block_bytes).join(df.select("doc_id", "text").distinct(), "doc_id").where("doc_id <> 3").collect()
    assert len(got) == len([x for x in docs if x[0] not in (3, None)])
    for r in got:
        h = want.get(str((r["doc_id"], r["text"])))
        if h is None:
            assert r["perplexity"] is None and not r["kept"]
        else:
            assert r["perplexity"] == pytest.approx(math.exp(h), rel=1e-4) and r["n_bytes"] == len(" ".join(r["text"].split()).encode()) + 1
            assert r["kept"] == (h <= limit) or abs(h - limit) < 1e-4
    kept = kneser_ney.keep_good(df, model, block_bytes=block_bytes)
    judged = kneser_ney.judge(df, model, block_bytes=block_bytes).where("kept")
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in judged.collect())
    assert kneser_ney.judge(df, model).count() == len(docs) and kneser_ney.judge(df.where("false"), model).count() == 0


def test_word_order_changes_perplexity(spark):
    rng = random.Random(2)
    ordered = lambda: " ".join(["one", "two", "three", "four", "five", "six"] * rng.randint(2, 4))
    docs = [(i, ordered()) for i in range(300)]
    mixed = [(1000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in docs[:40]]
    df = frame(spark, docs + mixed)
    model = kneser_ney.fit(df, spark.createDataFrame([(i, 1, 0) for i, _ in docs], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["perplexity"] for r in kneser_ney.judge(df, model).collect()}
    assert min(got[1000 + i] / got[i] for i in range(40)) > 1.3


def test_very_long_texts_are_scored_in_runs(spark, monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice(WORDS) for _ in range(3000))
    whole = [np.concatenate(x) for x in zip(*kneser_ney.ngrams([None, text.encode(), b" ", b"ab  c"], 5), strict=True)]
    monkeypatch.setattr(kneser_ney, "RUN", 100)
    runs = [np.concatenate(x) for x in zip(*kneser_ney.ngrams([None, text.encode(), b" ", b"ab  c"], 5), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, runs, strict=True))
    assert np.bincount(whole[0]).tolist() == [0, len(text.encode()) + 1, 0, 5]


def test_quality_classifier_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = kneser_ney.fit(docs, labels)
    kept = kneser_ney.keep_good(docs, model)
    assert kept.columns == docs.columns
    share = labels.join(kept.select("doc_id", F.lit(1).alias("k")), "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("k", F.lit(0))).alias("share"))
    by = {r["quality"]: r["share"] for r in share.collect()}
    assert by[1] > 0.96 and by[0] < 0.25
    empty = kneser_ney.fit(docs, labels.where("false"))
    assert kneser_ney.keep_good(docs, empty).count() == docs.where("trim(text) <> ''").count() == kneser_ney.judge(docs, empty).where("kept").count()


def test_limits_of_languages_equal_their_definition(spark):
    """Models of languages one by one; their limits from their own held-out documents and the shape of all."""
    rng, docs = random.Random(14), []
    for lang, letters, n in (("aa", "abc", 300), ("bb", "bcdé", 120), ("cc", "xyz", 60)):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(40)]
        docs += [(len(docs) + i, " ".join(rng.choice(words) for _ in range(rng.randint(2, 12))), lang) for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in docs], "doc_id long, quality int, toxic int")
    model = kneser_ney.fit(df, labels, order=3, lose=0.05, prior=20, block_bytes=500)
    held = is_held(spark, {i for i, _, _ in docs})
    steps = {}
    for lang in ("aa", "bb", "cc"):
        own = [(i, t) for i, t, x in docs if x == lang]
        h = brute_kn([t for i, t in own if i not in held], 3, [t for i, t in own if i in held])
        steps[lang] = sorted(math.floor(x * kneser_ney.STEPS) for x in h)
    assert min(map(len, steps.values())) >= 3
    middle = {lang: x[math.ceil(len(x) / 2) - 1] for lang, x in steps.items()}
    away = sorted(x - middle[lang] for lang, some in steps.items() for x in some)
    top = away[math.ceil(0.9 * len(away) - 1e-9) - 1]
    body, over = [x for x in away if x <= top], [x - top for x in away if x > top]
    n, excess = kneser_ney.TAIL_POINTS, float(np.median(over)) / math.log(2)
    shape = [(x, 18 / len(body)) for x in body] + [(top - excess * math.log((k + 0.5) / n), 2 / n) for k in range(n)]
    for lang, some in steps.items():
        stretch = math.sqrt(1 + math.pi / (2 * len(some)))
        mass = sorted([(x - middle[lang], 1.0) for x in some] + [(x * stretch, w) for x, w in shape])
        reach = 0.0
        for x, w in mass:
            reach += w
            if reach >= 0.95 * (len(some) + 20) - 1e-9:
                break
        assert model.limits[lang] == pytest.approx((middle[lang] + x + 1) / kneser_ney.STEPS, abs=0.0025)
    got = {r["lang"]: r["threshold"] for r in kneser_ney.judge(df, model, block_bytes=500).join(df.drop("text"), "doc_id").select("lang", "threshold").distinct().collect()}
    assert got == {lang: pytest.approx(math.exp(model.limits[lang])) for lang in steps}


def test_a_language_keeps_its_own_quantile_as_it_grows_and_the_shape_of_all_where_it_is_small():
    many = np.arange(1000, 2000), np.ones(1000, int)
    limits = kneser_ney.limits_of({"": many, "en": (many[0] * 2, many[1] * 1000), "fr": (np.array([500]), np.array([1]))}, 0.01)
    assert limits[""] == (1989 + 1) / kneser_ney.STEPS
    assert limits["en"] == pytest.approx(3979 / kneser_ney.STEPS, abs=0.003)
    assert 1.2 < limits["fr"] < 2.5  # its one document, and how far those of all lie from the middle
    assert kneser_ney.limits_of({}, 0.01) == {} and kneser_ney.limits_of({"": many}, 0.01).keys() == {""}


def test_every_language_of_a_small_table_has_its_own_limit(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = kneser_ney.fit(docs, labels)
    assert set(model.served()) == {"", "de", "en", "es", "fr"} and len(set(model.limits.values())) == 5


def test_equal_rows_are_dealt_over_all_blocks(spark):
    """A text that half of the rows share: no block has more than its part, and all copies have one verdict."""
    rng = random.Random(3)
    docs = [(1, "the same text again and again", "en")] * 10_000 + [(i, " ".join(rng.choice(WORDS) for _ in range(6)), "en") for i in range(2, 2000)]
    code = np.array([7, 7, 9, 7], np.uint64)
    seen: dict[int, int] = {}
    assert kneser_ney._earlier(code, seen).tolist() == [0, 1, 0, 2] and kneser_ney._earlier(code, seen).tolist() == [3, 4, 1, 5] and seen == {7: 6, 9: 2}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(2)
    packed = df.select("*", kneser_ney.row_hash(df).alias("h")).mapInArrow(lambda b: kneser_ney._pack(b, 16), "block long, data binary")
    rows = packed.rdd.map(lambda r: (r["block"], sum(1 for b in pa.ipc.open_stream(r["data"]) for x in b.column("doc_id").to_pylist() if x == 1))).reduceByKey(lambda a, b: a + b).collect()
    assert len(rows) == 16 and sum(n for _, n in rows) == 10_000 and max(n for _, n in rows) <= 10_000 // 16 + 2
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 1000)], "doc_id long, quality int, toxic int")
    model = kneser_ney.fit(df, labels, block_bytes=20_000)
    judged = kneser_ney.judge(df, model, block_bytes=20_000)
    assert judged.count() == len(docs) and judged.where("doc_id = 1").select("perplexity", "kept").distinct().count() == 1


def test_languages_without_a_limit_of_their_own_use_the_model_of_all(spark):
    rng = random.Random(8)
    plain = lambda: " ".join(rng.choice(["the", "house", "of", "stone", "und", "wasser", "rivers"]) for _ in range(40))
    ids = spark.range(2000).select("id", (F.pmod(F.xxhash64("id"), F.lit(10)) == 0).alias("held")).collect()
    unheld = [r["id"] for r in ids if not r["held"]][:30]
    good = [(i, plain(), "fr") for i in unheld] + [(i, plain(), rng.choice(["en", "de"])) for i in range(2000, 2600)]
    junk = ["qzx0 #@!7 zzkq vvx9 " * 10] * 3
    tried = [(-1, junk[0], None), (-2, junk[1], "xx"), (-3, junk[2], "fr"), (-4, "the house of stone und wasser " * 6, None), (-5, "the house of stone und wasser " * 6, "fr"), (-6, "the house of stone und wasser " * 6, "xx")]
    docs = spark.createDataFrame(good + tried, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good], "doc_id long, quality int, toxic int")
    model = kneser_ney.fit(docs, labels)
    assert model.languages == {"de", "en", "fr"} and {"", "de", "en"} == set(model.limits) == set(model.served())
    rows = {r["doc_id"]: r["kept"] for r in kneser_ney.judge(docs, model).where("doc_id < 0").collect()}
    assert rows == {-1: False, -2: False, -3: False, -4: True, -5: True, -6: True}
    assert {r["doc_id"] for r in kneser_ney.keep_good(docs, model).where("doc_id < 0").collect()} == {-4, -5, -6}


# ---- near-duplicates


def brute_fingerprint(t, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x] = up[up[x]]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark):
    rng = random.Random(8)
    base = texts(40, 3, 200)
    rows = []
    for i in range(160):
        t = base[rng.randrange(40)].split(" ")
        if t and rng.random() < 0.5:
            t[rng.randrange(len(t))] = "changed"
        rows.append((i, " ".join(t)))
    rows += [(None, base[0]), (500, None), (501, ""), (502, " \n"), (503, "one"), (503, "one")]
    fps = {k: brute_fingerprint(t) for k, (_, t) in enumerate(rows)}
    linked = [(a, b) for a in fps for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    group = roots(fps, linked)
    least = {}
    for k, r in group.items():
        if (i := rows[k][0]) is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(rows[k][0]), f"{fps[k]:016x}", least[group[k]]) for k in fps)
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    clashing = frame(spark, rows).withColumns({c: F.lit(1) for c in ("kept_id", "KEPT_hash", "root", "node")})
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(frame(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_trees_link_what_brute_force_links(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64) * 2 + 1
    f = base[rng.integers(0, len(base), 900)]
    for _ in range(int(rng.integers(0, 5))):
        f = f ^ (np.uint64(1) << rng.integers(0, 64, len(f), dtype=np.uint64))
    if seed % 3 == 0:  # a hot half
        f[:500] = f[:500] & np.uint64(0xFFFFFFFF00000000) | np.uint64(77)
    f = np.unique(f)
    want = simhash.Stars(len(f))
    want.link(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3))
    for depth in (0, 3, 6):
        got = simhash.Stars(len(f))
        for half in (0, 1):
            tree = simhash.Tree(f[:300], half, depth)
            at, leaf, home = tree.deal(f, 3)
            assert sorted(at[home]) == list(range(len(f)))
            if seed % 3 == 0 and depth == 6:
                assert np.bincount(leaf[home]).max() < 200
            for k in range(tree.leaves):
                own = at[leaf == k]
                stars = simhash.Stars(len(own))
                simhash.search(f[own], home[leaf == k], half, 3, stars)
                got.link(own, own[stars.label])
        assert (got.label == want.label).all()


def test_links_over_many_shards(spark):
    rng = np.random.default_rng(3)
    f = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for b in rng.integers(0, 2**63, 60, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    got = {(r["node"]): r["root"] for r in graph.components(simhash.link(df, 3, sample=400, shard=64)).collect()}
    s = f.view(np.int64).tolist()
    want = roots(s, [(s[i], s[j]) for i, j in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3), strict=True)])
    assert all(got.get(x, x) == want[x] for x in s)


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 7), (200, 201), (300, 300), (201, 200)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 0, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- language


def test_languages(spark):
    sf = "/root/testdata/sf0.01"
    docs, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages"))
    model = langid.fit(docs)
    got = {r["id"]: r["language"] for r in langid.identify(langid.from_pages(pages), model).collect()}
    truth = {r["page_id"]: r["x"] for r in pages.select("page_id", F.regexp_extract("url", "example.[a-z]+/([a-z]+)/", 1).alias("x")).collect()}
    assert len(got) == len(truth) and np.mean([got[i] == x for i, x in truth.items()]) > 0.97
    # without declarations and addresses the text still decides
    bare = langid.from_pages(pages).withColumns({"declared": F.lit(None).cast("string"), "host": F.lit(None).cast("string"), "suffix": F.lit(None).cast("string")})
    alone = {r["id"]: r["language"] for r in langid.identify(bare, model).collect()}
    assert np.mean([alone[i] == x for i, x in truth.items()]) > 0.9


def test_evidence_is_weighed(spark):
    model = langid.Languages.of([("aa", b"aba aba baa"), ("bb", b"xyz zyx yxz")])
    schema = "id long, text string, markup boolean, declared string, suffix string, host string"
    rows = [(i, "aba aba" if i % 2 else "xyz zyx", True, "A" if i % 2 else "B", None, "h1" if i % 2 else "h2") for i in range(40)]
    rows += [(100, None, True, "A", None, None), (101, "", True, None, None, "h2"), (102, None, True, None, None, None), (None, "aba", True, None, "com", "h2")]
    got = {r["id"]: r for r in langid.identify(spark.createDataFrame(rows, schema), model).collect()}
    assert got[100]["language"] == "aa" and got[101]["language"] == "bb" and got[102]["text_language"] is None
    assert all(0 < r["posterior"] <= 1 + 1e-9 for r in got.values()) and len(got) == 44
    none = langid.identify(spark.createDataFrame(rows, schema), langid.Languages([])).first()
    assert none["language"] is None
    assert langid.identify(spark.createDataFrame([], schema), model).count() == 0


def test_visible_text():
    html = b"<html><script>var t='</p>';</script><style>p{}</style><!-- x --><p class=a>Hi <b>you</b></p>"
    assert langid.visible(html).split() == [b"Hi", b"you"]
    assert langid.visible(b"a <script> b <i>c</i> <!-- d") == b"a   b  c  <!-- d" and langid.visible(b"1 < 2") == b"1 < 2"


@pytest.mark.parametrize("hostile", [b"<script", b"<!--", b"<style>", b"<", b"<!-- <script> "])
def test_a_hostile_page_takes_one_pass(hostile):
    import time

    began = time.time()
    langid.visible(hostile * ((1 << 20) // len(hostile)))
    assert time.time() - began < 5


def test_posteriors_equal_their_definition(spark):
    """All kinds of evidence by plain loops, the row's own part of its host's prior taken out."""
    rng = random.Random(12)
    model = langid.Languages.of([("aa", b"aba aba baa"), ("bb", b"xyz zyx yxz"), ("cc", b"kiki koko kuku")])
    rows = []
    for i in range(150):
        text = " ".join(rng.choice(["aba", "xyz", "kiki", "zyx", "koko"]) for _ in range(rng.randint(0, 4)))
        host = rng.choice(["a.x.de", "b.x.de", "x.de", "y.com", None])
        rows.append((i, text or None, True, rng.choice(["A", "B", None]), host and host.rsplit(".", 1)[1], host))
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "id long, text string, markup boolean, declared string, suffix string, host string").withColumns({c: F.lit("1") for c in ("logs", "score", "base", "lang")})
    own = [np.exp(e := model.evidence(t and t.encode())) / np.exp(e).sum() for _, t, *_ in rows]
    total = sum(own)
    base = (total + 1) / (total.sum() + 3)
    domain = lambda h: ".".join(h.split(".")[-2:])

    def rate(k, value):
        s = sum((p for p, r in zip(own, rows, strict=True) if r[k] == value), np.zeros(3))
        return np.log((s + 0.01) / (total + 1))

    want = []
    for p, (i, t, _, declared, suffix, host) in zip(own, rows, strict=True):
        score = model.evidence(t and t.encode()) + (rate(3, declared) if declared else 0) + (rate(4, suffix) if suffix else 0)
        prior = base
        if host:
            near = sum(q for q, r in zip(own, rows, strict=True) if r[5] and domain(r[5]) == domain(host))
            near = (near + 32 * base) / (near.sum() + 32)
            same = sum(q for q, r in zip(own, rows, strict=True) if r[5] == host)
            prior = (same - p + 8 * near) / (same.sum() - 1 + 8)
        score = score + np.log(prior)
        post = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        want.append((i, model.names[int(np.argmax(score))], round(float(post.max()), 6)))
    got = [(r["id"], r["language"], round(r["posterior"], 6)) for r in langid.identify(df, model).collect()]
    assert sorted(got) == sorted(want)


def test_many_languages_all_have_a_model(spark):
    docs = spark.createDataFrame([(100 * k + i, f"w{k}x w{k}y " * 5, f"l{k:03d}") for k in range(90) for i in range(4)], "doc_id long, text string, lang string")
    assert len(langid.fit(docs).names) == 90
    some = langid.fit(docs, sample=2)
    assert some.names == langid.fit(docs.orderBy(F.desc("doc_id")), sample=2).names


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_every_row_grows_a_tree():
    rng, roots = np.random.default_rng(2), {}
    x, keys = rng.normal(0, 1, (7001, 8)), np.arange(7001)
    x[6500] = 50.0
    forest = isoforest.Forest()

    def ask(f):
        found = isoforest._merge([f.statistics(x[k], k, f.share(len(x))) for k in np.array_split(keys, 7)])
        roots.update({k: v for k, v in found.items() if k[1] == 0})
        return found

    forest.grow(ask, len(x), trees=20, rows=16)
    assert sum(n for n, _, _ in roots.values()) == 7001 and max(high.max() for _, _, high in roots.values()) == 50.0
    again = isoforest.Forest()
    again.grow(lambda f: f.statistics(x, keys, f.share(len(x))), len(x), trees=20, rows=16)
    assert (again.score(x) == forest.score(x)).all()


def test_score_of_a_rank_is_exact(spark):
    x = np.random.default_rng(3).random(3000).round(3)
    scores = spark.createDataFrame([(float(v),) for v in x], "score double")
    assert [isoforest._kth(scores, k, 16) for k in (0, 1500, 2999)] == [float(np.sort(x)[k]) for k in (0, 1500, 2999)]
