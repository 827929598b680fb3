import random
import zlib

import numpy as np
import pytest

from lakeweave.llm import packing, repair
from lakeweave.llm.tokens import UnitEncoder, public_path

ODD = ["a  b", "", " a", "a ", "a \n b  ", "don't  stop x \x1c y", "A\tB C", "<|endoftext|> hi <|endoftext|>x", None, "   ", "ĠĠ a Ġb", "e \u0301a", "Σας ΣΑΣ b", "x\n\ny\nz", "word. Word, WORD.", "one one  one one one ", "", " one one one  "]
ALPHABET = ["a", "B", " ", "\u00a0", "\n", "\t", ".", ",", "'s", "é", "\u3000", "1", "日", "\x1c", "\r", "word", "Ġ", "\ue000", "İ", "Σ", "ß", "e\u0301"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    from tokenizers import Tokenizer

    rng, plain = random.Random(5), Tokenizer.from_file(public_path(name))
    own = UnitEncoder(public_path(name), max_units=3000)  # forgets in between
    texts = ODD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    texts += ["".join(rng.choice(ALPHABET[:9]) + " " * rng.choice([1, 1, 1, 2]) for _ in range(60)) for _ in range(500)]
    for k in range(0, len(texts), 500):
        ids, sizes = own.encode(texts[k : k + 500])
        got = np.split(ids, np.cumsum(sizes)[:-1])
        for t, g in zip(texts[k : k + 500], got, strict=True):
            assert g.tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_blocks_come_back_whole_and_in_parts():
    rng = np.random.default_rng(1)
    for _ in range(300):
        ids = rng.integers(0, rng.choice([1, 2, 5, 300]), rng.choice([0, 1, 2, 9, 50, 700])).astype(np.uint32)
        b = repair.Block(repair.pack([None, -3], np.array([len(ids), 0]), ids))
        assert (b.decode() == ids).all() and b.doc_ids == [None, -3] and b.lengths.tolist() == [len(ids), 0]
        for start, end in ((0, 1), (2, 5), (len(ids) // 2, len(ids) + 9)):
            assert (b.decode(start, end) == ids[start:end]).all()


def test_repetition_is_compressed():
    ids = np.tile(np.arange(8, dtype=np.uint32), 4000)
    assert len(repair.pack([1], np.array([len(ids)]), ids)) < len(ids)


def separate(s, least):
    """Pairs that occur ``least`` times or more without overlap."""
    counts, last = {}, {}
    for i, pair in enumerate(zip(s, s[1:])):
        if last.get(pair, -2) < i - 1:
            counts[pair], last[pair] = counts.get(pair, 0) + 1, i
    return {p: n for p, n in counts.items() if n >= least}


@pytest.mark.parametrize("seed", range(60))
def test_grammar_leaves_no_frequent_pair(seed):
    rng = random.Random(seed)
    least, few, n = rng.choice([2, 3, 8]), rng.choice([1, 2, 5, 40]), rng.randint(0, 3000)
    ids = [rng.randrange(few) for _ in range(n)]
    passage = [rng.randrange(40) for _ in range(rng.randint(2, 300))]
    for _ in range(rng.randint(0, 20)):
        k = rng.randint(0, len(ids))
        ids[k:k] = passage
    s, rules, first = repair.compress(np.array(ids, np.uint32), least=least)
    assert not separate(s.tolist(), least)
    said = [[i] for i in range(first)]
    for a, b in np.concatenate([*rules, np.zeros((0, 2), np.uint32)]).astype(int).tolist():
        said.append(said[a] + said[b])
    assert [x for i in s.tolist() for x in said[i]] == ids
    data = repair.pack([7], np.array([len(ids)]), np.array(ids, np.uint32))
    block = repair.Block(data)
    assert block.decode().tolist() == ids and block.decode(5, 70).tolist() == ids[5:70]


def test_grammar_reaches_long_copies_and_pairs_that_share_a_slot():
    rng = np.random.default_rng(3)
    copies = np.tile(rng.integers(0, 50_000, 1000), 16).astype(np.uint32)
    s, rules, _ = repair.compress(copies)
    assert len(s) < 64 and len(rules) > 3
    many = np.concatenate([np.repeat(rng.integers(0, 2**20, (20_000, 2)), 8, axis=0).reshape(-1), rng.integers(0, 2**20, 200_000)]).astype(np.uint32)
    s, _, _ = repair.compress(many)
    assert not separate(s.tolist(), repair.LEAST)


def test_token_files(spark, tmp_path):
    rows = [(5, "a b"), (None, "null id"), (3, None), (5, "again a b"), (2, ""), (5, "a b")] + [(i, f"text {i} " * (i % 9)) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "'x' as data", "2 as block").repartition(3)
    out = str(tmp_path / "ids")
    repair.write_tokens(docs, out, public_path("byte_bpe_50k.json"), 2, block_tokens=40)
    got = repair.read_digests(spark, out).orderBy("start").collect()
    own = UnitEncoder(public_path("byte_bpe_50k.json"))
    crc = lambda t: zlib.crc32(np.append(own.encode([t])[0], 2).astype("<u4").tobytes())
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == sorted((str(i), crc(t)) for i, t in rows)
    repair.write_tokens(docs.where("false"), out + "0", public_path("byte_bpe_50k.json"), 2)
    assert repair.read_digests(spark, out + "0").count() == 0


@pytest.mark.parametrize("seed", range(150))
def test_plan_places_every_piece(seed):
    rng = random.Random(seed)
    capacity, counts, spans, placed = rng.choice([5, 12, 30, 64]), {}, {}, {}
    for _ in range(rng.randint(0, 200)):
        n = rng.randint(1, capacity)
        counts[n] = counts.get(n, 0) + 1
    rows, used = packing.plan(counts, capacity)
    for n, rank, pieces, first, offset, each in rows.tolist():
        for k in range(pieces):
            placed.setdefault(n, []).append(rank + k)
            spans.setdefault(first + k // each, []).append((offset + k % each * n, n))
    assert {n: sorted(r) for n, r in placed.items()} == {n: list(range(c)) for n, c in counts.items()}
    assert sorted(spans) == list(range(used))
    for s in spans.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= capacity and sum(n > capacity / 3 for _, n in s) <= 2


def test_packing(spark):
    rows = [(1, "hello world " * 40), (None, None), (2, ""), (2, ""), (3, "x y z")] + [(10 + i, "word " * (i % 30)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as length", "3 as rank").repartition(3)
    got = packing.pack_documents(docs, public_path("word_bpe_49k.json"), 0, 32).collect()
    short = packing.pack_documents(docs, public_path("word_bpe_49k.json"), 0, 32, keep_units=False).collect()
    assert sorted(map(str, short)) == sorted(map(str, got))
    own = UnitEncoder(public_path("word_bpe_49k.json"))
    total = sum(len(own.encode([t])[0]) + 1 for _, t in rows)
    assert sum(r["length"] for r in got) == total
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] == 1:
            ids = np.append(own.encode([rows[0][1]])[0], 0)[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"] and r["start"] == 32 * r["piece"]
    for s in by.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= 32
    assert len(by) <= -(-total // 32) + 1
    assert packing.pack_documents(docs.where("false"), public_path("word_bpe_49k.json"), 0).count() == 0
