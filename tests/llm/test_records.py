import hashlib
import json
import random
from urllib.parse import urlsplit

import numpy as np
import pytest

from lakeweave.llm import chat, urls, warc

PIECES = ["a", "é", "\r\n", "\r\n\r\n", "WARC/1.1\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n", " ", " xyz" * 40, "\n"]


@pytest.mark.parametrize("block", ["3000", "100000000"])
def test_archives_come_back(spark, tmp_path, block):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}\r\nX: y" + "z" * rng.choice([0, 0, 4000]), None if i % 17 == 0 else "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) + rng.choice(["", "\r\n", "\r\n\r\n"])) for i in range(80)]
    rows += [(2000 + i, "http://long/" + "u" * n, "<p>" * 9) for i, n in enumerate((200_000, 2_990, 70_000))]
    rows += [(1000 + i, None, "Z" * 5000 + "\r\n") for i in range(5)] + [(None, "u", "Q" * 20000), (7, "dup", "W" * 1500), (7, "dup", "W" * 1500)]
    groups = {}
    for i, _, h in rows:
        if len(b := (h or "").encode()) >= 1000:
            groups.setdefault(b, []).append(i)

    def expected(i, h):
        b = (h or "").encode()
        most = max((x for x in groups.get(b, []) if x is not None), default=None)
        again = most is not None and most != i
        return str((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", most if again else None))

    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as n", "'x' as payload").repartition(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        out = str(tmp_path / "warc")
        warc.write_warc(df, out)
        read = warc.read_warc(spark, out, int(block))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")  # splits may change once it has been read
        got = read.collect()
        assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == sorted(expected(i, h) for i, _, h in rows)
        bodies = {(r["page_id"], bytes(r["payload"])) for r in got if r["record_type"] == "response"}
        assert all((i, (h or "").encode()) in bodies for i, _, h in rows if "revisit" not in expected(i, h))
        warc.write_warc(df.where("false"), out + "0")
        assert warc.read_warc(spark, out + "0").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_broken_archives_are_an_error(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, str(tmp_path / "a"))
    (file,) = (tmp_path / "a").glob("part-*")
    data = file.read_bytes()
    for name, broken in (("cut", data[:-40]), ("longer", data + b"more\n"), ("length", data.replace(b"Content-Length: 6", b"Content-Length: 9", 1)), ("headless", data.replace(b"WARC/1.1", b"WARC/0.9", 1))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_bytes(broken)
        with pytest.raises(ValueError, match="do not end where it ends"):
            warc.read_warc(spark, str(tmp_path / name))


def test_pointer_jumping():
    places = np.array([0, 10, 14, 30, 50])
    next_ = np.array([10, 30, 17, 120, 50])  # 14 breaks, 50 ends in itself
    exits, last = warc.jump(next_, places, 100)
    assert exits.tolist() == [120, 120, -1, 120, 50] and last.tolist() == [30, 30, 14, 30, 50]


def test_chat_round_trip(spark):
    said = "<|im_end|>\n<|im_start|>assistant ok \\ \\| <\\| <|"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", ""), (2, 5, "assistant", None), (2, 3, "a\nb<|", "x"), (None, 0, "assistant", "é"), (3, None, None, "t"), (3, 0, "user", "u"), (1, 0, "user", said)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as segment", "2 as content")
    got = {r["conv_id"]: r for r in chat.read_digests(chat.format_chat(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda k: (k[0], k[1].replace("\n", "\\n") + "\n" + chat.escape(k[2]) + chat.STOP))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_digests(chat.format_chat(df.where("false"))).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_escape_is_reversible(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["\\", "|", "<", "<|", "n", "\n", "<|im_end|>", "a"]) for _ in range(30))
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_parts_are_flattened(spark):
    parts = [{"type": "text", "text": "see <|"}, {"type": "image", "ref": "i.png", "width": 57, "height": 28}, {"type": "audio", "ref": "a.wav", "seconds": 2.5}, {"type": None, "text": None}, {"type": "document", "ref": "d.pdf", "pages": 2}]
    df = spark.read.schema(f"conv_id long, turn long, role string, text array<{chat.PART}>").json(spark.sparkContext.parallelize([json.dumps({"conv_id": 1, "turn": 0, "role": "user", "text": parts})]))
    r = chat.format_chat(df).first()
    assert r["segment"] == "<|im_start|>user\nsee <\\|<|image_1|><|audio_2|><|document_3|><|im_end|>\n"
    assert [(a["ordinal"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, "image", "i.png", 3), (2, "audio", "a.wav", 63), (3, "document", "d.pdf", 1024)]


def test_placeholders_are_numbered_through_a_conversation(spark):
    image, odd = {"type": "image", "ref": "i"}, {"type": "video", "ref": "v"}
    rows = [(1, 0, "user", [image, None, image]), (1, 2, "user", [{"type": "text", "text": "t"}, odd]), (1, 1, "assistant", [{"type": "text", "text": "x" * 300_000}]), (2, 0, "user", [image]), (1, 3, "user", None), (1, 4, "user", [image]), (None, 0, "user", [image])]
    text = [json.dumps({"conv_id": c, "turn": t, "role": r, "parts": p}) for c, t, r, p in rows]
    df = spark.read.schema(f"conv_id long, turn long, role string, parts array<{chat.PART}>").json(spark.sparkContext.parallelize(text)).selectExpr("*", "'z' as first", "1 as segment")
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_chat(df, content_col="parts").collect()}
    body = lambda k: got[k]["segment"].split("\n", 1)[1].removesuffix(chat.STOP)
    assert body((1, 0)) == "<|image_1|><|image_2|>" and body((1, 2)) == "t<|other_3|>" and body((1, 4)) == "<|image_4|>" and body((2, 0)) == body((None, 0)) == "<|image_1|>" and body((1, 3)) == ""
    assert [(a["ordinal"], a["kind"], a["tokens"]) for a in got[1, 2]["attachments"]] == [(3, "video", 0)] and len(got) == len(rows) and got[1, 1]["mask_length"] == 300_000


RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def expected(url):
    """Host, path and rule by plain string handling."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    found = ["https://A.Example.COM/en/7?x", "http://example.com/en/8#t", "com://com/en/", "http://xexample.net/de/8", "http://m.example.net/de/81/", "ftp://", "nothing", None, "http://É.org/es/\nq", "http://h?a=/b://c", "http://h#://x/y", "http://examplecom/en/", "x://a://b/c"]
    rows = list(enumerate(found)) + [(None, "http://a.com/en/1"), (0, found[0])]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as score", "'t' as text", "'h' as host"), RULES).collect()
    want = sorted(str((i, *expected(u))) for i, u in rows)
    assert sorted(str((r["page_id"], r["host"], r["path"], r["rule"])) for r in got) == want
    assert all(r["verdict"] == (RULES[r["rule"]] if r["rule"] else "allow") for r in got if r["rule"] or not r["host"])
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_markov_model_sums_to_one():
    keys, counts = np.unique(urls._keys(*urls._joined([b"abc/abd", b"abc"])[:2], 3), return_counts=True)
    model = urls.Markov(keys, counts, 3)
    data = b"".join(b"ab" + bytes([c]) for c in range(256))
    logs = model.logs(np.frombuffer(data, np.uint8), np.arange(0, len(data), 3))
    assert np.exp(logs[2::3]).sum() == pytest.approx(1)


def test_rejected_addresses_are_found(spark):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    good = [f"http://{word('aeiou')}.ok/{word('aeiou')}" for _ in range(400)]
    bad = [f"http://{word('xyzq')}.no/{word('xyzq')}" for _ in range(400)]
    new = [(f"http://{word('aeiou')}.tv/{word('aeiou')}", "allow") for _ in range(100)] + [(f"http://{word('xyzq')}.tv/{word('xyzq')}", "block") for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(good + bad + [u for u, _ in new])), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(df, {"ok/": "allow", "no/": "block"}).collect()}
    right = [got[800 + i] == v for i, (_, v) in enumerate(new)]
    assert np.mean(right) > 0.97 and urlsplit(good[0]).netloc.endswith(".ok")


def test_url_models_in_pieces_judge_as_whole_ones(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = [(i, f"http://{word()}.{('ok', 'no', 'xx')[i % 3]}/{word()}/{word()}") for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    whole, cut = (urls.judge_urls(df, {"ok/": "allow", "no/": "block"}, most_rows=n).orderBy("page_id").collect() for n in (10**9, 2000))
    for a, b in zip(whole, cut, strict=True):
        assert (a["page_id"], a["rule"], a["verdict"]) == (b["page_id"], b["rule"], b["verdict"])
        assert a["score"] == pytest.approx(b["score"])
