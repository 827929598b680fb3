import csv
import io
import random

import pytest

from lakeweave.sources import csvscan, lake


def python_rows(path):
    with open(path, encoding="utf-8", errors="ignore", newline="") as f:
        return [r for r in csv.reader(f) if r]


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "97")
    yield spark
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def check(spark, paths):
    got = {}
    for r in csvscan.scan(spark, [str(p) for p in paths]).collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], {})[r["row"]] = r["fields"]
    for path in paths:
        want = python_rows(path)
        rows = got.get(path.name, {})
        assert [rows.get(k) for k in range(len(want))] == want and len(rows) == len(want)


def test_blocks_cut_records_anywhere(small_blocks, tmp_path):
    rng = random.Random(1)
    pieces = ["a", 'say "x"', "two\nlines", "x\r\ny", "", "é日本", "1,5", " blank ", '"', '""', "\n\n\n", "lone\rreturn", "x" * 150]
    for k in range(3):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=("\n", "\r\n", "\n")[k])
        writer.writerow(["id", "one", "two"])
        for i in range(200):
            writer.writerow([i, rng.choice(pieces), rng.choice(pieces)])
        (tmp_path / f"t{k}.csv").write_text(out.getvalue(), encoding="utf-8", newline="")
    check(small_blocks, sorted(tmp_path.iterdir()))
    assert csvscan.lines(small_blocks, [str(tmp_path / "t0.csv")]).rdd.getNumPartitions() > 20


def test_a_field_over_many_blocks(small_blocks, tmp_path):
    long = "\n".join(f'line {i} with ""quotes"" in it' if i % 7 else f"line {i}" for i in range(100))
    (tmp_path / "long.csv").write_text(f'a,b\n1,"{long}"\n2,"{long}"\n3,x\n', encoding="utf-8")
    check(small_blocks, [tmp_path / "long.csv"])


def test_odd_quotes_and_lines(small_blocks, tmp_path):
    texts = {"mid": 'a,b\nx"y,z\n"q"r,s\n', "blank": "\n\na,b\n\n1,2\n\n", "bare": "a,b\r1,2\r3,4", "none": "", "head": "a,b\n", "last": "a\n1\n2"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text * (30 if name == "mid" else 1), encoding="utf-8", newline="")
    check(small_blocks, sorted(tmp_path.iterdir()))
    (tmp_path / "bytes.csv").write_bytes(b"a,b\n\xff1,\xfe2\n")
    check(small_blocks, [tmp_path / "bytes.csv"])


def test_an_unclosed_quote_takes_the_rest(small_blocks, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"two\n' + "three\n" * 60, encoding="utf-8")
    rows = {r["row"]: r["fields"] for r in csvscan.scan(small_blocks, [str(tmp_path / "open.csv")]).collect()}
    assert rows == {0: ["a", "b"], 1: ["1", "two\n" + "three\n" * 59 + "three"]}


@pytest.mark.parametrize("seed", range(4))
def test_any_text(small_blocks, tmp_path, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(['"', '"', ",", "\n", "\n", "a", "bc", "\r", "é"]) for _ in range(1500)) + "\n"
    text += '"\n' if not csvscan.records(csvscan.physical([text[:-1].encode()]))[2] else ""
    (tmp_path / "any.csv").write_text(text, encoding="utf-8", newline="")
    check(small_blocks, [tmp_path / "any.csv"])


def test_cells_have_row_numbers_in_file_order(small_blocks, tmp_path):
    rows = "".join(f'{i},"x{i}\ny"\n' if i % 3 else f"{i}\n" for i in range(300))
    (tmp_path / "a b+c.csv").write_text("id , v,id\n" + rows, encoding="utf-8")
    (tmp_path / "plain").write_text("k\n5\n", encoding="utf-8")
    with pytest.warns(UserWarning, match="no file of table gone"):
        cells = lake.csv_cells(small_blocks, str(tmp_path), ["a b+c", "plain", "gone"]).collect()
    own = {(r["row_idx"], r["column_name"]): r["raw"] for r in cells if r["table_name"] == "a b+c"}
    assert len(own) == 600 and all(own[i, "id"] == str(i) and own[i, " v"] == (f"x{i}\ny" if i % 3 else "") for i in range(300))
    assert [tuple(r) for r in cells if r["table_name"] == "plain"] == [("plain", 0, 0, "k", "5")]
