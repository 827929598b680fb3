"""Benchmark decontamination by word windows.

The words of a text are its runs of ASCII letters and digits (A-Z lower-cased)
and characters beyond ASCII. An item's windows are its runs of ``size`` words; an
item of fewer words is one window. The items are dealt into blocks of bounded size;
each block is broadcast as a hash set, and the documents pass by one after another
in a single step, without a shuffle. A hash that is found is verified word by word.

Nulls: a null text has no words. A null item id counts as an item with an empty
name. Rows of items with the same id are one item. Repeated documents are judged
row by row; a share of hit words equal to the bound is contaminated. With an empty
benchmark nothing is hit; an empty table gives no rows. Very long texts are judged
whole. Other columns are kept by ``decontaminate``, not read by ``judge``, and may
have any names.
"""

from __future__ import annotations

import re
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import bytes_of, column, exclusive, give_back, ragged_take, record_batch, slices

#: Everything but letters, digits and bytes beyond ASCII separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes of benchmark text in a broadcast block.
BLOCK_BYTES = 8 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Windows:
    """The windows of some items by length: sorted hashes of word numbers, where each window stands, and whose it is."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, items: list[tuple[str, bytes | None]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        flat, starts, lengths, owners = array("i"), [], [], []
        for name, text in items:
            words = words_of(text)
            starts.append(len(flat))
            lengths.append(len(words))
            owners.append(at[name])
            flat.extend([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
        self.flat, starts, lengths, owners = np.array(flat, np.int32), np.array(starts, np.int64), np.array(lengths, np.int64), np.array(owners, np.int64)
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(np.minimum(lengths[lengths > 0], size)).tolist():
            mine = np.flatnonzero(np.minimum(lengths, size) == n)
            windows = lengths[mine] - n + 1
            where = np.repeat(starts[mine] - exclusive(windows), windows) + np.arange(windows.sum())
            whose, h = np.repeat(owners[mine], windows), self.hashes(self.flat, where, n)
            order = np.lexsort((whose, h))
            where, whose, h = where[order], whose[order], h[order]
            # Of equal windows of one item the first is enough.
            again = np.flatnonzero((h[1:] == h[:-1]) & (whose[1:] == whose[:-1]))
            again = again[self.same(self.flat, where[again + 1], where[again], n)] + 1
            keep = np.ones(len(h), bool)
            keep[again] = False
            self.by_length.append((n, h[keep], where[keep].astype(np.int32), whose[keep].astype(np.int32)))

    def hashes(self, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * self.BASE + ids[at + k].astype(np.uint64)
        return h

    def same(self, ids: np.ndarray, at: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
        """Whether the ``n`` ids at each place are the words of the window that stands at ``where``."""
        out = np.ones(len(at), bool)
        for k in range(n):
            out &= ids[at + k] == self.flat[where + k]
        return out

    def find(self, words: list[list[bytes]]) -> tuple[np.ndarray, list[set[str]]]:
        """Which words of some texts are hit, one text after another, and the items found in each text."""
        get, flat, counts = self.vocabulary.get, [0], np.array([len(w) for w in words], np.int64)
        for own in words:
            flat += [get(w, 0) for w in own]
            flat.append(0)  # no window reaches into the next text
        ids, starts = np.array(flat, np.int64), 1 + exclusive(counts + 1)
        known = np.append(0, np.cumsum(ids > 0))
        marks, found = np.zeros(len(ids) + 1, np.int64), [set() for _ in words]
        for n, hashes, where, whose in self.by_length:
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            h = self.hashes(ids, at, n)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            at, low, many = at[hit := high > low], low[hit], (high - low)[hit]
            # every window with that hash, verified word by word
            place = np.repeat(low - exclusive(many), many) + np.arange(many.sum())
            at = np.repeat(at, many)
            fine = np.flatnonzero(self.same(ids, at, where[place].astype(np.int64), n))
            at, place = at[fine], place[fine]
            np.add.at(marks, at, 1)
            np.add.at(marks, at + n, -1)
            both = np.unique(np.searchsorted(starts, at, "right") - 1 << 32 | whose[place].astype(np.int64))
            for doc, item in zip((both >> 32).tolist(), (both & 0xFFFFFFFF).tolist(), strict=True):
                found[doc].add(self.names[item])
        return ragged_take(np.cumsum(marks[:-1]) > 0, starts, counts), found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[list[tuple[str, bytes | None]]]:
    """The items in blocks of about ``block_bytes`` each; only these are ever on the driver, one after another."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    count = -(-total // block_bytes)
    for k in range(count):
        some = items if count == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(count)) == k)
        yield [(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in some.collect()]




def _find(batches, blocks, text_col: str, finish):
    """Looks for the windows of one block after another; a worker holds one block at a time. ``finish`` makes the output."""
    for batch in batches:
        for some in slices(batch, text_col, 4 << 20 if len(blocks) == 1 else 16 << 20):
            texts = bytes_of(some, text_col)
            words = [words_of(t) for t in texts]
            counts = np.array([len(w) for w in words], np.int64)
            hit, found = np.zeros(counts.sum(), bool), [set() for _ in words]
            for block in blocks:
                own, names = block.value.find(words)
                hit |= own
                for a, b in zip(found, names, strict=True):
                    a |= b
                if len(blocks) > 1:
                    vars(block).pop("_value", None)  # read again from its file when it is wanted again
            yield finish(some, texts, exclusive(counts), counts, hit, found)
    give_back()


def _hits(starts, counts, hit) -> np.ndarray:
    total = np.append(0, np.cumsum(hit))
    return total[starts + counts] - total[starts]


def contaminated(n_hit: np.ndarray, n_words: np.ndarray, one_in: int) -> np.ndarray:
    return (n_hit > 0) & (one_in * n_hit >= n_words)


def _digest(batch, texts, starts, counts, hit, names, one_in: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("contaminated", pa.bool_())])
    n_hit = _hits(starts, counts, hit)
    items = [sorted(n) for n in names]
    return record_batch(schema, [column(batch, "doc_id"), counts, n_hit, [len(i) for i in items], items, contaminated(n_hit, counts, one_in)])


def _clean(batch, texts, starts, counts, hit, names, one_in: int, text_col: str, spans: bool):
    n_hit = _hits(starts, counts, hit)
    out = batch.filter(pa.array(~contaminated(n_hit, counts, one_in))) if not spans else batch
    if spans and n_hit.any():
        new = [t if t is None else t.decode() for t in texts]
        for i in np.flatnonzero(n_hit).tolist():
            flags = hit[starts[i] : starts[i] + counts[i]]
            kept, at = [], 0
            for flag, m in zip(flags.tolist(), _WORD.finditer(texts[i]), strict=True):
                if flag:
                    kept.append(texts[i][at : m.start()])
                    at = m.end()
            new[i] = b"".join([*kept, texts[i][at:]]).decode()
        k = batch.schema.get_field_index(text_col)
        out = batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))
    return out


def _pass(docs: DataFrame, benchmark: DataFrame, size: int, item_col: str, item_text_col: str, text_col: str, block_bytes: int, finish, schema) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(Windows(some, size)) for some in _blocks(benchmark, item_col, item_text_col, block_bytes)]
    return docs.mapInArrow(partial(_find, blocks=blocks, text_col=text_col, finish=finish), schema)


def judge(docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: its words, how many are hit, the items found, and whether a ``one_in``-th of the words or more is hit."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _pass(own, benchmark, size, item_col, item_text_col, "text", block_bytes, partial(_digest, one_in=one_in), "doc_id long, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20, remove: str = "documents", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without contaminated ones, or (``remove="spans"``) with all hit words cut out of their texts."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    return _pass(docs, benchmark, size, item_col, item_text_col, text_col, block_bytes, partial(_clean, one_in=one_in, text_col=text_col, spans=remove == "spans"), docs.schema)
