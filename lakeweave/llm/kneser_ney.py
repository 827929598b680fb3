"""Quality by perplexity under interpolated modified Kneser-Ney models of trusted text.

The units are bytes, and n-grams run through a whole text: its words, a space
between each two, and a mark at either end. Counts come from all trusted text
(labelled good and not toxic, all but a tenth by hash of the id, from which limits
are taken). They are summed per task and dealt into shards by the two bytes before
an n-gram's last. All n-grams that share a context of two bytes or more, and all
longer and shorter ones that bear on them, are then in one shard, so that
continuation counts, context sums and interpolation are local to it; n-grams of one
and two bytes, 65,536 a language at most, are worked out per language and joined to
all shards. There is a model for each language with enough trusted documents and
one of all for the rest: also for languages with no document held out.

Documents are scored by joins, and no model is ever whole in one place. Texts are
dealt into blocks of bounded size by a hash of the row. A block asks once for each
distinct n-gram in it; questions meet the counts of their shard, and the answers go
back to the block, which adds them up per document. Shards are as many as the
model's rows need, and shards that many blocks ask are made several times over. A
language's limit is a quantile of the perplexity of its held-out trusted documents,
shrunk towards the shape of all languages where they are few (``limits_of``): every
language with a model and a held-out document has a limit of its own. All is the
same at every size.

Nulls: a null language uses the model of all; a text without words has no
perplexity and is rejected; a null label or id is not trusted. Repeated rows are
judged one by one, those of a task dealt over many blocks; ids labelled twice are trusted if every label is good. A
document at its limit is kept. Very long texts are counted and scored in runs of
bounded size. An empty table gives no rows. Without trusted text all texts with
words are kept. Other columns are kept by ``keep_good`` and not read by ``judge``,
and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import bytes_of, cached, column, fresh, give_back, materialize, record_batch, row_hash, slices

ORDER, BITS = 5, 40
#: Begins and ends a text; white space within is written as single spaces.
EDGE = 10
_BLANKS = bytes(32 if c in b" \t\n\r\x0b\x0c" else c for c in range(256))
#: Bytes that are looked at in one go, and bytes of text in a block.
RUN, BLOCK_BYTES = 1 << 19, 8 << 20
#: Rows of counts, before tasks' own are put together, in a shard; and blocks that ask one copy of it, for each shard there is.
SHARD_ROWS, BLOCKS = 1_000_000, 8
#: Distinct n-grams that a task holds before it gives its counts away.
MOST_KEYS = 1_500_000
#: Trusted ids up to which their table is broadcast, at 8 bytes each.
MOST_IDS = 4_000_000
#: Documents of the shape of all languages that are added to a language's own for its limit.
PRIOR = 50
#: Upper share of that shape that is an exponential tail, and the points that stand for it.
TAIL, TAIL_POINTS = 0.1, 400
#: Steps of cross entropy per nat in histograms.
STEPS = 1000
UNIFORM = 1 / 256


def contexts(data: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Length of the n-gram at each byte, up to ``order`` and back to the mark before; and its bytes as a number."""
    at = np.arange(len(data), dtype=np.int32)
    edge = np.append(np.int32(0), np.maximum.accumulate(np.where(data == EDGE, at, np.int32(0)))[:-1])
    size = np.minimum(at - edge + 1, order)
    code = np.zeros(len(data), np.int64)
    for k in range(order):
        code[k:] |= np.where(size[k:] > k, data[: len(data) - k].astype(np.int64) << (8 * k), 0)
    return size, code


def ngrams(texts: list[bytes | None], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In runs: of which text each byte is, and the n-gram that it ends, its length in the high bits."""
    own = [i for i, t in enumerate(texts) if t and not t.isspace()]
    if not own:
        return
    mark = bytes([EDGE])
    x = np.frombuffer(mark + mark.join([texts[i].strip().translate(_BLANKS) for i in own]) + mark, np.uint8)
    x, own, done = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))], np.array(own), 0
    for a in range(1, len(x), RUN):
        low = max(0, a - order + 1)
        part = x[low : a + RUN]
        size, code = contexts(part, order)
        ends = part[a - low :] == EDGE
        upto = done + np.cumsum(ends)
        yield own[upto - ends], (size.astype(np.int64) << BITS | code)[a - low :]
        done = int(upto[-1])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse, counts, len(keys)).astype(np.int64)


def _grams(batches, order: int):
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64()), ("docs", pa.int64())])
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    docs: dict[str, int] = {}

    def given():
        for lang, parts in held.items():
            keys, counts = _summed(parts)
            yield record_batch(schema, [pa.repeat(lang, len(keys)), keys, counts, np.zeros(len(keys), np.int64)])
        held.clear()

    for batch in batches:
        for some in slices(batch, "text", RUN):
            by: dict[str, list[bytes | None]] = {}
            for lang, text in zip(column(some, "lang").to_pylist(), bytes_of(some, "text"), strict=True):
                by.setdefault(lang or "", []).append(text)
            for lang, texts in by.items():
                docs[lang] = docs.get(lang, 0) + len(texts)
                for _, key in ngrams(texts, order):
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(key, return_counts=True))
                    if sum(len(k) for k, _ in parts) > MOST_KEYS // 3:
                        parts[:] = [_summed(parts)]
            if sum(len(k) for parts in held.values() for k, _ in parts) > MOST_KEYS:
                yield from given()
    yield from given()
    for lang, n in docs.items():
        yield record_batch(schema, [[lang], [-1], [0], [n]])
    give_back()


def discounts(n: np.ndarray) -> np.ndarray:
    """What is taken off counts of 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return np.array([np.clip(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i, 0.05, 0.95 * i) for i in (1, 2, 3)])


def level(codes: np.ndarray, a: np.ndarray, cuts: np.ndarray, lower) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n-grams of one length: their probabilities, their contexts, and what each leaves to shorter ones. ``lower`` gives the probabilities without the first byte."""
    cut = cuts[np.minimum(a, 3) - 1]
    known, which = np.unique(codes >> 8, return_inverse=True)
    total, left = np.bincount(which, a), np.bincount(which, cut)
    gamma = left / total
    return (a - cut) / total[which] + gamma[which] * lower, known, gamma


def _counts_of_counts(a: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(a, 5), minlength=6)[1:5].tolist()


def _table(rows: list, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


_COUNTS = "shard long, lang string, k int, codes binary, counts binary, ones array<long>"


def _adjusted(table: pa.Table, languages: set[str], order: int) -> pa.Table:
    """A shard's counts: raw for the highest order and for n-grams that begin a text, else in how many ways one goes on to the left. Of 2 bytes the shard has a part only."""
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("k", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary()), ("ones", pa.list_(pa.int64()))])
    lang, key, n, rows = np.array(table.column("lang").to_pylist(), object), table.column("key").to_numpy(), table.column("n").to_numpy(), []
    for name in sorted((set(lang) & languages) | {""}):
        mine = slice(None) if name == "" else lang == name
        keys, counts = _summed([(key[mine], n[mine])])
        size, code, wider = keys >> BITS, keys & ((1 << BITS) - 1), None
        for k in range(order, 1, -1):
            codes, a = code[size == k], counts[size == k]
            if wider is not None:
                more = np.unique(wider & ((1 << 8 * k) - 1), return_counts=True)
                codes, a = np.append(codes, more[0]), np.append(a, more[1])
                codes, a = codes[i := np.argsort(codes)], a[i]
            if len(codes):
                rows.append((table.column("shard")[0].as_py(), name, k, codes.tobytes(), a.tobytes(), _counts_of_counts(a)))
            wider = codes
    return _table(rows, schema)


_MODEL = [("lang", pa.string()), ("grams", pa.binary()), ("p", pa.binary()), ("contexts", pa.binary()), ("gamma", pa.binary())]


def _short(table: pa.Table) -> pa.Table:
    """N-grams of 1 and 2 bytes of a language, from what its shards know of those of 2."""
    parts = [(np.frombuffer(c, np.int64), np.frombuffer(a, np.int64)) for c, a in zip(table.column("codes").to_pylist(), table.column("counts").to_pylist(), strict=True)]
    codes, a = _summed(parts)
    one, ways = np.unique(codes & 0xFF, return_counts=True)
    p1, h1, g1 = level(one, ways, discounts(np.array(_counts_of_counts(ways))), UNIFORM)
    p2, h2, g2 = level(codes, a, discounts(np.array(_counts_of_counts(a))), p1[np.searchsorted(one, codes & 0xFF)])
    row = np.append(1 << BITS | one, 2 << BITS | codes), np.append(p1, p2).astype(np.float32), np.append(1 << BITS | h1, 2 << BITS | h2), np.append(g1, g2).astype(np.float32)
    return _table([(table.column("lang")[0].as_py(), *(x.tobytes() for x in row))], pa.schema(_MODEL))


def _interpolated(counts: pa.Table, short: pa.Table, cuts: dict[tuple[str, int], np.ndarray]) -> pa.Table:
    """A shard's model: its own n-grams of 3 bytes and more, after the shorter ones of each language."""
    schema, rows = pa.schema([("shard", pa.int64()), *_MODEL]), []
    own = {(r["lang"], r["k"]): r for r in counts.select(["lang", "k", "codes", "counts"]).to_pylist()}
    for r in short.to_pylist():
        grams, p, known, gamma = ([np.frombuffer(r[c], t)] for c, t in (("grams", np.int64), ("p", np.float32), ("contexts", np.int64), ("gamma", np.float32)))
        at = np.searchsorted(grams[0], 2 << BITS)
        below, q = grams[0][at:] & ((1 << BITS) - 1), p[0][at:].astype(np.float64)
        for k in sorted(k for lang, k in own if lang == r["lang"]):
            codes, a = (np.frombuffer(own[r["lang"], k][c], np.int64) for c in ("codes", "counts"))
            q, h, g = level(codes, a, cuts[r["lang"], k], q[np.searchsorted(below, codes & ((1 << 8 * (k - 1)) - 1))])
            below = codes
            for x, y in ((grams, k << BITS | codes), (p, q.astype(np.float32)), (known, k << BITS | h), (gamma, g.astype(np.float32))):
                x.append(y)
        rows.append((r["shard"], r["lang"], *(np.concatenate(x).tobytes() for x in (grams, p, known, gamma))))
    return _table(rows, schema)


def _shard(cell, shards: int):
    """The shard that has the n-grams of 3 or more bytes with these two bytes before the last; of Columns or arrays."""
    return cell * 40503 % 65521 % shards


@dataclass
class Judge:
    """The model, a row per shard and language; and each language's limit of cross entropy ("" is of all)."""

    rows: DataFrame | None
    order: int
    shards: int
    languages: frozenset[str] = frozenset()
    limits: dict[str, float] = field(default_factory=dict)

    def served(self) -> dict[str, float]:
        """Languages that are judged by themselves, with their limits; "" has the limit of the rest."""
        names = self.languages & set(self.limits) if self.limits else self.languages
        return {x: self.limits.get(x, float("inf")) for x in names | {""}}


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, np.where(hit, values[at], other)


def logs(wanted: np.ndarray, grams: tuple[np.ndarray, np.ndarray], known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log probabilities of n-grams, from sorted n-grams with probabilities and contexts with what they leave to shorter ones."""
    out, todo, size, code = np.zeros(len(wanted)), np.arange(len(wanted)), wanted >> BITS, wanted & ((1 << BITS) - 1)
    while len(todo):
        k, c = size[todo], code[todo] & ((np.int64(1) << (8 * size[todo])) - 1)
        hit, p = _look(*grams, k << BITS | c, 1.0)
        out[todo] += np.log(p)
        todo, k, c = todo[~hit], k[~hit], c[~hit]
        out[todo] += np.log(_look(*known, k << BITS | c >> 8, 1.0)[1])
        size[todo] -= 1
        done = size[todo] == 0
        out[todo[done]] += np.log(UNIFORM)
        todo = todo[~done]
    return out


def _earlier(code: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """For each hash, how many like it came before, in this batch and in ``seen``, which is brought up to date."""
    order = np.argsort(code, kind="stable")
    values, first, n = np.unique(code[order], return_index=True, return_counts=True)
    before = np.array([seen.get(v, 0) for v in values.tolist()], np.int64)
    seen.update(zip(values.tolist(), (before + n).tolist(), strict=True))
    out = np.empty(len(code), np.int64)
    out[order] = np.arange(len(code)) - np.repeat(first - before, n)
    return out


def _pack(batches, blocks: int):
    """Rows of a batch that belong to the same block, as one compressed message. The last column has the row's hash.

    Equal rows of a task go to one block after another. As they are equal, their order
    does not matter: a task that is run again deals the same rows to the same blocks.
    """
    schema, written, seen = pa.schema([("block", pa.int64()), ("data", pa.binary())]), pa.ipc.IpcWriteOptions(compression="zstd"), {}
    for batch in batches:
        code = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
        block = ((code % np.uint64(blocks)).astype(np.int64) + _earlier(code, seen)) % blocks
        own = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[order], prepend=-1)).tolist()
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=written) as out:
                out.write_batch(own.take(pa.array(order[a:b])))
            yield record_batch(schema, [[int(block[order[a]])], pa.array([sink.getvalue().to_pybytes()], pa.binary())])


def _messages(table: pa.Table, text_col: str, at: int = 1) -> Iterator[pa.RecordBatch]:
    for data in table.column(at):
        for batch in pa.ipc.open_stream(data.as_buffer()):
            yield from slices(batch, text_col, RUN)


def _by_language(batch: pa.RecordBatch, text_col: str, lang_col: str, served) -> Iterator[tuple[str, list[int], list[bytes | None]]]:
    texts, by = bytes_of(batch, text_col), {}
    for i, lang in enumerate(column(batch, lang_col).to_pylist()):
        by.setdefault(lang if lang in served else "", []).append(i)
    for lang, rows in by.items():
        yield lang, rows, [texts[i] for i in rows]


def _distinct(table: pa.Table, text_col: str, lang_col: str, order: int, served) -> dict[str, np.ndarray]:
    """The n-grams of a block, each once and sorted, by language."""
    held: dict[str, list[np.ndarray]] = {}
    for batch in _messages(table, text_col):
        for lang, _, texts in _by_language(batch, text_col, lang_col, served):
            for _, key in ngrams(texts, order):
                parts = held.setdefault(lang, [])
                parts.append(np.unique(key))
                if sum(map(len, parts)) > 2 * RUN:
                    parts[:] = [np.unique(np.concatenate(parts))]
    return {lang: np.unique(np.concatenate(parts)) for lang, parts in held.items()}


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed steps, their like bytes together."""
    steps = np.ascontiguousarray(np.diff(keys, prepend=0).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(steps, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    steps = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.int64).reshape(-1))


def _ask(table: pa.Table, text_col: str, lang_col: str, order: int, served, shards: int, copies: int) -> pa.Table:
    """What a block asks each shard: its distinct n-grams, by language."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("lang", pa.string()), ("keys", pa.binary())])
    block, rows = table.column("block")[0].as_py(), []
    for lang, keys in _distinct(table, text_col, lang_col, order, served).items():
        shard = _shard(keys >> 8 & 0xFFFF, shards)
        rows += [(int(i) * copies + block % copies, block, lang, _packed(keys[shard == i])) for i in np.unique(shard)]
    give_back()
    return _table(rows, schema)


def _answer(asked: pa.Table, model: pa.Table, copies: int) -> pa.Table:
    """The log probabilities of what blocks ask of a shard, in the order of the keys asked for."""
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("lang", pa.string()), ("logs", pa.binary())])
    none = (np.zeros(0, np.int64), np.zeros(0))
    tables = {r["lang"]: tuple((np.frombuffer(r[k], np.int64), np.frombuffer(r[v], np.float32)) for k, v in (("grams", "p"), ("contexts", "gamma"))) for r in model.to_pylist()}
    rows = []
    for part, block, lang, keys in zip(*(asked.column(c) for c in ("part", "block", "lang", "keys")), strict=True):
        told = logs(_unpacked(keys.as_py()), *tables.get(lang.as_py(), (none, none))).astype(np.float32)
        rows.append((block.as_py(), part.as_py() // copies, lang.as_py(), told.tobytes()))
    give_back()
    return _table(rows, schema)


def _score(table: pa.Table, told: pa.Table, text_col: str, lang_col: str, order: int, served, shards: int, finish) -> pa.Table:
    """A block's documents with the answers to what it asked; ``finish`` makes the output of a batch."""
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for lang, keys in _distinct(table, text_col, lang_col, order, served).items():
        known[lang] = keys, np.full(len(keys), np.nan, np.float32)
    shard = {lang: _shard(keys >> 8 & 0xFFFF, shards).astype(np.int32) for lang, (keys, _) in known.items()}
    for i, lang, answers in zip(*(told.column(c) for c in ("shard", "lang", "logs")), strict=True):
        known[lang.as_py()][1][shard[lang.as_py()] == i.as_py()] = np.frombuffer(answers.as_py(), np.float32)
    del shard
    out = []
    for batch in _messages(table, text_col):
        size, total, limit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for lang, rows, texts in _by_language(batch, text_col, lang_col, served):
            at = np.array(rows)
            limit[at] = served[lang]
            for doc, key in ngrams(texts, order):
                keys, values = known[lang]
                size[at] += np.bincount(doc, minlength=len(at))
                total[at] -= np.bincount(doc, values[np.searchsorted(keys, key)], len(at))
        if np.isnan(total).any():
            raise ValueError("a block lacks answers")
        out.append(finish(batch, size, total / np.maximum(size, 1), limit))
    del known
    give_back()
    return pa.Table.from_batches(out)


def _scored(docs: DataFrame, judge: Judge, text_col: str, lang_col: str, finish, schema, block_bytes: int) -> DataFrame:
    """``finish`` over all documents, each with its bytes, cross entropy and limit.

    The packed blocks are an exchange that both sides of the last join use; where it
    is made twice, the hash of the row deals it alike.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    blocks, served, order, shards = 1 + total // block_bytes, judge.served(), judge.order, judge.shards
    copies = -(-blocks // (BLOCKS * shards))
    own = docs.select("*", row_hash(docs).alias(fresh(docs, "row_hash")[0])).mapInArrow(partial(_pack, blocks=blocks), "block long, data binary")
    asked = own.groupBy("block").applyInArrow(lambda rows: _ask(rows, text_col, lang_col, order, served, shards, copies), "part long, block long, lang string, keys binary")
    dealt = judge.rows.withColumn("part", F.explode(F.sequence(F.col("shard") * copies, F.col("shard") * copies + (copies - 1))))
    told = asked.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(lambda asked, model: _answer(asked, model, copies), "block long, shard long, lang string, logs binary")
    return own.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda rows, answers: _score(rows, answers, text_col, lang_col, order, served, shards, finish), schema)


def _entropies(batch, size, h, limit):
    fine = np.flatnonzero(size > 0)
    return record_batch(pa.schema([("lang", pa.string()), ("step", pa.int64())]), [column(batch, "lang").take(pa.array(fine)), np.floor(h[fine] * STEPS).astype(np.int64)])


def _trusted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Text of trusted documents, with ``held`` for the tenth that thresholds are taken from."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), F.lit(False))
    ids = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(good).alias("good")).where("good").select("id")
    ids = cached(ids)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "id")
    return own.select("id", "text", "lang", (F.pmod(F.xxhash64("id"), F.lit(10)) == 0).alias("held"))


def _quantile(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    """The smallest value that a share ``q`` of the weight reaches up to."""
    at = np.argsort(values, kind="stable")
    reach = np.cumsum(weights[at])
    return float(values[at][np.searchsorted(reach, q * reach[-1] * (1 - 1e-12))])


def limits_of(steps: dict[str, tuple[np.ndarray, np.ndarray]], lose: float, prior: float = PRIOR) -> dict[str, float]:
    """Limits from the histograms of held-out documents (steps of cross entropy, and how many): "" of all, the others of languages.

    That of all is the plain quantile ``1 - lose``. A language with n documents and the
    median m has m plus that quantile of its documents' distances from m, to which the
    distances of all languages, each from its own median, are added with a weight of
    ``prior`` documents together. Few documents do not reach as far as ``1 - lose``, so
    the upper tenth of the distances that are added is an exponential tail with their
    median, which one odd document does not move. They are stretched by sqrt(1 + pi / 2n), by which a distance from the median of
    n documents scatters more than one from the true median.
    """
    medians = {lang: _quantile(x, n, 0.5) for lang, (x, n) in steps.items() if lang}
    out = {"": (_quantile(*steps[""], 1 - lose) + 1) / STEPS} if "" in steps else {}
    if not medians:
        return out
    away = np.concatenate([steps[lang][0] - m for lang, m in medians.items()])
    docs = np.concatenate([steps[lang][1] for lang in medians]).astype(float)
    top = _quantile(away, docs, 1 - TAIL)
    above = away > top
    over, n_over = away[above] - top, docs[above]
    excess = (_quantile(over, n_over, 0.5) - _quantile(-over, n_over, 0.5)) / 2 / np.log(2) if above.any() else 0.0
    odds = (np.arange(TAIL_POINTS) + 0.5) / TAIL_POINTS
    shape = np.append(away[~above], top - excess * np.log(odds))
    weight = np.append((1 - TAIL) * docs[~above] / docs[~above].sum(), np.full(TAIL_POINTS, TAIL / TAIL_POINTS)) * prior
    for lang, m in medians.items():
        x, n = steps[lang]
        reach = np.append(x - m, shape * np.sqrt(1 + np.pi / 2 / n.sum()))
        out[lang] = (m + _quantile(reach, np.append(n, weight), 1 - lose) + 1) / STEPS
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, lose: float = 0.005, least_docs: int = 20, prior: float = PRIOR, shard_rows: int = SHARD_ROWS, block_bytes: int = BLOCK_BYTES) -> Judge:
    """Models from the trusted part of ``docs``, and per language the limit from held-out trusted documents' cross entropy (``limits_of``).

    A language with fewer than ``least_docs`` trusted documents to learn from, or none held out, uses the model of all.
    """
    trusted = _trusted(docs, labels, id_col, text_col, lang_col)
    raw = cached(trusted.where("not held").select("text", "lang").mapInArrow(partial(_grams, order=order), "lang string, key long, n long, docs long"))
    enough = [r["lang"] for r in raw.where("key < 0 and lang <> ''").groupBy("lang").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).collect()]
    shards, names = 1 + raw.count() // shard_rows, set(enough)
    counts = raw.where("key >= 0").select(_shard(F.shiftright("key", 8).bitwiseAND(0xFFFF), shards).alias("shard"), "lang", "key", "n")
    counts = materialize(counts.groupBy("shard").applyInArrow(lambda rows: _adjusted(rows, names, order), _COUNTS), "counts")
    raw.unpersist()
    ones = counts.where("k > 2").groupBy("lang", "k").agg(F.array(*[F.sum(F.col("ones")[i]) for i in range(4)]).alias("ones")).collect()
    cuts = {(r["lang"], r["k"]): discounts(np.array(r["ones"], float)) for r in ones}
    short = counts.where("k = 2").groupBy("lang").applyInArrow(_short, "lang string, grams binary, p binary, contexts binary, gamma binary")
    short = short.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    model = counts.where("k > 2").groupBy("shard").cogroup(short.groupBy("shard"))
    rows = materialize(model.applyInArrow(lambda counts, short: _interpolated(counts, short, cuts), "shard long, lang string, grams binary, p binary, contexts binary, gamma binary"), "model")
    judge = Judge(rows, order, shards, frozenset(enough))
    if rows.isEmpty():
        return Judge(None, order, shards)
    held = trusted.where("held").select("id", "text", "lang")  # ids spread copies of a text over blocks
    held = held.unionByName(held.where(F.col("lang").isin(enough)).withColumn("lang", F.lit("")))  # once more under the model of all
    steps = _scored(held.withColumn("lang", F.when(F.col("lang").isin(enough), F.col("lang")).otherwise("")), judge, "text", "lang", _entropies, "lang string, step long", block_bytes)
    rows = steps.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n")).toPandas()
    judge.limits = limits_of({lang: (part["step"].to_numpy(), part["n"].to_numpy()) for lang, part in rows.groupby("lang")}, lose, prior)
    return judge


def _keeps(size: np.ndarray, h: np.ndarray, limit: np.ndarray) -> np.ndarray:
    return (size > 0) & (h <= limit)


def _judged(batch, size, h, limit):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("perplexity", pa.float64()), ("threshold", pa.float64()), ("kept", pa.bool_())])
    return record_batch(schema, [column(batch, "doc_id"), size, pa.array(np.exp(h), pa.float64(), mask=size == 0), np.exp(np.minimum(limit, 700.0)), _keeps(size, h, limit)])


def _kept(batch, size, h, limit):
    return batch.filter(pa.array(_keeps(size, h, limit)))


def judge(docs: DataFrame, judge: Judge, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: its bytes, its perplexity per byte, the threshold of its language and whether it is kept."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    if judge.rows is None:
        words = F.regexp_replace("text", r"[ \t\n\r\x0b\x0c]+", "") != ""
        return own.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("perplexity"), F.lit(float("inf")).alias("threshold"), F.coalesce(words, F.lit(False)).alias("kept"))
    return _scored(own, judge, "text", "lang", _judged, "doc_id long, n_bytes long, perplexity double, threshold double, kept boolean", block_bytes)


def keep_good(docs: DataFrame, judge: Judge, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept."""
    if judge.rows is None:
        return docs.where(F.regexp_replace(F.col(text_col), r"[ \t\n\r\x0b\x0c]+", "") != "")
    return _scored(docs, judge, text_col, lang_col, _kept, docs.schema, block_bytes)
