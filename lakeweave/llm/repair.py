"""Token-id files compressed with Re-Pair grammars.

Documents are dealt by range of ``doc_id`` and sorted, so that shards follow one
another. A shard is a row of blocks; each block is a grammar of its own. Rounds
replace many frequent pairs of ids by new symbols at once, until no pair of a
block is frequent. A block keeps the rules and the length each symbol expands to, so any token can be reached without
expanding what stands before it.

Layout of a block (little-endian): ``RPG1``; u32 documents, rounds, rules,
symbols, first nonterminal, bytes of a symbol (2 to 4); u64 tokens; per document
i64 id, u8 whether it has one, u32 tokens; per round u32 rules; per rule two u32
symbols and u32 expansion length; the symbols.

Nulls: a null text has no ids besides the end id; a null id comes first and stays
null. Repeated ids keep all their rows, ordered by the text's hash. An empty
table gives no blocks and no rows. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

from .common import column, exclusive, ragged_take, record_batch, slices
from .tokens import encoder

MAGIC = b"RPG1"
_HEAD = struct.Struct("<4s6IQ")
#: Tokens after which a block is closed; a document stays in one block.
BLOCK_TOKENS = 1 << 18
#: Occurrences that make a pair a rule, and bits of the table that sorts out rare pairs before they are counted.
LEAST, TABLE_BITS = 8, 17


def _alternate(at: np.ndarray) -> np.ndarray:
    """Every second one in each run of neighbouring positions."""
    n = np.arange(len(at))
    return (n - np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, n, 0))) % 2 == 0


def compress(ids: np.ndarray, rounds: int | None = None, least: int = LEAST) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Symbols, the rules of each round as pairs, and the first nonterminal.

    Rounds go on until no pair occurs ``least`` times without overlap; ``rounds``
    bounds them only if given. Of overlapping matches of different pairs the more
    frequent pair's are replaced, of a pair with itself every second one; a pair
    that is left with fewer than ``least`` matches waits for the next round. The
    most frequent pair loses none, so that each round has a rule. A pair that was
    rare stays rare unless it has a new symbol: later rounds look only at
    positions beside a replaced one and at frequent pairs that had to wait.
    """
    first = int(ids.max()) + 1 if len(ids) else 0
    s, top, rules = ids.astype(np.uint32), first, []
    at = np.arange(max(len(s) - 1, 0))
    while len(at) and (rounds is None or len(rules) < rounds):
        left, right = (s[at], s[at + 1]) if rules else (s[:-1], s[1:])
        codes = (left.astype(np.uint64) << np.uint64(32)) | right
        slot = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).view(np.int64)
        maybe = np.flatnonzero((np.bincount(slot) >= least)[slot])  # a slot counts all of its pairs, so no frequent one is missed
        at, codes = at[maybe], codes[maybe]
        counted, twin = np.ones(len(at), bool), np.flatnonzero((left == right)[maybe])
        counted[twin] = _alternate(at[twin])
        found = pa.array(codes).dictionary_encode()
        pairs, which = found.dictionary.to_numpy(), found.indices.to_numpy()
        counts = np.bincount(which, counted, len(pairs))
        frequent = np.flatnonzero(counts >= least)
        if not len(frequent):
            break
        frequent = frequent[np.lexsort((pairs[frequent], counts[frequent]))]
        rank = np.full(len(pairs), -1)
        rank[frequent] = np.arange(len(frequent))
        which = rank[which]
        some = np.flatnonzero(which >= 0)
        at, which, pairs = at[some], which[some], pairs[frequent]
        ahead = np.where(np.diff(at) == 1, np.diff(which), 0)
        use = np.append(ahead <= 0, True) & np.append(True, ahead >= 0)
        use = np.flatnonzero(use)
        use = use[np.flatnonzero(_alternate(at[use]))]
        used = np.bincount(which[use], minlength=len(pairs)) >= least
        use = use[np.flatnonzero(used[which[use]])]
        x, symbol, pairs = at[use], np.cumsum(used) - 1 + top, pairs[used]
        rules.append(np.stack([(pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)], 1))
        again, keep = np.zeros(len(s), bool), np.ones(len(s), bool)
        for near in (at, x - (x > 0), x - 2 * (x > 1)):
            again[near] = True
        keep[x + 1] = False
        s[x] = symbol[which[use]]
        s, at = s[keep], np.flatnonzero(again[keep][:-1])
        top += len(pairs)
    return s, rules, first


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    s, rules, first = compress(ids)
    expanded = np.ones(0, np.uint32)
    size = lambda x: np.where(x < first, 1, np.append(expanded, 0)[np.maximum(x.astype(np.int64) - first, 0)])
    for r in rules:
        expanded = np.append(expanded, size(r[:, 0]) + size(r[:, 1])).astype(np.uint32)
    pairs = np.concatenate([*rules, np.zeros((0, 2), np.uint32)]).astype("<u4")
    width = 2 if (most := first + len(pairs)) < 1 << 16 else 3 if most < 1 << 24 else 4
    return b"".join((
        _HEAD.pack(MAGIC, len(doc_ids), len(rules), len(pairs), len(s), first, width, len(ids)),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is not None for x in doc_ids], np.uint8).tobytes(),
        lengths.astype("<u4").tobytes(),
        np.array([len(r) for r in rules], "<u4").tobytes(),
        pairs.tobytes(),
        expanded.astype("<u4").tobytes(),
        np.ascontiguousarray(s.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes(),
    ))


class Block:
    """A block as read back."""

    def __init__(self, data: bytes):
        magic, n, rounds, n_rules, n_symbols, first, width, self.n_tokens = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = _HEAD.size

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, dtype, count, at)
            at += x.nbytes
            return x

        ids, there, self.lengths = take("<i8", n), take("u1", n), take("<u4", n).astype(np.int64)
        self.doc_ids = [i if t else None for i, t in zip(ids.tolist(), there.tolist(), strict=True)]
        per_round, self.rules, self.expanded = take("<u4", rounds), take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        raw = take("u1", width * n_symbols).reshape(-1, width)
        self.symbols = np.zeros((n_symbols, 4), np.uint8)
        self.symbols[:, :width] = raw
        self.symbols, self.first = self.symbols.reshape(-1).view("<u4").astype(np.int64), first
        # Terminals stand for themselves; each round's rules join what earlier ones gave.
        self.starts = np.append(np.arange(first), first + exclusive(self.expanded.astype(np.int64)))
        self.sizes = np.append(np.ones(first, np.int64), self.expanded.astype(np.int64))
        flat, k = [np.arange(first, dtype=np.uint32)], 0
        for count in per_round.tolist():
            both = self.rules[k : k + count].reshape(-1).astype(np.int64)
            flat = [np.concatenate(flat)]
            flat.append(ragged_take(flat[0], self.starts[both], self.sizes[both]))
            k += count
        self.flat = np.concatenate(flat)

    def decode(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The tokens from ``start`` to ``end``; only symbols that reach into them are expanded."""
        sizes = self.sizes[self.symbols]
        ends = np.cumsum(sizes)
        end = self.n_tokens if end is None else min(end, self.n_tokens)
        if start >= end:
            return self.flat[:0]
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, end, "left")) + 1
        some = self.symbols[a:b]
        skip = start - int(ends[a] - sizes[a])
        return ragged_take(self.flat, self.starts[some], self.sizes[some])[skip : skip + end - start]


def _write(batches, id_col: str, text_col: str, path: str, end_id: int, block_tokens: int):
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
    shard, block, docs, lengths, parts = TaskContext.get().partitionId(), 0, [], [], []

    def close():
        nonlocal block, docs, lengths, parts
        ids = np.concatenate(parts)
        row = record_batch(schema, [[shard], [block], [len(ids)], [pack(docs, np.concatenate(lengths), ids)]])
        block, docs, lengths, parts = block + 1, [], [], []
        return row

    for batch in batches:
        for some in slices(batch, text_col, 8 << 20):
            ids, sizes = encoder(path).encode(column(some, text_col))
            at = np.cumsum(sizes)
            ids, sizes, names = np.insert(ids, at, end_id), sizes + 1, column(some, id_col).to_pylist()
            at, begin, held = np.cumsum(sizes), 0, sum(map(len, parts))
            while begin < len(names):
                done = int(at[begin - 1]) if begin else 0
                stop = max(begin + 1, int(np.searchsorted(at, done + block_tokens - held, "right")))
                docs += names[begin:stop]
                lengths.append(sizes[begin:stop])
                parts.append(ids[done : at[stop - 1]])
                held += int(at[stop - 1]) - done
                if held >= block_tokens or stop < len(names):
                    yield close()
                    held = 0
                begin = stop
    if docs:
        yield close()


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode each text, append ``end_id``, and write all in ascending ``id_col`` order as blocks below ``out``."""
    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .mapInArrow(partial(_write, id_col="doc_id", text_col="text", path=tokenizer, end_id=end_id, block_tokens=block_tokens), "shard long, block long, n_tokens long, data binary")
        .write.parquet(out)
    )


def _read(batches):
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for shard, block, data in zip(*(column(batch, c).to_pylist() for c in ("shard", "block", "data")), strict=True):
            b = Block(data)
            ids = memoryview(b.decode().astype("<u4")).cast("B")
            starts = exclusive(b.lengths)
            crcs = [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), b.lengths.tolist(), strict=True)]
            n = len(crcs)
            yield record_batch(schema, [np.full(n, shard), np.full(n, block), b.doc_ids, starts, b.lengths, crcs])


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """Per document of the files below ``out``: its place among all ids, its length and its ids' CRC-32."""
    blocks = spark.read.schema("shard long, block long, n_tokens long, data binary").parquet(out)
    sizes = blocks.select("shard", "block", F.col("n_tokens").alias("size"))
    shards = sizes.groupBy("shard").agg(F.sum("size").alias("size"))  # a row for each written file
    shards = shards.select("shard", F.coalesce(F.sum("size").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(shards, "shard").select("shard", "block", (F.col("base") + F.col("inner")).alias("base"))
    docs = blocks.mapInArrow(_read, "shard long, block long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(bases, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
