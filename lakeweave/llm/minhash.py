"""MinHash near-duplicates: an LSH forest finds families, and exact Jaccard links inside them.

A document is the set of its word shingles, as 64-bit hashes. Its signature has 256
minimum hashes of a byte each, eight for each of 32 trees: a tree's label is a long
whose bytes are read from the left. For each tree the labels are put in order
(range-partitioned, so a frequent label may span partitions), and documents whose
neighbours in that order share a long enough prefix become candidates of each other.
How long is decided by region: where up to ``CROWD`` documents share 6 bytes these
are enough, in crowded regions all 8 are needed. Runs of neighbours are written as
stars, so candidates are linear in the documents; with the stars of all trees,
connected components make families. A pair at the least similarity, 0.85, shares a
label of 8 bytes in one of 32 trees with probability 1 - 4e-5 (of 6 bytes 1 - 3e-7).

Inside families links are exact: sets are dealt to blocks of about ``BLOCK`` documents
(or ``BLOCK_SHINGLES`` shingles), every pair of blocks of a family is one group, and there
all intersections are counted. Families of more than ``MOST_BLOCKS`` blocks are taken
apart by region of the forest, i.e. by tree and whole label, then by the labels of two
and of four trees; what is still larger has 32 minimum hashes in common and is dealt in
blocks that all hold the region's smallest document. So no group grows with the input.
What this leaves apart is then compared exactly: in such a family every document outside of
its largest linked part meets all documents of the family that it isn't linked with, block
by block. Most large families are one part by then and end there; a family of many parts costs the
square of what lies outside of the largest.

Equal sets meet by a 64-bit hash of the whole set before anything is compared. That
two different sets among 10^10 share it has odds of a few in all.

Nulls: null, empty and blank texts have an empty set and are linked with nothing. With
fewer words than a shingle the whole sequence is one shingle. A null id counts as no
id: a component's id is the smallest that isn't null. Rows with the same id and text
have the same result, each its own row. Texts of any length are hashed whole. Other
columns are not read and may have any names. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache, partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bytes_of, column, exclusive, forget, give_back, lower_ascii, materialize, numbers_of, ragged_take, record_batch, slices
from .graph import components
from .simhash import Stars

TREES, DEPTH = 32, 8
#: Bytes that neighbours share in a thin region, and how many documents make a region crowded.
SHALLOW, CROWD = 6, 64
#: Documents and shingles of a block, and blocks of a family whose pairs are all compared.
BLOCK, BLOCK_SHINGLES, MOST_BLOCKS = 128, 1 << 18, 32
LINK = "a long, b long"


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the minimum hashes, as columns."""
    rng = np.random.default_rng(11)
    draw = lambda: rng.integers(0, 1 << 32, (TREES * DEPTH, 1), dtype=np.uint64).astype(np.uint32)
    return draw() | np.uint32(1), draw()


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each number (the finaliser of XXH64)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(32)
    return x


def shingle_set(text: bytes | None, width: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles, each from the hashes of its words in order."""
    from xxhash import xxh64_intdigest

    words = text.translate(lower_ascii()).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words, repeat(7)), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B185EBCA87) + h[k : k + len(out)])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """A long for each tree, whose bytes from the left are minimum hashes."""
    a, b = _functions()
    x, low = (found >> np.uint64(32)).astype(np.uint32), np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(low, (x[None, k : k + 2048] * a + b).min(1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).view(">u8").astype(np.int64)


def _signatures(batches, width: int):
    from xxhash import xxh64_intdigest

    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("labels", pa.list_(pa.int64()))])
    for batch in batches:
        for some in slices(batch, "text", 4 << 20):
            sets = [shingle_set(t, width) for t in bytes_of(some, "text")]
            nodes = np.fromiter((xxh64_intdigest(s.tobytes(), 3) for s in sets), np.uint64, len(sets)).view(np.int64)
            labels = np.stack([signature(s) for s in sets])
            ragged = pa.ListArray.from_arrays(np.arange(0, labels.size + 1, TREES, dtype=np.int32), pa.array(labels.ravel()))
            yield record_batch(schema, [column(some, "doc_id"), column(some, "text_hash"), nodes, [len(s) for s in sets], ragged])
    give_back()


def signatures(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a hash of the text, a hash and the size of the set, and a label for each tree."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64(F.col("doc_id").isNull(), "text"))
    return own.mapInArrow(partial(_signatures, width=width), "doc_id long, text_hash long, node long, n long, labels array<long>")


def _common_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes from the left that two labels share."""
    x = (a ^ b).view(np.uint64)
    return (x[:, None] < (np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64))[None, :]).sum(1)


def _neighbours(batches, crowd: int):
    """Stars over runs of neighbours in a sorted partition, and its first and last row for what lies across the border."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("at", pa.int32()), ("tree", pa.int64()), ("label", pa.int64())])
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    tree, label, node = (np.concatenate([numbers_of(b, c) for b in held]) for c in ("tree", "label", "node"))
    shared = np.where(tree[1:] == tree[:-1], _common_bytes(label[1:], label[:-1]), 0)
    region = np.append(0, np.cumsum(shared < SHALLOW))
    thin = np.bincount(region)[region] <= crowd
    joined = np.where(thin[1:], shared >= SHALLOW, shared >= DEPTH)
    run = np.append(0, np.cumsum(~joined))
    first = np.flatnonzero(np.append(True, ~joined))[run]
    far = node != node[first]
    at = TaskContext.get().partitionId()
    none = np.full(int(far.sum()), -1)
    yield record_batch(schema, [node[far], node[first][far], none, none, none])
    yield record_batch(schema, [node[[0, -1]], node[[0, -1]], [2 * at, 2 * at + 1], tree[[0, -1]], label[[0, -1]]])


def candidates(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links between documents that are neighbours in some tree's order and share enough of their labels.

    The driver sees two rows for each partition, to link what a border has parted.
    """
    spark = distinct.sparkSession
    cells = distinct.select("node", F.posexplode("labels").alias("tree", "label")).select("node", F.col("tree").cast("long").alias("tree"), "label")
    order = ["tree", F.col("label").bitwiseXOR(F.lit(-(1 << 63))), "node"]
    ordered = cells.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(ordered.mapInArrow(partial(_neighbours, crowd=crowd), "a long, b long, at int, tree long, label long"), "neighbours")
    ends = sorted(found.where("at >= 0").collect(), key=lambda r: r["at"])
    across = [(x["a"], y["a"]) for x, y in zip(ends[1::2], ends[2::2], strict=False) if x["tree"] == y["tree"] and x["a"] != y["a"] and (x["label"] ^ y["label"]) >> 8 * (DEPTH - SHALLOW) == 0]
    return found.where("at < 0").select("a", "b").union(spark.createDataFrame(across, LINK)).distinct()


def _blocks(members: DataFrame, keys: list[str], block: int, shingles: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The groups of members whose parts by ``keys`` have few enough blocks, and the members of the other parts."""
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("weight"))
    parts = F.greatest(F.ceil(F.col("docs") / block), F.ceil(F.col("weight") / shingles)).cast("int")
    known = members.join(sizes.where("docs > 1").select(*keys, parts.alias("parts")), keys)
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    small = known.where(F.col("parts") <= most).withColumn("own", own)
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("low"), F.greatest(k, F.col("own")).alias("high")))
    return small.select("node", F.xxhash64(F.lit(len(keys)), *keys).alias("part"), F.explode(pairs).alias("pair"), "own").select("node", "part", "pair.low", "pair.high", (F.col("own") == F.col("pair.low")).alias("left")), known.where(F.col("parts") > most).drop("parts")


def deal(families: DataFrame, block: int = BLOCK, shingles: int = BLOCK_SHINGLES, most: int = MOST_BLOCKS) -> DataFrame:
    """(node, part, low, high, left): the groups in which each document is compared with others.

    ``families`` has node, family, n and labels. Parts named by a hash of their keys may
    meet by chance, which only adds comparisons.
    """
    own, large = _blocks(families, ["family"], block, shingles, most)
    if large.isEmpty():
        return own
    cells = large.select("node", "family", "n", "labels", F.posexplode("labels").alias("tree", "label"))
    next_label = lambda k: F.element_at("labels", F.pmod(F.col("tree") + k, F.lit(TREES)) + 1)
    keys = ["family", "tree", "label"]
    for deeper in ((), (1,), (2, 3)):
        cells = cells.withColumns({f"label{k}": next_label(k) for k in deeper})
        keys = [*keys, *(f"label{k}" for k in deeper)]
        some, cells = _blocks(cells, keys, block, shingles, most)
        own = own.union(some)
    centres = cells.groupBy(*keys).agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("docs"), F.sum("n").alias("weight"))
    parts = F.greatest(F.ceil(F.col("docs") / block), F.ceil(F.col("weight") / shingles)).cast("int")
    part, fixed = F.xxhash64(F.lit(0), *keys), (F.lit(0).alias("high"), F.lit(True).alias("left"))
    chunks = cells.join(centres, keys).select("node", part.alias("part"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("low"), *fixed)
    heads = centres.select(F.col("centre").alias("node"), part.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("low"), *fixed)
    return own.union(chunks).union(heads).distinct()


def remaining(members: DataFrame, roots: DataFrame, block: int = BLOCK, shingles: int = BLOCK_SHINGLES, most: int = MOST_BLOCKS) -> DataFrame | None:
    """(node, part, low, high, left, root): the groups in which what ``deal`` took apart by region is compared in full; None if there is nothing.

    ``members`` has node, family and n; ``roots`` (node, root) what has been linked. Pairs
    within the largest part of a family are left out, as they are linked already.
    """
    parts = lambda docs, weight: F.greatest(F.ceil(docs / block), F.ceil(weight / shingles)).cast("int")
    large = members.groupBy("family").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("weight")).where(parts(F.col("docs"), F.col("weight")) > most).select("family")
    if large.isEmpty():
        return None
    known = members.select("node", "family", "n").join(large, "family").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = known.groupBy("family", "root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("weight"))
    whole = sizes.groupBy("family").agg(F.max(F.struct("docs", "weight", "root")).alias("core"), F.sum("docs").alias("docs"), F.sum("weight").alias("weight"))
    outside = (F.col("docs") - F.col("core.docs"), F.col("weight") - F.col("core.weight"))
    whole = whole.where(outside[0] > 0).select("family", F.col("core.root").alias("core"), parts(*outside).alias("others"), parts(F.col("core.docs"), F.col("core.weight")).alias("inner"))
    known = known.join(whole, "family").withColumn("h", F.xxhash64("node", F.lit(1)))
    place = lambda kind, low, high, left: F.struct(F.lit(kind).alias("kind"), low.cast("int").alias("low"), high.cast("int").alias("high"), left.alias("left"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own, core = F.pmod("h", F.col("others")).cast("int"), F.pmod("h", F.col("inner")).cast("int")
    out = F.concat(F.transform(upto("others"), lambda k: place(0, F.least(k, own), F.greatest(k, own), own <= k)), F.transform(upto("inner"), lambda k: place(1, own, F.col("others") + k, F.lit(True))))
    into = F.transform(upto("others"), lambda k: place(1, k, F.col("others") + core, F.lit(False)))
    dealt = known.select("node", "family", "root", F.explode(F.when(F.col("root") == F.col("core"), into).otherwise(out)).alias("at"))
    return dealt.select("node", F.xxhash64(F.lit(-1), "family", "at.kind").alias("part"), "at.low", "at.high", "at.left", "root")


def links(members: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK, shingles: int = BLOCK_SHINGLES, most: int = MOST_BLOCKS) -> DataFrame:
    """(node, root) of all linked members of families (node, family, n, labels); ``sets`` has each node's shingles."""
    compared = lambda groups: groups.join(sets, "node").groupBy("part", "low", "high").applyInArrow(_compare(percent), LINK)
    found = materialize(compared(deal(members, block, shingles, most)), "compared")
    roots = components(found)
    rest = remaining(members, roots, block, shingles, most)
    return roots if rest is None else components(found.union(compared(rest)))


def _sets(batches, width: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        for some in slices(batch, "text", 4 << 20):
            yield record_batch(schema, [column(some, "node"), [shingle_set(t, width).tobytes() for t in bytes_of(some, "text")]])
    give_back()


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, roots: np.ndarray | None = None) -> np.ndarray:
    """Labels of sets (left, then right) that pairs with ``100 * both >= percent * either`` join; without ``right`` pairs are within ``left``.

    A set's members are marked and counted in all sets it is compared with, so one step
    compares it with a whole block. Sets with the same of ``roots`` are linked already and not compared.
    """
    others = left if right is None else right
    sizes = np.array([len(s) for s in others], np.int64)
    universe, ids = np.unique(np.concatenate([*left, *(right or [])]), return_inverse=True)
    flat = ids[sum(map(len, left)) :] if right is not None else ids
    starts, at = exclusive(sizes), 0
    stars, mark = Stars(len(left) + len(right or [])), np.zeros(len(universe), np.int64)
    if roots is not None:
        _, first, of = np.unique(roots, return_index=True, return_inverse=True)
        stars.label = first[of]
    for k, own in enumerate(left):
        mine = ids[at : at + len(own)]
        at += len(own)
        first = k + 1 if right is None else 0
        if first >= len(others):
            break
        near = np.flatnonzero((100 * np.minimum(sizes[first:], len(own)) >= percent * np.maximum(sizes[first:], len(own)))) + first
        if roots is not None:
            near = near[roots[near + (0 if right is None else len(left))] != roots[k]]
        if not len(near):
            continue
        mark[mine] = 1
        both = np.add.reduceat(mark[ragged_take(flat, starts[near], sizes[near])], exclusive(sizes[near]))
        mark[mine] = 0
        hit = near[100 * both >= percent * (len(own) + sizes[near] - both)]
        stars.link(np.full(len(hit), k), hit + (0 if right is None else len(left)))
    return stars.label


def _compare(percent: int):
    def compare(group: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        node, left = group["node"].to_numpy(), group["left"].to_numpy().astype(bool)
        _, one = np.unique(node, return_index=True)  # in order of nodes, so that a star's centre is the smallest
        sets = group["shingles"]
        take = lambda rows: [np.frombuffer(sets[int(k)].as_py(), np.uint64) for k in rows]
        same = group["low"][0].as_py() == group["high"][0].as_py() or left.all()
        order = one if same else np.concatenate([one[left[one]], one[~left[one]]])
        a = order if same else order[: int(left[one].sum())]
        b = order[len(a) :]
        if not len(a) or not same and not len(b):
            return schema.empty_table()
        roots = group["root"].to_numpy()[order] if "root" in group.column_names else None
        label = linked(take(a), None if same else take(b), percent, roots)
        far = np.flatnonzero(label != np.arange(len(order)))
        return pa.table([node[order[far]], node[order[label[far]]]], schema=schema)

    return compare


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 3, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, shingles: int = BLOCK_SHINGLES, most: int = MOST_BLOCKS, crowd: int = CROWD) -> DataFrame:
    """Per document: n_shingles, component_id (the smallest id it reaches over links) and whether it is the one kept."""
    own = materialize(signatures(docs, width, id_col, text_col), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    distinct = materialize(own.where("n > 0").groupBy("node").agg(first, F.max("n").alias("n"), F.first("labels").alias("labels")), "sets")
    families = components(candidates(distinct, crowd)).toDF("node", "family")
    members = materialize(distinct.join(families, "node").select("node", "family", "n", "labels", F.col("first.doc_id").alias("own_id"), F.col("first.text_hash").alias("own_hash")), "members")
    texts = docs.select(F.col(id_col).cast("long").alias("own_id"), F.col(text_col).cast("string").alias("text")).withColumn("own_hash", F.xxhash64(F.col("own_id").isNull(), "text"))
    chosen = texts.join(members.select("node", "own_id", "own_hash"), (texts["own_hash"] == members["own_hash"]) & texts["own_id"].eqNullSafe(members["own_id"]))
    sets = materialize(chosen.select("node", "text").mapInArrow(partial(_sets, width=width), "node long, shingles binary"), "shingles")
    roots = links(members.select("node", "family", "n", "labels"), sets, percent, block, shingles, most)
    forget(sets)
    rooted = distinct.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("of"))
    known = rooted.join(smallest, "root").select("node", F.col("of.doc_id").alias("component"))
    found = own.join(known, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
