"""Quality rules: counts over whole texts, and an isolation forest over their rates.

All labelled good rows are used: half of them, by hash, grow the forest, each in at least
one tree (in all trees where they are few), and all of the others give the threshold on the
anomaly score, with all labelled bad rows. Trees grow level by level over counts and ranges of nodes
that Spark adds up, so no task and not the driver sees the rows. Split points are drawn over a
node's range widened on both sides, so that what lies far outside of anything
seen is cut off after a few steps.

Nulls: a null or empty text has no words and fails the base rules. Rows without
labels, or labels without rows, only leave the forest out: then the base rules
alone decide. Repeated rows are judged one by one; a row at the threshold is kept.
An empty table gives no rows. Texts of any length are counted whole. Other columns
are kept by ``keep_good``, not read by ``judge``, and may have any names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import bytes_of, column, give_back, materialize, record_batch, slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Bytes that aren't a code point of a word: white space and continuation bytes.
_NOT_COUNTED = bytes([32, *range(9, 14), *range(0x80, 0xC0)])
_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
RUN = 5


def repeated_words(words: list[bytes], run: int = RUN) -> int:
    """How many words stand in a window of ``run`` words that occurs twice or more."""
    m = len(words) - run + 1
    if m < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(run):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + m]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    at = np.sort(order[np.append(False, same) | np.append(same, False)]).tolist()
    seen: dict[tuple[bytes, ...], int] = {}
    for i in at:  # what hashes found is counted by the words themselves
        key = tuple(words[i : i + run])
        seen[key] = seen.get(key, 0) + 1
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.array([i for i in at if seen[tuple(words[i : i + run])] > 1], np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + run, -1)
    return int((np.cumsum(marks) > 0).sum())


def counts_of(text: bytes | None) -> tuple[int, ...]:
    """The base counts, and those that only the forest reads."""
    if not text:
        return (0,) * 11
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    less = lambda x: len(text) - len(text.translate(None, x))
    return (
        len(words), len(text.translate(None, _NOT_COUNTED)), less(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(set(words)), less(_UPPER), less(_DIGITS), less(_MARKS), len(text),
    )


def count(texts: list[bytes | None]) -> np.ndarray:
    return np.array([counts_of(t) for t in texts], np.int64).reshape(-1, 11)


def rates(c: np.ndarray) -> np.ndarray:
    """What the forest looks at."""
    words, chars, symbols, dups, repeats, lines, distinct, upper, digits, marks, _ = c.astype(float).T
    w, x = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack([chars / w, symbols / x, dups / np.maximum(lines, 1), repeats / w, np.log(np.maximum(distinct, 1)) / np.log(w + 1), upper / x, digits / x, marks / x], 1)


def base_failed(c: np.ndarray) -> np.ndarray:
    return (c[:, 0] < 10) | (100 * c[:, 4] > 20 * c[:, 0])


def _expected(n: np.ndarray) -> np.ndarray:
    """The mean path length to a row among ``n``."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _leaf(n: int, depth: int) -> tuple:
    return -1, 0.0, (0, 0), depth + float(_expected(np.array(n)))


class Forest:
    """Trees as arrays of each node's feature, cut, children and path length; grown over ``x``, or by ``grow`` over a table."""

    def __init__(self, x: np.ndarray | None = None, trees: int = 100, rows: int = 256, seed: int = 7, widen: float = 2.0):
        self.trees, self.norm = [], 1.0
        if x is not None:
            self.grow(lambda forest: _merge([forest.statistics(x, np.arange(len(x)), forest.share(len(x)))]), len(x), trees, rows, seed, widen)

    def share(self, n: int) -> float:
        """The share of trees that a row grows: so many that each tree has ``rows`` rows, but at least one."""
        return min(1.0, max(self.rows / max(n, 1), 1 / self.count))

    def grow(self, ask, n: int, trees: int = 100, rows: int = 256, seed: int = 7, widen: float = 2.0) -> None:
        """Level by level; ``ask`` gives {(tree, node): (rows, lowest, highest)} of the nodes that are leaves so far and may be cut."""
        self.count, self.rows = trees, rows
        of_tree = max(1.0, n * self.share(n))
        self.norm = float(max(_expected(np.array(of_tree)), 1.0))
        deep = int(np.ceil(np.log2(max(min(of_tree, 1024), 2)))) + 2
        nodes = [[_leaf(0, 0)] for _ in range(trees)]
        self.open = [{0} for _ in range(trees)]
        for depth in range(deep + 1):
            self.trees = [_arrays(t) for t in nodes]
            found, self.open = ask(self), [set() for _ in range(trees)]
            for (t, me), (size, low, high) in sorted(found.items()):
                tree = nodes[t]
                tree[me] = _leaf(size, depth)
                some = np.flatnonzero(high > low)
                if depth < deep and size > 1 and len(some):
                    rng = np.random.default_rng((seed, t, me))
                    f = int(rng.choice(some))
                    w = widen * (high[f] - low[f])
                    tree[me] = (f, rng.uniform(low[f] - w, high[f] + w), (len(tree), len(tree) + 1), 0.0)
                    self.open[t] |= {len(tree), len(tree) + 1}
                    tree += [_leaf(0, depth + 1), _leaf(0, depth + 1)]
            if not any(self.open):
                break
        self.trees = [_arrays(t) for t in nodes]

    def _at(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        feature, cut, children, _ = tree
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (f := feature[at]).max(initial=-1) >= 0:
            at = np.where(f < 0, at, children[at, (x[rows, np.maximum(f, 0)] >= cut[at]).astype(np.int64)])
        return at

    def statistics(self, x: np.ndarray, key: np.ndarray, share: float) -> dict:
        """Rows and ranges of the open nodes; ``key`` says which trees a row grows."""
        out, key = {}, key.astype(np.uint64)
        own = _spread(key, 0) % np.uint64(self.count)
        for t, tree in enumerate(self.trees):
            if not self.open[t]:
                continue
            part = x[(own == t) | (_spread(key, t + 1) < np.uint64(int(share * (2**32 - 1)))) if share * self.count > 1 else own == t]
            at = self._at(tree, part)
            order = np.argsort(at, kind="stable")
            ids, starts = np.unique(at[order], return_index=True)
            if len(ids):
                low, high = (f.reduceat(part[order], starts, axis=0) for f in (np.minimum, np.maximum))
                sizes = np.diff(np.append(starts, len(at)))
                out |= {(t, int(i)): (int(n), lo, hi) for i, n, lo, hi in zip(ids, sizes, low, high, strict=True) if int(i) in self.open[t]}
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; near 1 where few splits cut a row off."""
        total = np.zeros(len(x))
        for tree in self.trees:
            total += tree[3][self._at(tree, x)]
        return 2.0 ** -(total / max(len(self.trees), 1) / self.norm)


def _arrays(nodes: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(np.array(column) for column in zip(*nodes, strict=True))


def _spread(key: np.ndarray, salt: int) -> np.ndarray:
    """32 bits of a key, others for each salt."""
    x = key + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x >> np.uint64(32)


def _merge(parts: list[dict]) -> dict:
    out: dict = {}
    for part in parts:
        for k, (n, low, high) in part.items():
            m, lo, hi = out.get(k, (0, low, high))
            out[k] = (m + n, np.minimum(lo, low), np.maximum(hi, high))
    return out


class Rules:
    """The fitted forest, or none, and the score from which documents are rejected."""

    def __init__(self, forest: Forest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def verdict(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        failed = base_failed(c)
        score = self.forest.score(rates(c)) if self.forest and len(c) else np.zeros(len(c))
        return failed, score, ~failed & (score <= self.threshold)


def _count(batches):
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("counts", pa.list_(pa.int64()))])
    for batch in batches:
        for some in slices(batch, "text", 4 << 20):
            yield record_batch(schema, [column(some, "id"), column(some, "text_hash"), pa.array(count(bytes_of(some, "text")).tolist(), pa.list_(pa.int64()))])
    give_back()


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return rates(column(batch, "counts").flatten().to_numpy().reshape(-1, 11))


def _statistics(batches, forest, share: float):
    schema = pa.schema([("tree", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), *((f"{k}{i}", pa.float64()) for k in ("low", "high") for i in range(8))])
    found: dict = {}
    for batch in batches:
        if batch.num_rows:
            found = _merge([found, forest.value.statistics(_matrix(batch), column(batch, "key").to_numpy().view(np.uint64), share)])
    if found:
        of = list(found.values())
        bounds = np.concatenate([np.array([x[k] for x in of]) for k in (1, 2)], 1)
        yield record_batch(schema, [[k[0] for k in found], [k[1] for k in found], [x[0] for x in of], *bounds.T])


def _scores(batches, forest):
    schema = pa.schema([("good", pa.bool_()), ("score", pa.float64())])
    for batch in batches:
        if batch.num_rows:
            yield record_batch(schema, [column(batch, "good"), forest.value.score(_matrix(batch))])


def _kth(scores: DataFrame, k: int, bins: int = 4096) -> float:
    """The score of rank ``k`` from 0, exact: the bin that has it is cut again until it has one value."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        part = F.least(F.floor((F.col("score") - low) / (high - low) * bins), F.lit(bins - 1))
        rows = scores.where(F.col("score").between(low, high)).groupBy(part.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy("bin").collect()
        for r in rows:
            if k < r["n"]:
                break
            k -= r["n"]
        low, high = r["low"], r["high"]
    return low


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lose: float = 0.003, trees: int = 100, rows: int = 256, seed: int = 7) -> Rules:
    """Fit on all labelled ids; of rows with the same id, on the one whose text has the smallest hash.

    Good rows are those of quality 1 that aren't toxic. Half of the good ones grow
    the forest; on the others the score is found that rejects a share ``lose`` of
    them. The threshold lies half way from there to the next score of a bad row:
    it rejects as many of the known bad rows, and spares what lies between.
    """
    picked = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), F.lit(False)).alias("good"), F.col("quality"))
    picked = picked.where(F.col("good") | (F.col("quality") == 0)).groupBy("id").agg(F.min("good").alias("good"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    counted = own.mapInArrow(_count, "id long, text_hash long, counts array<long>").join(picked, "id")
    counted = counted.groupBy("id", "good").agg(F.min(F.struct("text_hash", "counts")).alias("one")).select("good", "one.counts", F.xxhash64("id").alias("key"))  # a row for each id, whatever their order
    failed = (F.col("counts")[0] < 10) | (100 * F.col("counts")[4] > 20 * F.col("counts")[0])
    known = materialize(counted.where(~failed), "labelled")
    growing = F.col("good") & (F.pmod(F.xxhash64("key"), F.lit(2)) == 0)
    sizes = known.agg(F.count(F.when(growing, 1)).alias("grow"), F.count(F.when(F.col("good") & ~growing, 1)).alias("held")).first()
    if sizes["grow"] < 4 or sizes["held"] < 4:
        return Rules(None, 1.0)
    context, base = docs.sparkSession.sparkContext, known.where(growing).select("counts", "key")
    bounds = [f"{k}{i}" for k in ("low", "high") for i in range(8)]

    def ask(forest: Forest) -> dict:
        shared = context.broadcast(forest)
        found = base.mapInArrow(partial(_statistics, forest=shared, share=forest.share(sizes["grow"])), "tree long, node long, n long, " + ", ".join(f"{c} double" for c in bounds))
        found = found.groupBy("tree", "node").agg(F.sum("n").alias("n"), *[(F.min if c[0] == "l" else F.max)(c).alias(c) for c in bounds]).collect()  # a row for each node of a level
        shared.unpersist()
        return {(r["tree"], r["node"]): (r["n"], np.array([r[c] for c in bounds[:8]]), np.array([r[c] for c in bounds[8:]])) for r in found}

    forest = Forest()
    forest.grow(ask, sizes["grow"], trees, rows, seed)
    scored = materialize(known.where(~growing).select("good", "counts").mapInArrow(partial(_scores, forest=context.broadcast(forest)), "good boolean, score double"), "scores")
    held, place = scored.where("good"), (sizes["held"] - 1) * (1 - lose)
    below, above = (_kth(held, k) for k in (int(np.floor(place)), int(np.ceil(place))))
    threshold = below + (above - below) * (place - np.floor(place))
    beyond = scored.where(~F.col("good") & (F.col("score") > float(threshold))).agg(F.min("score")).first()[0]
    return Rules(forest, float(threshold) if beyond is None else (float(threshold) + beyond) / 2)


def _judge(batches, rules):
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in COUNTS), ("base_failed", pa.bool_()), ("anomaly", pa.float64()), ("kept", pa.bool_())])
    for batch in batches:
        for some in slices(batch, "text", 4 << 20):
            c = count(bytes_of(some, "text"))
            failed, score, kept = rules.value.verdict(c)
            yield record_batch(schema, [column(some, "doc_id"), *c[:, :5].T, failed, score, kept])
    give_back()


def _keep(batches, rules, text_col: str):
    for batch in batches:
        for some in slices(batch, text_col, 4 << 20):
            yield some.filter(pa.array(rules.value.verdict(count(bytes_of(some, text_col)))[2]))
    give_back()


def judge(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the base counts, whether the base rules reject it, its anomaly score and whether it is kept."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(rules)
    return own.mapInArrow(partial(_judge, rules=shared), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly double, kept boolean")


def keep_good(docs: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are kept."""
    return docs.mapInArrow(partial(_keep, rules=docs.sparkSession.sparkContext.broadcast(rules), text_col=text_col), docs.schema)
