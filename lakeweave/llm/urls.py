"""URL filters: rules by host and path, and a character-model ratio for the rest.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, give
each URL a log-likelihood difference per character; one above a calibrated limit
is blocked. A context's prediction is mixed with that of the next shorter one by
how often the context was seen. The URLs that rules decide are the training data:
three quarters of them, by hash of the host, grow the models and the others set
the limit. Counts come from all of them, summed per task first. The order is the
same at every size: models of more than ``most_rows`` n-grams are cut into pieces by
the two bytes before an n-gram's last, and workers load one piece at a time.

Nulls: a null URL, or one without ``://``, has an empty host and path, is fitted
by no rule and is allowed. Repeated rows are judged one by one. Without URLs that
rules accept, or any that they reject, no other is blocked. Other columns are not
read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import bytes_of, column, materialize, record_batch, slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER, BITS = 5, 40
#: Rows of both models that a worker may hold at once, 16 bytes each (larger models come in pieces of a quarter of that), and steps of the score per nat in histograms.
MOST_ROWS, STEPS = 2_000_000, 200
ALLOW, BLOCK = "allow", "block"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null. A rule is a host and the start of a path; it fits subdomains too."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, rule).otherwise(found)
    return found


def _grams(data: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte how many bytes of its URL stand before it, up to ``order - 1``; and the n-gram that it ends."""
    back = np.minimum(np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))), order - 1)
    code = np.zeros(len(data), np.int64)
    for k in range(order):
        shifted = np.zeros(len(data), np.int64)
        shifted[k:] = data[: len(data) - k]
        code += np.where(back >= k, shifted << (8 * k), 0)
    return back, code


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, where each text that isn't empty begins, and the sizes of all."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), (np.cumsum(sizes) - sizes)[sizes > 0], sizes


def _keys(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    back, code = _grams(data, starts, order)
    return np.concatenate([(k << BITS) | code[back >= k - 1] & ((1 << 8 * k) - 1) for k in range(1, order + 1)])


def _count(batches, order: int):
    schema = pa.schema([("bad", pa.bool_()), ("key", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for some in slices(batch, "text", 4 << 20):
            bad, texts = column(some, "bad").to_pylist(), bytes_of(some, "text")
            for kind in (False, True):
                data, starts, _ = _joined([t for t, b in zip(texts, bad, strict=True) if b is kind and t])
                if len(data):
                    keys, counts = np.unique(_keys(data, starts, order), return_counts=True)
                    yield record_batch(schema, [[kind] * len(keys), keys, counts])


class Markov:
    """Counts of n-grams up to ``order``; the mixture's weight for a context seen n times is n / (n + ``mix``)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, mix: float = 4.0):
        self.order, self.mix = order, mix
        self.keys, self.counts = keys[i := np.argsort(keys)], counts[i].astype(np.float64)
        # A context's count is the sum over what follows it: the n-grams with the same bytes but the last.
        above = (self.keys >> BITS) << BITS | (self.keys & ((1 << BITS) - 1)) >> 8
        self.contexts, inverse = np.unique(above, return_inverse=True)
        self.totals = np.bincount(inverse, self.counts, len(self.contexts)) if len(keys) else np.zeros(0)

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def logs(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.logs_of(*_grams(data, starts, self.order))

    def logs_of(self, back: np.ndarray, code: np.ndarray) -> np.ndarray:
        p = np.full(len(code), 1 / 256)
        for k in range(1, self.order + 1):
            at = np.flatnonzero(back >= k - 1)
            c = code[at] & ((1 << 8 * k) - 1)
            n, total = self._look(self.keys, self.counts, k << BITS | c), self._look(self.contexts, self.totals, k << BITS | c >> 8)
            p[at] = (n + self.mix * p[at]) / (total + self.mix)
        return np.log(p)


def _piece(cell, pieces: int):
    """The piece of the models that has the n-grams of 3 or more bytes with these two bytes before the last; of Columns or arrays."""
    return cell * 40503 % 65521 % pieces


class Ratio:
    def __init__(self, good: Markov, bad: Markov):
        self.good, self.bad = good, bad

    def logs(self, back: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.bad.logs_of(back, code) - self.good.logs_of(back, code)


def score(ratios: list, texts: list[bytes], order: int) -> np.ndarray:
    """How much likelier a text is among the rejected, in nats per byte; 0 for an empty one. ``ratios``: broadcasts of all pieces."""
    data, starts, sizes = _joined(texts)
    if not len(data):
        return np.zeros(len(texts))
    back, code = _grams(data, starts, order)
    if len(ratios) == 1:
        logs = ratios[0].value.logs(back, code)
    else:
        logs, piece = np.zeros(len(data)), _piece(code >> 8 & 0xFFFF, len(ratios))
        for i, held in enumerate(ratios):
            if len(at := np.flatnonzero(piece == i)):
                logs[at] = held.value.logs(back[at], code[at])
                vars(held).pop("_value", None)  # read again from its file when it is wanted again
    total, ends = np.append(0, np.cumsum(logs)), np.cumsum(sizes)
    return (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)


def _score(batches, ratios, order: int):
    for batch in batches:
        for some in slices(batch, "text", 4 << 20):
            yield some.append_column("score", pa.array(score(ratios, [t or b"" for t in bytes_of(some, "text")], order)))


def _models(counts: DataFrame, order: int, most_rows: int) -> tuple[list, bool]:
    """Broadcasts of the two models, in as many pieces as they need, and whether neither is empty. N-grams of 1 and 2 bytes are in every piece."""
    sc = counts.sparkSession.sparkContext

    def shared(found):
        models = [Markov(found.loc[found["bad"] == b, "key"].to_numpy(np.int64), found.loc[found["bad"] == b, "n"].to_numpy(np.int64), order) for b in (False, True)]
        return sc.broadcast(Ratio(*models)), all(len(m.keys) for m in models)

    found = counts.limit(most_rows + 1).toPandas()
    if len(found) <= most_rows:
        ratio, both = shared(found)
        return [ratio], both
    del found
    counts = materialize(counts, "url-grams")
    pieces = 1 + counts.count() // max(1, most_rows // 4)
    own = _piece(F.shiftright("key", 8).bitwiseAND(0xFFFF), pieces)
    parts = [shared(counts.where((F.shiftright("key", BITS) <= 2) | (own == i)).toPandas()) for i in range(pieces)]
    return [ratio for ratio, _ in parts], all(both for _, both in parts)


def judge_urls(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", order: int = ORDER, wrong: float = 0.01, most_rows: int = MOST_ROWS) -> DataFrame:
    """Per page: host, path, the rule that fits, the score and the verdict.

    ``rules`` maps ``host/path`` to ``allow`` or ``block``. The limit is the score
    that a share ``wrong`` of accepted URLs exceeds, 0 at least.
    """
    host, path = split_url(F.col("url"))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    own = own.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "text": F.concat("host", "path")})
    given = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        given = F.when(F.col("rule") == rule, verdict).otherwise(given)
    ruled = own.where("rule is not null").select("text", (given == BLOCK).alias("bad"), (F.pmod(F.xxhash64("host"), F.lit(4)) == 0).alias("held"))
    counts = ruled.where("not held").select("text", "bad").mapInArrow(partial(_count, order=order), "bad boolean, key long, n long")
    ratios, both = _models(counts.groupBy("bad", "key").agg(F.sum("n").alias("n")), order, most_rows)
    limit = float("inf")
    if both:
        held = ruled.where("held and not bad").select("text").mapInArrow(partial(_score, ratios=ratios, order=order), "text string, score double")
        steps = held.groupBy(F.floor(F.col("score") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("step")
        limit = 0.0
        if len(steps):
            reach = np.cumsum(steps["n"].to_numpy()) >= (1 - wrong) * steps["n"].sum()
            limit = max(0.0, float((steps["step"].to_numpy()[np.argmax(reach)] + 1) / STEPS))
    scored = own.mapInArrow(partial(_score, ratios=ratios, order=order), "page_id long, host string, path string, rule string, text string, score double")
    verdict = F.coalesce(given, F.when((F.col("score") > limit) & (F.col("text") != ""), BLOCK).otherwise(ALLOW))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
