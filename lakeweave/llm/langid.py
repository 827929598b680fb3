"""Language identification that weighs several kinds of evidence by Bayes' rule.

A text's likelihood under each language comes from byte trigrams in a table of
fixed size, fitted on a sample of labelled texts of each language. The declared
language and the address suffix count by how often they go with each language;
hosts give a prior, smoothed towards that of their domain, which is smoothed
towards that of all. These counts are grouped aggregates over all rows, each row
adding its text's own posterior; a row is judged by what the others of its host
say, its own part taken out. Counts are summed per task first, and a row per host,
not per page, is joined back.

Nulls: a null or empty text, a null declaration, suffix or host each leave their
kind of evidence out. Repeated rows count each. Of equally likely languages the
first by name is taken. Very long texts are read whole; markup is taken out in one
pass. Without labelled text, or rows, the language is null. Other columns are not
read, and may have any names.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import bytes_of, column, materialize, record_batch, slices
from .urls import split_url

TABLE_BITS = 16
_OPEN = re.compile(rb"(?i)<(?:(script|style)\b|(!--))?")
_CLOSE = {b"script": re.compile(rb"(?i)</script\s*>"), b"style": re.compile(rb"(?i)</style\s*>")}
#: Trigrams of one text are not independent: as evidence it counts for this many at most.
MOST_EVIDENCE = 40.0


def visible(html: bytes) -> bytes:
    """The text of a page without scripts, styles, comments and tags; what has no end is text.

    An end that is once found missing is not looked for again, so a page of any kind takes one pass.
    """
    out, at, missing = [], 0, set()

    def end_of(kind: bytes, search) -> int:
        end = -1 if kind in missing else search()
        if end < 0:
            missing.add(kind)
        return end

    while b">" not in missing and (m := _OPEN.search(html, at)):
        name, end = (m[1] or m[2] or b"").lower(), -1
        if name == b"!--":
            end = end_of(name, lambda: html.find(b"-->", m.end()) + 3 if html.find(b"-->", m.end()) >= 0 else -1)  # noqa: B023
        elif name:
            end = end_of(name, lambda: found.end() if (found := _CLOSE[name].search(html, m.end())) else -1)  # noqa: B023
        if end < 0:  # a plain tag
            end = end_of(b">", lambda: html.find(b">", m.start()) + 1 or -1)  # noqa: B023
        if end < 0:
            break
        out += (html[at : m.start()], b" ") if end > m.start() + 2 else (html[at:end],)
        at = end
    return b"".join([*out, html[at:]])


def features(text: bytes) -> np.ndarray:
    x = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    if len(x) < 4:
        return np.zeros(0, np.int64)
    h = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    return (h * np.uint32(0x9E3779B1) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)


class Languages:
    """Log probabilities of trigrams, from (language, trigram's place, count)."""

    def __init__(self, counts: list[tuple[str, int, int]], smooth: float = 0.5):
        self.names = sorted({lang for lang, _, _ in counts})
        table, at = np.zeros((1 << TABLE_BITS, len(self.names))), {c: i for i, c in enumerate(self.names)}
        for lang, place, n in counts:
            table[place, at[lang]] += n
        self.logs = np.log((table + smooth) / (table.sum(0) + smooth * (1 << TABLE_BITS))).astype(np.float32)

    @staticmethod
    def of(rows: list[tuple[str, bytes]]) -> "Languages":
        return Languages([(lang, int(f), 1) for lang, text in rows for f in features(text)])

    def evidence(self, text: bytes | None) -> np.ndarray:
        """Log likelihood of each language, less that of the best."""
        f = features(text) if text else np.zeros(0, np.int64)
        if not len(f) or not self.names:
            return np.zeros(len(self.names))
        total = sum(self.logs[f[k : k + 65536]].sum(0, dtype=np.float64) for k in range(0, len(f), 65536))
        total *= min(1.0, MOST_EVIDENCE / len(f))
        return total - total.max()


def _features(batches):
    schema = pa.schema([("lang", pa.string()), ("place", pa.int64()), ("n", pa.int64())])
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for some in slices(batch, "text", 4 << 20):
            for lang, text in zip(column(some, "lang").to_pylist(), bytes_of(some, "text"), strict=True):
                held[lang] = held.get(lang, 0) + np.bincount(features(text), minlength=1 << TABLE_BITS)
    for lang, table in held.items():
        at = np.flatnonzero(table)
        yield record_batch(schema, [[lang] * len(at), at, table[at]])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 2000) -> Languages:
    """From about ``sample`` labelled texts of each language: those whose hash lies below its language's bound, or all if there are fewer."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("id is not null and lang is not null and text is not null")
    bound = rows.groupBy("lang").agg(F.least(F.lit(1.0), sample / F.count(F.lit(1))).alias("share"))
    picked = rows.join(F.broadcast(bound), "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    # At most 65,536 rows a language, whatever the texts' length.
    counts = picked.select("lang", "text").mapInArrow(_features, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    return Languages([tuple(r) for r in counts.collect()])


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, markup, declared, suffix, host) of web pages."""
    host, _ = split_url(F.col(url_col).cast("string"))
    declared = F.lower(F.regexp_extract(F.col(html_col).cast("string"), r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("text"), F.lit(True).alias("markup"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    return rows.select("id", "text", "markup", "declared", F.substring_index("host", ".", -1).alias("suffix"), "host")


def from_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", declared_col: str | None = None) -> DataFrame:
    """The same of plain documents, with their source as host. A declaration is read only where a column other than the one fitted on has it."""
    declared = F.col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(False).alias("markup"), declared.alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col(source_col).cast("string").alias("host"))


def _evidence(batches, languages):
    schema = pa.schema([("id", pa.int64()), ("markup", pa.bool_()), ("declared", pa.string()), ("suffix", pa.string()), ("host", pa.string()), ("logs", pa.list_(pa.float64()))])
    for batch in batches:
        for some in slices(batch, "text", 4 << 20):
            logs = [languages.value.evidence(visible(t) if m and t else t).tolist() for t, m in zip(bytes_of(some, "text"), column(some, "markup").to_pylist(), strict=True)]
            yield record_batch(schema, [*(column(some, c) for c in ("id", "markup", "declared", "suffix", "host")), pa.array(logs, pa.list_(pa.float64()))])


def _sums(names: list[str]) -> list[Column]:
    """Per language, the sum of the rows' own posteriors."""
    mass = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x))
    return [F.sum(F.exp(F.col("logs")[i]) / mass).alias(f"s{i}") for i in range(len(names))]


def identify(rows: DataFrame, languages: Languages, smooth: float = 1.0, host_weight: float = 8.0, domain_weight: float = 32.0) -> DataFrame:
    """Per row (``from_pages`` or ``from_documents``): the likeliest language, its posterior, and what the text alone says."""
    names, n = languages.names, len(languages.names)
    if not n:
        return rows.select("id", "markup", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_language"))
    own = materialize(rows.mapInArrow(partial(_evidence, languages=rows.sparkSession.sparkContext.broadcast(languages)), "id long, markup boolean, declared string, suffix string, host string, logs array<double>"), "evidence")
    own = own.withColumn("domain", domain_of(F.col("host")))
    array = lambda f: F.array(*[f(i) for i in range(n)])
    # One pass: a row per host and what it declares; all other counts are sums of these.
    hosts = materialize(own.groupBy("markup", "host", "domain", "declared", "suffix").agg(*_sums(names)), "evidence-sums")
    sums = lambda *by: hosts.groupBy(*by).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)])
    every = sums("markup").select("markup", *[F.col(f"s{i}").alias(f"t{i}") for i in range(n)])
    total = sum((F.col(f"t{i}") for i in range(n)), F.lit(0.0))
    base = every.select("markup", array(lambda i: (F.col(f"t{i}") + smooth) / (total + n * smooth)).alias("base"), *[f"t{i}" for i in range(n)])

    def goes_with(name: str) -> DataFrame:
        # P(value | language), against its mean over languages
        t = sums("markup", name).where(F.col(name).isNotNull()).join(F.broadcast(base), "markup")
        p = [(F.col(f"s{i}") + 0.01 * smooth) / (F.col(f"t{i}") + smooth) for i in range(n)]
        return t.select("markup", name, array(lambda i: F.log(p[i])).alias(f"of_{name}"))

    def prior(name: str, above: DataFrame, key: list[str], weight: float, up: str) -> DataFrame:
        t = sums("markup", *key).where(F.col(name).isNotNull()).join(above, [c for c in above.columns if c in ("markup", *key)])
        size = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0))
        return t.select("markup", *key, array(lambda i: F.col(f"s{i}") + weight * F.col(up)[i]).alias(f"of_{name}"), size.alias(f"{name}_size"), array(lambda i: (F.col(f"s{i}") + weight * F.col(up)[i]) / (size + weight)).alias(f"prior_{name}"))

    domains = prior("domain", F.broadcast(base.select("markup", "base")), ["domain"], domain_weight, "base")
    by_host = prior("host", domains, ["host", "domain"], host_weight, "prior_domain").select("markup", "host", "of_host", "host_size")
    fused = own.join(F.broadcast(base.select("markup", "base")), "markup").join(goes_with("declared"), ["markup", "declared"], "left").join(goes_with("suffix"), ["markup", "suffix"], "left").join(by_host, ["markup", "host"], "left")
    zero = F.array(*[F.lit(0.0)] * n)
    # A host's prior without what the row itself has added to it.
    mass = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x))
    others = lambda i: F.greatest(F.col("of_host")[i] - F.exp(F.col("logs")[i]) / mass, F.lit(1e-9)) / (F.col("host_size") - 1 + host_weight)
    score = lambda i: F.col("logs")[i] + F.coalesce("of_declared", zero)[i] + F.coalesce("of_suffix", zero)[i] + F.log(F.coalesce(others(i), F.col("base")[i]))
    fused = fused.select("id", "markup", "logs", array(score).alias("score"))
    fused = fused.withColumn("best", F.array_max("score")).withColumn("mass", F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best"))))
    name = lambda scores, top: F.element_at(F.array(*map(F.lit, names)), F.array_position(scores, top).cast("int"))
    alone = F.when(F.array_min("logs") < F.array_max("logs"), name("logs", F.array_max("logs")))
    return fused.select("id", "markup", name("score", F.col("best")).alias("language"), (1 / F.col("mass")).alias("posterior"), alone.alias("text_language"))
