"""Other inputs and outputs: node dictionaries, edge text files, caches, splits, events."""

from __future__ import annotations

import hashlib
import json
import resource
import threading
import time
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

from ..functions.text import row_index, table_key


def node_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, kind, table_name, column_name, row_idx) of ``{kind: {key: id}}``; keys that aren't of their kind are left out."""
    raw = spark.read.option("wholetext", True).text(path)
    maps = raw.select(F.from_json("value", "map<string,map<string,bigint>>").alias("m")).select(F.explode("m").alias("kind", "ids"))
    rows = maps.select("kind", F.explode("ids").alias("key", "node_id"))
    part = lambda k: F.regexp_extract("key", r"""^\(\s*['"](.*?)['"]\s*,\s*['"]?(.*?)['"]?\s*\)$""", k)
    named = rows.withColumns({"table_name": F.when(F.col("kind") == "table", F.col("key")).otherwise(F.nullif(part(1), F.lit(""))), "second": part(2)})
    out = named.select("node_id", "kind", "table_name", F.when(F.col("kind") == "column", F.nullif("second", F.lit(""))).alias("column_name"), F.when(F.col("kind") == "row", row_index("second")).alias("row_idx"))
    return out.where("table_name is not null and (kind = 'table' or kind = 'column' and column_name is not null or kind = 'row' and row_idx is not null)")


def _lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(edge_id, name): a text file's lines with their numbers, which come from sizes of its blocks, not one task."""
    t = spark.read.text(path).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"), F.col("value").alias(name))
    t = t.withColumn("i", F.col("m") - F.shiftleft(F.col("p").cast("long"), 33))
    sizes = t.groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return t.join(F.broadcast(sizes.select("p", "base")), "p").select((F.col("base") + F.col("i")).alias("edge_id"), name)


def edge_files(spark: SparkSession, folder: str) -> DataFrame:
    """(edge_id, label, nodes, size, edge_type, train, validate, test) of line-aligned text files; short masks count as 0."""
    out = _lines(spark, f"{folder}/edge_lists.txt", "list")
    for name, file in (("label", "edge_labels"), ("edge_type", "edge_type"), ("train", "train_mask"), ("validate", "validate_mask"), ("test", "test_mask")):
        out = out.join(_lines(spark, f"{folder}/{file}.txt", name), "edge_id", "left")
    nodes = F.transform(F.slice(F.split("list", "\t"), 1, 4), lambda x: F.trim(x).cast("long"))
    mask = lambda c: (F.coalesce(F.trim(c), F.lit("0")) == "1").alias(c)
    return out.select("edge_id", F.trim("label").cast("tinyint").alias("label"), nodes.alias("nodes"), F.size(nodes).alias("size"), F.trim("edge_type").alias("edge_type"), *map(mask, ("train", "validate", "test")))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def split_rows(split: DataFrame, most: int | None = None) -> DataFrame:
    """(table_name, row_idx) named by a split's pairs, either spelling of a table counting as one; all of them, or the first ``most`` if that is given."""
    one = split.select(table_key("ltable_name").alias("table_name"), row_index("l_id").alias("row_idx"))
    two = split.select(table_key("rtable_name").alias("table_name"), row_index("r_id").alias("row_idx"))
    found = one.unionByName(two).where("row_idx is not null").distinct()
    return found if most is None else found.orderBy("table_name", "row_idx").limit(most)


def write_archive(rows: DataFrame, path: str, track: str, settings: dict) -> None:
    """Scored rows of a track (selection or evaluation) with what is needed to score them again, beside its settings."""
    rows.write.mode("overwrite").parquet(f"{path}/{track}/rows")
    rows.sparkSession.createDataFrame([(json.dumps(settings, sort_keys=True),)], "settings string").coalesce(1).write.mode("overwrite").json(f"{path}/{track}/settings")


def read_archive(spark: SparkSession, path: str, track: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/{track}/rows"), json.loads(spark.read.json(f"{path}/{track}/settings").first()["settings"])


def hit_ratios(calls: DataFrame, cache: str, key: list[str]) -> DataFrame:
    """(cache, hits, misses, hit_ratio) of calls by key: a key's first call misses. 0 without calls."""
    per = calls.groupBy(cache, *key).agg(F.count(F.lit(1)).alias("c"))
    sums = per.groupBy(cache).agg(F.sum(F.col("c") - 1).alias("hits"), F.count(F.lit(1)).alias("misses"))
    n = F.col("hits") + F.col("misses")
    return sums.withColumn("hit_ratio", F.when(n > 0, F.col("hits") / n).otherwise(0.0))


def pair_digest(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row, ``digest``: 16 hex digits over the set of canonical pairs, whatever their order.

    Each pair's own hash is added up, so no task sees them all.
    """
    h = F.xxhash64(F.least(a, b), F.greatest(a, b)).cast("decimal(38,0)")
    return pairs.agg(F.substring(F.sha1(F.concat_ws(":", F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0)))), 1, 16).alias("digest"))


#: Version of what ``cached`` keeps; entries of another one are made anew.
VERSION = 1


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, path: str, config: dict) -> str | None:
    """What is wrong with an entry; None if it is whole and fits."""
    p, fs = _file_system(spark, f"{path}/manifest")
    if not fs.exists(p):
        return "no manifest"
    row = spark.read.text(f"{path}/manifest").first()
    try:
        said = json.loads(row["value"]) if row else {}
    except json.JSONDecodeError:
        return "no readable manifest"
    if said.get("version") != VERSION or said.get("config") != json.loads(json.dumps(config)):
        return "another version or other flags"
    found = spark.read.parquet(f"{path}/data")
    if found.schema.jsonValue() != said.get("schema"):
        return "another schema"
    return None if found.count() == said.get("rows") else "other rows than were written"


def cached(spark: SparkSession, folder: str, config: dict, make) -> DataFrame:
    """The table that ``make()`` gives for a configuration, kept below ``folder``.

    An entry is made beside its place, with a manifest of version, flags, schema and number of
    rows, and published by one rename that never replaces another; who comes second
    drops its own and reads the first's. An entry without a fitting manifest is put aside
    and made anew. (On stores whose rename copies, publishing is not one step.)
    """
    key = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
    path, own = f"{folder}/{key}", f"{folder}/.{key}-{uuid.uuid4().hex}"
    place, fs = _file_system(spark, path)
    jvm = spark.sparkContext._jvm
    if fs.exists(place):
        if _manifest(spark, path, config) is None:
            return spark.read.parquet(f"{path}/data")
        fs.rename(place, jvm.org.apache.hadoop.fs.Path(f"{folder}/.broken-{key}-{uuid.uuid4().hex}"))
    make().write.parquet(f"{own}/data")
    found = spark.read.parquet(f"{own}/data")
    manifest = json.dumps({"version": VERSION, "config": config, "schema": found.schema.jsonValue(), "rows": found.count()}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{own}/manifest")
    mine, _ = _file_system(spark, own)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(mine, place, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception:
        if not fs.exists(place) or (wrong := _manifest(spark, path, config)):
            raise RuntimeError(f"the entry at {path} could not be published") from None
        fs.delete(mine, True)
    return spark.read.parquet(f"{path}/data")


def write_scores(scores: DataFrame, path: str) -> None:
    """Scored rows, in a folder for each task and split."""
    scores.write.mode("overwrite").partitionBy("task", "split").parquet(path)


def feature_pool(names: str | Iterable[str], schema: Iterable[str] = ()) -> list[str]:
    """Feature names from a comma-separated text, a list, or else a table's columns; each once, in order."""
    found = names.split(",") if isinstance(names, str) else list(names)
    return list(dict.fromkeys(n.strip() for n in (found or schema) if n.strip()))


class Events:
    """Phases of a run as JSON lines: seconds, rows, and what Spark's own records say of the stages that ran in them.

    Of each phase: rows and bytes read and written, bytes shuffled and spilled, CPU
    seconds, the most execution memory that a task had, and the most heap that an executor and
    resident memory that this process had, by a sampler where ``every`` is set. (Counts by
    ``Observation`` are not used: a session that has had one can't apply logistic models any more.)
    """

    #: name: how a stage's records have it, and how stages are put together.
    STAGE = {"rows_read": ("inputRecords", sum), "bytes_read": ("inputBytes", sum), "rows_shuffled": ("shuffleWriteRecords", sum), "rows_written": ("outputRecords", sum), "bytes_written": ("outputBytes", sum), "shuffle_bytes": ("shuffleWriteBytes", sum), "memory_spilled": ("memoryBytesSpilled", sum), "disk_spilled": ("diskBytesSpilled", sum), "cpu_ns": ("executorCpuTime", sum), "peak_execution_memory": ("peakExecutionMemory", max), "tasks": ("numCompleteTasks", sum)}
    SCHEMA = "phase string, seconds double, stages long, peak_heap long, peak_resident long, samples long, " + ", ".join(f"{k} long" for k in STAGE)

    def __init__(self, spark: SparkSession, every: float | None = None):
        self.spark, self.every, self.rows = spark, every, []

    def _stages(self) -> dict[int, dict[str, int]]:
        jvm, store = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.sc().statusStore()
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        none = jvm.java.util.ArrayList()
        found = store.stageList(none, False, False, self.spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        stages = [found.apply(i) for i in range(found.size())]
        return {(s.stageId(), s.attemptId()): {k: int(getattr(s, name)()) for k, (name, _) in self.STAGE.items()} for s in stages}

    def _memory(self) -> tuple[int, int]:
        """The most heap that an executor has had, and this process's resident bytes."""
        found = self.spark.sparkContext._jsc.sc().statusStore().executorList(False)
        peaks = [found.apply(i).peakMemoryMetrics() for i in range(found.size())]
        heaps = [p.get().getMetricValue("JVMHeapMemory") for p in peaks if p.isDefined()]
        return max([0, *heaps]), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024

    @contextmanager
    def phase(self, name: str):
        began, before, samples, over = time.time(), set(self._stages()), [], threading.Event()

        def sample() -> None:
            while not over.wait(self.every):
                samples.append(self._memory())

        thread = threading.Thread(target=sample, daemon=True) if self.every else None
        if thread:
            thread.start()
        try:
            yield
        finally:
            seconds = time.time() - began
            over.set()
            if thread:
                thread.join()
            samples.append(self._memory())
            own = [v for k, v in self._stages().items() if k not in before]
            told = {k: put([s[k] for s in own] or [0]) for k, (_, put) in self.STAGE.items()}
            self.rows.append({"phase": name, "seconds": seconds, "stages": len(own), "peak_heap": max(s[0] for s in samples), "peak_resident": max(s[1] for s in samples), "samples": len(samples), **told})

    def write(self, path: str) -> None:
        self.spark.createDataFrame(self.rows, self.SCHEMA).coalesce(1).write.mode("append").json(path)


def summarise_events(events: DataFrame) -> DataFrame:
    return events.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("longest"), *[F.max(c).alias(c) for c in ("peak_heap", "peak_execution_memory") if c in events.columns])
