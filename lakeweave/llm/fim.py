"""Fill-in-middle: texts cut at units and reordered, as relations all the way.

A unit is a run of ASCII letters or one other character. Each text is dealt by its
key, its units become rows (``posexplode``), a running sum over the units of a text
gives every unit's end, two cut requests per text meet the units by their ordinal, and
the answers are gathered per text and cut it by ``substring``. Only units before the
later cut are made into rows. A text moves in one shuffle, as the row of ordinal 0
before its units; units, running sums, requests and answers stay in its partition.

No Python runs anywhere; Spark splits and spills the rows of very long texts.

Nulls: a null text is empty; a null id counts as the empty string after ``1:``.
Empty texts, texts with a sentinel inside and a tenth of all others stay plain. Both
cuts may be equal, or lie at the start or the end, which leaves parts empty. Rows with
the same id and text are told apart by their partition and number, so each gives
its own row; their results are the same. An empty table gives no rows. Other columns
are not read and may have any names.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

UNIT = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are reordered, and of a hundred of these so many suffix first.
REORDERED, SUFFIX_FIRST = 90, 20
KEY = ["k1", "k2", "part"]


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits as a number, k from 1."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def choose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n units, form, and the ordinals of the first and the second cut, for each document."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumns({"n": F.char_length(F.regexp_replace("text", "[A-Za-z]+", "a")).cast("long"), "digest": F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)})
    h1, h2, h3, h4 = (_draw(F.col("digest"), k) for k in (1, 2, 3, 4))
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    plain = (F.col("text") == "") | F.contains(F.col("text"), F.lit(PREFIX)) | F.contains(F.col("text"), F.lit(SUFFIX)) | F.contains(F.col("text"), F.lit(MIDDLE)) | (h3 % 100 >= REORDERED)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    return own.select("doc_id", "text", "n", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def deal(chosen: DataFrame, partitions: int | None = None) -> DataFrame:
    """Documents dealt by their content (two hashes) and where they came from, with a number among equal rows.

    Rows that are equal in all columns are spread by the partition they come from, as
    one may make up a large part of the table.
    """
    some = partitions or 4 * int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = chosen.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "text", "doc_id"), "part": F.spark_partition_id()})
    return keyed.repartition(some, *KEY).withColumn("number", F.row_number().over(W.partitionBy(*KEY).orderBy("k1")))


def unit_ends(dealt: DataFrame) -> DataFrame:
    """A row for each unit before the later cut with the characters up to its end, and one for each document, with ordinal 0."""
    matches = F.slice(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), F.lit(1), F.col("second").cast("int"))
    units = F.when((F.col("form") != "plain") & (F.col("number") == 1), matches).otherwise(F.array().cast("array<string>"))
    rows = dealt.select(*KEY, "doc_id", "text", "n", "form", F.posexplode(F.concat(F.array(F.lit("")), units)).alias("ordinal", "unit"))
    doc = F.when(F.col("ordinal") == 0, F.struct("doc_id", "text", "n", "form")).alias("doc")
    upto = W.partitionBy(*KEY).orderBy("ordinal").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select(*KEY, "ordinal", F.char_length("unit").alias("length"), doc).select(*KEY, "ordinal", "doc", F.sum("length").over(upto).alias("end"))


def answered(dealt: DataFrame) -> DataFrame:
    """Each document with the characters before its cuts, null where a cut comes before all units.

    All joins and windows are by the key that the documents are dealt by, so no unit is
    shuffled. Units are streamed past the two requests of their text.
    """
    requests = dealt.where("number = 1").select(*KEY, F.posexplode(F.array("first", "second")).alias("which", "units_before"))
    met = F.when(F.col("ordinal") == 0, F.col("which") == 0).otherwise(F.col("ordinal") - F.col("units_before") == 0)
    hits = unit_ends(dealt).hint("merge").join(requests, KEY).where(met)
    at = lambda which: F.max(F.when((F.col("which") == which) & (F.col("ordinal") > 0), F.col("end"))).over(W.partitionBy(*KEY))
    return hits.select("ordinal", "doc", at(0).alias("first_at"), at(1).alias("second_at")).where("ordinal = 0").select("doc.*", "first_at", "second_at")


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    part = lambda k: F.element_at(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), k)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(2), part(4), part(3))).otherwise(F.concat(part(3), part(4), part(2)))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Per document: doc_id, text, n, form, output, prefix_chars and middle_chars (null if plain)."""
    found = answered(deal(choose(docs, id_col, text_col), partitions))
    first, second = (F.when(F.col("form") != "plain", F.coalesce(c, F.lit(0))).cast("int") for c in ("first_at", "second_at"))
    text, chars = F.col("text"), F.char_length("text")
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, chars - second)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm)
    return found.select("doc_id", "text", "n", "form", output.alias("output"), first.cast("long").alias("prefix_chars"), (second - first).cast("long").alias("middle_chars"))
