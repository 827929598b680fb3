"""Registered queries over the driver's tables, most with the same in SQL.

A query's name starts with the number of the inventory row it covers. All run
over whole tables; the few pairs of columns come from the schema.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

from ..functions import compiled, generated
from ..functions import text as T
from ..operators import atoms, decoder, encoder, evaluate, graph, learn, profile, report, rerank
from ..sources import files, lake, shared
from ..streaming import scoring
from . import expression, policy, roles, specs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LAKE = [
    lake.Table("region", "r_regionkey", {"r_regionkey": "int", "r_name": "string"}),
    lake.Table("nation", "n_nationkey", {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}),
    lake.Table("customer", "c_custkey", {"c_custkey": "int", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}),
    lake.Table("supplier", "s_suppkey", {"s_suppkey": "int", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}),
    lake.Table("part", "p_partkey", {"p_partkey": "int", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}),
    lake.Table("orders", "o_orderkey", {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"}),
    lake.Table("lineitem", "l_orderkey", {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp"}),
]
ROWS = [t for t in LAKE if t.name in ("customer", "supplier", "part")]
KEYS = ["customer.c_custkey", "customer.c_nationkey", "lineitem.l_orderkey", "lineitem.l_partkey", "lineitem.l_suppkey", "nation.n_nationkey", "nation.n_regionkey", "orders.o_custkey", "orders.o_orderkey", "part.p_partkey", "region.r_regionkey", "supplier.s_nationkey", "supplier.s_suppkey"]

NORM, NULLS = r"regexp_replace(lower(raw), '\.0$', '')", ", ".join(f"'{x}'" for x in T.NULL_LIKE)
NUMERIC = f"regexp_matches(lower(trim(v)), '{T.NUMERIC}')"
HEADER = "regexp_extract_all(lower({}), '[0-9]+|[^_ /0-9]+')"
#: SQL of the lake's values: all, and those that don't count as missing.
CELLS = f"cells AS ({lake.cells_sql(LAKE)})"
VALUES = CELLS + f""", raw_values AS (SELECT table_name, column_name, {NORM} AS v FROM cells WHERE {NORM} <> ''),
vals AS (SELECT table_name, column_name, v, count(*) AS n FROM raw_values GROUP BY ALL)"""
CLEAN = CELLS + f""", cleaned AS (SELECT *, regexp_replace(lower(trim(raw)), '\\.0$', '') AS v FROM cells),
marked AS (SELECT *, v IN ({NULLS}) AS missing FROM cleaned),
vals AS (SELECT table_name, column_name, v, count(*) AS n FROM marked WHERE NOT missing GROUP BY ALL)"""
SHARES = f"""stats AS (SELECT table_name, column_name, CAST(sum(n) AS BIGINT) AS n_values, count(*) AS n_distinct, count(*) / CAST(sum(n) AS DOUBLE) AS unique_ratio,
 coalesce(sum(n) FILTER ({NUMERIC}), 0) / CAST(sum(n) AS DOUBLE) AS numeric_ratio, sum(length(v) * n) / CAST(sum(n) AS DOUBLE) AS avg_len FROM vals GROUP BY ALL)"""


def cells(spark: SparkSession, sf_dir: str, tables: list[lake.Table] | None = None) -> DataFrame:
    return lake.cells(spark, sf_dir, tables or LAKE)


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lake's different cells with their numbers, dealt by value, so that tasks don't grow with the tables."""
    n = shared.parts(*[table(spark, sf_dir, t.name) for t in LAKE])
    return lake.counted(spark, sf_dir, LAKE).repartition(n, "raw")


def with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.concat_ws(".", "table_name", "column_name"))


def key_pairs(spark: SparkSession) -> DataFrame:
    """Pairs of the lake's key columns, of different tables."""
    return spark.createDataFrame([(a, b) for a in KEYS for b in KEYS if a < b and a.split(".")[0] != b.split(".")[0]], "a string, b string")


PAIRS = "keys AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in KEYS) + "]) AS k), pairs AS (SELECT x.k AS a, y.k AS b FROM keys x, keys y WHERE x.k < y.k AND split_part(x.k, '.', 1) <> split_part(y.k, '.', 1))"


# ---- sources and profiles -------------------------------------------------


@query(f"WITH {VALUES}, {SHARES} SELECT table_name, column_name, n_values, n_distinct, unique_ratio, numeric_ratio, avg_len FROM stats")
def s1_a1_a2_a4_a5_join_column_profiles(spark, sf_dir):
    c = shared.written(counted(spark, sf_dir), "counted")
    return profile.join_columns(c).select("table_name", "column_name", "n_values", "n_distinct", "unique_ratio", "numeric_ratio", "avg_len")


@query(f"WITH {CLEAN}, {SHARES}, m AS (SELECT table_name, column_name, avg(CAST(missing AS DOUBLE)) AS missing_ratio FROM marked GROUP BY ALL) SELECT table_name, column_name, missing_ratio, n_distinct, unique_ratio, numeric_ratio, avg_len FROM m JOIN stats USING (table_name, column_name)")
def s4_a3_schema_column_profiles(spark, sf_dir):
    c = shared.written(counted(spark, sf_dir), "counted")
    return profile.schema_columns(c, shared.written(profile.schema_counts(c), "counts")).select("table_name", "column_name", "missing_ratio", "n_distinct", "unique_ratio", "numeric_ratio", "avg_len")


@query(f"WITH {CELLS} SELECT table_name, count(DISTINCT column_name) AS n_cols, count(*) FILTER (col_idx = 0) AS n_rows, list_sort(list_distinct(flatten(list({HEADER.format('column_name')})))) AS header_tokens FROM cells GROUP BY 1")
def s5_union_table_profiles(spark, sf_dir):
    return profile.union_tables(shared.written(counted(spark, sf_dir), "counted")).select("table_name", "n_cols", "n_rows", "header_tokens")


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)
SELECT doc_id, sha256(text) AS text_sha256, lang, source FROM d""")
def s1_s2_csv_scan(spark, sf_dir):
    """Documents written as CSV and scanned again: texts hold line ends and quotes, rows are put together by their numbers."""
    root = shared.folder(spark, "csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root)
    parts = sorted({r[0].rsplit("/", 1)[1] for r in spark.read.text(root).select("_metadata.file_path").distinct().collect()})
    wide = lake.csv_cells(spark, root, parts).groupBy("table_name", "row_idx").pivot("column_name", ["doc_id", "text", "lang", "source"]).agg(F.first("raw"))
    return wide.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"), "lang", "source")


ROW_SQL = f"""cells AS ({lake.cells_sql(ROWS)}),
cleaned AS (SELECT *, table_name || ':' || row_idx AS id, regexp_replace(lower(trim(raw)), '\\.0$', '') AS v FROM cells),
marked AS (SELECT *, v IN ({NULLS}) AS missing, {HEADER.format('column_name')} AS h, regexp_extract_all(v, '[a-z0-9]+') AS t FROM cleaned),
heads AS (SELECT id, list_distinct(flatten(list(h))) AS header_token_set FROM marked GROUP BY 1),
p AS (SELECT id, list_distinct(list(v)) AS value_set, list_distinct(flatten(list(t))) AS token_set, list_distinct(list(v) FILTER ({NUMERIC})) AS numeric_value_set,
 list_distinct(flatten(list(list_concat(h, t)))) AS serial_token_set, list_distinct(flatten(list(flatten([[x || ':' || y for y in t] for x in h])))) AS header_value_token_set,
 string_agg('col ' || column_name || ' val ' || v, ' ; ' ORDER BY col_idx)[1:512] AS serial_text, count(*) AS nonempty_count, count(*) FILTER ({NUMERIC}) / CAST(count(*) AS DOUBLE) AS numeric_ratio,
 avg(CAST(length(v) AS DOUBLE)) AS avg_len, median(TRY_CAST(v AS DOUBLE)) FILTER ({NUMERIC}) AS numeric_median, list(column_name || '=' || v) AS fields, list(column_name) AS names FROM marked WHERE NOT missing GROUP BY 1),
prof AS (SELECT * FROM p JOIN heads USING (id))"""


def row_profiles(spark, sf_dir, fields=None):
    rows = profile.entity_rows(cells(spark, sf_dir, ROWS) if fields is None else fields)
    return rows.withColumn("id", F.concat_ws(":", "table_name", "row_idx"))


@query(f"WITH {ROW_SQL} SELECT id, len(value_set) AS n_values, len(token_set) AS n_tokens, len(serial_token_set) AS n_serial, len(header_token_set) AS n_headers, len(header_value_token_set) AS n_cross, len(numeric_value_set) AS n_numbers, serial_text, nonempty_count, numeric_ratio, avg_len, numeric_median FROM prof")
def s2_a6_a7_f20_row_profiles(spark, sf_dir):
    n = lambda c: F.size(c).cast("long")
    return row_profiles(spark, sf_dir).select("id", n("value_set").alias("n_values"), n("token_set").alias("n_tokens"), n("serial_token_set").alias("n_serial"), n("header_token_set").alias("n_headers"), n("header_value_token_set").alias("n_cross"), n("numeric_value_set").alias("n_numbers"), "serial_text", F.col("nonempty_count").cast("long").alias("nonempty_count"), "numeric_ratio", "avg_len", "numeric_median")


@query("WITH w AS (SELECT DISTINCT 'customer' AS table_name, o_custkey AS row_idx FROM orders) SELECT c_custkey AS row_idx, c_name AS raw FROM customer WHERE c_custkey IN (SELECT row_idx FROM w)")
def s3_j10_required_rows(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.lit("customer").alias("table_name"), F.col("o_custkey").alias("row_idx"))
    return lake.required_rows(cells(spark, sf_dir, ROWS), wanted).where("column_name = 'c_name'").select("row_idx", "raw")


@query(f"WITH {ROW_SQL}, n AS (SELECT count(*) AS n FROM prof WHERE len(token_set) > 0), d AS (SELECT token, count(*) AS df FROM (SELECT unnest(token_set) AS token FROM prof) GROUP BY 1) SELECT token, df, ln((n + 1) / CAST(df + 1 AS DOUBLE)) + 1 AS idf FROM d, n")
def a8_token_idf(spark, sf_dir):
    return profile.idf(row_profiles(spark, sf_dir))


@query("SELECT DISTINCT table_name, row_idx FROM (SELECT 'orders' AS table_name, o_orderkey AS row_idx FROM orders UNION ALL SELECT 'customer', o_custkey FROM orders)")
def s7_s13_split_rows(spark, sf_dir):
    split = table(spark, sf_dir, "orders").select(F.lit("orders.csv").alias("ltable_name"), F.concat(F.col("o_orderkey"), F.lit(".0")).alias("l_id"), F.lit("customer").alias("rtable_name"), F.col("o_custkey").cast("string").alias("r_id"))
    return files.split_rows(split)


@query("SELECT vec_id, len(embedding) AS dim, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding])) AS norm FROM embeddings")
def s11_embedding_scan(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dim"), F.sqrt(T._dot(F.col("embedding"), F.col("embedding"))).alias("norm"))


# ---- pair atoms ------------------------------------------------------------

JACCARD = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / CAST(len(list_distinct(list_concat({0}, {1}))) AS DOUBLE) END"
SAFE = "CASE WHEN {0} > 0 AND {1} > 0 THEN least({0}, {1}) / CAST(greatest({0}, {1}) AS DOUBLE) ELSE 0.0 END"
COLUMN_PAIRS = f"""prof AS (SELECT table_name || '.' || column_name AS id, column_name, n_distinct, unique_ratio, numeric_ratio, avg_len FROM stats),
ids AS (SELECT table_name || '.' || column_name AS id, v FROM vals),
shared AS (SELECT a, b, count(*) AS both_ FROM pairs JOIN ids x ON x.id = a JOIN ids y ON y.id = b AND y.v = x.v GROUP BY ALL),
joined AS (SELECT pairs.a, pairs.b, coalesce(both_, 0) AS i, pa.n_distinct AS na, pb.n_distinct AS nb, pa.unique_ratio AS ua, pb.unique_ratio AS ub, pa.numeric_ratio AS ra, pb.numeric_ratio AS rb, pa.avg_len AS la, pb.avg_len AS lb,
 {HEADER.format('pa.column_name')} AS ha, {HEADER.format('pb.column_name')} AS hb, pa.column_name AS ca, pb.column_name AS cb
 FROM pairs JOIN prof pa ON pa.id = pairs.a JOIN prof pb ON pb.id = pairs.b LEFT JOIN shared ON shared.a = pairs.a AND shared.b = pairs.b)"""
EDIT = "CASE WHEN {0} = {1} THEN 1.0 ELSE 1.0 - levenshtein({0}, {1}) / CAST(greatest(length({0}), length({1})) AS DOUBLE) END"


def _join_atoms(spark, sf_dir):
    c = shared.written(counted(spark, sf_dir), "counted")
    values = shared.written(profile.join_values(c), "values")
    return atoms.joinable(key_pairs(spark), with_id(profile.join_columns(c, values)), with_id(values).select("id", "v"))


@query(f"""WITH {VALUES}, {SHARES}, {PAIRS}, {COLUMN_PAIRS},
words AS (SELECT a, b, unnest(list_distinct(list_concat(ha, hb))) AS w, ha, hb FROM joined),
freq AS (SELECT a, b, len([x for x in ha if x = w]) / CAST(len(ha) AS DOUBLE) AS p, len([x for x in hb if x = w]) / CAST(len(hb) AS DOUBLE) AS q FROM words),
js AS (SELECT a, b, 1.0 - 0.5 * sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) AS s FROM freq GROUP BY ALL)
SELECT a, b, i / CAST(na + nb - i AS DOUBLE) AS jaccard, greatest(i / CAST(na AS DOUBLE), i / CAST(nb AS DOUBLE)) AS containment_max, s AS value_distribution,
 i / CAST(na AS DOUBLE) AS coverage_a, i / CAST(nb AS DOUBLE) AS coverage_b, greatest(i / CAST(na AS DOUBLE), i / CAST(nb AS DOUBLE)) AS coverage_max,
 {SAFE.format('ua', 'ub')} AS unique_ratio_sim, 1 - abs(ra - rb) AS numeric_ratio_sim, {SAFE.format('la', 'lb')} AS avg_len_ratio_sim,
 {JACCARD.format('ha', 'hb')} AS header_token_jaccard, {EDIT.format('ca', 'cb')} AS header_edit_similarity FROM joined JOIN js USING (a, b)""")
def j1_j2_u7_jts_atoms(spark, sf_dir):
    return _join_atoms(spark, sf_dir)


@query(f"""WITH {CLEAN}, {SHARES}, {PAIRS}, {COLUMN_PAIRS},
m AS (SELECT table_name || '.' || column_name AS id, avg(CAST(missing AS DOUBLE)) AS r FROM marked GROUP BY 1)
SELECT a, b, {JACCARD.format('ha', 'hb')} AS header_token_jaccard, {EDIT.format('ca', 'cb')} AS header_edit_similarity, {SAFE.format('ua', 'ub')} AS unique_ratio_sim,
 1 - abs(ma.r - mb.r) AS missing_ratio_sim, 1 - abs(ra - rb) AS numeric_ratio_sim, {SAFE.format('la', 'lb')} AS avg_len_ratio_sim,
 i / CAST(na + nb - i AS DOUBLE) AS value_jaccard, greatest(i / CAST(na AS DOUBLE), i / CAST(nb AS DOUBLE)) AS value_containment_max
FROM joined JOIN m ma ON ma.id = a JOIN m mb ON mb.id = b""")
def sm_atoms(spark, sf_dir):
    c = shared.written(counted(spark, sf_dir), "counted")
    counts = shared.written(profile.schema_counts(c), "counts")
    return atoms.schema(key_pairs(spark), with_id(profile.schema_columns(c, counts)), with_id(profile.schema_values(c, counts)).select("id", "v"))


def _union_inputs(spark, sf_dir):
    c = shared.written(counted(spark, sf_dir), "counted")
    names = [t.name for t in LAKE]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a < b], "a string, b string")
    values = shared.written(profile.union_values(c), "firsts").withColumnRenamed("table_name", "id")
    columns = c.select(F.col("table_name").alias("id"), "col_idx").distinct()
    return pairs, profile.union_tables(c).withColumnRenamed("table_name", "id"), values, columns


@query(f"""WITH {CLEAN}, firsts AS (SELECT table_name, col_idx, v, min(row_idx) AS first FROM marked WHERE NOT missing GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY table_name, col_idx ORDER BY first, v) AS r FROM firsts),
u AS (SELECT table_name AS id, col_idx, v FROM ranked WHERE r <= 1024), n AS (SELECT id, col_idx, count(*) AS n FROM u GROUP BY ALL),
t AS (SELECT table_name AS id, count(DISTINCT column_name) AS n_cols, count(*) FILTER (col_idx = 0) AS n_rows, list_distinct(flatten(list({HEADER.format('column_name')}))) AS h FROM cells GROUP BY 1),
tp AS (SELECT x.id AS a, y.id AS b FROM t x, t y WHERE x.id < y.id),
s AS (SELECT tp.a, tp.b, x.col_idx AS i, y.col_idx AS j, count(*) AS c FROM tp JOIN u x ON x.id = tp.a JOIN u y ON y.id = tp.b AND y.v = x.v GROUP BY ALL),
sc AS (SELECT s.*, greatest(c / CAST(na.n + nb.n - c AS DOUBLE), c / CAST(na.n AS DOUBLE), c / CAST(nb.n AS DOUBLE)) AS o FROM s JOIN n na ON na.id = a AND na.col_idx = i JOIN n nb ON nb.id = b AND nb.col_idx = j),
cols AS (SELECT DISTINCT table_name AS id, col_idx FROM cells),
ab AS (SELECT tp.a, tp.b, avg(best) AS m, avg(CAST(best >= 0.1 AS DOUBLE)) AS c FROM tp JOIN LATERAL (SELECT cols.col_idx, coalesce((SELECT max(o) FROM sc WHERE sc.a = tp.a AND sc.b = tp.b AND sc.i = cols.col_idx), 0.0) AS best FROM cols WHERE cols.id = tp.a) ON true GROUP BY ALL),
ba AS (SELECT tp.a, tp.b, avg(best) AS m, avg(CAST(best >= 0.1 AS DOUBLE)) AS c FROM tp JOIN LATERAL (SELECT cols.col_idx, coalesce((SELECT max(o) FROM sc WHERE sc.a = tp.a AND sc.b = tp.b AND sc.j = cols.col_idx), 0.0) AS best FROM cols WHERE cols.id = tp.b) ON true GROUP BY ALL)
SELECT tp.a, tp.b, ab.m AS col_overlap_a2b_mean, ba.m AS col_overlap_b2a_mean, ab.c AS col_overlap_a2b_cov, ba.c AS col_overlap_b2a_cov, {JACCARD.format('x.h', 'y.h')} AS header_jaccard,
 {SAFE.format('x.n_cols', 'y.n_cols')} AS col_count_ratio, {SAFE.format('x.n_rows', 'y.n_rows')} AS row_count_ratio
FROM tp JOIN t x ON x.id = tp.a JOIN t y ON y.id = tp.b JOIN ab ON ab.a = tp.a AND ab.b = tp.b JOIN ba ON ba.a = tp.a AND ba.b = tp.b""")
def j3_uts_atoms(spark, sf_dir):
    return atoms.union(*_union_inputs(spark, sf_dir))


def entity_pairs(spark, sf_dir):
    """Each customer with the next one, and with the supplier of the same number."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    nxt = c.select((F.col("k") - 1).alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    row = lambda t, k: F.concat(F.lit(f"{t}:"), k)
    one = c.join(nxt, "k", "left_semi").select(row("customer", F.col("k")).alias("src"), row("customer", F.col("k") + 1).alias("dst"))
    return atoms.canonical(one.unionByName(c.join(s, "k").select(row("customer", F.col("k")).alias("src"), row("supplier", F.col("k")).alias("dst"))))


ENTITY_PAIRS = """pp AS (SELECT 'customer:' || x.c_custkey AS s, 'customer:' || (x.c_custkey + 1) AS d FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1
 UNION ALL SELECT 'customer:' || c_custkey, 'supplier:' || s_suppkey FROM customer JOIN supplier ON s_suppkey = c_custkey),
pairs AS (SELECT DISTINCT least(s, d) AS a, greatest(s, d) AS b FROM pp)"""
RAW_GRAMS = "list_distinct([({0})[i : i + {1} - 1] for i in range(1, greatest(length({0}) - {1}, 0) + 2)])"
GRAMS = "list_distinct([lower({0})[i : i + {1} - 1] for i in range(1, length({0}) - {1} + 2)])"


@query(f"""WITH {ROW_SQL}, {ENTITY_PAIRS},
n AS (SELECT count(*) AS n FROM prof WHERE len(token_set) > 0), df AS (SELECT token, count(*) AS c FROM (SELECT unnest(token_set) AS token FROM prof) GROUP BY 1),
idf AS (SELECT token, ln((n + 1) / CAST(c + 1 AS DOUBLE)) + 1 AS w FROM df, n),
j AS (SELECT pairs.a, pairs.b, x, y FROM pairs JOIN prof x ON x.id = a JOIN prof y ON y.id = b),
wi AS (SELECT a, b, sum(w) AS s FROM (SELECT a, b, unnest(list_intersect(x.token_set, y.token_set)) AS token FROM j) JOIN idf USING (token) GROUP BY ALL),
wu AS (SELECT a, b, sum(w) AS s FROM (SELECT a, b, unnest(list_distinct(list_concat(x.token_set, y.token_set))) AS token FROM j) JOIN idf USING (token) GROUP BY ALL)
SELECT a, b, len(list_intersect(x.value_set, y.value_set)) / CAST(len(list_distinct(list_concat(x.value_set, y.value_set))) AS DOUBLE) AS row_value_jaccard,
 len(list_intersect(x.value_set, y.value_set)) / CAST(least(len(x.value_set), len(y.value_set)) AS DOUBLE) AS row_value_containment_max,
 {JACCARD.format('x.token_set', 'y.token_set')} AS row_token_jaccard, {SAFE.format('x.nonempty_count', 'y.nonempty_count')} AS row_nonempty_ratio,
 1 - abs(x.numeric_ratio - y.numeric_ratio) AS row_numeric_ratio_sim, {SAFE.format('x.avg_len', 'y.avg_len')} AS row_avg_len_ratio,
 {JACCARD.format('x.serial_token_set', 'y.serial_token_set')} AS row_serial_token_jaccard,
 CASE WHEN greatest(length(x.serial_text), length(y.serial_text)) > 128 THEN {JACCARD.format(RAW_GRAMS.format('x.serial_text', 3), RAW_GRAMS.format('y.serial_text', 3))} ELSE {EDIT.format('x.serial_text', 'y.serial_text')} END AS row_serial_edit_similarity,
 len(list_intersect(x.numeric_value_set, y.numeric_value_set)) / CAST(least(len(x.numeric_value_set), len(y.numeric_value_set)) AS DOUBLE) AS row_numeric_value_overlap,
 {JACCARD.format(GRAMS.format('x.serial_text', 3), GRAMS.format('y.serial_text', 3))} AS row_serial_char3_jaccard, {JACCARD.format(GRAMS.format('x.serial_text', 4), GRAMS.format('y.serial_text', 4))} AS row_serial_char4_jaccard,
 coalesce(wi.s, 0) / wu.s AS row_token_idf_jaccard, 1 / (1 + abs(x.numeric_median - y.numeric_median) / greatest(abs(x.numeric_median), abs(y.numeric_median), 1.0)) AS row_numeric_rel_diff_sim,
 {JACCARD.format('x.header_token_set', 'y.header_token_set')} AS row_header_jaccard,
 CASE WHEN len(list_intersect(x.names, y.names)) = 0 THEN 0.0 ELSE len(list_intersect(x.fields, y.fields)) / CAST(len(list_intersect(x.names, y.names)) AS DOUBLE) END AS row_header_value_exact_ratio,
 {JACCARD.format('x.header_value_token_set', 'y.header_value_token_set')} AS row_header_token_jaccard
FROM j LEFT JOIN wi USING (a, b) LEFT JOIN wu USING (a, b)""")
def j4_f6_f13_em_atoms(spark, sf_dir):
    # All rows weigh tokens; the other sets are made for rows in pairs only.
    pairs = shared.written(entity_pairs(spark, sf_dir), "pairs")
    fields = shared.written(profile.row_fields(cells(spark, sf_dir, ROWS)), "fields")
    weights = profile.idf(shared.written(row_profiles(spark, sf_dir, fields).select("token_set"), "tokens"))
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    asked = fields.join(named, F.concat_ws(":", "table_name", "row_idx") == F.col("id"), "left_semi")
    rows = row_profiles(spark, sf_dir, asked.repartition(shared.parts(pairs, rows=atoms.PROFILE_ROWS), "table_name", "row_idx"))
    return atoms.entity(pairs, rows, weights, tokens=list(atoms.ATOMS["entity_matching"][2:]))


@query("""
WITH z AS (SELECT x.vec_id AS a, y.vec_id AS b, list_zip(x.embedding, y.embedding) AS e FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1),
s AS (SELECT a, b, list_sum([CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE) for p in e]) AS d, list_sum([CAST(p[1] AS DOUBLE) * CAST(p[1] AS DOUBLE) for p in e]) AS na, list_sum([CAST(p[2] AS DOUBLE) * CAST(p[2] AS DOUBLE) for p in e]) AS nb,
 list_sum([abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) for p in e]) / len(e) AS l FROM z)
SELECT a, b, round(d / (sqrt(na) * sqrt(nb)), 9) AS row_emb_cosine, round(1 / (1 + l), 9) AS row_emb_l1_sim FROM s""")
def j5_f14_f15_embedding_atoms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    strings = F.array().cast("array<string>")
    empty = {c: strings for c in ("value_set", "token_set", "numeric_value_set", "header_token_set", "serial_token_set", "header_value_token_set")}
    rows = e.select(F.col("vec_id").alias("id"), *[v.alias(c) for c, v in empty.items()], F.lit("").alias("serial_text"), F.lit(0).alias("nonempty_count"), *[F.lit(0.0).alias(c) for c in ("numeric_ratio", "avg_len", "numeric_median")], F.create_map().cast("map<string,string>").alias("header_to_value"))
    pairs = e.select(F.col("vec_id").alias("a")).join(e.select((F.col("vec_id") - 1).alias("a")), "a", "left_semi").withColumn("b", F.col("a") + 1)
    found = atoms.entity(pairs, rows, embeddings=e.select(F.col("vec_id").alias("id"), "embedding"), tokens=["row_emb_cosine", "row_emb_l1_sim"])
    return found.select("a", "b", *[F.round(c, 9).alias(c) for c in ("row_emb_cosine", "row_emb_l1_sim")])


# ---- scored rows for evaluation: customers' balances against a segment -----

SCORED = "scored AS (SELECT c_custkey AS id, (c_acctbal + 1000) / 11000 AS score, CAST(c_mktsegment = 'BUILDING' OR c_acctbal > 6000 AS INT) AS label, c_mktsegment AS seg FROM customer)"


def scored(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), ((F.col("c_acctbal") + 1000) / 11000).alias("score"), ((F.col("c_mktsegment") == "BUILDING") | (F.col("c_acctbal") > 6000)).cast("int").alias("label"), F.col("c_mktsegment").alias("seg"))


RATES = "tp, fp, fn, tn, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END AS f1"
COUNTS = "count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp, count(*) FILTER (score < t AND label = 1) AS fn, count(*) FILTER (score < t AND label = 0) AS tn"


@query(f"WITH {SCORED}, c AS (SELECT seg, {COUNTS.replace('t AND', '0.5 AND')} FROM scored GROUP BY 1) SELECT seg, {RATES} FROM c")
def a11_p9_confusion(spark, sf_dir):
    return evaluate.confusion(scored(spark, sf_dir), 0.5, by=("seg",))


@query(f"""WITH {SCORED}, r AS (SELECT seg, label, rank() OVER (PARTITION BY seg ORDER BY score) + (count(*) OVER (PARTITION BY seg, score) - 1) / 2.0 AS r FROM scored),
s AS (SELECT seg, sum(r) FILTER (label = 1) AS rp, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM r GROUP BY 1)
SELECT seg, round(CASE WHEN p > 0 AND n > 0 THEN (rp - p * (p + 1) / 2.0) / (p * n) ELSE 'nan'::DOUBLE END, 10) AS auc FROM s""")
def a12_auc(spark, sf_dir):
    return evaluate.auc(scored(spark, sf_dir), ("seg",)).select("seg", F.round("auc", 10).alias("auc"))


@query(f"WITH {SCORED}, r AS (SELECT seg, score, rank() OVER (PARTITION BY seg ORDER BY score) + (count(*) OVER (PARTITION BY seg, score) - 1) / 2.0 AS avg_rank FROM scored) SELECT seg, score, count(*) AS n, avg(avg_rank) AS avg_rank FROM r GROUP BY ALL")
def w1_average_rank(spark, sf_dir):
    return evaluate.average_rank(scored(spark, sf_dir), by=("seg",)).select("seg", "score", "n", F.col("avg_rank").cast("double").alias("avg_rank"))


@query(f"""WITH {SCORED}, t AS (SELECT g / 1000.0 AS t FROM range(1, 1000) r(g)), c AS (SELECT t, {COUNTS} FROM t, scored GROUP BY 1), m AS (SELECT t AS threshold, {RATES} FROM c),
b AS (SELECT *, max(f1) OVER () AS best_f1 FROM m)
SELECT CAST(threshold AS DOUBLE) AS threshold, best_f1 FROM b WHERE f1 >= best_f1 - 0.01 ORDER BY round(abs(threshold - 0.5), 9), f1 DESC, recall DESC, threshold LIMIT 1""")
def t6_k12_best_grid_threshold(spark, sf_dir):
    return evaluate.best_grid_threshold(scored(spark, sf_dir))


@query(f"WITH {SCORED}, t AS (SELECT DISTINCT score AS t FROM scored), c AS (SELECT t, {COUNTS} FROM t, scored GROUP BY 1), m AS (SELECT t AS threshold, {RATES} FROM c) SELECT threshold, f1 FROM m ORDER BY round(f1, 12) DESC, threshold LIMIT 1")
def t7_best_score_threshold(spark, sf_dir):
    return evaluate.best_score_threshold(scored(spark, sf_dir))


@query(f"""WITH {SCORED}, r AS (SELECT seg, score, row_number() OVER (PARTITION BY seg ORDER BY score DESC) - 1 AS i, count(*) OVER (PARTITION BY seg) AS n, min(score) OVER (PARTITION BY seg) AS lo, max(score) OVER (PARTITION BY seg) AS hi FROM scored),
g AS (SELECT seg, score, row_number() OVER (PARTITION BY seg ORDER BY round((score - lo) / (hi - lo) - (1 - i / CAST(n - 1 AS DOUBLE)), 12) DESC, score DESC) AS k FROM r) SELECT seg, score AS elbow FROM g WHERE k = 1""")
def w2_t4_elbow(spark, sf_dir):
    return evaluate.elbow(scored(spark, sf_dir), ("seg",))


@query(f"WITH {SCORED} SELECT id, score FROM scored WHERE label = 0 ORDER BY score DESC, id LIMIT (SELECT CAST(round_even(count(*) * 0.25, 0) AS BIGINT) FROM scored WHERE label = 1)")
def t1_p12_hard_negatives(spark, sf_dir):
    return evaluate.hard_negatives(scored(spark, sf_dir), 0.25).select("id", "score")


@query(f"WITH {SCORED} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT (SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) FROM scored)")
def t2_mine_top_ratio(spark, sf_dir):
    return evaluate.mine_top(scored(spark, sf_dir), 0.1).select("id", "score")


@query(f"WITH {SCORED}, r AS (SELECT *, id % 37 AS batch, row_number() OVER (PARTITION BY id % 37 ORDER BY score DESC, id) AS r FROM scored) SELECT id, batch FROM r WHERE score >= 0.97 OR r <= 2")
def t3_mine_by_threshold(spark, sf_dir):
    """Rows above a threshold; batches that have fewer give their best two."""
    rows = scored(spark, sf_dir).withColumn("batch", F.col("id") % 37)
    return evaluate.mine_above(rows, 0.97, ("batch",), 2).select("id", "batch")


@query(f"WITH {SCORED} SELECT seg, count(score) AS n, avg(score) AS mean, sqrt(greatest(avg(score * score) - avg(score) * avg(score), 1e-12)) AS std, quantile_cont(score, 0.25) AS p25, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.75) AS p75, quantile_cont(score, 0.95) AS p95 FROM scored GROUP BY 1")
def a13_a14_g19_summary(spark, sf_dir):
    return evaluate.summary(scored(spark, sf_dir), "score", ("seg",))


@query(f"WITH {SCORED}, m AS (SELECT avg(score) AS m, sqrt(greatest(avg(score * score) - avg(score) * avg(score), 1e-12)) AS s FROM scored WHERE seg <> 'MACHINERY') SELECT id, round((score - m) / s, 8) AS score FROM scored, m")
def g9_standardise(spark, sf_dir):
    return evaluate.standardise(scored(spark, sf_dir), ["score"], F.col("seg") != "MACHINERY").select("id", F.round("score", 8).alias("score"))


@query(f"WITH {SCORED}, x AS (SELECT seg, label, score AS b, least(1.0, score + 0.05) AS a FROM scored) SELECT seg, count(*) FILTER (CAST(b >= 0.5 AS INT) <> label AND CAST(a >= 0.5 AS INT) = label) AS fixes, count(*) FILTER (CAST(b >= 0.5 AS INT) = label AND CAST(a >= 0.5 AS INT) <> label) AS breaks, count(*) FILTER (CAST(b >= 0.5 AS INT) <> label AND CAST(a >= 0.5 AS INT) = label) - count(*) FILTER (CAST(b >= 0.5 AS INT) = label AND CAST(a >= 0.5 AS INT) <> label) AS fix_gap, avg(CAST((b >= 0.5) <> (a >= 0.5) AS DOUBLE)) AS changed_ratio FROM x GROUP BY 1")
def a25_a26_corrections(spark, sf_dir):
    rows = scored(spark, sf_dir).select("seg", "label", F.col("score").alias("before"), F.least(F.lit(1.0), F.col("score") + 0.05).alias("after"))
    return evaluate.corrections(rows, 0.5, ("seg",))


@query(f"WITH {SCORED} SELECT least(10.0, greatest(1.0, count(*) FILTER (label = 0) / CAST(count(*) FILTER (label = 1) AS DOUBLE))) AS pos_weight FROM scored")
def a23_positive_weight(spark, sf_dir):
    return spark.createDataFrame([(learn.positive_weight(scored(spark, sf_dir)),)], "pos_weight double")


@query(f"WITH {SCORED}, p AS (SELECT label, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM scored), r AS (SELECT CASE WHEN label = 1 THEN p ELSE 1 - p END AS r FROM p) SELECT avg(-ln(r)) AS bce, avg(-power(1 - r, 2) * ln(r)) AS focal FROM r")
def g7_losses(spark, sf_dir):
    return scored(spark, sf_dir).agg(*[F.avg(c).alias(n) for n, c in learn.losses(F.col("score"), F.col("label")).items()])


# ---- expressions, specs, rules ---------------------------------------------

FEATURES = ["f1", "f2", "f3"]
FEATURE_SQL = "f AS (SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS f1, p_retailprice / 2000 - 0.6 AS f2, (p_partkey % 7) - 3.0::DOUBLE AS f3 FROM part)"


def features(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("f1"), (F.col("p_retailprice") / 2000 - 0.6).alias("f2"), (F.col("p_partkey") % 7 - 3.0).alias("f3"))


DIV = "({0}) / CASE WHEN abs({1}) < 1e-6 THEN CASE WHEN {1} < 0 THEN -1e-6 ELSE 1e-6 END ELSE {1} END"


@query(f"""WITH {FEATURE_SQL} SELECT id, round(1 / (1 + exp(-greatest(-40, least(40, f1 - f3)))), 9) AS e1, round({DIV.format('f1', 'f3')}, 9) AS e2, CASE WHEN f3 > 0 THEN f1 ELSE f2 END AS e3,
 round(f3 - floor(f3 / 2.0) * 2.0, 9) AS e4, round(ln(greatest(f2, 1e-12)), 9) AS e5, (f1 + f2 + f3) / 3 AS e6, CAST(f1 > 0.5 AND f2 > 0 AS DOUBLE) AS e7, greatest(0, least(1, f2 * f3)) AS e8, round(power(greatest(-1e6, least(1e6, f1)), 2.0), 9) AS e9 FROM f""")
def y1_y2_expressions(spark, sf_dir):
    texts = ["sigmoid(f1 - f3)", "f1 / f3", "where(f3 > 0, f1, f2)", "f3 % 2", "log(f2)", "avg(f1, f2, f3)", "f1 > 0.5 and f2", "clip(f2 * f3, 0, 1)", "f1 ** 2"]
    column = lambda i, t: F.round(expression.parse(t, FEATURES).column(), 9) if i in (1, 2, 4, 5, 9) else expression.parse(t, FEATURES).column()
    return features(spark, sf_dir).select("id", *[column(i, t).alias(f"e{i}") for i, t in enumerate(texts, 1)])


SPEC = {"spec_version": "v2", "task": "entity_matching", "output_name": "s", "decision": {"threshold": 0.5, "positive_if": ">="},
        "channels": [{"name": "c1", "role": "level", "expression": "relu(f1)"}, {"name": "c2", "role": "sign", "expression": "where(f3 > 0, f2, 0 - f2)"}, {"name": "c3", "role": "mix", "expression": "max(f1, f2, f3) - min(f1, f3)", "output_range_hint": [0, 2]}],
        "aggregation": {"weights": [0.5, 0.3, 0.2], "bias": 0.1, "postprocess": "logistic"}}


@query(f"""WITH {FEATURE_SQL}, c AS (SELECT id, greatest(f1, 0) AS c1, CASE WHEN f3 > 0 THEN f2 ELSE -f2 END AS c2, least(2, greatest(0, greatest(f1, f2, f3) - least(f1, f3))) AS c3 FROM f),
s AS (SELECT *, 1 / (1 + exp(-(0.1::DOUBLE + 0.5::DOUBLE * c1 + 0.3::DOUBLE * c2 + 0.2::DOUBLE * c3))) AS s FROM c) SELECT id, CAST(c1 AS DOUBLE) AS c1, CAST(c2 AS DOUBLE) AS c2, round(CAST(c3 AS DOUBLE), 9) AS c3, round(s, 9) AS score, CAST(s >= 0.5 AS INT) AS decision FROM s""")
def y4_y5_y6_spec_channels(spark, sf_dir):
    spec = specs.validate(SPEC, FEATURES)
    score = specs.score_column(spec, FEATURES)
    c1, c2, c3 = specs.channel_columns(spec, FEATURES)
    return features(spark, sf_dir).select("id", c1, c2, F.round(c3, 9).alias("c3"), F.round(score, 9).alias("score"), specs.decision_column(spec, score).alias("decision"))


EVIDENCE_SQL = "ev AS (SELECT c_custkey AS id, (c_acctbal + 1000) / 11000 AS s_prior, c_nationkey AS src_degree, CAST(c_custkey % 9 AS BIGINT) AS dst_degree FROM customer), e AS (SELECT *, 1 - 2 * abs(s_prior - 0.5) AS uncertainty, CASE WHEN greatest(src_degree, dst_degree) > 0 THEN least(src_degree, dst_degree) / CAST(greatest(src_degree, dst_degree) AS DOUBLE) ELSE 0.0 END AS degree_ratio FROM ev)"


def evidence(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return atoms.evidence(c.select(F.col("c_custkey").alias("id"), ((F.col("c_acctbal") + 1000) / 11000).alias("s_prior"), F.col("c_nationkey").alias("src_degree"), (F.col("c_custkey") % 9).alias("dst_degree")))


@query(f"WITH {EVIDENCE_SQL} SELECT id, uncertainty, degree_ratio FROM e")
def y8_r11_evidence(spark, sf_dir):
    return evidence(spark, sf_dir).select("id", "uncertainty", "degree_ratio")


POLICY = {"task": "entity_matching", "version": 1, "selected_features": ["s_prior"], "rules": [
    {"id": "busy", "if": [["src_degree", ">", 12], ["dst_degree", ">=", 5]], "delta": 0.06},
    {"id": "faint", "if": [["s_prior", "<", 0.35], ["uncertainty", "between", [0.25, 0.65]], ["dst_degree", "<=", 6]], "delta": -0.04},
    {"id": "top", "if": [["degree_ratio", "in_top_band", 0.2]], "then": {"delta": 0.05}}]}
EVIDENCE = ["s_prior", "uncertainty", "src_degree", "dst_degree", "degree_ratio"]


def fixed_encoder(width: int = 8) -> encoder.Encoder:
    w = {n: fixed_weights(width, 2 if n == "edge" else width, k) for k, n in enumerate(("q", "k", "v", "edge", "out", "own", "others"))}
    norm = ([1 + i / 10 for i in range(width)], [i / 20 for i in range(width)])
    layers = (encoder.Layer(lambda e, x: encoder.attend(e, x, w, 2), norm), encoder.Layer(lambda e, x: encoder.neighbour_mean(e, x, w["own"], w["others"]), norm))
    return encoder.Encoder(fixed_weights(width, 64, 9), layers, [((i * 3) % 7 - 3) / 20 for i in range(2 * width)], 0.1)


@query()
def g5_w5_encoder_over_hops(spark, sf_dir):
    """Projection, two gated layers with weighted norms, over sampled hops into every fifth vector."""
    edges = ring(spark, sf_dir).where("src >= 0").distinct().withColumn("edge", F.array(F.col("src") % 3 / 3.0, F.lit(0.5)))
    x = vectors(spark, sf_dir)
    found = fixed_encoder().sampled(edges, x, x.where("node % 5 = 0").select("node"), (10, 5))
    return found.select("node", F.posexplode("embedding").alias("pos", "x")).select("node", "pos", F.round("x", 7).alias("x"))


@query()
def g6_g8_hidden_decoder(spark, sf_dir):
    """Do two neighbouring vectors have the same label? A decoder with hidden layers and interactions, in seeded mini-batches, kept at its best epoch."""
    e = table(spark, sf_dir, "embeddings")
    one, two = e.select(F.col("vec_id").alias("id"), F.col("label").alias("p"), F.col("embedding").alias("u")), e.select((F.col("vec_id") - 1).alias("id"), F.col("label").alias("q"), F.col("embedding").alias("v"))
    dbl = lambda c: F.transform(c, lambda x: x.cast("double"))
    rows = one.join(two, "id").select("id", (F.col("p") == F.col("q")).cast("int").alias("label"), decoder.pair_input(dbl("u"), dbl("v"), F.array(F.col("id") % 2), True).alias("x"))
    model, threshold, _ = decoder.train(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"), hidden=16, epochs=4, patience=2, batches=4, rate=0.01)
    return decoder.score(rows, model, replay=True).select("id", "label", "score", F.lit(threshold).alias("threshold"), F.size("edge_hidden").alias("hidden"), F.size("projection").alias("projected"))


@query(f"""WITH {EVIDENCE_SQL}, q AS (SELECT quantile_cont(degree_ratio, 0.8) AS q FROM e)
SELECT id, round(CASE WHEN src_degree > 12 AND dst_degree >= 5 THEN 0.06 ELSE 0 END + CASE WHEN s_prior < 0.35 AND uncertainty BETWEEN 0.25 AND 0.65 AND dst_degree <= 6 THEN -0.04 ELSE 0 END + CASE WHEN degree_ratio >= q THEN 0.05 ELSE 0 END, 9)::DOUBLE AS delta FROM e, q""")
def p8_r4_r7_r10_policy(spark, sf_dir):
    found = policy.apply(evidence(spark, sf_dir), policy.validate(POLICY, "entity_matching", EVIDENCE))
    return found.select("id", F.round("delta", 9).alias("delta"))


@query(f"""WITH {EVIDENCE_SQL} SELECT id, round(CASE WHEN (s_prior < 0.35)::INT + (uncertainty BETWEEN 0.25 AND 0.65)::INT + (dst_degree <= 6)::INT >= 2 AND abs(s_prior - 0.5) <= 0.2 THEN 0.499 WHEN (src_degree > 12)::INT + (dst_degree >= 5)::INT >= 1 THEN 0.501 ELSE s_prior END - s_prior, 9)::DOUBLE AS delta FROM e""")
def r5_r6_r8_policy_override(spark, sf_dir):
    doc = POLICY | {"rules": POLICY["rules"][:2]}
    options = policy.Options(match="partial", ratio=0.5, negative_margin=0.2, combine="hard_override")
    found = policy.apply(evidence(spark, sf_dir), policy.validate(doc, "entity_matching", EVIDENCE), options)
    return found.select("id", F.round("delta", 9).alias("delta"))


MOVED = "mv AS (SELECT id, score AS s, label, CASE WHEN id % 3 = 0 THEN 0.2 WHEN id % 3 = 1 THEN -0.15 ELSE 0.0 END AS delta FROM scored)"


def moved(spark, sf_dir):
    k = F.col("id") % 3
    return scored(spark, sf_dir).select("id", F.col("score").alias("s"), "label", F.when(k == 0, 0.2).when(k == 1, -0.15).otherwise(0.0).alias("delta"))


@query(f"WITH {SCORED}, {MOVED} SELECT id, round(least(1.0, greatest(0.0, s + 0.5 * CASE WHEN abs(s - 0.5) <= 0.25 AND abs(delta) >= 0.05 THEN greatest(-0.1, least(0.1, delta)) ELSE 0 END)), 9)::DOUBLE AS score FROM mv")
def k1_k2_k3_rerank(spark, sf_dir):
    c = rerank.Setting(cap=0.1, alpha=0.5, margin=0.25, delta_min=0.05)
    return moved(spark, sf_dir).select("id", F.round(rerank.reranked(F.col("s"), F.col("delta"), 0.5, c), 9).alias("score"))


@query(f"""WITH {SCORED}, {MOVED}, g AS (SELECT cap, alpha, margin FROM (VALUES (0.1::DOUBLE), (0.2)) c(cap), (VALUES (0.5::DOUBLE), (1.0)) a(alpha), (VALUES (0.1::DOUBLE), (0.3)) m(margin)),
x AS (SELECT g.*, label = 1 AS y, s >= 0.5 AS was, least(1.0, greatest(0.0, s + alpha * CASE WHEN abs(s - 0.5) <= margin THEN greatest(-cap, least(cap, delta)) ELSE 0 END)) >= 0.5 AS now FROM mv, g)
SELECT cap, alpha, margin, 2 * count(*) FILTER (now AND y) / CAST(2 * count(*) FILTER (now AND y) + count(*) FILTER (now AND NOT y) + count(*) FILTER (NOT now AND y) AS DOUBLE) AS f1,
 count(*) FILTER (was <> y AND now = y) - count(*) FILTER (was = y AND now <> y) AS fix_gap FROM x GROUP BY ALL""")
def k4_t5_rerank_search(spark, sf_dir):
    return rerank.search(moved(spark, sf_dir), rerank.settings((0.1, 0.2), (0.5, 1.0), (0.1, 0.3)), 0.5).select("cap", "alpha", "margin", "f1", "fix_gap")


@query(f"""WITH {SCORED}, {MOVED}, b AS (SELECT *, (s >= 0.5) <> (label = 1) AS wrong, CASE WHEN label = 1 THEN delta > 1e-9 ELSE delta < -1e-9 END AS towards FROM mv)
SELECT id, CAST(wrong AND towards AS INT) AS target, round(CASE WHEN abs(delta) <= 1e-9 THEN 0.1 WHEN wrong AND towards THEN 1.5 WHEN wrong THEN 1.25 WHEN NOT towards THEN 0.75 ELSE 0.25 END * (1 + greatest(0.0, 1 - abs(s - 0.5) / 0.15)), 9)::DOUBLE AS weight FROM b""")
def k5_k6_benefit(spark, sf_dir):
    target, weight = rerank.benefit_targets(0.5)
    return moved(spark, sf_dir).select("id", target.alias("target"), F.round(weight, 9).alias("weight"))


# ---- graph: customers, orders and parts as nodes -----------------------------


def fk_graph(spark, sf_dir):
    """Orders to customers (type 1) and order lines to parts (type 2); nodes are numbered apart."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 10 + 1).alias("src"), (F.col("o_custkey") * 10).alias("dst"), F.lit(1).alias("type_id"))
    return o.unionByName(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + 1).alias("src"), (F.col("l_partkey") * 10 + 2).alias("dst"), F.lit(2).alias("type_id")))


GRAPH = "g AS (SELECT o_orderkey * 10 + 1 AS src, o_custkey * 10 AS dst, 1 AS type_id FROM orders UNION ALL SELECT l_orderkey * 10 + 1, l_partkey * 10 + 2, 2 FROM lineitem)"


@query(f"WITH {GRAPH} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY 1")
def a9_j6_degrees(spark, sf_dir):
    return graph.degrees(fk_graph(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT DISTINCT src, dst, type_id FROM (SELECT * FROM g UNION ALL SELECT dst, src, type_id FROM g)")
def u1_append_undirected(spark, sf_dir):
    g = fk_graph(spark, sf_dir)
    return graph.append(g.where("false"), g)


def lake_edges(spark, sf_dir):
    """Edges of two and four nodes with labels and splits, from order lines."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    kinds = F.array(*[F.lit(t) for t in graph.EDGE_TYPES])
    nodes = F.when(F.col("l_linenumber") % 2 == 0, F.array("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long"))).otherwise(F.array("l_orderkey", "l_partkey"))
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), (F.col("l_suppkey") % 3 > 0).cast("int").alias("label"), nodes.alias("nodes"), F.element_at(kinds, (F.col("l_partkey") % 9 + 1).cast("int")).alias("edge_type"), (F.col("l_orderkey") % 5 < 3).alias("train"), (F.col("l_orderkey") % 5 == 3).alias("validate"), (F.col("l_orderkey") % 5 == 4).alias("test"))


EDGES = "e AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, CAST(l_suppkey % 3 > 0 AS INT) AS label, CASE WHEN l_linenumber % 2 = 0 THEN [l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT] ELSE [l_orderkey, l_partkey] END AS nodes, [" + ", ".join(f"'{t}'" for t in graph.EDGE_TYPES) + "][l_partkey % 9 + 1] AS edge_type, l_orderkey % 5 < 3 AS train, l_orderkey % 5 = 3 AS validate, l_orderkey % 5 = 4 AS test FROM lineitem)"


@query(f"""WITH {EDGES}, x AS (SELECT edge_id, nodes, edge_type, unnest([[1,2,0],[1,3,1],[1,4,2],[2,3,3],[2,4,4],[3,4,5]]) AS p FROM e)
SELECT edge_id, p[3] AS k, nodes[p[1]] AS u, nodes[p[2]] AS v FROM x WHERE len(nodes) >= p[2] AND (p[3] = 0 OR edge_type <> 'joinable_table_search')""")
def u2_g11_edge_expansion(spark, sf_dir):
    return graph.pairs(lake_edges(spark, sf_dir)).select("edge_id", "k", "u", "v")


@query(f"""WITH {EDGES}, x AS (SELECT nodes, edge_type, unnest([[1,2],[1,3],[1,4],[2,3],[2,4],[3,4]]) AS p FROM e WHERE label = 1 AND NOT validate AND NOT test AND edge_type IN ('cell_row', 'cell_column', 'row_table', 'column_table'))
SELECT nodes[p[1]] AS src, nodes[p[2]] AS dst, CASE edge_type WHEN 'cell_row' THEN 1 WHEN 'cell_column' THEN 2 WHEN 'row_table' THEN 3 ELSE 4 END AS type_id FROM x WHERE len(nodes) >= p[2]""")
def p5_p6_g1_message_graph(spark, sf_dir):
    return graph.message_graph(lake_edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT edge_type, CASE WHEN test THEN 'test' WHEN validate THEN 'validate' WHEN train THEN 'train' ELSE 'none' END AS split, count(*) AS n FROM e GROUP BY ALL")
def p7_a21_edge_statistics(spark, sf_dir):
    return graph.edge_statistics(lake_edges(spark, sf_dir))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), "embedding")


def ring(spark, sf_dir):
    """Each vector with the one before it and the one of its number's half."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dst"))
    return v.select(F.explode(F.array(F.col("dst") - 1, F.floor(F.col("dst") / 2))).alias("src"), "dst")


RING = "r AS (SELECT vec_id - 1 AS src, vec_id AS dst FROM embeddings UNION ALL SELECT vec_id // 2, vec_id FROM embeddings)"


@query(f"""WITH {RING}, x AS (SELECT dst AS node, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM r JOIN embeddings ON vec_id = src), m AS (SELECT node, pos, avg(x) AS x FROM x GROUP BY ALL),
o AS (SELECT vec_id AS node, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS own FROM embeddings) SELECT o.node, CAST(o.pos - 1 AS INT) AS pos, round(coalesce(0.25 * own + 0.75 * x, own), 7)::DOUBLE AS x FROM o LEFT JOIN m USING (node, pos)""")
def a10_j7_g10_pool(spark, sf_dir):
    pooled = graph.overlay(vectors(spark, sf_dir), graph.pool(ring(spark, sf_dir), vectors(spark, sf_dir), 0.25))
    return pooled.select("node", F.posexplode("embedding").alias("pos", "x")).select("node", "pos", F.round("x", 7).alias("x"))


@query(f"WITH {RING}, s AS (SELECT src, dst, (src % 10) / 3.0::DOUBLE AS score FROM r) SELECT src, dst, round(exp(score) / sum(exp(score)) OVER (PARTITION BY dst), 9) AS weight FROM s")
def w6_g4_edge_softmax(spark, sf_dir):
    s = ring(spark, sf_dir).withColumn("score", (F.col("src") % 10) / 3.0)
    return graph.softmax(s).select("src", "dst", F.round("weight", 9).alias("weight"))


@query()
def w5_neighbour_sampling(spark, sf_dir):
    return graph.sample_neighbours(fk_graph(spark, sf_dir), table(spark, sf_dir, "part").select((F.col("p_partkey") * 10 + 2).alias("node")), (10, 5))


@query(f"WITH {GRAPH} SELECT dst AS node, least(10, count(DISTINCT src)) AS n, least(10, count(DISTINCT src)) AS others, CAST(0 AS BIGINT) AS strays FROM g JOIN part ON dst = p_partkey * 10 + 2 GROUP BY 1")
def w5_first_hop(spark, sf_dir):
    """Of each part's sampled neighbours: how many, how many different, how many it has no edge from."""
    g, seeds = fk_graph(spark, sf_dir), table(spark, sf_dir, "part").select((F.col("p_partkey") * 10 + 2).alias("node"))
    n = shared.parts(g)
    real = g.select("src", "dst").repartition(n, "src", "dst").distinct().withColumn("edge", F.lit(1))
    found = graph.sample_neighbours(g, seeds, (10,)).repartition(n, "src", "dst").join(real, ["src", "dst"], "left").repartition(n, "dst")
    return found.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("others"), F.sum(F.col("edge").isNull().cast("long")).alias("strays"))


PART_EDGES = "e AS (SELECT l_partkey AS u, l_suppkey + 1000000 AS v FROM lineitem WHERE l_suppkey % 5 = 0 UNION SELECT l_partkey, l_partkey % 7 + 1 FROM lineitem UNION SELECT p_partkey, k FROM part, range(1, 41) r(k) WHERE p_partkey <= 40 AND (p_partkey + k) % 13 <> 0)"


@query(f"""WITH {PART_EDGES}, b AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v), n AS (SELECT p_partkey AS u FROM part),
d AS (SELECT n.u, count(m.u) AS known FROM n LEFT JOIN b ON b.u = n.u LEFT JOIN n m ON m.u = b.v GROUP BY 1)
SELECT u, least(4, (SELECT count(*) FROM n) - 1 - known) AS found, CAST(0 AS BIGINT) AS edges, least(4, (SELECT count(*) FROM n) - 1 - known) AS others FROM d WHERE (SELECT count(*) FROM n) - 1 > known""")
def g3_negatives_until_enough(spark, sf_dir):
    """Four parts for each part that it has no edge with; how many came, how many are edges all the same, how many are different."""
    edges = part_edges(spark, sf_dir)
    found = graph.negatives(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), edges, 4)
    either = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src")).distinct().withColumn("edge", F.lit(1))
    return found.join(either, ["u", "v"], "left").groupBy("u").agg(F.count(F.lit(1)).alias("found"), F.sum(F.coalesce("edge", F.lit(0)).cast("long")).alias("edges"), F.countDistinct("v").alias("others"))


def part_edges(spark, sf_dir):
    """Edges between parts and others; the first forty parts are joined to nearly all of each other."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_partkey <= 40")
    one = li.where("l_suppkey % 5 = 0").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"))
    two = li.select("l_partkey", F.col("l_partkey") % 7 + 1)
    three = p.select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(40)).cast("array<bigint>")).alias("k")).where("(p_partkey + k) % 13 <> 0")
    return one.union(two).union(three).distinct()


@query("SELECT c_custkey AS u, CAST(2 + CAST(row_number() OVER (ORDER BY c_custkey) > 0 AS INT) AS BIGINT) AS n, CAST(0 AS BIGINT) AS loops FROM customer")
def j11_cycle_pairs(spark, sf_dir):
    """Three rounds of pairs of customers: each is in every round once, and never with itself."""
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    found = graph.sample_cycle_pairs(nodes, 3 * nodes.count())
    return found.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("u") == F.col("v")).cast("long")).alias("loops"))


# ---- reports ---------------------------------------------------------------

RUNS = "runs AS (SELECT o_orderpriority AS task, o_orderstatus AS dataset, CAST(o_custkey % 4 AS BIGINT) AS dim, o_totalprice / 1000 AS f1 FROM orders)"


def runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("dataset"), (F.col("o_custkey") % 4).alias("dim"), (F.col("o_totalprice") / 1000).alias("f1"))


@query(f"WITH {RUNS} SELECT dataset, task, dim, round(avg(f1), 6) AS mean, round(coalesce(stddev_samp(f1), 0), 6) AS std, count(f1) AS n FROM runs GROUP BY ALL")
def a16_mean_std(spark, sf_dir):
    r = report.mean_and_std(runs(spark, sf_dir), "f1", ["dataset", "task", "dim"])
    return r.select("dataset", "task", "dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(f"WITH {RUNS}, i AS (SELECT dim, task, avg(f1) AS f1 FROM runs GROUP BY ALL) SELECT dim, round(avg(f1), 6) AS mean, round(coalesce(stddev_samp(f1), 0), 6) AS std FROM i GROUP BY 1")
def a17_macro_average(spark, sf_dir):
    return report.macro(runs(spark, sf_dir), "f1", ["dim", "task"], ["dim"]).select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {RUNS}, s AS (SELECT task, dim, CAST(count(*) AS VARCHAR) AS n FROM runs GROUP BY ALL) SELECT task, coalesce(max(n) FILTER (dim = 0), 'N/A') AS \"0\", coalesce(max(n) FILTER (dim = 1), 'N/A') AS \"1\", coalesce(max(n) FILTER (dim = 2), 'N/A') AS \"2\", coalesce(max(n) FILTER (dim = 9), 'N/A') AS \"9\" FROM s GROUP BY 1")
def a18_pivot(spark, sf_dir):
    n = runs(spark, sf_dir).groupBy("task", "dim").agg(F.count(F.lit(1)).cast("string").alias("n"))
    return report.wide(n, ["task"], "dim", [0, 1, 2, 9], "n")


@query("SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS anchors, round(avg(value), 6) AS mean_value, round(sum(value * 0.15 + user_id * 0.6) / 1e6, 9) AS usd FROM events GROUP BY 1")
def a19_a28_f24_call_costs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("user_id").alias("anchors"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.sum(T.cost_usd("value", "user_id", 0.15, 0.6)), 9).alias("usd"))


@query(f"WITH {RUNS}, m AS (SELECT task, dataset || '-' || dim AS atom, avg(f1) AS auc FROM runs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY auc DESC, atom) AS rank FROM m) SELECT task, atom, round(auc, 6) AS auc, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def a20_w4_strongest(spark, sf_dir):
    stats = runs(spark, sf_dir).select("task", F.concat_ws("-", "dataset", "dim").alias("atom"), F.col("f1").alias("auc"), F.lit(0.0).alias("f1"), F.lit(0.0).alias("missing_rate"))
    return report.strongest(stats, 3).select("task", "atom", F.round("auc", 6).alias("auc"), "rank")


@query(f"WITH {RUNS}, a AS (SELECT task, dim, avg(f1) AS one FROM runs WHERE dataset = 'F' AND dim < 3 GROUP BY ALL), b AS (SELECT task, dim, avg(f1) AS two FROM runs WHERE dataset = 'O' AND dim > 0 GROUP BY ALL) SELECT task, dim, round(one, 6) AS one, round(two, 6) AS two, round(two - one, 6) AS delta FROM a FULL JOIN b USING (task, dim)")
def j8_compare_runs(spark, sf_dir):
    r = runs(spark, sf_dir)
    mean = lambda c: r.where(c).groupBy("task", "dim").agg(F.avg("f1").alias("f1"))
    found = report.compare(mean("dataset = 'F' AND dim < 3"), mean("dataset = 'O' AND dim > 0"), ["task", "dim"], "f1")
    return found.select("task", "dim", *[F.round(c, 6).alias(c) for c in ("one", "two", "delta")])


@query("SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def w3_s18_carry_forward(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") != "assistant", F.col("role")).alias("section"))
    return report.carry_forward(lines, "section", ["conv_id"], "turn")


LOG_SQL = """l AS (SELECT o_orderkey AS k, regexp_extract(lower(o_orderpriority), '[a-z_]+') AS task, 0.1 + (o_orderkey % 1000000) / 1e7 AS th, (o_custkey % 1000) / 1000 AS val, (o_custkey % 100) / 100 AS half, (o_orderkey % 91) / 91 AS own FROM orders)"""


@query(f"WITH {LOG_SQL} SELECT task, round(th, 7) AS threshold_valbest, round(val, 6) AS val_f1_best, round(own, 6) AS test_f1_valbest, CASE WHEN k % 3 > 0 THEN round(half, 6) END AS test_f1_at05 FROM l")
def s18_log_sections(spark, sf_dir):
    """A training log with a section for each order, written as text and read again by blocks of its files."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.regexp_extract(F.lower("o_orderpriority"), "[a-z_]+", 0).alias("task"), (0.1 + F.col("o_orderkey") % 1000000 / 1e7).alias("at"), (F.col("o_custkey") % 1000 / 1000).alias("val"), (F.col("o_custkey") % 100 / 100).alias("half"), (F.col("o_orderkey") % 91 / 91).alias("own"))
    test = lambda at, f1: F.format_string(f"INFO Test Metrics (threshold={at}): {{'link_f1': %.9f}}", *f1)
    told = [F.format_string("INFO Training for task: %s", "task"), F.lit("epoch 1"), F.format_string("[Validation] selected threshold=%.7f f1=%.6f", "at", "val"), F.when(F.col("k") % 3 > 0, test("0.5", ["half"])), F.when(F.col("k") % 2 == 0, test("0.9", [F.lit(0.123)])), F.when(F.col("k") % 4 != 1, test("%.7f", ["at", "own"])).otherwise(test("0.8", ["own"]))]
    root = shared.folder(spark, "logs")
    o.repartitionByRange("k").sortWithinPartitions("k").select(F.explode(F.array_compact(F.array(*told))).alias("value")).write.text(root)
    return report.read_logs(spark, root).select("task", F.round("threshold_valbest", 7).alias("threshold_valbest"), F.round("val_f1_best", 6).alias("val_f1_best"), F.round("test_f1_valbest", 6).alias("test_f1_valbest"), F.round("test_f1_at05", 6).alias("test_f1_at05"))


@query("WITH t AS (SELECT o_orderkey AS id, printf('%.2f', o_totalprice) || '±' || printf('%d', o_custkey) AS c FROM orders) SELECT id, CAST(split_part(c, '±', 1) AS DOUBLE) AS mean, CAST(split_part(c, '±', 2) AS DOUBLE) AS std FROM t")
def s19_f22_mean_std_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.mean_std(F.format_string("%.2f±%d", "o_totalprice", "o_custkey")).alias("x"))
    return o.select("id", "x.mean", "x.std")


@query(r"""SELECT event_id, coalesce(nullif(trim(regexp_replace(event_type, '[^0-9A-Za-z_.-]+', '_', 'g'), '._-'), ''), 'item') AS token,
nullif(regexp_extract(regexp_replace(props, '(?m)^\s*```.*$', '', 'g'), '(?s)\{.*\}', 0), '') AS json, nullif(split_part(event_type, ' ', 1), '') AS flag FROM events""")
def f19_f21_f27_text_helpers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", T.path_token("event_type").alias("token"), T.json_object("props").alias("json"), T.flag_value(F.concat(F.lit("run --mode "), F.col("event_type")), "mode").alias("flag"))


@query("SELECT page_id, list_sort(list_distinct(regexp_extract_all(lower(url), '[a-z0-9]+'))) AS tokens, length(url) AS n FROM pages")
def f4_value_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_sort(F.array_distinct(T.value_tokens("url"))).alias("tokens"), F.length("url").cast("long").alias("n"))


@query()
def a24_pair_digest(spark, sf_dir):
    return files.pair_digest(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b")))


@query("SELECT event_type, CAST(count(*) - count(DISTINCT user_id) AS BIGINT) AS hits, count(DISTINCT user_id) AS misses, (count(*) - count(DISTINCT user_id)) / CAST(count(*) AS DOUBLE) AS hit_ratio FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def a27_cache_hit_ratios(spark, sf_dir):
    return files.hit_ratios(table(spark, sf_dir, "events").where("user_id is not null"), "event_type", ["user_id"])


PRICED = "p AS (SELECT o_totalprice AS score, CAST(o_custkey % 3 = 0 OR o_totalprice > 200000 AS INT) AS label FROM orders)"


@query(f"""WITH {PRICED}, u AS (SELECT count(DISTINCT score) AS n FROM p), c AS (SELECT DISTINCT score AS t FROM p, u WHERE n <= 2048 UNION SELECT unnest(q) FROM (SELECT quantile_cont(score, {[i / 2047 for i in range(2048)]}) AS q FROM p), u WHERE n > 2048),
m AS (SELECT t, count(*) FILTER (label = 1) AS tp, count(*) FILTER (label = 0) AS fp FROM c JOIN p ON score >= t GROUP BY t), f AS (SELECT t, 2 * tp / CAST(tp + fp + (SELECT count(*) FILTER (label = 1) FROM p) AS DOUBLE) AS f1 FROM m)
SELECT round(t, 3) AS threshold, round(f1, 9) AS f1 FROM f ORDER BY round(f1, 12) DESC, t LIMIT 1""")
def t7_best_of_many_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("double").alias("score"), ((F.col("o_custkey") % 3 == 0) | (F.col("o_totalprice") > 200000)).cast("int").alias("label"))
    return evaluate.best_score_threshold(rows).select(F.round("threshold", 3).alias("threshold"), F.round("f1", 9).alias("f1"))


@query("""WITH e AS (SELECT vec_id // 48 AS batch, vec_id, CAST(vec_id % 4 AS INT) - 1 AS y, embedding AS v FROM embeddings WHERE vec_id % 4 > 0),
s AS (SELECT a.batch, a.vec_id AS i, b.vec_id AS j, a.y AS yi, b.y AS yj, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / 0.1::DOUBLE AS s FROM e a JOIN e b ON a.batch = b.batch),
t AS (SELECT i, ln(sum(exp(s))) AS t FROM s GROUP BY 1), l AS (SELECT batch, i, sum(s - t) / (count(*) + 1e-8) AS m FROM s JOIN t USING (i) WHERE yi = 1 AND yj = 1 AND i <> j GROUP BY ALL)
SELECT batch, round(coalesce(-avg(m), 0), 6) AS loss FROM (SELECT DISTINCT batch FROM e) LEFT JOIN l USING (batch) GROUP BY 1""")
def g7_contrastive_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 48).alias("batch"), (F.col("vec_id") % 4 - 1).alias("label"), "embedding")
    return learn.contrastive_loss(rows, "batch").select("batch", F.round("loss", 6).alias("loss"))


@query()
def g8_early_stopping(spark, sf_dir):
    """What each epoch gives for a scorer of customers; few epochs, as each passes over all rows."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 10000).alias("x1"), (F.col("c_nationkey") / 25).alias("x2"), ((F.col("c_acctbal") / 10000 + F.col("c_custkey") % 3 / 10) > 0.5).cast("int").alias("label"))
    _, history = learn.train_early(c.where("c_custkey % 5 < 4"), c.where("c_custkey % 5 = 4"), ["x1", "x2"], epochs=6, patience=3)
    return spark.createDataFrame([(h["epoch"], round(h["loss"], 6), round(h["f1"], 6)) for h in history], "epoch int, loss double, f1 double")


def fixed_weights(out: int, into: int, seed: int) -> encoder.Weights:
    return [[((i * 3 + j * 5 + seed) % 7 - 3) / 10 for j in range(into)] for i in range(out)], [((i + seed) % 3 - 1) / 10 for i in range(out)]


@query()
def g4_g5_encoder_layer(spark, sf_dir):
    """A layer of attention with edge vectors, and one of graph attention, each gated, over a ring of vectors."""
    x = vectors(spark, sf_dir).select("node", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
    x = x.select("node", learn.dense(F.col("embedding"), *fixed_weights(4, 64, 8)).alias("embedding"))
    edges = ring(spark, sf_dir).where("src >= 0").distinct().withColumn("edge", F.array(F.col("src") % 3 / 3.0, F.lit(0.5)))
    w = {n: fixed_weights(4, 2 if n == "edge" else 4, k) for k, n in enumerate(("q", "k", "v", "edge", "out", "left", "right"))}
    gate = [0.1, -0.2, 0.3, 0.0, 0.2, -0.1, 0.1, 0.05]
    x = encoder.gated(x, encoder.attend(edges, x, w, 2), gate, 0.1)
    x = encoder.gated(x, encoder.graph_attention(edges, x, w, [[0.3, -0.2], [0.1, 0.4]], [0.0] * 4, 2), gate, 0.1)
    return x.select("node", F.posexplode("embedding").alias("pos", "x")).select("node", "pos", F.round("x", 7).alias("x"))


@query(f"""WITH {EVIDENCE_SQL}, q AS (SELECT quantile_cont(degree_ratio, 0.8) AS q FROM e)
SELECT id, round(CASE WHEN src_degree > 12 AND dst_degree >= 5 THEN 0.06 ELSE 0 END + CASE WHEN s_prior < 0.35 AND uncertainty BETWEEN 0.25 AND 0.65 AND dst_degree <= 6 THEN -0.04 ELSE 0 END + CASE WHEN degree_ratio >= q THEN 0.05 ELSE 0 END, 9)::DOUBLE AS delta FROM e, q""")
def k11_replay(spark, sf_dir):
    """Stored rows whose derived evidence has gone stale."""
    stored = evidence(spark, sf_dir).withColumns({"uncertainty": F.lit(0.0), "degree_ratio": F.lit(-1.0)})
    found = policy.replay(stored, policy.validate(POLICY, "entity_matching", EVIDENCE))
    return found.select("id", F.round("delta", 9).alias("delta"))


FAMILY_SQL = "CASE " + " ".join(f"WHEN k IN ({', '.join(repr(n) for n in names)}) THEN '{kind}'" for kind, names in roles.FAMILIES.items()) + " " + " ".join(f"WHEN regexp_matches(k, '{parts}') THEN '{kind}'" for kind, parts in roles.NAMED) + " ELSE 'general_similarity' END"


@query(f"WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN ' Row_Profile ' WHEN 1 THEN p_name || '_Header_size' WHEN 2 THEN 'cell_ratio' WHEN 3 THEN 'col_count' WHEN 4 THEN p_name || ' size' ELSE 'plain' END AS name, CASE WHEN p_partkey % 11 = 0 THEN ' Own ' ELSE '' END AS told FROM part), k AS (SELECT *, lower(trim(name)) AS k FROM n) SELECT id, CASE WHEN trim(told) <> '' THEN lower(trim(told)) ELSE {FAMILY_SQL} END AS family FROM k")
def f25_feature_families(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kinds = {0: F.lit(" Row_Profile "), 1: F.concat("p_name", F.lit("_Header_size")), 2: F.lit("cell_ratio"), 3: F.lit("col_count"), 4: F.concat("p_name", F.lit(" size"))}
    name = F.lit("plain")
    for k, c in kinds.items():
        name = F.when(F.col("p_partkey") % 6 == k, c).otherwise(name)
    rows = p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.when(F.col("p_partkey") % 11 == 0, " Own ").otherwise("").alias("told"))
    return rows.select("id", roles.family("name", "told").alias("family"))


GROUP_SQL = ", ".join(f"('{t}', '{','.join(a)}')" for groups in atoms.GROUPS.values() for t, a in groups.items())


@query(f"""WITH g(token, a) AS (VALUES {GROUP_SQL}), c AS (SELECT DISTINCT token, CAST(NULL AS VARCHAR) AS formula FROM g UNION ALL SELECT 'part_' || p_partkey, 'expands_to=[' || p_brand || ', ' || p_size || ',]' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'part_' || p_partkey, p_type FROM part WHERE p_partkey % 3 > 0)
SELECT c.token, coalesce(max(g.a), max(regexp_replace(regexp_extract(c.formula, '^expands_to=.(.*).$', 1), ', *', ',', 'g').trim(','))) AS expands_to FROM c LEFT JOIN g ON g.token = c.token WHERE (g.token IS NOT NULL AND g.a <> g.token) OR (g.token IS NULL AND c.formula LIKE 'expands_to=%') GROUP BY 1""")
def f26_group_tokens(spark, sf_dir):
    known = spark.createDataFrame([(t,) for t in sorted({t for g in atoms.GROUPS.values() for t in g})], "token string").withColumns({"formula": F.lit(None).cast("string"), "range": F.lit(None).cast("string")})
    p = table(spark, sf_dir, "part")
    formula = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("expands_to=["), "p_brand", F.lit(", "), "p_size", F.lit(",]"))).otherwise(F.col("p_type"))
    cards = p.select(F.concat(F.lit("part_"), "p_partkey").alias("token"), formula.alias("formula"), F.lit("0..1").alias("range"))
    return roles.group_tokens(known.unionByName(cards)).select("token", F.array_join("expands_to", ",").alias("expands_to"))


@query(f"WITH {VALUES}, {SHARES}, {PAIRS}, {COLUMN_PAIRS} SELECT 'jaccard' AS atom, avg(CAST(i > 0 AS DOUBLE)) AS hit_ratio FROM joined UNION ALL SELECT 'coverage_max', avg(CAST(i > 0 AS DOUBLE)) FROM joined UNION ALL SELECT 'any', avg(CAST(i > 0 AS DOUBLE)) FROM joined")
def a15_p1_p3_hit_ratios(spark, sf_dir):
    c = shared.written(counted(spark, sf_dir), "counted")
    values = shared.written(profile.join_values(c), "values")
    found = atoms.joinable(key_pairs(spark), with_id(profile.join_columns(c, values)), with_id(values).select("id", "v"), ["jaccard", "coverage_max"])
    return evaluate.hits(found, ["jaccard", "coverage_max"])


FEATURE = {"feature_name": "column_jaccard", "task": "joinable_table_search", "scope": "column_pair", "inputs_used": ["n_distinct"], "fallback_value": 0.0, "range_hint": [0.0, 1.0],
           "code": "def compute_feature(ctx):\n    helpers = ctx['helpers']\n    a = ctx['stats_a']\n    b = ctx['stats_b']\n    return helpers['safe_ratio_float'](a['n_distinct'], b['n_distinct']) * 0.5 + 0.5 * helpers['token_jaccard'](a['header_tokens'], b['header_tokens'])\n"}


@query(f"WITH {VALUES}, {SHARES}, {PAIRS}, {COLUMN_PAIRS} SELECT a, b, round(0.5 * {SAFE.format('na', 'nb')} + 0.5 * {JACCARD.format('ha', 'hb')}, 9) AS column_jaccard FROM joined")
def udf_generated_feature(spark, sf_dir):
    profiles = with_id(profile.join_columns(shared.written(counted(spark, sf_dir), "counted")))
    found = generated.compute(atoms._sides(key_pairs(spark), profiles), [generated.validate(FEATURE, "joinable_table_search")], ["a", "b"])
    return found.select("a", "b", F.round("column_jaccard", 9).alias("column_jaccard"))


def user_feature(name: str, body: str) -> generated.Feature:
    lines = ["def compute_feature(ctx):", "a = ctx['stats_a']", "b = ctx['stats_b']", "h = ctx['helpers']", *body.strip().split("\n")]
    return generated.validate({"feature_name": name, "code": "\n    ".join(lines), "fallback_value": -1.0})


#: Features in a user's own words: folds, sets made in loops, choices, and what goes wrong (a median that isn't there).
USER = [
    user_feature("value_share", "both = a['value_set'].intersection(b['value_set'])\nevery = a['value_set'].union(b['value_set'])\nreturn len(both) / len(every) if every else 0.0"),
    user_feature("token_cover", "s = a['token_set']\nt = b['token_set']\nif not s or not t:\n    return 0.0\nreturn len(s.intersection(t)) / min(len(s), len(t))"),
    user_feature("same_fields", "m = a['header_to_value']\nk = b['header_to_value']\nn = 0\nfor key in m.keys():\n    if key in k and m[key] == k[key]:\n        n += 1\nreturn n / max(1, len(m))"),
    user_feature("field_share", "s = set()\nt = set()\nfor key in a['header_to_value']:\n    s.add(key + '=' + a['header_to_value'][key])\nfor key in b['header_to_value']:\n    t.add(key + '=' + b['header_to_value'][key])\nreturn h['set_jaccard'](s, t)"),
    user_feature("median_nearness", "x = float(a['numeric_median'])\ny = float(b['numeric_median'])\nreturn 1 / (1 + abs(x - y) / max(abs(x), abs(y), 1.0))"),
    user_feature("field_balance", "x = a['nonempty_count']\ny = b['nonempty_count']\nreturn 1.0 - abs(x - y) / max(x + y, 1)"),
    user_feature("long_tokens", "n = 0\nfor token in a['token_set']:\n    if len(token) > 5 and token not in b['token_set']:\n        n = n + len(token)\nreturn n"),
]


@query(f"""WITH {ROW_SQL}, {ENTITY_PAIRS}, j AS (SELECT pairs.a, pairs.b, x, y FROM pairs JOIN prof x ON x.id = a JOIN prof y ON y.id = b)
SELECT a, b, round({JACCARD.format('x.value_set', 'y.value_set')}, 9) AS value_share, round(len(list_intersect(x.token_set, y.token_set)) / CAST(least(len(x.token_set), len(y.token_set)) AS DOUBLE), 9) AS token_cover,
 round(len(list_intersect(x.fields, y.fields)) / CAST(len(x.fields) AS DOUBLE), 9) AS same_fields, round({JACCARD.format('x.fields', 'y.fields')}, 9) AS field_share,
 round(coalesce(1 / (1 + abs(x.numeric_median - y.numeric_median) / greatest(abs(x.numeric_median), abs(y.numeric_median), 1.0)), -1), 9) AS median_nearness,
 round(1.0::DOUBLE - abs(x.nonempty_count - y.nonempty_count) / (x.nonempty_count + y.nonempty_count)::DOUBLE, 9) AS field_balance, coalesce(list_sum([length(t) for t in x.token_set if length(t) > 5 and not list_contains(y.token_set, t)]), 0)::DOUBLE AS long_tokens FROM j""")
def udf_compiled_features(spark, sf_dir):
    """Seven features as native columns: no Python runs."""
    found = compiled.compute(atoms._sides(entity_pairs(spark, sf_dir), row_profiles(spark, sf_dir)), USER, ["a", "b"])
    return found.select("a", "b", *[F.round(f.name, 9).alias(f.name) for f in USER])


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    return scoring.windowed(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 6).alias("total"))


@query()
def g5_g6_g8_g13_decoder(spark, sf_dir):
    rows = shared.written(_join_atoms(spark, sf_dir), "atoms").withColumn("label", (F.regexp_extract("a", r"_([a-z]+)$", 1) == F.regexp_extract("b", r"_([a-z]+)$", 1)).cast("int"))
    names = list(atoms.ATOMS["joinable_table_search"][:6])
    return learn.score(learn.train_decoder(rows, names, 20), rows).select("a", "b", "label", F.round("score", 4).alias("score"))


@query(f"""WITH {ROW_SQL}, {ENTITY_PAIRS}, j AS (SELECT pairs.a, pairs.b, x, y FROM pairs JOIN prof x ON x.id = a JOIN prof y ON y.id = b)
SELECT a, b, {JACCARD.format('x.value_set', 'y.value_set')} AS value_overlap, {SAFE.format('x.nonempty_count', 'y.nonempty_count')} AS field_balance, {JACCARD.format('x.serial_token_set', 'y.serial_token_set')} AS serial_overlap,
 CASE WHEN greatest(length(x.serial_text), length(y.serial_text)) > 128 THEN {JACCARD.format(RAW_GRAMS.format('x.serial_text', 3), RAW_GRAMS.format('y.serial_text', 3))} ELSE {EDIT.format('x.serial_text', 'y.serial_text')} END AS serial_edit,
 len(list_intersect(x.numeric_value_set, y.numeric_value_set)) / CAST(least(len(x.numeric_value_set), len(y.numeric_value_set)) AS DOUBLE) AS number_overlap, {JACCARD.format('x.header_value_token_set', 'y.header_value_token_set')} AS cross_overlap FROM j""")
def udf_entity_features(spark, sf_dir):
    rows = row_profiles(spark, sf_dir)
    return generated.compute(atoms._sides(entity_pairs(spark, sf_dir), rows), generated.dry_run("entity_matching"), ["a", "b"])


@query(f"WITH {GRAPH} SELECT DISTINCT src, dst, 1.0::DOUBLE AS value FROM g")
def g2_adjacency(spark, sf_dir):
    return graph.adjacency(fk_graph(spark, sf_dir))


@query(f"""WITH {RING}, e AS (SELECT src, dst FROM r UNION ALL SELECT vec_id, vec_id FROM embeddings), n AS (SELECT dst, count(*) AS n FROM e GROUP BY 1),
x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT e.dst AS node, CAST(pos - 1 AS INT) AS pos, round(sum(x / sqrt(a.n * b.n)), 7) AS x FROM e JOIN n a ON a.dst = e.dst JOIN n b ON b.dst = e.src JOIN x ON vec_id = e.src GROUP BY ALL""")
def g5_convolution(spark, sf_dir):
    return graph.convolve(ring(spark, sf_dir), vectors(spark, sf_dir), "gcn").select("node", "pos", F.round("x", 7).alias("x"))


@query(f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY seg) AS n FROM scored) SELECT id, seg FROM r WHERE r <= greatest(1, ceil(n * 0.05))")
def t2_mine_top_per_batch(spark, sf_dir):
    return evaluate.mine_top_per(scored(spark, sf_dir), 0.05, ("seg",)).select("id", "seg")


@query(f"""WITH {SCORED}, x AS (SELECT score AS s, label, id % 4 = 0 AS active, CASE WHEN id % 2 = 0 THEN 0.1 ELSE -0.1 END AS residual FROM scored), g AS (SELECT margin, cap FROM (VALUES (0.05::DOUBLE), (0.2)) m(margin), (VALUES (0.05::DOUBLE), (0.1)) c(cap)),
y AS (SELECT g.*, label = 1 AS y, s >= 0.5 AS was, CASE WHEN NOT active AND abs(s - 0.5) <= margin THEN least(1.0, greatest(0.0, s + least(cap, greatest(-cap, residual)))) ELSE s END >= 0.5 AS now FROM x, g)
SELECT margin, cap, 2 * count(*) FILTER (now AND y) / CAST(2 * count(*) FILTER (now AND y) + count(*) FILTER (now AND NOT y) + count(*) FILTER (NOT now AND y) AS DOUBLE) AS f1, count(*) FILTER (was <> y AND now = y) - count(*) FILTER (was = y AND now <> y) AS fix_gap FROM y GROUP BY ALL""")
def k10_residual_search(spark, sf_dir):
    rows = scored(spark, sf_dir).select(F.col("score").alias("s"), "label", (F.col("id") % 4 == 0).alias("active"), F.when(F.col("id") % 2 == 0, 0.1).otherwise(-0.1).alias("residual"))
    return rerank.search_residual(rows, 0.5, [0.05, 0.2], [0.05, 0.1]).select("margin", "cap", "f1", "fix_gap")


@query()
def k7_benefit_model(spark, sf_dir):
    rows = moved(spark, sf_dir).withColumns({"src_degree": F.col("id") % 5, "dst_degree": F.col("id") % 7})
    model = learn.train_benefit(rows, 0.5, rounds=20)
    scored_rows = learn.score(model, rows.withColumns(rerank.benefit_features(0.5)))
    return scored_rows.select("id", F.round("score", 4).alias("benefit"))


@query(f"""WITH {SCORED}, {MOVED}, t AS (SELECT count(*)::DOUBLE AS n, sum(s) AS a, sum(delta) AS b, sum(s * s) + 1 AS aa, sum(s * delta) AS ab, sum(delta * delta) + 1 AS bb, sum(label - s) AS r, sum((label - s) * s) AS ra, sum((label - s) * delta) AS rb FROM mv),
d AS (SELECT *, n * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b) AS det FROM t)
SELECT 'intercept' AS feature, round((r * (aa * bb - ab * ab) - a * (ra * bb - ab * rb) + b * (ra * ab - aa * rb)) / det, 6) AS weight FROM d
UNION ALL SELECT 's', round((n * (ra * bb - ab * rb) - r * (a * bb - ab * b) + b * (a * rb - ra * b)) / det, 6) FROM d
UNION ALL SELECT 'delta', round((n * (aa * rb - ra * ab) - a * (a * rb - ra * b) + r * (a * ab - aa * b)) / det, 6) FROM d""")
def k8_ridge_residual(spark, sf_dir):
    rows = moved(spark, sf_dir).withColumns({"residual": F.col("label") - F.col("s"), "w": F.lit(1.0)})
    weights = rerank.normal_equations(rows, ["s", "delta"], "residual", "w")
    return spark.createDataFrame([(n, round(x, 6)) for n, x in zip(["intercept", "s", "delta"], weights, strict=True)], "feature string, weight double")


# ---- single functions over whole columns -------------------------------------


@query(f"WITH {CELLS}, v AS (SELECT table_name, column_name, {NORM} AS v FROM cells) SELECT table_name, column_name, count(*) FILTER ({NUMERIC}) AS n_numeric, count(*) FILTER (v IN ({NULLS})) AS n_missing, CAST(sum(length(v)) AS BIGINT) AS n_chars FROM v GROUP BY ALL")
def f1_f12_p4_cell_kinds(spark, sf_dir):
    v = cells(spark, sf_dir).withColumn("v", T.normalise("raw"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return v.groupBy("table_name", "column_name").agg(n(T.is_numeric("v")).alias("n_numeric"), n(T.is_missing("v")).alias("n_missing"), n(F.length("v")).alias("n_chars"))


@query(f"WITH {CELLS} SELECT DISTINCT table_name, column_name, {HEADER.format('column_name')} AS tokens FROM cells")
def f2_f3_f5_header_tokens(spark, sf_dir):
    return cells(spark, sf_dir).select("table_name", "column_name").distinct().withColumn("tokens", T.header_tokens("column_name"))


#: Texts that a task compares.
TEXTS = 5_000
LONG_NAME = "CASE WHEN p_partkey % 5 = 0 THEN repeat(p_name || ' ', 12) WHEN p_partkey % 5 = 1 THEN repeat(upper(p_name), 11) ELSE p_name END"


@query(f"""WITH n AS (SELECT p_partkey, {LONG_NAME} AS s FROM part), p AS (SELECT x.p_partkey AS a, y.p_partkey AS b, x.s AS na, y.s AS nb FROM n x JOIN n y ON y.p_partkey = x.p_partkey + 1)
SELECT a, b, CASE WHEN greatest(length(na), length(nb)) > 128 THEN {JACCARD.format(RAW_GRAMS.format('na', 3), RAW_GRAMS.format('nb', 3))} ELSE {EDIT.format('na', 'nb')} END AS edit, {JACCARD.format(GRAMS.format('trim(na)', 3), GRAMS.format('trim(nb)', 3))} AS char3, {JACCARD.format("regexp_extract_all(lower(na), '[a-z0-9]+')", "regexp_extract_all(lower(nb), '[a-z0-9]+')")} AS tokens FROM p""")
def f8_f9_text_similarity(spark, sf_dir):
    """Names beside their neighbours; some repeated beyond the exact length, some of these in capitals."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.expr(LONG_NAME).alias("na"))
    two = p.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("na").alias("nb"))
    rows = p.join(two, "a")
    # Two names are compared once, however many rows have them; dealt out first, as the work is in the texts and not in their bytes.
    names = rows.select("na", "nb").repartition(shared.parts(p, rows=TEXTS), "na", "nb").distinct()
    found = names.select(F.col("na").alias("x"), F.col("nb").alias("y"), T.edit_similarity("na", "nb").alias("edit"), T.ngram_jaccard("na", "nb", 3).alias("char3"), T.jaccard(T.value_tokens("na"), T.value_tokens("nb")).alias("tokens"))
    return rows.join(found, F.col("na").eqNullSafe(F.col("x")) & F.col("nb").eqNullSafe(F.col("y"))).select("a", "b", "edit", "char3", "tokens")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), t AS (SELECT doc_id, unnest(t) AS x FROM w), c AS (SELECT doc_id, x, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT doc_id, sum(n) AS s FROM c GROUP BY 1),
p AS (SELECT w.doc_id AS a, w.doc_id + 1 AS b FROM w JOIN w w2 ON w2.doc_id = w.doc_id + 1),
f AS (SELECT a, b, x, n / s AS p, 0.0::DOUBLE AS q FROM p JOIN c ON doc_id = a JOIN s ON s.doc_id = a UNION ALL SELECT a, b, x, 0.0, n / s FROM p JOIN c ON doc_id = b JOIN s ON s.doc_id = b),
g AS (SELECT a, b, x, sum(p) AS p, sum(q) AS q FROM f GROUP BY ALL), both_ AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b),
j AS (SELECT a, b, 1 - 0.5 * sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) AS s FROM g GROUP BY ALL)
SELECT a, b, round(s, 8) AS js FROM j JOIN both_ USING (a, b)""")
def f10_js_similarity(spark, sf_dir):
    """Neighbouring documents by token frequencies."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a"), "text")
    n = shared.parts(docs, rows=TEXTS)
    # Texts are dealt out before they are cut into tokens, both sides alike: the join needs no other shuffle.
    tokens = lambda df, *keys: df.repartition(n, "a").select(*keys, T.value_tokens("text").alias("t")).where("size(t) > 0")
    one = tokens(docs, "a").withColumnRenamed("t", "x")
    two = tokens(docs.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), "text"), "a", "b").withColumnRenamed("t", "y")
    return one.hint("merge").join(two, "a").select("a", "b", F.round(T.js_similarity("x", "y"), 8).alias("js"))


@query("SELECT s_suppkey AS id, least(1.0, greatest(0.0, s_acctbal / 10000)) AS clipped, CASE WHEN s_acctbal > 0 AND s_nationkey > 0 THEN least(s_acctbal, s_nationkey) / greatest(s_acctbal, s_nationkey) ELSE 0.0 END AS ratio, 1 / (1 + abs(s_acctbal - s_nationkey) / greatest(abs(s_acctbal), abs(s_nationkey), 1.0)) AS close FROM supplier")
def f11_f16_number_similarity(spark, sf_dir):
    n = F.col("s_nationkey").cast("double")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), T.clip01(F.col("s_acctbal") / 10000).alias("clipped"), T.safe_ratio("s_acctbal", n).alias("ratio"), T.relative_closeness("s_acctbal", n).alias("close"))


@query("SELECT o_orderkey AS id, o_orderkey AS a, o_custkey AS b, trim(regexp_replace(o_orderpriority, '[^0-9A-Za-z_.-]+', '_', 'g'), '._-') AS token FROM orders")
def f18_f19_indexes_and_tokens(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), T.row_index(F.concat(F.lit(" "), F.col("o_orderkey"))).alias("a"), T.row_index(F.concat(F.col("o_custkey"), F.lit(".0"))).alias("b"), T.path_token("o_orderpriority").alias("token"))


# ---- more of edges, specs and settings -----------------------------------------


@query("SELECT l_orderkey AS u, l_partkey AS v, CAST(l_discount > 0.05 AS INT) AS label FROM lineitem UNION ALL SELECT o_orderkey, o_custkey, 0 FROM orders")
def u3_with_negatives(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("u"), F.col("l_partkey").alias("v"), (F.col("l_discount") > 0.05).cast("int").alias("label"))
    return graph.with_negatives(own, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("u"), F.col("o_custkey").alias("v")))


@query("""WITH r AS (SELECT l_orderkey AS src, l_suppkey AS dst FROM lineitem), c AS (SELECT o_orderkey AS src, o_custkey AS dst FROM orders),
k AS (SELECT 'row' AS kind, src AS node FROM r UNION ALL SELECT 'column', src FROM c UNION ALL (SELECT 'table', dst FROM r UNION SELECT 'table', dst FROM c))
SELECT kind, node, count(*) AS n FROM k GROUP BY ALL""")
def u4_nodes_of_kinds(spark, sf_dir):
    """Rows and columns come once for each of their edges, tables once."""
    typed = lambda df, a, b, name: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(graph.EDGE_TYPES.index(name)).alias("type_id"))
    edges = typed(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "row_table").unionByName(typed(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "column_table"))
    found = [graph.nodes_of_kind(edges, kind).withColumn("kind", F.lit(kind)) for kind in ("row", "column", "table")]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("kind", "node").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS u, o_custkey AS v FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE (l_orderkey = o_orderkey AND l_partkey = o_custkey) OR (l_orderkey = o_custkey AND l_partkey = o_orderkey)) AND o_orderkey <> o_custkey")
def j9_not_an_edge(spark, sf_dir):
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("u"), F.col("o_custkey").alias("v"))
    return graph.without_edges(made, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("WITH c AS (SELECT DISTINCT o_orderpriority AS channel, 'f' || o_custkey % 50 AS atom FROM orders WHERE o_custkey % 50 < 20 OR o_orderpriority = '1-URGENT') SELECT atom, CAST(count(*) AS INT) AS n FROM c GROUP BY 1 HAVING count(*) >= 2")
def a22_atom_usage(spark, sf_dir):
    """Atoms that channels share, the channels being made from orders."""
    atom = F.concat(F.lit("f"), F.col("o_custkey") % 50)
    rows = table(spark, sf_dir, "orders").where("o_custkey % 50 < 20 or o_orderpriority = '1-URGENT'").select(F.col("o_orderpriority").alias("channel"), atom.alias("atom")).distinct()
    return rows.groupBy("atom").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n >= 2")


@query("""WITH p AS (SELECT p_partkey AS id, (p_size % 10) / 10.0::DOUBLE AS a, (p_partkey % 7) / 7.0::DOUBLE AS b, (p_partkey % 11) / 11.0::DOUBLE AS c, (p_size % 3) / 3.0::DOUBLE AS d FROM part)
SELECT id, greatest(a, b) AS overlap_mean_max, greatest(c, d) AS overlap_cov_max, least(b, c) AS size_balance, abs(a - b) AS overlap_direction_gap, greatest(a, d) AS coverage_max FROM p""")
def p9_derived_evidence(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    a, b, c, d = size % 10 / 10.0, k % 7 / 7.0, k % 11 / 11.0, size % 3 / 3.0
    named = {"col_overlap_a2b_mean": a, "col_overlap_b2a_mean": b, "col_overlap_a2b_cov": c, "col_overlap_b2a_cov": d, "col_count_ratio": b, "row_count_ratio": c, "coverage_a": a, "coverage_b": d}
    rows = table(spark, sf_dir, "part").select(k.alias("id"), *[v.alias(n) for n, v in named.items()], F.lit(0.5).alias("s_prior"), F.lit(1).alias("src_degree"), F.lit(2).alias("dst_degree"))
    return atoms.evidence(rows).select("id", "overlap_mean_max", "overlap_cov_max", "size_balance", "overlap_direction_gap", "coverage_max")


@query(f"WITH {EVIDENCE_SQL} SELECT id, round(degree_ratio * least(1.0, greatest(0.0, 1 - abs(s_prior - 0.5) / 0.15)), 9) AS boundary FROM e")
def k9_residual_features(spark, sf_dir):
    e = evidence(spark, sf_dir).withColumnRenamed("s_prior", "s")
    return e.select("id", F.round(rerank.residual_feature(F.col("degree_ratio"), 0.5, True), 9).alias("boundary"))


@query(f"WITH {FEATURE_SQL} SELECT id, f1 AS k1, f3 AS k2, f2 AS k3 FROM f")
def p2_decoder_keep(spark, sf_dir):
    """An atom that the source has twice is asked for twice, and gets both."""
    source = ["row_value_jaccard", "row_token_jaccard", "row_value_jaccard"]
    rows = features(spark, sf_dir).select("id", F.array("f1", "f2", "f3").alias("features"))
    kept = atoms.keep(rows, "entity_matching", source, ["row_value_jaccard", "none", "row_value_jaccard", "row_token_jaccard"])
    return kept.select("id", *[F.col("features")[i].alias(f"k{i + 1}") for i in range(3)])


@query(f"""WITH {FEATURE_SQL}, c AS (SELECT id, greatest(f1, 0) AS c1, CASE WHEN f3 > 0 THEN f2 ELSE -f2 END AS c2 FROM f), m AS (SELECT avg(c1) AS m1, sqrt(greatest(avg(c1 * c1) - avg(c1) * avg(c1), 1e-12)) AS s1, avg(c2) AS m2, sqrt(greatest(avg(c2 * c2) - avg(c2) * avg(c2), 1e-12)) AS s2 FROM c WHERE id % 3 > 0)
SELECT id, round((c1 - m1) / s1, 7) AS c1, round((c2 - m2) / s2, 7) AS c2 FROM c, m""")
def y9_standardised_channels(spark, sf_dir):
    spec = specs.validate(SPEC, FEATURES)
    rows = features(spark, sf_dir).select("id", *specs.channel_columns(spec, FEATURES))
    found = evaluate.standardise(rows, ["c1", "c2"], F.col("id") % 3 > 0)
    return found.select("id", F.round("c1", 7).alias("c1"), F.round("c2", 7).alias("c2"))


@query(f"""WITH {FEATURE_SQL}, c AS (SELECT id, greatest(f1, 0)::DOUBLE AS c1, 0.0::DOUBLE - f2 AS c2, (greatest(f1, f2, 0) - least(f1, 0))::DOUBLE AS c3 FROM f),
m AS (SELECT avg(c1) AS m1, sqrt(greatest(avg(c1 * c1) - avg(c1) * avg(c1), 1e-12)) AS s1, avg(c2) AS m2, sqrt(greatest(avg(c2 * c2) - avg(c2) * avg(c2), 1e-12)) AS s2, avg(least(2, c3)) AS m3, sqrt(greatest(avg(least(2, c3) * least(2, c3)) - avg(least(2, c3)) * avg(least(2, c3)), 1e-12)) AS s3 FROM c WHERE id % 3 > 0),
t AS (SELECT id, [(c1 - m1) / s1, (c2 - m2) / s2, (least(2, c3) - m3) / s3] AS x FROM c, m)
SELECT id, CAST(pos AS INT) AS pos, round(v, 7) AS x FROM (SELECT id, unnest(range(6)) AS pos, unnest(list_concat(x, x)) AS v FROM t)""")
def y9_tiled_channels(spark, sf_dir):
    """Three channels, standardised and twice over; the third feature is missing and counts as 0."""
    spec = specs.validate(SPEC, FEATURES)
    found = specs.representation(features(spark, sf_dir).drop("f3"), spec, repeat=2, train=F.col("id") % 3 > 0)
    return found.select("id", F.posexplode("channels").alias("pos", "x")).select("id", "pos", F.round("x", 7).alias("x"))


@query("""WITH g AS (SELECT DISTINCT o_orderkey AS s, o_custkey AS d FROM orders), n AS (SELECT l_orderkey AS s, l_suppkey AS d FROM lineitem UNION SELECT l_suppkey, l_orderkey FROM lineitem)
SELECT s AS src, count(*) AS added FROM (SELECT * FROM n EXCEPT SELECT * FROM g) GROUP BY 1""")
def u1_added_edges(spark, sf_dir):
    """Edges that a graph gains both ways, counted per source."""
    typed = lambda df, a, b: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(0).alias("type_id"))
    own, new = typed(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey"), typed(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")
    return graph.added(own, new).groupBy("src").agg(F.count(F.lit(1)).alias("added"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions_per_user(spark, sf_dir):
    return scoring.sessions(table(spark, sf_dir, "events"), gap="6 hours").select("user_id", "start", "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the lake's keys with every joinability atom, best first."""
    return _join_atoms(spark, sf_dir).orderBy(F.desc("jaccard"), "a", "b")
