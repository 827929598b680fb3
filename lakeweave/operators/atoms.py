"""Similarity atoms of candidate pairs, as plain columns.

Every scorer takes pairs (a, b) of ids, joins both sides' profiles from the left,
and selects the atoms asked for; Catalyst drops what nobody asked for. A pair
whose side has no profile scores 0 throughout. Pairs are put in order first, so
``a`` is the smaller id in directed atoms.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions import grams
from ..functions import text as T
from ..sources.shared import parts, written

#: Ids of a value up to which it meets itself, and parts in which the frequent values of an id are listed.
MOST_IDS, SALTS = 256, 16
#: Profiles of rows that a task joins with their pairs, some KB each.
PROFILE_ROWS = 50_000

#: The atoms of each task in their order, and named groups of them.
ATOMS = {
    "joinable_table_search": ("jaccard", "containment_max", "value_distribution", "coverage_a", "coverage_b", "coverage_max", "unique_ratio_sim", "numeric_ratio_sim", "avg_len_ratio_sim", "header_token_jaccard", "header_edit_similarity"),
    "entity_matching": ("row_emb_cosine", "row_emb_l1_sim", "row_value_jaccard", "row_value_containment_max", "row_token_jaccard", "row_nonempty_ratio", "row_numeric_ratio_sim", "row_avg_len_ratio", "row_serial_token_jaccard", "row_serial_edit_similarity", "row_numeric_value_overlap", "row_serial_char3_jaccard", "row_serial_char4_jaccard", "row_token_idf_jaccard", "row_numeric_rel_diff_sim", "row_header_jaccard", "row_header_value_exact_ratio", "row_header_token_jaccard"),
    "schema_matching": ("header_token_jaccard", "header_edit_similarity", "unique_ratio_sim", "missing_ratio_sim", "numeric_ratio_sim", "avg_len_ratio_sim", "value_jaccard", "value_containment_max"),
    "union_table_search": ("col_overlap_a2b_mean", "col_overlap_b2a_mean", "col_overlap_a2b_cov", "col_overlap_b2a_cov", "header_jaccard", "col_count_ratio", "row_count_ratio"),
}
#: Groups of atoms by name, and what a task uses if nothing is asked for.
GROUPS: dict[str, dict[str, tuple[str, ...]]] = {
    "joinable_table_search": {"jaccard_containment": ("jaccard", "containment_max"), "value_distribution": ("value_distribution",), "overlap_coverage": ("coverage_a", "coverage_b", "coverage_max"), "value_profile": ("unique_ratio_sim", "numeric_ratio_sim", "avg_len_ratio_sim"), "header_similarity": ("header_token_jaccard", "header_edit_similarity")},
    "entity_matching": {"embedding_similarity": ("row_emb_cosine", "row_emb_l1_sim"), "row_value_overlap": ("row_value_jaccard", "row_value_containment_max", "row_token_jaccard"), "row_profile": ("row_nonempty_ratio", "row_numeric_ratio_sim", "row_avg_len_ratio"), "serial_value_alignment": ("row_serial_token_jaccard", "row_serial_edit_similarity", "row_numeric_value_overlap"), "ditto_proxy": ("row_serial_token_jaccard", "row_serial_edit_similarity", "row_numeric_value_overlap"), "serial_lexical_plus": ("row_serial_char3_jaccard", "row_serial_char4_jaccard", "row_token_idf_jaccard", "row_numeric_rel_diff_sim"), "header_alignment": ("row_header_jaccard", "row_header_value_exact_ratio", "row_header_token_jaccard")},
    "schema_matching": {"header_similarity": ("header_token_jaccard", "header_edit_similarity"), "value_stats": ("unique_ratio_sim", "missing_ratio_sim", "numeric_ratio_sim", "avg_len_ratio_sim"), "value_overlap": ("value_jaccard", "value_containment_max")},
    "union_table_search": {"column_overlap": ("col_overlap_a2b_mean", "col_overlap_b2a_mean", "col_overlap_a2b_cov", "col_overlap_b2a_cov"), "header_jaccard": ("header_jaccard",), "table_size_ratio": ("col_count_ratio", "row_count_ratio")},
}
DEFAULTS = {
    "entity_matching": ("embedding_similarity", "row_value_overlap", "row_profile"),
    "joinable_table_search": ("jaccard_containment", "value_distribution", "overlap_coverage", "value_profile", "header_similarity"),
    "union_table_search": ("column_overlap", "header_jaccard", "table_size_ratio"),
    "schema_matching": ("header_similarity", "value_stats", "value_overlap"),
}
#: A column counts as covered from this overlap on.
COVERED = 0.1


def resolve(task: str, tokens: list[str], groups: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """Atom names for tokens, each an atom or a group of them; the task's defaults for none.

    In entity matching the caller's order and repeats stay; elsewhere atoms come
    once, in their own order.
    """
    if task not in ATOMS:
        raise ValueError(f"unknown task: {task}")
    out: list[str] = []
    groups = GROUPS[task] | (groups or {})
    for token in tokens or DEFAULTS[task]:
        if token in ATOMS[task]:
            out.append(token)
        elif token in groups:
            out += groups[token]
        else:
            raise ValueError(f"unknown feature: {token}")
    return out if task == "entity_matching" else [a for a in ATOMS[task] if a in out]


def keep_places(task: str, source: list[str], asked: list[str]) -> list[int]:
    """Where in ``source`` the atoms asked for stand; one asked for twice takes its first two places. ``none`` and blanks ask for nothing."""
    asked = [t.strip() for t in asked if t.strip() not in ("", "none")]
    free: dict[str, list[int]] = {}
    for i, name in enumerate(source):
        free.setdefault(name, []).append(i)
    wanted, out = resolve(task, asked) if asked else [], []
    for atom in wanted:
        if not free.get(atom):
            raise ValueError(f"{atom} is asked for more often than the source has it: {source}")
        out.append(free[atom].pop(0))
    return out


def keep(rows: DataFrame, task: str, source: list[str], asked: list[str], column: str = "features") -> DataFrame:
    """Rows whose array of atoms, in the order of ``source``, has only those asked for; none are an empty array."""
    places = keep_places(task, source, asked)
    return rows.withColumn(column, F.array(*[F.col(column)[i] for i in places]) if places else F.array().cast("array<double>"))


def _letters(text: str) -> Column:
    """What n-grams of a serial text are made of."""
    return F.lower(F.trim(text))


def _long_edit() -> Column:
    """Jaccard of the raw 3-grams of serial texts; null where they are those of ``_letters``, which are counted for many pairs at once."""
    raw = T.set_jaccard(T.raw_ngrams("pa.serial_text", 3), T.raw_ngrams("pb.serial_text", 3))
    plain = [F.col(c) == _letters(c) for c in ("pa.serial_text", "pb.serial_text")]
    return F.when(~(plain[0] & plain[1]), raw)


def canonical(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(a, b) with the smaller id first, each pair once."""
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _sides(pairs: DataFrame, profiles: DataFrame, parts: int | None = None) -> DataFrame:
    """Pairs with both profiles; dealt by id into so many ``parts``, if that is given."""
    side = lambda s: profiles.select(F.col("id").alias(s), F.struct(*[c for c in profiles.columns if c != "id"]).alias(f"p{s}"))
    if not parts:
        return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    for s in "ab":
        pairs = pairs.repartition(parts, s).join(side(s).repartition(parts, s).hint("merge"), s, "left")
    return pairs


def meet(pairs: DataFrame, values: DataFrame, keys: list[str], most: int = MOST_IDS, salts: int = SALTS) -> DataFrame:
    """(a, b, one_*, two_*, shared): how many values parts of ``a`` and ``b`` have in common, for the given pairs.

    ``values`` has id, v and the ``keys`` that tell parts of an id (columns of a table) apart.
    Values that one id only has can't meet and go first. A value of up to ``most`` ids
    then meets itself, and what isn't a pair asked for is left out; so a column is not
    repeated for each of its pairs, and no task sees more than ``most`` ids times its
    parts of a value. Values of more ids are frequent, so few: they are listed for each
    pair, in ``salts`` parts of an id, and looked up on the other side.
    """
    asked = pairs.select("a", "b").distinct()
    named = asked.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = written(values.select("id", *keys, "v").join(F.broadcast(named), "id", "left_semi"), "named")
    n = parts(rows)
    # Dealt by value into parts that don't grow with the values; what follows up to the join needs no other shuffle.
    rows = rows.repartition(n, "v").distinct()
    counts = (rows.select("id", "v").distinct() if keys else rows).groupBy("v").agg(F.count(F.lit(1)).alias("ids")).where("ids > 1")
    rows = written(rows.join(counts.hint("merge"), "v"), "values").repartition(n, "v")
    side = lambda df, name, tag: df.select(F.col("id").alias(name), *[F.col(k).alias(f"{tag}_{k}") for k in keys], "v")
    of = ["a", "b", *[f"{tag}_{k}" for tag in ("one", "two") for k in keys]]
    few, many = rows.where(F.col("ids") <= most), rows.where(F.col("ids") > most)
    light = side(few, "a", "one").join(side(few, "b", "two"), "v").where("a <> b").join(F.broadcast(asked), ["a", "b"]).select(*of)
    salted = side(many, "a", "one").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    spread = asked.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    heavy = spread.join(salted, ["a", "salt"]).join(side(many, "b", "two"), ["b", "v"]).where("a <> b").select(*of)
    return light.unionByName(heavy).groupBy(*of).agg(F.count(F.lit(1)).alias("shared"))


def shared_values(pairs: DataFrame, values: DataFrame, most: int = MOST_IDS, salts: int = SALTS) -> DataFrame:
    """(a, b, shared): how many of ``values`` (id, v) both sides of a pair have; pairs without any are absent."""
    return meet(pairs, values, [], most, salts)


def _known(atoms: dict[str, Column], wanted: list[str]) -> list[Column]:
    known = F.col("pa").isNotNull() & F.col("pb").isNotNull()
    return [F.when(known, atoms[n]).otherwise(0.0).alias(n) for n in wanted]


def _column_atoms() -> dict[str, Column]:
    both, n_a, n_b = F.coalesce("shared", F.lit(0)), F.col("pa.n_distinct"), F.col("pb.n_distinct")
    return {
        "jaccard": T.ratio(both, n_a + n_b - both), "value_jaccard": T.ratio(both, n_a + n_b - both),
        "containment_max": T.containment_max(both, n_a, n_b), "value_containment_max": T.containment_max(both, n_a, n_b),
        "coverage_a": T.ratio(both, n_a), "coverage_b": T.ratio(both, n_b), "coverage_max": T.containment_max(both, n_a, n_b),
        "value_distribution": T.js_similarity("pa.header_tokens", "pb.header_tokens"),
        "unique_ratio_sim": T.safe_ratio("pa.unique_ratio", "pb.unique_ratio"),
        "numeric_ratio_sim": T.closeness("pa.numeric_ratio", "pb.numeric_ratio"),
        "avg_len_ratio_sim": T.safe_ratio("pa.avg_len", "pb.avg_len"),
        "header_token_jaccard": T.jaccard("pa.header_tokens", "pb.header_tokens"),
        "header_edit_similarity": T.edit_similarity("pa.header_text", "pb.header_text"),
    }


def _column_pairs(task: str, pairs: DataFrame, profiles: DataFrame, values: DataFrame, tokens: list[str] | None, atoms: dict[str, Column]) -> DataFrame:
    wanted, rows = resolve(task, tokens or list(ATOMS[task])), _sides(pairs, profiles)
    if {"jaccard", "value_jaccard", "containment_max", "value_containment_max", "coverage_a", "coverage_b", "coverage_max"} & set(wanted):
        rows = rows.join(shared_values(pairs, values), ["a", "b"], "left")
    return rows.select("a", "b", *_known(atoms, wanted))


def joinable(pairs: DataFrame, profiles: DataFrame, values: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Joinability of column pairs. ``profiles``: join_columns with ``id``; ``values``: (id, v)."""
    return _column_pairs("joinable_table_search", pairs, profiles, values, tokens, _column_atoms())


def schema(pairs: DataFrame, profiles: DataFrame, values: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Correspondence of columns. ``profiles``: schema_columns with ``id``."""
    return _column_pairs("schema_matching", pairs, profiles, values, tokens, _column_atoms() | {"missing_ratio_sim": T.closeness("pa.missing_ratio", "pb.missing_ratio")})


def entity(pairs: DataFrame, profiles: DataFrame, weights: DataFrame | None = None, embeddings: DataFrame | None = None, tokens: list[str] | None = None) -> DataFrame:
    """Sameness of rows. ``profiles``: entity_rows with ``id``; ``weights``: (token, idf), 1 where a token is absent; ``embeddings``: (id, embedding). Every profile is made, so leave out rows that no pair names."""
    wanted = resolve("entity_matching", tokens or list(ATOMS["entity_matching"]))
    pairs = written(pairs, "pairs")
    if embeddings is not None:
        profiles = profiles.join(embeddings.select("id", "embedding"), "id", "left")
    else:
        profiles = profiles.withColumn("embedding", F.lit(None).cast("array<float>"))
    profiles = written(profiles, "profiles")
    n = parts(profiles, pairs, rows=PROFILE_ROWS)
    if weights is not None and "row_token_idf_jaccard" in wanted:
        own = profiles.select("id", F.posexplode("token_set").alias("at", "token")).join(weights.select("token", "idf"), "token", "left")
        own = own.repartition(n, "id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("idf", F.lit(1.0)).alias("weight"), "token"))).alias("weights"))
        profiles = profiles.repartition(n, "id").join(own.hint("merge"), "id", "left")
    else:
        profiles = profiles.withColumn("weights", F.transform("token_set", lambda t, i: F.struct(i.alias("at"), F.lit(1.0).alias("weight"), t.alias("token"))))
    rows = _sides(pairs, profiles, n)
    shared = lambda c: T.size0(F.array_intersect(f"pa.{c}", f"pb.{c}"))
    # What more than one atom reads is made once for a pair.
    rows = rows.withColumns({"values": shared("value_set"), "numbers": shared("numeric_value_set"), "headers": F.array_intersect(F.map_keys("pa.header_to_value"), F.map_keys("pb.header_to_value"))})
    both, headers = F.col("values"), F.col("headers")
    same = F.filter(headers, lambda h: F.col("pa.header_to_value")[h] == F.col("pb.header_to_value")[h])
    atoms = {
        "row_emb_cosine": T.cosine("pa.embedding", "pb.embedding"), "row_emb_l1_sim": T.l1_similarity("pa.embedding", "pb.embedding"),
        "row_value_jaccard": T.ratio(both, T.size0("pa.value_set") + T.size0("pb.value_set") - both),
        "row_value_containment_max": T.containment_max(both, T.size0("pa.value_set"), T.size0("pb.value_set")),
        "row_token_jaccard": T.set_jaccard("pa.token_set", "pb.token_set"),
        "row_nonempty_ratio": T.safe_ratio("pa.nonempty_count", "pb.nonempty_count"),
        "row_numeric_ratio_sim": T.closeness("pa.numeric_ratio", "pb.numeric_ratio"),
        "row_avg_len_ratio": T.safe_ratio("pa.avg_len", "pb.avg_len"),
        "row_serial_token_jaccard": T.set_jaccard("pa.serial_token_set", "pb.serial_token_set"),
        "row_serial_edit_similarity": T.edit_similarity("pa.serial_text", "pb.serial_text", _long_edit()),
        "row_numeric_value_overlap": T.containment_max(F.col("numbers"), T.size0("pa.numeric_value_set"), T.size0("pb.numeric_value_set")),
        "row_token_idf_jaccard": T.weighted_jaccard("pa.token_set", "pb.token_set", "pa.weights", "pb.weights"),
        "row_numeric_rel_diff_sim": T.relative_closeness("pa.numeric_median", "pb.numeric_median"),
        "row_header_jaccard": T.set_jaccard("pa.header_token_set", "pb.header_token_set"),
        "row_header_value_exact_ratio": T.ratio(T.size0(same), T.size0(headers)),
        "row_header_token_jaccard": T.set_jaccard("pa.header_value_token_set", "pb.header_value_token_set"),
    }
    of_grams = {"row_serial_char3_jaccard": F.col("grams.char3"), "row_serial_char4_jaccard": F.col("grams.char4"), "row_serial_edit_similarity": F.coalesce("row_serial_edit_similarity", "grams.char3")}
    if not of_grams.keys() & set(wanted):
        return rows.select("a", "b", *_known(atoms, wanted))
    letters = [F.when(F.col("pa").isNotNull() & F.col("pb").isNotNull(), _letters(f"p{s}.serial_text")).alias(f"letters_{s}") for s in "ab"]
    rows = rows.select("a", "b", *letters, *_known(atoms, [n for n in dict.fromkeys(wanted) if n in atoms]))
    return rows.withColumn("grams", grams.shared("letters_a", "letters_b")).select("a", "b", *[of_grams.get(n, F.col(n)).alias(n) for n in wanted])


def best_columns(pairs: DataFrame, values: DataFrame, columns: DataFrame) -> DataFrame:
    """(a, b, side, col_idx, best): for each column of either table, the best overlap with one of the other's.

    ``values``: (id, col_idx, v); ``columns``: (id, col_idx) of all columns. Column
    pairs that share no value are never made.
    """
    sizes = columns.join(values.groupBy("id", "col_idx").agg(F.count(F.lit(1)).alias("n")), ["id", "col_idx"], "left").fillna(0, subset=["n"])
    shared = meet(pairs, values, ["col_idx"]).select("a", "b", F.col("one_col_idx").alias("i"), F.col("two_col_idx").alias("j"), F.col("shared").alias("both"))
    n_a = sizes.select(F.col("id").alias("a"), F.col("col_idx").alias("i"), F.col("n").alias("n_a"))
    n_b = sizes.select(F.col("id").alias("b"), F.col("col_idx").alias("j"), F.col("n").alias("n_b"))
    scored = shared.join(n_a, ["a", "i"]).join(n_b, ["b", "j"]).withColumn("s", T.overlap_score(F.col("both"), F.col("n_a"), F.col("n_b")))
    found = scored.select("a", "b", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("i").alias("col_idx"), "s"), F.struct(F.lit("b").alias("side"), F.col("j").alias("col_idx"), "s"))).alias("x"))
    best = found.groupBy("a", "b", "x.side", "x.col_idx").agg(F.max("x.s").alias("best"))
    every = pairs.select("a", "b", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("id")), F.struct(F.lit("b").alias("side"), F.col("b").alias("id")))).alias("x")).select("a", "b", "x.*")
    return every.join(columns, "id").join(best, ["a", "b", "side", "col_idx"], "left").select("a", "b", "side", "col_idx", F.coalesce("best", F.lit(0.0)).alias("best"))


def union(pairs: DataFrame, profiles: DataFrame, values: DataFrame, columns: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Unionability of tables. ``profiles``: union_tables with ``id``."""
    wanted = resolve("union_table_search", tokens or list(ATOMS["union_table_search"]))
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col("best")))
    covered = lambda s: F.avg(F.when(F.col("side") == s, (F.col("best") >= COVERED).cast("double")))
    by = best_columns(pairs, values, columns).groupBy("a", "b").agg(mean("a").alias("ma"), mean("b").alias("mb"), covered("a").alias("ca"), covered("b").alias("cb"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    atoms = {
        "col_overlap_a2b_mean": zero("ma"), "col_overlap_b2a_mean": zero("mb"), "col_overlap_a2b_cov": zero("ca"), "col_overlap_b2a_cov": zero("cb"),
        "header_jaccard": T.jaccard("pa.header_tokens", "pb.header_tokens"),
        "col_count_ratio": T.safe_ratio("pa.n_cols", "pb.n_cols"), "row_count_ratio": T.safe_ratio("pa.n_rows", "pb.n_rows"),
    }
    return _sides(pairs, profiles).join(by, ["a", "b"], "left").select("a", "b", *_known(atoms, wanted))


def evidence(scored: DataFrame, score: str = "s_prior", src_degree: str = "src_degree", dst_degree: str = "dst_degree") -> DataFrame:
    """Adds what rules read besides atoms: uncertainty, degree ratio, and those derived from atoms that are there."""
    s, d, e, has = F.col(score), F.col(src_degree), F.col(dst_degree), set(scored.columns)
    out = {"uncertainty": 1 - 2 * F.abs(s - 0.5), "degree_ratio": F.when(F.greatest(d, e) > 0, F.least(d, e) / F.when(F.greatest(d, e) > 0, F.greatest(d, e))).otherwise(0.0)}
    two = {"overlap_mean_max": ("col_overlap_a2b_mean", "col_overlap_b2a_mean", F.greatest), "overlap_cov_max": ("col_overlap_a2b_cov", "col_overlap_b2a_cov", F.greatest), "size_balance": ("col_count_ratio", "row_count_ratio", F.least), "overlap_direction_gap": ("col_overlap_a2b_mean", "col_overlap_b2a_mean", lambda x, y: F.abs(F.col(x) - F.col(y))), "coverage_max": ("coverage_a", "coverage_b", F.greatest)}
    out |= {n: f(x, y) for n, (x, y, f) in two.items() if {x, y} <= has and n not in has}
    return scored.withColumns(out)
