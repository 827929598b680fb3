"""What a spec is asked for: roles and number of its channels, families and groups of features."""

from __future__ import annotations

from collections.abc import Iterable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..operators.atoms import GROUPS

#: Example roles of a task's channels, in order.
ROLES = {
    "entity_matching": ("serial_lexical", "value_overlap", "profile_consistency", "numeric_alignment", "robustness", "boundary_guard", "calibration", "hard_negative_guard"),
    "joinable_table_search": ("containment_core", "coverage_balance", "coverage_direction", "distribution_profile", "header_semantic", "robustness", "noise_guard", "calibration"),
    "union_table_search": ("overlap_a2b", "overlap_b2a", "overlap_coverage", "header_alignment", "size_compatibility", "robustness", "noise_guard", "calibration"),
    "schema_matching": ("header_semantic", "value_overlap", "value_containment", "profile_stats", "missingness_guard", "numeric_consistency", "robustness", "calibration"),
}
#: Roles of a task without examples.
OTHER_ROLES = ("signal_core", "supporting_evidence", "robustness", "calibration")
#: Families of atoms and groups by name, where the rules on names below give another one.
FAMILIES = {
    "semantic_embedding": ("embedding_similarity", "row_emb_cosine", "row_emb_l1_sim"),
    "set_overlap_coverage": ("row_value_overlap", "row_value_jaccard", "row_value_containment_max", "row_token_jaccard", "jaccard_containment", "jaccard", "containment_max", "overlap_coverage", "coverage_a", "coverage_b", "coverage_max", "value_overlap", "value_jaccard", "value_containment_max", "column_overlap", "col_overlap_a2b_mean", "col_overlap_b2a_mean", "col_overlap_a2b_cov", "col_overlap_b2a_cov"),
    "profile_statistics": ("row_profile", "row_nonempty_ratio", "row_numeric_ratio_sim", "row_avg_len_ratio"),
    "lexical_serialization": ("serial_value_alignment", "ditto_proxy", "row_serial_token_jaccard", "row_serial_edit_similarity", "row_numeric_value_overlap", "serial_lexical_plus", "row_serial_char3_jaccard", "row_serial_char4_jaccard", "row_token_idf_jaccard", "row_numeric_rel_diff_sim"),
    "schema_header": ("header_alignment", "row_header_jaccard", "row_header_value_exact_ratio", "row_header_token_jaccard", "header_similarity", "header_token_jaccard", "header_edit_similarity", "header_jaccard"),
    "distributional_profile": ("value_distribution", "value_profile", "unique_ratio_sim", "numeric_ratio_sim", "avg_len_ratio_sim", "value_stats", "missing_ratio_sim"),
    "size_scale": ("table_size_ratio", "col_count_ratio", "row_count_ratio"),
}
#: Parts of a name and the family they tell, first match first.
NAMED = (
    ("schema_header", "header"),
    ("set_overlap_coverage", "jaccard|containment|coverage|overlap"),
    ("semantic_embedding", "emb"),
    ("distributional_profile", "profile|distribution|ratio|stats"),
    ("lexical_serialization", "serial|token|edit|lexical"),
    ("size_scale", "count|size"),
)


def channel_roles(task: str, channels: int, given: Iterable[str] = ()) -> list[str]:
    """Roles of ``channels`` channels: those given, which differ and are as many, or examples, padded with numbers."""
    given = [r.strip() for r in given if r.strip()]
    if not given:
        some = ROLES.get(task, OTHER_ROLES)[: max(1, channels)]
        return [*some, *(f"role_{k:02d}" for k in range(1, max(1, channels) - len(some) + 1))]
    if len(given) != channels:
        raise ValueError(f"{channels} roles are expected, not {len(given)}")
    if len({r.lower() for r in given}) < channels:
        raise ValueError(f"a role is given twice: {given}")
    return given


def channel_count(pool: int, exact: int = 0, least: int = 0, roles: int = 0) -> tuple[int, int]:
    """How many channels exactly (0: any number) and at least."""
    exact = exact if exact > 0 else roles
    if exact > 0 and least > exact:
        raise ValueError(f"at least {least} channels cannot be exactly {exact}")
    least = exact if exact > 0 else least if least > 0 else pool
    if least <= 0:
        raise ValueError("no channels")
    return exact, least


def without_hints(doc: dict, task: str) -> dict:
    """A document for entity matching loses its range hints, which would clip; others stay."""
    if task != "entity_matching" or not isinstance(doc, dict):
        return doc
    bare = lambda d: {k: v for k, v in d.items() if k != "output_range_hint"} if isinstance(d, dict) else d
    out = bare(doc)
    return out | {"channels": [bare(c) for c in out["channels"]]} if isinstance(out.get("channels"), list) else out


def family(name: Column | str, told: Column | str | None = None) -> Column:
    """The family of a feature: what its card tells, else by its name, else by parts of its name."""
    key = F.lower(F.trim(F.col(name) if isinstance(name, str) else name))
    out = F.lit("general_similarity")
    for kind, parts in reversed(NAMED):
        out = F.when(key.rlike(parts), kind).otherwise(out)
    for kind, names in FAMILIES.items():
        out = F.when(key.isin(*names), kind).otherwise(out)
    own = F.lower(F.trim(F.col(told) if isinstance(told, str) else told)) if told is not None else F.lit(None).cast("string")
    return F.coalesce(F.nullif(own, F.lit("")), out)


def group_tokens(cards: DataFrame) -> DataFrame:
    """(token, expands_to) of the rows (token, range, formula) that stand for groups.

    A group that is known by name has its atoms, and is none if it stands for itself;
    others are groups if their card says so, by a range or by ``expands_to=[…]``.
    """
    known = {t: atoms for groups in GROUPS.values() for t, atoms in groups.items()}
    table = F.create_map(*[x for t, atoms in sorted(known.items()) for x in (F.lit(t), F.array(*map(F.lit, atoms)))])
    own, formula = table[F.col("token")], F.trim(F.coalesce("formula", F.lit("")))
    inner = F.regexp_extract(formula, r"^expands_to=\[(.*)\]$", 1)
    told = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    says = F.lower(F.coalesce("range", F.lit(""))).contains("group token") | F.lower(formula).startswith("expands_to=")
    rows = cards.withColumn("expands_to", F.when(own.isNotNull(), own).when(says, told))
    return rows.where(F.col("expands_to").isNotNull() & ~(own.isNotNull() & (F.size("expands_to") == 1) & (F.col("expands_to")[0] == F.col("token")))).select("token", "expands_to")
