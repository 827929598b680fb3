"""Text, token, number and set functions as Column expressions: no Python runs per row.

Each mirrors one scalar function of the matching toolkit; sets are arrays without
repeats. ``a`` and ``b`` may be any Column; nulls count as empty.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

#: Cell contents that count as missing.
NULL_LIKE = ("", "nan", "none", "null", "na", "n/a", "unknown", "-", "unknown_cell")
#: Fixed value: what Python's float() takes, for lower-cased trimmed ASCII text.
NUMERIC = r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?$|^[+-]?(inf|infinity|nan)$"
#: Fixed value: parts of a header.
PARTS = "[0-9]+|[^_ /0-9]+"
#: Fixed value: where a camel-case word is cut.
CAMEL = r".+?(?:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|$)"
#: Edit distance is exact up to this length; beyond, 3-grams stand in.
EXACT_EDIT = 128


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(cell: Column | str) -> Column:
    """Lower case, less one trailing ``.0``."""
    return F.regexp_replace(F.lower(_col(cell)), r"\.0$", "")


def is_missing(value: Column | str) -> Column:
    """Whether a normalised, stripped value counts as missing."""
    return F.coalesce(_col(value).isin(*NULL_LIKE), F.lit(True))


def is_numeric(value: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_col(value))).rlike(NUMERIC), F.lit(False))


def as_number(value: Column | str) -> Column:
    """The number that a numeric text stands for; null for any other."""
    text = F.regexp_replace(F.lower(F.trim(_col(value))), "_", "")
    plain = F.regexp_replace(text, r"^\+", "")
    return F.when(is_numeric(value), plain.try_cast("double"))


def is_finite(x: Column | str) -> Column:
    x = _col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def camel_words(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_col(text), F.lit(CAMEL), F.lit(0)), F.lower)


def header_tokens(header: Column | str) -> Column:
    """Words of a header, cut at ``_``, space and ``/``, at digits (which are kept) and in camel case."""
    parts = F.regexp_extract_all(_col(header), F.lit(PARTS), F.lit(0))
    return F.flatten(F.transform(parts, camel_words))


def value_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]+"), F.lit(0))


def row_header_tokens(header: Column | str) -> Column:
    """Header words of a header that was lower-cased before; its value words if there are none."""
    low = F.lower(_col(header))
    # Without capitals a part is one word, unless it has an end of line.
    words = F.when(low.rlike(r"[\n\r\u0085\u2028\u2029]"), header_tokens(low)).otherwise(F.regexp_extract_all(low, F.lit(PARTS), F.lit(0)))
    return F.coalesce(F.get(F.filter(F.array(words), lambda w: F.size(w) > 0), 0), value_tokens(low))


def size0(a: Column | str) -> Column:
    return F.coalesce(F.size(_col(a)), F.lit(0))


def ratio(n: Column, d: Column) -> Column:
    """``n / d``, 0 where ``d`` is 0 or less."""
    return F.when(d > 0, n.cast("double") / F.when(d > 0, d)).otherwise(F.lit(0.0))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two token lists or sets; 0 if either is empty."""
    a, b = F.array_distinct(_col(a)), F.array_distinct(_col(b))
    both = size0(F.array_intersect(a, b))
    return F.when((size0(a) > 0) & (size0(b) > 0), ratio(both, size0(a) + size0(b) - both)).otherwise(0.0)


def containment_max(both: Column, n_a: Column, n_b: Column) -> Column:
    return F.greatest(ratio(both, n_a), ratio(both, n_b))


def overlap_score(both: Column, n_a: Column, n_b: Column) -> Column:
    return F.greatest(ratio(both, n_a + n_b - both), containment_max(both, n_a, n_b))


def numeric_overlap(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return containment_max(size0(F.array_intersect(a, b)), size0(a), size0(b))


def weighted_jaccard(a: Column | str, b: Column | str, weights_a: Column | str, weights_b: Column | str) -> Column:
    """Token sets weighted by arrays of (token, weight) in their order."""
    a, b, of_a, of_b = _col(a), _col(b), _col(weights_a), _col(weights_b)
    total = lambda s, begun: F.aggregate(s, begun, lambda x, t: x + t["weight"])
    both, more = F.filter(of_a, lambda t: F.array_contains(b, t["token"])), F.filter(of_b, lambda t: ~F.array_contains(a, t["token"]))
    sums = F.array(F.struct(total(both, F.lit(0.0)).alias("both"), total(more, total(of_a, F.lit(0.0))).alias("every")))
    return F.when((size0(a) > 0) & (size0(b) > 0), F.transform(sums, lambda s: ratio(s["both"], s["every"]))[0]).otherwise(0.0)


def char_ngrams(text: Column | str, n: int) -> Column:
    """The distinct character n-grams of the trimmed lower-cased text; a short text is its own."""
    t = F.lower(F.trim(_col(text)))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substr(t, i, F.lit(n)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= n, F.array(t)).otherwise(F.array_distinct(grams))


def set_jaccard(a: Column | str, b: Column | str) -> Column:
    """``jaccard`` of arrays that have no repeats."""
    a, b = _col(a), _col(b)
    sizes = F.transform(F.array(F.size(F.array_intersect(a, b))), lambda i: F.when((size0(a) > 0) & (size0(b) > 0), ratio(i, size0(a) + size0(b) - i)).otherwise(0.0))
    return F.coalesce(sizes[0], F.lit(0.0))


def ngram_jaccard(a: Column | str, b: Column | str, n: int) -> Column:
    return set_jaccard(char_ngrams(a, n), char_ngrams(b, n))


def raw_ngrams(text: Column | str, n: int) -> Column:
    """The distinct character n-grams of a text as it stands; a short text is its own."""
    t = _col(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substr(t, i, F.lit(n)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def edit_similarity(a: Column | str, b: Column | str, when_long: Column | None = None) -> Column:
    """1 less the edit distance over the longer length; Jaccard of raw 3-grams (or ``when_long``, if that is known) where one text is long."""
    a, b = F.coalesce(_col(a), F.lit("")), F.coalesce(_col(b), F.lit(""))
    longest = F.greatest(F.length(a), F.length(b))
    exact = F.lit(1.0) - F.levenshtein(a, b) / F.when(longest > 0, longest)
    return F.when(a == b, 1.0).when(F.least(F.length(a), F.length(b)) == 0, 0.0).when(longest > EXACT_EDIT, set_jaccard(raw_ngrams(a, 3), raw_ngrams(b, 3)) if when_long is None else when_long).otherwise(exact)


def js_similarity(a: Column | str, b: Column | str) -> Column:
    """1 less the Jensen-Shannon divergence (natural log) of two token lists; 0 if either is empty.

    Tokens of both are sorted once, so that runs of equal ones are counted in one pass.
    """
    a, b = _col(a), _col(b)
    mark = lambda xs, one: F.transform(xs, lambda t: F.struct(t.alias("t"), F.lit(one).alias("a")))
    runs = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0.0).alias("gap"))
    part = lambda p, m: F.when(p > 0, p * F.log(F.when(p > 0, p / m))).otherwise(0.0)

    def closed(s: Column) -> Column:
        p, q = s["p"] / F.size(a), s["q"] / F.size(b)
        return s["gap"] + part(p, (p + q) / 2) + part(q, (p + q) / 2)

    def step(s: Column, x: Column) -> Column:
        same = x["t"].eqNullSafe(s["t"])
        one, two = F.when(x["a"], 1).otherwise(0), F.when(x["a"], 0).otherwise(1)
        return F.struct(x["t"].alias("t"), F.when(same, s["p"] + one).otherwise(one).alias("p"), F.when(same, s["q"] + two).otherwise(two).alias("q"), F.when(same, s["gap"]).otherwise(closed(s)).alias("gap"))

    gap = F.aggregate(F.sort_array(F.concat(mark(a, True), mark(b, False))), runs, step, closed)
    return F.when((size0(a) > 0) & (size0(b) > 0), F.lit(1.0) - gap / 2).otherwise(0.0)


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """Smaller over larger; 0 unless both are positive."""
    a, b = _col(a), _col(b)
    return F.when((a > 0) & (b > 0), F.least(a, b).cast("double") / F.when((a > 0) & (b > 0), F.greatest(a, b))).otherwise(0.0)


def closeness(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - F.abs(_col(a) - _col(b))


def relative_closeness(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.when(a.isNotNull() & b.isNotNull(), 1 / (1 + F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))).otherwise(0.0)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.coalesce(F.when(norms > 0, _dot(a, b) / F.when(norms > 0, norms)), F.lit(0.0))


def l1_similarity(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(1 / (1 + gap / F.when(F.size(a) > 0, F.size(a))), F.lit(0.0))


def clip01(x: Column | str) -> Column:
    return F.greatest(F.least(_col(x), F.lit(1.0)), F.lit(0.0))


def row_index(x: Column | str) -> Column:
    """A whole number, or one written as a decimal; null for anything else."""
    text = F.trim(_col(x).cast("string"))
    return F.coalesce(text.try_cast("long"), F.floor(text.try_cast("double")).try_cast("long"))


def path_token(x: Column | str, default: str = "item") -> Column:
    """A text made safe as part of a file name."""
    text = F.btrim(F.regexp_replace(_col(x), "[^0-9A-Za-z_.-]+", "_"), F.lit("._-"))
    return F.when(F.coalesce(text, F.lit("")) == "", default).otherwise(text)


def table_key(name: Column | str) -> Column:
    """A table's name without a ``.csv`` ending, by which either spelling is found."""
    return F.regexp_replace(_col(name), r"\.csv$", "")


def mean_std(token: Column | str) -> Column:
    """``mean±std`` as a struct; nulls where the text isn't one."""
    pattern = r"^\s*([0-9]*\.?[0-9]+)\s*±\s*([0-9]*\.?[0-9]+)\s*$"
    part = lambda k: F.nullif(F.regexp_extract(_col(token), pattern, k), F.lit("")).try_cast("double")
    return F.struct(part(1).alias("mean"), part(2).alias("std"))


def json_object(text: Column | str) -> Column:
    """The outermost ``{…}`` of a text, less code fences."""
    return F.nullif(F.regexp_extract(F.regexp_replace(_col(text), r"(?m)^\s*```.*$", ""), r"(?s)\{.*\}", 0), F.lit(""))


def flag_value(command: Column | str, flag: str) -> Column:
    """The word after ``--flag`` in a logged command."""
    return F.nullif(F.regexp_extract(_col(command), rf"--{flag}[ =]([^ ]+)", 1), F.lit(""))


def cost_usd(prompt_tokens: Column | str, completion_tokens: Column | str, prompt_per_1m: float, completion_per_1m: float) -> Column:
    return (_col(prompt_tokens) * prompt_per_1m + _col(completion_tokens) * completion_per_1m) / 1e6


def without_sentences(text: Column | str, words: tuple[str, ...]) -> Column:
    """A text without the sentences that mention any of ``words``."""
    kept = F.filter(F.split(_col(text), r"(?<=[.!?])\s+"), lambda s: ~F.lower(s).rlike("|".join(words)))
    return F.array_join(kept, " ")
