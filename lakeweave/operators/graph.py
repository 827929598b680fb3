"""Graph operators over edge tables: expansion, degrees, negatives, sampling, pooling, attention."""

from __future__ import annotations

from itertools import combinations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import Window as W

from ..sources.shared import parts, written

#: Edge types and their ids; the last four are tasks, which never carry messages.
EDGE_TYPES = ("token_cell", "cell_row", "cell_column", "row_table", "column_table", "entity_matching", "joinable_table_search", "schema_matching", "union_table_search")
TASKS = EDGE_TYPES[5:]


def keep(edges: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """Positive training edges whose type isn't in ``without``."""
    return edges.where((F.col("label") == 1) & ~F.col("validate") & ~F.col("test") & ~F.col("edge_type").isin(*(without or ("",))))


def pairs(edges: DataFrame, first_two: tuple[str, ...] = ("joinable_table_search",)) -> DataFrame:
    """(edge_id, k, u, v, …) for each two nodes of an edge, in order; types in ``first_two`` give their first two nodes only."""
    n = F.size("nodes")
    every = F.array(*[F.struct(F.lit(k).alias("k"), F.try_element_at("nodes", F.lit(i + 1)).alias("u"), F.try_element_at("nodes", F.lit(j + 1)).alias("v")) for k, (i, j) in enumerate(combinations(range(4), 2))])
    fits = F.filter(every, lambda p: p["v"].isNotNull() & p["u"].isNotNull() & ((p["k"] == 0) | ~F.col("edge_type").isin(*first_two)))
    rest = [c for c in edges.columns if c != "nodes"]
    return edges.where(n >= 2).select(*rest, F.explode(fits).alias("p")).select(*rest, "p.k", "p.u", "p.v")


def message_graph(edges: DataFrame, cells: bool = True) -> DataFrame:
    """(src, dst, type_id) of all edges that carry messages, one way."""
    out = TASKS + ("token_cell",) + (() if cells else ("cell_row", "cell_column"))
    ids = F.create_map(*[F.lit(x) for i, t in enumerate(EDGE_TYPES) for x in (t, i)])
    return pairs(keep(edges, out)).select(F.col("u").alias("src"), F.col("v").alias("dst"), ids[F.col("edge_type")].alias("type_id"))


def without_types(graph: DataFrame, types: list[int]) -> DataFrame:
    return graph.where(~F.col("type_id").isin(*types)) if types else graph


def append(graph: DataFrame, new: DataFrame, undirected: bool = True, distinct: bool = True) -> DataFrame:
    """Edges added to a graph (src, dst, type_id), both ways if undirected; without repeats of itself or the graph."""
    return graph.select("src", "dst", "type_id").unionByName(added(graph, new, undirected, distinct))


def added(graph: DataFrame, new: DataFrame, undirected: bool = True, distinct: bool = True) -> DataFrame:
    """The edges that ``append`` adds; how many there are is their count."""
    both = new.unionByName(new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type_id")) if undirected else new
    both = both.select("src", "dst", "type_id")
    return both.distinct().join(graph, ["src", "dst", "type_id"], "left_anti") if distinct else both


def nodes_of_kind(graph: DataFrame, kind: str) -> DataFrame:
    """(node): the nodes of a kind, by the typed edges (src, dst, type_id) that lead to tables.

    Rows and columns are those edges' sources, once for each edge; tables are their targets,
    once each.
    """
    ids = {name: i for i, name in enumerate(EDGE_TYPES)}
    of = {"row": ("src", ("row_table",)), "column": ("src", ("column_table",)), "table": ("dst", ("row_table", "column_table"))}
    if kind not in of:
        raise ValueError(f"unknown kind: {kind}")
    end, types = of[kind]
    found = graph.where(F.col("type_id").isin([ids[t] for t in types])).select(F.col(end).alias("node"))
    return found.distinct() if kind == "table" else found


def without_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (u, v) of two nodes that no edge (src, dst) joins, in either direction."""
    one = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    either = one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
    n = parts(pairs, either)
    return pairs.where("u <> v").repartition(n, "u", "v").join(either.repartition(n, "u", "v"), ["u", "v"], "left_anti")


def degrees(graph: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, degree): ends of edges at each node, a loop counting twice; with ``nodes`` those without any too."""
    ends = graph.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node").join(ends, "node", "left").fillna(0, subset=["degree"]) if nodes is not None else ends


def ranked(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """(node, i): distinct nodes numbered from 0 in hash order.

    Ranks are made in two steps, so no task sees all nodes: nodes are counted per
    bucket of the hash, ranked within it, and buckets are added up.
    """
    h = nodes.select("node").distinct().select("node", F.xxhash64(F.lit(seed), "node").alias("h")).withColumn("b", F.shiftright("h", 48))
    sizes = h.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return h.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy("h", "node")) - 1).join(F.broadcast(sizes), "b").select("node", (F.col("r") + F.col("base")).alias("i"))  # 65,536 sizes


def cycle_pairs(nodes: DataFrame, shift: int = 1, seed: int = 0) -> DataFrame:
    """(u, v): each node with the one ``shift`` places on, in hash order, round the end."""
    own = ranked(nodes, seed)
    n = own.count()
    other = own.select(F.col("node").alias("v"), F.pmod(F.col("i") - shift, F.lit(max(n, 1))).alias("i"))
    return own.join(other, "i").select(F.col("node").alias("u"), "v")


def sample_cycle_pairs(nodes: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """(u, v), ``most`` of them: round after round each node with one further on, in another order each round; the last round as far as needed."""
    n = nodes.select("node").distinct().count()
    if n < 2:
        raise ValueError("pairs need two nodes")
    rounds, out = -(-most // n), None
    for k in range(rounds):
        own = ranked(nodes, seed + k)
        if k == rounds - 1:
            part = own.where(F.col("i") < most - k * n)
        else:
            part = own
        shift = k % (n - 1) + 1
        other = own.select(F.col("node").alias("v"), F.pmod(F.col("i") + shift, F.lit(n)).alias("i"))
        made = part.join(other, "i").select(F.col("node").alias("u"), "v")
        out = made if out is None else out.unionByName(made)
    return out if out is not None else nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)


def negatives(nodes: DataFrame, edges: DataFrame, per_node: int = 1, seed: int = 0, rounds: int = 6) -> DataFrame:
    """(u, v): ``per_node`` other nodes for each node, none of them twice or at an edge with it in either direction.

    A node with fewer such nodes gets all it has. In each round every node that lacks
    some is offered as many nodes as it lacks, each some drawn places on in hash order; what is an
    edge or chosen already goes. After the rounds only nodes with edges to a large part of
    all others are left; what they lack comes from the list of all nodes, which is about
    as long as their list of edges.
    """
    places = written(ranked(nodes, seed), "places")
    n = places.count()
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    known = written(both.union(both.select("v", "u")).where("u <> v").distinct(), "known")
    lacking = places.select(F.col("node").alias("u"), "i", F.lit(per_node).alias("lacks"))
    chosen, step = None, lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "u", "at"), F.lit(max(n - 1, 1))) + 1
    for k in range(rounds if n > 1 else 0):
        offered = lacking.select("u", "i", F.explode(F.sequence(F.lit(1), F.col("lacks"))).alias("at")).withColumn("j", F.pmod(F.col("i") + step(k), F.lit(n)))
        made = offered.join(places.select(F.col("node").alias("v"), F.col("i").alias("j")), "j").select("u", "v").distinct().join(known, ["u", "v"], "left_anti")
        made = made if chosen is None else made.join(chosen, ["u", "v"], "left_anti")
        chosen = written(made if chosen is None else chosen.union(made), "negatives")
        have = chosen.groupBy("u").agg(F.count(F.lit(1)).alias("have"))
        lacking = written(places.withColumnRenamed("node", "u").join(have, "u", "left").select("u", "i", (F.lit(per_node) - F.coalesce("have", F.lit(0))).cast("int").alias("lacks")).where("lacks > 0"), "lacking")
        if lacking.isEmpty():
            return chosen
    if chosen is None:
        return nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    steps = 64
    rest = lacking.select("u", "lacks", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("part")).join(places.select(F.col("node").alias("v"), F.pmod("i", F.lit(steps)).cast("int").alias("part")), "part").where("u <> v")
    rest = rest.join(known, ["u", "v"], "left_anti").join(chosen, ["u", "v"], "left_anti").withColumn("h", F.xxhash64(F.lit(seed), "u", "v"))
    cut = lambda df, by: df.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("h", "v"))).where("r <= lacks")
    return chosen.union(cut(cut(rest, ("u", "part")), ("u",)).select("u", "v"))


def with_negatives(labelled: DataFrame, extra: DataFrame) -> DataFrame:
    """(u, v, label) with ``extra`` (u, v) as label 0; repeats stay."""
    return labelled.select("u", "v", "label").unionByName(extra.select("u", "v", F.lit(0).alias("label")))


def sample_neighbours(graph: DataFrame, seeds: DataFrame, fanouts: tuple[int, ...] = (10, 5), seed: int = 0) -> DataFrame:
    """(hop, dst, src): up to ``fanouts[hop]`` incoming neighbours of each node, hop by hop, by hash order.

    Edges are dealt by node into as many parts as their number asks for; a node's are cut down in 64 parts first.
    """
    n = parts(graph)
    out, frontier = None, seeds.select(F.col("node").alias("dst")).distinct()
    for hop, fanout in enumerate(fanouts):
        near = graph.select("src", "dst").repartition(n, "dst").join(frontier.repartition(n, "dst"), "dst").distinct().withColumn("part", F.pmod(F.xxhash64("src"), F.lit(64)))
        pick = lambda df, by: df.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("h", "src"))).where(F.col("r") <= fanout)
        near = near.withColumn("h", F.xxhash64(F.lit(seed + hop), "src", "dst"))
        got = pick(pick(near, ("dst", "part")), ("dst",)).select(F.lit(hop).alias("hop"), "dst", "src")
        out = got if out is None else out.unionByName(got)
        frontier = got.select(F.col("src").alias("dst")).distinct()
    return out


def pool(graph: DataFrame, vectors: DataFrame, alpha: float = 0.0) -> DataFrame:
    """(node, embedding): the mean of incoming neighbours' vectors, mixed with a node's own by ``alpha``.

    Nodes without neighbours keep theirs. Sums are made element by element, with
    partial sums before the shuffle.
    """
    parts = graph.select("src", F.col("dst").alias("node")).join(vectors.select(F.col("node").alias("src"), F.posexplode("embedding").alias("pos", "x")), "src")
    means = parts.groupBy("node", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"))
    own = F.transform("embedding", lambda x: x.cast("double"))
    mixed = F.when(F.col("mean").isNull(), own).when(F.lit(alpha == 0.0), F.col("mean")).otherwise(F.zip_with(own, "mean", lambda a, b: alpha * a + (1 - alpha) * b))
    return vectors.join(means, "node", "left").select("node", mixed.alias("embedding"))


def overlay(vectors: DataFrame, replaced: DataFrame) -> DataFrame:
    """Vectors with those of ``replaced`` in their place."""
    new = replaced.select("node", F.col("embedding").alias("new"))
    return vectors.join(new, "node", "left").select("node", F.coalesce("new", "embedding").alias("embedding"))


def softmax(scores: DataFrame, group: str = "dst", score: str = "score") -> DataFrame:
    """Adds ``weight``: the softmax of scores among edges with the same end, by combining aggregates."""
    top = scores.groupBy(group).agg(F.max(score).alias("__top"))
    e = scores.join(top, group).withColumn("__e", F.exp(F.col(score) - F.col("__top")))
    total = e.groupBy(group).agg(F.sum("__e").alias("__sum"))
    return e.join(total, group).withColumn("weight", F.col("__e") / F.col("__sum")).drop("__top", "__e", "__sum")


def attend(graph: DataFrame, query: DataFrame, key: DataFrame, value: DataFrame, scale: float) -> DataFrame:
    """(node, pos, x): values of incoming neighbours, weighted by the softmax of scaled query-key products."""
    from ..functions.text import _dot

    q, k = query.select(F.col("node").alias("dst"), F.col("embedding").alias("q")), key.select(F.col("node").alias("src"), F.col("embedding").alias("k"))
    scored = graph.select("src", "dst").join(q, "dst").join(k, "src").select("src", "dst", (_dot(F.col("q"), F.col("k")) / scale).alias("score"))
    weighted = softmax(scored).join(value.select(F.col("node").alias("src"), F.posexplode("embedding").alias("pos", "x")), "src")
    return weighted.groupBy(F.col("dst").alias("node"), "pos").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))


def adjacency(graph: DataFrame) -> DataFrame:
    """(src, dst, value): a sparse matrix of ones."""
    return graph.select("src", "dst").distinct().withColumn("value", F.lit(1.0))


def identity(spark, n: int) -> DataFrame:
    """(node, index) for a graph whose nodes are numbered already."""
    return spark.range(n).select(F.col("id").alias("node"), F.col("id").alias("index"))


def cap_edges(edges: DataFrame, most: int, seed: int = 0, id_col: str = "edge_id") -> DataFrame:
    """At most ``most`` edges for a trial run: the first by hash, in the order of their ids."""
    return edges.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(most).orderBy(id_col)


def convolve(graph: DataFrame, vectors: DataFrame, kind: str = "sage") -> DataFrame:
    """(node, pos, x): one step of neighbour aggregation.

    ``sage`` takes the mean of incoming neighbours; ``gcn`` adds loops and weighs
    each edge by one over the root of both ends' numbers of incoming edges.
    """
    if kind == "sage":
        return pool(graph, vectors).select("node", F.posexplode("embedding").alias("pos", "x"))
    if kind != "gcn":
        raise ValueError(f"unknown kind: {kind}")
    edges = graph.select("src", "dst").unionByName(vectors.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    weighed = edges.join(into, "dst").join(into.select(F.col("dst").alias("src"), F.col("n").alias("m")), "src")
    parts = weighed.join(vectors.select(F.col("node").alias("src"), F.posexplode("embedding").alias("pos", "x")), "src")
    return parts.groupBy(F.col("dst").alias("node"), "pos").agg(F.sum(F.col("x") / F.sqrt(F.col("n") * F.col("m"))).alias("x"))


def edge_statistics(edges: DataFrame) -> DataFrame:
    """(edge_type, split, n): how many edges of each type each split has."""
    split = F.when(F.col("test"), "test").when(F.col("validate"), "validate").when(F.col("train"), "train").otherwise("none")
    return edges.groupBy("edge_type", split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


def splits(raw: str) -> list[str]:
    """The names of splits in a comma-separated list; others raise."""
    found = [s.strip() for s in raw.split(",") if s.strip()]
    if bad := [s for s in found if s not in ("train", "val", "test")]:
        raise ValueError(f"unknown splits: {bad}")
    return list(dict.fromkeys(found))
