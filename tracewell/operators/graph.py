"""Traversal of the evidence graph: neighbours, callers, callees, bounded search and paths.

Edges are joined by node id; a step of a search is one join of its frontier.
The edges of a hub are spread over tasks (see `skew`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import skew
from tracewell.session import written

NEIGHBOUR_CAP, BFS_DEPTH, BFS_NODES, PATH_DEPTH = 256, 8, 512, 6


def adjacent(edges: DataFrame, node: str, direction: str) -> DataFrame:
    """Edges that leave (`out`) or reach (`in`) a node, by edge id."""
    end = "source" if direction == "out" else "target"
    return edges.where(F.col(end) == node).orderBy("edge_id")


def _hubs(edges: DataFrame, end: str) -> DataFrame | None:
    """Edges per node, of nodes with so many that a join must spread them; None where there are none."""
    counts = written(edges.groupBy(end).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > skew.HOT_ROWS))
    return None if counts.isEmpty() else counts


def _step(edges: DataFrame, end: str, frontier: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """`edges` joined to the rows of a frontier by their `end`; the edges of a hub are spread."""
    if hubs is None:
        return edges.join(frontier, end)
    return skew.skew_join(edges, frontier, [end], F.xxhash64(*edges.columns), counts=hubs)


def neighbourhood(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, cap: int | None = NEIGHBOUR_CAP) -> DataFrame:
    """Edges in both directions of each seed (`node_id`), the first `cap` of each by (edge_id, direction).

    Columns: seed, direction, edge_kind, edge_id, node_id, node_key. None: all,
    without a sort; `degrees` counts all.
    """
    s = seeds.select(F.col("node_id").alias("seed"))
    plain = edges.select("edge_id", "edge_kind", "source", "target")
    out = _step(plain, "source", s.withColumnRenamed("seed", "source"), _hubs(plain, "source")).select(F.col("source").alias("seed"), F.lit("outgoing").alias("direction"), "edge_kind", "edge_id", F.col("target").alias("node_id"))
    into = _step(plain, "target", s.withColumnRenamed("seed", "target"), _hubs(plain, "target")).select(F.col("target").alias("seed"), F.lit("incoming").alias("direction"), "edge_kind", "edge_id", F.col("source").alias("node_id"))
    both = out.unionByName(into).join(nodes.select("node_id", "node_key"), "node_id")
    if cap is None:
        return both
    order = Window.partitionBy("seed").orderBy("edge_id", F.desc("direction"))
    return both.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def relation_dedup(related: DataFrame) -> DataFrame:
    """Drops a relation that equals the one just before it in (node, kind), in canonical order only."""
    order = Window.partitionBy("seed").orderBy("node_key", "direction", "edge_kind", "edge_id")
    same = (F.lag("node_id").over(order) == F.col("node_id")) & (F.lag("edge_kind").over(order) == F.col("edge_kind"))
    return related.withColumn("_same", F.coalesce(same, F.lit(False))).where(~F.col("_same")).drop("_same")


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, n_out, n_in)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.n").alias("node_id")).agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def callers(edges: DataFrame) -> DataFrame:
    """Who may call each declaration: incoming call candidates."""
    return edges.where(F.col("edge_kind") == "call_candidate").select(F.col("target").alias("declaration"), F.col("source").alias("caller"), "candidate_set_id")


def callees(edges: DataFrame) -> DataFrame:
    """What each callable may call: contained calls, then their candidates."""
    holds = edges.where(F.col("edge_kind") == "contains").select(F.col("source").alias("callable"), F.col("target").alias("call"))
    may = edges.where(F.col("edge_kind") == "call_candidate").select(F.col("source").alias("call"), F.col("target").alias("callee"), "candidate_set_id")
    return holds.join(may, "call")


def bounded_search(edges: DataFrame, seeds: DataFrame, depth: int = BFS_DEPTH, cap: int | None = BFS_NODES) -> DataFrame:
    """Nodes reached from each seed and their least distance: (seed, node_id, depth).

    One join a level. `cap` stops a seed's search once it holds so many nodes;
    it is tested before a level is taken, so a level may pass it. None: no cap,
    the exact way.
    """
    hop = edges.select("source", F.col("target").alias("_to"))
    hubs = _hubs(hop, "source")
    reached = written(seeds.select(F.col("node_id").alias("seed"), "node_id", F.lit(0).alias("depth")).distinct())
    frontier = reached
    for level in range(1, depth + 1):
        if cap is not None:
            full = reached.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cap).select("seed")
            frontier = frontier.join(full, "seed", "left_anti")
        step = _step(hop, "source", frontier.select("seed", F.col("node_id").alias("source")), hubs).select("seed", F.col("_to").alias("node_id")).distinct()
        frontier = written(step.join(reached, ["seed", "node_id"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def bounded_trails(edges: DataFrame, starts: DataFrame, depth: int = PATH_DEPTH) -> DataFrame:
    """Trails of up to `depth` edges from each start: (seed, node_id, depth, trail).

    An edge does not repeat within a trail, a node may. Every trail is kept.
    """
    hop = edges.select("edge_id", F.col("source").alias("node_id"), "target")
    hubs = _hubs(hop, "node_id")
    now = starts.select(F.col("node_id").alias("seed"), "node_id", F.array().cast("array<string>").alias("trail"))
    parts = []
    for level in range(1, depth + 1):
        now = written(
            _step(hop, "node_id", now, hubs)
            .where(~F.array_contains("trail", F.col("edge_id")))
            .select("seed", F.col("target").alias("node_id"), F.array_append("trail", F.col("edge_id")).alias("trail"))
        )
        parts.append(now.withColumn("depth", F.lit(level)))
        if now.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paths_between(edges: DataFrame, ends: DataFrame, depth: int = PATH_DEPTH) -> DataFrame:
    """Trails of up to `depth` edges from `seed` to `goal` of each row of `ends`: (seed, goal, depth, trail).

    A trail stops where it first meets its goal; a seed that is its own goal has
    the empty trail. Distances to the goals are found first, so that only trails
    are followed that can still arrive.
    """
    pairs = ends.select("seed", "goal").distinct()
    own = pairs.where("seed = goal").select("seed", "goal", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("trail"))
    pairs = pairs.where("seed <> goal")
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    near = bounded_search(back, pairs.select(F.col("goal").alias("node_id")), depth, None).select(F.col("seed").alias("goal"), "node_id", F.col("depth").alias("_far"))
    near = written(near)
    hop = edges.select("edge_id", F.col("source").alias("node_id"), "target")
    hubs = _hubs(hop, "node_id")
    now = pairs.select("seed", "goal", F.col("seed").alias("node_id"), F.array().cast("array<string>").alias("trail"))
    now = now.join(near.where(F.col("_far") <= depth).select("goal", "node_id"), ["goal", "node_id"])
    out = own
    for level in range(1, depth + 1):
        step = _step(hop, "node_id", now, hubs).where(~F.array_contains("trail", F.col("edge_id")))
        step = step.select("seed", "goal", F.col("target").alias("node_id"), F.array_append("trail", F.col("edge_id")).alias("trail"))
        step = written(step.join(near.where(F.col("_far") <= depth - level).select("goal", "node_id"), ["goal", "node_id"]))
        out = out.unionByName(step.where("node_id = goal").select("seed", "goal", F.lit(level).alias("depth"), "trail"))
        now = step.where("node_id <> goal")
        if now.isEmpty():
            break
    return out


def routes(edges: DataFrame, ends: DataFrame, depth: int = PATH_DEPTH, most: int | None = None, kinds: list[str] | None = None, evidence: str | None = None) -> DataFrame:
    """The routes that a search of both ends reports: `paths_between`, the short ones.

    Routes of the least length come back, and those of each next length as long
    as no length is left out. `most` keeps the first of each pair by length, then by
    edge ids; `kinds` and `evidence` leave other edges out. Adds `rank` (from 1).
    """
    if kinds:
        edges = edges.where(F.col("edge_kind").isin(kinds))
    if evidence:
        edges = edges.where(F.col("evidence_class") == evidence)
    found = written(paths_between(edges, ends, depth))
    pair = Window.partitionBy("seed", "goal")
    lengths = found.select("seed", "goal", "depth").distinct()
    run = lengths.withColumn("_skip", F.col("depth") - F.row_number().over(pair.orderBy("depth"))).withColumn("_least", F.min("_skip").over(pair)).where("_skip = _least")
    kept = found.join(run.select("seed", "goal", "depth"), ["seed", "goal", "depth"])
    ranked = kept.withColumn("rank", F.row_number().over(pair.orderBy("depth", "trail")))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def trail_evidence(trails: DataFrame, edges: DataFrame) -> DataFrame:
    """Per trail: whether it rests on facts only, holds candidates, and its distinct candidate sets."""
    steps = trails.withColumn("trail_id", F.array_join("trail", ">")).select("trail_id", F.explode("trail").alias("edge_id"))
    return steps.join(edges.select("edge_id", "evidence_class", "candidate_set_id"), "edge_id").groupBy("trail_id").agg(
        F.min((F.col("evidence_class") == "fact").cast("int")).alias("fact_only"),
        F.max((F.col("evidence_class") == "candidate").cast("int")).alias("has_candidate"),
        F.countDistinct("candidate_set_id").alias("n_candidate_sets"),
    )


def term_index(nodes: DataFrame, terms) -> DataFrame:
    """Inverted index (term, node_id): declarations and entities by label, files by path, nothing else."""
    text = F.when(F.col("node_kind").isin("declaration", "entity"), F.col("label")).when(F.col("node_kind") == "file", F.col("relative_path"))
    return nodes.select("node_id", F.explode(F.array_distinct(terms(text))).alias("term"))


#: What a node's kind adds to its score. Fixed values.
KIND_PRIOR = {"declaration": 20, "entity": 15, "file": 10, "import": 4, "call": 2}


def ranked_seeds(nodes: DataFrame, query: str, query_terms: list[str], terms, k: int, hits: DataFrame | None = None) -> DataFrame:
    """The `k` best nodes that the term index leads to: (node_id, node_key, score, rank, total).

    `total` counts all hits before the limit; order is by score, then key, then
    id. `hits` (node_id) takes the place of the term index where a target is named.
    """
    wanted = F.array(*[F.lit(t) for t in query_terms]) if query_terms else F.array().cast("array<string>")
    if hits is None:
        hits = term_index(nodes, terms).where(F.col("term").isin(query_terms)).select("node_id").distinct()
    own, at = terms(F.col("label")), terms(F.col("relative_path"))
    n_own = F.size(F.array_intersect(F.array_distinct(own), wanted))
    prior = F.lit(0)
    for kind, value in KIND_PRIOR.items():
        prior = F.when(F.col("node_kind") == kind, value).otherwise(prior)
    score = (
        F.when(F.lower("label") == query.strip().lower(), 1000).otherwise(0)
        + F.when(n_own == len(set(query_terms)), 400).otherwise(0)
        + 100 * n_own
        + 30 * F.coalesce(F.size(F.array_intersect(F.array_distinct(at), wanted)), F.lit(0))
        + prior
    )
    scored = nodes.join(hits, "node_id", "left_semi").select("node_id", "node_key", score.alias("score"), F.lit(1).alias("_one"))
    total = scored.groupBy("_one").agg(F.count(F.lit(1)).alias("total"))
    best = scored.orderBy(F.desc("score"), "node_key", "node_id").limit(k)
    # Only k rows are left to number, and one total to add.
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("_one").orderBy(F.desc("score"), "node_key", "node_id")))
    return ranked.join(F.broadcast(total), "_one").drop("_one")
