"""Graph operators: shared-evidence pairs, degrees, closures, distances, best paths and scores.

Closures are loops over frontiers: each round joins only the vertices that are new, is written to
the checkpoint folder, and ends when a round finds none.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Facets with their weights, in order.
FACETS = (("mechanism", 0.15), ("moderator", 0.20), ("boundary", 0.20), ("measurement", 0.10), ("contradiction", 0.15), ("application", 0.20))
PROPAGATING = ("ABSTRACTS_FROM", "DERIVES_FROM", "HAS_SCOPED_INSTANCE")


#: Has a query's shuffle files deleted when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str = "round") -> str:
    """A new path under ``spark.checkpoint.dir``. Only in local mode, where there are no other machines, may the setting be absent."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "gleanmark-rounds")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of one task, about, where an aggregate holds most of its rows.
TASK_ROWS = 1 << 19


def width(spark: SparkSession, rows: int) -> int:
    """How many tasks so many rows are dealt over, so that a task's memory doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a path of ``scratch`` and read it back, so that rounds don't pile up lineage. The shuffle files of the write go with it."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def undirected(edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
    return a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def coevidence_pairs(supports: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of nodes that evidence supports both of and no edge joins: node_a, node_b, co_count, evidence_ids."""
    s = supports.select("evidence_id", "target_node").distinct()
    pairs = s.alias("a").join(s.alias("b"), "evidence_id").where("a.target_node < b.target_node")
    counted = pairs.groupBy(F.col("a.target_node").alias("node_a"), F.col("b.target_node").alias("node_b")).agg(F.count(F.lit(1)).alias("co_count"), F.array_join(F.sort_array(F.collect_set("evidence_id")), ",").alias("evidence_ids"))
    joined = edges.select(F.least("from_node", "to_node").alias("node_a"), F.greatest("from_node", "to_node").alias("node_b")).distinct()
    return counted.join(joined, ["node_a", "node_b"], "left_anti")


def coactivation_pairs(activations: DataFrame, least: int = 3, most: int = 30) -> DataFrame:
    """Cards activated by the same query in at least ``least`` queries, the most frequent first."""
    a = activations.where("query_id is not null and card_id is not null").select("query_id", "card_id")
    slices = width(a.sparkSession, a.count())
    cards = a.repartition(slices, "query_id").groupBy("query_id").agg(F.collect_set("card_id").alias("cards")).select("cards", F.explode("cards").alias("card_a"))
    pairs = cards.select("card_a", F.explode(F.filter("cards", lambda c: c > F.col("card_a"))).alias("card_b"))
    # Most pairs are rare, so that counting them before the shuffle would hold them all and spare little.
    counted = pairs.repartition(slices, "card_a", "card_b").groupBy("card_a", "card_b").agg(F.count(F.lit(1)).alias("freq"))
    return counted.where(F.col("freq") >= least).orderBy(F.desc("freq"), "card_a", "card_b").limit(most)


def degree(edges: DataFrame) -> DataFrame:
    """Each edge adds one to both of its ends, two for a loop."""
    return edges.select(F.explode(F.array("from_node", "to_node")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def distances(seeds: DataFrame, steps: DataFrame, most: int = 10_000) -> DataFrame:
    """Hops from the nearest of ``seeds`` (id) along ``steps`` (src, dst), for all that can be reached."""
    seen = frontier = stored(seeds.select("id").distinct().withColumn("hops", F.lit(0)))
    parts = [seen]
    for hops in range(1, most):
        fresh = frontier.join(steps, frontier["id"] == steps["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = stored(fresh.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hops)))
        if not frontier.take(1):
            break
        parts.append(frontier)
        if len(parts) > 8:  # one table again, so that a round reads a few and not one for each round before it
            parts = [stored(reduce(DataFrame.unionByName, parts))]
        seen = reduce(DataFrame.unionByName, parts)
    return seen


def stale_closure(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, shielded: DataFrame) -> DataFrame:
    """Nodes that stand on a stale one along structural edges, against their direction; nodes that are
    stale or superseded already, or have a proof of their own (``shielded``), stop the spread."""
    stop = nodes.where(F.col("status").isin("stale", "superseded")).select("id").union(shielded.select("id")).distinct()
    back = edges.where(F.col("type").isin(*PROPAGATING)).select(F.col("to_node").alias("src"), F.col("from_node").alias("dst")).distinct()
    back = back.join(stop.select(F.col("id").alias("dst")), "dst", "left_anti")
    return distances(seeds, back).where("hops > 0")


def _trimmed(step: DataFrame) -> DataFrame:
    """Edges (src, dst) without what no way leads into or out of, round by round, until all that is left has both."""
    before, now = -1, -2
    while before != now:
        before = now
        step = step.join(step.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        step = stored(step.join(step.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = step.count()
    return step


def _spread(state: DataFrame, step: DataFrame, best: Callable[[str], Column]) -> DataFrame:
    """``state`` (id, mark), with each id's mark the best of its own and of all that lead to it. A round follows the ids that
    have changed."""
    moved = state
    while moved.take(1):
        met = moved.join(step, moved["id"] == step["src"]).groupBy(F.col("dst").alias("id")).agg(best("mark").alias("told"))
        both = state.join(met, "id", "left").withColumn("now", F.coalesce(F.greatest("mark", "told") if best is F.max else F.least("mark", "told"), "mark"))
        both = stored(both.select("id", "mark", "now"))
        moved = stored(both.where("now <> mark").select("id", F.col("now").alias("mark")))
        state = both.select("id", F.col("now").alias("mark"))
    return state


def cycle_components(steps: DataFrame) -> DataFrame:
    """The vertices of ``steps`` (src, dst) that lie on a directed cycle of any length: id, component (the least id of all that
    it reaches and that reach it) and size. A vertex with an edge to itself is a cycle of its own.

    What can't be on a cycle is trimmed first. Each vertex then takes the colour of the greatest vertex that leads to it; those
    of a colour from which its namesake can be reached again are one component. They go, with the edges
    between different colours, and the rest starts anew. Edges with a null end count for nothing.
    """
    steps = stored(steps.where("src is not null and dst is not null").select("src", "dst").distinct())
    loops = steps.where("src = dst").select(F.col("src").alias("id"))
    found = []
    step = _trimmed(steps.where("src <> dst"))
    while step.take(1):
        ids = step.select(F.col("src").alias("id")).distinct()
        colour = stored(_spread(ids.withColumn("mark", F.col("id")), step, F.max))
        a, b = (colour.select(F.col("id").alias(end), F.col("mark").alias(f"{end}_mark")) for end in ("src", "dst"))
        inside = stored(step.join(a, "src").join(b, "dst").where("src_mark = dst_mark").select("src", "dst", F.col("src_mark").alias("mark")))
        # Back from each colour's namesake, inside its colour.
        members = distances(colour.where("id = mark").select("id"), inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        members = stored(members.select("id").join(colour, "id"))
        found.append(members)
        step = _trimmed(inside.join(members.select(F.col("id").alias("src")), "src", "left_anti").join(members.select(F.col("id").alias("dst")), "dst", "left_anti"))
    alone = loops.select("id", F.col("id").alias("mark"))
    every = reduce(DataFrame.unionByName, found) if found else alone.limit(0)
    sizes = every.groupBy("mark").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("size"))
    # A namesake alone is no cycle.
    rows = every.join(sizes.where("size > 1"), "mark").select("id", "component", "size")
    return stored(rows.unionByName(loops.join(rows, "id", "left_anti").select("id", F.col("id").alias("component"), F.lit(1).cast("long").alias("size"))))


def witnesses(steps: DataFrame, components: DataFrame) -> DataFrame:
    """One cycle for each of ``components`` (of ``cycle_components``): component and cycle, the ids of a shortest way from its least id back to
    itself, joined by ">", equals by their text. A component's walk ends with the round that closes it."""
    at = components.select("id", "component")
    inside = stored(steps.select("src", "dst").distinct().join(at.withColumnRenamed("id", "src"), "src").join(at.select(F.col("id").alias("dst"), F.col("component").alias("other")), "dst").where("component = other").select("src", "dst", "component"))
    walk = stored(components.where("id = component").select("component", "id", F.col("id").cast("string").alias("cycle")))
    seen, closed = walk.select("component", "id"), []
    while walk.take(1):
        then = walk.join(inside.withColumnRenamed("src", "id"), ["component", "id"]).groupBy("component", F.col("dst").alias("id")).agg(F.min(F.concat_ws(">", "cycle", F.col("dst").cast("string"))).alias("cycle"))
        then = stored(then)
        done = then.where("id = component").select("component", "cycle")
        closed.append(done)
        walk = stored(then.join(done.select("component"), "component", "left_anti").join(seen, ["component", "id"], "left_anti"))
        seen = stored(seen.unionByName(walk.select("component", "id")))
    return reduce(DataFrame.unionByName, closed) if closed else walk.select("component", "cycle")


def followed(relations: DataFrame, context: str = "science") -> DataFrame:
    """Relations (type, epistemic_status, ...) that inference may follow: approved or verified, not what something emerges from, and
    in science no analogies."""
    kept = relations.where(F.col("epistemic_status").isin("approved", "verified") & (F.coalesce("type", F.lit("related")) != "emerges_from"))
    return kept.where(F.col("epistemic_status") != "analogy") if context == "science" else kept


def best_paths(edges: DataFrame, seeds: DataFrame, depth: int = 2, least: float = 0.3) -> DataFrame:
    """The most confident path from each seed to each node, of at most ``depth`` edges: confidence is the
    product along the path and stays at ``least`` or above; equals go by the path's text."""
    step = edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b"), F.coalesce("confidence", F.lit(0.5)).alias("c"))
    walk = seeds.select(F.col("id").alias("start"), F.col("id").alias("id"), F.lit(1.0).alias("confidence"), F.col("id").alias("path"), F.lit(0).alias("hops"))
    every = walk
    for hop in range(1, depth + 1):
        walk = walk.join(step, walk["id"] == step["a"]).select("start", F.col("b").alias("id"), (F.col("confidence") * F.col("c")).alias("confidence"), F.concat_ws(">", "path", "b").alias("path"), F.lit(hop).alias("hops"))
        walk = walk.where((F.col("confidence") >= least) & ~F.concat(F.lit(">"), F.regexp_replace("path", ">[^>]*$", ""), F.lit(">")).contains(F.concat(F.lit(">"), F.col("id"), F.lit(">"))))
        every = every.unionByName(walk)
    order = W.partitionBy("start", "id").orderBy(F.desc("confidence"), "path")
    return every.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def node_priority(nodes: DataFrame, edges: DataFrame, claims: DataFrame, supports: DataFrame, facets: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Where deepening pays most: a weighted sum of nearness to practice, facet gaps, claims that lack
    evidence, degree and freshness, for live science and foundation nodes."""
    by = lambda df, column, name, value=F.lit(1): df.groupBy(F.col(column).alias("id")).agg(F.count(value).alias(name))
    near = distances(nodes.where("layer = 'practice'").select("id"), undirected(edges))
    proof = supports.groupBy(F.col("target_node").alias("id")).agg(F.count_distinct("evidence_id").alias("evidence_count"))
    cover = facets.groupBy(F.col("node_id").alias("id")).agg(*[F.coalesce(F.max(F.when(F.col("facet") == f, F.col("coverage"))), F.lit(0.0)).alias(f) for f, _ in FACETS])
    rows = nodes.where(F.col("layer").isin("science", "foundation") & ~F.col("status").isin("superseded", "blocked")).select("id", "revision", "layer")
    for part in (near.withColumnRenamed("hops", "practice_distance"), degree(edges), by(claims, "node_id", "claim_count"), proof, cover, *([by(runs, "target_node_id", "recent")] if runs is not None else [])):
        rows = rows.join(part, "id", "left")
    rows = rows.fillna(99, ["practice_distance"]).fillna(0)
    gap = F.lit(1.0) - sum((F.lit(w) * F.col(f) for f, w in FACETS[1:]), F.lit(FACETS[0][1]) * F.col(FACETS[0][0]))
    demand = F.least(F.col("claim_count") / (F.col("evidence_count") + 1) / 3.0, F.lit(1.0))
    penalty = F.least(F.lit(1.0), F.col("recent") / 2.0) if runs is not None else F.lit(0.0)
    score = 0.30 / (1.0 + F.col("practice_distance")) + 0.25 * gap + 0.20 * demand + 0.15 * F.least(F.col("degree") / 8.0, F.lit(1.0)) + 0.10 * (1.0 - penalty) - 0.15 * penalty
    thin = F.sort_array(F.array(*[F.struct(F.col(f).alias("c"), F.lit(i).alias("i"), F.lit(f).alias("f")) for i, (f, _) in enumerate(FACETS)]))
    low = F.array_join(F.transform(F.filter(F.slice(thin, 1, 2), lambda x: x["c"] < 1.0), lambda x: x["f"]), ",")
    return rows.select("id", "revision", F.round(score, 6).alias("score"), low.alias("least_covered"), "degree", "claim_count", "evidence_count", F.col("practice_distance").cast("int").alias("practice_distance"))
