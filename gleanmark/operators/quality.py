"""Graph health, quality metrics, votes, breakers and budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanmark.operators.gaps import unsupported_claims
from gleanmark.operators.graph import distances, undirected


def group_counts(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Counts by value of several tables in one: metric, value, n; a null is "ungraded"."""
    parts = [df.groupBy(F.coalesce(c.cast("string"), F.lit("ungraded")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("metric"), "value", "n") for m, (df, c) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def graph_health(nodes: DataFrame, edges: DataFrame, claims: DataFrame, evidence: DataFrame, supports: DataFrame) -> DataFrame:
    """One row: totals, edges per node, share of supported claims, and how much practice nodes reach.

    Reach counts whatever is reached, superseded or not, over live nodes."""
    reach = distances(nodes.where("layer = 'practice' and status <> 'superseded'").select("id"), undirected(edges))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    supported = claims.join(supports.select(F.col("target_claim").alias("claim_id")), "claim_id", "left_semi")
    parts = [one(nodes.where("status <> 'superseded'"), "total_nodes"), one(edges, "total_edges"), one(claims, "total_claims"), one(evidence, "total_evidence"), one(supported, "supported"), one(reach, "reached")]
    row = reduce(DataFrame.crossJoin, parts)  # one row each
    least = lambda c: F.greatest(F.col(c), F.lit(1))
    row = row.withColumn("edge_node_ratio", F.round(F.col("total_edges") / least("total_nodes"), 6)).withColumn("support_ratio", F.round(F.col("supported") / least("total_claims"), 6)).withColumn("practice_reachability", F.round(F.col("reached") / least("total_nodes"), 6))
    return row.withColumn("quality_red", (F.col("edge_node_ratio") < 1.0) | (F.col("support_ratio") < 0.30)).drop("supported", "reached")


def quality_metrics(nodes: DataFrame, claims: DataFrame, supports: DataFrame) -> DataFrame:
    """One row of coverage metrics. Claims on hypotheses or on nodes without a subtype count as supported, as
    the count of unsupported ones leaves them out."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    independent = supports.where("assessor <> 'evidence_miner'").select(F.col("target_claim").alias("claim_id"))
    sound = nodes.where("subtype <> 'HYP'").select(F.col("id").alias("node_id"), F.col("revision").alias("node_revision"))
    legacy = claims.where("kind <> 'definition'").join(sound, ["node_id", "node_revision"], "left_semi").join(independent, "claim_id", "left_semi")
    parts = [one(nodes, "total_nodes"), one(nodes.where("status = 'proposed'"), "provisional"), one(claims.where("kind <> 'definition'"), "claims"), one(unsupported_claims(claims, nodes, supports, metric=True), "unsupported_claims"), one(legacy, "legacy")]
    row = reduce(DataFrame.crossJoin, parts)
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, a / F.col(b)).otherwise(0.0), 6)
    return row.select("unsupported_claims", ratio(F.col("claims") - F.col("unsupported_claims"), "claims").alias("evidence_coverage"), ratio(F.col("legacy"), "claims").alias("legacy_assessor_coverage"), ratio(F.col("provisional"), "total_nodes").alias("provisional_ratio"))


def independent_support(supports: DataFrame, origins: DataFrame, least: int = 2) -> DataFrame:
    """Claims that evidence from at least ``least`` confirmed origins (evidence_id, independent_group) supports: claim_id, origins."""
    met = supports.join(origins, "evidence_id")
    return met.groupBy(F.col("target_claim").alias("claim_id")).agg(F.count_distinct("independent_group").alias("origins")).where(F.col("origins") >= least)


def budget_split(edge_node_ratio: Column, support_ratio: Column, red: Column, saturation: Column) -> Column:
    pick = lambda d, e, c: F.struct(F.lit(d).alias("deepen"), F.lit(e).alias("expand"), F.lit(c).alias("consolidate"))
    return F.when(red, pick(0.0, 0.0, 1.0)).when((support_ratio < 0.45) | (edge_node_ratio < 1.5), pick(0.7, 0.0, 0.3)).when(saturation > 0.5, pick(0.3, 0.6, 0.1)).otherwise(pick(0.6, 0.3, 0.1))


def low_yield(cycles: DataFrame, key: str, order: list[str], value: str, least: float, trip: int = 3) -> DataFrame:
    """How many cycles in a row were below ``least``: islands between cycles that weren't; trips at ``trip``."""
    w = W.partitionBy(key).orderBy(*order)
    reset = F.sum(F.when(F.col(value) >= least, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    island = cycles.withColumn("_i", reset)
    run = F.sum(F.when(F.col(value) < least, 1).otherwise(0)).over(W.partitionBy(key, "_i").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return island.withColumn("low_run", run).withColumn("tripped", F.col("low_run") >= trip).drop("_i")


def breaker(rejection: Column, checked: Column, provisional: Column, nodes: Column, disputes: Column, growth: Column) -> Column:
    """The first of the breaker's rules that trips, each from a least number of observations on; null if none."""
    return F.when((checked > 5) & (rejection > 0.5), "hallucination").when((nodes >= 50) & (provisional > 0.6), "provisional").when(disputes > 10, "disputes").when((nodes >= 20) & (growth > 0.2), "growth")


def majority(votes: DataFrame, item: str, choice: str, place: str) -> DataFrame:
    """Each item's most common choice, first seen first among equals, and how it came about."""
    counted = votes.groupBy(item, choice).agg(F.count(F.lit(1)).alias("votes"), F.min(place).alias("first_place"))
    w = W.partitionBy(item)
    ranked = counted.withColumn("total", F.sum("votes").over(w)).withColumn("choices", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("votes"), "first_place")))
    how = F.when(F.col("choices") == 1, "unanimous").when(F.col("votes") * 2 > F.col("total"), "majority").otherwise("plurality")
    return ranked.where("_r = 1").select(item, F.col(choice).alias("winner"), "votes", "total", how.alias("how"))
