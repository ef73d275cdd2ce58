"""The gap ledger: detectors as anti-joins, idempotent upserts and state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edge types that need evidence, and the ledger's order of gap types.
STRUCTURAL = ("ABSTRACTS_FROM", "DERIVES_FROM", "FORMALIZED_BY", "HAS_SCOPED_INSTANCE")
PRIORITY = ("unsupported_claim", "missing_instance", "unverified_edge")


def unsupported_claims(claims: DataFrame, nodes: DataFrame, supports: DataFrame, metric: bool = False) -> DataFrame:
    """Claims that no assessment targets, definitions and hypotheses aside. A null subtype is
    neither HYP nor another one, so its claims drop out. ``metric`` leaves out the filters on
    status and questions, as the quality metrics do."""
    live = nodes.where("subtype <> 'HYP'")
    if not metric:
        live = live.where(~F.col("status").isin("superseded", "stale") & (F.col("type") != "Question"))
    live = live.select(F.col("id").alias("node_id"), F.col("revision").alias("node_revision"), "layer")
    return claims.where("kind <> 'definition'").join(live, ["node_id", "node_revision"]).join(supports.select(F.col("target_claim").alias("claim_id")), "claim_id", "left_anti")


def missing_instances(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Approved science and universe nodes without an outgoing scoped instance at any revision."""
    has = edges.where("type = 'HAS_SCOPED_INSTANCE'").select(F.col("from_node").alias("id"))
    return nodes.where(F.col("layer").isin("science", "universe") & (F.col("status") == "approved")).join(has, "id", "left_anti")


def co_evidence(supports: DataFrame) -> DataFrame:
    """Pairs of node revisions that share evidence, in either order."""
    s = supports.select("evidence_id", "target_node", "target_revision").distinct()
    a = s.select("evidence_id", F.col("target_node").alias("from_node"), F.col("target_revision").alias("from_revision"))
    b = s.select("evidence_id", F.col("target_node").alias("to_node"), F.col("target_revision").alias("to_revision"))
    return a.join(b, "evidence_id").drop("evidence_id").distinct()


def unverified_edges(edges: DataFrame, supports: DataFrame) -> DataFrame:
    """Structural edges without a derivation and without evidence that both ends share; an empty derivation is none."""
    open_ = edges.where(F.col("type").isin(*STRUCTURAL) & (F.coalesce("derivation_ref", F.lit("")) == ""))
    ends = ["from_node", "from_revision", "to_node", "to_revision"]
    # Only the edges' own ends look for a shared item: no pairs of all that share one.
    from_side = open_.join(supports.select(F.col("target_node").alias("from_node"), F.col("target_revision").alias("from_revision"), "evidence_id"), ends[:2]).select("edge_id", *ends, "evidence_id")
    shared = from_side.join(supports.select(F.col("target_node").alias("to_node"), F.col("target_revision").alias("to_revision"), "evidence_id"), [*ends[2:], "evidence_id"], "left_semi").select("edge_id")
    return open_.join(shared, "edge_id", "left_anti")


def fingerprint(kind: Column, node: Column, claim: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of type:node:claim; a missing claim is empty."""
    return F.substring(F.sha2(F.concat_ws(":", kind, node, F.coalesce(claim, F.lit(""))), 256), 1, 16)


def ledger(claims: DataFrame, nodes: DataFrame, edges: DataFrame, supports: DataFrame) -> DataFrame:
    """All detected gaps with their fingerprints: gap_id, fingerprint, gap_type, anchor_node, anchor_claim."""
    row = lambda df, kind, node, claim: df.select(F.lit(kind).alias("gap_type"), node.alias("anchor_node"), claim.cast("string").alias("anchor_claim"))
    found = row(unsupported_claims(claims, nodes, supports), PRIORITY[0], F.col("node_id"), F.col("claim_id"))
    found = found.unionByName(row(missing_instances(nodes, edges), PRIORITY[1], F.col("id"), F.lit(None)))
    found = found.unionByName(row(unverified_edges(edges, supports), PRIORITY[2], F.col("from_node"), F.col("edge_id")))
    mark = fingerprint(F.col("gap_type"), F.col("anchor_node"), F.col("anchor_claim"))
    return found.withColumn("fingerprint", mark).dropDuplicates(["fingerprint"]).withColumn("gap_id", F.substring("fingerprint", 1, 8))


def upsert(known: DataFrame, found: DataFrame) -> DataFrame:
    """New gaps only: a fingerprint that the ledger knows is left as it is, whatever its state."""
    return found.join(known.select("fingerprint"), "fingerprint", "left_anti")


def priority(found: DataFrame) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("gap_type")).cast("int"), F.lit(0)), F.lit(4))


def transition(state: Column, outcome: Column, attempts: Column, most: int = 3, dry: bool = False) -> tuple[Column, Column]:
    """The next state and attempts of a gap that is worked on: a dry run opens it again but counts."""
    tried = attempts + 1
    after = F.when(outcome == "linked", "resolved").when(outcome == "candidates", "candidate_ready").when(outcome == "edge", "needs_review").when(tried >= most, "exhausted").otherwise("retry_wait")
    return F.when(state != "open", state).otherwise(F.lit("open") if dry else after), F.when(state != "open", attempts).otherwise(tried)


def mining_queue(evidence: DataFrame, mined: DataFrame, most: int | None = None) -> DataFrame:
    """Evidence with a doi: address that hasn't been mined, by id."""
    queue = evidence.where(F.col("source_uri").startswith("doi:")).join(mined.where("state = 'mined'").select("evidence_id"), "evidence_id", "left_anti").orderBy("evidence_id")
    return queue.limit(most) if most else queue


def edge_gaps(open_gaps: DataFrame, edges: DataFrame, usable: DataFrame, supports: DataFrame) -> DataFrame:
    """Open gaps of unverified edges (gap_id, edge_id) with their next state: resolved where the edge is usable and some evidence supports
    both of its nodes, and these differ; open otherwise, as shared evidence alone verifies no relation."""
    ends = edges.join(usable.select("edge_id"), "edge_id", "left_semi").where("from_node <> to_node").select("edge_id", "from_node", "to_node")
    proof = supports.select("evidence_id", "target_node").distinct()
    one = ends.join(proof.withColumnRenamed("target_node", "from_node"), "from_node").select("edge_id", "to_node", "evidence_id")
    both = one.join(proof.withColumnRenamed("target_node", "to_node"), ["to_node", "evidence_id"], "left_semi").select("edge_id").distinct()
    return open_gaps.join(both.withColumn("_m", F.lit(True)), "edge_id", "left").select("gap_id", "edge_id", F.when(F.col("_m"), "resolved").otherwise("open").alias("state"))
