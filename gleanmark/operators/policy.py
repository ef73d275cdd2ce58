"""Which claims, edges and nodes may be used: fail-closed conjunctions over audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The states that an audit may confirm, and the policy version in force.
VALID_STATES = ("formally_verified", "source_supported", "simulation_supported")
POLICY = "v2"


def digest(*columns: str) -> Column:
    """SHA-256 of the columns in order; a null isn't an empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns]), 256)


def claim_fingerprint() -> Column:
    """What an audit binds a claim to: its wording, kind and assumptions, and its node's status, subtype and data. It is
    an expression on claims joined with their nodes; any change makes another one."""
    return digest("claim_id", "node_id", "node_revision", "statement", "kind", "assumptions", "status", "subtype", "data")


def evidence_fingerprint() -> Column:
    return digest("evidence_id", "source_uri", "content_hash", "origin_group", "reliability_grade")


def placed(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """Claims with the status, subtype and data of their nodes' revisions."""
    at = nodes.select(F.col("id").alias("node_id"), F.col("revision").alias("node_revision"), "status", "subtype", "data")
    return claims.join(at, ["node_id", "node_revision"])


def valid_assets(cited: DataFrame, assets: DataFrame) -> DataFrame:
    """``cited`` (path, sha256) with valid: the path stays below the root and the file there has that digest."""
    now = assets.select("path", F.col("sha256").alias("now"))
    below = ~F.col("path").startswith("/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    return cited.join(now, "path", "left").withColumn("valid", F.coalesce(below & (F.col("now") == F.col("sha256")), F.lit(False))).drop("now")


def _all(rows: DataFrame, good: Column) -> DataFrame:
    """The audits (id) with rows, all of which are good."""
    return rows.groupBy("id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("_all")).where("_all").select("id")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each ``key`` by ``order``."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r")).select(key, "r.*")


def usable_claims(claims: DataFrame, nodes: DataFrame, validations: DataFrame, supports: DataFrame, evidence: DataFrame, audited: DataFrame, cited: DataFrame, assets: DataFrame, require_node: bool = True) -> DataFrame:
    """Claims that every rule admits: a valid state, no hypothesis, a live (and approved) node, a
    latest audit that passed, under this policy and with a scope, of this state and fingerprint, with assets all
    of which still are what was audited (``cited``: id, path, sha256) and evidence all of which still is what
    was audited (``audited``: id, evidence_id, fingerprint) and supports the claim. A claim without an audit, or
    with a null anywhere in a rule, isn't usable."""
    last = latest(validations, "claim_id", "id")
    status = F.col("status") == "approved" if require_node else ~F.col("status").isin("blocked", "stale", "superseded")
    rows = placed(claims, nodes).withColumn("_mark", claim_fingerprint())
    rows = rows.where(F.col("epistemic_status").isin(*VALID_STATES) & (F.col("kind") != "application_hypothesis") & (F.coalesce("subtype", F.lit("")) != "HYP") & status)
    rows = rows.join(last.select("claim_id", "id", "decision", "validated_state", "fingerprint", "policy", "scope"), "claim_id")
    rows = rows.where((F.col("decision") == "passed") & (F.col("validated_state") == F.col("epistemic_status")) & (F.col("fingerprint") == F.col("_mark")) & (F.col("policy") == POLICY) & (F.col("scope") != ""))
    asked = rows.select("id", "claim_id")
    now = evidence.select("evidence_id", evidence_fingerprint().alias("_now"))
    bound = supports.select("evidence_id", F.col("target_claim").alias("claim_id"), F.lit(True).alias("_bound")).distinct()
    proof = asked.join(audited, "id").join(now, "evidence_id", "left").join(bound, ["evidence_id", "claim_id"], "left")
    sound = _all(proof, (F.col("_now") == F.col("fingerprint")) & F.col("_bound"))
    files = _all(valid_assets(asked.select("id").join(cited, "id"), assets), F.col("valid"))
    return rows.join(sound, "id", "left_semi").join(files, "id", "left_semi").select(*claims.columns)


def usable_nodes(usable: DataFrame) -> DataFrame:
    return usable.select(F.col("node_id").alias("id"), F.col("node_revision").alias("revision")).distinct()


#: The mark of a guessed edge's rationale, and the state of a review that admits an edge.
GUESSED, REVIEWED = "[HYP_EDGE]", "validated"


def edge_fingerprint() -> Column:
    """What a review binds an edge to: all of it."""
    return digest("edge_id", "type", "from_node", "from_revision", "from_claim", "to_node", "to_revision", "to_claim", "rationale", "derivation_ref")


def usable_edges(edges: DataFrame, usable: DataFrame, reviews: DataFrame) -> DataFrame:
    """Edges that every rule admits: no guess, a review (edge_id, status, fingerprint) that validated the edge as it still is, a
    usable claim at both nodes' revisions, and both of its own claims named and usable. An edge without a review, or
    with a null anywhere in a rule but its rationale, isn't usable. An edge has one review; of several, one must do."""
    rows = edges.where(~F.coalesce("rationale", F.lit("")).contains(GUESSED)).withColumn("_mark", edge_fingerprint())
    good = reviews.where(F.col("status") == REVIEWED).select("edge_id", F.col("fingerprint").alias("_mark"))
    rows = rows.join(good, ["edge_id", "_mark"], "left_semi")
    live, claims = usable_nodes(usable), usable.select("claim_id")
    for end in ("from", "to"):
        side = live.select(F.col("id").alias(f"{end}_node"), F.col("revision").alias(f"{end}_revision"))
        rows = rows.join(side, [f"{end}_node", f"{end}_revision"], "left_semi").join(claims.withColumnRenamed("claim_id", f"{end}_claim"), f"{end}_claim", "left_semi")
    return rows.select(*edges.columns)


def approval_violations(nodes: DataFrame, claims: DataFrame, usable: DataFrame, supports: DataFrame, evidence: DataFrame) -> DataFrame:
    """Why each node revision can't be approved: id, revision and the rules it offends, as one text."""
    checked = claims.join(usable.select("claim_id", F.lit(1).alias("ok")), "claim_id", "left")
    checked = checked.groupBy(F.col("node_id").alias("id"), F.col("node_revision").alias("revision")).agg(F.count("ok").alias("n_ok"), F.count(F.lit(1)).alias("n_claims"))
    proof = supports.join(evidence.select("evidence_id", "content_hash"), "evidence_id", "left").groupBy(F.col("target_node").alias("id"), F.col("target_revision").alias("revision"))
    proof = proof.agg(F.count(F.lit(1)).alias("n_support"), F.count_if(F.col("content_hash").isNull()).alias("n_unhashed"))
    rows = nodes.join(checked, ["id", "revision"], "left").join(proof, ["id", "revision"], "left")
    rules = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("n_claims"), F.lit(0)) == F.lit(0), "unaudited").when(F.col("n_ok") < F.col("n_claims"), "unaudited"),
            F.when(F.coalesce("n_unhashed", F.lit(0)) > 0, "unhashed"),
            F.when(F.col("subtype") == "HYP", "hypothesis"),
            F.when(F.col("layer").isin("foundation", "science") & (F.coalesce("n_support", F.lit(0)) == 0), "no_evidence"),
        )
    )
    return rows.select("id", "revision", F.array_join(rules, ",").alias("violations"))


def refreshed(lineage: DataFrame, evidence: DataFrame, work: Column) -> DataFrame:
    """Lineage (evidence_id, canonical_work, independent_group, independence_review, metadata_fingerprint) brought up to
    ``evidence``: where a row is new or its metadata changed, the work is told anew by ``work`` and the review starts over."""
    now = evidence.select("evidence_id", work.alias("_work"), evidence_fingerprint().alias("_now"))
    both = now.join(lineage, "evidence_id", "left")
    same = F.coalesce(F.col("metadata_fingerprint") == F.col("_now"), F.lit(False))
    keep = lambda c, other: F.when(same, F.col(c)).otherwise(other).alias(c)
    return both.select("evidence_id", keep("canonical_work", F.col("_work")), keep("independent_group", F.lit(None)), keep("independence_review", F.lit("unreviewed")), F.col("_now").alias("metadata_fingerprint"))


def confirmed(lineage: DataFrame, evidence: DataFrame) -> DataFrame:
    """(evidence_id, independent_group) of evidence whose lineage was confirmed for the metadata that it still has."""
    now = evidence.select("evidence_id", evidence_fingerprint().alias("_now"))
    held = lineage.where("independence_review = 'confirmed' and coalesce(independent_group, '') <> ''").join(now, "evidence_id")
    return held.where("metadata_fingerprint = _now").select("evidence_id", "independent_group")


def promotion(nodes: DataFrame, claims: DataFrame, usable: DataFrame, edges: DataFrame, usable_edge: DataFrame, supports: DataFrame, origins: DataFrame) -> DataFrame:
    """Whether proposed nodes may rise: two independent origins (``origins``, as ``confirmed``), two usable edges, all claims audited, none contradicted."""
    at = [F.col("node_id").alias("id"), F.col("node_revision").alias("revision")]
    told = claims.join(usable.select("claim_id", F.lit(1).alias("ok")), "claim_id", "left").groupBy(*at)
    told = told.agg(F.count(F.lit(1)).alias("n"), F.count("ok").alias("ok"), F.count_if(F.col("epistemic_status") == "contradicted").alias("contradictions"))
    origins = supports.join(origins, "evidence_id").groupBy(F.col("target_node").alias("id"), F.col("target_revision").alias("revision")).agg(F.count_distinct("independent_group").alias("independent_evidence"))
    ends = usable_edge.select(F.explode(F.array_distinct(F.array("from_node", "to_node"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("edges"))
    rows = nodes.where("status = 'proposed'").select("id", "revision").join(told, ["id", "revision"], "left").join(origins, ["id", "revision"], "left").join(ends, "id", "left").fillna(0)
    audited = (F.col("n") > 0) & (F.col("ok") == F.col("n"))
    good = audited & (F.col("independent_evidence") >= 2) & (F.col("edges") >= 2) & (F.col("contradictions") == 0)
    return rows.select("id", "revision", "independent_evidence", "edges", "contradictions", good.alias("eligible"))


def lookup_latest_revision(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("revision")))).where("_r = 1").drop("_r")
