"""The given tables, and the knowledge graph that is derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with ``ts`` as a timestamp, which watermarks need."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _id(prefix: str, key: str | Column) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


def _node(df: DataFrame, id_: Column, layer: str, kind: Column, subtype: Column, status: Column, title: str, revision: int = 1) -> DataFrame:
    return df.select(id_.alias("id"), F.lit(revision).alias("revision"), F.lit(layer).alias("layer"), kind.alias("type"), subtype.alias("subtype"), status.alias("status"), F.col(title).alias("title"), F.concat(F.lit("data of "), F.col(title)).alias("data"))


def _case(value: Column, whens: dict[int, str | None], otherwise: str | None) -> Column:
    out = None
    for k, v in whens.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(F.lit(otherwise)).cast("string")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned nodes: regions and nations as principles and laws, parts as theories (each tenth in two
    revisions), suppliers as world models, customers as practice questions."""
    t = lambda n: table(spark, sf_dir, n)
    part, c = t("part"), F.col
    return reduce(
        DataFrame.unionAll,
        [
            _node(t("region"), _id("B-", "r_regionkey"), "foundation", F.lit("FormalPrinciple"), F.lit("THM"), F.lit("approved"), "r_name"),
            _node(t("nation"), _id("S-", "n_nationkey"), "science", F.lit("ScopedLaw"), _case(c("n_nationkey") % 4, {0: None}, "LAW"), _case(c("n_nationkey") % 5, {0: "superseded", 1: "proposed"}, "approved"), "n_name"),
            _node(part, _id("K-", "p_partkey"), "science", _case(c("p_partkey") % 11, {0: "Question"}, "Theory"), _case(c("p_partkey") % 7, {0: "HYP", 1: None}, "THY"), _case(c("p_partkey") % 6, {0: "stale", 1: "proposed"}, "approved"), "p_name"),
            _node(part.where(c("p_partkey") % 10 == 0), _id("K-", "p_partkey"), "science", F.lit("Theory"), F.lit("THY"), F.lit("approved"), "p_name", 2),
            _node(t("supplier"), _id("U-", "s_suppkey"), "universe", F.lit("WorldModel"), F.lit("WM"), F.lit("approved"), "s_name"),
            _node(t("customer"), _id("P-", "c_custkey"), "practice", F.lit("Question"), F.lit("Q"), _case(c("c_custkey") % 8, {0: "superseded"}, "approved"), "c_name"),
        ],
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed, directed edges between node revisions, with a confidence for traversal."""
    t = lambda n: table(spark, sf_dir, n)
    c = F.col

    def edge(df: DataFrame, id_: Column, kind: str, a: Column, b: Column, derivation: Column, confidence: Column) -> DataFrame:
        return df.select(id_.alias("edge_id"), F.lit(kind).alias("type"), a.alias("from_node"), F.lit(1).alias("from_revision"), b.alias("to_node"), F.lit(1).alias("to_revision"), derivation.cast("string").alias("derivation_ref"), confidence.alias("confidence"))

    uses = t("lineitem").where(c("l_linenumber") == 1).select("l_partkey", "l_suppkey").distinct()
    ps = F.concat(F.lit("e-ps-"), c("l_partkey").cast("string"), F.lit("-"), c("l_suppkey").cast("string"))
    part = lambda v: (5 + v % 5) / F.lit(10.0)
    return reduce(
        DataFrame.unionAll,
        [
            edge(t("nation"), _id("e-nr-", "n_nationkey"), "ABSTRACTS_FROM", _id("S-", "n_nationkey"), _id("B-", "n_regionkey"), _case(c("n_nationkey") % 3, {0: "proof"}, None), part(c("n_nationkey"))),
            edge(t("supplier"), _id("e-sn-", "s_suppkey"), "DERIVES_FROM", _id("U-", "s_suppkey"), _id("S-", "s_nationkey"), F.lit(None), part(c("s_suppkey"))),
            edge(uses, ps, "HAS_SCOPED_INSTANCE", _id("K-", "l_partkey"), _id("U-", "l_suppkey"), F.lit(None), part(c("l_partkey"))),
            edge(t("customer").where(c("c_custkey") % 2 == 0), _id("e-cn-", "c_custkey"), "ABOUT", _id("P-", "c_custkey"), _id("S-", "c_nationkey"), F.lit(None), part(c("c_custkey"))),
        ],
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        _id("C-", "doc_id").alias("claim_id"),
        _id("K-", F.expr("1 + doc_id div 3")).alias("node_id"),
        F.lit(1).alias("node_revision"),
        F.col("text").alias("statement"),
        _case(k % 5, {0: "definition", 1: "theorem", 2: "application_hypothesis"}, "empirical").alias("kind"),
        _case(k % 4, {0: "formally_verified", 1: "source_supported", 2: "contradicted"}, "unverified").alias("epistemic_status"),
        F.col("lang").alias("assumptions"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    uri = F.when(k % 4 == 0, _id("doi:10.1000/", k)).when(k % 4 == 1, _id("https://doi.org/10.1000/", k - 1)).when(k % 4 == 2, F.col("url"))
    return table(spark, sf_dir, "pages").select(
        _id("E-", "page_id").alias("evidence_id"),
        uri.alias("source_uri"),
        F.when(k % 9 != 0, F.md5("html")).alias("content_hash"),
        _id("g", k % 7).alias("origin_group"),
        _case(k % 5, {0: "A", 1: "B", 2: "C"}, None).alias("reliability_grade"),
    )


def supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One piece of evidence for each labelled claim, a second one for every other."""
    k = F.col("doc_id")
    labels = table(spark, sf_dir, "labels").withColumn("second", F.explode(F.when(k % 2 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return labels.select(
        F.concat(F.when(F.col("second"), "SB-").otherwise("SA-"), k.cast("string")).alias("assessment_id"),
        F.when(F.col("second"), _id("E-", F.expr("doc_id div 4"))).otherwise(_id("E-", F.expr("doc_id div 5"))).alias("evidence_id"),
        _id("K-", F.expr("1 + doc_id div 3")).alias("target_node"),
        F.lit(1).alias("target_revision"),
        _id("C-", "doc_id").alias("target_claim"),
        F.when((F.col("quality") == 1) & ~F.col("second"), "evidence_miner").otherwise("reviewer").alias("assessor"),
    )


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found of each piece of evidence's origin; some of it unreviewed, or for other metadata."""
    from gleanmark.operators.policy import evidence_fingerprint

    k = F.substring_index("evidence_id", "-", -1).cast("long")
    return evidence(spark, sf_dir).select(
        "evidence_id",
        F.lit(None).cast("string").alias("canonical_work"),
        F.when(k % 8 != 5, F.col("origin_group")).alias("independent_group"),
        F.when(k % 6 == 1, "unreviewed").otherwise("confirmed").alias("independence_review"),
        F.when(k % 10 == 4, F.lit("old")).otherwise(evidence_fingerprint()).alias("metadata_fingerprint"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the files that audits refer to: path and sha256."""
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("notes/"), F.col("page_id").cast("string")).alias("path"), F.sha2("html", 256).alias("sha256"))


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two audit rows for each labelled claim; the later one counts. Some were made under an old policy, refused,
    without a scope, or bound to another statement."""
    from gleanmark.operators.policy import claim_fingerprint, placed

    told = placed(claims(spark, sf_dir), nodes(spark, sf_dir)).withColumn("mark", claim_fingerprint())
    base = told.join(table(spark, sf_dir, "labels").select(_id("C-", "doc_id").alias("claim_id"), F.col("doc_id").alias("k")), "claim_id")
    k = F.col("k")
    state = F.col("epistemic_status").alias("validated_state")
    first = base.select((2 * k).alias("id"), "claim_id", F.lit("deferred").alias("decision"), state, F.col("mark").alias("fingerprint"), F.lit("v2").alias("policy"), F.lit("all").alias("scope"))
    second = base.select(
        (2 * k + 1).alias("id"),
        "claim_id",
        F.when(k % 6 == 5, "deferred").otherwise("passed").alias("decision"),
        state,
        F.when(k % 7 == 3, F.sha2(F.concat(F.lit("old"), F.col("claim_id")), 256)).otherwise(F.col("mark")).alias("fingerprint"),
        F.when(k % 11 == 4, "v1").otherwise("v2").alias("policy"),
        F.when(k % 19 == 1, "").when(k % 19 != 2, "all").alias("scope"),
    )
    return first.unionAll(second)


def audited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence that audits saw: id, evidence_id, fingerprint. Some has changed since, some never supported the claim."""
    from gleanmark.operators.policy import evidence_fingerprint

    k = F.col("doc_id")
    seen = table(spark, sf_dir, "labels").select((2 * k + 1).alias("id"), k, F.explode(F.array_distinct(F.array(F.expr("doc_id div 5"), F.when(k % 17 == 4, F.lit(0)).otherwise(F.expr("doc_id div 5"))))).alias("page"))
    now = evidence(spark, sf_dir).select("evidence_id", evidence_fingerprint().alias("now"))
    met = seen.select("id", k, _id("E-", "page").alias("evidence_id")).join(now, "evidence_id", "left")
    return met.select("id", "evidence_id", F.when(k % 13 == 6, F.lit("old")).otherwise(F.col("now")).alias("fingerprint"))


def audited_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that audits saw: id, path, sha256. Some have changed since, some lie outside."""
    k = F.col("doc_id")
    seen = table(spark, sf_dir, "labels").select((2 * k + 1).alias("id"), k, F.concat(F.lit("notes/"), F.expr("doc_id div 5").cast("string")).alias("path"))
    met = seen.join(assets(spark, sf_dir), "path", "left")
    return met.select("id", F.when(k % 29 == 3, F.concat(F.lit("../"), F.col("path"))).otherwise(F.col("path")).alias("path"), F.when(k % 23 == 5, F.lit("old")).otherwise(F.col("sha256")).alias("sha256"))


def claim_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between claims, some of them guessed, some without a claim at one end."""
    k = F.col("c_custkey")
    near, far = F.expr("3 * (c_custkey div 7) + c_custkey % 3"), F.expr("3 * (c_custkey div 5) + (c_custkey div 2) % 3")
    return table(spark, sf_dir, "customer").select(
        _id("e-cc-", k).alias("edge_id"),
        F.lit("COMPLEMENTS").alias("type"),
        _id("K-", F.expr("1 + c_custkey div 7")).alias("from_node"),
        F.lit(1).alias("from_revision"),
        F.when(k % 31 != 5, _id("C-", near)).alias("from_claim"),
        _id("K-", F.expr("1 + c_custkey div 5")).alias("to_node"),
        F.lit(1).alias("to_revision"),
        F.when(k % 37 != 6, _id("C-", far)).alias("to_claim"),
        F.when(k % 13 == 2, "[HYP_EDGE] looks alike").when(k % 13 != 3, "both say so").alias("rationale"),
        F.lit(None).cast("string").alias("derivation_ref"),
    )


def edge_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of claim edges: some are candidates still, some saw another edge, some edges have none."""
    from gleanmark.operators.policy import edge_fingerprint

    k = F.substring_index("edge_id", "-", -1).cast("long")
    seen = F.when(k % 9 == 4, F.lit("old")).otherwise(edge_fingerprint())
    return claim_edges(spark, sf_dir).where(k % 17 != 6).select("edge_id", F.when(k % 11 == 3, "candidate").otherwise("validated").alias("status"), seen.alias("fingerprint"))
