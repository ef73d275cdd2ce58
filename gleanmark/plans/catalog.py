"""All registered queries of the knowledge-graph operators, with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanmark import tables as T
from gleanmark.functions import text as X
from gleanmark.operators import claims as C
from gleanmark.operators import gaps, graph, matching, planning, policy, quality, retrieval
from gleanmark.operators.graph import stored
from gleanmark.plans.kg_sql import with_kg
from gleanmark.sources import notes
from gleanmark.streaming import log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "hybrid_trace"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _usable(s: SparkSession, d: str, require_node: bool = True) -> DataFrame:
    return policy.usable_claims(T.claims(s, d), T.nodes(s, d), T.validations(s, d), T.supports(s, d), T.evidence(s, d), T.audited_evidence(s, d), T.audited_assets(s, d), T.assets(s, d), require_node)


# --- gaps and the ledger -------------------------------------------------------------------------------------------


@query(with_kg("""SELECT c.claim_id, c.node_id, c.node_revision, c.kind, n.layer FROM kg_claim c JOIN kg_node n ON c.node_id = n.id AND c.node_revision = n.revision
LEFT JOIN kg_support s ON s.target_claim = c.claim_id WHERE s.assessment_id IS NULL AND n.subtype <> 'HYP' AND n.status NOT IN ('superseded', 'stale') AND c.kind <> 'definition' AND n.type <> 'Question'"""))
def gap_unsupported_claims(s: SparkSession, d: str) -> DataFrame:
    return gaps.unsupported_claims(T.claims(s, d), T.nodes(s, d), T.supports(s, d)).select("claim_id", "node_id", "node_revision", "kind", "layer")


@query(with_kg("""SELECT id, revision, layer, type, title FROM kg_node n WHERE layer IN ('science', 'universe') AND status = 'approved'
AND NOT EXISTS (SELECT 1 FROM kg_edge e WHERE e.type = 'HAS_SCOPED_INSTANCE' AND e.from_node = n.id)"""))
def gap_missing_instances(s: SparkSession, d: str) -> DataFrame:
    return gaps.missing_instances(T.nodes(s, d), T.edges(s, d)).select("id", "revision", "layer", "type", "title")


UNVERIFIED = """SELECT edge_id, type, from_node, to_node FROM kg_edge e WHERE type IN ('ABSTRACTS_FROM', 'DERIVES_FROM', 'FORMALIZED_BY', 'HAS_SCOPED_INSTANCE')
AND coalesce(derivation_ref, '') = '' AND NOT EXISTS (SELECT 1 FROM kg_support a JOIN kg_support b ON a.evidence_id = b.evidence_id
WHERE a.target_node = e.from_node AND a.target_revision = e.from_revision AND b.target_node = e.to_node AND b.target_revision = e.to_revision)"""


@query(with_kg(UNVERIFIED))
def gap_unverified_edges(s: SparkSession, d: str) -> DataFrame:
    return gaps.unverified_edges(T.edges(s, d), T.supports(s, d)).select("edge_id", "type", "from_node", "to_node")


LEDGER = f"""found AS (
SELECT 'unsupported_claim' AS gap_type, c.node_id AS anchor_node, c.claim_id AS anchor_claim FROM kg_claim c JOIN kg_node n ON c.node_id = n.id AND c.node_revision = n.revision
LEFT JOIN kg_support s ON s.target_claim = c.claim_id WHERE s.assessment_id IS NULL AND n.subtype <> 'HYP' AND n.status NOT IN ('superseded', 'stale') AND c.kind <> 'definition' AND n.type <> 'Question'
UNION ALL SELECT 'missing_instance', id, NULL FROM kg_node n WHERE layer IN ('science', 'universe') AND status = 'approved' AND NOT EXISTS (SELECT 1 FROM kg_edge e WHERE e.type = 'HAS_SCOPED_INSTANCE' AND e.from_node = n.id)
UNION ALL SELECT 'unverified_edge', from_node, edge_id FROM ({UNVERIFIED}) x),
gap AS (SELECT DISTINCT gap_type, anchor_node, anchor_claim, substr(sha256(concat(gap_type, ':', anchor_node, ':', coalesce(anchor_claim, ''))), 1, 16) AS fingerprint FROM found)"""


def _ledger(s: SparkSession, d: str) -> DataFrame:
    return gaps.ledger(T.claims(s, d), T.nodes(s, d), T.edges(s, d), T.supports(s, d))


@query(with_kg(LEDGER + "\nSELECT substr(fingerprint, 1, 8) AS gap_id, fingerprint, gap_type, anchor_node, anchor_claim FROM gap"))
def fingerprint(s: SparkSession, d: str) -> DataFrame:
    return _ledger(s, d).select("gap_id", "fingerprint", "gap_type", "anchor_node", "anchor_claim")


@query(with_kg(LEDGER + "\nSELECT gap_id, gap_type, anchor_node, priority, row_number() OVER (ORDER BY priority, fingerprint) AS place FROM (SELECT *, substr(fingerprint, 1, 8) AS gap_id, CASE gap_type WHEN 'unsupported_claim' THEN 1 WHEN 'missing_instance' THEN 2 WHEN 'unverified_edge' THEN 3 ELSE 4 END AS priority FROM gap) x QUALIFY place <= 50"))
def priority_ledger(s: SparkSession, d: str) -> DataFrame:
    """The first 50 open gaps (a report), by the ledger's order of types."""
    best = _ledger(s, d).withColumn("priority", gaps.priority(F.lit(0))).orderBy("priority", "fingerprint").limit(50)
    return best.withColumn("place", F.row_number().over(W.orderBy("priority", "fingerprint"))).select("gap_id", "gap_type", "anchor_node", "priority", "place")


@query(with_kg(LEDGER + "\nSELECT gap_id, CASE WHEN known THEN 'known' ELSE 'new' END AS action FROM (SELECT substr(fingerprint, 1, 8) AS gap_id, fingerprint < '8' AS known FROM gap) x WHERE NOT known"))
def ledger_upsert(s: SparkSession, d: str) -> DataFrame:
    """A second run of the detectors over a ledger that has seen the lower half of the fingerprints."""
    found = _ledger(s, d)
    return gaps.upsert(found.where("fingerprint < '8'"), found).select("gap_id", F.lit("new").alias("action"))


@query(with_kg(LEDGER + """
SELECT substr(fingerprint, 1, 8) AS gap_id, CASE substr(fingerprint, 16, 1) WHEN '0' THEN 'resolved' WHEN '1' THEN 'candidate_ready' WHEN '2' THEN 'needs_review' ELSE CASE WHEN attempts + 1 >= 3 THEN 'exhausted' ELSE 'retry_wait' END END AS state, attempts + 1 AS attempts
FROM (SELECT *, CAST(length(anchor_node) % 4 AS INT) AS attempts FROM gap) x"""))
def gap_transitions(s: SparkSession, d: str) -> DataFrame:
    digit = F.substring("fingerprint", 16, 1)
    outcome = F.when(digit == "0", "linked").when(digit == "1", "candidates").when(digit == "2", "edge").otherwise("nothing")
    state, attempts = gaps.transition(F.lit("open"), outcome, (F.length("anchor_node") % 4).cast("int"))
    return _ledger(s, d).select("gap_id", state.alias("state"), attempts.alias("attempts"))


@query(with_kg("""SELECT evidence_id FROM kg_evidence e WHERE source_uri LIKE 'doi:%' AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id % 3 = 0 AND concat('E-', p.page_id) = e.evidence_id)"""))
def mining_queue(s: SparkSession, d: str) -> DataFrame:
    mined = T.table(s, d, "pages").where("page_id % 3 = 0").select(F.concat(F.lit("E-"), F.col("page_id").cast("string")).alias("evidence_id"), F.lit("mined").alias("state"))
    return gaps.mining_queue(T.evidence(s, d), mined).select("evidence_id")


# --- graph -----------------------------------------------------------------------------------------------------------


@query(with_kg("""pairs AS (SELECT a.target_node AS node_a, b.target_node AS node_b, count(DISTINCT a.evidence_id) AS co_count, string_agg(DISTINCT a.evidence_id, ',' ORDER BY a.evidence_id) AS evidence_ids
FROM kg_support a JOIN kg_support b ON a.evidence_id = b.evidence_id AND a.target_node < b.target_node GROUP BY 1, 2)
SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM kg_edge e WHERE (e.from_node = p.node_a AND e.to_node = p.node_b) OR (e.from_node = p.node_b AND e.to_node = p.node_a))"""))
def coevidence_pairs(s: SparkSession, d: str) -> DataFrame:
    return graph.coevidence_pairs(T.supports(s, d), T.edges(s, d))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS q, l_suppkey AS c FROM lineitem)
SELECT x.c AS card_a, y.c AS card_b, count(*) AS freq FROM a x JOIN a y ON x.q = y.q AND x.c < y.c GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY freq DESC, card_a, card_b LIMIT 30""")
def coactivation_pairs(s: SparkSession, d: str) -> DataFrame:
    return graph.coactivation_pairs(T.table(s, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("card_id")))


@query(with_kg("SELECT id, count(*) AS degree FROM (SELECT from_node AS id FROM kg_edge UNION ALL SELECT to_node FROM kg_edge) x GROUP BY id"))
def degree(s: SparkSession, d: str) -> DataFrame:
    return graph.degree(T.edges(s, d))


REACH = """ud AS (SELECT from_node AS a, to_node AS b FROM kg_edge UNION SELECT to_node, from_node FROM kg_edge),
walk AS (SELECT id, 0 AS hops FROM kg_node WHERE layer = 'practice' {where} UNION SELECT ud.b, hops + 1 FROM walk JOIN ud ON ud.a = walk.id WHERE hops < 8),
near AS (SELECT id, min(hops) AS hops FROM walk GROUP BY id)"""


@query(with_kg(REACH.format(where="AND status <> 'superseded'") + "\nSELECT id, CAST(hops AS INT) AS hops FROM near", recursive=True))
def practice_reach(s: SparkSession, d: str) -> DataFrame:
    return graph.distances(T.nodes(s, d).where("layer = 'practice' and status <> 'superseded'").select("id"), graph.undirected(T.edges(s, d)))


STALE = """stop AS (SELECT id FROM kg_node WHERE status IN ('stale', 'superseded') UNION SELECT from_node FROM kg_edge WHERE derivation_ref = 'proof'),
back AS (SELECT DISTINCT to_node AS a, from_node AS b FROM kg_edge WHERE type IN ('ABSTRACTS_FROM', 'DERIVES_FROM', 'HAS_SCOPED_INSTANCE') AND from_node NOT IN (SELECT id FROM stop)),
walk AS (SELECT id, 0 AS hops FROM kg_node WHERE id IN ('B-0', 'B-1') UNION SELECT back.b, hops + 1 FROM walk JOIN back ON back.a = walk.id WHERE hops < 8)
SELECT id, CAST(min(hops) AS INT) AS hops FROM walk WHERE hops > 0 GROUP BY id"""


@query(with_kg(STALE, recursive=True))
def stale_closure(s: SparkSession, d: str) -> DataFrame:
    edges, nodes = T.edges(s, d), T.nodes(s, d)
    return graph.stale_closure(edges, nodes, nodes.where("id in ('B-0', 'B-1')"), edges.where("derivation_ref = 'proof'").select(F.col("from_node").alias("id")))


@query(with_kg("""step AS (SELECT from_node AS a, to_node AS b FROM kg_edge WHERE type IN ('ABSTRACTS_FROM', 'DERIVES_FROM', 'HAS_SCOPED_INSTANCE')
UNION SELECT to_node, from_node FROM kg_edge WHERE type = 'ABSTRACTS_FROM' AND derivation_ref = 'proof' UNION SELECT concat('B-', p_partkey % 50), concat('K-', p_partkey) FROM part WHERE p_partkey % 50 < 5),
out AS (SELECT a FROM step INTERSECT SELECT b FROM step), st AS (SELECT * FROM step WHERE a IN (SELECT a FROM out) AND b IN (SELECT a FROM out)),
walk AS (SELECT a, b FROM st UNION SELECT w.a, st.b FROM walk w JOIN st ON w.b = st.a),
c AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component, count(*) AS size FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a GROUP BY 1)
SELECT id, component, size FROM c""", recursive=True))
def cycle_check(s: SparkSession, d: str) -> DataFrame:
    """The structural edges and, so that there are cycles, the proved ones turned round, and some from principles back to parts."""
    edges = T.edges(s, d).where(F.col("type").isin(*graph.PROPAGATING)).select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"), "derivation_ref", "type")
    turned = edges.where("derivation_ref = 'proof' and type = 'ABSTRACTS_FROM'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    k = F.col("p_partkey")
    back = T.table(s, d, "part").where(k % 50 < 5).select(F.concat(F.lit("B-"), (k % 50).cast("string")).alias("src"), F.concat(F.lit("K-"), k.cast("string")).alias("dst"))
    return graph.cycle_components(edges.select("src", "dst").unionByName(turned).unionByName(back))


@query(with_kg("""walk AS (SELECT id AS start, id, CAST(1 AS DOUBLE) AS confidence, id AS path, 0 AS hops FROM (SELECT DISTINCT id FROM kg_node WHERE layer = 'science') x
UNION ALL SELECT start, e.to_node, w.confidence * e.confidence, concat(w.path, '>', e.to_node), hops + 1 FROM walk w JOIN kg_edge e ON e.from_node = w.id WHERE hops < 2 AND w.confidence * e.confidence >= 3e-1 AND NOT list_contains(string_split(w.path, '>'), e.to_node)),
r AS (SELECT *, row_number() OVER (PARTITION BY start, id ORDER BY confidence DESC, path) AS n FROM walk)
SELECT start, id, round(confidence, 6) AS confidence, path, CAST(hops AS INT) AS hops FROM r WHERE n = 1""", recursive=True))
def traverse_best_path(s: SparkSession, d: str) -> DataFrame:
    seeds = T.nodes(s, d).where("layer = 'science'").select("id").distinct()
    return graph.best_paths(T.edges(s, d), seeds).withColumn("confidence", F.round("confidence", 6))


def _facets(s: SparkSession, d: str) -> DataFrame:
    """Coverage of two facets of each part's node, from the part's size."""
    part = T.table(s, d, "part").select(F.concat(F.lit("K-"), F.col("p_partkey").cast("string")).alias("node_id"), "p_size")
    pick = F.array(F.struct(F.lit("mechanism").alias("facet"), (F.col("p_size") % 11 / 10.0).alias("coverage")), F.struct(F.lit("boundary").alias("facet"), (F.col("p_size") % 6 / 5.0).alias("coverage")))
    return part.select("node_id", F.inline(pick))


PRIORITY = REACH.format(where="") + """,
deg AS (SELECT id, count(*) AS degree FROM (SELECT from_node AS id FROM kg_edge UNION ALL SELECT to_node FROM kg_edge) x GROUP BY id),
cl AS (SELECT node_id AS id, count(*) AS claim_count FROM kg_claim GROUP BY 1), ev AS (SELECT target_node AS id, count(DISTINCT evidence_id) AS evidence_count FROM kg_support GROUP BY 1),
fa AS (SELECT concat('K-', p_partkey) AS id, (p_size % 11) / 1e1 AS mech, (p_size % 6) / 5e0 AS bound FROM part),
ru AS (SELECT concat('K-', 1 + user_id) AS id, least(1e0, count(*) / 2e0) AS pen FROM events WHERE event_type = 'purchase' AND event_id // 50 > (SELECT max(event_id // 50) FROM events) - 5 GROUP BY 1),
b AS (SELECT n.id, coalesce(pen, 0) AS pen, n.revision, coalesce(degree, 0) AS degree, coalesce(claim_count, 0) AS claim_count, coalesce(evidence_count, 0) AS evidence_count, coalesce(hops, 99) AS dist, coalesce(mech, 0) AS mech, coalesce(bound, 0) AS bound
FROM kg_node n LEFT JOIN deg USING (id) LEFT JOIN cl USING (id) LEFT JOIN ev USING (id) LEFT JOIN fa USING (id) LEFT JOIN near USING (id) LEFT JOIN ru USING (id) WHERE layer IN ('science', 'foundation') AND status NOT IN ('superseded', 'blocked'))
SELECT id, revision, round(3e-1 / (1 + dist) + 25e-2 * (1 - (15e-2 * mech + 2e-1 * bound)) + 2e-1 * least(claim_count / CAST(evidence_count + 1 AS DOUBLE) / 3e0, 1e0) + 15e-2 * least(degree / 8e0, 1e0) + 1e-1 * (1 - pen) - 15e-2 * pen, 6) AS score,
CASE WHEN mech = 0 THEN 'mechanism,moderator' WHEN bound = 0 THEN 'moderator,boundary' ELSE 'moderator,measurement' END AS least_covered, degree, claim_count, evidence_count, CAST(dist AS INT) AS practice_distance FROM b"""


@query(with_kg(PRIORITY, recursive=True))
def node_priority(s: SparkSession, d: str) -> DataFrame:
    """Purchases of the last five cycles, of 50 events each, are the recent runs."""
    events = T.table(s, d, "events").withColumn("cycle", F.expr("event_id div 50"))
    last = events.agg(F.max("cycle").alias("last"))
    runs = events.where("event_type = 'purchase'").join(F.broadcast(last), F.col("cycle") > F.col("last") - 5)  # one row
    runs = runs.select(F.concat(F.lit("K-"), (F.col("user_id") + 1).cast("string")).alias("target_node_id"))
    return graph.node_priority(T.nodes(s, d), T.edges(s, d), T.claims(s, d), T.supports(s, d), _facets(s, d), runs)


# --- policy ----------------------------------------------------------------------------------------------------------

USABLE = """v AS (SELECT * FROM kg_validation QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY id DESC) = 1),
usable AS (SELECT c.* FROM kg_claim c JOIN kg_node n ON n.id = c.node_id AND n.revision = c.node_revision JOIN v ON v.claim_id = c.claim_id JOIN kg_mark m ON m.claim_id = c.claim_id
WHERE c.epistemic_status IN ('formally_verified', 'source_supported', 'simulation_supported') AND c.kind <> 'application_hypothesis' AND coalesce(n.subtype, '') <> 'HYP' AND {node}
AND v.decision = 'passed' AND v.validated_state = c.epistemic_status AND v.fingerprint = m.mark AND v.policy = 'v2' AND v.scope <> ''
AND v.id IN (SELECT x.id FROM kg_audit_asset x LEFT JOIN kg_asset a ON a.path = x.path GROUP BY 1 HAVING bool_and(coalesce(x.sha256 = a.sha256 AND x.path NOT LIKE '/%' AND NOT regexp_matches(x.path, '(^|/)\\.\\.(/|$)'), FALSE)))
AND v.id IN (SELECT x.id FROM kg_audit_evidence x LEFT JOIN kg_emark m ON m.evidence_id = x.evidence_id GROUP BY 1
  HAVING bool_and(coalesce(x.fingerprint = m.mark, FALSE) AND EXISTS (SELECT 1 FROM kg_support s WHERE s.target_claim = concat('C-', (x.id - 1) // 2) AND s.evidence_id = x.evidence_id))))"""
STRICT, LOOSE = USABLE.format(node="n.status = 'approved'"), USABLE.format(node="n.status NOT IN ('blocked', 'stale', 'superseded')")


@query(with_kg(STRICT + "\nSELECT claim_id, node_id, node_revision, kind, epistemic_status FROM usable"))
def claim_usable(s: SparkSession, d: str) -> DataFrame:
    return _usable(s, d).select("claim_id", "node_id", "node_revision", "kind", "epistemic_status")


CLAIM_EDGES = """un AS (SELECT DISTINCT node_id AS id, node_revision AS revision FROM usable),
ue AS (SELECT e.* FROM kg_claim_edge e JOIN kg_edge_review r ON r.edge_id = e.edge_id JOIN kg_edge_mark m ON m.edge_id = e.edge_id WHERE coalesce(rationale, '') NOT LIKE '%[HYP_EDGE]%' AND r.status = 'validated' AND r.fingerprint = m.mark
AND EXISTS (SELECT 1 FROM un WHERE id = from_node AND revision = from_revision) AND EXISTS (SELECT 1 FROM un WHERE id = to_node AND revision = to_revision)
AND EXISTS (SELECT 1 FROM usable u WHERE u.claim_id = from_claim) AND EXISTS (SELECT 1 FROM usable u WHERE u.claim_id = to_claim))"""


@query(with_kg(STRICT + ",\n" + CLAIM_EDGES + "\nSELECT edge_id, from_node, to_node FROM ue"))
def edge_usable(s: SparkSession, d: str) -> DataFrame:
    return policy.usable_edges(T.claim_edges(s, d), _usable(s, d), T.edge_reviews(s, d)).select("edge_id", "from_node", "to_node")


@query(with_kg(LOOSE + """,
cl AS (SELECT c.node_id AS id, c.node_revision AS revision, count(u.claim_id) AS ok, count(*) AS n FROM kg_claim c LEFT JOIN usable u ON u.claim_id = c.claim_id GROUP BY 1, 2),
su AS (SELECT target_node AS id, target_revision AS revision, count(*) AS n, count(*) - count(content_hash) AS bare FROM kg_support s LEFT JOIN kg_evidence e ON e.evidence_id = s.evidence_id GROUP BY 1, 2)
SELECT n.id, n.revision, concat_ws(',', CASE WHEN coalesce(cl.n, 0) = 0 OR cl.ok < cl.n THEN 'unaudited' END, CASE WHEN coalesce(bare, 0) > 0 THEN 'unhashed' END, CASE WHEN subtype = 'HYP' THEN 'hypothesis' END, CASE WHEN layer IN ('foundation', 'science') AND coalesce(su.n, 0) = 0 THEN 'no_evidence' END) AS violations
FROM kg_node n LEFT JOIN cl ON cl.id = n.id AND cl.revision = n.revision LEFT JOIN su ON su.id = n.id AND su.revision = n.revision"""))
def approval_violations(s: SparkSession, d: str) -> DataFrame:
    return policy.approval_violations(T.nodes(s, d), T.claims(s, d), _usable(s, d, False), T.supports(s, d), T.evidence(s, d))


@query(with_kg(LOOSE + ",\n" + CLAIM_EDGES + """,
cl AS (SELECT c.node_id AS id, c.node_revision AS revision, count(u.claim_id) AS ok, count(*) AS n, count(*) FILTER (WHERE c.epistemic_status = 'contradicted') AS con FROM kg_claim c LEFT JOIN usable u ON u.claim_id = c.claim_id GROUP BY 1, 2),
ori AS (SELECT target_node AS id, target_revision AS revision, count(DISTINCT independent_group) AS n FROM kg_support s JOIN kg_origin e ON e.evidence_id = s.evidence_id GROUP BY 1, 2),
ends AS (SELECT id, count(DISTINCT edge_id) AS n FROM (SELECT edge_id, from_node AS id FROM ue UNION ALL SELECT edge_id, to_node FROM ue) x GROUP BY 1)
SELECT n.id, n.revision, coalesce(ori.n, 0) AS independent_evidence, coalesce(ends.n, 0) AS edges, coalesce(con, 0) AS contradictions, coalesce(cl.n, 0) > 0 AND cl.ok = cl.n AND coalesce(ori.n, 0) >= 2 AND coalesce(ends.n, 0) >= 2 AND coalesce(con, 0) = 0 AS eligible
FROM kg_node n LEFT JOIN cl ON cl.id = n.id AND cl.revision = n.revision LEFT JOIN ori ON ori.id = n.id AND ori.revision = n.revision LEFT JOIN ends ON ends.id = n.id WHERE n.status = 'proposed'""").replace("coalesce(cl.n, 0) > 0 AND cl.ok = cl.n", "coalesce(cl.n, 0) > 0 AND coalesce(cl.ok, 0) = coalesce(cl.n, 0)"))
def promotion(s: SparkSession, d: str) -> DataFrame:
    usable = _usable(s, d, False)
    edges = T.claim_edges(s, d)
    return policy.promotion(T.nodes(s, d), T.claims(s, d), usable, edges, policy.usable_edges(edges, usable, T.edge_reviews(s, d)), T.supports(s, d), policy.confirmed(T.lineage(s, d), T.evidence(s, d)))


@query(with_kg("SELECT id, revision, status FROM kg_node QUALIFY row_number() OVER (PARTITION BY id ORDER BY revision DESC) = 1"))
def latest_revision(s: SparkSession, d: str) -> DataFrame:
    return policy.lookup_latest_revision(T.nodes(s, d)).select("id", "revision", "status")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_validation(s: SparkSession, d: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    return policy.latest(T.table(s, d, "events").select("user_id", "event_id", "event_type", F.col("event_id").alias("o")), "user_id", "o").drop("o")


# --- quality ---------------------------------------------------------------------------------------------------------


@query(with_kg("""SELECT 'node_status' AS metric, status AS value, count(*) AS n FROM kg_node GROUP BY 2 UNION ALL SELECT 'node_layer', layer, count(*) FROM kg_node GROUP BY 2
UNION ALL SELECT 'epistemic_status', epistemic_status, count(*) FROM kg_claim GROUP BY 2 UNION ALL SELECT 'grade', coalesce(reliability_grade, 'ungraded'), count(*) FROM kg_evidence GROUP BY 2
UNION ALL SELECT 'edge_type', type, count(*) FROM kg_edge GROUP BY 2"""))
def group_counts(s: SparkSession, d: str) -> DataFrame:
    n, c, e, v = T.nodes(s, d), T.claims(s, d), T.edges(s, d), T.evidence(s, d)
    return quality.group_counts({"node_status": (n, F.col("status")), "node_layer": (n, F.col("layer")), "epistemic_status": (c, F.col("epistemic_status")), "grade": (v, F.col("reliability_grade")), "edge_type": (e, F.col("type"))})


HEALTH = REACH.format(where="AND status <> 'superseded'") + """,
t AS (SELECT (SELECT count(*) FROM kg_node WHERE status <> 'superseded') AS total_nodes, (SELECT count(*) FROM kg_edge) AS total_edges, (SELECT count(*) FROM kg_claim) AS total_claims, (SELECT count(*) FROM kg_evidence) AS total_evidence,
(SELECT count(*) FROM kg_claim c WHERE EXISTS (SELECT 1 FROM kg_support s WHERE s.target_claim = c.claim_id)) AS supported, (SELECT count(*) FROM near) AS reached),
h AS (SELECT total_nodes, total_edges, total_claims, total_evidence, round(total_edges / CAST(greatest(total_nodes, 1) AS DOUBLE), 6) AS edge_node_ratio, round(supported / CAST(greatest(total_claims, 1) AS DOUBLE), 6) AS support_ratio, round(reached / CAST(greatest(total_nodes, 1) AS DOUBLE), 6) AS practice_reachability FROM t)"""


@query(with_kg(HEALTH + "\nSELECT *, edge_node_ratio < 1e0 OR support_ratio < 3e-1 AS quality_red FROM h", recursive=True))
def graph_health(s: SparkSession, d: str) -> DataFrame:
    return quality.graph_health(T.nodes(s, d), T.edges(s, d), T.claims(s, d), T.evidence(s, d), T.supports(s, d))


@query(with_kg(HEALTH + "\nSELECT CASE WHEN edge_node_ratio < 1e0 OR support_ratio < 3e-1 THEN 0e0 WHEN support_ratio < 45e-2 OR edge_node_ratio < 15e-1 THEN 7e-1 ELSE 6e-1 END AS deepen, CASE WHEN edge_node_ratio < 1e0 OR support_ratio < 3e-1 THEN 0e0 WHEN support_ratio < 45e-2 OR edge_node_ratio < 15e-1 THEN 0e0 ELSE 3e-1 END AS expand, CASE WHEN edge_node_ratio < 1e0 OR support_ratio < 3e-1 THEN 1e0 WHEN support_ratio < 45e-2 OR edge_node_ratio < 15e-1 THEN 3e-1 ELSE 1e-1 END AS consolidate FROM h", recursive=True))
def budget_split(s: SparkSession, d: str) -> DataFrame:
    health = graph_health(s, d)
    return health.select(quality.budget_split(F.col("edge_node_ratio"), F.col("support_ratio"), F.col("quality_red"), F.lit(0.0)).alias("b")).select("b.*")


@query(with_kg("""t AS (SELECT (SELECT count(*) FROM kg_claim WHERE kind <> 'definition') AS c, (SELECT count(*) FROM kg_node) AS n, (SELECT count(*) FROM kg_node WHERE status = 'proposed') AS p,
(SELECT count(*) FROM kg_claim c JOIN kg_node n ON c.node_id = n.id AND c.node_revision = n.revision WHERE n.subtype <> 'HYP' AND c.kind <> 'definition' AND NOT EXISTS (SELECT 1 FROM kg_support s WHERE s.target_claim = c.claim_id)) AS u,
(SELECT count(*) FROM kg_claim c JOIN kg_node n ON c.node_id = n.id AND c.node_revision = n.revision WHERE n.subtype <> 'HYP' AND c.kind <> 'definition' AND EXISTS (SELECT 1 FROM kg_support s WHERE s.target_claim = c.claim_id AND s.assessor <> 'evidence_miner')) AS l)
SELECT u AS unsupported_claims, round((c - u) / CAST(c AS DOUBLE), 6) AS evidence_coverage, round(l / CAST(c AS DOUBLE), 6) AS legacy_assessor_coverage, round(p / CAST(n AS DOUBLE), 6) AS provisional_ratio FROM t"""))
def quality_metrics(s: SparkSession, d: str) -> DataFrame:
    return quality.quality_metrics(T.nodes(s, d), T.claims(s, d), T.supports(s, d))


@query(with_kg("SELECT target_claim AS claim_id, count(DISTINCT independent_group) AS origins FROM kg_support s JOIN kg_origin e ON e.evidence_id = s.evidence_id GROUP BY 1 HAVING count(DISTINCT independent_group) >= 2"))
def independent_support(s: SparkSession, d: str) -> DataFrame:
    return quality.independent_support(T.supports(s, d), policy.confirmed(T.lineage(s, d), T.evidence(s, d)))


@query(with_kg("""SELECT m.evidence_id, CASE WHEN metadata_fingerprint = mark THEN independent_group END AS independent_group, CASE WHEN metadata_fingerprint = mark THEN independence_review ELSE 'unreviewed' END AS independence_review, mark AS metadata_fingerprint FROM kg_emark m LEFT JOIN kg_lineage l ON l.evidence_id = m.evidence_id"""))
def lineage_refresh(s: SparkSession, d: str) -> DataFrame:
    return policy.refreshed(T.lineage(s, d), T.evidence(s, d), X.canonical_work(F.col("source_uri"))).drop("canonical_work")


@query(with_kg("""SELECT x.id, x.path, coalesce(x.sha256 = a.sha256 AND x.path NOT LIKE '/%' AND NOT regexp_matches(x.path, '(^|/)\\.\\.(/|$)'), FALSE) AS valid FROM kg_audit_asset x LEFT JOIN kg_asset a ON a.path = x.path"""))
def asset_check(s: SparkSession, d: str) -> DataFrame:
    return policy.valid_assets(T.audited_assets(s, d), T.assets(s, d)).select("id", "path", "valid")


@query("""WITH r AS (SELECT *, sum(CASE WHEN value >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM events),
c AS (SELECT user_id, event_id, sum(CASE WHEN value < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, i ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS low_run FROM r)
SELECT user_id, event_id, CAST(low_run AS BIGINT) AS low_run, low_run >= 3 AS tripped FROM c""")
def breaker(s: SparkSession, d: str) -> DataFrame:
    """Low-yield runs in each user's events."""
    return quality.low_yield(T.table(s, d, "events"), "user_id", ["ts", "event_id"], "value", 40).select("user_id", "event_id", "low_run", "tripped")


@query("""WITH v AS (SELECT l_partkey AS item, l_returnflag AS choice, count(*) AS votes, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY item) AS BIGINT) AS total, count(*) OVER (PARTITION BY item) AS choices, row_number() OVER (PARTITION BY item ORDER BY votes DESC, f) AS n FROM v)
SELECT item, choice AS winner, votes, total, CASE WHEN choices = 1 THEN 'unanimous' WHEN votes * 2 > total THEN 'majority' ELSE 'plurality' END AS how FROM r WHERE n = 1""")
def majority_vote(s: SparkSession, d: str) -> DataFrame:
    votes = T.table(s, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("choice"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return quality.majority(votes, "item", "choice", "place")


@query("""SELECT p_type AS category, count(DISTINCT p_partkey) AS folders, count(*) AS lectures, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS courses, round(1e2 * count(*) / CAST((SELECT count(*) FROM lineitem JOIN part ON p_partkey = l_partkey) AS DOUBLE), 4) AS share
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def category_rollup(s: SparkSession, d: str) -> DataFrame:
    joined = T.table(s, d, "lineitem").select("l_partkey").join(T.table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rolled = joined.groupBy(F.col("p_type").alias("category")).agg(F.count_distinct("p_partkey").alias("folders"), F.count(F.lit(1)).alias("lectures"), F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("courses"))
    total = F.sum("lectures").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rolled.withColumn("share", F.round(100.0 * F.col("lectures") / total, 4))


# --- retrieval -------------------------------------------------------------------------------------------------------

#: Queries are benchmark items, those whose id is divisible by 100; all documents are searched.
EVERY = """q AS (SELECT item_id AS query_id, text FROM benchmark), qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM q)"""
ASKED = EVERY.replace("FROM benchmark", "FROM benchmark WHERE item_id % 100 = 0")


def _asked(s: SparkSession, d: str, every: bool = False) -> DataFrame:
    items = T.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return items if every else items.where("query_id % 100 = 0")


SCORED = """tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ts FROM documents),
len AS (SELECT doc_id, CAST(len(ts) AS DOUBLE) AS l FROM tok), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(l) AS mean FROM len),
tf AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) x WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY 1),
w AS (SELECT query_id, qt.term, CASE WHEN ln((n - df + 5e-1) / (df + 5e-1)) <= 0 THEN 1e-6 ELSE ln((n - df + 5e-1) / (df + 5e-1)) END AS idf FROM qt JOIN df ON df.term = qt.term, st),
sc AS (SELECT query_id, doc_id, -sum(idf * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * l / mean))) AS score, count(*) AS terms FROM tf JOIN w ON w.term = tf.term JOIN len USING (doc_id), st GROUP BY 1, 2)"""


@query("WITH " + ASKED + ",\n" + SCORED + "\nSELECT query_id, doc_id, round(score, 6) + 0e0 AS score FROM sc")
def bm25_or(s: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(T.table(s, d, "documents"), "doc_id", {"text": 1.0}, _asked(s, d)).select("query_id", "doc_id", (F.round("score", 6) + 0.0).alias("score"))


PHRASES = """q AS (SELECT doc_id AS query_id, regexp_extract(text, '[A-Za-z]{3,} [a-z]{3,}', 0) AS text FROM documents WHERE doc_id % 100 = 0), qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM q)"""


@query("WITH " + PHRASES + ",\n" + SCORED + "\nSELECT query_id, doc_id, round(score, 6) + 0e0 AS score FROM sc WHERE terms = (SELECT count(*) FROM qt WHERE qt.query_id = sc.query_id)")
def bm25_and(s: SparkSession, d: str) -> DataFrame:
    """Documents with both words of a phrase: the first of two words in those whose id is divisible by 100."""
    docs = T.table(s, d, "documents")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.regexp_extract("text", "[A-Za-z]{3,} [a-z]{3,}", 0).alias("query"))
    return retrieval.bm25(docs, "doc_id", {"text": 1.0}, asked, every=True).select("query_id", "doc_id", (F.round("score", 6) + 0.0).alias("score"))


PAGES = """p AS (SELECT page_id, regexp_extract_all(lower(coalesce(url, '')), '[\\p{L}\\p{N}]+') AS u, regexp_extract_all(lower(coalesce(html, '')), '[\\p{L}\\p{N}]+') AS h FROM pages),
len AS (SELECT page_id, CAST(len(u) + len(h) AS DOUBLE) AS l FROM p), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(l) AS mean FROM len),
tf AS (SELECT page_id, term, sum(wt) AS tf FROM (SELECT page_id, unnest(u) AS term, 1e1 AS wt FROM p UNION ALL SELECT page_id, unnest(h), 1e0 FROM p) x WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY 1),
w AS (SELECT query_id, qt.term, CASE WHEN ln((n - df + 5e-1) / (df + 5e-1)) <= 0 THEN 1e-6 ELSE ln((n - df + 5e-1) / (df + 5e-1)) END AS idf FROM qt JOIN df ON df.term = qt.term, st),
sc AS (SELECT query_id, page_id, -sum(idf * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * l / mean))) AS score FROM tf JOIN w ON w.term = tf.term JOIN len USING (page_id), st GROUP BY 1, 2)"""


@query("WITH " + ASKED + ",\n" + PAGES + "\nSELECT query_id, page_id, round(score, 6) + 0e0 AS score FROM sc")
def bm25_fielded(s: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(T.table(s, d, "pages"), "page_id", {"url": 10.0, "html": 1.0}, _asked(s, d)).select("query_id", "page_id", (F.round("score", 6) + 0.0).alias("score"))


BACKOFF = """q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM benchmark),
tries AS (SELECT query_id, n, list_slice(t, 1, n) AS t FROM (SELECT *, unnest(range(2, len(t) + 1)) AS n FROM q WHERE len(t) >= 2) x),
qt AS (SELECT DISTINCT query_id, n, unnest(t) AS term FROM tries),
dt AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) x WHERE term IN (SELECT term FROM qt)),
m AS (SELECT query_id, n, doc_id, count(*) AS c FROM qt JOIN dt ON dt.term = qt.term GROUP BY 1, 2, 3),
ok AS (SELECT query_id, n, doc_id FROM m WHERE c = (SELECT count(*) FROM qt WHERE qt.query_id = m.query_id AND qt.n = m.n))"""


@query("WITH " + BACKOFF + "\nSELECT query_id, CAST(n AS INT) AS n_terms, doc_id FROM ok WHERE n = (SELECT max(n) FROM ok o WHERE o.query_id = ok.query_id)")
def bm25_backoff(s: SparkSession, d: str) -> DataFrame:
    """Every benchmark item as a query, on all documents."""
    return retrieval.backed_off(T.table(s, d, "documents"), "doc_id", {"text": 1.0}, _asked(s, d, every=True)).select("query_id", "n_terms", "doc_id")


COSINE = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cs AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(e.v, q.v) / (CASE WHEN list_dot_product(e.v, e.v) = 0 THEN 1 ELSE sqrt(list_dot_product(e.v, e.v)) END * CASE WHEN list_dot_product(q.v, q.v) = 0 THEN 1 ELSE sqrt(list_dot_product(q.v, q.v)) END) AS score FROM e, e q WHERE q.vec_id % 100 = 0),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) - 1 AS rank FROM cs)"""


def _near(s: SparkSession, d: str) -> DataFrame:
    vectors = T.table(s, d, "embeddings")
    return retrieval.nearest(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 30)


@query("WITH " + COSINE + "\nSELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM cr WHERE rank < 30")
def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    return _near(s, d)


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    lexical = retrieval.top(retrieval.bm25(T.table(s, d, "documents"), "doc_id", {"text": 1.0}, _asked(s, d)).withColumn("score", F.round("score", 6)), "doc_id", 30)
    return retrieval.rrf([lexical, _near(s, d).withColumnRenamed("vec_id", "doc_id")], "doc_id")


HYBRID = COSINE + ",\n" + ASKED + ",\n" + SCORED + """,
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6), doc_id) - 1 AS rank FROM sc),
hy AS (SELECT query_id, doc_id, sum(1e0 / (61 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM br WHERE rank < 30 UNION ALL SELECT query_id, vec_id, rank FROM cr WHERE rank < 30) x GROUP BY 1, 2)"""


@query("WITH " + HYBRID + "\nSELECT query_id, doc_id, round(score, 6) AS score FROM hy")
def rrf_hybrid(s: SparkSession, d: str) -> DataFrame:
    return _hybrid(s, d).withColumn("score", F.round("score", 6))


NESTED = HYBRID.replace("""FROM br WHERE rank < 30""", """FROM br WHERE rank < 30 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""").replace("""FROM cr WHERE rank < 30)""", """FROM cr WHERE rank < 30 AND vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))""") + """,
l1 AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY round(max(score), 9) DESC, node_id) - 1 AS rank FROM hy JOIN kg_claim c ON c.doc_id = hy.doc_id GROUP BY 1, 2),
rt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark WHERE item_id % 100 = 0),
hs AS (SELECT u.node_id, lower(concat(u.statement, ' data of ', n.title, ' ', u.node_id)) AS h FROM usable u JOIN kg_node n ON n.id = u.node_id AND n.revision = u.node_revision),
th AS (SELECT query_id, node_id, count(*) AS score FROM hs JOIN rt ON contains(h, term) GROUP BY 1, 2),
l2 AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1 AS rank FROM th),
ns AS (SELECT query_id, node_id, sum(1e0 / (61 + rank)) AS score FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) x GROUP BY 1, 2),
six AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS place FROM ns QUALIFY place <= 6),
lr AS (SELECT id, max(revision) AS revision FROM kg_node GROUP BY 1)"""


@query(with_kg(STRICT + ",\n" + NESTED + """
SELECT six.query_id, CAST(place AS INT) AS place, six.node_id, lr.revision, u.claim_id, s.evidence_id, e.reliability_grade FROM six JOIN lr ON lr.id = six.node_id JOIN usable u ON u.node_id = six.node_id AND u.node_revision = lr.revision
LEFT JOIN (SELECT s.* FROM kg_support s JOIN v ON v.claim_id = s.target_claim JOIN kg_audit_evidence x ON x.id = v.id AND x.evidence_id = s.evidence_id) s ON s.target_claim = u.claim_id AND s.target_node = six.node_id AND s.target_revision = lr.revision
LEFT JOIN kg_evidence e ON e.evidence_id = s.evidence_id"""))
def hybrid_trace(s: SparkSession, d: str) -> DataFrame:
    """The flagship: ranks by words and by vectors fused, and fused again with the hits of the query's words in usable claims. The
    first six nodes are traced, where they are usable, to their usable claims and the evidence that these were audited with."""
    docs = T.table(s, d, "documents")
    bad = T.table(s, d, "labels").where("quality = 0").select("doc_id")
    lexical = retrieval.top(retrieval.bm25(docs, "doc_id", {"text": 1.0}, _asked(s, d)).withColumn("score", F.round("score", 6)), "doc_id", 30)
    lists = [x.join(bad, "doc_id", "left_anti") for x in (lexical, _near(s, d).withColumnRenamed("vec_id", "doc_id"))]
    told = stored(_usable(s, d))
    claims = T.claims(s, d).select(F.expr("cast(substr(claim_id, 3) as long)").alias("doc_id"), "node_id")
    notes_ = retrieval.rrf(lists, "doc_id").join(claims, "doc_id").groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    asked = _asked(s, d).select("query_id", F.explode(X.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    data = T.nodes(s, d).select(F.col("id").alias("node_id"), F.col("revision").alias("node_revision"), "data")
    haystack = F.lower(F.concat_ws(" ", "statement", "data", "node_id"))
    hits = matching.term_scores(told.join(data, ["node_id", "node_revision"]), "node_id", haystack, asked)
    nested = retrieval.rrf([retrieval.reranked(notes_, "node_id"), retrieval.reranked(hits, "node_id")], "node_id")
    best = retrieval.reranked(nested, "node_id").where("rank < 6").select("query_id", (F.col("rank") + 1).alias("place"), "node_id")
    latest = T.nodes(s, d).groupBy(F.col("id").alias("node_id")).agg(F.max("revision").alias("revision"))
    traced = best.join(latest, "node_id").join(told.select("node_id", F.col("node_revision").alias("revision"), "claim_id"), ["node_id", "revision"])
    audits = policy.latest(T.validations(s, d), "claim_id", "id").select("claim_id", "id").join(told.select("claim_id"), "claim_id", "left_semi")
    seen = audits.join(T.audited_evidence(s, d).select("id", "evidence_id"), "id").select("claim_id", "evidence_id")
    proof = T.supports(s, d).select(F.col("target_node").alias("node_id"), F.col("target_revision").alias("revision"), F.col("target_claim").alias("claim_id"), "evidence_id").join(seen, ["claim_id", "evidence_id"])
    proof = proof.join(T.evidence(s, d).select("evidence_id", "reliability_grade"), "evidence_id", "left")
    return traced.join(proof, ["node_id", "revision", "claim_id"], "left").select("query_id", "place", "node_id", "revision", "claim_id", "evidence_id", "reliability_grade")


@query("WITH " + EVERY + ",\n" + SCORED + """,
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6), doc_id) - 1 AS rank FROM sc),
ex AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT ex.query_id, max(CASE WHEN rank < 6 THEN 1 ELSE 0 END) AS hit, round(count(*) FILTER (WHERE rank < 6) / CAST(count(*) AS DOUBLE), 6) AS recall FROM ex LEFT JOIN br ON br.query_id = ex.query_id AND br.doc_id = ex.doc_id GROUP BY 1""")
def recall_at_k(s: SparkSession, d: str) -> DataFrame:
    """How many of the documents that contain a benchmark item are among the first six for its words."""
    docs = T.table(s, d, "documents")
    expected = _found(s, d).select("query_id", "doc_id")
    ranked = retrieval.top(retrieval.bm25(docs, "doc_id", {"text": 1.0}, _asked(s, d, every=True)).withColumn("score", F.round("score", 6)), "doc_id", 6)
    return retrieval.hit_rates(ranked, expected, "doc_id", 6).withColumn("recall", F.round("recall", 6))


def _found(s: SparkSession, d: str) -> DataFrame:
    """All documents with all the benchmark items that they contain."""
    items = T.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return retrieval.containing(T.table(s, d, "documents"), "doc_id", items)


# --- claims and text -------------------------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
KEYED = f"""kc AS (SELECT claim_id, node_id, doc_id, list_filter(list_distinct(regexp_extract_all(lower(statement), '[a-z]{{4,}}')), lambda w: w NOT IN ({STOP})) AS ks FROM kg_claim),
nk AS (SELECT claim_id, len(ks) AS n, unnest(ks) AS k FROM kc WHERE doc_id % 5 = 0), ok AS (SELECT claim_id AS match_id, len(ks) AS n, unnest(ks) AS k FROM kc WHERE doc_id % 5 <> 0)"""


@query(with_kg(KEYED + """,
pr AS (SELECT claim_id, match_id, nk.n AS a, ok.n AS b, count(*) AS c FROM nk JOIN ok ON ok.k = nk.k GROUP BY 1, 2, 3, 4),
be AS (SELECT claim_id, match_id, c / CAST(a + b - c AS DOUBLE) AS sim FROM pr WHERE c / CAST(a + b - c AS DOUBLE) >= 45e-2 QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY c / CAST(a + b - c AS DOUBLE) DESC, match_id) = 1)
SELECT c.claim_id, match_id, round(coalesce(sim, 0), 6) AS similarity, CASE WHEN coalesce(sim, 0) >= 7e-1 THEN 'identical' WHEN coalesce(sim, 0) >= 45e-2 THEN 'similar' ELSE 'new' END AS verdict FROM kg_claim c LEFT JOIN be ON be.claim_id = c.claim_id WHERE c.doc_id % 5 = 0"""))
def keyword_jaccard_dedup(s: SparkSession, d: str) -> DataFrame:
    """Definitions as newly mined claims against all others."""
    every = T.claims(s, d)
    return C.duplicates(every.where("kind = 'definition'"), every.where("kind <> 'definition'"))


@query(with_kg(f"""kc AS (SELECT item_id AS claim_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')), lambda w: w NOT IN ({STOP})) AS ks FROM benchmark),
nw AS (SELECT DISTINCT id, k FROM (SELECT node_id AS id, unnest(regexp_extract_all(lower(statement), '[a-z]{{4,}}')) AS k FROM kg_claim WHERE kind = 'theorem') x WHERE k NOT IN ({STOP})),
a AS (SELECT claim_id, len(ks) AS n, unnest(ks) AS k FROM kc), b AS (SELECT id, count(*) OVER (PARTITION BY id) AS n, k FROM nw),
pr AS (SELECT claim_id, id, a.n AS x, b.n AS y, CAST(count(*) AS DOUBLE) AS c FROM a JOIN b ON a.k = b.k GROUP BY 1, 2, 3, 4),
sc AS (SELECT claim_id, id, greatest(c / x, c / y, (c / x + c / y) / 2) AS score FROM pr QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY greatest(c / x, c / y, (c / x + c / y) / 2) DESC, id) = 1)
SELECT claim_id, CASE WHEN score >= 35e-2 THEN id END AS node_id, round(score, 6) AS score FROM sc"""))
def attribution_score(s: SparkSession, d: str) -> DataFrame:
    nodes = T.claims(s, d).where("kind = 'theorem'").select(F.col("node_id").alias("id"), "statement")
    return C.attribution(T.table(s, d, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("statement")), nodes)


@query(with_kg("""SELECT evidence_id, CASE WHEN regexp_full_match(b, '10\\.[0-9]{4,9}/[^ \\t\\n\\r]+') THEN concat('doi:', b) END AS work FROM (SELECT evidence_id, trim(regexp_replace(lower(url_decode(trim(source_uri))), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '')) AS b FROM kg_evidence) x"""))
def canonical_work(s: SparkSession, d: str) -> DataFrame:
    return T.evidence(s, d).select("evidence_id", X.canonical_work(F.col("source_uri")).alias("work"))


@query("SELECT p_partkey, concat('F-', upper(substr(replace(replace(p_type, ' ', ''), '&', 'AND'), 1, 4))) AS field_id FROM part")
def field_id(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "part").select("p_partkey", X.field_id(F.col("p_type")).alias("field_id"))


QUOTES = """qd AS (SELECT b.item_id, d.doc_id, b.text AS quote, d.text FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


@query("WITH " + QUOTES + "\nSELECT b.item_id, qd.doc_id, qd.doc_id IS NOT NULL AND length(trim(b.text)) >= 20 AS verbatim FROM benchmark b LEFT JOIN qd ON qd.item_id = b.item_id")
def quote_validation(s: SparkSession, d: str) -> DataFrame:
    """Benchmark items as quotes, with every document that has them word by word, or none."""
    items = T.table(s, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    met = items.join(_found(s, d).select(F.col("query_id").alias("item_id"), "doc_id"), "item_id", "left")
    return met.select("item_id", "doc_id", (F.col("doc_id").isNotNull() & (F.length(F.trim("quote")) >= 20)).alias("verbatim"))


@query("WITH " + QUOTES + """,
cx AS (SELECT item_id, doc_id, quote, concat(regexp_extract(substr(text, 1, strpos(text, quote) - 1), '(?s)^(?:.*(?:\\. |\\n))?(.*)$', 1), quote) AS context FROM qd)
SELECT item_id, doc_id, md5(context) AS context, concat_ws(',', CASE WHEN regexp_matches(context, '(?i)\\b(analy[sz]ed|shown|proved|proposed|introduced)\\s+(further\\s+)?by\\b|\\bwho\\s+(have\\s+)?(shown|proved)\\b') THEN 'prior_work' END, CASE WHEN regexp_matches(quote, '(?i)^\\s*(this|that|these|those)\\s+(method|approach|auction|result|algorithm)') THEN 'cropped_antecedent' END) AS reasons FROM cx""")
def attribution_triage(s: SparkSession, d: str) -> DataFrame:
    quote, text = F.col("passage"), F.col("text")
    return _found(s, d).select(F.col("query_id").alias("item_id"), "doc_id", F.md5(X.sentence_context(quote, text)).alias("context"), F.array_join(X.attribution_reasons(quote, text), ",").alias("reasons"))


@query(with_kg("""SELECT evidence_id, CASE WHEN source_uri IS NULL THEN 'REJECTED' WHEN sc >= 6 THEN 'A' WHEN sc >= 4 THEN 'B' WHEN sc >= 3 THEN 'C' ELSE 'D' END AS grade FROM
(SELECT evidence_id, source_uri, 3e0 + CASE WHEN content_hash IS NOT NULL THEN 1e0 ELSE 0e0 END + CASE reliability_grade WHEN 'A' THEN 2e0 WHEN 'B' THEN 1e0 ELSE 0e0 END + CASE WHEN ascii(substr(content_hash, 1, 1)) > 57 THEN 1e0 ELSE 0e0 END + CASE WHEN origin_group = 'g1' THEN 5e-1 ELSE 0e0 END AS sc FROM kg_evidence) x"""))
def verification_grade(s: SparkSession, d: str) -> DataFrame:
    relevance = F.when(F.col("reliability_grade") == "A", "likely").when(F.col("reliability_grade") == "B", "possible")
    cited = F.when(F.ascii(F.substring("content_hash", 1, 1)) > 57, 11).otherwise(0)
    return T.evidence(s, d).select("evidence_id", X.grade(F.col("source_uri").isNotNull(), F.col("content_hash").isNotNull(), relevance, cited, F.col("origin_group") == "g1").alias("grade"))


@query("""WITH o AS (SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 10 <> 1), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 2 THEN concat(text, '!') ELSE text END) AS digest FROM documents WHERE doc_id % 10 <> 3)
SELECT coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' WHEN o.digest <> n.digest THEN 'update' ELSE 'skip' END AS action FROM o FULL JOIN n ON n.doc_id = o.doc_id""")
def manifest_diff(s: SparkSession, d: str) -> DataFrame:
    """All documents in two versions: some new, some changed, some gone."""
    docs = T.table(s, d, "documents").withColumnRenamed("doc_id", "path")
    old = docs.where("path % 10 <> 1").select("path", F.md5("text").alias("digest"))
    changed = F.when(F.col("path") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return notes.manifest_diff(old, docs.where("path % 10 <> 3").select("path", F.md5(changed).alias("digest")))


@query()
def chunks(s: SparkSession, d: str) -> DataFrame:
    cut = notes.chunks(T.table(s, d, "documents"), "doc_id", "text", notes.lecture)
    return cut.select("doc_id", "place", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '') AS title, nullif(trim(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)), '') AS heading, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages")
def html_metadata(s: SparkSession, d: str) -> DataFrame:
    part = lambda tag: F.nullif(F.trim(F.regexp_extract("html", tag, 1)), F.lit(""))
    return T.table(s, d, "pages").select("page_id", part("(?s)<title>(.*?)</title>").alias("title"), part("(?s)<h1[^>]*>(.*?)</h1>").alias("heading"), F.regexp_count("html", F.lit("<p[ >]")).alias("paragraphs"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) - 1 AS rank FROM conversations")
def turn_rank(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy(F.length("text").desc(), "turn")
    return T.table(s, d, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).alias("rank"))


# --- finite checks, events -------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT l_shipdate, l_returnflag, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT l_shipdate, n / sum(n) OVER (PARTITION BY l_shipdate) AS p FROM c)
SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, round(sum(-p * log2(p)), 6) AS entropy FROM p GROUP BY 1""")
def entropy(s: SparkSession, d: str) -> DataFrame:
    counted = T.table(s, d, "lineitem").groupBy("l_shipdate", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("l_shipdate"))
    return counted.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), p.alias("p")).groupBy("day").agg(F.round(F.sum(-F.col("p") * F.log2("p")), 6).alias("entropy"))


@query("SELECT event_id, concat('Q-', substr(sha256(concat(event_type, chr(31), CAST(user_id AS VARCHAR))), 1, 16)) AS question_id, event_type, CASE user_id % 10 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'seed' ELSE 'user' END AS origin FROM events")
def event_projection(s: SparkSession, d: str) -> DataFrame:
    return log.projected(T.events(s, d))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def activity_windows(s: SparkSession, d: str) -> DataFrame:
    # Local timestamps, so that no session zone moves an hour.
    return log.windows(T.table(s, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 20")
def recent_events(s: SparkSession, d: str) -> DataFrame:
    """The last 20 events (a report)."""
    last = T.events(s, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    return last.select("event_id", "event_type", F.row_number().over(W.orderBy(F.desc("ts"), F.desc("event_id"))).alias("place"))


# --- questions and plans ---------------------------------------------------------------------------------------------


def _rules(s: SparkSession, d: str) -> DataFrame:
    """Two groups of terms for each region: its name's first letters, and two short words."""
    region = T.table(s, d, "region").select(F.col("r_regionkey").cast("string").alias("claim_id"), F.lower(F.substring("r_name", 1, 2)).alias("head"))
    return region.select("claim_id", F.inline(F.array(*[F.struct(F.lit(g).alias("group"), t.alias("term")) for g, t in ((1, F.col("head")), (2, F.lit("the")), (2, F.lit("der")))])))


SCOPED = """ru AS (SELECT CAST(r_regionkey AS VARCHAR) AS claim_id, 1 AS g, lower(substr(r_name, 1, 2)) AS term FROM region UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 2, 'the' FROM region UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 2, 'der' FROM region),
sc2 AS (SELECT item_id AS query_id, claim_id FROM (SELECT item_id, claim_id, g, bool_or(contains(lower(text), term)) AS ok FROM benchmark, ru GROUP BY 1, 2, 3) x GROUP BY 1, 2 HAVING bool_and(ok))"""


def _scoped(s: SparkSession, d: str) -> DataFrame:
    return planning.in_scope(T.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), _rules(s, d))


@query("WITH " + SCOPED + "\nSELECT query_id, claim_id FROM sc2")
def scope_gate(s: SparkSession, d: str) -> DataFrame:
    return _scoped(s, d)


@query("WITH " + SCOPED + """,
ch AS (SELECT item_id AS query_id, CAST(item_id % 5 AS VARCHAR) AS claim_id FROM benchmark WHERE item_id % 3 <> 0),
m AS (SELECT query_id, list_sort(list(DISTINCT claim_id)) AS may FROM sc2 GROUP BY 1), p AS (SELECT query_id, list_sort(list(DISTINCT claim_id)) AS picked FROM ch GROUP BY 1),
b AS (SELECT coalesce(m.query_id, p.query_id) AS query_id, may, picked, CASE WHEN may IS NULL THEN 'nothing_in_scope' WHEN picked IS NULL THEN 'nothing_chosen' WHEN NOT list_has_all(may, picked) THEN 'outside_scope' ELSE 'answered' END AS status FROM m FULL JOIN p ON p.query_id = m.query_id)
SELECT query_id, status, CASE WHEN status = 'answered' THEN array_to_string(picked, ',') END AS claims FROM b""")
def scoped_answer(s: SparkSession, d: str) -> DataFrame:
    chosen = T.table(s, d, "benchmark").where("item_id % 3 <> 0").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 5).cast("string").alias("claim_id"))
    return planning.answer(_scoped(s, d), chosen)


@query("""WITH k AS (SELECT unnest(['ABSTRACTS_FROM', 'DERIVES_FROM', 'FORMALIZED_BY', 'HAS_SCOPED_INSTANCE', 'COMPLEMENTS']) AS t, generate_subscripts(['ABSTRACTS_FROM', 'DERIVES_FROM', 'FORMALIZED_BY', 'HAS_SCOPED_INSTANCE', 'COMPLEMENTS'], 1) AS i),
r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'derives from' WHEN 1 THEN 'scoped' WHEN 2 THEN event_type ELSE 'it complements this' END AS raw FROM events), u AS (SELECT event_id, replace(upper(trim(raw)), ' ', '_') AS p FROM r)
SELECT event_id, coalesce((SELECT arg_min(t, CASE WHEN t = p THEN 0 ELSE i END) FROM k WHERE contains(t, p) OR contains(p, t)), 'COMPLEMENTS') AS edge_type FROM u""")
def edge_types(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    raw = F.when(k == 0, "derives from").when(k == 1, "scoped").when(k == 2, F.col("event_type")).otherwise("it complements this")
    return T.table(s, d, "events").select("event_id", planning.edge_type(raw).alias("edge_type"))


@query("""WITH c AS (SELECT concat('S-', n_nationkey) AS id, n_name AS title FROM nation)
SELECT id AS id_a, NULL AS id_b, replace(unnest(['What is {a}?', 'Where does {a} fail?']), '{a}', title) AS question FROM c
UNION ALL SELECT a.id, b.id, replace(replace(unnest(['How do {a} and {b} differ?']), '{a}', a.title), '{b}', b.title) FROM c a JOIN c b ON a.id < b.id""")
def question_lattice(s: SparkSession, d: str) -> DataFrame:
    cards = T.table(s, d, "nation").select(F.concat(F.lit("S-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"))
    return planning.lattice(cards, ("What is {a}?", "Where does {a} fail?"), ("How do {a} and {b} differ?",))


@query("""WITH g AS (SELECT CAST(event_id AS VARCHAR) AS gap_id, CAST(user_id AS VARCHAR) AS card, user_id % 3 AS origin_rank, length(event_type) AS kind_rank, ts AS created FROM events),
f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY card ORDER BY origin_rank, kind_rank, created, gap_id) = 1), b AS (SELECT * FROM f ORDER BY origin_rank, kind_rank, created, gap_id LIMIT 12)
SELECT gap_id, card, concat('P-', substr(sha256((SELECT string_agg(gap_id, ',' ORDER BY gap_id) FROM b)), 1, 16)) AS plan_id FROM b""")
def growth_plan(s: SparkSession, d: str) -> DataFrame:
    """Twelve gaps to work on next (a report), one for each card."""
    found = T.table(s, d, "events").select(F.col("event_id").cast("string").alias("gap_id"), F.col("user_id").cast("string").alias("card"), (F.col("user_id") % 3).alias("origin_rank"), F.length("event_type").alias("kind_rank"), F.col("ts").alias("created"))
    return planning.plan(found, 12).select("gap_id", "card", "plan_id")


@query(with_kg("""lv AS (SELECT id, arg_max(title, revision) AS title FROM kg_node WHERE status <> 'superseded' GROUP BY 1),
sh AS (SELECT id, CASE WHEN length(title) > 12 THEN concat(substr(title, 1, 9), '...') ELSE title END AS label FROM lv)
SELECT edge_id, type, from_node, to_node, a.label AS from_label, b.label AS to_label FROM kg_edge JOIN sh a ON a.id = from_node JOIN sh b ON b.id = to_node"""))
def live_graph(s: SparkSession, d: str) -> DataFrame:
    return planning.live_graph(T.nodes(s, d), T.edges(s, d))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, json_extract_string(props, '$.k')) AS place FROM events GROUP BY 1")
def review_queue(s: SparkSession, d: str) -> DataFrame:
    counted = T.table(s, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "k")))


@query("SELECT page_id, n_nationkey FROM pages JOIN nation ON lower(html) LIKE concat('%', lower(substr(n_name, 1, 3)), '%')")
def like_join(s: SparkSession, d: str) -> DataFrame:
    """A page can match several names, and then has several rows; the names are a dimension of fixed size."""
    names = T.table(s, d, "nation").select("n_nationkey", F.concat(F.lit("%"), F.lower(F.substring("n_name", 1, 3)), F.lit("%")).alias("pattern"))
    return T.table(s, d, "pages").join(F.broadcast(names), F.expr("lower(html) like pattern")).select("page_id", "n_nationkey")
