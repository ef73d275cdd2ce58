"""The derived knowledge graph as SQL, for the statements that check the queries."""

KG = """
kg_node AS (
  SELECT concat('B-', r_regionkey) AS id, 1 AS revision, 'foundation' AS layer, 'FormalPrinciple' AS type, 'THM' AS subtype, 'approved' AS status, r_name AS title FROM region
  UNION ALL SELECT concat('S-', n_nationkey), 1, 'science', 'ScopedLaw', CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'LAW' END, CASE n_nationkey % 5 WHEN 0 THEN 'superseded' WHEN 1 THEN 'proposed' ELSE 'approved' END, n_name FROM nation
  UNION ALL SELECT concat('K-', p_partkey), 1, 'science', CASE WHEN p_partkey % 11 = 0 THEN 'Question' ELSE 'Theory' END, CASE p_partkey % 7 WHEN 0 THEN 'HYP' WHEN 1 THEN NULL ELSE 'THY' END, CASE p_partkey % 6 WHEN 0 THEN 'stale' WHEN 1 THEN 'proposed' ELSE 'approved' END, p_name FROM part
  UNION ALL SELECT concat('K-', p_partkey), 2, 'science', 'Theory', 'THY', 'approved', p_name FROM part WHERE p_partkey % 10 = 0
  UNION ALL SELECT concat('U-', s_suppkey), 1, 'universe', 'WorldModel', 'WM', 'approved', s_name FROM supplier
  UNION ALL SELECT concat('P-', c_custkey), 1, 'practice', 'Question', 'Q', CASE WHEN c_custkey % 8 = 0 THEN 'superseded' ELSE 'approved' END, c_name FROM customer),
kg_edge AS (
  SELECT concat('e-nr-', n_nationkey) AS edge_id, 'ABSTRACTS_FROM' AS type, concat('S-', n_nationkey) AS from_node, 1 AS from_revision, concat('B-', n_regionkey) AS to_node, 1 AS to_revision, CASE WHEN n_nationkey % 3 = 0 THEN 'proof' ELSE NULL END AS derivation_ref, (5 + n_nationkey % 5) / 1e1 AS confidence FROM nation
  UNION ALL SELECT concat('e-sn-', s_suppkey), 'DERIVES_FROM', concat('U-', s_suppkey), 1, concat('S-', s_nationkey), 1, NULL, (5 + s_suppkey % 5) / 1e1 FROM supplier
  UNION ALL SELECT concat('e-ps-', l_partkey, '-', l_suppkey), 'HAS_SCOPED_INSTANCE', concat('K-', l_partkey), 1, concat('U-', l_suppkey), 1, NULL, (5 + l_partkey % 5) / 1e1 FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1) x
  UNION ALL SELECT concat('e-cn-', c_custkey), 'ABOUT', concat('P-', c_custkey), 1, concat('S-', c_nationkey), 1, NULL, (5 + c_custkey % 5) / 1e1 FROM customer WHERE c_custkey % 2 = 0),
kg_claim AS (
  SELECT concat('C-', doc_id) AS claim_id, concat('K-', 1 + doc_id // 3) AS node_id, 1 AS node_revision, text AS statement, CASE doc_id % 5 WHEN 0 THEN 'definition' WHEN 1 THEN 'theorem' WHEN 2 THEN 'application_hypothesis' ELSE 'empirical' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'formally_verified' WHEN 1 THEN 'source_supported' WHEN 2 THEN 'contradicted' ELSE 'unverified' END AS epistemic_status, lang AS assumptions, doc_id FROM documents),
kg_evidence AS (
  SELECT concat('E-', page_id) AS evidence_id, CASE page_id % 4 WHEN 0 THEN concat('doi:10.1000/', page_id) WHEN 1 THEN concat('https://doi.org/10.1000/', page_id - 1) WHEN 2 THEN url ELSE NULL END AS source_uri, CASE WHEN page_id % 9 = 0 THEN NULL ELSE md5(html) END AS content_hash, concat('g', page_id % 7) AS origin_group, CASE page_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE NULL END AS reliability_grade FROM pages),
kg_support AS (
  SELECT concat('SA-', doc_id) AS assessment_id, concat('E-', doc_id // 5) AS evidence_id, concat('K-', 1 + doc_id // 3) AS target_node, 1 AS target_revision, concat('C-', doc_id) AS target_claim, CASE WHEN quality = 1 THEN 'evidence_miner' ELSE 'reviewer' END AS assessor FROM labels
  UNION ALL SELECT concat('SB-', doc_id), concat('E-', doc_id // 4), concat('K-', 1 + doc_id // 3), 1, concat('C-', doc_id), 'reviewer' FROM labels WHERE doc_id % 2 = 0),
kg_emark AS (
  SELECT evidence_id, sha256(concat_ws(chr(31), evidence_id, coalesce(source_uri, chr(30)), coalesce(content_hash, chr(30)), coalesce(origin_group, chr(30)), coalesce(reliability_grade, chr(30)))) AS mark FROM kg_evidence),
kg_lineage AS (
  SELECT evidence_id, CASE WHEN k % 8 <> 5 THEN origin_group END AS independent_group, CASE WHEN k % 6 = 1 THEN 'unreviewed' ELSE 'confirmed' END AS independence_review, CASE WHEN k % 10 = 4 THEN 'old' ELSE mark END AS metadata_fingerprint
  FROM (SELECT e.*, m.mark, CAST(substr(e.evidence_id, 3) AS BIGINT) AS k FROM kg_evidence e JOIN kg_emark m ON m.evidence_id = e.evidence_id) x),
kg_origin AS (
  SELECT l.evidence_id, independent_group FROM kg_lineage l JOIN kg_emark m ON m.evidence_id = l.evidence_id WHERE independence_review = 'confirmed' AND coalesce(independent_group, '') <> '' AND metadata_fingerprint = mark),
kg_asset AS (SELECT concat('notes/', page_id) AS path, sha256(html) AS sha256 FROM pages),
kg_mark AS (
  SELECT c.claim_id, sha256(concat_ws(chr(31), c.claim_id, c.node_id, CAST(c.node_revision AS VARCHAR), coalesce(c.statement, chr(30)), c.kind, coalesce(c.assumptions, chr(30)), n.status, coalesce(n.subtype, chr(30)), concat('data of ', n.title))) AS mark
  FROM kg_claim c JOIN kg_node n ON n.id = c.node_id AND n.revision = c.node_revision),
kg_audited AS (SELECT c.*, m.mark, l.doc_id AS k FROM kg_claim c JOIN kg_mark m ON m.claim_id = c.claim_id JOIN labels l ON c.doc_id = l.doc_id),
kg_validation AS (
  SELECT 2 * k AS id, claim_id, 'deferred' AS decision, epistemic_status AS validated_state, mark AS fingerprint, 'v2' AS policy, 'all' AS scope FROM kg_audited
  UNION ALL SELECT 2 * k + 1, claim_id, CASE WHEN k % 6 = 5 THEN 'deferred' ELSE 'passed' END, epistemic_status, CASE WHEN k % 7 = 3 THEN sha256(concat('old', claim_id)) ELSE mark END, CASE WHEN k % 11 = 4 THEN 'v1' ELSE 'v2' END, CASE WHEN k % 19 = 1 THEN '' WHEN k % 19 <> 2 THEN 'all' END FROM kg_audited),
kg_audit_evidence AS (
  SELECT id, s.evidence_id, CASE WHEN k % 13 = 6 THEN 'old' ELSE mark END AS fingerprint FROM (SELECT DISTINCT 2 * doc_id + 1 AS id, doc_id AS k, concat('E-', unnest([doc_id // 5, CASE WHEN doc_id % 17 = 4 THEN 0 ELSE doc_id // 5 END])) AS evidence_id FROM labels) s LEFT JOIN kg_emark m ON m.evidence_id = s.evidence_id),
kg_audit_asset AS (
  SELECT 2 * doc_id + 1 AS id, CASE WHEN doc_id % 29 = 3 THEN concat('../notes/', doc_id // 5) ELSE concat('notes/', doc_id // 5) END AS path, CASE WHEN doc_id % 23 = 5 THEN 'old' ELSE a.sha256 END AS sha256 FROM labels LEFT JOIN kg_asset a ON a.path = concat('notes/', doc_id // 5)),
kg_claim_edge AS (
  SELECT concat('e-cc-', c_custkey) AS edge_id, 'COMPLEMENTS' AS type, concat('K-', 1 + c_custkey // 7) AS from_node, 1 AS from_revision, CASE WHEN c_custkey % 31 <> 5 THEN concat('C-', 3 * (c_custkey // 7) + c_custkey % 3) END AS from_claim,
  concat('K-', 1 + c_custkey // 5) AS to_node, 1 AS to_revision, CASE WHEN c_custkey % 37 <> 6 THEN concat('C-', 3 * (c_custkey // 5) + (c_custkey // 2) % 3) END AS to_claim,
  CASE WHEN c_custkey % 13 = 2 THEN '[HYP_EDGE] looks alike' WHEN c_custkey % 13 <> 3 THEN 'both say so' END AS rationale, c_custkey AS k FROM customer),
kg_edge_review AS (
  SELECT edge_id, CASE WHEN k % 11 = 3 THEN 'candidate' ELSE 'validated' END AS status,
  CASE WHEN k % 9 = 4 THEN 'old' ELSE sha256(concat_ws(chr(31), edge_id, type, from_node, from_revision, coalesce(from_claim, chr(30)), to_node, to_revision, coalesce(to_claim, chr(30)), coalesce(rationale, chr(30)), chr(30))) END AS fingerprint FROM kg_claim_edge WHERE k % 17 <> 6),
kg_edge_mark AS (
  SELECT edge_id, sha256(concat_ws(chr(31), edge_id, type, from_node, from_revision, coalesce(from_claim, chr(30)), to_node, to_revision, coalesce(to_claim, chr(30)), coalesce(rationale, chr(30)), chr(30))) AS mark FROM kg_claim_edge)
"""


def with_kg(body: str, recursive: bool = False) -> str:
    """``body`` begins with further named queries, or with SELECT."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    return head + KG.strip() + (" " if body.upper().startswith("SELECT") else ",\n") + body
