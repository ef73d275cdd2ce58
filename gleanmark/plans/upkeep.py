"""Registered queries of the upkeep operators, with the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark import tables as T
from gleanmark.functions.text import tokens
from gleanmark.operators import quality, upkeep
from gleanmark.operators.graph import stored
from gleanmark.plans.catalog import query
from gleanmark.plans.kg_sql import with_kg

# --- indexes ---------------------------------------------------------------------------------------------------------

VERSIONS = """cur AS (SELECT page_id AS path, md5(html) AS digest FROM pages WHERE page_id % 11 <> 0),
man AS (SELECT page_id AS path, CASE WHEN page_id % 5 = 0 THEN md5(concat(html, '!')) ELSE md5(html) END AS digest FROM pages WHERE page_id % 7 <> 0)"""


def _versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = T.table(s, d, "pages").withColumnRenamed("page_id", "path")
    old = F.when(F.col("path") % 5 == 0, F.md5(F.concat("html", F.lit("!")))).otherwise(F.md5("html"))
    current = pages.where("path % 11 <> 0").select("path", F.md5("html").alias("digest"), F.md5("html").alias("content"))
    return pages.where("path % 7 <> 0").select("path", old.alias("digest")), current


@query("WITH " + VERSIONS + """
SELECT cur.path, cur.digest AS content, CASE WHEN man.digest = cur.digest THEN 'kept' ELSE 'written' END AS origin FROM cur LEFT JOIN man ON man.path = cur.path""")
def index_upsert(s: SparkSession, d: str) -> DataFrame:
    manifest, current = _versions(s, d)
    return upkeep.apply_upsert(manifest.select("path", F.col("digest").alias("content")), manifest, current)


@query("WITH " + VERSIONS + "\nSELECT man.path, man.digest, coalesce(cur.digest = man.digest, FALSE) AS usable FROM man LEFT JOIN cur ON cur.path = man.path")
def index_fresh(s: SparkSession, d: str) -> DataFrame:
    return upkeep.fresh(*_versions(s, d))


@query(with_kg("""SELECT evidence_id, source_uri FROM kg_evidence WHERE length(trim(coalesce(source_uri, ''))) > 0 AND content_hash IS NOT NULL AND coalesce(reliability_grade, 'C') <> 'C'"""))
def provenance_gate(s: SparkSession, d: str) -> DataFrame:
    """Evidence without an address, a digest of its content or a grade better than C isn't taken in."""
    graded = T.evidence(s, d).where(F.coalesce("reliability_grade", F.lit("C")) != "C")
    return upkeep.admitted(graded, ["source_uri", "content_hash"]).select("evidence_id", "source_uri")


@query("""WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS l FROM embeddings), t AS (SELECT doc_id, text AS now, CASE WHEN doc_id % 10 = 1 THEN concat(text, ' as it was') ELSE text END AS before FROM documents)
SELECT vec_id, round(CASE WHEN l = 0 THEN 1e0 ELSE l END, 5) AS norm, CASE WHEN vec_id % 3 <> 0 AND now = before THEN 'keep' ELSE 'embed' END AS action FROM n JOIN t ON doc_id = vec_id""")
def embedding_store(s: SparkSession, d: str) -> DataFrame:
    """Norms of the documents' stored vectors, a zero one counting as 1, and which have to be made anew as their text changed or was never stored."""
    vectors, docs = T.table(s, d, "embeddings"), T.table(s, d, "documents")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    before = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" as it was"))).otherwise(F.col("text"))
    known = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("path"), F.md5(before).alias("digest"))
    state = upkeep.fresh(docs.select(F.col("doc_id").alias("path"), F.md5("text").alias("digest")), known)
    return vectors.join(state.withColumnRenamed("path", "vec_id"), "vec_id").select("vec_id", F.round(F.when(norm == 0, 1.0).otherwise(norm), 5).alias("norm"), F.when(F.col("usable"), "keep").otherwise("embed").alias("action"))


# --- logs, ledgers and evidence ----------------------------------------------------------------------------------------


@query("SELECT l_partkey AS node, l_shipmode AS facet, max(l_discount) AS coverage, count(*) AS attempts FROM lineitem GROUP BY 1, 2".replace("l_shipmode", "l_returnflag"))
def facet_coverage(s: SparkSession, d: str) -> DataFrame:
    """Stored facets of parts, merged with later observations of them."""
    rows = T.table(s, d, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_returnflag").alias("facet"), F.col("l_discount").alias("coverage"), "l_linenumber")
    stored = rows.where("l_linenumber = 1").groupBy("node", "facet").agg(F.max("coverage").alias("coverage"), F.count(F.lit(1)).alias("attempts"))
    return upkeep.max_merge(stored, rows.where("l_linenumber <> 1"), ["node", "facet"])


@query("""SELECT user_id, event_type AS state, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) x WHERE r = 1""")
def mining_log(s: SparkSession, d: str) -> DataFrame:
    """A log with one row for each source, upserted by later runs."""
    runs = T.table(s, d, "events").select("user_id", "event_id", F.col("event_type").alias("state"), "value")
    first = upkeep.latest_upsert(runs.where("event_id % 2 = 0"), runs.where("event_id < 0"), "user_id", "event_id")
    return upkeep.latest_upsert(first, runs.where("event_id % 2 = 1"), "user_id", "event_id").select("user_id", "state", "value")


@query("SELECT l_linestatus AS state, count(*) AS n, round(sum(l_quantity), 2) AS extracted, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END), 2) AS fresh FROM lineitem GROUP BY 1")
def mining_totals(s: SparkSession, d: str) -> DataFrame:
    fresh = F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)
    return T.table(s, d, "lineitem").groupBy(F.col("l_linestatus").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("extracted"), F.round(F.sum(fresh), 2).alias("fresh"))


AMPLIFIED = """am AS (SELECT concat('C-', l.doc_id) AS claim_id, concat('E-', p.page_id) AS evidence_id, CASE p.page_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE NULL END AS grade, CASE WHEN l.toxic = 1 THEN 'irrelevant' ELSE 'likely' END AS relevance
FROM labels l JOIN pages p ON p.page_id = l.doc_id OR p.page_id = l.doc_id // 5)"""


@query(with_kg(AMPLIFIED + """
SELECT claim_id, evidence_id, grade FROM am WHERE grade IN ('A', 'B', 'C') AND relevance <> 'irrelevant' AND NOT EXISTS (SELECT 1 FROM kg_support s WHERE s.target_claim = am.claim_id AND s.evidence_id = am.evidence_id)"""))
def unlinked_evidence(s: SparkSession, d: str) -> DataFrame:
    """Evidence that was found for a claim, graded and relevant, and isn't linked to it yet."""
    k = F.col("doc_id")
    asked = T.table(s, d, "labels").select(k, "toxic", F.explode(F.array_distinct(F.array(k, F.expr("doc_id div 5")))).alias("page_id"))
    graded = T.evidence(s, d).select("evidence_id", F.col("reliability_grade").alias("grade"))
    met = asked.select(F.concat(F.lit("C-"), k.cast("string")).alias("claim_id"), F.concat(F.lit("E-"), F.col("page_id").cast("string")).alias("evidence_id"), F.when(F.col("toxic") == 1, "irrelevant").otherwise("likely").alias("relevance"))
    return upkeep.unlinked(met.join(graded, "evidence_id"), T.supports(s, d)).select("claim_id", "evidence_id", "grade")


@query("""WITH m AS (SELECT l_orderkey AS source, count(*) FILTER (WHERE l_linestatus = 'O') AS unresolved FROM lineitem GROUP BY 1)
SELECT source, unresolved FROM m WHERE unresolved > 0 AND source NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def unresolved_backlog(s: SparkSession, d: str) -> DataFrame:
    mined = T.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("source")).agg(F.count_if(F.col("l_linestatus") == "O").alias("unresolved"))
    return upkeep.backlog(mined, T.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("source")))


@query("""WITH f AS (SELECT page_id AS id, CASE WHEN page_id % 4 < 2 THEN url END AS doi, CASE page_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'REJECTED' WHEN 3 THEN 'D' END AS grade FROM pages)
SELECT id, doi, CASE WHEN grade IN ('A', 'B') THEN grade ELSE 'C' END AS grade FROM f WHERE doi IS NOT NULL AND coalesce(grade, '') <> 'REJECTED' AND id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def evidence_registration(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    grade = F.when(k % 5 == 0, "A").when(k % 5 == 1, "B").when(k % 5 == 2, "REJECTED").when(k % 5 == 3, "D")
    found = T.table(s, d, "pages").select(k.alias("id"), F.when(k % 4 < 2, F.col("url")).alias("doi"), grade.alias("grade"))
    return upkeep.register(found, T.table(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))).select("id", "doi", "grade")


@query(with_kg("""SELECT origin_group, count(*) AS n, count(*) FILTER (WHERE reliability_grade = 'A') AS a, count(*) FILTER (WHERE reliability_grade = 'B') AS b, count(*) FILTER (WHERE reliability_grade = 'C') AS c,
round(count(*) FILTER (WHERE reliability_grade IN ('A', 'B', 'C')) / CAST(count(*) AS DOUBLE), 6) AS acceptance, round(count(*) FILTER (WHERE reliability_grade IS NULL) / CAST(count(*) AS DOUBLE), 6) AS rejection FROM kg_evidence GROUP BY 1"""))
def acceptance(s: SparkSession, d: str) -> DataFrame:
    """Grades of each origin's evidence, and the shares accepted and rejected."""
    g, n = F.col("reliability_grade"), F.count(F.lit(1))
    each = [F.count_if(g == x).alias(x.lower()) for x in upkeep.GRADED]
    return T.evidence(s, d).groupBy("origin_group").agg(n.alias("n"), *each, F.round(F.count_if(g.isin(*upkeep.GRADED)) / n, 6).alias("acceptance"), F.round(F.count_if(g.isNull()) / n, 6).alias("rejection"))


@query("""WITH a AS (SELECT l_orderkey AS work, count(*) AS sources, count(nullif(l_suppkey % 4, 0)) AS told, count(DISTINCT nullif(l_suppkey % 4, 0)) AS different FROM lineitem GROUP BY 1)
SELECT work, CASE WHEN told = 0 THEN 'no_doi_from_any' WHEN told = 1 THEN 'single_source' WHEN different = 1 AND told = sources THEN 'unanimous' WHEN different = 1 THEN 'agreed' ELSE 'disagreement' END AS verdict FROM a""")
def source_agreement(s: SparkSession, d: str) -> DataFrame:
    told = F.nullif(F.col("l_suppkey") % 4, F.lit(0))
    met = T.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("work")).agg(F.count(F.lit(1)).alias("sources"), F.count(told).alias("told"), F.count_distinct(told).alias("different"))
    return met.select("work", upkeep.agreement(F.col("sources"), F.col("told"), F.col("different")).alias("verdict"))


@query("""WITH m AS (SELECT o_custkey AS subject, avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END) AS rejection, count(*) AS checked, avg(CASE WHEN o_orderstatus = 'P' THEN 1e0 ELSE 0e0 END) AS provisional, count(*) * 4 AS nodes, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS disputes, avg(CASE WHEN o_totalprice > 250000 THEN 1e0 ELSE 0e0 END) AS growth FROM orders GROUP BY 1)
SELECT subject, CASE WHEN checked > 5 AND rejection > 5e-1 THEN 'hallucination' WHEN nodes >= 50 AND provisional > 6e-1 THEN 'provisional' WHEN disputes > 10 THEN 'disputes' WHEN nodes >= 20 AND growth > 2e-1 THEN 'growth' END AS reason FROM m""")
def breaker_rules(s: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    m = T.table(s, d, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(share(F.col("o_orderstatus") == "F").alias("rejection"), F.count(F.lit(1)).alias("checked"), share(F.col("o_orderstatus") == "P").alias("provisional"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("disputes"), share(F.col("o_totalprice") > 250000).alias("growth"))
    c = F.col
    return m.select("subject", quality.breaker(c("rejection"), c("checked"), c("provisional"), c("checked") * 4, c("disputes"), c("growth")).alias("reason"))


RECENT = """cy AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) // 2 AS cycle FROM events),
re AS (SELECT *, count(*) OVER w AS runs, count(*) FILTER (WHERE value >= 20) OVER w AS successes FROM cy WINDOW w AS (PARTITION BY user_id ORDER BY cycle RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def _recent(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    cycle = F.floor(F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) / 2)
    return upkeep.recent(T.table(s, d, "events").select("user_id", "event_id", "value", cycle.alias("cycle")), "user_id", "cycle", F.col("value") >= 20)


@query("WITH " + RECENT + "\nSELECT user_id, event_id, runs, successes, least(1e0, (runs - 1) / 2e0) AS penalty, runs >= 6 AND successes = 0 AS stop FROM re")
def recent_runs(s: SparkSession, d: str) -> DataFrame:
    """What each run's subject did in the last five cycles."""
    return _recent(s, d).select("user_id", "event_id", "runs", "successes", "penalty", "stop")


@query("WITH " + RECENT + """,
pe AS (SELECT user_id, bool_or(runs >= 6 AND successes = 0) AS stop, avg(CASE WHEN value >= 1 THEN 1e0 ELSE 0e0 END) AS reach, bool_or(value > 90) AS red FROM re GROUP BY 1)
SELECT user_id, concat_ws(',', CASE WHEN reach < 8e-1 THEN 'reachability' END, CASE WHEN red THEN 'red' END, CASE WHEN stop THEN 'no_success' END) AS reasons FROM pe""")
def safety_reasons(s: SparkSession, d: str) -> DataFrame:
    per = _recent(s, d).groupBy("user_id").agg(F.bool_or("stop").alias("stop"), F.avg(F.when(F.col("value") >= 1, 1.0).otherwise(0.0)).alias("reach"), F.bool_or(F.col("value") > 90).alias("red"))
    return per.select("user_id", upkeep.safety(F.col("reach"), F.col("red"), F.col("stop")).alias("reasons"))


@query("SELECT o_custkey AS subject, count(*) AS gaps, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END), 6) AS fulfilment FROM orders GROUP BY 1")
def gap_fulfilment(s: SparkSession, d: str) -> DataFrame:
    resolved = F.avg((F.col("o_orderstatus") == "F").cast("double"))
    return T.table(s, d, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.count(F.lit(1)).alias("gaps"), F.round(resolved, 6).alias("fulfilment"))


@query("SELECT role, count(*) AS calls, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, max(turn) AS last_turn FROM conversations GROUP BY 1")
def usage_totals(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.max("turn").alias("last_turn"))


# --- validation and routing --------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_size % 5 = 0 THEN 'layer' END, CASE WHEN p_size % 7 = 0 THEN 'no_parent' WHEN s_suppkey IS NULL THEN 'unknown_parent' END, CASE WHEN p_size % 3 = 0 THEN 'no_edge' END, CASE WHEN length(p_name) < 10 THEN 'indistinct' END) AS faults
FROM part LEFT JOIN supplier ON s_suppkey = CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_partkey END""")
def node_validation(s: SparkSession, d: str) -> DataFrame:
    """Parts as new nodes below suppliers."""
    size = F.col("p_size")
    new = T.table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name", size, F.when(size % 7 != 0, F.col("p_partkey").cast("long")).alias("parent"))
    known = new.join(T.table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("parent"), F.lit(True).alias("known")), "parent", "left")
    layer, edge = F.when(size % 5 == 0, "nowhere").otherwise("science"), F.when(size % 3 != 0, "ABOUT")
    return known.select("id", upkeep.node_faults(layer, F.col("parent"), F.col("known"), edge, F.col("p_name")).alias("faults"))


@query("""WITH c AS (SELECT o_orderkey, o_custkey, count(*) AS n, bool_and(l_quantity >= 2) AS named, bool_and(l_suppkey % 10 <> o_custkey % 10) AS allowed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderkey AS run, n >= 1 AND n <= 8 AND named AND allowed AS ok FROM c""")
def candidate_shape(s: SparkSession, d: str) -> DataFrame:
    """Each order's lines as the candidates of a run; its customer may not draw on suppliers of the same last digit."""
    lines = T.table(s, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.when(F.col("l_quantity") >= 2, "named").otherwise(" ").alias("c"), (F.col("l_suppkey") % 10).cast("int").alias("src"))
    runs = lines.groupBy("run").agg(F.collect_list("c").alias("c"), F.collect_set("src").alias("src"))
    met = runs.join(T.table(s, d, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_custkey") % 10).cast("int").alias("own")), "run")
    allowed = F.array_except(F.sequence(F.lit(0), F.lit(9)), F.array("own"))
    return met.select("run", upkeep.shape_ok(F.col("c"), F.col("src"), allowed).alias("ok"))


ASKS = """qw AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(concat(p_type, ' ', p_name)), '[\\p{L}\\p{N}]+')) AS w FROM part),
lw AS (SELECT DISTINCT p_name AS label, unnest(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) AS w FROM part)"""


@query("WITH " + ASKS + "\nSELECT p_partkey, label FROM qw JOIN lw ON lw.w = qw.w GROUP BY 1, 2 HAVING count(*) >= 2")
def label_routing(s: SparkSession, d: str) -> DataFrame:
    """Items whose wording shares at least two words with a label: what they ask for is there already. There are few different labels."""
    part = T.table(s, d, "part")
    # Equal wordings are routed once, and by different words: what is shuffled and held doesn't grow with the items.
    wording = F.concat_ws(" ", "p_type", "p_name")
    asked = part.select(F.array_sort(F.array_distinct(tokens(wording))).alias("ws")).distinct()
    words = asked.select("ws", F.explode("ws").alias("w"))
    labels = part.select(F.col("p_name").alias("label")).distinct().select("label", F.explode(F.array_distinct(tokens(F.col("label")))).alias("w"))
    routes = stored(words.join(labels, "w").groupBy("ws", "label").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 2").groupBy("ws").agg(F.collect_list("label").alias("labels")))
    items = part.select("p_partkey", F.array_sort(F.array_distinct(tokens(wording))).alias("ws"))
    return items.join(routes, "ws").select("p_partkey", F.explode("labels").alias("label"))


@query("""SELECT c_nationkey AS domain FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0""")
def excluded_domains(s: SparkSession, d: str) -> DataFrame:
    """Domains that were used or rejected."""
    used = T.table(s, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("domain"))
    return used.union(T.table(s, d, "supplier").where("s_acctbal < 0").select("s_nationkey")).distinct()


@query("SELECT p_partkey AS item FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def coverage_gaps(s: SparkSession, d: str) -> DataFrame:
    """All items less those found."""
    found = T.table(s, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("item")).distinct()
    return T.table(s, d, "part").select(F.col("p_partkey").alias("item")).distinct().join(found, "item", "left_anti")


@query("""WITH l AS (SELECT p_name AS label, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS r FROM part) x WHERE r = 1)
SELECT DISTINCT p.p_partkey AS item, l.p_partkey AS origin FROM part p JOIN l ON l.label = p.p_name WHERE p.p_partkey <> l.p_partkey""")
def origin_links(s: SparkSession, d: str) -> DataFrame:
    """Each item and the latest one of the same label."""
    part = T.table(s, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("label"))
    latest = part.groupBy("label").agg(F.max("item").alias("origin"))
    return part.join(latest, "label").where("item <> origin").select("item", "origin").distinct()


@query(with_kg("SELECT n.id, n.revision, e.event_id FROM kg_node n JOIN events e ON n.id = concat('K-', e.event_id) WHERE e.event_type IN ('signup', 'view')"))
def node_creation(s: SparkSession, d: str) -> DataFrame:
    """Nodes with the events that made them, by id alone: each revision has each event."""
    made = T.table(s, d, "events").where("event_type in ('signup', 'view')").select(F.concat(F.lit("K-"), F.col("event_id").cast("string")).alias("id"), "event_id")
    return T.nodes(s, d).select("id", "revision").join(made, "id")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS m FROM events)
SELECT user_id, max(CASE WHEN r = 1 THEN event_type END) AS state, CAST(sum(m) AS BIGINT) AS changes FROM e GROUP BY 1""")
def card_states(s: SparkSession, d: str) -> DataFrame:
    """The state that the log leaves each card in."""
    return upkeep.state_of(T.table(s, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH x AS (SELECT l.doc_id, d.text, p.html, CASE WHEN l.doc_id % 4 = 0 THEN concat(d.text, ' reworded') ELSE d.text END AS old_text, CASE WHEN p.page_id % 6 = 1 THEN concat(p.html, ' ') ELSE p.html END AS old_html FROM labels l JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN pages p ON p.page_id = l.doc_id // 5)
SELECT doc_id, coalesce(doc_id % 9 <> 0 AND doc_id % 8 <> 5 AND text = old_text AND html = old_html, FALSE) AS reuse FROM x""")
def prior_validation(s: SparkSession, d: str) -> DataFrame:
    """Checks that needn't run again: the same checker, evidence and claim were checked before, by the digests of their contents."""
    k, page = F.col("doc_id"), F.col("page_id")
    rows = T.table(s, d, "labels").select("doc_id", F.expr("doc_id div 5").alias("page_id")).join(T.table(s, d, "documents").select("doc_id", "text"), "doc_id").join(T.table(s, d, "pages").select("page_id", "html"), "page_id", "left")
    told = lambda df, checker, html, text: df.select(k, F.sha2(checker, 256).alias("checker"), F.sha2(html, 256).alias("evidence"), F.sha2(text, 256).alias("claim"))
    wanted = told(rows, F.lit("checker 2"), F.col("html"), F.col("text"))
    checker = F.when(k % 8 == 5, "checker 1").otherwise("checker 2")
    known = told(rows.where(k % 9 != 0), checker, F.when(page % 6 == 1, F.concat("html", F.lit(" "))).otherwise(F.col("html")), F.when(k % 4 == 0, F.concat("text", F.lit(" reworded"))).otherwise(F.col("text")))
    return upkeep.reusable(wanted, known, ["checker", "evidence", "claim"], "doc_id").select("doc_id", "reuse")


@query("SELECT o_orderkey AS item, o_clerk AS made_by FROM orders".replace("o_clerk AS made_by", "CASE WHEN o_custkey % 7 = 0 THEN 'failed' ELSE 'open' END AS state") + " WHERE NOT (o_custkey % 7 = 0 AND o_orderpriority LIKE '5%')")
def quarantine(s: SparkSession, d: str) -> DataFrame:
    """What an invalid run made goes; its other rows are marked failed."""
    bad = F.col("o_custkey") % 7 == 0
    kept = T.table(s, d, "orders").where(~(bad & F.col("o_orderpriority").like("5%")))
    return kept.select(F.col("o_orderkey").alias("item"), F.when(bad, "failed").otherwise("open").alias("state"))


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 10 OFFSET 5")
def batch_slice(s: SparkSession, d: str) -> DataFrame:
    """One batch of a fixed order; a slice is what this operator is."""
    return T.table(s, d, "benchmark").orderBy("item_id").offset(5).limit(10).select("item_id", "text")


@query("""SELECT DISTINCT conv_id, part AS card, CAST(min(place) AS INT) AS rank FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS part, generate_subscripts(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 1) - 1 AS place FROM conversations WHERE role = 'user' AND turn = 0) x GROUP BY 1, 2""")
def activations(s: SparkSession, d: str) -> DataFrame:
    """A query log's activated cards with their first ranks, from 0."""
    asked = T.table(s, d, "conversations").where("role = 'user' and turn = 0")
    return asked.select("conv_id", F.posexplode(tokens(F.col("text"))).alias("place", "card")).groupBy("conv_id", "card").agg(F.min("place").cast("int").alias("rank"))


@query("""WITH w AS (SELECT item_id, b.text AS claim, p.html AS source, regexp_extract_all(lower(b.text), '[a-z]{4,}') AS ws FROM benchmark b JOIN pages p ON p.page_id = b.item_id),
s AS (SELECT item_id, len(ws) AS n, len(list_filter(ws, lambda x: contains(lower(source), x))) AS c FROM w)
SELECT item_id, CASE WHEN n = 0 THEN 'unknown' WHEN c / CAST(n AS DOUBLE) >= 4e-1 THEN 'likely' WHEN c / CAST(n AS DOUBLE) >= 2e-1 THEN 'possible' ELSE 'unlikely' END AS relevance FROM s""")
def relevance_bucket(s: SparkSession, d: str) -> DataFrame:
    claims = T.table(s, d, "benchmark").select("item_id", F.col("text").alias("claim"))
    return claims.join(T.table(s, d, "pages"), F.col("page_id") == F.col("item_id")).select("item_id", upkeep.relevance(F.col("claim"), F.col("html")).alias("relevance"))
