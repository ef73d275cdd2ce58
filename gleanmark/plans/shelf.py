"""Queries of cards, courses, histories and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark import tables as T
from gleanmark.operators import cards
from gleanmark.plans.catalog import LEDGER, _ledger, query
from gleanmark.plans.kg_sql import with_kg

FOLDERS = """f AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat('How We Teach (', p_size, '): MIT ', p_partkey % 31, '.', p_size, ' ', p_name) WHEN 1 THEN concat('RES.', p_partkey % 40, '-00', p_size, ' ', p_partkey % 9, '.1') WHEN 2 THEN concat('MIT ', p_partkey % 30, 'A.', p_size) WHEN 3 THEN concat('mit ', p_partkey % 28, '.', p_size, ' x') ELSE p_name END AS folder FROM part)"""


@query("WITH " + FOLDERS + """,
d AS (SELECT CAST(n_nationkey AS VARCHAR) AS dept, n_name AS discipline, r_name AS broad FROM nation JOIN region ON r_regionkey = n_regionkey),
c AS (SELECT p_partkey, folder, 0 AS place, upper(regexp_extract(folder, '(?i)How We Teach[^:]*[:：]\\s*(?:MIT\\s+)?(\\d{1,2}[A-Z]?)\\.', 1)) AS dept FROM f
UNION ALL SELECT p_partkey, folder, 1, regexp_extract(folder, '(?i)RES\\.(\\d{1,2})', 1) FROM f UNION ALL SELECT p_partkey, folder, 2, upper(regexp_extract(folder, '(?i)(?:MIT\\s+)?(\\d{1,2}[A-Z]?)\\.', 1)) FROM f),
m AS (SELECT c.*, CASE WHEN place = 1 THEN concat(discipline, ' (Supplemental)') ELSE discipline END AS discipline, broad FROM c JOIN d ON d.dept = c.dept QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY place) = 1)
SELECT f.p_partkey, m.dept, m.discipline, m.broad FROM f LEFT JOIN m ON m.p_partkey = f.p_partkey""")
def course_classes(s: SparkSession, d: str) -> DataFrame:
    """Parts as course folders, nations as departments."""
    k, size, text = F.col("p_partkey"), F.col("p_size").cast("string"), lambda n: (F.col("p_partkey") % n).cast("string")
    folder = (
        F.when(k % 5 == 0, F.concat(F.lit("How We Teach ("), size, F.lit("): MIT "), text(31), F.lit("."), size, F.lit(" "), F.col("p_name")))
        .when(k % 5 == 1, F.concat(F.lit("RES."), text(40), F.lit("-00"), size, F.lit(" "), text(9), F.lit(".1")))
        .when(k % 5 == 2, F.concat(F.lit("MIT "), text(30), F.lit("A."), size))
        .when(k % 5 == 3, F.concat(F.lit("mit "), text(28), F.lit("."), size, F.lit(" x")))
        .otherwise(F.col("p_name"))
    )
    departments = T.table(s, d, "nation").join(T.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("dept"), F.col("n_name").alias("discipline"), F.col("r_name").alias("broad"))
    return cards.classified(T.table(s, d, "part").select(k, folder.alias("folder")), departments).select("p_partkey", "dept", "discipline", "broad")


@query("""WITH n AS (SELECT doc_id, concat('---', chr(10), 'id: K-', lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0'), chr(10), CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('status: ', CASE WHEN doc_id % 2 = 0 THEN '"draft"' ELSE 'candidate' END, chr(10)) END, '---', chr(10), coalesce(text, ''), chr(10), 'status: open') AS note FROM documents)
SELECT doc_id, regexp_extract(note, 'K-\\d{4}', 0) AS card, regexp_extract(note, '(?m)^status:\\s*["'']?(\\w+)', 1) AS before, md5(regexp_replace(note, '(?m)^(status:\\s*)["'']?\\w+["'']?', '\\1"accepted"')) AS after FROM n""")
def status_rewrite(s: SparkSession, d: str) -> DataFrame:
    """Documents as notes, with or without a status in their headers, that are accepted."""
    k = F.col("doc_id")
    status = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("status: "), F.when(k % 2 == 0, '"draft"').otherwise("candidate"), F.lit("\n")))
    note = F.concat(F.lit("---\nid: K-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("\n"), status, F.lit("---\n"), F.coalesce("text", F.lit("")), F.lit("\nstatus: open"))
    return T.table(s, d, "documents").select(k, cards.card_id(note).alias("card"), cards.status_of(note).alias("before"), F.md5(cards.with_status(note, F.lit("accepted"))).alias("after"))


@query(with_kg("""SELECT n.id, max(n.revision) AS revision, count(DISTINCT c.claim_id) AS claims, coalesce(string_agg(DISTINCT c.claim_id, ',' ORDER BY c.claim_id), '') AS ids FROM kg_node n LEFT JOIN kg_claim c ON c.node_id = n.id GROUP BY 1"""))
def nested_claims(s: SparkSession, d: str) -> DataFrame:
    told = cards.nested(T.nodes(s, d), T.claims(s, d))
    return told.select("id", "revision", F.size("claims").alias("claims"), F.array_join(F.transform("claims", lambda c: c["claim_id"]), ",").alias("ids"))


@query("SELECT user_id, string_agg(concat(event_type, '/', event_id % 3), ' ' ORDER BY ts, event_id) AS events FROM events GROUP BY 1")
def entity_history(s: SparkSession, d: str) -> DataFrame:
    rows = T.table(s, d, "events").withColumn("actor", (F.col("event_id") % 3).cast("string"))
    told = cards.history(rows, "user_id", ["ts", "event_id"])
    return told.select("user_id", F.array_join(F.transform("events", lambda e: F.concat_ws("/", e["event_type"], e["actor"])), " ").alias("events"))


@query("""WITH f AS (SELECT page_id, sha256(html) AS sha256, CASE WHEN page_id % 6 = 0 THEN ' ' ELSE html END AS text FROM pages WHERE html IS NOT NULL)
SELECT substr(sha256, 1, 16) AS id, min(concat('p/', lpad(CAST(page_id AS VARCHAR), 12, '0'))) AS path, arg_min(CASE WHEN trim(text) = '' THEN 'needs_ocr' ELSE 'needs_topic_extraction' END, page_id) AS state FROM f WHERE substr(sha256, 1, 16) NOT IN (SELECT substr(sha256, 1, 16) FROM f WHERE page_id % 4 = 0) GROUP BY 1""")
def extraction_queue(s: SparkSession, d: str) -> DataFrame:
    """Pages as files; each fourth is in the queue already."""
    files = T.table(s, d, "pages").where("html is not null").select("page_id", F.concat(F.lit("p/"), F.lpad(F.col("page_id").cast("string"), 12, "0")).alias("path"), F.col("html").alias("content"), F.when(F.col("page_id") % 6 == 0, " ").otherwise(F.col("html")).alias("text"))
    known = files.where("page_id % 4 = 0").select(F.substring(F.sha2("content", 256), 1, 16).alias("id"))
    return cards.queued(files, known).select("id", "path", "state")


@query(with_kg(LEDGER + """
SELECT substr(fingerprint, 1, 8) AS gap_id, md5(CASE gap_type WHEN 'unsupported_claim' THEN concat('academic evidence for: ', coalesce(statement, anchor_claim)) WHEN 'missing_instance' THEN concat('concrete examples and case studies of: ', anchor_node) ELSE concat('evidence justifying the relationship ', anchor_claim) END) AS topic FROM gap LEFT JOIN kg_claim c ON c.claim_id = anchor_claim"""))
def gap_topics(s: SparkSession, d: str) -> DataFrame:
    """What to look for, for every gap of the ledger."""
    told = _ledger(s, d).join(T.claims(s, d).select(F.col("claim_id").alias("anchor_claim"), "statement"), "anchor_claim", "left")
    topic = cards.gap_topic(F.col("gap_type"), F.col("anchor_node"), F.col("anchor_claim"), F.col("statement"))
    return told.select("gap_id", F.md5(topic).alias("topic"))
