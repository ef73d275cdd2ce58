"""Queries of streams, sources, the versioned store and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark import tables as T
from gleanmark.functions import text as X
from gleanmark.operators import gaps, planning, policy
from gleanmark.operators.graph import scratch, width
from gleanmark.plans.catalog import CLAIM_EDGES, STRICT, _usable, query
from gleanmark.plans.kg_sql import with_kg
from gleanmark.sources import readers, versioned
from gleanmark.streaming import ledger


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'linked' WHEN event_type = 'signup' THEN 'reopen' WHEN event_type = 'error' THEN 'nothing' WHEN event_type = 'click' AND event_id % 7 = 0 THEN 'candidates' END AS outcome, value,
row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, CAST(NULL AS BIGINT) AS event_id, 'open' AS state, 0 AS attempts, 0 AS low_run, FALSE AS tripped, CAST(0 AS BIGINT) AS n FROM o GROUP BY 1
UNION ALL SELECT o.user_id, o.event_id, CASE WHEN outcome = 'reopen' THEN 'open' WHEN outcome IS NULL OR state NOT IN ('open', 'retry_wait') THEN state WHEN outcome = 'linked' THEN 'resolved' WHEN outcome = 'candidates' THEN 'candidate_ready' WHEN attempts + 1 >= 3 THEN 'exhausted' ELSE 'retry_wait' END,
CASE WHEN outcome = 'reopen' THEN 0 WHEN outcome IS NULL OR state NOT IN ('open', 'retry_wait') THEN attempts ELSE attempts + 1 END,
CASE WHEN value IS NULL THEN low_run WHEN value < 40 THEN low_run + 1 ELSE 0 END, tripped OR (value < 40 AND low_run + 1 >= 3), o.n FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id, event_id, state, attempts, low_run, tripped, FALSE AS late FROM f WHERE n > 0""")
def ledger_stream(s: SparkSession, d: str) -> DataFrame:
    """The event log read as a stream: each user's gap and low-yield run after every event."""
    events = s.readStream.schema(T.table(s, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern, as the table may be one file
    told = ledger.run(s, ledger.outcomes(events), scratch(s, "ledger"), scratch(s, "stream"))
    return told.withColumnRenamed("key", "user_id")


@query("""SELECT concat('folder ', page_id % 60) AS folder, arg_max(concat('dept ', page_id % 7), page_id) AS dept, arg_max(concat('field ', page_id % 5), page_id) AS discipline, arg_max(concat('side ', page_id % 3), page_id) AS broad FROM pages WHERE page_id % 9 NOT IN (4, 5) GROUP BY 1""")
def vote_files(s: SparkSession, d: str) -> DataFrame:
    """Votes on folders, written as text files with comments and broken lines among them, and read back; a later vote counts."""
    k = F.col("page_id")
    part = lambda name, n: F.concat(F.lit(f" {name} "), (k % n).cast("string"))
    line = F.concat_ws("|", part("folder", 60), part("dept", 7), part("field", 5), part("side", 3))
    told = F.when(k % 9 == 4, F.concat(F.lit("# "), line)).when(k % 9 == 5, F.substring_index(line, "|", 3)).otherwise(line)
    path = scratch(s, "votes")
    T.table(s, d, "pages").select(k, told.alias("value")).repartitionByRange(5, "page_id").sortWithinPartitions("page_id").select("value").write.text(path)
    readers.register(s)
    return readers.last_votes(s.read.format("votes").load(path))


@query("""WITH t AS (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS quote FROM conversations WHERE turn % 5 <> 4)
SELECT concat('talk:', conv_id) AS source_id, concat('turn ', turn) AS title, concat('https://example.org/', conv_id) AS url, concat(conv_id, '-', turn) AS video_id, md5(quote) AS quote FROM t WHERE quote <> ''""")
def search_blocks(s: SparkSession, d: str) -> DataFrame:
    """Turns as blocks of printed search results, read back; blocks without an address, or without a quote, aren't evidence."""
    c = F.col
    url = F.when(c("turn") % 5 == 4, "unknown").otherwise(F.concat(F.lit("https://example.org/"), c("conv_id").cast("string")))
    block = F.concat(F.lit("--- SOURCE 1 [talk:"), c("conv_id").cast("string"), F.lit("] ---\nTITLE: turn "), c("turn").cast("string"), F.lit("\nURL: "), url, F.lit("\nVIDEO_ID: "), F.concat_ws("-", c("conv_id").cast("string"), c("turn").cast("string")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    path = scratch(s, "blocks")
    T.table(s, d, "conversations").select(block).write.text(path)
    readers.register(s)
    return s.read.format("search_output").load(path).select("source_id", "title", "url", "video_id", F.md5("quote").alias("quote"))


@query(with_kg("""after AS (SELECT id, revision, CASE WHEN status = 'proposed' AND hash_free % 2 = 0 THEN 'approved' ELSE status END AS now, status FROM (SELECT *, length(id) AS hash_free FROM kg_node) x)
SELECT 0 AS version, status, count(*) AS n, (SELECT count(*) FROM kg_node) AS events FROM kg_node GROUP BY 2
UNION ALL SELECT 1, now, count(*), (SELECT count(*) FROM after) + (SELECT count(*) FROM after WHERE now <> status) FROM after GROUP BY 2"""))
def status_history(s: SparkSession, d: str) -> DataFrame:
    """All nodes committed to a store, some then given another status, both with their events; each version is read again."""
    store, nodes = versioned.Store(scratch(s, "store")), T.nodes(s, d)
    versioned.add_nodes(s, store, "first", nodes)
    changes = nodes.where((F.col("status") == "proposed") & (F.length("id") % 2 == 0)).select("id", "revision", F.lit("approved").alias("new_status"))
    for _ in range(2):  # run again, it changes nothing
        versioned.set_status(s, store, "second", changes)
    counted = [versioned.read(s, store, "node", v).groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(v)).crossJoin(F.broadcast(versioned.read(s, store, "event", v).agg(F.count(F.lit(1)).alias("events")))) for v in (0, 1)]  # one row
    return counted[0].unionByName(counted[1]).select("version", "status", "n", "events")


@query("""SELECT doc_id, concat('K-', lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0')) AS card, 'part_of' AS type, coalesce(lang, 'none') AS note FROM documents
UNION ALL SELECT doc_id, concat('K-', lpad(CAST(doc_id * 7 % 10000 AS VARCHAR), 4, '0')), 'related', concat('from ', coalesce(source, 'none')) FROM documents WHERE doc_id % 3 <> 0""")
def note_migration(s: SparkSession, d: str) -> DataFrame:
    """Documents as notes of the first schema, migrated, and the relations read from the result."""
    card = lambda k: F.concat(F.lit("K-"), F.lpad((k % 10000).cast("string"), 4, "0"))
    k, other = F.col("doc_id"), lambda c: F.coalesce(c, F.lit("none"))
    first = F.concat(F.lit("- concept_id: "), card(k), F.lit(", relation_type: part_of — "), other("lang"), F.lit("\n"))
    second = F.when(k % 3 != 0, F.concat(F.lit("- "), card(k * 7), F.lit(": from "), other("source"), F.lit("\n"))).otherwise("- see elsewhere\n")
    note = F.concat(F.lit("---\nstatus: approved\n---\n## Related Concepts\n"), first, second, F.lit("\n## Text\n"), F.coalesce("text", F.lit("")))
    told = T.table(s, d, "documents").select("doc_id", X.migrated(note).alias("note"))
    return told.select("doc_id", F.explode(X.relations(F.col("note"))).alias("r")).select("doc_id", F.col("r.to").alias("card"), "r.type", "r.note")


@query("SELECT doc_id, md5(array_to_string(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\x0B\\f]+'), ' ')) AS digest FROM documents")
def position_lists(s: SparkSession, d: str) -> DataFrame:
    """Each text as a map from its words to their positions, and back."""
    docs = T.table(s, d, "documents")
    # Dealt by text, so that its words stay together, and the lists and the map are made where they are.
    letters = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    words = docs.where("doc_id is not null").select("doc_id", "text").repartition(width(s, letters // 6), "doc_id").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("at", "word"))
    lists = words.groupBy("doc_id", "word").agg(F.array_sort(F.collect_list("at")).alias("at")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return docs.select("doc_id").join(lists, "doc_id", "left").select("doc_id", F.md5(F.coalesce(X.from_positions(F.col("index")), F.lit(""))).alias("digest"))


@query("""SELECT doc_id, sha256(concat('[', CAST(doc_id AS VARCHAR), ', ', coalesce(CAST(to_json(text) AS VARCHAR), 'null'), ', ', coalesce(CAST(to_json(lang) AS VARCHAR), 'null'), ']')) AS digest FROM documents""")
def canonical_digest(s: SparkSession, d: str) -> DataFrame:
    docs = T.table(s, d, "documents")
    return docs.select("doc_id", X.json_digest(docs, "doc_id", "text", "lang").alias("digest"))


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def answer_salvage(s: SparkSession, d: str) -> DataFrame:
    """Properties of events inside what a model may answer: fenced, among words, bare, or cut off."""
    n, props = F.col("event_id") % 4, F.col("props")
    raw = F.when(n == 0, F.concat(F.lit("Here:\n```json\n"), props, F.lit("\n```\nand {more}"))).when(n == 1, F.concat(F.lit("It is "), props, F.lit(", I think"))).when(n == 2, props).otherwise(F.expr("substr(props, 1, length(props) - 1)"))
    return T.table(s, d, "events").select("event_id", F.try_variant_get(X.salvaged(raw), "$.k", "bigint").alias("k"))


@query(with_kg(STRICT + ",\n" + CLAIM_EDGES + """,
co AS (SELECT DISTINCT ue.edge_id FROM ue JOIN kg_support a ON a.target_node = ue.from_node JOIN kg_support b ON b.target_node = ue.to_node AND b.evidence_id = a.evidence_id WHERE ue.from_node <> ue.to_node)
SELECT substr(sha256(edge_id), 1, 8) AS gap_id, edge_id, CASE WHEN edge_id IN (SELECT edge_id FROM co) THEN 'resolved' ELSE 'open' END AS state FROM kg_claim_edge"""))
def edge_gap_resolution(s: SparkSession, d: str) -> DataFrame:
    """All edges between claims as open gaps, and which of them shared evidence resolves."""
    edges = T.claim_edges(s, d)
    found = edges.select(F.substring(F.sha2("edge_id", 256), 1, 8).alias("gap_id"), "edge_id")
    return gaps.edge_gaps(found, edges, policy.usable_edges(edges, _usable(s, d), T.edge_reviews(s, d)), T.supports(s, d))


@query("""WITH q AS (SELECT l_orderkey AS id, l_partkey AS card_id FROM lineitem), c AS (SELECT p_partkey AS card_id, CASE WHEN p_partkey % 3 = 0 THEN 'revise' WHEN p_partkey % 5 = 0 THEN 'defer' WHEN p_partkey % 7 = 0 THEN 'draft' ELSE 'accepted' END AS status, p_size % 9 <> 0 AS sourced FROM part WHERE p_partkey % 11 <> 0),
m AS (SELECT id, bool_or(status IS NULL OR NOT sourced) AS gap, list_sort(list(DISTINCT status) FILTER (WHERE status IS NOT NULL)) AS s FROM q LEFT JOIN c ON c.card_id = q.card_id GROUP BY 1)
SELECT id, CASE WHEN gap THEN 'gap' WHEN s = ['accepted'] THEN 'accepted_ready' WHEN list_contains(s, 'revise') THEN 'revision_required' WHEN list_contains(s, 'defer') THEN 'deferred' ELSE 'draft_only' END AS result, coalesce(array_to_string(s, ','), '') AS statuses FROM m""")
def card_coverage(s: SparkSession, d: str) -> DataFrame:
    """Orders as questions, their parts as the cards that are expected."""
    k = F.col("p_partkey")
    cards = T.table(s, d, "part").where(k % 11 != 0).select(k.alias("card_id"), F.when(k % 3 == 0, "revise").when(k % 5 == 0, "defer").when(k % 7 == 0, "draft").otherwise("accepted").alias("status"), (F.col("p_size") % 9 != 0).alias("sourced"))
    return planning.coverage(T.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("card_id")), cards)


@query(with_kg("""m AS (SELECT node_id AS card_id, claim_id, CASE kind WHEN 'application_hypothesis' THEN kind WHEN 'definition' THEN 'background' ELSE 'lecture_derived' END AS type, EXISTS (SELECT 1 FROM kg_support s WHERE s.target_claim = c.claim_id) AS good FROM kg_claim c),
a AS (SELECT card_id, count(*) FILTER (WHERE type = 'lecture_derived') AS derived, count(*) FILTER (WHERE type = 'lecture_derived' AND good) AS supported, coalesce(string_agg(claim_id, ',' ORDER BY claim_id) FILTER (WHERE type = 'lecture_derived' AND NOT good), '') AS unresolved, coalesce(string_agg(claim_id, ',' ORDER BY claim_id) FILTER (WHERE type = 'application_hypothesis'), '') AS hypotheses FROM m GROUP BY 1)
SELECT *, derived > 0 AND derived = supported AS review_ready FROM a"""))
def claim_map_audit(s: SparkSession, d: str) -> DataFrame:
    """Which nodes are ready for review: claims other than definitions as derived ones, supported where evidence targets them."""
    proved = T.supports(s, d).select(F.col("target_claim").alias("claim_id"), F.lit("supported_by_search_excerpt").alias("disposition")).distinct()
    kind = F.when(F.col("kind") == "application_hypothesis", F.col("kind")).when(F.col("kind") == "definition", "background").otherwise("lecture_derived")
    rows = T.claims(s, d).select(F.col("node_id").alias("card_id"), "claim_id", kind.alias("type")).join(proved, "claim_id", "left")
    return planning.claim_audit(rows)
