"""Queries of the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark import tables as T
from gleanmark.operators import index as I
from gleanmark.operators.graph import scratch
from gleanmark.plans.catalog import ASKED, EVERY, PAGES, SCORED, _asked, query

RANKED = "\nSELECT query_id, doc_id, round(score, 6) + 0e0 AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6), doc_id) - 1 AS INT) AS rank FROM sc QUALIFY rank < 10"


def _documents(s: SparkSession, d: str) -> I.Index:
    index = I.Index(scratch(s, "index"), "doc_id", {"text": 1.0}, ("lang", "source"))
    return I.upsert(index, T.table(s, d, "documents"))


@query("WITH " + EVERY + ",\n" + SCORED + RANKED)
def index_best(s: SparkSession, d: str) -> DataFrame:
    """The ten best documents for any of a query's words, from the index; every benchmark item is a query."""
    return I.search(_documents(s, d), _asked(s, d, every=True), 10)


@query("WITH " + ASKED + ",\n" + SCORED + """,
ok AS (SELECT sc.* FROM sc JOIN documents d ON d.doc_id = sc.doc_id WHERE d.lang IN ('en', 'fr') AND d.source LIKE 'src1%'),
tt AS (SELECT query_id, doc_id, round(score, 6) + 0e0 AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6), doc_id) - 1 AS INT) AS rank FROM ok QUALIFY rank < 30)
SELECT tt.* FROM tt WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def index_filtered(s: SparkSession, d: str) -> DataFrame:
    """Language and source narrow what is ranked, before the limit; the label is asked after it."""
    docs = T.table(s, d, "documents")
    sources = [r["source"] for r in docs.where("source like 'src1%'").select("source").distinct().collect()]
    good = T.table(s, d, "labels").where("quality = 1").select("doc_id")
    return I.search(_documents(s, d), _asked(s, d), 30, where={"lang": ["en", "fr"], "source": sources}, usable=good)


CHANGED = """nd AS (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN concat(text, ' ', text, ' again') ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 10 = 4)"""


@query("WITH " + ASKED + ",\n" + CHANGED + ",\n" + SCORED.replace("FROM documents", "FROM nd") + RANKED)
def index_upserted(s: SparkSession, d: str) -> DataFrame:
    """The index of all documents, brought to a later state of them: some gone, some changed, some new."""
    docs = T.table(s, d, "documents")
    text = F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit(" "), "text", F.lit(" again"))).otherwise(F.col("text"))
    later = docs.where("doc_id % 10 <> 3").withColumn("text", text)
    later = later.unionByName(docs.where("doc_id % 10 = 4").withColumn("doc_id", F.col("doc_id") + 1_000_000_000))
    return I.search(I.upsert(_documents(s, d), later), _asked(s, d), 10)


URLS = """q AS (SELECT page_id AS query_id, url AS text FROM pages WHERE page_id % 100 = 0), qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM q)"""


@query("WITH " + URLS + ",\n" + PAGES.replace("AS score FROM tf", "AS score, count(*) AS terms FROM tf") + """,
ok AS (SELECT * FROM sc WHERE terms = (SELECT count(*) FROM qt WHERE qt.query_id = sc.query_id))
SELECT query_id, page_id, round(score, 6) + 0e0 AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6), page_id) - 1 AS INT) AS rank FROM ok QUALIFY rank < 10""")
def index_all_words(s: SparkSession, d: str) -> DataFrame:
    """The ten best pages with all words of an address: those of the pages whose id is divisible by 100."""
    pages = T.table(s, d, "pages")
    index = I.upsert(I.Index(scratch(s, "index"), "page_id", {"url": 10.0, "html": 1.0}), pages)
    return I.search(index, pages.where("page_id % 100 = 0").select(F.col("page_id").alias("query_id"), F.col("url").alias("query")), 10, every=True)
