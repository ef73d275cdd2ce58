"""The stored index against a scan of all documents, with small blocks, so that searches have something to leave out."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleanmark.operators import index as I
from gleanmark.operators import retrieval

DOCS = "id long, title string, body string, role string, field string"


def make(spark, rng, ids, words=60):
    vocabulary = [f"w{i}" for i in range(words)]
    say = lambda n: " ".join(rng.choices(vocabulary, weights=range(1, words + 1), k=n))
    rows = [(i, say(3) if i % 7 else None, say(rng.randint(0, 30)) if i % 11 else "", rng.choice(["a", "b", None]), rng.choice("xyz")) for i in ids]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(I, "BLOCK_BITS", 3)
    monkeypatch.setattr(I, "FIRST", 1)


QUERIES = [(1, "w1 w2"), (2, "w59 W58 w59"), (3, "w3 nowhere"), (4, "..."), (5, None), (6, "w57 w55 w50 w10 w2"), (7, "w0")]


def scan(docs, queries, k, every, keep=None):
    told = retrieval.bm25(docs, "id", {"title": 10.0, "body": 1.0}, queries, every).withColumn("score", F.round("score", 6))
    told = told if keep is None else told.join(docs.where(keep).select("id"), "id", "left_semi")
    return sorted((r.query_id, r.rank, r.id, round(r.score, 5)) for r in retrieval.top(told, "id", k).collect())


def test_search_equals_a_scan_over_every_state(spark, tmp_path, small):
    rng = random.Random(2)
    index = I.Index(str(tmp_path / "index"), "id", {"title": 10.0, "body": 1.0}, ("role", "field"), buckets=5)
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    got = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 5)) for r in df.collect())
    state = make(spark, rng, range(70))
    I.upsert(index, state)
    assert got(I.search(index, queries, 5)) == scan(state, queries, 5, False)
    assert got(I.search(index, queries, 3, every=True)) == scan(state, queries, 3, True)
    # Some documents stay, some change, some go, some are new; an unchanged state adds an empty segment.
    later = state.where("id % 5 <> 1").withColumn("body", F.when(F.col("id") % 4 == 0, F.concat(F.coalesce("body", F.lit("")), F.lit(" w1 w59"))).otherwise(F.col("body"))).unionByName(make(spark, rng, range(100, 112)))
    I.upsert(index, later)
    I.upsert(index, later)
    assert I.segments(spark, index) == [0, 1, 2] and index.table(spark, "docs").where("segment = 2").count() == 0
    assert got(I.search(index, queries, 5)) == scan(later, queries, 5, False)
    where = {"role": ["a"], "field": ["x", "y"]}
    assert got(I.search(index, queries, 4, where=where)) == scan(later, queries, 4, False, "role = 'a' and field in ('x', 'y')")
    usable = later.where("id % 2 = 0").select("id")
    assert got(I.search(index, queries, 5, usable=usable)) == [r for r in scan(later, queries, 5, False) if r[2] % 2 == 0]
    # Without deletes, what isn't named stays.
    I.upsert(index, later.where("id = 4").withColumn("title", F.lit("w0 w0")), delete=False)
    last = later.where("id <> 4").unionByName(later.where("id = 4").withColumn("title", F.lit("w0 w0")))
    assert got(I.search(index, queries, 6)) == scan(last, queries, 6, False)


def test_a_segment_that_failed_is_never_read(spark, tmp_path, small):
    rng = random.Random(4)
    index = I.Index(str(tmp_path / "index"), "id", {"title": 10.0, "body": 1.0})
    first, second = make(spark, rng, range(20)), make(spark, rng, range(30, 44))
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    I.upsert(index, first)
    before = sorted(map(tuple, I.search(index, queries, 5).collect()))
    # All of the next segment is there but for its row in the log.
    other = I.Index(str(tmp_path / "other"), "id", index.fields)
    I.upsert(I.upsert(other, first), second)
    for name in ("docs", "postings", "facets", "gone"):
        (tmp_path / "other" / name / "segment=1").rename(tmp_path / "index" / name / "segment=1")
    assert sorted(map(tuple, I.search(index, queries, 5).collect())) == before
    I.upsert(index, second)
    assert {r.id for r in I.search(index, queries, 50).collect()} <= set(range(30, 44))


def test_a_search_reads_its_own_postings_and_blocks_only(spark, tmp_path, small):
    index = I.Index(str(tmp_path / "index"), "id", {"title": 10.0, "body": 1.0}, buckets=16)
    I.upsert(index, make(spark, random.Random(6), range(200)))
    asked = spark.createDataFrame([("w3",), ("w3",)], "term string")
    rows = I.postings(index, asked)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan) and "EqualTo(term,w3)" in plan
    assert {r.term for r in rows.select("term").collect()} == {"w3"} and len(rows.inputFiles()) >= 1
    assert "positions" not in rows.select("n", "most")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        I.search(I.Index(str(tmp_path / "none"), "id", {"body": 1.0}), spark.createDataFrame(QUERIES, "query_id int, query string"), 3)


def test_the_best_of_each_query_limits_what_is_ranked(spark):
    scored = spark.createDataFrame([(q, i, float(i % 5)) for q in range(3) for i in range(20)], "query_id int, id int, score double")
    best = retrieval.top(scored, "id", 4)
    assert [(r.id, r.rank) for r in best.where("query_id = 1").orderBy("rank").collect()] == [(0, 0), (5, 1), (10, 2), (15, 3)]
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
