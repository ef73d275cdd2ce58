"""Steps whose tasks and shuffles must not grow with the tables, and the two ways in which each can go."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from gleanmark.operators import graph, retrieval
from gleanmark.operators import index as I
from gleanmark.plans import catalog


def exchanges(df, key):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in x and key in x]


@pytest.mark.parametrize("every", [False, True])
def test_many_queries_score_as_few_do(spark, monkeypatch, every):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(n))
    docs = spark.createDataFrame([(i, say(rng.randint(0, 30))) for i in range(80)], "id long, text string")
    queries = spark.createDataFrame([(i, say(2)) for i in range(40)] + [(100, "w1 w2"), (101, "W2 w1 w1"), (102, None)], "query_id int, query string")
    told = lambda: sorted((r.query_id, r.id, round(r.score, 9), r.terms) for r in retrieval.bm25(docs, "id", {"text": 1.0}, queries, every).collect())
    few = retrieval.bm25(docs, "id", {"text": 1.0}, queries, every)
    # A pair of a query and a document is never shuffled where the queries are few.
    assert not exchanges(few, "set_id")
    want = told()
    assert [x[1:] for x in want if x[0] == 100] == [x[1:] for x in want if x[0] == 101] != []
    monkeypatch.setattr(retrieval, "SENT", 0)
    assert told() == want


def test_backoff_meets_each_query_once(spark):
    docs = spark.createDataFrame([(1, "a1 b1 c1"), (2, "a1 b1"), (3, "b1 c1 d1"), (4, "a1 d1 b1")], "id int, text string")
    queries = spark.createDataFrame([(1, "a1 b1 a1 d1 zz"), (2, "c1 b1 qq a1"), (3, "a1 a1 qq"), (4, "zz a1"), (5, "a1")], "query_id int, query string")
    got = {(r.query_id, r.n_terms, r.id) for r in retrieval.backed_off(docs, "id", {"text": 1.0}, queries).collect()}
    assert got == {(1, 4, 4), (2, 2, 1), (2, 2, 3), (3, 2, 1), (3, 2, 2), (3, 2, 4)}


def test_vectors_in_small_slices(spark, monkeypatch):
    rng = random.Random(9)
    vectors = spark.createDataFrame([(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(120)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    want = sorted(map(tuple, retrieval.nearest(vectors, queries, 5).collect()))
    monkeypatch.setattr(retrieval, "SCORES", 18)
    assert sorted(map(tuple, retrieval.nearest(vectors, queries, 5).collect())) == want


def test_tasks_of_pairs_and_postings_follow_the_rows(spark, monkeypatch, tmp_path):
    rows = [(q, c) for q in range(40) for c in range(q % 5)] * 2 + [(None, 1), (None, 2), (3, None)]
    activations = spark.createDataFrame(rows, "query_id int, card_id int")
    want = [tuple(r) for r in graph.coactivation_pairs(activations).collect()]
    assert want[0] == (0, 1, 24) and len(want) == 6
    monkeypatch.setattr(graph, "TASK_ROWS", 10)
    assert [tuple(r) for r in graph.coactivation_pairs(activations).collect()] == want
    assert graph.width(spark, 1000) == 100
    index = I.upsert(I.Index(str(tmp_path / "index"), "id", {"text": 1.0}, buckets=2), spark.range(60).select("id", F.lit("one two three").alias("text")))
    assert len(glob.glob(f"{index.path}/postings/*/bucket=*/*.parquet")) <= 18
    assert index.table(spark, "postings").groupBy("term", "block").count().where("count > 1").count() == 0


def test_lists_and_labels_are_made_without_their_words_in_a_shuffle(spark, sf):
    plan = catalog.QUERIES["position_lists"](spark, sf)
    assert not exchanges(plan, "word") and exchanges(plan, "doc_id")
    assert not exchanges(catalog.QUERIES["label_routing"](spark, sf), "p_partkey")
