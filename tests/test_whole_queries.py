"""Searches that ask with every benchmark item, and not with a part of them."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers all queries)
from gleanmark import tables as T
from gleanmark.functions.text import tokens
from gleanmark.operators import retrieval
from gleanmark.plans import catalog


def items(spark, sf, least):
    table = T.table(spark, sf, "benchmark").where(F.size(tokens(F.col("text"))) >= least)
    return {r.item_id for r in table.select("item_id").collect()}


def test_index_best_ranks_for_every_item(spark, sf):
    got = {r.query_id for r in catalog.QUERIES["index_best"](spark, sf).select("query_id").collect()}
    assert got == items(spark, sf, 1) and len(got) > 1


def test_backoff_asks_with_every_item(spark, sf):
    got = {r.query_id for r in catalog.QUERIES["bm25_backoff"](spark, sf).select("query_id").collect()}
    assert {q for q in got if q % 100} and got <= items(spark, sf, 2)


@pytest.mark.parametrize("sent", [0, 100])
def test_backoff_of_many_queries(spark, monkeypatch, sent):
    docs = spark.createDataFrame([(1, "a1 b1 c1"), (2, "a1 b1"), (3, "b1 c1 d1"), (4, "a1 d1 b1"), (5, None)], "id int, text string")
    queries = spark.createDataFrame([(1, "a1 b1 a1 d1 zz"), (2, "c1 b1 qq a1"), (3, "a1 a1 qq"), (4, "zz a1"), (5, "a1"), (6, "b1 a1 zz d1"), (7, None)], "query_id int, query string")
    monkeypatch.setattr(retrieval, "SENT", sent)
    got = {(r.query_id, r.n_terms, r.id) for r in retrieval.backed_off(docs, "id", {"text": 1.0}, queries).collect()}
    assert got == {(1, 4, 4), (2, 2, 1), (2, 2, 3), (3, 2, 1), (3, 2, 2), (3, 2, 4), (6, 2, 1), (6, 2, 2), (6, 2, 4)}
