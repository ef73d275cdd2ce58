"""Blocks of claims meet where they are stored: nothing is written or shuffled for a pair of blocks."""

import random

from gleanmark.operators import claims as C
from tests.test_claim_tiles import KINDS, sets, small  # noqa: F401  (a fixture)


def plans(monkeypatch):
    """The plans of all tables that claims store."""
    seen, stored = [], C.stored

    def told(df):
        seen.append(df._jdf.queryExecution().sparkPlan().toString())
        return stored(df)

    monkeypatch.setattr(C, "stored", told)
    return seen


def test_no_sketch_is_shuffled_for_a_pair_of_blocks(spark, small, monkeypatch):  # noqa: F811
    rng = random.Random(11)
    rows = sets(rng, "x", 120, [f"word{i}" for i in range(400)], (5, 20, 60))
    left, right = spark.createDataFrame(rows[::2], KINDS.format("a")), spark.createDataFrame(rows[1::2], KINDS.format("b"))
    seen = plans(monkeypatch)
    assert C.similar(left, right, "a", "b").count() > 0
    assert any("CartesianProduct" in p for p in seen) and not any("CoGroup" in p for p in seen)


def test_no_node_is_shuffled_for_a_pair_of_blocks(spark, small, monkeypatch):  # noqa: F811
    rng = random.Random(12)
    words = [f"word{i}" for i in range(60)]
    nodes = spark.createDataFrame(sets(rng, "n", 40, words, (3, 8, 30)), KINDS.format("id"))
    rows = [(f"c{i}", ks, []) for i, (_, ks) in enumerate(sets(rng, "c", 60, words, (2, 8, 20)))]
    seen = plans(monkeypatch)
    claims = spark.createDataFrame(rows, "claim_id string, ks array<string>, subject_ks array<string>")
    want = {(r.claim_id, r.node_id, r.score) for r in C.attributed(claims, nodes).collect()}
    assert any("CartesianProduct" in p for p in seen) and not any("CoGroup" in p for p in seen)
    # Words that many nodes have are counted apart.
    monkeypatch.setattr(C, "DENSE", 3)
    monkeypatch.setattr(C, "STEP", 4)
    assert {(r.claim_id, r.node_id, r.score) for r in C.attributed(claims, nodes).collect()} == want != set()
