"""Claims that meet in tiles, against all pairs, with tiles of a few rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gleanmark.operators import claims as C
from gleanmark.operators.graph import stored

KINDS = "{} string, ks array<string>"


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(C, "TILE", 16)
    monkeypatch.setattr(C, "CLAIMS", 9)
    monkeypatch.setattr(C, "NODES", 7)


def sets(rng, name, n, words, sizes):
    base = [sorted(rng.sample(words, rng.choice(sizes))) for _ in range(n // 3)]
    made = base + [sorted({w if rng.random() < 0.8 else rng.choice(words) for w in rng.choice(base)}) for _ in range(n - len(base))]
    return [(f"{name}{i}", ks) for i, ks in enumerate(made)]


def test_similar_sets_are_found_in_tiles_of_all_sizes(spark, small):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(900)]
    shared = sets(rng, "x", 90, words, (1, 2, 3, 9, 20, 130, 400))
    left = [(f"a{i}", ks) for i, (_, ks) in enumerate(shared[::2])] + [("a-none", []), ("a-null", None)]
    right = [(f"b{i}", ks) for i, (_, ks) in enumerate(shared[1::2])] + [("b-none", [])]
    got = C.similar(spark.createDataFrame(left, KINDS.format("a")), spark.createDataFrame(right, KINDS.format("b")), "a", "b").collect()
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in left for b, y in right if x and y}
    want = {pair: s for pair, s in want.items() if s >= 0.45}
    assert len(want) > 20 and {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want)
    none = spark.createDataFrame([("a-none", [])], KINDS.format("a"))
    assert C.similar(none, spark.createDataFrame(right, KINDS.format("b")), "a", "b").count() == 0


def test_attribution_is_the_best_of_all_nodes(spark, small):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(60)]
    nodes = [(f"n{i:02}", ks) for i, (_, ks) in enumerate(sets(rng, "n", 40, words, (1, 3, 8, 30)))] + [("n-none", [])]
    claims = [(f"c{i}", ks, rng.choice([None, [], rng.sample(words, 1), ["unknown"], rng.sample(words, 2), [words[0], "unknown", "other"]])) for i, (_, ks) in enumerate(sets(rng, "c", 60, words, (2, 8, 20)))]
    claims += [("c-none", [], None), ("c-far", ["nowhere"], None)]

    def best(ks, ss):
        ks, ss = set(ks) | set(ss or []), set(ss or [])
        told = [(-max(len(ks & set(ns)) / len(ks), len(ks & set(ns)) / len(ns), 1.5 * len(ss & set(ns)) / len(ss) if ss else 0.0), i) for i, ns in nodes if ns] if ks else []
        return min((x for x in told if -x[0] >= 0.35), default=None)

    got = C.attributed(spark.createDataFrame(claims, "claim_id string, ks array<string>, subject_ks array<string>"), spark.createDataFrame(nodes, KINDS.format("id"))).collect()
    want = {c: best(ks, ss) for c, ks, ss in claims}
    assert {r.claim_id: (-r.score, r.node_id) for r in got} == {c: x for c, x in want.items() if x}


def test_a_stored_table_keeps_no_shuffle_files(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    count = lambda: sum(f.startswith("shuffle_") and f.endswith(".data") for d in folder for _, _, fs in os.walk(d) for f in fs)
    before = count()
    stored(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count())
    assert count() <= before
