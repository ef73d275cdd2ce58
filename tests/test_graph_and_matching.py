"""Cycle components, pattern matching, claims in order, nearest vectors and edge reviews against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanmark.functions import text as X
from gleanmark.operators import claims, graph, matching, policy, retrieval


def reach(edges, n):
    """Which vertices can be reached from each, by one edge or more."""
    told = {a: {b for x, b in edges if x == a} for a in range(n)}
    while True:
        then = {a: told[a].union(*[told[b] for b in told[a]]) for a in told}
        if then == told:
            return told
        told = then


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 12, 14), (2, 20, 24), (3, 9, 40), (4, 15, 15)])
def test_cycle_components_of_random_graphs(spark, seed, n, m):
    rng = random.Random(seed)
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(n - 1, n - 1)}
    rows = spark.createDataFrame([*map(tuple, edges), (1, None), (None, 2)], "src int, dst int")
    got = graph.cycle_components(rows)
    told = reach(edges, n)
    want = {}
    for v in range(n):
        if v in told[v]:
            every = {w for w in told[v] if v in told[w]}
            want[v] = (min(every), len(every))
    assert {r.id: (r.component, r.size) for r in got.collect()} == want
    ways = {r.component: [int(x) for x in r.cycle.split(">")] for r in graph.witnesses(rows, got).collect()}
    assert set(ways) == {c for c, _ in want.values()}
    for component, way in ways.items():
        assert way[0] == way[-1] == component and len(way) > 1 and all(e in edges for e in zip(way, way[1:], strict=False)) and all(want[v][0] == component for v in way)


def test_an_endless_chain_has_no_cycle(spark):
    chain = spark.range(8).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.cycle_components(chain).count() == 0 and graph.witnesses(chain, graph.cycle_components(chain)).count() == 0
    ring = chain.unionByName(spark.createDataFrame([(8, 0)], "src long, dst long"))
    got = graph.cycle_components(ring)
    assert got.where("component = 0 and size = 9").count() == 9 and graph.witnesses(ring, got).first().cycle == "0>1>2>3>4>5>6>7>8>0"


@pytest.mark.parametrize("shard", [4, 4_000_000])
def test_hits_equal_a_search_for_each_pattern(spark, shard):
    texts = [(1, "abracadabra"), (2, ""), (3, None), (4, "xx" * 30), (5, "日本語のテキスト"), (6, "abracadabra"), (None, "a cad")]
    patterns = ["abra", "a", "cad", "xx", "x", "zz", "本語", "", None, "a", "abracadabra"]
    docs = spark.createDataFrame(texts, "k long, t string").repartition(3)
    told = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    want = Counter((k, p, sum(t.startswith(p, i) for i in range(len(t))), t.find(p)) for k, t in texts if t for p in {p for p in patterns if p} if p in t)
    assert Counter(map(tuple, matching.hits(docs, "k", "t", told, shard).collect())) == want
    assert matching.hits(docs, "k", "t", told.where("false")).count() == 0 and matching.hits(docs.where("false"), "k", "t", told).count() == 0


def test_expansion_classes_and_routes_come_from_hits(spark):
    make = spark.createDataFrame
    synonyms = make([(2, "入札", "bidding auction"), (1, "均衡", "equilibrium"), (3, "ナッシュ均衡", "Nash"), (4, "none", "x")], "place int, term string, words string")
    asked = make([(1, "ナッシュ均衡と入札"), (2, "plain"), (3, None)], "query_id int, query string")
    assert {r.query_id: r["query"] for r in matching.expanded(asked, synonyms).collect()} == {1: "ナッシュ均衡と入札 equilibrium bidding auction Nash", 2: "plain", 3: ""}
    rules = make([(1, "special", "S"), (2, "6.", "EECS"), (3, "18.", "Maths")], "place int, pattern string, class string")
    docs = make([(1, "18. and 6. special"), (2, "18.02 with 6.001"), (3, "18.1"), (4, "x"), (5, None)], "k int, t string")
    assert {r.k: r["class"] for r in matching.first_class(docs, "k", "t", rules).collect()} == {1: "S", 2: "EECS", 3: "Maths", 4: None, 5: None}
    cards = make([("K-2", "Nash"), ("K-1", "equilibrium"), ("K-3", ""), ("K-4", None)], "card_id string, title string")
    gaps = make([(1, "what is a NASH Equilibrium?"), (2, "else"), (3, None)], "id int, question string")
    assert {r.id: (r.route, r.cards) for r in matching.routed(gaps, cards).collect()} == {1: ("existing_unreviewed", "K-1,K-2"), 2: ("retrieval_miss", None), 3: ("retrieval_miss", None)}


def test_term_scores_sum_over_claims(spark):
    rows = spark.createDataFrame([("n", "second price"), ("n", "price"), ("m", "sealed bid"), ("m", None)], "node string, text string")
    asked = spark.createDataFrame([(1, "price", 2), (1, "bid", 1), (2, "se", 1), (3, "none", 1)], "query_id int, term string, times int")
    got = matching.term_scores(rows, "node", F.col("text"), asked)
    assert sorted(map(tuple, got.select("query_id", "node", "score").collect())) == [(1, "m", 1), (1, "n", 4), (2, "m", 1), (2, "n", 1)]


def loop(new, known):
    """The claims one by one, each accepted one known to the next."""
    told, out = [(i, claims_words(t)) for i, t in known], {}
    for name, _, text in sorted(new, key=lambda r: r[1]):
        words = claims_words(text)
        scored = [(-len(words & w) / len(words | w), i) for i, w in told if words | w and len(words & w) / len(words | w) >= 0.45]
        best = min(scored, default=(0.0, None))
        verdict = "identical" if -best[0] >= 0.7 else "similar" if best[1] else "new"
        out[name] = (best[1], round(-best[0], 6), verdict)
        if verdict != "identical":
            told.append((name, words))
    return out


def claims_words(text):
    return {w for w in (text or "").split() if len(w) >= 4}


@pytest.mark.parametrize("seed", range(4))
def test_claims_are_registered_as_in_a_loop(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}zzq" for a in "bcdfg" for b in "aeiou"]
    base = [rng.sample(vocabulary, 8) for _ in range(5)]
    say = lambda: " ".join(w if rng.random() < 0.85 else rng.choice(vocabulary) for w in rng.choice(base))
    known = [(f"k{i}", say()) for i in range(4)]
    new = [(f"n{i:02}", place, say() if i % 9 else ["", None][i % 2]) for i, place in enumerate(rng.sample(range(100), 40))]
    new += [(f"x{i}", 200 + i, new[1][2]) for i in range(5)]  # copies of one claim
    got = claims.registered(spark.createDataFrame(new, "claim_id string, place int, statement string"), spark.createDataFrame(known, "claim_id string, statement string"))
    assert {r.claim_id: (r.match_id, r.similarity, r.verdict) for r in got.collect()} == loop(new, known)


def words_of(text):
    return {w for w in re.findall("[a-z]{4,}", (text or "").lower()) if w not in X.STOP_WORDS} | set(re.findall("[\u4e00-\u9fff]{2,}", text or ""))


@pytest.mark.parametrize("seed", range(3))
def test_statements_are_mined_as_in_a_loop(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}zzq" for a in "bcdfg" for b in "aeiou"]
    say = lambda n: " ".join(rng.sample(vocabulary, n))
    nodes = [(f"N{i}", say(2), "Theory") for i in range(4)] + [("N8", "均衡", None), ("N9", None, None)]
    stated = [(f"N{rng.randrange(4)}", say(rng.randint(3, 6))) for _ in range(7)] + [("N9", "入札 and 入札価"), ("none", say(3))]
    synonyms = [("入札", ["auction", "bidding"]), ("均衡", ["equilibrium"]), (nodes[0][1], ["titled"])]
    known = [(f"k{i}", t) for i, (_, t) in enumerate(stated[:4])] + [("E1#mined-3", "elsewhere altogether")]
    base = [t for _, t in stated[:7]] + [say(5), "auction bidding equilibrium", "titled words alone"]
    found = []
    for place in range(45):
        words = [w if rng.random() < 0.8 else rng.choice(vocabulary) for w in rng.choice(base).split()]
        text = rng.choice([" ".join(words)] * 8 + ["  ", None])
        found.append((f"E{place % 3}", place // 3, place, text, [say(1), None] if rng.random() < 0.3 else None, rng.choice(["theoretical", "methodological", "definitional", "odd", None]), rng.choice(["speculative", None, None]), rng.choice(["background", "hypothesis", None, None, None, None]), rng.choice([True, False, None, None, None])))
    make = spark.createDataFrame
    keyed = claims.node_keywords(make(nodes, "id string, title string, type string"), make(stated, "id string, statement string"), make(synonyms, "term string, words array<string>"))
    sets = {}
    for node, title, kind in nodes:
        texts = [t for n, t in stated if n == node]
        terms = {title or ""} | {t for text in [*texts, title or ""] for t in re.findall("[\u4e00-\u9fff]{2,}", text)}
        sets[node] = set().union(words_of(title), words_of(kind), *map(words_of, texts), *[w for t, w in synonyms if t in terms])
    assert {r.id: set(r.ks) for r in keyed.collect()} == {n: w for n, w in sets.items() if w}
    schema = "evidence_id string, index int, place int, text string, subjects array<string>, claim_type string, confidence string, attribution string, review_required boolean"
    got = claims.mined(make(found, schema), make(known, "claim_id string, statement string"), keyed)
    want, told = {}, [(i, words_of(t)) for i, t in known]
    for evidence, index, _, text, subjects, kind, confidence, attribution, review in found:
        name, text = f"{evidence}#mined-{index}", (text or "").strip()
        if review or attribution == "background":
            want[name] = ("deferred", None, None, None, None)
            continue
        if not text:
            continue
        own, subject = words_of(text), set().union(*[words_of(x) for x in subjects or []])
        scored = [(-len(own & w) / len(own | w), i) for i, w in told if own & w and len(own & w) / len(own | w) >= 0.45]
        best = min(scored, default=(0.0, None))
        every, at = own | subject, (0.0, None)
        for node in sorted(sets):
            w = sets[node]
            if every & w:
                there, back = len(every & w) / len(every), len(every & w) / len(w)
                score = max(there, back, 1.5 * len(subject & w) / len(subject) if subject else 0, (there + back) / 2)
                at = max(at, (score, node), key=lambda x: x[0])
        node = at[1] if at[0] >= 0.35 else None
        action = "duplicate" if -best[0] >= 0.7 else "unresolved" if node is None else "already_exists" if name in dict(known) else "new"
        kinds = {"theoretical": "theorem", "methodological": "empirical", "definitional": "definition"}
        as_ = "application_hypothesis" if confidence == "speculative" or attribution == "hypothesis" else kinds.get(kind, "empirical")
        want[name] = (action, best[1], round(-best[0], 6), node if action == "new" else None, as_ if action == "new" else None)
        if action == "new":
            told.append((name, own))
    assert {r.claim_id: (r.action, r.match_id, r.similarity, r.node_id, r.kind) for r in got.collect()} == want
    assert {a for a, *_ in want.values()} >= {"new", "duplicate", "deferred"}


def test_nearest_vectors_in_waves(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)] + [(90, [0.0] * 4), (91, None), (92, [1.0, None, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = vectors.where("vec_id % 6 = 0 or vec_id > 89").withColumnRenamed("vec_id", "query_id")
    good = [(i, np.array(v)) for i, v in rows if v and None not in v]
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    want = []
    for q, v in good:
        if q % 6 == 0 or q > 89:
            scored = sorted((-round(float(unit(v) @ unit(w)), 6) + 0.0, i) for i, w in good)
            want += [(q, i, abs(s) if s == 0 else -s, rank) for rank, (s, i) in enumerate(scored[:7])]
    for most in (1 << 15, 3):
        assert sorted(map(tuple, retrieval.nearest(vectors, asked, 7, most).select("query_id", "vec_id", "score", "rank").collect())) == sorted(want)
    assert retrieval.nearest(vectors, asked.where("false"), 3).count() == 0


def test_edges_are_usable_only_if_every_rule_admits_them(spark):
    make = spark.createDataFrame
    usable = make([("c1", "a", 1), ("c2", "b", 2), ("c3", "a", 1)], "claim_id string, node_id string, node_revision int")
    edge = "edge_id string, type string, from_node string, from_revision int, from_claim string, to_node string, to_revision int, to_claim string, rationale string, derivation_ref string"
    good = ("e", "ABOUT", "a", 1, "c1", "b", 2, "c2", None, None)
    mark = make([good], edge).select(policy.edge_fingerprint().alias("m")).first().m
    review = lambda *rows: make(rows, "edge_id string, status string, fingerprint string")

    def count(row=good, reviews=None, claims_=usable):
        edges = make([row], edge)
        now = edges.select(policy.edge_fingerprint().alias("m")).first().m
        return policy.usable_edges(edges, claims_, review(("e", "validated", now)) if reviews is None else reviews).count()

    assert count() == 1 and count((*good[:8], "seen in both", "proof")) == 1
    assert count((*good[:8], "maybe [HYP_EDGE] so", None)) == 0
    for bad in (review(), review(("e", "candidate", mark)), review(("e", None, mark)), review(("e", "validated", "other")), review(("e", "validated", None)), review(("f", "validated", mark))):
        assert count(reviews=bad) == 0
    for place, value in ((2, "z"), (3, 2), (3, None), (4, None), (4, "c9"), (5, "z"), (6, 1), (7, None), (7, "c9")):
        assert count((*good[:place], value, *good[place + 1 :])) == 0
    assert count(claims_=usable.where("claim_id <> 'c1'")) == 0 and count(claims_=usable.where("claim_id <> 'c2'")) == 0
    # Any change after the review undoes it.
    for place in range(1, 10):
        changed = (*good[:place], 1 if place in (3, 6) else "a" if place == 2 else "new", *good[place + 1 :])
        assert changed == good or count(changed, review(("e", "validated", mark))) == 0
