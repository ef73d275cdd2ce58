"""Operators on hand-built frames: nulls, ties, empty tables, and the rules that SQL doesn't show."""

from collections import Counter

from pyspark.sql import functions as F

from gleanmark.functions import text as X
from gleanmark.operators import checks, claims, gaps, graph, policy, quality, retrieval, upkeep
from gleanmark.sources import notes
from gleanmark.streaming import log

NODE = "id string, revision int, layer string, type string, subtype string, status string"
CLAIM = "claim_id string, node_id string, node_revision int, statement string, kind string, epistemic_status string"
EDGE = "edge_id string, type string, from_node string, from_revision int, to_node string, to_revision int, derivation_ref string, confidence double"
SUPPORT = "evidence_id string, target_node string, target_revision int, target_claim string, assessor string"


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_null_subtypes_drop_out_of_unsupported_claims(spark):
    nodes = spark.createDataFrame([("a", 1, "science", "T", None, "approved"), ("b", 1, "science", "T", "LAW", "approved"), ("c", 1, "science", "T", "HYP", "approved"), ("d", 1, "science", "T", "LAW", "stale")], NODE)
    rows = spark.createDataFrame([(f"{n}#1", n, 1, "s", "theorem", "unverified") for n in "abcd"] + [("b#2", "b", 1, "s", "definition", "unverified"), ("b#3", "b", 2, "s", "theorem", "unverified")], CLAIM)
    none = spark.createDataFrame([], SUPPORT)
    assert ids(gaps.unsupported_claims(rows, nodes, none), "claim_id") == ["b#1"]
    assert ids(gaps.unsupported_claims(rows, nodes, none, metric=True), "claim_id") == ["b#1", "d#1"]


def test_ledger_is_idempotent(spark):
    nodes = spark.createDataFrame([("u", 1, "universe", "W", "WM", "approved")], NODE)
    found = gaps.ledger(spark.createDataFrame([], CLAIM), nodes, spark.createDataFrame([], EDGE), spark.createDataFrame([], SUPPORT))
    assert found.count() == 1 and gaps.upsert(found, found).count() == 0 and len(found.first().gap_id) == 8


def test_shared_evidence_verifies_an_edge_only_at_its_revisions(spark):
    edge = lambda i, a, b, ra=1, d=None: (i, "DERIVES_FROM", a, ra, b, 1, d, 0.9)
    edges = spark.createDataFrame([edge("1", "a", "b"), edge("2", "a", "b", 2), edge("3", "a", "c"), edge("4", "a", "c", d=""), edge("5", "a", "c", d="proof")], EDGE)
    supports = spark.createDataFrame([("E", "a", 1, "x", "m"), ("E", "b", 1, "y", "m")], SUPPORT)
    assert ids(gaps.unverified_edges(edges, supports), "edge_id") == ["2", "3", "4"]


def test_usable_claims_fail_closed(spark):
    make = spark.createDataFrame
    nodes = make([("n", 1, "science", "T", "LAW", "approved", "data")], NODE + ", data string")
    told = make([("c", "n", 1, "statement", "theorem", "formally_verified", "none")], CLAIM + ", assumptions string")
    proof = make([("E", "n", 1, "c", "m")], SUPPORT)
    evidence = make([("E", "doi:10.1000/1", "h", None, "A")], "evidence_id string, source_uri string, content_hash string, origin_group string, reliability_grade string")
    mark = policy.placed(told, nodes).select(policy.claim_fingerprint().alias("m")).first().m
    seen = evidence.select(policy.evidence_fingerprint().alias("m")).first().m
    audit = lambda *rows: make(rows, "id int, claim_id string, decision string, validated_state string, fingerprint string, policy string, scope string")
    good = (1, "c", "passed", "formally_verified", mark, "v2", "all")
    audited = lambda *rows: make(rows, "id int, evidence_id string, fingerprint string")
    cited = lambda *rows: make(rows, "id int, path string, sha256 string")
    files = make([("a/b", "1"), ("../x", "2"), ("/y", "3")], "path string, sha256 string")

    def usable(c=told, n=nodes, v=None, s=proof, e=evidence, seen_evidence=None, seen_files=None, assets=files):
        return policy.usable_claims(c, n, audit(good) if v is None else v, s, e, audited((1, "E", seen)) if seen_evidence is None else seen_evidence, cited((1, "a/b", "1")) if seen_files is None else seen_files, assets).count()

    assert usable() == 1
    assert usable(v=audit()) == 0 and usable(s=proof.where("false")) == 0
    assert usable(v=audit(good, (2, "c", "deferred", "formally_verified", mark, "v2", "all"))) == 0
    for change in ({2: "deferred"}, {3: "unverified"}, {4: None}, {5: "v1"}, {6: ""}, {6: None}):
        assert usable(v=audit(tuple(change.get(i, v) for i, v in enumerate(good)))) == 0
    for column in ("statement", "assumptions"):
        assert usable(c=told.withColumn(column, F.lit("other"))) == 0
    for status in ("proposed", "blocked", "stale", "superseded"):
        assert usable(n=nodes.withColumn("status", F.lit(status))) == 0
    assert usable(n=nodes.withColumn("data", F.lit("other"))) == 0
    for column in evidence.columns[1:]:
        assert usable(e=evidence.withColumn(column, F.lit("changed"))) == 0
    assert usable(seen_evidence=audited()) == 0 and usable(seen_evidence=audited((1, "E", seen), (1, "F", seen))) == 0
    for bad in ((), ((1, "a/b", "2"),), ((1, "a/b", "1"), (1, "gone", "1")), ((1, "../x", "2"),), ((1, "/y", "3"),)):
        assert usable(seen_files=cited(*bad)) == 0
    assert usable(assets=files.where("false")) == 0


def test_lineage_counts_only_what_was_confirmed_for_this_metadata(spark):
    evidence = spark.createDataFrame([("E", "doi:10.1000/1", "h", "g", "A"), ("F", "doi:10.1000/2", "h", "g", "A"), ("G", None, None, None, None)], "evidence_id string, source_uri string, content_hash string, origin_group string, reliability_grade string")
    none = spark.createDataFrame([], "evidence_id string, canonical_work string, independent_group string, independence_review string, metadata_fingerprint string")
    fresh = policy.refreshed(none, evidence, X.canonical_work(F.col("source_uri")))
    assert {r.evidence_id: (r.canonical_work, r.independence_review) for r in fresh.collect()} == {"E": ("doi:10.1000/1", "unreviewed"), "F": ("doi:10.1000/2", "unreviewed"), "G": (None, "unreviewed")}
    reviewed = fresh.withColumn("independent_group", F.col("evidence_id")).withColumn("independence_review", F.lit("confirmed"))
    supports = spark.createDataFrame([(e, "n", 1, "c", "m") for e in "EFG"], SUPPORT)
    count = lambda l, e: [r.origins for r in quality.independent_support(supports, policy.confirmed(l, e)).collect()]
    assert count(fresh, evidence) == [] and count(reviewed, evidence) == [3]
    changed = evidence.withColumn("content_hash", F.when(F.col("evidence_id") != "F", F.col("content_hash")).otherwise("new"))
    assert count(reviewed, changed) == [2]
    again = {r.evidence_id: r.independence_review for r in policy.refreshed(reviewed, changed, X.canonical_work(F.col("source_uri"))).collect()}
    assert again == {"E": "confirmed", "F": "unreviewed", "G": "confirmed"}


def test_stale_spreads_against_edges_and_stops_at_proofs(spark):
    nodes = spark.createDataFrame([(x, 1, "l", "t", "s", "superseded" if x == "d" else "approved") for x in "oabcde"], NODE)
    edges = spark.createDataFrame([(f"{a}{b}", "DERIVES_FROM", a, 1, b, 1, None, 0.5) for a, b in ("ao", "ba", "cb", "do", "ed")] + [("w", "PLANS", "e", 1, "o", 1, None, 0.5)], EDGE)
    seed = nodes.where("id = 'o'")
    assert ids(graph.stale_closure(edges, nodes, seed, nodes.where("false"))) == ["a", "b", "c"]
    assert ids(graph.stale_closure(edges, nodes, seed, nodes.where("id = 'b'"))) == ["a"]


def test_distances_cycles_and_paths(spark):
    edges = spark.createDataFrame([(f"{a}{b}", "DERIVES_FROM", a, 1, b, 1, None, c) for a, b, c in (("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.5), ("c", "a", 0.2))], EDGE)
    steps = graph.undirected(edges)
    assert {r.id: r.hops for r in graph.distances(spark.createDataFrame([("a",)], "id string"), steps).collect()} == {"a": 0, "b": 1, "c": 1}
    ways = edges.select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
    assert ids(graph.cycle_components(ways)) == ["a", "b", "c"] and graph.cycle_components(ways.where("src <> 'c'")).count() == 0
    best = {r.id: (round(r.confidence, 2), r.path) for r in graph.best_paths(edges, spark.createDataFrame([("a",)], "id string")).collect()}
    assert best == {"a": (1.0, "a"), "b": (0.9, "a>b"), "c": (0.81, "a>b>c")}


def test_bm25_order_and_empty_queries(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "apple apple tree stands here"), (3, None), (4, "tree")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "Apple tree"), (2, ""), (3, "nothing")], "query_id int, query string")
    scored = retrieval.bm25(docs, "doc_id", {"text": 1.0}, asked)
    assert {r.query_id for r in scored.collect()} == {1}
    assert [r.doc_id for r in retrieval.bm25(docs, "doc_id", {"text": 1.0}, asked, every=True).collect()] == [2]
    back = retrieval.backed_off(docs, "doc_id", {"text": 1.0}, spark.createDataFrame([(1, "apple pie nowhere"), (2, "apple")], "query_id int, query string")).collect()
    assert [(r.query_id, r.n_terms, r.doc_id) for r in back] == [(1, 2, 1)]


def test_rrf_rewards_agreement(spark):
    ranks = lambda *r: spark.createDataFrame([(1, d, i) for i, d in enumerate(r)], "query_id int, doc_id int, rank int")
    fused = {r.doc_id: r.score for r in retrieval.rrf([ranks(7, 8), ranks(8, 9)], "doc_id").collect()}
    assert max(fused, key=fused.get) == 8 and abs(fused[7] - 1 / 61) < 1e-12


def test_duplicates_have_verdicts(spark):
    new = spark.createDataFrame([("n1", "gravity bends light strongly"), ("n2", "zzz"), ("n3", None)], "claim_id string, statement string")
    known = spark.createDataFrame([("k2", "light bends gravity strongly"), ("k1", "strongly gravity light bends"), ("k3", "gravity waves")], "claim_id string, statement string")
    got = {r.claim_id: (r.match_id, r.verdict) for r in claims.duplicates(new, known).collect()}
    assert got == {"n1": ("k1", "identical"), "n2": (None, "new"), "n3": (None, "new")}


def test_text_functions(spark):
    row = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v")).alias("x")).first().x
    assert row(X.canonical_work, " https://DX.doi.org/10.1000/A%2Fb+c ") == "doi:10.1000/a/b+c"
    assert row(X.canonical_work, "http://example.org") is None and row(X.canonical_work, None) is None
    assert row(X.field_id, "Arts & Crafts") == "F-ARTS" and row(X.shorten, "x" * 46) == "x" * 42 + "..."
    assert row(X.front_matter, "---\na: 1\nb-c: two words\na: 3\n---\nbody: 4\n") == {"a": "3", "b-c": "two words"}
    assert row(lambda c: X.section(c, "Two"), "## One\nx\n## Two\ny\nz\n## Three\n") == "y\nz"
    assert row(X.salvage_json, 'so:\n```json\n{"a": 1}\n```') == '{"a": 1}' and row(X.salvage_json, "none") is None


def test_attribution_looks_at_the_whole_sentence(spark):
    told = spark.createDataFrame([("as proposed by A, prices rise", "prices rise"), ("Shown by B. Our prices rise", "Our prices rise"), ("this method works", "this method works"), ("x", "y")], "t string, q string")
    got = [list(r.r) for r in told.select(X.attribution_reasons(F.col("q"), F.col("t")).alias("r")).collect()]
    assert got == [["prior_work"], [], ["cropped_antecedent"], ["quote_missing"]]


def test_windows_follow_their_rule(spark):
    line = "some words and yet more of them, é\n"
    texts = ["", "short", "x" * 9000, line * 400, ("y" * 2500 + "\n") * 6, "\n" * 5000, line * 10 + "z" * 7000, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", notes.windows(F.col("t"), 4000, 400).alias("w")).collect()
    for i, found in rows:
        text = texts[i]
        if not text:
            assert not found
            continue
        assert found[0].at == 0 and found[-1].stop == len(text)
        for w, after in zip(found, [*found[1:], None], strict=True):
            last = [k for k in range(w.at + 2000, w.at + 4000) if k < len(text) and text[k] == "\n"]
            ends = len(text) if w.at + 4000 >= len(text) else (last or [w.at + 4000])[-1]
            assert w.stop == ends and (after is None or after.at == max(w.stop - 400, w.at + 1))


def test_chunks_tell_their_source(spark):
    body = "\n\n\n\n" + "word " * 1500 + "\n\n\n" + "more " * 900 + "\n"
    docs = spark.createDataFrame([(1, "head" + "\n\n" + body), (2, "only a head"), (3, None), (4, "")], "doc_id int, text string")
    got = {k: [r.chunk for r in sorted(notes.chunks(docs, "doc_id", "text").where(F.col("doc_id") == k).collect(), key=lambda r: r.place)] for k in (1, 2, 3, 4)}
    assert got[2] == ["only a head"] and got[3] == [] and got[4] == [""]
    assert len(got[1]) == 4 and all(c.startswith("head\n\nword") or c.startswith("head\n\nmore") or len(c) <= 4006 for c in got[1]) and not any("\n\n\n" in c for c in got[1])
    assert [r.chunk for r in notes.chunks(docs.where("doc_id > 1"), "doc_id", "text", notes.plain).orderBy("doc_id").collect()] == ["only a head", ""]


def test_manifest_without_deletes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, digest string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, digest string")
    act = lambda delete: {r.path: r.action for r in notes.manifest_diff(old, new, delete).collect()}
    assert act(True) == {"a": "skip", "b": "update", "c": "delete", "d": "insert"} and "c" not in act(False)


def test_markdown_notes(spark, tmp_path):
    for name, text in {"accepted/K-1.md": "---\nstatus: approved\ntitle: One\n---\nx", "accepted/K-2.md": "---\nstatus: draft\n---\n", "concepts/_inbox/K-3.md": "---\nstatus: approved\n---\n", "perspectives/P-1.md": "---\nUser_Confirmed: TRUE\n---\n", "accepted/README.md": "---\nstatus: approved\n---\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert ids(notes.markdown(spark, str(tmp_path)), "stem") == ["K-1", "P-1"]
    assert len(ids(notes.markdown(spark, str(tmp_path), include_inbox=True), "stem")) == 4
    assert notes.workspace(spark, str(tmp_path), (".md",), ("_inbox",)).count() == 4


def test_low_yield_runs_and_votes(spark):
    rows = spark.createDataFrame([("u", i, v) for i, v in enumerate([1, 0, 0, 0, 5, 0])], "u string, i int, v int")
    assert [(r.low_run, r.tripped) for r in quality.low_yield(rows, "u", ["i"], "v", 1).orderBy("i").collect()] == [(0, False), (1, False), (2, False), (3, True), (0, False), (1, False)]
    votes = spark.createDataFrame([("x", "b", 1), ("x", "a", 2), ("y", "a", 1), ("y", "a", 2)], "item string, choice string, place int")
    assert {r["item"]: (r.winner, r.how) for r in quality.majority(votes, "item", "choice", "place").collect()} == {"x": ("b", "plurality"), "y": ("a", "unanimous")}


def test_huffman_codes(spark):
    rows = spark.createDataFrame([("g", s, float(n)) for s, n in zip("abcd", (8, 4, 2, 2), strict=True)] + [("one", "z", 3.0)], "g string, symbol string, weight double")
    got = {(r.g, r.symbol): r.code for r in checks.huffman(rows, "g").collect()}
    assert [len(got["g", s]) for s in "abcd"] == [1, 2, 3, 3] and got["one", "z"] == "0"
    codes = [got["g", s] for s in "abcd"]
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert checks.code_lengths(checks.huffman(rows, "g"), "g").where("average_length >= entropy and average_length <= entropy + 1").count() == 2


def test_event_stream_projects_once(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    rows = [(1, 10, "a"), (2, 20, "b"), (1, 10, "a")]
    df = spark.createDataFrame([(e, u, t) for e, u, t in rows], "event_id long, user_id long, event_type string").select("event_id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"))
    df.write.parquet(str(tmp_path / "in"))
    query = log.stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r.event_id for r in out.collect()) == {1: 1, 2: 1}
    assert out.where("origin = 'synthetic'").count() == 2
    assert log.windows(df.withColumn("ts", F.col("ts").cast("timestamp"))).first().n >= 1


def test_upkeep_of_indexes_and_logs(spark):
    make = spark.createDataFrame
    manifest = make([("same", "1"), ("changed", "1"), ("gone", "1")], "path string, digest string")
    current = make([("same", "1", "s"), ("changed", "2", "c"), ("new", "3", "n"), ("none", None, "x")], "path string, digest string, content string")
    index = make([("same", "s"), ("changed", "old"), ("gone", "old")], "path string, content string")
    assert sorted(map(tuple, upkeep.apply_upsert(index, manifest, current).collect())) == [("changed", "c", "written"), ("new", "n", "written"), ("none", "x", "written"), ("same", "s", "kept")]
    assert sorted((r.path, r.usable) for r in upkeep.fresh(manifest, current).collect()) == [("changed", False), ("gone", False), ("same", True)]
    stored = make([("n", "f", 0.5, 2)], "node string, facet string, coverage double, attempts long")
    seen = make([("n", "f", 0.3), ("n", "f", 0.7), ("n", "g", 0.1)], "node string, facet string, coverage double")
    assert sorted(map(tuple, upkeep.max_merge(stored, seen, ["node", "facet"]).collect())) == [("n", "f", 0.7, 4), ("n", "g", 0.1, 1)]
    log = make([("a", 1, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, at int, state string")
    got = upkeep.latest_upsert(log.where("state = 'x' or k = 'b'"), log.where("state = 'y'"), "k", "at")
    assert sorted((r.k, r.state) for r in got.collect()) == [("a", "y"), ("b", "z")]
    assert [(r.state, r.changes) for r in upkeep.state_of(log.where("k = 'a'"), "k", ["at", "state"], "state").collect()] == [("y", 2)]


def test_new_nodes_and_candidates_are_checked(spark):
    rows = spark.createDataFrame([("science", "p", True, "ABOUT", "long enough"), (None, None, None, None, None), ("nowhere", "p", None, "ABOUT", "short")], "l string, p string, k boolean, e string, d string")
    c = F.col
    assert [r.f for r in rows.select(upkeep.node_faults(c("l"), c("p"), c("k"), c("e"), c("d")).alias("f")).collect()] == ["", "layer,no_parent,no_edge,indistinct", "layer,unknown_parent,indistinct"]
    shapes = spark.createDataFrame([(["a"], [1]), (["a", " "], [1]), ([], [1]), (["a"] * 9, [1]), (["a"], [3]), (None, [1]), (["a"], None)], "c array<string>, s array<int>")
    assert [r.ok for r in shapes.select(upkeep.shape_ok(c("c"), c("s"), F.array(F.lit(1), F.lit(2))).alias("ok")).collect()] == [True] + [False] * 6


def test_passages_are_found_letter_by_letter(spark):
    long = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, f"zero{long}nine"), (2, long), (3, "one two three four five six  seven eight"), (4, None), (5, "a short one"), (6, f"x {long} y {long}")], "doc_id long, text string")
    items = spark.createDataFrame([(10, long), (11, "short o"), (12, None)], "query_id long, passage string")
    assert sorted((r.query_id, r.doc_id) for r in retrieval.containing(docs, "doc_id", items).collect()) == [(10, 1), (10, 2), (10, 6), (11, 5)]
