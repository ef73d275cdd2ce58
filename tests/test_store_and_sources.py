"""The versioned store, the data sources and the ledger stream: failures, repeats, malformed files, restarts."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleanmark.operators import gaps, graph, planning
from gleanmark.sources import readers, versioned
from gleanmark.streaming import ledger

NODE = "id string, revision int, layer string, type string, status string"


def states(df):
    return sorted((r.id, r.revision, r.status) for r in df.collect())


def test_a_commit_that_fails_before_its_manifest_is_never_read(spark, tmp_path, monkeypatch):
    store = versioned.Store(str(tmp_path / "store"))
    nodes = spark.createDataFrame([("a", 1, "science", "T", "draft"), ("b", 1, "science", "T", "draft"), ("b", 1, "science", "T", "draft")], NODE)
    assert versioned.read(spark, store, "node") is None
    assert versioned.add_nodes(spark, store, "one", nodes) == 0
    change = spark.createDataFrame([("a", 1, "approved"), ("z", 1, "approved")], "id string, revision int, new_status string")
    with monkeypatch.context() as m:
        m.setattr(versioned, "MANIFEST", versioned.MANIFEST + ", missing string")  # all is written but the manifest
        with pytest.raises(Exception):  # noqa: B017
            versioned.set_status(spark, store, "two", change)
    assert (tmp_path / "store" / "node" / "v=1").exists()
    assert states(versioned.read(spark, store, "node")) == [("a", 1, "draft"), ("b", 1, "draft")] and versioned.read(spark, store, "event").count() == 2
    # The same job again; and once more, which writes nothing.
    assert versioned.set_status(spark, store, "two", change) == 1 and versioned.set_status(spark, store, "two", change) == 1
    assert states(versioned.read(spark, store, "node")) == [("a", 1, "approved"), ("b", 1, "draft")]
    assert states(versioned.read(spark, store, "node", 0)) == [("a", 1, "draft"), ("b", 1, "draft")]
    assert Counter((r.event_type, r.entity_ref) for r in versioned.read(spark, store, "event").collect()) == {("node_created", "a"): 1, ("node_created", "b"): 1, ("status_changed", "a"): 1}
    # Revisions that are there stay as they are; new ones come behind the snapshot.
    more = spark.createDataFrame([("a", 1, "science", "T", "blocked"), ("a", 2, "science", "T", "draft")], NODE)
    assert versioned.add_nodes(spark, store, "three", more) == 2
    assert states(versioned.read(spark, store, "node")) == [("a", 1, "approved"), ("a", 2, "draft"), ("b", 1, "draft")]
    assert versioned.read(spark, store, "event").select("event_id").distinct().count() == 4


def test_rows_are_inserted_once_by_their_key(spark, tmp_path):
    store = versioned.Store(str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "what?", "x"), (2, "what?", "y"), (3, None, "z"), (4, "why?", "w")], "place int, question string, note string")
    put = lambda token, df: versioned.insert_new(spark, store, token, "question", df, F.lower("question"), "place")
    assert put("a", rows) == 0 and put("b", rows.withColumn("question", F.upper("question"))) == 1
    assert sorted((r.place, r.question) for r in versioned.read(spark, store, "question").collect()) == [(1, "what?"), (4, "why?")]


FILES = {
    "votes/a.txt": "# head\nF 1 | 6 | EECS | Eng\n\nbroken | line\nF 2|18|Maths|M\nF 1|8|Physics|N|extra\n",
    "votes/b.txt": "F 2 | 7 | Bio | N\r\n||||\n",
    "cards/K-1.md": '---\nconcept_id: "K-0001"\ncanonical_name: One\nstatus: approved\nstatus: accepted\n---\nx\n## Definition\nA thing\nof two lines\n## Relations\n- to: K-2\n',
    "cards/_inbox/K-2.md": "no header",
    "cards/README.md": "---\n---\n",
    "cards/K-3.txt": "",
    "lectures/x.ai_v1.md": "TITLE: A talk\nURL: http://example.org/1\nTITLE: other\n\nbody",
    "lectures/raw/y.ai_v1.md": "TITLE: raw",
    "lectures/z.terra.md": "no head",
    "lectures/old.txt": "TITLE: old",
    "lists/q.yaml": '# list\n- query: "one two"\n  expected: [K-1, "K-2"]\n  type: direct\n- query: three  # why\n  expected: K-3\nstray: x\n- type: only\n- query: ""\n-\n  query: four\n',
    "found/out.txt": "noise\n--- SOURCE 1 [v:1] ---\nTITLE: T\nURL: http://x\nVIDEO_ID: 9\n\nquote\nmore\n\n--- SOURCE 2 [v:2] ---\nTITLE: T\nURL: none\nVIDEO_ID: 9\n\nq\n--- SOURCE 3 [v:3] ---\nTITLE: T\n",
}


@pytest.fixture
def folder(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, newline="")
    (tmp_path / "votes" / "c.txt").write_bytes(b"\xff\xfe bad | 1 | 2 | 3\nF 3|1|2|3\n")
    (tmp_path / "empty").mkdir()
    readers.register(spark)
    return tmp_path


def test_sources_read_malformed_files_too(spark, folder):
    load = lambda kind, part: spark.read.format(kind).load(str(folder / part))
    votes = load("votes", "votes")
    got = {r.folder: (r.dept, r.discipline, r.broad) for r in readers.last_votes(votes).collect()}
    assert got == {"F 1": ("8", "Physics", "N"), "F 2": ("7", "Bio", "N"), "F 3": ("1", "2", "3"), "": ("", "", ""), "�� bad": ("1", "2", "3")}
    cards = {r.file: (r.card_id, r.title, r.status, r.definition, r.relations, r.inbox) for r in load("cards", "cards").collect()}
    assert cards == {"K-1.md": ("K-0001", "One", "accepted", "A thing\nof two lines", "- to: K-2", False), "_inbox/K-2.md": ("K-2", "K-2", "unknown", "", "", True)}
    assert {r.file: (r.title, r.source, r.url) for r in load("lectures", "lectures").collect()} == {"x.ai_v1.md": ("A talk", "", "http://example.org/1"), "z.terra.md": ("z", "", "")}
    assert [(r.place, r["query"], r.expected, r.type) for r in load("questions", "lists").orderBy("place").collect()] == [(0, "one two", ["K-1", "K-2"], "direct"), (1, "three", ["K-3"], None), (2, "four", [], None)]
    assert [(r.source_id, r.quote) for r in load("search_output", "found").collect()] == [("v:1", "quote\nmore")]
    assert load("votes", "empty").count() == 0


def test_filters_on_files_choose_what_is_read(spark, folder, monkeypatch):
    votes = spark.read.format("votes").load(str(folder / "votes"))
    (folder / "votes" / "c.txt").chmod(0o600)
    assert votes.where("file = 'b.txt'").count() == 2 and votes.where("file in ('a.txt', 'b.txt') and folder = 'F 1'").count() == 2 and votes.where("file like 'a%'").count() == 3
    reader = readers.FolderReader(str(folder / "votes"), "file string", readers.Votes.takes, readers.Votes.parse)
    kept = list(reader.pushFilters([readers.EqualTo(("file",), "b.txt"), readers.EqualTo(("folder",), "x")]))
    assert len(kept) == 2 and [p.paths for p in reader.partitions()] == [["b.txt"]]
    monkeypatch.setattr(readers, "PART_BYTES", 10)
    assert [p.paths for p in readers.FolderReader(str(folder / "votes"), "", readers.Votes.takes, readers.Votes.parse).partitions()] == [["a.txt"], ["b.txt"], ["c.txt"]]


def test_the_ledger_goes_on_over_batches_and_restarts(spark, tmp_path):
    at = lambda i: datetime(2024, 1, 1, 0, i)
    rows = []
    for i in range(60):
        rows.append((i % 3, at(i // 2), i, [None, "nothing", "linked", "reopen", "edge", "candidates", "nothing", "nothing"][(i * 7) % 8], [None, 5.0, 90.0, 1.0, 2.0, 3.0][i % 6]))
    schema = "key long, at timestamp, event_id long, outcome string, value double"
    want, held = {}, {}
    for key, t, n, outcome, value in sorted(rows, key=lambda r: (r[1], r[2])):
        held[key] = ledger.step(held.get(key, ("open", 0, 0, False, None, None)), t, n, outcome, value, 3, 40.0, 3)
        want[n] = (key, *held[key][:4])
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: ledger.run(spark, stream(), str(tmp_path / "out"), str(tmp_path / "check"))
    put = lambda some: spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(rows[:25])
    run()
    put(rows[25:40])
    put(rows[3:4])  # late, and already folded
    put(rows[40:])
    told = run()
    assert {r.event_id: (r.key, r.state, r.attempts, r.low_run, r.tripped) for r in told.where("not late").collect()} == want
    assert [r.event_id for r in told.where("late").collect()] == [3]
    assert run().count() == told.count() == 61  # nothing new, nothing told again
    assert {s for _, s, *_ in want.values()} >= {"candidate_ready", "retry_wait"} and any(w[4] for w in want.values())


def test_small_rules(spark):
    make = spark.createDataFrame
    relations = make([("a", "part", "approved"), ("b", "emerges_from", "verified"), ("c", None, "verified"), ("d", "part", "established"), ("e", "part", None)], "to string, type string, epistemic_status string")
    assert sorted(r.to for r in graph.followed(relations).collect()) == ["a", "c"]
    asked = make([(1, "x"), (1, "y"), (2, "x"), (3, "z"), (4, "w"), (5, "y")], "id int, card_id string")
    cards = make([("x", "accepted", True), ("y", "revise", True), ("w", "accepted", False)], "card_id string, status string, sourced boolean")
    assert {r.id: r.result for r in planning.coverage(asked, cards).collect()} == {1: "revision_required", 2: "accepted_ready", 3: "gap", 4: "gap", 5: "revision_required"}
    claims = make([("K", "c2", "lecture_derived", None), ("K", "c1", "lecture_derived", "supported_by_search_excerpt"), ("K", "h", "application_hypothesis", None), ("L", "c", "lecture_derived", "supported_by_search_excerpt"), ("M", "h", "application_hypothesis", None)], "card_id string, claim_id string, type string, disposition string")
    assert {r.card_id: (r.derived, r.supported, r.unresolved, r.hypotheses, r.review_ready) for r in planning.claim_audit(claims).collect()} == {"K": (2, 1, "c2", "h", False), "L": (1, 1, "", "", True), "M": (0, 0, "", "h", False)}
    seeds = make([("a", 0.5, ["n1", "n2", "n9"]), ("b", 0.9, ["n1", "n8"]), ("c", 0.9, ["n1", "n2", "n3"])], "domain string, alignment double, bridges array<string>")
    got = planning.expansion(seeds, make([("c",)], "domain string"), make([("n1",), ("n2",), ("n2",), ("n3",)], "id string")).collect()
    assert [(r.domain, r.bridge_count, round(r.score, 4)) for r in got] == [("a", 2, round(0.225 + 0.35 * 2 / 3 + 0.14, 4))]
    edges = make([("e1", "a", "b"), ("e2", "a", "b"), ("e3", "a", "a"), ("e4", "a", "c")], "edge_id string, from_node string, to_node string")
    supports = make([("E", "a"), ("E", "b"), ("F", "c")], "evidence_id string, target_node string")
    told = gaps.edge_gaps(edges.select(F.col("edge_id").alias("gap_id"), "edge_id"), edges, edges.where("edge_id <> 'e2'"), supports)
    assert {r.edge_id: r.state for r in told.collect()} == {"e1": "resolved", "e2": "open", "e3": "open", "e4": "open"}
