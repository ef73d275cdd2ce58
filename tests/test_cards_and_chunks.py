"""Card rules on odd rows, and the chunks query against a plain loop."""

import hashlib
import json
from collections import Counter

from pyspark.sql import functions as F

from gleanmark.functions import text as X
from gleanmark.operators import cards, planning
from gleanmark.plans import catalog


def test_courses_are_classified_in_order(spark):
    departments = spark.createDataFrame([("6", "EECS", "Computing"), ("18", "Maths", "Maths"), ("21M", "Music", "Arts")], "dept string, discipline string, broad string")
    want = {
        "MIT 6.0001 Intro": ("6", "EECS", "Computing"),
        "How We Teach: MIT 18.01, like 6.01": ("18", "Maths", "Maths"),
        "How We Teach: 99.1 and 6.2": (None, None, None),
        "RES.6-007 Signals 18.1": ("6", "EECS (Supplemental)", "Computing"),
        "RES.99-1 and 18.2": ("18", "Maths", "Maths"),
        "mit 21m.301 Harmony": ("21M", "Music", "Arts"),
        "none": (None, None, None),
        None: (None, None, None),
    }
    folders = spark.createDataFrame([(x,) for x in want] + [("none",)], "folder string")
    got = cards.classified(folders, departments).collect()
    assert len(got) == len(want) + 1 and {r.folder: (r.dept, r.discipline, r.broad) for r in got} == want
    paths = spark.createDataFrame([("14.12", "a/14-12F"), ("14.12", "A/14_12"), ("21M.1", "x/21m.1"), ("14.12", "1412"), (None, "x")], "c string, p string")
    assert [r.m for r in paths.select(cards.course_matches(F.col("c"), F.col("p")).alias("m")).collect()] == [True, True, True, False, None]


def test_cards_statuses_aliases_and_sources(spark):
    row = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v")).alias("x")).first().x
    note = "---\nid: K-0001\nstatus: 'draft'\nstatus: other\n---\nstatus: body\n"
    assert row(cards.status_of, note) == "draft" and row(cards.status_of, "none") == "unknown"
    assert row(lambda c: cards.with_status(c, F.lit("accepted")), note) == note.replace("'draft'", '"accepted"')
    assert row(lambda c: cards.with_status(c, F.lit("accepted")), "no line") == "no line" and row(lambda c: cards.with_status(c, F.lit("x")), None) is None
    assert row(cards.card_id, "see K-1234x and K-9999") == "K-1234" and row(cards.card_id, "K-12") is None
    assert row(cards.has_sources, "a\n## Source Refs\n") and not row(cards.has_sources, "## Sources")
    assert row(cards.english_alias, 'aliases: ["概念", one, "second price auction", two words]') == "second price auction" and row(cards.english_alias, "aliases: [one]") is None


def test_nests_histories_and_queues(spark):
    make = spark.createDataFrame
    nodes = make([("a", 1), ("a", 2), ("b", 1)], "id string, revision int")
    claims = make([("c2", "a", "two"), ("c1", "a", None), ("c3", "z", "x")], "claim_id string, node_id string, statement string")
    assert {r.id: (r.revision, [tuple(c) for c in r.claims]) for r in cards.nested(nodes, claims).collect()} == {"a": (2, [("c1", None), ("c2", "two")]), "b": (1, [])}
    events = make([("K", 2, "b", "x"), ("K", 1, "a", None), ("L", 1, "c", "y")], "ref string, at int, event_type string, actor string")
    assert {r.ref: [tuple(e) for e in r.events] for r in cards.history(events, "ref", ["at"]).collect()} == {"K": [("a", None), ("b", "x")], "L": [("c", "y")]}
    files = make([("b", b"same", "text"), ("a", b"same", " "), ("c", b"known", "x"), ("d", b"new", None)], "path string, content binary, text string")
    known = make([(hashlib.sha256(b"known").hexdigest()[:16],)], "id string")
    assert sorted((r.path, r.characters, r.state) for r in cards.queued(files, known).collect()) == [("a", 1, "needs_ocr"), ("d", 0, "needs_ocr")]


def test_answers_are_checked(spark):
    plan = {"pilot": dict.fromkeys(cards.PLAN_KEYS, 1)}
    less = {"pilot": dict.fromkeys(cards.PLAN_KEYS[1:], 1)}
    review = lambda *f: json.dumps({"reviews": [{"recommend_for_followup": x} for x in f]})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([review(True, True, False), review(True, True, True), review(), '{"reviews": 1}', "none", json.dumps(plan), f"```json\n{json.dumps(less)}\n```"])], "i int, t string")
    told = rows.select("i", X.salvaged(F.col("t")).alias("v")).select("i", cards.valid_critique(F.col("v")).alias("c"), cards.valid_plan(F.col("v")).alias("p"))
    assert [(r.c, r.p) for r in told.orderBy("i").collect()] == [(True, False), (False, False), (False, False), (False, False), (False, False), (False, True), (False, False)]


def test_topics_take_nodes_and_facets_in_turn(spark):
    nodes = spark.createDataFrame([("b", "Bee", 0.5, "x,y"), ("a", None, 0.5, "y"), ("c", "See", 0.9, ""), ("d", "Dee", 0.7, "z")], "id string, title string, score double, least_covered string")
    got = planning.topics(nodes, {"x": "X {concept}?", "y": "Y {concept}?"}, 3).collect()
    assert [(r.place, r.id, r.facet, r.query) for r in got] == [(1, "d", "z", "X Dee?"), (2, "a", "y", "Y ?"), (3, "b", "x", "X Bee?")]


def lecture(text, size=4000, overlap=400, least=2000):
    head, _, body = text.partition("\n\n")
    while "\n\n\n" in body:
        body = body.replace("\n\n\n", "\n\n")
    body = body.strip()
    if not body:
        return [head]
    out, at = [], 0
    while at < len(body):
        stop = min(at + size, len(body))
        if stop < len(body):
            cut = body.rfind("\n", at + least, stop)
            stop = cut if cut >= 0 else stop
        out.append(f"{head}\n\n{body[at:stop].strip()}")
        at = len(body) if stop == len(body) else max(stop - overlap, at + 1)
    return out


def test_the_chunks_query_equals_a_loop(spark, sf):
    got = Counter(map(tuple, catalog.QUERIES["chunks"](spark, sf).collect()))
    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        for place, chunk in enumerate(lecture(r.text) if r.text is not None else []):
            want[r.doc_id, place, len(chunk), hashlib.md5(chunk.encode()).hexdigest()] += 1
    assert got == want
