"""Relation blocks, note migration, positions, canonical JSON and salvage against Python's own."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gleanmark.functions import text as X


def row(spark, c, v, kind="string"):
    return spark.createDataFrame([(v,)], f"v {kind}").select(c(F.col("v")).alias("x")).first().x


def test_relation_blocks_open_and_close_records(spark):
    told = lambda t: [tuple(r) for r in row(spark, X.relations, t)]
    block = """x
## Relations

stray line
type: orphan
- to: K-1 : odd
  type: part
  confidence: bad
  note: "said: \\"so\\""
   - to: K-2
  confidence: 1e-1
  epistemic_status: approved
  type: whole
  type: again
- [nested] note
  - sub: x
- to:
## Next
- to: K-9
"""
    assert told(block) == [(None, "orphan", None, None, None), ("K-1 : odd", "part", 0.5, None, 'said: \\"so\\'), ("K-2", "again", 0.1, "approved", None), ("", None, None, None, None)]
    assert told("## Relations\n- to: K-1\n  confidence: 0.8f") == [("K-1", None, 0.5, None, None)]
    assert told("none") == [] and told("## Relations\n\n") == []


NOTE = "---\nconcept_id: K-0001\n---\nabout\n## Related Concepts\n{}\n## More\nend"


def test_notes_are_migrated_once(spark):
    lines = ["- concept_id: K-0002, relation_type: part_of — why (so)", "- concept_id: K-0003 relation_type: is_a", "- K-0004（名前）：説明", "K-0005: plain", "- K-0006 名前: more: yet", "- K-7: short id", "", "prose"]
    got = row(spark, X.migrated, NOTE.format("\n".join(lines)))
    want = [("K-0002", "part_of", "why (so"), ("K-0003", "is_a", ""), ("K-0004", "related", "説明"), ("K-0005", "related", "plain"), ("K-0006", "related", "名前 — more: yet")]
    assert got.startswith("---\nconcept_id: K-0001\nschema_version: 2\n---\nabout\n## Relations\n\n- to: K-0002\n") and got.endswith("\n\n\n## More\nend")
    assert [(r.to, r.type, r.note or "") for r in row(spark, X.relations, got)] == want
    assert [(r.confidence, r.epistemic_status) for r in row(spark, X.relations, got)] == [(0.8, "established")] * 5
    assert row(spark, X.migrated, got) is None and row(spark, X.migrated, "no header") is None and row(spark, X.migrated, "---\nx") is None and row(spark, X.migrated, None) is None
    assert "## Relations\n\n(なし)\n" in row(spark, X.migrated, NOTE.format("nothing"))
    assert row(spark, X.migrated, "---\na: 1\n---\nbody") == "---\na: 1\nschema_version: 2\n---\nbody"


def test_cards_read_by_context(spark):
    rows = spark.createDataFrame([("approved", "c/K-1.md", "base", {"science": "delta"}, {"science": "verified"}), ("draft", "c/K-2.md", "base", {}, {}), ("accepted", "c/_inbox/K-3.md", "base", {}, {}), ("accepted", "c/K-4.md", "base", None, None), (None, "p", "base", {}, {})], "status string, path string, definition string, deltas map<string,string>, states map<string,string>")
    told = [tuple(r.v) for r in rows.select(X.facet_view(*map(F.col, rows.columns), "science").alias("v")).collect()]
    assert told == [("delta", "verified"), ("", "unverified"), ("", "unverified"), ("base", "established"), ("", "unverified")]


def test_positions_make_a_text(spark):
    told = lambda m: row(spark, X.from_positions, m, "map<string,array<int>>")
    assert told({"b": [5, 1], "a": [0, 3]}) == "a b a b" and told({}) == "" and told(None) is None
    assert told({"x": [0, 2], "y": [2], "z": [2, 9]}) == "x z z"
    words = [random.Random(1).choice("abcdefg") for _ in range(3000)]
    index = {w: [i for i, x in enumerate(words) if x == w] for w in dict.fromkeys(words)}
    assert told(index) == " ".join(words)


ODD = ["", "plain", 'quo"te', "back\\slash\\n", "\n\r\t\b\f", "".join(map(chr, range(1, 33))), "\x00", "\x7f\x80", "é 日本 😀", " </script>", "{}[],: ", None]


def test_canonical_json_equals_pythons(spark):
    rows = [(t, i if i % 2 else None, i % 3 == 0, [t, None, "z"], {f"k{t}": "v", "b": t, "A": None} if t is not None else {}, (2, t)) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "t string, n long, b boolean, a array<string>, m map<string,string>, s struct<z:int,`a b`:string>")
    digest = X.json_digest(df, "t", "n", "b", "a", "m", "s")
    for r in df.select("*", digest.alias("d")).collect():
        data = [r.t, r.n, r.b, r.a, r.m, r.s.asDict()]
        assert r.d == hashlib.sha256(json.dumps(data, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    with pytest.raises(TypeError):
        X.json_digest(spark.createDataFrame([(0.5,)], "x double"), "x")


def test_answers_are_salvaged(spark):
    told = lambda t: row(spark, lambda c: F.try_variant_get(X.salvaged(c), "$.a", "int"), t)
    assert told('so:\n```json\n{"a": 1}\n``` and {"a": 3}') == 1 and told('```\n {"a": 2} \n```') == 2 and told('{"a": 3}') == 3
    assert told('well {"a": 4, "b": {"c": "}"}} done') == 4 and told('```json\nsee {"a": 5}!\n```') == 5
    assert told("none") is None and told('{"a": ') is None and told(None) is None and told("} {") is None
    assert row(spark, X.salvage_json, 'so:\n```json\n{"a": 1}\n```') == '{"a": 1}'
