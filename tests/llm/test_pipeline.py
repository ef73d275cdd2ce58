"""The corpus pipeline, stage by stage, on a small table with nulls, ties, repeats and other columns."""

import collections

import corpus_pipeline
import numpy as np
import pytest

from gleanmark.llm import weakrules
from gleanmark.llm.common import materialise
from tests.llm.test_operators import brute_lines, brute_links, split

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, lost int"


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(31)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("ra", "so", "tiv", "zan")]
    say = lambda n: " ".join(rng.choice(words, n)) + "."
    out = [(i, "\n".join(say(30) for _ in range(3)), "en", "abc"[i % 3], 1, "r", 1) for i in range(30)]
    near = out[0][1].split(" ")
    near[5] = near[40] = near[70] = "changed"
    out += [(40, " ".join(near), "en", "a", 1, "r", 1), (41, out[1][1], "de", None, 1, "r", 1), (41, out[1][1], "de", None, 1, "r", 1)]
    out += [(42, None, None, None, None, None, None), (43, "", "en", "a", 0, "r", 1), (44, "# * $ % " * 30, "en", "b", 1, "r", 1), (45, "too short", "en", "b", 1, "r", 1)]
    out += [(46, say(25) + "\n" + out[2][1].split("\n")[1] + "\n" + say(25), "en", "c", 1, "r", 1), (None, say(60), "en", "a", 1, "r", 1), (47, say(4000), "en", "b", 1, "r", 1)]
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_one_after_the_other(spark, table):
    docs = materialise(spark.createDataFrame(table, COLUMNS).repartition(3), "documents")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality rules", "line dedup", "near dedup", "source mixing", "best-fit packing"]

    kept = materialise(stage["quality rules"](spark, docs, ""), "kept")
    judged = {(r.doc_id, r.n_words): r.kept for r in weakrules.judge(docs).collect()}
    assert kept.columns == docs.columns
    assert sorted(rows(kept), key=str) == sorted((r for r in table if judged[r[0], len(split(r[1]))]), key=str)
    left = {r[0] for r in rows(kept)}
    assert set(range(30)) <= left and not left & {42, 43, 44, 45}

    lined = materialise(stage["line dedup"](spark, kept, ""), "lined")
    stored = rows(kept)
    gone = collections.Counter(brute_lines(stored))
    want = collections.Counter()
    for doc, text, *rest in stored:
        lines = text.split("\n")
        if doc == 41:  # two equal rows, whose lines document 1 has
            continue
        stay = [x for k, x in enumerate(lines) if not gone[doc, k]]
        if any(map(split, stay)):
            new = "\n".join(stay)
            want[doc, new, *rest[:2], len(new) if len(stay) < len(lines) else rest[2], *rest[3:]] += 1
    got = collections.Counter(rows(lined))
    assert lined.columns == docs.columns
    assert collections.Counter((r[0], r[1]) for r in got.elements()) == collections.Counter((r[0], r[1]) for r in want.elements())
    assert all(r[4] == len(r[1]) for r in got if gone[r[0], 0] or gone[r[0], 1] or gone[r[0], 2])

    near = materialise(stage["near dedup"](spark, lined, ""), "near")
    links = brute_links(rows(lined), 80, 100)
    assert near.columns == docs.columns and near.count() == len({c if c is not None else id(c) for _, _, c in links})

    mixed = materialise(stage["source mixing"](spark, near, ""), "mixed")
    sizes = collections.Counter()
    for r in rows(near):
        sizes[r[3]] += len(split(r[1]))
    taken = collections.Counter()
    for r in rows(mixed):
        taken[r[3]] += len(split(r[1]))
    assert mixed.columns == docs.columns and set(rows(mixed)) <= set(rows(near))
    longest = max(len(split(r[1])) for r in rows(near))
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 3 * longest and all(taken[s] <= 2 * sizes[s] for s in taken)

    packed = stage["best-fit packing"](spark, mixed, "").collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(r[0] for r in rows(mixed))
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_on_an_empty_table(spark, table):
    docs = materialise(spark.createDataFrame(table, COLUMNS).where("doc_id = -1"), "none")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == "best-fit packing" or out.columns == docs.columns)
