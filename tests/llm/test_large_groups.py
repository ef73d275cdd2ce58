"""Line dedup where many lines share most of their words: all similar ones are found, whatever the size of their groups."""

import random

import pytest

from gleanmark.llm import lines


@pytest.mark.parametrize("small", [2, 32])
def test_lines_of_one_template(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(lines, "SMALL", small)
    rng = random.Random(small)
    template = [f"t{i}" for i in range(10)]
    rows, every = [], []
    for doc in range(12):
        own = []
        for _ in range(8):
            extra = [f"own{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 3]))]
            words = rng.sample(template, rng.choice([9, 10, 10])) + extra + [f"often{rng.randrange(3)}"] * rng.randrange(2)
            own.append(" ".join(rng.sample(words, len(words))))
        rows.append((doc, "\n".join(own)))
        every += [(doc, i, set(line.split())) for i, line in enumerate(own)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    want = {(d, i) for at, (d, i, w) in enumerate(every) if any(9 * len(w & v) >= 4 * (len(w) + len(v)) for _, _, v in every[:at])}
    got = {(r.doc_id, r.line_no) for r in lines.removals(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == want and 5 < len(want) < len(every) - 5


def test_pairs_of_a_family_meet_once(spark, tmp_path, monkeypatch):
    """Lines that share most words, and yet too few, are handed on once a pair and not for each word in common."""
    template = [f"t{i}" for i in range(176)]
    rows = [(doc, " ".join(template + [f"own{doc}x{i}" for i in range(25)])) for doc in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    made, similar = [], lines._similar

    def counted(pairs, classes):
        made.append((pairs.count(), pairs.distinct().count()))
        return similar(pairs, classes)

    monkeypatch.setattr(lines, "_similar", counted)
    assert lines.removals(spark.read.parquet(str(tmp_path / "d"))).count() == 0
    assert len(made) == 2 and made[1][0] == made[1][1] > 10


def stored(monkeypatch):
    """How many rows each table has that line dedup stores, by its name."""
    rows, materialise = {}, lines.materialise

    def counted(df, label="table", **options):
        out = materialise(df, label, **options)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(lines, "materialise", counted)
    return rows


def test_lines_that_share_two_words_only_go_no_further(spark, tmp_path, monkeypatch):
    """Lines with two neighbours in common and nothing else are told apart where they meet, and neither stored nor looked up again."""
    rows = [(doc, " ".join(["both", "words"] + [f"own{doc}x{i}" for i in range(8)])) for doc in range(12)]
    rows += [(100, "some line that stands alone here"), (101, "some line that stands alone here too")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    seen = stored(monkeypatch)
    monkeypatch.setattr(lines, "levels", lambda classes: spark.range(1).selectExpr("array_repeat(0L, 131072) as level"))
    short = [(doc, "both words" + f" own{doc}") for doc in range(200, 212)]
    spark.createDataFrame(short, "doc_id long, text string").repartition(3).write.mode("append").parquet(str(tmp_path / "d"))
    assert [(r.doc_id, r.line_no) for r in lines.removals(spark.read.parquet(str(tmp_path / "d"))).collect()] == [(101, 0)]
    assert seen["members"] == 0 and seen["rest"] == 0 and seen["shared"] < 4


@pytest.mark.parametrize("copies", [1, 64])
def test_copies_of_a_line_are_dealt_out(spark, tmp_path, monkeypatch, copies):
    """The first of a frequent line's copies stays, whatever salts they have, and a line that it resembles goes."""
    monkeypatch.setattr(lines, "COPIES", copies, raising=False)
    often = "one line that stands in all documents of the table"
    rows = [(doc, f"own{doc} text{doc}\n{often}\n\n{often}") for doc in range(5, 45)] + [(2, f"{often} again"), (None, "null first\n ")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = sorted((r.doc_id, r.line_no) for r in lines.removals(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert got == [(doc, k) for doc in range(5, 45) for k in (1, 3)]
