"""Line dedup where groups share a key and little else, and where frequent words have small groups."""

from pyspark.sql import functions as F

from gleanmark.llm import lines
from tests.llm.test_large_groups import stored


def written(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(folder)
    return spark.read.parquet(folder)


def test_lines_that_fit_no_other_of_a_group_go_no_further(spark, tmp_path, monkeypatch):
    """Forty lines with the two first words of the order in common."""
    monkeypatch.setattr(lines, "levels", lambda classes: spark.range(1).selectExpr("array_repeat(0L, 131072) as level"))
    some = spark.range(5000).select(F.concat(F.lit("w"), "id").alias("w")).orderBy(F.hash("w")).limit(2).collect()
    rows = [(doc, " ".join([r.w for r in some] + [f"own{doc}x{i}" for i in range(8)])) for doc in range(40)]
    rows += [(100, "some line that stands alone here"), (101, "some line that stands alone here too")]
    seen = stored(monkeypatch)
    docs = written(spark, str(tmp_path / "d"), rows)
    assert [(r.doc_id, r.line_no) for r in lines.removals(docs).collect()] == [(101, 0)]
    assert seen["large"] == 0


def test_small_groups_of_frequent_words_are_put_together_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 2)
    base = [" ".join(f"{w}{i}" for w in "abcdefghk") for i in range(6)]
    rows = [(i, x) for i, x in enumerate(base)] + [(10 + i, f"{x} more") for i, x in enumerate(base)]
    seen = stored(monkeypatch)
    docs = written(spark, str(tmp_path / "d"), rows)
    assert sorted((r.doc_id, r.line_no) for r in lines.removals(docs).collect()) == [(10 + i, 0) for i in range(6)]
    assert seen["large"] == 0 and seen["again"] > 0
