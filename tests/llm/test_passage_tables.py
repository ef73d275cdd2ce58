"""What finding repeated passages leaves behind, and the hashes of words in a row."""

from pathlib import Path

import numpy as np

from gleanmark.llm import passages
from gleanmark.llm.textvec import mix


def test_tables_of_windows_go(spark, tmp_path):
    run = " ".join(f"w{i}" for i in range(70))
    rows = [(1, f"a b {run} c"), (2, f"d {run} e f"), (3, "g h")]
    spark.createDataFrame(rows, "uid long, text string").write.parquet(str(tmp_path / "d"))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.glob("*"))
    found = passages.exact(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert {(r.uid, r.s, r.e, r.removed) for r in found} == {(1, 2, 72, False), (2, 1, 71, True)}
    left = {x.name for folder in set(shared.glob("*")) - before for x in folder.iterdir()}
    assert "pieces" in left and not left & {"windows", "paragraphs"}


def test_hashes_and_least_values_of_runs():
    rng = np.random.default_rng(3)
    hashes, word = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 350, 90)
    for size in (1, 25, 50):
        key = np.zeros(len(word), np.uint64)
        for j in range(size):
            key = key * np.uint64(passages.BASE) + hashes[word + j]
        assert (passages._hash_of(hashes, word, size) == mix(key)).all()
    for values in (hashes, hashes % np.uint64(3), hashes[:22]):
        want = [max(range(i, i + 22), key=lambda k: (-int(values[k]), k)) for i in range(len(values) - 21)]
        assert passages._least_of(values, 22).tolist() == want
