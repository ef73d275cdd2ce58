"""Exact top-k inner products over a bit-sliced index.

The index keeps, for blocks of rows, one bitmap for each bit of each quantised component. A query
adds the slices that its own bits call for with carry-save adders, all bitmap arithmetic, which
gives the slices of the scores; from the most significant slice downward it then keeps the rows that
lead, until k are sure. Rows that tie at the boundary are settled by their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanmark.llm.common import materialise, shuffle_width

#: Rows of a block and queries of a set; blocks and sets of a tile.
ROWS, QUERIES = 4096, 128
BLOCKS, SETS = 16, 32


def quantise(vector: Column, scale: int = 64) -> Column:
    """Components as floor(scale * x); null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def slices(values: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps of (values - low): an array of components, bits and words of 64 rows."""
    n, dims = values.shape
    width = -(-n // 64) * 64
    shifted = np.zeros((dims, width), np.uint64)
    shifted[:, :n] = (values - low).T.astype(np.uint64)
    out = np.zeros((dims, bits, width // 8), np.uint8)
    for j in range(bits):
        out[:, j] = np.packbits((shifted >> np.uint64(j) & np.uint64(1)).astype(bool), axis=1, bitorder="little")
    return out.view(np.uint64)


def add_up(index: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Slices, least significant first, of the sum over components of query times index.

    ``query`` (queries, components) isn't negative. Every set bit i of a weight sends the component's
    slices j to column i + j; a full adder takes three bitmaps of a column and leaves one there and
    one in the next column. All queries of the array go through each adder together.
    """
    dims, bits, words = index.shape
    q = len(query)
    columns: list[list[np.ndarray]] = [[] for _ in range(80)]

    def put(at: int, bitmap: np.ndarray) -> None:
        while True:
            column = columns[at]
            column.append(bitmap)
            if len(column) < 3:
                return
            a, b, c = column.pop(), column.pop(), column.pop()
            half = a ^ b
            column.append(half ^ c)
            a &= b
            half &= c
            a |= half
            at, bitmap = at + 1, a

    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for d in range(dims):
        weight = query[:, d]
        for i in range(int(weight.max()).bit_length() if q else 0):
            mask = np.where(weight >> i & 1, ones, np.uint64(0))[:, None]
            if mask.any():
                for j in range(bits):
                    put(i + j, mask & index[d, j][None, :])
    out, carry = [], None
    for column in columns:  # two bitmaps a column are left at most; add them with their carries
        parts = [*column, *([carry] if carry is not None else [])]
        carry = None
        if len(parts) == 3:
            half = parts[0] ^ parts[1]
            carry = (parts[0] & parts[1]) | (half & parts[2])
            out.append(half ^ parts[2])
        elif len(parts) == 2:
            carry = parts[0] & parts[1]
            out.append(parts[0] ^ parts[1])
        else:
            out.append(parts[0] if parts else np.zeros((q, words), np.uint64))
    while len(out) > 1 and not out[-1].any():
        out.pop()
    return out


def leaders(score: list[np.ndarray], live: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the rows sure to be among its k best and those that tie for what is left."""
    sure, tied = np.zeros_like(live), live.copy()
    for bitmap in reversed(score):
        high = tied & bitmap
        n = np.bitwise_count(sure | high).sum(axis=1, dtype=np.int64)[:, None]
        sure = np.where(n <= k, sure | high, sure)
        tied = np.where(n >= k, high, tied & ~bitmap)
        tied = np.where(n == k, np.uint64(0), tied)
    return sure, tied


def _rows(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bitmap.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def _scores(block: dict, q_ids: np.ndarray, values: np.ndarray, low: int, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of one block for each of some queries: place of the query, id and score."""
    raw = lambda c, kind: np.frombuffer(block[c].as_buffer(), kind)
    ids, bits = raw("ids", "<i8"), block["bits"].as_py()
    index = raw("index", "<u8").reshape(dims, bits, -1)
    # A negative weight w of x is |w| of (top - x), x's slices turned round, less a constant.
    top = (1 << bits) - 1
    wide = np.concatenate([index, ~index])
    score = add_up(wide, np.concatenate([np.maximum(values, 0), np.maximum(-values, 0)], axis=1))
    constant = values.sum(axis=1) * low - np.maximum(-values, 0).sum(axis=1) * top
    live = np.packbits(np.pad(ids[None, :] != q_ids[:, None], ((0, 0), (0, -len(ids) % 64))), axis=1, bitorder="little").view(np.uint64)
    sure, tied = leaders(score, live, k)
    sure, tied = _rows(sure, len(ids)), _rows(tied, len(ids))
    # ids ascend in a block: of those that tie the first ones fill up.
    tied &= np.cumsum(tied, axis=1) <= (k - sure.sum(axis=1))[:, None]
    q, at = np.nonzero(sure | tied)
    total = np.zeros(len(q), np.int64)
    for j, bitmap in enumerate(score):
        total += (bitmap[q, at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << j
    return q, ids[at], total + constant[q]


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each query by score, ties by id."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
    return q[keep], ids[keep], score[keep]


def _tile(low: int, k: int, dims: int):
    """For the query sets and the index blocks of one tile: the k best rows of all its blocks for each query."""

    def run(sets: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s in range(sets.num_rows):
            q_ids = np.frombuffer(sets["q_ids"][s].as_buffer(), "<i8")
            values = np.frombuffer(sets["q_values"][s].as_buffer(), "<i8").reshape(len(q_ids), dims)
            none = np.zeros(0, np.int64)
            held = none, none, none
            for b in range(blocks.num_rows):
                found = _scores({c: blocks[c][b] for c in ("ids", "index", "bits")}, q_ids, values, low, k, dims)
                held = _best(*(np.concatenate(x) for x in zip(held, found, strict=True)), k)
            out.append((q_ids[held[0]], held[1], held[2]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """The k rows of ``vectors`` (vec_id, embedding) with the highest integer inner products with
    each query, ties to smaller vec_id: query_id, rank, vec_id, score.

    ``queries`` says which rows are queries; a row isn't a candidate for a query of its own vec_id. Null
    ids, vectors that are null or have null or non-finite components, and vectors of another length
    than most take no part. Rows that repeat a vec_id are candidates each; queries that repeat one share
    its k ranks. Scores must fit 63 bits. Other columns aren't read.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantise(F.col("embedding"), scale).alias("v"), queries.alias("asks")).where("v is not null and vec_id is not null")
    kept = materialise(kept, "vectors")
    spread = F.struct(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"), F.count(F.lit(1)).alias("n"))
    sizes = kept.where(F.size("v") > 0).groupBy(F.size("v").alias("dims")).agg(spread.alias("s")).orderBy(F.desc("s.n"), "dims").first()
    out = "query_id long, rank int, vec_id long, score long"
    if sizes is None:
        return spark.createDataFrame([], out)
    dims, low, high, n = sizes["dims"], sizes["s"]["low"], sizes["s"]["high"], sizes["s"]["n"]
    kept = kept.where(F.size("v") == dims)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for batch in batches:
            values, ids = _matrix(batch["v"]), batch["vec_id"].to_numpy()
            for start in range(0, len(ids), ROWS):
                some, own = values[start : start + ROWS], ids[start : start + ROWS]
                bits = max(1, int(some.max() - low).bit_length())
                index = slices(some, np.int64(low), bits)
                yield pa.record_batch([pa.array([part << 32 | place], pa.int64()), pa.array([own.astype("<i8").tobytes()], pa.binary()), pa.array([index.tobytes()], pa.binary()), pa.array([bits], pa.int32())], names=["block", "ids", "index", "bits"])
                place += 1

    width = max(1, min(shuffle_width(spark), -(-n // ROWS)))
    index = materialise(kept.select("vec_id", "v").repartitionByRange(width, "vec_id").sortWithinPartitions("vec_id").mapInArrow(blocks, "block long, ids binary, index binary, bits int"), "index")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ids = _matrix(batch["v"]), batch["vec_id"].to_numpy()
            for start in range(0, len(ids), QUERIES):
                yield pa.record_batch([pa.array([ids[start : start + QUERIES].astype("<i8").tobytes()], pa.binary()), pa.array([values[start : start + QUERIES].astype("<i8").tobytes()], pa.binary())], names=["q_ids", "q_values"])

    sets = materialise(kept.where("asks").select("vec_id", "v").mapInArrow(asked, "q_ids binary, q_values binary"), "queries")
    # The query set is stated; its sets meet every block of the index in tiles of some sets and some blocks, so that
    # a task holds a few megabytes, and hands on k rows a query for all its blocks.
    columns = max(1, -(-n // (ROWS * BLOCKS)))
    asking = kept.where("asks").count()
    rows = max(1, min(-(-asking // QUERIES), max(-(-asking // (QUERIES * SETS)), -(-4 * shuffle_width(spark) // columns))))
    tall = sets.withColumn("i", F.pmod(F.xxhash64("q_ids"), F.lit(rows)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    wide = index.withColumn("j", F.pmod(F.xxhash64("block"), F.lit(columns)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    best = tall.groupBy("i", "j").cogroup(wide.groupBy("i", "j")).applyInArrow(_tile(low, k, dims), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
