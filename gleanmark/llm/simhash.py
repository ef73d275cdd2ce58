"""SimHash near-duplicates by BK-trees: fingerprints, shard trees, and links of few differing bits.

Documents with equal fingerprints become one point. A point goes to one shard for each block of its bits: two
points that differ in ``radius`` bits or fewer agree in at least one of ``radius + 1`` blocks, and so meet in the
shard that its leading bits name. A shard that gets too large is split by the whole block and then by
blocks of the other bits, which again loses no pair. A shard's tree is stored and sent to every slice of the shard's
points; a point follows only edges whose distance is within the radius of its own distance to the node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmark.llm.common import materialise, salted_join
from gleanmark.llm.components import components

#: Points of a shard's tree, on average and (twice as many) at most.
SHARD = 1 << 13
#: Points that search a tree at once, and shingles that are hashed at once.
TOGETHER, HASHED = 512, 1 << 16


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """The SimHash of a text as a signed 64-bit number: bit by bit, whether it is set in over half of the XXH64 values
    (seed 42) of all ``size``-word shingles, repeats included. A-Z count as a-z; words are joined by one space. A text of
    fewer words is one shingle; one without words, or null, has fingerprint 0."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # at space and 0x09 to 0x0D, as bytes are split
    if not words:
        return 0
    line = b" ".join(words)
    cuts = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    size = min(size, len(words))
    starts, ends = np.append(0, cuts + 1)[: len(words) - size + 1], np.append(cuts, len(line))[size - 1 :]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), HASHED):
        some = zip(starts[at : at + HASHED].tolist(), ends[at : at + HASHED].tolist(), strict=True)
        hashes = np.fromiter((xxh64_intdigest(line[s:e], 42) for s, e in some), "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``key`` and print (long) of every row, in one pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array((fingerprint(t.as_py(), size) for t in batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), marks], names=["key", "print"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    told = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"key {kind}, print long")
    return told.select(F.col("key").alias(key), "print")


class Tree:
    """A BK-tree over distinct 64-bit points: a child's key is its Hamming distance to its parent, so that all points
    below one child are equally far from the parent. Built level by level: of the points that share parent
    and distance, the first becomes the child and the others its descendants."""

    def __init__(self, points: np.ndarray, parent: np.ndarray, edge: np.ndarray) -> None:
        self.points = points
        keys = parent.astype(np.int64) * 65 + edge
        keys[parent < 0] = -1
        self.child = np.argsort(keys, kind="stable")
        self.keys = keys[self.child]

    @staticmethod
    def edges(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's parent (its place among the points, -1 for the root) and distance to it."""
        parent, edge = np.full(len(points), -1, np.int32), np.zeros(len(points), np.int32)
        left = np.arange(1, len(points))
        host = np.zeros(len(left), np.int64)
        while len(left):
            far = np.bitwise_count(points[left] ^ points[host]).astype(np.int64)
            _, first, same = np.unique(host * 65 + far, return_index=True, return_inverse=True)
            parent[left[first]], edge[left[first]] = host[first], far[first]
            host = left[first][same]
            rest = left != host
            left, host = left[rest], host[rest]
        return parent, edge

    def near(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in ``asked``, place of a point) within ``radius``: a step takes all open (query, node) pairs
        one edge further."""
        query, node = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            far = np.bitwise_count(asked[query] ^ self.points[node]).astype(np.int64)
            hit = far <= radius
            found.append((query[hit], node[hit]))
            low = np.searchsorted(self.keys, node * 65 + np.maximum(far - radius, 0))
            n = np.searchsorted(self.keys, node * 65 + np.minimum(far + radius, 64), side="right") - low
            query = np.repeat(query, n)
            node = self.child[np.arange(len(query)) + np.repeat(low - (np.cumsum(n) - n), n)]
        return np.concatenate([q for q, _ in found]), np.concatenate([p for _, p in found])


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of ``label`` (each member's least known member) along pairs (a, b)."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, low, high = a[open_], b[open_], np.minimum(x, y)[open_], np.maximum(x, y)[open_]
        np.minimum.at(label, high, low)
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def _blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """``n`` blocks of ``bits`` bits as (bits before it, width)."""
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _lead(value: Column, width: int) -> Column:
    """The first ``width`` of 64 bits; a shift by 64 would be none."""
    return F.shiftrightunsigned(value, 64 - width) if width else F.lit(0).cast("long")


def _shards(points: DataFrame, radius: int, shard: int) -> DataFrame:
    """(block, value, parts, print): the shards of each point. Such a row's shard has ``parts`` trees, of at most 2 * ``shard`` points or so each."""
    blocks = _blocks(64, radius + 1)
    # One number reaches the driver: how many leading bits make shards of the wished size.
    width = max(0, min(min(w for _, w in blocks), math.ceil(math.log2(max(1, points.count()) / shard))))
    turned = [F.struct(F.lit(k).alias("block"), F.shiftleft("print", at).bitwiseOR(F.shiftrightunsigned("print", 64 - at) if at else F.lit(0)).alias("turned")) for k, (at, _) in enumerate(blocks)]
    members = points.select("print", F.inline(F.array(*turned))).withColumn("value", _lead(F.col("turned"), width))

    def counted(df: DataFrame) -> DataFrame:
        sizes = df.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n"))
        return salted_join(df, sizes, ["block", "value"], "print")

    first = counted(members)
    some = first.where(F.col("n") <= 2 * shard).select("block", "value", F.lit(1).alias("parts"), "print")
    inner = []
    for k, (_, w) in enumerate(blocks):
        rest = F.shiftleft("turned", w)  # the bits of the other blocks, in front
        for j, (at, own) in enumerate(_blocks(64 - w, radius + 1)):
            value = F.shiftleft(_lead(F.col("turned"), w), own).bitwiseOR(_lead(F.shiftleft(rest, at), own))
            inner.append(F.when(F.col("block") == k, F.struct(F.lit((k + 1) * (radius + 1) + j).alias("block"), value.alias("value"))))
    deep = first.where(F.col("n") > 2 * shard).select("print", F.inline(F.array_compact(F.array(*inner))))
    parts = F.when(F.col("n") > 2 * shard, F.ceil(F.col("n") / shard)).otherwise(1).cast("int")
    return some.unionByName(counted(deep).select("block", "value", parts.alias("parts"), "print"))


KEYS = ["block", "value", "part"]


def near_links(points: DataFrame, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """Links (a, b: long) that join exactly the distinct points (print: long) of each class under "differ in at most ``radius``
    bits": of the links between points of a slice and a tree, those of a spanning forest, so that a family in
    which all resemble all doesn't give all pairs. Null points are left out."""
    shards = materialise(_shards(points.where("print is not null"), radius, shard), "shards")
    dealt = shards.withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        points = np.sort(table["print"].to_numpy().view(np.uint64))
        parent, edge = Tree.edges(points)
        held = [pa.array([k.as_py()] * len(points), kind) for k, kind in zip(key, (pa.int32(), pa.int64(), pa.int32()), strict=True)]
        parts = pa.array([table["parts"][0].as_py()] * len(points), pa.int32())
        return pa.table([*held, parts, pa.array(np.arange(len(points), dtype=np.int32)), pa.array(points.view(np.int64)), pa.array(parent), pa.array(edge)], names=[*KEYS, "parts", "node", "print", "parent", "edge"])

    trees = dealt.groupBy(*KEYS).applyInArrow(grow, "block int, value long, part int, parts int, node int, print long, parent int, edge int")
    trees = materialise(trees, "trees")
    # Slice s of a shard meets its trees 0 to s; the others meet it as trees.
    sent = trees.withColumn("slice", F.explode(F.sequence("part", F.col("parts") - 1)))
    asked = dealt.withColumnRenamed("part", "slice").withColumn("part", F.explode(F.sequence(F.lit(0), "slice")))

    def search(table: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not table.num_rows or not queries.num_rows:
            return none
        order = np.argsort(table["node"].to_numpy())
        points = table["print"].to_numpy()[order].view(np.uint64)
        tree = Tree(points, table["parent"].to_numpy()[order], table["edge"].to_numpy()[order])
        others = queries["print"].to_numpy().view(np.uint64)
        every = np.concatenate([points, others]).view(np.int64)
        label = np.arange(len(every))
        for at in range(0, len(others), TOGETHER):
            query, node = tree.near(others[at : at + TOGETHER], radius)
            unite(label, query + (at + len(points)), node)
        # A class becomes a tree of small degree, so that no point has many links.
        order = np.lexsort((every, label))
        start = np.searchsorted(label[order], label[order])
        within = np.arange(len(order)) - start
        up = order[start + np.maximum(within - 1, 0) // 8]
        linked = every[order] != every[up]
        return pa.table({"a": every[order][linked], "b": every[up][linked]})

    by = [*KEYS, "slice"]
    return sent.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, "a long, b long")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """``key``, fingerprint (16 lower-case hexadecimal digits) and component_id of every row: the smallest key that can be reached over
    fingerprints which differ in at most ``radius`` bits, itself included.

    A null, empty or blank text has fingerprint 0 and is linked like any other. Rows with equal texts or keys all stay; a null
    key stays null and is never the smallest, unless its component has no other. Other columns don't come through.
    The work follows the words of a text of whatever length; its hashes are taken in slices. An empty table gives no rows.
    """
    told = materialise(fingerprints(docs, key, text, size).select(F.col(key).alias("key"), "print"), "prints")
    points = told.groupBy("print").agg(F.min("key").alias("least"))
    links = near_links(points.select("print"), radius)
    groups = points.join(components(links).withColumnRenamed("id", "print"), "print", "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    named = salted_join(groups.select("print", "component"), groups.groupBy("component").agg(F.min("least").alias("component_id")), ["component"], "print")
    rows = salted_join(told, named.select("print", "component_id"), ["print"], "key")
    return rows.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
