"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

A chromosome says which bin each item of a block lies in; its genes are whole bins. Crossover takes
well-filled bins of one parent into the other, drops the other's bins that hold an item
twice, and puts the items so displaced back by best fit. Blocks of a bounded number of items
are dealt at random; each block has several islands, groups of a Spark shuffle, whose best
chromosome moves to the next island between epochs. Bins that stay slack are dissolved and their
items packed anew in a next round of blocks, until one block is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmark.llm.common import materialise
from gleanmark.llm.textvec import chunks
from gleanmark.llm.tokens import closed, encoder


class Packing:
    """Bins over items of given lengths; free space is indexed for best fit."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: dict[int, list[int]] = {}
        self.mask = 0

    def _offer(self, b: int) -> None:
        f = self.free[b]
        if f:
            self.by_free.setdefault(f, []).append(b)
            self.mask |= 1 << f

    def bin(self, items: list[int]) -> None:
        self.bins.append(items)
        self.free.append(self.capacity - sum(self.lengths[i] for i in items))
        self._offer(len(self.bins) - 1)

    def best_fit(self, items: list[int]) -> None:
        """Put each item into the fullest bin that has room for it; open one where none has."""
        for i in items:
            size = self.lengths[i]
            fits = self.mask >> size
            if not fits:
                self.bin([i])
                continue
            f = size + (fits & -fits).bit_length() - 1
            slot = self.by_free[f]
            b = slot.pop()
            if not slot:
                self.mask &= ~(1 << f)
            self.bins[b].append(i)
            self.free[b] = f - size
            self._offer(b)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then more uneven filling, which leaves room where it is of use."""
        return -len(self.bins), sum((1 - f / self.capacity) ** 2 for f in self.free)

    def genes(self) -> np.ndarray:
        out = np.zeros(len(self.lengths), np.int32)
        for b, items in enumerate(self.bins):
            out[items] = b
        return out

    @classmethod
    def of(cls, genes: np.ndarray, lengths: list[int], capacity: int) -> Packing:
        out = cls(lengths, capacity)
        order = np.argsort(genes, kind="stable")
        for items in np.split(order, np.flatnonzero(np.diff(genes[order])) + 1):
            if len(items):
                out.bin(items.tolist())
        return out


def crossover(mother: Packing, father: Packing, rng: np.random.Generator) -> Packing:
    """The father's well-filled bins go whole into the mother's packing."""
    order = sorted(range(len(father.bins)), key=father.free.__getitem__)
    good = order[: max(1, len(order) // 2)]
    chosen = [good[i] for i in rng.permutation(len(good))[: max(1, int(len(good) * rng.uniform(0.3, 1.0)))]]
    taken = {i for b in chosen for i in father.bins[b]}
    child = Packing(mother.lengths, mother.capacity)
    for b in chosen:
        child.bin(list(father.bins[b]))
    displaced: list[int] = []
    for items in mother.bins:
        rest = [i for i in items if i not in taken]
        if len(rest) == len(items):
            child.bin(list(items))
        else:
            displaced += rest
    displaced.sort(key=mother.lengths.__getitem__, reverse=True)
    child.best_fit(displaced)
    return child


def mutate(parent: Packing, rng: np.random.Generator) -> Packing:
    """Dissolve the slackest bins and a few others; best-fit their items in random order of size."""
    n = len(parent.bins)
    slack = set(sorted(range(n), key=parent.free.__getitem__)[-max(1, n // 50) :]) | set(rng.integers(0, n, max(1, n // 25)).tolist())
    child = Packing(parent.lengths, parent.capacity)
    loose: list[int] = []
    for b, items in enumerate(parent.bins):
        if b in slack:
            loose += items
        else:
            child.bin(list(items))
    noise = rng.uniform(0.7, 1.3, len(loose))
    child.best_fit([loose[k] for k in np.argsort([-parent.lengths[i] * x for i, x in zip(loose, noise, strict=True)])])
    return child


def evolve(lengths: list[int], capacity: int, seeds: list[np.ndarray], rng: np.random.Generator, size: int, generations: int) -> list[Packing]:
    """One island's epoch: its population, best first. It ends early at the lower bound of bins."""
    least = -(-sum(lengths) // capacity)
    people = [Packing.of(s, lengths, capacity) for s in seeds]
    while len(people) < size:
        noise = 1.0 if not people else rng.uniform(0.85, 1.15, len(lengths))
        new = Packing(lengths, capacity)
        new.best_fit(np.argsort(-np.array(lengths) * noise, kind="stable").tolist())
        people.append(new)
        if len(new.bins) <= least:
            return [new]
    people.sort(key=Packing.fitness, reverse=True)
    for _ in range(generations):
        if len(people[0].bins) <= least:
            break
        mother, father = (people[i] for i in rng.choice(len(people), 2, replace=False))
        for child in (crossover(mother, father, rng), mutate(people[0], rng)):
            people.append(child)
        people = sorted(people, key=Packing.fitness, reverse=True)[:size]
    return people


_STATE = "block long, island int, uids binary, lengths binary, genes binary, bins int, least int, fit double"


def _rows(block: int, island: int, uids: np.ndarray, lengths: np.ndarray, people: list[Packing], capacity: int) -> pd.DataFrame:
    least = -(-int(lengths.sum()) // capacity)
    return pd.DataFrame([{"block": block, "island": island, "uids": uids.astype("<i8").tobytes(), "lengths": lengths.astype("<i4").tobytes(), "genes": p.genes().astype("<i4").tobytes(), "bins": len(p.bins), "least": least, "fit": p.fitness()[1]} for p in people])


def islands(items: DataFrame, capacity: int, per_block: int = 4096, n_islands: int = 3, epochs: int = 2, population: int = 4, generations: int = 6, seed: int = 7) -> DataFrame:
    """Pack ``items`` (uid long, length int) block by block; one row a block with its best chromosome."""
    n = items.count()
    blocks = max(1, -(-n // per_block))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(blocks)))

    def found(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        lengths = pdf["length"].to_numpy()
        people = evolve(lengths.tolist(), capacity, [], np.random.default_rng([seed, int(key[0])]), 1, 0)
        return _rows(int(key[0]), 0, pdf["uid"].to_numpy(), lengths, people, capacity)

    state = materialise(dealt.groupBy("block").applyInPandas(found, _STATE), "founders")
    done = [state.where("bins <= least")]
    open_ = state.where("bins > least")

    def epoch(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bins", "fit"], ascending=[True, False])
        lengths = np.frombuffer(pdf["lengths"].iloc[0], "<i4")
        seeds = [np.frombuffer(g, "<i4") for g in pdf["genes"]][:population]
        rng = np.random.default_rng([seed, int(key[0]), int(key[1]), len(pdf)])
        people = evolve(lengths.tolist(), capacity, seeds, rng, population, generations)
        return _rows(int(key[0]), int(key[1]), np.frombuffer(pdf["uids"].iloc[0], "<i8"), lengths, people, capacity)

    for _ in range(epochs):
        if not open_.take(1):
            break
        if not _:
            settled = open_.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(n_islands - 1))))
        else:  # each island's elite also goes to its neighbour in the ring
            best = F.max_by(F.struct(*[c for c in open_.columns if c not in ("block", "island")]), F.struct(-F.col("bins"), "fit"))
            elite = open_.groupBy("block", "island").agg(best.alias("e")).select("block", ((F.col("island") + 1) % n_islands).cast("int").alias("island"), "e.*")
            settled = open_.unionByName(elite)
        state = materialise(settled.groupBy("block", "island").applyInPandas(epoch, _STATE), "epoch")
        solved = state.groupBy("block").agg(F.min("bins").alias("_b"), F.max("least").alias("_l")).where("_b <= _l").select("block")
        done.append(state.join(solved, "block", "left_semi"))
        open_ = state.join(solved, "block", "left_anti")
    done.append(open_)
    every = reduce(DataFrame.unionByName, done)
    columns = [c for c in every.columns if c != "block"]
    return every.groupBy("block").agg(F.max_by(F.struct(*columns), F.struct(-F.col("bins"), "fit", -F.col("island"))).alias("e")).select("block", "e.*")


def pack(items: DataFrame, capacity: int = 2048, per_block: int = 4096, slack: float = 0.02, most_rounds: int = 8, **island: int) -> DataFrame:
    """Pack ``items`` (uid long, distinct; length int, 0 to capacity) into bins.

    Returns uid, sequence_id (distinct over the whole result) and offset. Items of a full
    sequence take one each. Bins with more than ``slack`` of their room left are packed again with
    those of other blocks, round by round, until a round is one block. An empty table gives no rows.
    """
    full = items.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts, rest = [full], materialise(items.where(F.col("length") < capacity).select("uid", F.col("length").cast("int").alias("length")), "items")

    def places(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
                    genes = np.frombuffer(row["genes"], "<i4")
                    order = np.argsort(genes, kind="stable")
                    g, size = genes[order], lengths[order]
                    filled = np.bincount(genes, weights=lengths).astype(np.int64)
                    before = np.cumsum(size) - size
                    offset = before - np.repeat(before[np.append(True, np.diff(g) > 0)], np.bincount(g))
                    kept = np.ones(len(g), bool) if last else (filled >= capacity * (1 - slack))[g]
                    yield pa.record_batch([pa.array(np.frombuffer(row["uids"], "<i8")[order]), pa.array(size.astype(np.int32)), pa.array((np.int64(row["block"]) << 24) | g), pa.array(offset), pa.array(kept)], names=["uid", "length", "bin", "offset", "kept"])

        return run

    for number in range(most_rounds):
        n = rest.count()
        if not n:
            break
        last = n <= per_block or number == most_rounds - 1
        best = islands(rest, capacity, per_block, seed=7 + number, **island)
        placed = materialise(best.select("block", "uids", "lengths", "genes").mapInArrow(places(last), "uid long, length int, bin long, offset long, kept boolean"), "placed")
        parts.append(placed.where("kept").select("uid", (F.lit(number).cast("long") * (1 << 58) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        rest = placed.where("not kept").select("uid", "length")
    return reduce(DataFrame.unionByName, parts)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32.

    A document is its ids and then ``end_id``; a null or empty text is the end id alone. Only a
    document longer than ``capacity`` is cut; its first piece takes what is over whole sequences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        tool = encoder(tokenizer)
        for batch in (whole.slice(a, e - a) for whole in batches for a, e in chunks(whole["text"], 1 << 22)):
            ids, offsets = closed(*tool.encode(batch["text"]), end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            size = np.diff(offsets)
            n = np.maximum(-(-size // capacity), 1)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            over = np.where(size > capacity, size - (n - 1) * capacity, size)[doc]
            start = np.where(piece > 0, over + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, over)
            at = (offsets[:-1][doc] + start) * 4
            crc = [zlib.crc32(raw[a:e]) for a, e in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            yield pa.record_batch([batch["doc_id"].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, **options) -> DataFrame:
    """Cut, pack and place all documents: the columns of ``pieces`` with sequence_id and offset.

    Null ids and repeated rows are packed like others, each row for itself; an empty table gives no rows.
    """
    cut = materialise(pieces(docs, tokenizer, end_id, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = pack(cut.select("uid", "length"), capacity, **options)
    return cut.join(placed, "uid").drop("uid")
