"""Passages that repeat across documents.

Paragraphs come in two grains. Lines of more than 50 words, and wherever lines are shorter, overlapping
runs of successive lines of more than 50 words, are banded by MinHash: bands are tuned for a wanted recall at
the similarity limit, colliding paragraphs are verified by exact Jaccard similarity and clustered by
components. And as a repeat needn't begin or end with a line, every document is also cut
into overlapping paragraphs of 25 words that begin where the MinHash of 22 successive shingles of five
words lies: two documents that share more than 50 words in a row have one of these in common for
certain. All windows of 51 words whose paragraphs collide are then told the first and the last document
that has them; those of two documents are repeats, and successive ones are one run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanmark.llm.common import FILTER_BITS, bit_filter, discard, materialise, numbered, passes, salted_join
from gleanmark.llm.components import components
from gleanmark.llm.neardup import link
from gleanmark.llm.textvec import Words, chunks, mix, shingles, word_hashes, words

SPAN, REACH, SHINGLE = 25, 22, 5
#: Windows whose first paragraph stands in more places are salted.
HOT = 1000
#: Of the hash of several words, and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def bands_for(limit: float, rows: int = 3, recall: float = 0.9999) -> tuple[int, int]:
    """(bands, rows) such that a pair at the limit shares a band with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - limit**rows)), rows


def _least_of(values: np.ndarray, reach: int) -> np.ndarray:
    """For each run of ``reach`` values the place of the least, the last of equals. Runs are made of two shorter ones,
    which may overlap."""
    best, width = np.arange(len(values)), 1
    while width < reach:
        step = min(width, reach - width)
        one, other = best[:-step], best[step:]
        best = np.where(values[other] <= values[one], other, one)
        width += step
    return best


def _paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's words: their hashes, where each row's shingles begin, the place of the least shingle of each
    REACH successive ones, and row, place and key (hash of all 25 words) of the paragraphs. Places count
    shingles of the whole chunk."""
    hashes = word_hashes(w, folded=True)
    value, row = shingles(w, hashes, SHINGLE)
    counts = w.counts
    n = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(n)])
    least = _least_of(value, REACH) if len(value) >= REACH else np.zeros(0, np.int64)
    place = np.unique(least[np.flatnonzero(row[: len(least)] == row[REACH - 1 :][: len(least)])])
    owner = row[place]
    # Documents with fewer words than a span have no paragraph.
    fits = place - first[owner] + SPAN <= counts[owner]
    owner, place = owner[fits], place[fits]
    return hashes, first, least, owner, place, _hash_of(hashes, w.first[owner] + place - first[owner], SPAN)


def _hash_of(hashes: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each of ``word`` on, a polynomial in BASE. Sums over all words before, in
    which each counts by a power of the inverse, give that of any words by one subtraction, modulo 2 ** 64."""
    up, down = (np.cumprod(np.append(np.uint64(1), np.full(len(hashes), x, np.uint64))) for x in (BASE, INVERSE))
    total = np.append(np.uint64(0), np.cumsum(hashes * down[:-1], dtype=np.uint64))
    return mix((total[word + size] - total[word]) * up[word + size - 1])


def anchors(docs: DataFrame) -> DataFrame:
    """uid and key (hash of all 25 words) of the paragraphs of each row of ``docs`` (uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in chunks(batch["text"]):
                *_, owner, _, key = _paragraphs(words(batch["text"].slice(start, end - start)))
                yield pa.record_batch([batch["uid"].slice(start, end - start).take(pa.array(owner)), pa.array(key.view(np.int64))], names=["uid", "key"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, key long")


def windows(docs: DataFrame, least: int) -> DataFrame:
    """uid, at (first word) and window (hash of all words) of each ``least`` successive words that
    another document can have too: all paragraphs that lie in them stand in two documents. All
    windows of which that holds are there, and some others: a bit filter of fixed size tells. salt is -1,
    or from 0 to 63 where a window's first paragraph stands in more than HOT places."""
    spread = anchors(docs).groupBy("key").agg(F.min("uid").alias("low"), F.max("uid").alias("high"), F.count(F.lit(1)).alias("places")).where("low <> high")
    spread = materialise(spread.select("key", "places"), "paragraphs")
    packed = bit_filter(spread, "key", mixed=True)
    hot = bit_filter(spread.where(F.col("places") > HOT), "key", mixed=True)
    discard(spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in chunks(batch["text"]):
                w = words(batch["text"].slice(start, end - start))
                hashes, first, lowest, _, place, key = _paragraphs(w)
                # Reaches whose paragraph only one document has.
                alone, often = np.zeros((2, first[-1] + 1), bool)
                bit = (key & np.uint64(FILTER_BITS - 1)).view(np.int64)
                alone[place[~passes(packed.value, bit)]] = True
                often[place[passes(hot.value, bit)]] = True
                lone = alone[lowest]
                before = np.concatenate([[0], np.cumsum(lone)])
                n = np.maximum(w.counts - least + 1, 0)
                row = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                g = first[row] + at
                good = np.flatnonzero(~lone[g])
                row, at, g = row[good], at[good], g[good]
                # A window's own reaches, as far as their paragraphs lie in it; places never fall.
                last = np.minimum(np.searchsorted(lowest, g + least - SPAN, side="right"), g + least - SHINGLE - REACH + 2)
                good = np.flatnonzero(before[last] == before[g])
                row, at, g = row[good], at[good], g[good]
                window = _hash_of(hashes, w.first[row] + at, least)
                uid = batch["uid"].slice(start, end - start).take(pa.array(row))
                salt = np.where(often[lowest[g]], uid.to_numpy() & 63, -1)
                yield pa.record_batch([uid, pa.array(at.astype(np.int32)), pa.array(window.view(np.int64)), pa.array(salt.astype(np.int8))], names=["uid", "at", "window", "salt"])

    every = materialise(docs.select("uid", "text").mapInArrow(run, "uid long, at int, window long, salt byte"), "windows")
    packed.destroy()
    hot.destroy()
    return every


def _pieces(least: int):
    """From windows, sorted by row and place: the runs that successive ones make, in pieces whose first
    occurrences lie in one row one after the other, too."""

    def merged(t: pa.Table) -> pa.RecordBatch:
        uid, at, low, low_at = (t[c].to_numpy() for c in ("uid", "at", "low", "low_at"))
        removed = low < uid
        fresh = np.ones(len(uid), bool)
        fresh[1:] = (uid[1:] != uid[:-1]) | (at[1:] != at[:-1] + 1) | (removed[1:] != removed[:-1])
        begin = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        stop = at[np.append(begin[1:], len(uid)) - 1] + least
        part = fresh.copy()
        part[1:] |= (low[1:] != low[:-1]) | (low_at[1:] != low_at[:-1] + 1)
        k = np.flatnonzero(part)
        return pa.record_batch([pa.array(x) for x in (uid[k], at[begin][run[k]], stop[run[k]].astype(np.int32), removed[k], low[k], low_at[k])], names=["uid", "s", "e", "removed", "low", "low_at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            uid = batch["uid"].to_numpy()
            # The last row's windows wait for the next batch.
            cut = int(np.searchsorted(uid, uid[-1]))
            if cut or (held and held[-1]["uid"][0].as_py() != uid[0]):
                yield merged(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield merged(pa.Table.from_batches(held))

    return run


def exact(docs: DataFrame, least: int = 51) -> DataFrame:
    """Runs of at least ``least`` words of ``docs`` (uid, text) that another document has too: uid, s, e (words), mark (a
    number that the run's cluster shares) and removed (an earlier document has them).

    Every window of ``least`` words is held against its first and last document, so that no pairs are
    made and none is missed. Successive windows are one run, as long as they all go or all stay.
    """
    every = windows(docs, least)
    same = W.partitionBy("window")
    met = every.where("salt < 0").select("uid", "at", F.min("uid").over(same).alias("low"), F.max("uid").over(same).alias("high"), F.min_by("at", "uid").over(same).alias("low_at")).where("low <> high").drop("high")
    # Each (window, salt) of the hot ones is told its window's first place.
    hot = every.where("salt >= 0")
    part = hot.groupBy("window", "salt").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"), F.min_by("at", "uid").alias("lo_at"))
    whole = part.groupBy("window").agg(F.min("lo").alias("low"), F.max("hi").alias("high"), F.min_by("lo_at", "lo").alias("low_at")).where("low <> high")
    known = part.select("window", "salt").join(whole.drop("high"), "window").select("window", "salt", F.lit(None).cast("long").alias("uid"), F.lit(None).cast("int").alias("at"), "low", "low_at")
    members = hot.select("window", "salt", "uid", "at", F.lit(None).cast("long").alias("low"), F.lit(None).cast("int").alias("low_at"))
    salted = W.partitionBy("window", "salt")
    told = members.unionByName(known).select("uid", "at", F.max("low").over(salted).alias("low"), F.max("low_at").over(salted).alias("low_at"))
    met = met.unionByName(told.where("uid is not null and low is not null"))
    met = met.repartition("uid").sortWithinPartitions("uid", "at")
    piece = materialise(met.mapInArrow(_pieces(least), "uid long, s int, e int, removed boolean, low long, low_at int"), "pieces")
    discard(every)
    runs = piece.select("uid", "s", "e", "removed").distinct()
    # A first place lies in the last run before it that stays.
    place = piece.select(F.col("low").alias("uid"), F.col("low_at").alias("at"), F.lit(None).cast("int").alias("own")).distinct()
    begun = runs.where("not removed").select("uid", F.col("s").alias("at"), F.col("s").alias("own"))
    inside = F.last("own", True).over(W.partitionBy("uid").orderBy("at"))
    place = place.unionByName(begun).withColumn("low_s", inside).where("own is null").select(F.col("uid").alias("low"), F.col("at").alias("low_at"), "low_s")
    linked = salted_join(piece.select("uid", "s", "low", "low_at"), place, ["low", "low_at"], "uid")
    group = components(linked.select(F.xxhash64("uid", "s").alias("a"), F.xxhash64("low", "low_s").alias("b")))
    runs = runs.withColumn("id", F.xxhash64("uid", "s"))
    return runs.join(group, "id", "left").select("uid", "s", "e", F.coalesce("component", "id").alias("mark"), "removed")


def near(docs: DataFrame, limit: tuple[int, int] = (80, 100), least: int = 51) -> DataFrame:
    """Paragraphs of ``docs`` (uid, text) that resemble one of another document: uid, s, e, mark, removed."""
    stored = materialise(paragraphs(docs, least).withColumn("doc_id", F.monotonically_increasing_id()), "paragraphs", compression="zstd")
    linked = link(stored.select("doc_id", "text"), limit, SHINGLE, bands=bands_for(limit[0] / limit[1]), fine=64)
    groups = linked.groupBy("component_id").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    member = linked.join(groups, "component_id").select("doc_id", "component_id")
    member = member.join(stored.select("doc_id", "uid", "s", "n"), "doc_id")
    spread = member.groupBy("component_id").agg(F.min("uid").alias("low"), F.max("uid").alias("high")).where("low <> high")
    met = member.join(spread, "component_id")
    return met.select("uid", "s", (F.col("s") + F.col("n")).alias("e"), F.col("component_id").alias("mark"), (F.col("uid") != F.col("low")).alias("removed"))


def paragraphs(docs: DataFrame, least: int) -> DataFrame:
    """uid, s (words of the row before the paragraph), n (words) and text of the paragraphs of ``docs`` (uid, text).

    A line of at least ``least`` words is one. From each shorter line on, as many of the lines after it as
    make up ``least`` words are one too, unless a long line or one without words comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in chunks(batch["text"]):
                text = pc.fill_null(batch["text"].slice(start, end - start), "")
                lists = pc.split_pattern(text, "\n")
                line, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
                n = words(line).counts
                before = np.cumsum(n) - n
                s = before - before[np.searchsorted(owner, np.arange(end - start))][owner]
                # The last line of each paragraph is the first by which there are enough words.
                last = np.searchsorted(before + n, before + least)
                cut = (n == 0) | (n >= least) | np.append(owner[1:] != owner[:-1], True)
                stop = np.flatnonzero(cut)
                # A short line's run ends before the next long or empty line, or with its row's last line.
                limit = stop[np.searchsorted(stop, np.arange(len(n)))]
                limit = np.where((n[limit] == 0) | (n[limit] >= least), limit - 1, limit)
                first = np.flatnonzero((n >= least) | ((n > 0) & (last <= limit)))
                last = np.where(n[first] >= least, first, last[first])
                # Lines of a row lie one after the other, a line feed between them.
                size = pc.binary_length(line).to_numpy().astype(np.int64)
                stops = np.cumsum(size + 1) - 1
                data = "\n".join(line.to_pylist()).encode()
                parts = pa.array([data[a:b] for a, b in zip((stops - size)[first].tolist(), stops[last].tolist(), strict=True)], pa.binary()).cast(pa.string())
                many = (before + n)[last] - before[first]
                yield pa.record_batch([batch["uid"].slice(start, end - start).take(pa.array(owner[first])), pa.array(s[first].astype(np.int32)), pa.array(many.astype(np.int32)), parts], names=["uid", "s", "n", "text"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, s int, n int, text string")


def repeats(docs: DataFrame, limit: tuple[int, int] = (80, 100), least: int = 51) -> DataFrame:
    """One row for each passage of ``docs`` (doc_id, text) that repeats across documents.

    doc_id, start and stop (words, from 0, stop excluded), kind (run or line, a paragraph), cluster and removed: all but
    the passages of a cluster's first document go. Documents without such a passage have no row.
    Documents follow one another in the order of the stored table. Null or short texts, of fewer words
    than ``least``, have none; rows that repeat are documents of their own. A cluster's number means nothing else.
    """
    stored = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = exact(stored, least).withColumn("kind", F.lit("run")).unionByName(near(stored, limit, least).withColumn("kind", F.lit("line")))
    whole = found.groupBy("uid", "s", "e", "kind").agg(F.min("mark").alias("cluster"), F.max("removed").alias("removed"))
    return whole.join(stored.select("uid", "doc_id"), "uid").select("doc_id", F.col("s").cast("long").alias("start"), F.col("e").cast("long").alias("stop"), "kind", "cluster", "removed")
