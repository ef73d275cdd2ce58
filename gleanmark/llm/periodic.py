"""Periodic runs of words: where a text says the same few words over and over.

Suffix classes are united by decreasing length of common prefix (LCP). Each class keeps its positions in order; where a
union makes two positions neighbours whose distance is within the LCP, a run begins: the words from the first position
to the second one's end of the common part repeat with that distance as their smallest period. Each run is met
exactly once at its own first position, so that no candidate has to be tested again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmark.llm.textvec import chunks


def _suffixes(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes in order, and each suffix's rank by its first 1, 2, 4, ... words, by prefix doubling.

    Only suffixes that share their rank with another are sorted again. The last of ``words`` and one in every place
    where a comparison has to end must be unlike all others.
    """
    order = np.argsort(words, kind="stable")
    rank = np.empty(len(words), np.int64)
    head = np.flatnonzero(np.append(True, np.diff(words[order]) != 0))
    rank[order] = np.repeat(head, np.diff(np.append(head, len(words))))
    levels, width = [rank], 1
    sizes = np.bincount(rank, minlength=len(words))
    open_ = order[sizes[rank[order]] > 1]
    while len(open_):
        first, then = rank[open_], rank[open_ + width]
        by = np.lexsort((then, first))
        open_, first, then = open_[by], first[by], then[by]
        cut = np.append(True, (np.diff(first) != 0) | (np.diff(then) != 0))
        class_start = np.flatnonzero(np.append(True, np.diff(first) != 0))
        within = np.arange(len(open_)) - np.repeat(class_start, np.diff(np.append(class_start, len(open_))))
        head = np.flatnonzero(cut)
        sizes = np.diff(np.append(head, len(open_)))
        rank = rank.copy()
        rank[open_] = first + np.repeat(within[head], sizes)
        levels.append(rank)
        open_ = open_[np.repeat(sizes, sizes) > 1]
        width *= 2
    suffixes = np.empty(len(words), np.int64)
    suffixes[rank] = np.arange(len(words))
    return suffixes, levels


def _common(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The length of the common prefix of each two suffixes."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length += (levels[k][a + length] == levels[k][b + length]).astype(np.int64) << k
    return length


def seeds(words: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """All (start, length, period) of maximal runs with length >= max(least, times * period), in order, of a sequence as
    ``_suffixes`` wants it. ``times`` is 2 or more."""
    suffixes, levels = _suffixes(words)
    # No run has two neighbours with a shorter common part, whatever its period.
    floor = min(max((times - 1) * d, least - d, 1) for d in range(1, max(least, 2)))
    level = levels[min(floor.bit_length() - 1, len(levels) - 1)]
    alike = np.flatnonzero(level[suffixes[:-1]] == level[suffixes[1:]]) if floor < 2 ** len(levels) else np.zeros(0, np.int64)
    a, b = suffixes[alike], suffixes[alike + 1]
    shared = _common(a, b, levels)
    by = np.argsort(-shared, kind="stable")
    by = by[shared[by] >= floor]
    home: dict[int, list[int]] = {}
    found = []
    for x, y, lcp in zip(a[by].tolist(), b[by].tolist(), shared[by].tolist(), strict=True):
        large, small = home.get(x) or [x], home.get(y) or [y]
        if len(large) < len(small):
            large, small = small, large
        if len(large) == 1:
            home[large[0]] = large
        for p in small:
            large.insert(bisect_left(large, p), p)
            home[p] = large
        # Neighbours count once all are in: one that only waits for a nearer one has no smallest period. Two that come from
        # the same class are no new neighbours.
        moved = set(small)
        for p in small:
            at = bisect_left(large, p)
            for q in large[max(at - 1, 0) : at + 2]:
                d = abs(q - p)
                if q not in moved and (times - 1) * d <= lcp and d + lcp >= least:
                    first = min(p, q)
                    if first == 0 or words[first - 1] != words[first + d - 1]:
                        found.append((first, lcp + d, d))
    return sorted(found)


def _runs(texts: list[bytes | None], least: int, times: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Runs and collapsed text of each text; word numbers and periods of several texts are found together."""
    split = [(t or b"").split() for t in texts]  # at space and 0x09 to 0x0D, as bytes are split
    parts, base, begin = [], 0, [0]
    for words in split:
        # Words of different texts get different numbers, and each text an end of its own.
        own = {w: i for i, w in enumerate(dict.fromkeys(words), base)}
        base += len(own) + 1
        parts.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([base - 1]))
        begin.append(begin[-1] + len(words) + 1)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
    if split:
        found = seeds(np.concatenate(parts), least, times)
        rows = np.searchsorted(begin, [start for start, _, _ in found], side="right") - 1
        for row, (start, length, period) in zip(rows.tolist(), found, strict=True):
            runs[row].append((start - begin[row], length, period))
    collapsed = []
    for words, own in zip(split, runs, strict=True):
        if own:
            keep = np.ones(len(words), bool)
            for start, length, period in own:
                keep[start + period : start + length] = False
            words = [words[i] for i in np.flatnonzero(keep)]
        collapsed.append(b" ".join(words))
    return runs, collapsed


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """``key``, runs (array of start, length and period, in words, by start and period) and collapsed (string) of every row.

    A run is a stretch of consecutive words with smallest period q, of max(least, times * q) words or more, that no neighbouring word
    extends; a word is dropped from the collapsed text if any run contains it after that run's first q words. Words are compared
    as they stand. A null, empty or blank text has no runs and an empty collapsed text; null and repeated keys are
    handed on, other columns aren't, and an empty table gives no rows. Rows are worked on one by one where
    they lie, nothing is shuffled; texts share a pass up to a megabyte, and a longer one, with some 200 bytes for each
    word (and 8 more for each doubling of its longest repeat), has its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for a, b in chunks(batch.column(1), 1 << 20):
                runs, collapsed = _runs(batch.column(1).slice(a, b - a).to_pylist(), least, times)
                flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
                ends = np.cumsum([0, *map(len, runs)])
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(place)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), held, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["key", "runs", "collapsed"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    told = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"key {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return told.withColumnRenamed("key", key)
