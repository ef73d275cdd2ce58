"""Alignment of two tokenizers' ids over the same bytes.

The ends of both lists' tokens, counted in bytes, are the keys of two dictionaries from end to index. Their common keys,
sorted, slice both lists into groups, and each A-B pair of a group is a link. Both tokenizers cut a text before the white
space that follows a word, so that this is done once for each distinct piece that a worker meets; a document is its
pieces put together. A text for which that doesn't hold is aligned whole.

How often an id pair is linked is counted over documents: each document stores its distinct pairs, which are counted with partial sums.
The most frequent pairs, at most 2 ** 20 of them, are then broadcast; a document's other pairs fetch their counts by a join.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanmark.llm.common import materialise, numbered
from gleanmark.llm.textvec import chunks

#: Pieces, and characters of pieces, that a worker remembers before it starts anew; pairs that are broadcast at most.
KNOWN, KNOWN_CHARS, BROADCAST = 1 << 19, 1 << 24, 1 << 20
#: White space other than spaces and line feeds; pieces of a text without it, and the cuts of one with it.
_RARE, _PIECE, _CUT = re.compile(r"[^\S \n]"), re.compile(r"[ \n]*[^ \n]+|[ \n]+"), re.compile(r"(?<=\S)(?=[ \n])")
#: An A id and a B id in one number: A * PAIR + B.
PAIR = 1 << 32


def line_up(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """The ends of the groups, as indices into both lists, of two lists of cumulative token ends."""
    at_a = {end: i for i, end in enumerate(ends_a, 1)}
    at_b = {end: i for i, end in enumerate(ends_b, 1)}
    return [(at_a[end], at_b[end]) for end in sorted(at_a.keys() & at_b.keys())]


class Aligner:
    """Ids of both tokenizers for pieces of text, and their groups and links by piece."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # special tokens' strings in a text are plain text
        self.b = SentencePieceProcessor(model_file=path_b)
        # The byte-level alphabet: printable characters stand for themselves, other bytes for those from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in set(plain)]
        byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # B may be cut before a space or line feed if no piece of its vocabulary goes on over one.
        self.space = self.b.piece_to_id("▁")
        apart = not any(re.search("[^▁]▁|\n", p) for p in pieces) and self.b.encode("\n")[:1] == [self.space]
        rule = str(self.a.pre_tokenizer)
        whole = self.a.normalizer is not None or "ByteLevel" not in rule or "add_prefix_space=False" not in rule or "use_regex=True" not in rule
        self.safe = apart and not whole
        self.text = [str(i) for i in range(max(len(self.bytes_a), len(pieces)))]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars, self.uses = 0, np.zeros(1 << 12, np.int64)
        self.shown: list[str] = []
        self.sizes = np.zeros((1 << 12, 4), np.int64)  # A tokens, B tokens, groups, links of each piece
        self.start = np.zeros(1 << 12, np.int64)
        self.links, self.used = np.zeros(1 << 15, np.int64), 0

    def shrink(self) -> None:
        """Keep the half of the pieces that was met most often."""
        n, place, shown, sizes, start, links = len(self.shown), self.place, self.shown, self.sizes, self.start, self.links
        best = self.uses[:n] > np.median(self.uses[:n])
        self.forget()
        kept = [(p, i) for p, i in place.items() if best[i] and len(p) <= KNOWN_CHARS // KNOWN]
        at = np.array([i for _, i in kept], np.int64)
        self.place, self.chars = {p: i for i, (p, _) in enumerate(kept)}, sum(len(p) for p, _ in kept)
        n_links = sizes[at, 3]
        held = links[np.arange(n_links.sum()) + np.repeat(start[at] - (np.cumsum(n_links) - n_links), n_links)]
        self._add([shown[i] for i in at.tolist()], sizes[at], held)

    def ids_b(self, pieces: list[str]) -> list[list[int]]:
        """B's ids of pieces as they stand in a text; B puts a space before what it is given."""
        told = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        return [([self.space] if p == " " else ids if p[0] == " " else ids[1:]) for p, ids in zip(pieces, told, strict=True)]

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces with both tokenizers, and line each up. One that isn't given back byte by byte has no groups."""
        if not pieces:
            return
        of_a, of_b, text = self.bytes_a, self.bytes_b, self.text
        every_a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        shown, sizes, links = [], [], []
        for at, (piece, a, b) in enumerate(zip(pieces, every_a, self.ids_b(pieces), strict=True), len(self.shown)):
            self.place[piece] = at
            raw, told_a, told_b = piece.encode(), [of_a[i] for i in a], [of_b[i] for i in b]
            if b"".join(told_a) != raw or b"".join(told_b) != raw:
                shown.append("")
                sizes.append((0, 0, 0, 0))
                continue
            groups, before, i, j = [], len(links), 0, 0
            for to_a, to_b in line_up(list(accumulate(map(len, told_a))), list(accumulate(map(len, told_b)))):
                if to_a == i + 1 and to_b == j + 1:
                    x, y = a[i], b[j]
                    groups.append(f"{text[x]}|{text[y]}")
                    links.append(x * PAIR + y)
                else:
                    some_a, some_b = a[i:to_a], b[j:to_b]
                    groups.append(f"{','.join([text[x] for x in some_a])}|{','.join([text[y] for y in some_b])}")
                    links += [x * PAIR + y for x in some_a for y in some_b]
                i, j = to_a, to_b
            shown.append(";".join(groups))
            sizes.append((len(a), len(b), len(groups), len(links) - before))
        self.chars += sum(map(len, pieces))
        self._add(shown, np.array(sizes, np.int64), np.array(links, np.int64))

    def _add(self, shown: list[str], sizes: np.ndarray, links: np.ndarray) -> None:
        n = len(self.shown)
        while n + len(shown) > len(self.start):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.start, self.uses = np.append(self.start, np.zeros_like(self.start)), np.append(self.uses, np.zeros_like(self.uses))
        while self.used + len(links) > len(self.links):
            self.links = np.append(self.links, np.zeros_like(self.links))
        self.sizes[n : n + len(shown)] = sizes
        self.start[n : n + len(shown)] = self.used + np.cumsum(sizes[:, 3]) - sizes[:, 3]
        self.links[self.used : self.used + len(links)] = links
        self.used += len(links)
        self.shown += shown

    def pieces(self, text: str | None) -> list[str]:
        """A space and the text, cut before spaces and line feeds that follow a word."""
        if not text:
            return []
        if not self.safe:
            return [" " + text]
        return _PIECE.findall(" " + text) if not _RARE.search(text) else _CUT.split(" " + text)

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """Of each text: its four sizes, its groups as text, its distinct links and how often each occurs."""
        if len(self.shown) > KNOWN or self.chars > KNOWN_CHARS:
            self.shrink()
        split = [self.pieces(t) for t in texts]
        places = [list(map(self.place.get, own)) for own in split]
        unmet = {p: None for own, at in zip(split, places, strict=True) if None in at for p, i in zip(own, at, strict=True) if i is None}
        self.learn(list(unmet))
        sizes, groups, links, times = np.zeros((len(texts), 4), np.int64), [], [], []
        none = np.zeros(0, np.int64)
        for row, (own, at) in enumerate(zip(split, places, strict=True)):
            if None in at:
                at = list(map(self.place.__getitem__, own))
            where = np.array(at, np.int64)
            told = self.sizes[where]
            if len(own) > 1 and not told[:, 2].all():  # what a piece alone doesn't give back, the whole text may
                text = "".join(own)
                if text not in self.place:
                    self.learn([text])
                at = [self.place[text]]
                where = np.array(at, np.int64)
                told = self.sizes[where]
            if not at or not told[0, 2]:
                groups.append("")
                links.append(none)
                times.append(none)
                continue
            np.add.at(self.uses, where, 1)
            sizes[row] = told.sum(axis=0)
            n = told[:, 3]
            every = self.links[np.arange(n.sum()) + np.repeat(self.start[where] - (np.cumsum(n) - n), n)]
            pairs, often = np.unique(every, return_counts=True)
            groups.append(";".join(map(self.shown.__getitem__, at)))
            links.append(pairs)
            times.append(often)
        return sizes, groups, links, times


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]), kind))


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links (long), groups (``a1,a2|b1;a3|b2,b3`` in ids), links (distinct pairs as A * 2 ** 32 + B) and
    times (how often each is linked) of every row. Texts that are null, empty, or that either tokenizer doesn't give back
    byte by byte (A's text is a space and the text) have no tokens: zeros, an empty text and no links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _aligner(path_a, path_b)
        for batch in batches:
            for a, b in chunks(batch.column(1), 1 << 20):
                sizes, groups, links, times = tool.documents(batch.column(1).slice(a, b - a).to_pylist())
                columns = [pa.array(sizes[:, i]) for i in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns, pa.array(groups, pa.string()), _lists(links, pa.int64()), _lists(times, pa.int32())], names=["key", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "times"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    told = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links array<long>, times array<int>")
    return told.withColumnRenamed("key", key)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (how many rows of ``links`` hold it among their distinct links) and best (no pair of the same A id has more)."""
    counted = materialise(links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    # As many rows for one A id as B has ids at most.
    most = F.max("n").over(W.partitionBy(F.shiftright("pair", 32)))
    return materialise(counted.select("pair", "n", (F.col("n") == most).alias("best")), "counts")


def frequent(counts: DataFrame, most: int = BROADCAST) -> int:
    """The least n from which on there are ``most`` pairs at most; n is told by eighths of its powers of 2, some hundred rows."""
    step = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, None
    for row in counts.groupBy(step.alias("step")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("step")).collect():
        total += row["pairs"]
        if total > most:
            break
        least = row["least"]
    return least if least is not None else 2**62


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", shown: Callable[[Column], Column] = lambda groups: groups, most: int = BROADCAST) -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups of every row.

    A pair's count is the number of rows that hold it linked. n_best is how many of a row's links have the highest count of
    their A id, ties included; count_sum adds up the counts of all its links. ``shown`` is what to keep of ``groups``: a digest
    of them, where the text of all groups, three times the input, isn't wanted.

    For rows without tokens (see ``aligned``) all numbers are 0. Null and repeated keys are handed on, other columns aren't; each row is
    counted as a document of its own. A very long text passes whole. An empty table gives no rows.
    """
    told = aligned(docs, path_a, path_b, key, text).withColumn("groups", shown(F.col("groups"))).withColumnRenamed(key, "key")
    told = numbered(materialise(told, "aligned", compression="zstd"), "uid")
    counts = pair_counts(told)
    least = frequent(counts, most)
    top = counts.where(F.col("n") >= least).select("pair", "n", "best").toArrow()  # ``most`` rows at most
    order = np.argsort(top["pair"].to_numpy())
    known = told.sparkSession.sparkContext.broadcast([top[c].to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, often, best = known.value
        for batch in batches:
            uid, links, times = batch.columns
            codes, each = links.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(uid)), np.diff(links.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(pairs, codes), max(len(pairs) - 1, 0))
            met = pairs[at] == codes if len(pairs) else np.zeros(len(codes), bool)
            add = lambda values: pa.array(np.bincount(row[met], weights=values, minlength=len(uid)).astype(np.int64))  # noqa: E731, B023
            sums, bests = add(often[at[met]] * each[met]), add(np.where(best[at[met]], each[met], 0))
            left = [np.bincount(row[~met], minlength=len(uid))]
            ends = pa.array(np.append(0, np.cumsum(left[0])), pa.int32())
            yield pa.RecordBatch.from_arrays([uid, sums, bests, pa.ListArray.from_arrays(ends, pa.array(codes[~met])), pa.ListArray.from_arrays(ends, pa.array(each[~met].astype(np.int32)))], names=["uid", "count_sum", "n_best", "links", "times"])

    part = told.select("uid", "links", "times").mapInArrow(run, "uid long, count_sum long, n_best long, links array<long>, times array<int>")
    part = materialise(part, "sums", compression="zstd")
    rest = part.where(F.size("links") > 0).select("uid", F.inline(F.arrays_zip(F.col("links").alias("pair"), F.col("times").alias("times"))))
    rest = rest.join(counts.where(F.col("n") < least), "pair").select("uid", (F.col("n") * F.col("times")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("n_best"))
    sums = part.select("uid", "count_sum", "n_best").unionByName(rest).groupBy("uid").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    rows = told.select("uid", "key", "n_a", "n_b", "n_groups", "n_links", "groups").join(sums, "uid")
    return rows.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
