"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once.

Both public vocabularies split a text at white space before they merge bytes, so the ids of a
text are those of its pieces put together. A piece is a word with the one space before it, or
the rest of a run of white space. The pieces of a whole Arrow batch are hashed at once; only
pieces that this Python worker hasn't met are handed to the library, many in one call.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleanmark.llm.textvec import SPACE, chunks, mix, word_hashes, words

#: White space beyond ASCII: texts with it are encoded whole where white space has ids of its own.
_OTHER_SPACE = "[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]"
_MARK = "\x01"


class _Seen:
    """An open-addressing table from hashes to the ids of pieces, looked up for many at once."""

    def __init__(self) -> None:
        self.size = 1 << 16
        self.keys, self.place = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int64)
        self.n, self.used = 0, 0
        self.start, self.length = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.ids = np.zeros(1 << 17, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), -1, np.int64)
        mask = np.uint64(self.size - 1)
        left, slot = np.arange(len(hashes)), hashes & mask
        while len(left):
            keys = self.keys[slot]
            hit = keys == hashes[left]
            found[left[hit]] = self.place[slot[hit]]
            on = ~hit & (keys != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & mask
        return found

    def _put(self, hashes: np.ndarray, place: np.ndarray) -> None:
        mask = np.uint64(self.size - 1)
        slot = hashes & mask
        while len(hashes):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[slot[take]], self.place[slot[take]] = hashes[take], place[take]
            rest = np.ones(len(hashes), bool)
            rest[take] = False
            hashes, place, slot = hashes[rest], place[rest], (slot[rest] + np.uint64(1)) & mask

    def add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        m = len(hashes)
        while self.n + m > len(self.start):
            self.start, self.length = np.append(self.start, np.zeros_like(self.start)), np.append(self.length, np.zeros_like(self.length))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.start[self.n : self.n + m] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + m] = lengths
        self.ids[self.used : self.used + len(ids)] = ids
        if (self.n + m) * 2 > self.size:
            live = self.keys != 0
            keys, place = self.keys[live], self.place[live]
            while (self.n + m) * 2 > self.size:
                self.size *= 2
            self.keys, self.place = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int64)
            self._put(keys, place)
        self._put(hashes, np.arange(self.n, self.n + m))
        self.n, self.used = self.n + m, self.used + len(ids)


class TextEncoder:
    """``encode(column)`` gives the ids of every text of a column and the count of each text.

    ``most`` bounds the pieces kept in memory; the table starts anew beyond it. A vocabulary whose
    splitting rule isn't one of the two known kinds has every text encoded whole.
    """

    def __init__(self, path: str, most: int = 1 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.seen = most, _Seen()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        # A text that holds an added token, whatever its case, is encoded whole.
        added = [re.escape(t["content"]) for t in told.get("added_tokens") or []]
        self.odd = "|".join([f"(?i:{'|'.join(added)})"] * bool(added))
        split, normal = told.get("pre_tokenizer") or {}, told.get("normalizer")
        if split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and normal is None:
            self.kind, self.between = "kept", "\n"
        elif split.get("type") == "Sequence" and split["pretokenizers"][0].get("behavior") == "Removed" and "\\s" not in split["pretokenizers"][0]["pattern"]["Regex"].split("|")[-2]:
            self.kind, self.between = "dropped", f" {_MARK} "
        else:
            self.kind, self.between = "whole", ""
        if self.kind == "kept":
            self.odd = "|".join(filter(None, (self.odd, _OTHER_SPACE)))
        mark = self._whole(self.between)
        self.mark = mark[0] if len(mark) == 1 else None

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of unmet pieces: one call of the library for all plain words."""
        if self.mark is not None and len(pieces) > 1:
            between = self.between.encode()
            ids = np.array(self._whole(between.join(pieces).decode()), dtype=np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(pieces) - 1:
                lengths = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
                return np.delete(ids, cuts), lengths
        each = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        return np.array([i for e in each for i in e], dtype=np.uint32), np.array([len(e) for e in each], dtype=np.int64)

    def _learn(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> None:
        fresh, first = np.unique(hashes, return_index=True)
        raw = data.tobytes()
        pieces = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        alone = np.array([SPACE[p[-1]] or _MARK.encode() in p for p in pieces], dtype=bool)
        for chosen, single in ((~alone, False), (alone, True)):
            if chosen.any():
                part = [p for p, c in zip(pieces, chosen, strict=True) if c]
                if single:
                    each = [self._whole(p.decode()) for p in part]
                    ids, lengths = np.array([i for e in each for i in e], dtype=np.uint32), np.array([len(e) for e in each], dtype=np.int64)
                else:
                    ids, lengths = self._pieces(part)
                self.seen.add(fresh[chosen], lengths, ids)

    def _chunk(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(column)
        if self.kind == "whole":
            each = [e.ids for e in self.tokenizer.encode_batch_fast(column.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.array([i for e in each for i in e], dtype=np.uint32), np.array([len(e) for e in each], dtype=np.int64)
        w = words(column)
        starts, ends, rows, hashes = w.starts, w.ends, w.row, word_hashes(w)
        if self.kind == "kept":
            own = np.zeros(len(starts), bool)
            inside = starts > w.offsets[rows] if len(starts) else own
            own[inside] = w.data[starts[inside] - 1] == 32
            starts = starts - own
            hashes = mix(hashes + own.astype(np.uint64))
            # What no word takes is white space; the last of a run before a word stands alone.
            free = SPACE[w.data]
            free[starts[own]] = False
            if free.any():
                at = np.flatnonzero(free)
                row = np.searchsorted(w.offsets, at, side="right") - 1
                last = np.append((np.diff(at) > 1) | (np.diff(row) > 0), True)
                ends_here = at[last] + 1
                begins = at[np.append(True, last[:-1])]
                row = row[last]
                followed = (ends_here < w.offsets[row + 1]) & ~np.append(SPACE[w.data], True)[ends_here]
                split = followed & (ends_here - begins > 1)
                more_s = np.concatenate([begins, ends_here[split] - 1])
                more_e = np.concatenate([np.where(split, ends_here - 1, ends_here), ends_here[split]])
                more_r = np.concatenate([row, row[split]])
                raw = w.data.tobytes()
                names: dict[bytes, int] = {}
                more_h = np.array([names.setdefault(p := raw[s:e], (hash_bytes(p))) for s, e in zip(more_s.tolist(), more_e.tolist(), strict=True)], dtype=np.uint64)
                starts, ends, rows, hashes = (np.concatenate(x) for x in ((starts, more_s), (ends, more_e), (rows, more_r), (hashes, more_h)))
                order = np.argsort(starts, kind="stable")
                starts, ends, rows, hashes = starts[order], ends[order], rows[order], hashes[order]
        hashes = np.maximum(hashes, np.uint64(1))
        if self.seen.n > self.most:
            self.seen = _Seen()
        found = self.seen.find(hashes)
        unmet = found < 0
        if unmet.any():
            self._learn(hashes[unmet], starts[unmet], ends[unmet], w.data)
            found[unmet] = self.seen.find(hashes[unmet])
        lengths, begin = self.seen.length[found], self.seen.start[found]
        total = int(lengths.sum())
        ids = self.seen.ids[np.arange(total) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)]
        return ids, np.bincount(rows, weights=lengths, minlength=n).astype(np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        odd = np.zeros(len(column), bool)
        if self.kind != "whole" and self.odd:
            odd = pc.fill_null(pc.match_substring_regex(column, self.odd), False).to_numpy(zero_copy_only=False)
        ids, counts = [], []
        plain = pc.if_else(pa.array(odd), pa.scalar("", column.type), column) if odd.any() else column
        for a, b in chunks(plain, 1 << 20):
            some, each = self._chunk(plain.slice(a, b - a))
            if odd[a:b].any():
                parts = np.split(some, np.cumsum(each)[:-1])
                for r in np.flatnonzero(odd[a:b]):
                    parts[r] = np.array(self._whole(column[a + int(r)].as_py()), dtype=np.uint32)
                some, each = np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
            ids.append(some)
            counts.append(each)
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))


def hash_bytes(piece: bytes) -> int:
    """For runs of white space, which the word hash counts as nothing."""
    return (zlib.crc32(piece) << 32 | zlib.adler32(piece)) ^ 0x5BD1E9955BD1E995


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for a vocabulary in each Python worker."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def closed(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the end id after each text's ids; the ids and the n + 1 offsets of the texts."""
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(offsets[-1], end, dtype=np.uint32)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - 1] = False
    out[keep] = ids
    return out, offsets
