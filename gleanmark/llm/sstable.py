"""Token ids in sorted-string-table shards.

A shard is one file. Documents stand in ascending key order in data blocks; in a block a key
keeps only the bytes that differ from the key before. After the blocks come a sparse index (the
first key, place, length and CRC-32 of every block), a Bloom filter over all keys, and a footer
of fixed size, so that a reader finds a document with the footer, the filter, a binary search of
the index and one block.

Key: one byte 0 for a null id or 1, then the id as a big-endian integer with its sign bit turned, so
that bytes sort as integers do. Value: the ids as little-endian uint16 or uint32 (the footer says which).
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark.llm.common import materialise, shared_dir
from gleanmark.llm.textvec import chunks
from gleanmark.llm.tokens import closed, encoder

MAGIC = b"GLMSST01"
_FOOTER = struct.Struct("<QQQQQQB3x4s8s")  # index at, length; bloom at, length; documents, tokens; id width; -; magic
_ENTRY = struct.Struct("<HHI")  # shared key bytes, own key bytes, value bytes
_BITS, _HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _bloom_bits(key: bytes, size: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5A5A5A5A) | 1
    return [(a + i * b) % size for i in range(_HASHES)]


class ShardWriter:
    """Collects one shard's entries in key order; ``finish`` gives the whole file's bytes."""

    def __init__(self, width: int, block_bytes: int) -> None:
        self.width, self.block_bytes = width, block_bytes
        self.out, self.index, self.keys = bytearray(), [], []
        self.block, self.first, self.last = bytearray(), b"", b""
        self.tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.tokens += len(value) // self.width
        if len(self.block) >= self.block_bytes:
            self._close()

    def _close(self) -> None:
        if self.block:
            self.index.append((self.first, len(self.out), len(self.block), zlib.crc32(self.block)))
            self.out += self.block
            self.block = bytearray()

    @property
    def size(self) -> int:
        return len(self.out) + len(self.block)

    def finish(self) -> bytes:
        self._close()
        index_at = len(self.out)
        for key, at, length, crc in self.index:
            self.out += struct.pack("<HQII", len(key), at, length, crc) + key
        bloom_at = len(self.out)
        bits = np.zeros(max(64, _BITS * len(self.keys)), dtype=bool)
        for key in self.keys:
            bits[_bloom_bits(key, len(bits))] = True
        self.out += struct.pack("<Q", len(bits)) + np.packbits(bits).tobytes()
        return bytes(self.out) + _FOOTER.pack(index_at, bloom_at - index_at, bloom_at, len(self.out) - bloom_at, len(self.keys), self.tokens, self.width, b"\0" * 4, MAGIC)


class Shard:
    """A reader over ``read(start, length)`` of a file of ``size`` bytes."""

    def __init__(self, read, size: int) -> None:
        self.read = read
        self.index_at, self.index_len, self.bloom_at, self.bloom_len, self.documents, self.tokens, self.width, _, magic = _FOOTER.unpack(read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        raw, self.index, at = read(self.index_at, self.index_len), [], 0
        while at < len(raw):
            n, place, length, crc = struct.unpack_from("<HQII", raw, at)
            at += 18
            self.index.append((raw[at : at + n], place, length, crc))
            at += n

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, length, crc = self.index[i]
        raw, at, key = self.read(place, length), 0, b""
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {i} is damaged")
        while at < len(raw):
            shared, own, n = _ENTRY.unpack_from(raw, at)
            at += _ENTRY.size
            key = key[:shared] + bytes(raw[at : at + own])
            at += own
            yield key, raw[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        raw = self.read(self.bloom_at, self.bloom_len)
        (size,) = struct.unpack_from("<Q", raw)
        return all(raw[8 + (b >> 3)] >> (7 - (b & 7)) & 1 for b in _bloom_bits(key, size))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        key, out = key_of(doc_id), []
        if not self.may_hold(key):
            return out
        i = max(0, bisect.bisect_left([x[0] for x in self.index], key) - 1)
        while i < len(self.index) and self.index[i][0] <= key:
            out += [np.frombuffer(v, dtype=f"<u{self.width}") for k, v in self.block(i) if k == key]
            i += 1
        return out


def open_shard(path: str) -> Shard:
    """A shard on any store that pyarrow's file systems reach; only the parts asked for are read."""
    store, inner = _store(path)
    f = store.open_input_file(inner)
    return Shard(lambda start, length: f.read_at(length, start), f.size())


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def write(docs: DataFrame, tokenizer: str, end_id: int, rows_per_range: int = 4096, most_ranges: int = 4096, shard_bytes: int = 16 << 20, block_bytes: int = 64 << 10) -> tuple[str, DataFrame]:
    """Encode every text of ``docs`` (doc_id, text) and write shards in ascending doc_id order.

    Returns the folder and the manifest: one row per shard with its file, range, place in the
    range, documents, tokens, first and last id. The documents are dealt into ranges at quantiles of
    doc_id, so one task holds one open shard at a time and never a whole range. A null text is
    empty and holds the end id alone; null ids stand first; documents of one id keep separate
    entries, ordered by their ids' bytes. A task that runs twice writes other file names, and only
    files of the manifest count.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/shards"
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows, nulls = ids.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    ranges = max(1, min(most_ranges, -(-rows // rows_per_range)))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 and rows > nulls else []
    cuts = sorted(set(cuts or []))
    width = 2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        bounds = np.array(cuts, dtype=np.int64)
        for batch in (whole.slice(a, e - a) for whole in batches for a, e in chunks(whole["text"], 1 << 22)):
            out, offsets = closed(*tool.encode(batch["text"]), end_id)
            raw = pa.py_buffer(out.astype(f"<u{width}").tobytes())
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer((offsets * width).astype(np.int64).tobytes()), raw])
            doc = batch["doc_id"]
            part = np.where(doc.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(bounds, doc.fill_null(0).to_numpy(zero_copy_only=False), side="left"))
            yield pa.record_batch([pa.array(part, pa.int32()), doc, values.cast(pa.binary())], names=["part", "doc_id", "ids"])

    encoded = ids.mapInArrow(encode, "part int, doc_id long, ids binary")
    dealt = encoded.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part, place, ends = None, 0, 0, [None, None]

        def close() -> pa.RecordBatch:
            path = f"{folder}/shard-{part:05d}-{place:05d}-{uuid.uuid4().hex}.sst"
            store, inner = _store(path)
            store.create_dir(inner.rpartition("/")[0], recursive=True)
            with store.open_output_stream(inner) as f:
                f.write(writer.finish())
            return pa.RecordBatch.from_pylist([{"file": path.rpartition("/")[2], "part": part, "place": place, "documents": len(writer.keys), "tokens": writer.tokens, "first_id": ends[0], "last_id": ends[1]}], schema=_MANIFEST)

        for batch in batches:
            for p, doc, value in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                if writer and (p != part or writer.size >= shard_bytes):
                    yield close()
                    place, writer = (place + 1 if p == part else 0), None
                if writer is None:
                    writer, part, ends = ShardWriter(width, block_bytes), p, [doc, doc]
                writer.add(key_of(doc), value.as_buffer().to_pybytes())
                ends[1] = doc
        if writer:
            yield close()

    manifest = dealt.mapInArrow(shards, "file string, part int, place int, documents long, tokens long, first_id long, last_id long")
    return folder, materialise(manifest, "manifest")


_MANIFEST = pa.schema([("file", pa.string()), ("part", pa.int32()), ("place", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def read(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every document of the shards: doc_id, n_tokens, ids_crc32, start, the number of ids of all
    documents before it, and, unless ``with_ids`` is off, the ids. The shards' starts are summed in two steps, ranges and then shards of a range."""
    from pyspark.sql import Window as W

    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("_t"))
    parts = parts.select("part", (F.sum("_t").over(W.orderBy("part")) - F.col("_t")).alias("_before"))
    inside = W.partitionBy("part").orderBy("place")
    starts = manifest.join(parts, "part").select("file", (F.col("_before") + F.sum("tokens").over(inside) - F.col("tokens")).alias("base"))
    schema = "doc_id long, n_tokens long, ids_crc32 long, start long" + ", ids array<long>" * with_ids
    if not manifest.take(1):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch["base"].to_pylist(), batch["content"], strict=True):
                view = memoryview(content.as_buffer())
                shard = Shard(lambda a, n, view=view: bytes(view[a : a + n]), len(view))
                for i in range(len(shard.index)):
                    doc, values = [], []
                    for key, value in shard.block(i):
                        doc.append(id_of(key))
                        values.append(np.frombuffer(value, dtype=f"<u{shard.width}").astype("<u4"))
                    n = np.array([len(v) for v in values], dtype=np.int64)
                    crc = [zlib.crc32(v) for v in values]
                    columns = [pa.array(doc, pa.int64()), pa.array(n), pa.array(crc, pa.int64()), pa.array(base + np.cumsum(n) - n)]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(values).astype(np.int64))))
                    yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_crc32", "start", "ids"][: len(columns)])
                    base += int(n.sum())

    return files.join(starts, "file").select("base", "content").mapInArrow(parse, schema)


def lookup(spark: SparkSession, folder: str, manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids of the documents named in ``wanted`` (doc_id), by binary search in the shards that may hold them."""
    asked = wanted.select("doc_id").distinct()
    pairs = asked.join(manifest.select("file", "first_id", "last_id"), F.col("doc_id").between(F.coalesce("first_id", "doc_id"), F.coalesce("last_id", "doc_id")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for name in sorted({r["file"] for r in rows}):
                shard = open_shard(f"{folder}/{name}")
                found = [(r["doc_id"], v.astype(np.int64)) for r in rows if r["file"] == name for v in shard.get(r["doc_id"])]
                yield pa.record_batch([pa.array([d for d, _ in found], pa.int64()), pa.array([v for _, v in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return pairs.repartition("file").select("doc_id", "file").mapInArrow(find, "doc_id long, ids array<long>")
