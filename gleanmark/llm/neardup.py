"""Near-duplicate documents: b-bit MinHash signatures under a multi-index Hamming join.

Documents with equal shingle sets are one class. A class has a signature of ``places`` MinHash
values of 16 bits. Two signatures that differ in at most ``distance`` places have, when split into
more than distance / 2 chunks, a chunk with at most one difference (pigeonhole); each chunk's
values with any one place left out are keys, so such a pair shares a key for certain. Pairs that
share keys are weighed by a finer signature of 512 values of 8 bits and confirmed on full shingle sets.

A key's members aren't paired with each other at first: all are compared with the key's most
connected member, and only pairs that lie in different components after that are compared too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmark.llm.common import bit_filter, filter_bit, fresh, materialise, numbered, passes, salted_lookup
from gleanmark.llm.components import components
from gleanmark.llm.textvec import chunks, mix, sets, shingles, word_hashes, words

#: MinHash values of 16 bits that make the keys, and of 8 bits, more of them, that weigh candidates.
PLACES, FINE = 64, 512
_rng = np.random.default_rng(7)
_TIMES = _rng.integers(0, 2**31, PLACES * 8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 2**32, PLACES * 8, dtype=np.uint32)
_KEY = _rng.integers(1, 2**63, PLACES * 8, dtype=np.uint64) | np.uint64(1)


def distance_for(limit: float, places: int = PLACES) -> int:
    """A distance that a pair at the limit exceeds once in some 100,000 times (4.7 deviations)."""
    return min(places, math.floor(places * (1 - limit) + 4.7 * math.sqrt(places * limit * (1 - limit))))


def document_sets(text: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, the rows' shingle sets one after the other, and their offsets."""
    for start, end in chunks(text):
        w = words(text.slice(start, end - start))
        values, rows = shingles(w, word_hashes(w, folded=True), size)
        yield start, *sets(values, rows, end - start)


def signatures(values: np.ndarray, offsets: np.ndarray, places: int = FINE) -> np.ndarray:
    """MinHash values of 16 bits, a row for each set; empty sets have zeros."""
    out = np.zeros((len(offsets) - 1, places), np.uint16)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        short = (values >> np.uint64(32)).astype(np.uint32)
        begin = offsets[:-1][some]
        for i in range(places):
            out[some, i] = np.minimum.reduceat(short * _TIMES[i] + _PLUS[i], begin).astype(np.uint16)
    return out


def set_ids(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, as signed integers."""
    total = lambda x: np.diff(np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64))[offsets])
    size = np.diff(offsets).astype(np.uint64)
    return mix(total(mix(values)) + size).view(np.int64), mix(total(mix(values * np.uint64(0x9FB21C651E98DF25))) ^ size).view(np.int64)


def sketch(docs: DataFrame, size: int = 5, places: int = PLACES, fine: int = FINE) -> DataFrame:
    """uid, doc_id, n (distinct shingles), class (set_id, set_id2) and both signatures of each row of ``docs`` (uid, doc_id, text)."""

    def fixed(values: np.ndarray, kind: str) -> pa.Array:
        raw = np.ascontiguousarray(values).astype(kind)
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1] * raw.itemsize), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, values, offsets in document_sets(batch["text"], size):
                n = len(offsets) - 1
                one, two = set_ids(values, offsets)
                least = signatures(values, offsets, max(places, fine))
                yield pa.record_batch([batch["uid"].slice(start, n), batch["doc_id"].slice(start, n), pa.array(np.diff(offsets)), pa.array(one), pa.array(two), fixed(least[:, :places], "<u2"), fixed(least[:, :fine] & np.uint16(255), "u1")], names=["uid", "doc_id", "n", "set_id", "set_id2", "signature", "fine"])

    return docs.select("uid", "doc_id", "text").mapInArrow(run, "uid long, doc_id long, n long, set_id long, set_id2 long, signature binary, fine binary")


def _keys(distance: int):
    parts = distance // 2 + 1
    bounds = [round(i * PLACES / parts) for i in range(parts + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 20_000):
                some = batch.slice(start, 20_000)
                sig = np.frombuffer(b"".join(some["signature"].to_pylist()), "<u2").reshape(-1, PLACES).astype(np.uint64)
                term = mix(sig + np.uint64(1)) * _KEY[:PLACES]
                keys = []
                for c in range(parts):
                    whole = term[:, bounds[c] : bounds[c + 1]].sum(axis=1, dtype=np.uint64)
                    for j in range(bounds[c], bounds[c + 1]):
                        keys.append(mix(whole - term[:, j] + _KEY[PLACES + j]))
                cid = some["cid"].to_numpy()
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(cid, len(keys)))], names=["key", "cid"])

    return run


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 20_000):
                some = batch.slice(start, 20_000)
                sig = np.frombuffer(b"".join(some["signature"].to_pylist()), "<u2").reshape(-1, bands * rows).astype(np.uint64)
                term = mix(sig + np.uint64(1)) * _KEY[: bands * rows]
                keys = [mix(term[:, b * rows : (b + 1) * rows].sum(axis=1, dtype=np.uint64) + _KEY[PLACES + b]) for b in range(bands)]
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(some["cid"].to_numpy(), bands))], names=["key", "cid"])

    return run


def _near(distance: int, limit: tuple[int, int]):
    """Pairs whose fine signatures differ in at most ``distance`` places and whose sizes allow the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = [np.frombuffer(b"".join(batch[s].to_pylist()), "u1").reshape(batch.num_rows, -1) for s in ("a_fine", "b_fine")]
                a, b = batch["a_n"].to_numpy(), batch["b_n"].to_numpy()
                good = ((sig[0] != sig[1]).sum(axis=1) <= distance) & (limit[1] * np.minimum(a, b) >= limit[0] * np.maximum(a, b))
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _crossing(distance: int, limit: tuple[int, int], exact: bool = False):
    """Inside two blocks: pairs of different components that pass ``_near``; if ``exact``, only those
    whose full sets, which the rows then carry, reach the limit."""

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        cid, n = table["cid"].to_numpy(), table["n"].to_numpy()
        label = table["component"].to_numpy()
        sig = np.frombuffer(b"".join(table["fine"].to_pylist()), "u1").reshape(table.num_rows, -1)
        if exact:
            sets_ = table["shingles"].combine_chunks()
            values, offsets = sets_.values.to_numpy(), sets_.offsets.to_numpy().astype(np.int64)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        out_a, out_b = [], []
        for i in left:
            near = (label[right] != label[i]) & (cid[right] != cid[i]) & (limit[1] * np.minimum(n[right], n[i]) >= limit[0] * np.maximum(n[right], n[i]))
            js = right[near]
            js = js[(sig[js] != sig[i]).sum(axis=1) <= distance]
            if exact and len(js):
                own = offsets[i + 1] - offsets[i]
                found = np.isin(np.concatenate([values[offsets[j] : offsets[j + 1]] for j in js]), values[offsets[i] : offsets[i + 1]])
                size = offsets[js + 1] - offsets[js]
                common = np.add.reduceat(found.astype(np.int64), np.cumsum(size) - size)
                js = js[limit[1] * common >= limit[0] * (own + size - common)]
            out_a.append(np.minimum(cid[js], cid[i]))
            out_b.append(np.maximum(cid[js], cid[i]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})

    return run


def _with_ends(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("cid").alias(x), F.col("n").alias(f"{x}_n"), F.col("fine").alias(f"{x}_fine")), x)
    return pairs


def _blocks(rows: DataFrame, members: str, block: int) -> DataFrame:
    """Deal each key's rows into blocks that meet two by two, so that no group is larger than two blocks."""
    parts = F.ceil(F.col(members) / block).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cid", F.lit(3)), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", side).drop("own", "other", members)


def class_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, size: int = 5) -> DataFrame:
    """(cid, shingles) of the classes in ``wanted``, made anew from the texts of their first documents
    only; a bit filter of fixed size, 8 MB, spares the other texts the work."""
    wanted = materialise(wanted.join(classes.select("cid", "first_uid"), "cid"), "wanted")
    packed = bit_filter(wanted, "first_uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(passes(packed.value, batch["bit"].to_numpy())))
            for start, values, offsets in document_sets(some["text"], size) if some.num_rows else ():
                n = len(offsets) - 1
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.record_batch([some["uid"].slice(start, n), lists], names=["first_uid", "shingles"])

    made = docs.select("uid", "text").withColumn("bit", filter_bit("uid")).mapInArrow(run, "first_uid long, shingles array<long>").join(wanted, "first_uid").select("cid", "shingles")
    made = materialise(made, "sets")
    packed.destroy()
    return made


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, limit: tuple[int, int], size: int = 5) -> DataFrame:
    """The pairs (a, b of classes) whose full shingle sets reach ``limit`` (numerator, denominator) in Jaccard similarity."""
    ends = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    made = class_sets(ends, classes, docs, size)
    a, b = (made.select(F.col("cid").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "ab")
    both = pairs.select("a", "b").join(b, "b").join(a, "a")
    common = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - common
    return both.where(limit[1] * common >= limit[0] * union).select("a", "b")


def link(docs: DataFrame, limit: tuple[int, int] = (80, 100), size: int = 5, small: int = 64, block: int = 2048, most_kin: int = 16_384, bands: tuple[int, int] | None = None, fine: int = FINE) -> DataFrame:
    """Each row's class, component and smallest linked doc_id.

    Returns uid (the row's number in ``docs``), doc_id, n_shingles, component (its number, null without
    words), component_id (its least doc_id, which unlike rows can share) and kept (doc_id = component_id). Words are runs of anything but space and 0x09-0x0D, with A-Z
    as a-z. A document with fewer words than ``size`` has its whole sequence as one shingle; one
    without words, or with a null text, has none and is linked with nothing. Rows that repeat
    are of one class. A null doc_id is larger than any other. Only doc_id and text are read. Sets are taken
    for equal by 128 bits; all other pairs are confirmed on full sets.
    """
    return _link(numbered(docs.select("doc_id", "text")), "uid", limit, size, small, block, most_kin, bands, fine)


def _link(docs: DataFrame, row: str, limit: tuple[int, int], size: int, small: int = 64, block: int = 2048, most_kin: int = 16_384, bands: tuple[int, int] | None = None, fine: int = FINE) -> DataFrame:
    """As ``link``, of documents whose rows ``row`` numbers."""
    docs = docs.select(F.col(row).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    distance = distance_for(limit[0] / limit[1])
    rows = materialise(sketch(docs, size, bands[0] * bands[1] if bands else PLACES, fine), "sketches")
    known = rows.where("n > 0")
    classes = known.groupBy("set_id", "set_id2").agg(F.min("uid").alias("first_uid"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("fine").alias("fine"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    keys = classes.select("cid", "signature").mapInArrow(_bands(*bands) if bands else _keys(distance), "key long, cid long")
    # Counts are taken before the shuffle too, and the join with them splits a key that many classes share.
    often = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "often")
    shared = materialise(keys.join(often, "key"), "keys")
    weight = shared.groupBy("cid").agg(F.sum("members").alias("weight"))
    weighed = shared.join(weight, "cid")
    hubs = weighed.groupBy("key").agg(F.max_by("cid", F.struct("weight", "cid")).alias("hub"))
    star = weighed.select("key", "cid").join(hubs, "key").where("cid <> hub").select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
    ends = classes.select("cid", "n", "fine")
    apart = distance_for(limit[0] / limit[1], fine)
    star = materialise(_with_ends(star, ends).mapInArrow(_near(apart, limit), "a long, b long"), "star")
    edges = materialise(confirm(star, classes, docs, limit, size), "links")
    label = components(edges)

    labelled = shared.join(label.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    left = materialise(labelled.join(mixed, "key"), "open")
    few = left.where(F.col("members") <= small)
    one, two = (few.select("key", F.col("cid").alias(x), F.col("component").alias(f"{x}c")) for x in "ab")
    pairs = one.join(two, "key").where("a < b and ac <> bc").select("a", "b").distinct()
    pairs = _with_ends(pairs, ends).mapInArrow(_near(apart, limit), "a long, b long")
    # Members of larger keys are gathered into families, so that a pair meets once and not for each key
    # that it shares, and is verified where it meets.
    large = left.where(F.col("members") > small)
    first = large.groupBy("key").agg(F.min("cid").alias("b"))
    family = components(large.select("key", F.col("cid").alias("a")).join(first, "key")).select(F.col("id").alias("cid"), F.col("component").alias("family"))
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("kin"))
    family = materialise(family.join(sizes, "family").join(large.select("cid", "component").distinct(), "cid"), "families")
    kin = family.where(F.col("kin") <= most_kin)
    kin = kin.join(ends, "cid").join(class_sets(kin.select("cid"), classes, docs, size), "cid")
    verified = _blocks(kin.withColumnRenamed("family", "key"), "kin", block).groupBy("key", "i", "j").applyInArrow(_crossing(apart, limit, exact=True), "a long, b long")
    # In a larger family only those that share a key are compared.
    many = large.join(family.where(F.col("kin") > most_kin).select("cid"), "cid", "left_semi").join(ends, "cid")
    more = _blocks(many, "members", block).groupBy("key", "i", "j").applyInArrow(_crossing(apart, limit), "a long, b long")
    rest = materialise(pairs.union(more).distinct().join(star, ["a", "b"], "left_anti"), "rest")
    verified = materialise(verified, "links3")
    further = [verified] if verified.take(1) else []
    if rest.take(1):
        further.append(materialise(confirm(rest, classes, docs, limit, size), "links2"))
    if further:
        label = components(reduce(DataFrame.union, further, edges))

    group = classes.join(label.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    group = salted_lookup(group.select("set_id", "set_id2", "component", F.col("least_id").alias("component_id")), ["component"], "component_id", "set_id", value=F.min)
    group = group.select("set_id", "set_id2", "component", "component_id")
    salted = known.withColumn("_salt", F.pmod(F.xxhash64("uid"), F.lit(64)))
    per = salted.select("set_id", "set_id2", "_salt").distinct().join(group, ["set_id", "set_id2"])
    found = salted.join(per, ["set_id", "set_id2", "_salt"]).select("uid", "doc_id", F.col("n").alias("n_shingles"), "component", "component_id")
    alone = rows.where("n = 0").select("uid", "doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, limit: tuple[int, int] = (80, 100), size: int = 5) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component, with their columns: the first row
    among those with the component's smallest doc_id. Rows without words stay, whatever they repeat."""
    row = fresh(docs, "row")
    stored = numbered(docs, row)
    linked = _link(stored, row, limit, size).where("kept")
    first = linked.where("n_shingles > 0").groupBy("component").agg(F.min("uid").alias(row)).select(row)
    alone = linked.where("n_shingles = 0").select(F.col("uid").alias(row))
    return stored.join(first.union(alone), row, "left_semi").select(*docs.columns)


#: All pairs of documents that share a shingle, and their closure; for small tables, at 85 in 100.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
