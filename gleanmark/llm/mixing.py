"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed shuffled order, twice over. A document goes
out in packets of a bounded number of words; a packet's virtual finish time is its source's words
up to its end over the source's target. All packets are ranged by finish time and cut where the
budget of words is spent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanmark.llm.common import WORD, fresh, materialise, numbered

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
BUCKETS, SLOTS = 4096, 4096


def targets(sizes: DataFrame, share: float = 1.5, repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets of sources: ``sizes`` has one row a source (source, source_size); a null source is last.

    The budget is ``share`` of all sizes. A target stops at ``repeats`` times its source's size, and
    what is over is shared again by weight: sources are ordered by the level at which they fill up, and
    the level of the first that doesn't is that of all after it.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(repeats) * F.col("source_size"))
    ranked = ranked.withColumn("fills", F.col("cap") / F.col("weight"))
    order = W.orderBy("fills", "rank")
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = ranked.withColumn("budget", F.lit(share) * F.sum("source_size").over(every))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("place", "level"))).over(every)
    ranked = ranked.withColumn("first", first)
    return ranked.select("source", "source_size", "rank", "weight", F.when(F.col("place") < F.coalesce(F.col("first.place"), F.lit(2**31 - 1)), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("first.level")).alias("target"))


def schedule(docs: DataFrame, share: float = 1.5, repeats: int = 2, packet: int = 256, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The packets of ``docs`` (uid, doc_id, text, source) with their finish times, and the sized documents.

    A hot source is cut into buckets of its shuffled order: sums over (source, bucket), then over a
    source's at most 4096 buckets, then inside a bucket. A null text has no words; a document without
    words is one empty packet. Rows that repeat are documents of their own.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = docs.select("uid", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("shuffle"))
    sized = materialise(sized.withColumn("bucket", F.conv(F.substring("shuffle", 1, 3), 16, 10).cast("int")), "sized")
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    target = targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, repeats)
    buckets = per_bucket.alias("b").join(target.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "t.source_size", "t.rank", "t.target")
    buckets = buckets.withColumn("before", F.sum("bucket_size").over(W.partitionBy("rank").orderBy("bucket")) - F.col("bucket_size"))
    queued = sized.alias("d").join(buckets.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket"))).select("d.uid", "d.doc_id", "d.size", "d.shuffle", "d.bucket", "b.source_size", "b.rank", "b.target", "b.before")
    inside = W.partitionBy("rank", "bucket").orderBy("shuffle", "doc_id", "size", "uid").rowsBetween(W.unboundedPreceding, 0)
    queued = queued.withColumn("at", F.col("before") + F.sum("size").over(inside) - F.col("size")).drop("before", "bucket")
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / packet))
    packets = queued.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    end = F.least(F.col("size"), (F.col("packet") + 1) * packet)
    packets = packets.withColumn("words", end - F.col("packet") * packet)
    finish = F.when(F.col("target") > 0, (F.col("at") + F.col("pass") * F.col("source_size") + end) / F.col("target")).otherwise(F.lit(0.0))
    packets = packets.withColumn("finish", finish)
    return packets.withColumn("slot", F.least(F.floor(F.col("finish") * SLOTS), F.lit(2 * SLOTS)).cast("int")), sized


#: The order of all packets.
ORDER = ("finish", "rank", "pass", "shuffle", "doc_id", "size", "uid", "packet")


def cut(packets: DataFrame, share: float = 1.5) -> DataFrame:
    """Packets with ``take``, the words of each that the budget reaches in order of finish time.

    Finish times fall into slots; running sums of the slots show in which slot the budget ends, and
    only there are packets summed one by one.
    """
    slots = packets.groupBy("slot").agg(F.sum("words").alias("words"), F.sum(F.when((F.col("pass") == 0), F.col("words"))).alias("once"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    slots = slots.withColumn("budget", F.floor(F.lit(share) * F.sum("once").over(every)).cast("long")).withColumn("before", F.sum("words").over(W.orderBy("slot")) - F.col("words"))
    slots = slots.select("slot", (F.col("budget") - F.col("before")).alias("left"), F.col("words").alias("slot_words"))
    joined = packets.join(F.broadcast(slots), "slot")  # at most 2 * SLOTS + 1 rows
    ends = (F.col("left") > 0) & (F.col("left") < F.col("slot_words"))
    running = F.sum("words").over(W.partitionBy("slot").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0))
    last = joined.where(ends).withColumn("take", F.greatest(F.lit(0), F.least(F.col("words"), F.col("left") - running + F.col("words"))))
    rest = joined.where(~ends).withColumn("take", F.when(F.col("left") > 0, F.col("words")).otherwise(F.lit(0)))
    reached = F.col("take") * 2 >= F.col("words")
    return last.unionByName(rest).withColumn("in", F.when(F.col("words") > 0, (F.col("take") > 0) & reached).otherwise(F.col("left") > 0))


def _middle(packet: int) -> Column:
    """The packet in the middle of its document: a copy of the document is in the mix if this one is."""
    return F.col("packet") == F.floor((F.greatest(F.col("size"), F.lit(1)) - 1) / (2 * packet))


def mix(docs: DataFrame, share: float = 1.5, repeats: int = 2, packet: int = 256, seed: str = "mix") -> DataFrame:
    """How much of each document the mix takes: doc_id, size, source_size, target, taken (words,
    repeats counted) and copies (times that most of the document is in).

    A null or empty text has size 0 and takes none. An empty table gives no rows.
    """
    packets, _ = schedule(numbered(docs.select("doc_id", "text", "source")), share, repeats, packet, seed)
    per = cut(packets, share).groupBy("uid", "doc_id", "size", "source_size", "target").agg(F.sum("take").alias("taken"), F.count_if(F.col("in") & _middle(packet)).alias("copies"))
    return per.select("uid", "doc_id", "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix has them, in the mix's order: each row as often as it is taken, with
    all its columns and no others. A document is in a pass if the middle one of its packets is."""
    row, finish = fresh(docs, "row"), fresh(docs, "finish")
    stored = numbered(docs, row)
    packets, _ = schedule(stored.select(F.col(row).alias("uid"), "doc_id", "text", "source"), **options)
    starts = cut(packets, options.get("share", 1.5)).where(F.col("in") & _middle(options.get("packet", 256))).select(F.col("uid").alias(row), F.col("finish").alias(finish))
    return stored.join(starts, row).repartitionByRange(finish, row).sortWithinPartitions(finish, row).select(*docs.columns)


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM s),
f AS (SELECT *, cap / CAST(weight AS DOUBLE) AS fills, 15e-1 * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM w),
l AS (SELECT *, row_number() OVER (ORDER BY fills, rank) AS place,
  (budget - coalesce(CAST(sum(cap) OVER (ORDER BY fills, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
  / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY fills, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM f),
k AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM l WHERE level <= fills),
t AS (SELECT l.source, l.rank, source_size, CASE WHEN k.place IS NULL OR l.place < k.place THEN CAST(cap AS DOUBLE) ELSE weight * k.level END AS target FROM l, k),
q AS (SELECT d.*, t.rank, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY t.rank ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS pos FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT q.*, pass, packet, least(size, (packet + 1) * 256) AS e FROM (SELECT *, unnest(range(0, greatest(1, (size + 255) // 256))) AS packet FROM q) q, (VALUES (0), (1)) AS x(pass)),
v AS (SELECT *, e - packet * 256 AS words, CASE WHEN target > 0 THEN CAST(pos + pass * source_size + e AS DOUBLE) / target ELSE 0 END AS finish FROM p),
r AS (SELECT *, sum(words) OVER (ORDER BY finish, rank, pass, shuffle, doc_id, size, packet ROWS UNBOUNDED PRECEDING) AS running FROM v),
b AS (SELECT CAST(floor(15e-1 * CAST(sum(size) AS DOUBLE)) AS BIGINT) AS budget FROM sized)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(words, budget - running + words))) AS BIGINT) AS taken
FROM r, b GROUP BY doc_id, size, source_size, target
"""
