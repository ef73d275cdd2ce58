"""A stored inverted index: posting blocks with bounds, kept up by upserts, and searched for the best k.

An index is a folder. An upsert adds a segment: numbered documents (``docs``), their postings by block of 4,096 numbers, dealt into
buckets of terms (``postings``), one bitmap for each attribute value and block (``facets``), and bitmaps of the numbers of older
segments that are gone now (``gone``). The segment counts from when its row stands in ``log``, which is written last: what an
upsert that failed has left behind is never read, and is overwritten by the next one.

A search reads the buckets and terms of its queries only. A block's bound is the sum of its terms' largest possible parts. Each query
scores its most promising blocks first; blocks whose bound stays under the k-th score found there can't hold
one of the best k and aren't read any further.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanmark.functions.text import tokens
from gleanmark.operators.graph import stored, width
from gleanmark.operators.retrieval import K1, B

#: Numbers of one block, as a power of 2; a bitmap of a block has 512 bytes.
BLOCK_BITS = 12
#: Blocks that each query scores before it prunes, and terms up to which a scan is told them one by one.
FIRST, NAMED = 4, 1024
#: A posting block: how many documents, their largest frequency and shortest length, and all three of each.
POSTINGS = "term string, block long, n int, most double, shortest int, positions array<int>, tfs array<double>, lengths array<int>, segment int, bucket int"


@dataclass(frozen=True)
class Index:
    """Where an index is, and what it holds: ``key`` names documents, ``fields`` are texts with weights, ``facets`` are attributes to filter by."""

    path: str
    key: str
    fields: dict[str, float]
    facets: tuple[str, ...] = ()
    buckets: int = 64

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A table of all committed segments."""
        done = segments(spark, self)
        paths = [f"{self.path}/{name}/segment={n}" for n in done]
        reader = spark.read.option("basePath", f"{self.path}/{name}")
        return (reader.schema(POSTINGS) if name == "postings" else reader).parquet(*paths)


def segments(spark: SparkSession, index: Index) -> list[int]:
    return [int(r["segment"]) for r in _log(spark, index)]


def _log(spark: SparkSession, index: Index) -> list:
    """One small row for each upsert so far."""
    try:
        told = spark.read.schema("segment int, docs long, tokens long").parquet(f"{index.path}/log")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return told.orderBy("segment").collect()


def _block() -> Column:
    return F.shiftright("number", BLOCK_BITS).alias("block")


def _position() -> Column:
    return F.col("number").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("position")


def _bitmap() -> Column:
    """The bits of a block's positions, from a group's rows."""
    return F.substring(F.bitmap_construct_agg(F.col("position").cast("long")), 1, 1 << BLOCK_BITS - 3).alias("bits")


def _has(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(position, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, position.bitwiseAND(F.lit(7))) == 1


def upsert(index: Index, docs: DataFrame, delete: bool = True) -> Index:
    """Bring the index to the state of ``docs`` (key, fields, facets): what is new or changed goes into a new segment, what
    was there before it, and with ``delete`` what ``docs`` doesn't have any more, is marked gone. Equal rows cost a digest.

    A null key is left out; of repeated keys one row counts, the least by its digest. Null texts are empty."""
    spark, every = docs.sparkSession, [*index.fields, *index.facets]
    log = _log(spark, index)
    segment = len(log)
    digest = F.sha2(F.to_json(F.struct(*every), {"ignoreNullFields": "false"}), 256)
    now = docs.where(F.col(index.key).isNotNull()).select(F.col(index.key).alias("key"), *every, digest.alias("digest"))
    now = now.groupBy("key").agg(F.min_by(F.struct(*every, "digest"), "digest").alias("d")).select("key", "d.*")
    gone = None
    if log:
        known = _live(spark, index).select("key", F.col("digest").alias("before"), "segment", "number")
        # Which version stays needs no text: only keys and digests meet.
        both = stored(known.join(now.select("key", "digest"), "key", "full" if delete else "right"))
        gone = both.where(F.col("number").isNotNull() & ~F.col("before").eqNullSafe(F.col("digest"))).select("segment", "number")
        now = now.join(both.where(F.col("digest").isNotNull() & ~F.col("before").eqNullSafe(F.col("digest"))).select("key"), "key", "left_semi")
    lists = [tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"t_{i}") for i, f in enumerate(index.fields)]
    sized = now.select(F.monotonically_increasing_id().alias("number"), "key", "digest", *index.facets, *lists)
    length = reduce(lambda a, b: a + b, [F.size(f"t_{i}") for i in range(len(lists))])
    at = lambda name: f"{index.path}/{name}/segment={segment}"
    # Numbers hold once they are written; everything else is made of what was written.
    sized.withColumn("length", length).write.mode("overwrite").parquet(f"{index.path}/staged")
    staged = spark.read.parquet(f"{index.path}/staged")
    staged.select("number", "key", "digest", *index.facets, "length").write.mode("overwrite").parquet(at("docs"))
    parts = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.col(f"t_{i}").alias("t")) for i, w in enumerate(index.fields.values())])
    told = staged.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("tokens")).first()
    # Tasks grow in number and not in size: a document's terms are counted where it is, and what goes into one
    # bucket is dealt by zones of blocks, of which each makes one file.
    slices = width(spark, told["tokens"])
    zones = -(-slices // index.buckets)
    words = staged.repartition(slices, "number").select("number", "length", F.explode(parts).alias("p")).select("number", "length", "p.w", F.explode("p.t").alias("term"))
    counted = words.groupBy("term", "number", "length").agg(F.sum("w").alias("tf"))
    posting = F.struct(_position(), F.col("tf").cast("double").alias("tf"), F.col("length").cast("int").alias("length"))
    placed = counted.select(bucket(F.col("term"), index.buckets).alias("bucket"), "term", _block(), posting.alias("x")).withColumn("zone", F.pmod("block", F.lit(zones)))
    blocks = placed.repartition(slices, "bucket", "zone").groupBy("bucket", "zone", "term", "block").agg(F.array_sort(F.collect_list("x")).alias("x"))
    held = blocks.select("bucket", "term", "block", F.size("x").alias("n"), *[F.col(f"x.{c}").alias(f"{c}s") for c in ("position", "tf", "length")])
    rows = held.select("bucket", "term", "block", "n", F.array_max("tfs").alias("most"), F.array_min("lengths").alias("shortest"), "positions", "tfs", "lengths")
    rows.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
    values = F.inline(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in index.facets] or [F.struct(F.lit("").alias("facet"), F.lit(None).cast("string").alias("value"))]))
    maps = staged.select(_block(), _position(), values).where("value is not null").groupBy("facet", "value", "block").agg(_bitmap())
    maps.write.mode("overwrite").parquet(at("facets"))
    none = spark.createDataFrame([], "segment int, number long")
    left = (gone if gone is not None else none).select(F.col("segment").alias("of"), "number").select("of", _block(), _position())
    left.groupBy("of", "block").agg(_bitmap()).write.mode("overwrite").parquet(at("gone"))
    counts = spark.createDataFrame([(segment, told["docs"], told["tokens"])], "segment int, docs long, tokens long")
    counts.coalesce(1).write.mode("append").parquet(f"{index.path}/log")
    return index


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _gone(spark: SparkSession, index: Index) -> DataFrame:
    """(segment, block, dead): positions that have gone, as one bitmap for each block that has any."""
    return index.table(spark, "gone").groupBy(F.col("of").alias("segment"), "block").agg(F.bitmap_or_agg("bits").alias("dead"))


def _live(spark: SparkSession, index: Index) -> DataFrame:
    docs = index.table(spark, "docs").select("*", _block(), _position())
    met = docs.join(_gone(spark, index), ["segment", "block"], "left")
    return met.where(F.col("dead").isNull() | ~_has(F.col("dead"), F.col("position"))).drop("dead", "block", "position")


def postings(index: Index, asked: DataFrame) -> DataFrame:
    """Posting blocks of the terms of ``asked`` (term): the scan is told the buckets, and the terms where they are few."""
    spark = asked.sparkSession
    told = stored(asked.select("term").distinct())
    rows = index.table(spark, "postings")
    near = [int(r["bucket"]) for r in told.select(bucket(F.col("term"), index.buckets).alias("bucket")).distinct().collect()]
    rows = rows.where(F.col("bucket").isin(near))
    few = [r["term"] for r in told.limit(NAMED + 1).collect()]
    rows = rows.where(F.col("term").isin(few)) if len(few) <= NAMED else rows.join(told, "term", "left_semi")
    return rows


def _allowed(index: Index, spark: SparkSession, where: dict[str, list[str]]) -> DataFrame | None:
    """(segment, block, bits...): a bitmap for each filtered attribute; a block without one of them has no row."""
    maps = None
    for i, (facet, values) in enumerate(where.items()):
        some = index.table(spark, "facets").where((F.col("facet") == facet) & F.col("value").isin([str(v) for v in values])).groupBy("segment", "block").agg(F.bitmap_or_agg("bits").alias(f"may_{i}"))
        maps = some if maps is None else maps.join(some, ["segment", "block"])
    return maps


def search(index: Index, queries: DataFrame, k: int, every: bool = False, where: dict[str, list[str]] | None = None, usable: DataFrame | None = None) -> DataFrame:
    """The best ``k`` documents of each query (query_id, query): query_id, key, score (BM25, negative, less is better), rank from 0.

    ``every`` asks for all terms of a query. ``where`` (attribute: values) narrows what is ranked, by bitmaps, before the limit;
    statistics stay those of all documents. ``usable`` (key) is asked after the limit, so that fewer than ``k`` may be
    left, with their ranks. Scores are rounded to six digits, and equals go by key. A query without terms finds nothing."""
    spark = queries.sparkSession
    log = _log(spark, index)
    if not log:
        raise ValueError("the index has no segment yet")
    asked = stored(queries.select("query_id", F.explode(F.array_distinct(tokens(F.coalesce("query", F.lit("")))))).toDF("query_id", "term"))
    lists = postings(index, asked)
    dead = _gone(spark, index)
    some_gone = bool(dead.take(1))
    if some_gone:
        lost = index.table(spark, "docs").select("segment", _block(), _position(), "length").join(dead, ["segment", "block"])
        lost = lost.where(_has(F.col("dead"), F.col("position"))).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t")).first()
        lists = lists.join(dead, ["segment", "block"], "left")
        here = F.when(F.col("dead").isNull(), F.col("n")).otherwise(F.size(F.filter("positions", lambda p: ~_has(F.col("dead"), p))))
    else:
        lost, here = {"n": 0, "t": 0}, F.col("n")
    n = sum(r["docs"] for r in log) - lost["n"]
    mean = (sum(r["tokens"] for r in log) - lost["t"]) / max(n, 1)
    # Bounds need no postings: the scan leaves out the arrays, but where something has gone.
    heads = stored(lists.select("segment", "block", "term", here.alias("n"), "most", "shortest").where("n > 0"))
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = heads.groupBy("term").agg(F.sum("n").cast("double").alias("df")).withColumn("idf", F.when(idf <= 0, 1e-6).otherwise(idf))
    weights = stored(asked.join(weights, "term").select("query_id", "term", "idf"))
    needed = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))

    def part(tf: Column, length: Column) -> Column:
        return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean or 1.0)))

    bounds = heads.join(weights, "term").groupBy("query_id", "segment", "block").agg(F.sum(part(F.col("most"), F.col("shortest"))).alias("bound"), F.count(F.lit(1)).alias("terms"))
    if every:
        bounds = bounds.join(needed, "query_id").where("terms = needed").drop("needed")
    maps = _allowed(index, spark, where or {})
    if maps is not None:
        bounds = bounds.join(maps.select("segment", "block"), ["segment", "block"], "left_semi")
    bounds = stored(bounds.drop("terms"))

    def score(chosen: DataFrame) -> DataFrame:
        """The best k documents of the chosen (query_id, segment, block)."""
        rows = lists.join(chosen.select("segment", "block").distinct(), ["segment", "block"], "left_semi")
        if maps is not None:
            rows = rows.join(maps, ["segment", "block"])
        rows = rows.withColumn("x", F.explode(F.arrays_zip("positions", "tfs", "lengths")))
        if some_gone:
            rows = rows.where(F.col("dead").isNull() | ~_has(F.col("dead"), F.col("x.positions")))
        for i in range(len(where or {})):
            rows = rows.where(_has(F.col(f"may_{i}"), F.col("x.positions")))
        rows = rows.select("segment", "block", "term", F.col("x.positions").alias("position"), F.col("x.tfs").alias("tf"), F.col("x.lengths").alias("length"))
        met = rows.join(weights, "term").join(chosen, ["query_id", "segment", "block"])
        told = met.groupBy("query_id", "segment", "block", "position").agg((F.round(-F.sum(part(F.col("tf"), F.col("length"))), 6) + 0.0).alias("score"), F.count(F.lit(1)).alias("terms"))
        if every:
            told = told.join(needed, "query_id").where("terms = needed").drop("needed")
        return told.drop("terms")

    def best(told: DataFrame) -> DataFrame:
        """With their keys, which decide between equals."""
        # Equal scores at the edge all stay until the keys are there.
        edge = told.withColumn("_r", F.rank().over(W.partitionBy("query_id").orderBy("score"))).where(F.col("_r") <= k).drop("_r")
        names = index.table(spark, "docs").select("segment", "number", "key")
        return edge.withColumn("number", F.shiftleft("block", BLOCK_BITS).bitwiseOR(F.col("position").cast("long"))).join(names, ["segment", "number"]).select("query_id", "key", "score")

    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block"))
    first = bounds.withColumn("_r", order).where(F.col("_r") <= FIRST).drop("_r")
    begun = stored(score(first.drop("bound")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("score"))
    limits = begun.withColumn("_r", place).where(F.col("_r") <= k).groupBy("query_id").agg(F.max("score").alias("limit"), F.count(F.lit(1)).alias("found")).where(F.col("found") == k)
    rest = bounds.join(first.drop("bound"), ["query_id", "segment", "block"], "left_anti").join(limits, "query_id", "left")
    rest = rest.where(F.col("limit").isNull() | (F.col("bound") >= -F.col("limit") - 1e-5)).select("query_id", "segment", "block")
    found = best(begun.unionByName(score(stored(rest))))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "key"))).where(F.col("rank") <= k)
    ranked = ranked.withColumn("rank", F.col("rank") - 1).withColumnRenamed("key", index.key)
    return ranked if usable is None else ranked.join(usable.select(index.key), index.key, "left_semi")
