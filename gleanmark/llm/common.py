"""Helpers shared by the training-data operators.

Everything an operator keeps between two Spark jobs goes to Parquet in the folder that the
cluster names in ``spark.checkpoint.dir``; a lost executor then costs a re-read, never a wrong
result, and no lineage is kept on executor disks.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space of every word rule here: space and U+0009..U+000D, as a regular expression class.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; where that is unset, in the one given to
    ``setCheckpointDir``. Only in local mode, where there are no other machines, a temp folder serves."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        told = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = told.get() if told.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "gleanmark-shared")
    return f"{root.rstrip('/')}/gleanmark-{uuid.uuid4().hex}"


#: Has a query's shuffle files deleted when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str = "table", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written. The shuffle files of the
    write aren't needed any more then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` made, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where.getParent(), True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it a name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of one file that ``numbered`` can tell apart, as a power of 2.
ROW_BITS = 40


def _stored(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of a Parquet file: a scan, with filters and projections at most."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or "HadoopFsRelation" not in plan.relation().getClass().getName():
        return False
    return "Parquet" in plan.relation().fileFormat().getClass().getName()


def numbered(df: DataFrame, name: str = "uid") -> DataFrame:
    """``df`` with a column ``name``: a number of each row that every scan gives it anew, whatever the splits
    and the executors then are. It counts the files by path, and the rows in each, so that it follows
    the order of the stored table. What isn't a table of files is stored first.

    The files' numbers are broadcast, 16 bytes for each file; a scan's own list of files is longer.
    """
    if not _stored(df):
        df = materialise(df, "rows")
    place = df.metadataColumn("_metadata")
    path, number, row = (fresh(df, x) for x in ("path", "number", "row"))
    known = df.select("*", F.xxhash64(place["file_path"]).alias(path), place["row_index"].alias(row))
    paths = df.select(place["file_path"].alias(path)).distinct()
    files = paths.select(F.xxhash64(path).alias(path), (F.row_number().over(W.orderBy(path)) - 1).cast("long").alias(number))
    files = materialise(files, "files")
    both = known.join(F.broadcast(files), path)
    return both.select(*[both[c] for c in df.columns], F.shiftleft(number, ROW_BITS).bitwiseOR(F.col(row)).alias(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salted_lookup(members: DataFrame, keys: list[str], column: str, order: str, salts: int = 64, value: Callable[[str], Column] = F.max) -> DataFrame:
    """Aggregate ``column`` by ``value`` (F.min or F.max) over each group of ``keys`` and hand the result to every
    member row, in place of the column.

    A group may hold a third of all rows. The aggregate is taken per (keys, salt) first; the
    per-salt rows, at most ``salts`` for a key, then fetch their key's total, and members join on
    (keys, salt), so that a hot group is dealt over ``salts`` tasks. ``order`` is the column the salt is drawn
    from, distinct within a group as a rule.
    """
    salted = members.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    part = salted.groupBy(*keys, "_salt").agg(value(column).alias(column))
    per_salt = part.select(*keys, "_salt").join(part.groupBy(*keys).agg(value(column).alias(column)), keys)
    return salted.drop(column).join(per_salt, [*keys, "_salt"]).drop("_salt")


def salted_join(members: DataFrame, table: DataFrame, keys: list[str], order: str, salts: int = 64) -> DataFrame:
    """Inner join of ``members`` with ``table``, which has one row for each of ``keys``, also where one
    key holds a third of the members: the table's row goes to the (key, salt) pairs that occur, at
    most ``salts`` for a key, and members join on the pair."""
    salted = members.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    pairs = salted.select(*keys, "_salt").distinct().join(table, keys)
    return salted.join(pairs, [*keys, "_salt"]).drop("_salt")


#: Bits of ``few``'s filter, and of one of its rows.
FEW_BITS, FEW_ROW = 1 << 25, 1 << 15


def few(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is likely among ``ids``, with column functions only. A filter of 2 ** 25 bits, 4
    MB whatever the number of ids, spares most of the others the shuffle of a join that must still follow."""
    bit = F.pmod(F.xxhash64(column), F.lit(FEW_BITS))
    maps = ids.groupBy(F.shiftright(bit, 15).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit + 1)).alias("bits"))
    every = ids.sparkSession.range(FEW_BITS // FEW_ROW).withColumnRenamed("id", "number").join(maps, "number", "left")
    told = materialise(every.agg(F.array_sort(F.collect_list(F.struct("number", "bits"))).alias("x")).select(F.transform("x", lambda x: x.bits).alias("maps")), "filter")
    held, at = fresh(df, "maps"), fresh(df, "bit")
    rows = df.withColumn(at, bit).withColumn(held, F.get(told.scalar(), F.shiftright(at, 15).cast("int")))
    byte = F.conv(F.hex(F.substring(held, F.shiftright(F.col(at).bitwiseAND(F.lit(FEW_ROW - 1)), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.where(F.getbit(byte, F.col(at).bitwiseAND(F.lit(7)).cast("int")) == 1).drop(held, at)


FILTER_BITS = 1 << 26


def filter_bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def bit_filter(ids: DataFrame, column: str, mixed: bool = False):
    """A broadcast test for ``filter_bit`` of the ids: 2 ** 26 bits, 8 MB, whatever their number. It
    lets some others pass, so what passes must still be joined with the ids. Ids that are hashes
    themselves (``mixed``) are tested by their lowest bits."""
    import numpy as np

    bit = (F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1)) if mixed else filter_bit(column)) + 1
    maps = ids.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    packed = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in maps:  # at most 2,048 rows of 4 KB
        at = (row["bucket"] - 1) * 4096
        packed[at : at + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)[:4096]
    return ids.sparkSession.sparkContext.broadcast(packed)


def passes(packed, bits):
    """Which of an array of ``filter_bit`` values the filter lets pass."""
    import numpy as np

    return (packed[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)
