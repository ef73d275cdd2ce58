"""Tables with a commit log: what belongs together becomes visible together, or not at all.

A commit writes its tables as Parquet beside the ones that are there, its events with them, and last a manifest that names all of
it. Readers take what manifests name; files of a commit that failed before its manifest are never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANIFEST = "version int, token string, name string, kind string, path string"
EVENTS = "event_id string, event_type string, entity_ref string, payload string, created_at timestamp, actor string"


@dataclass(frozen=True)
class Store:
    path: str


def manifests(spark: SparkSession, store: Store) -> DataFrame:
    """One row for each table that a commit wrote: version, token, name, kind (append or snapshot), path."""
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{store.path}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def read(spark: SparkSession, store: Store, name: str, version: int | None = None) -> DataFrame | None:
    """A table as of a version, the last one if none is told: its last snapshot and what was appended since. None if it isn't there yet."""
    rows = manifests(spark, store).where(F.col("name") == name)
    rows = rows if version is None else rows.where(F.col("version") <= version)
    told = rows.orderBy("version").collect()  # one small row for each commit that wrote the table
    begin = max((i for i, r in enumerate(told) if r["kind"] == "snapshot"), default=0)
    parts = [spark.read.parquet(r["path"]) for r in told[begin:]]
    return reduce(DataFrame.unionByName, parts) if parts else None


def commit(spark: SparkSession, store: Store, token: str, tables: dict[str, tuple[str, DataFrame]], events: DataFrame | None = None) -> int:
    """Write ``tables`` (name: (append or snapshot, rows)) and ``events`` (event_type, entity_ref, payload, actor) as one commit and return its
    version. A token that was committed before writes nothing and returns that version, so that a job may run again.

    One writer at a time is assumed; a second one that takes the same version finds its manifest there and fails."""
    done = manifests(spark, store)
    before = done.where(F.col("token") == token).select("version").first()
    if before:
        return before["version"]
    last = done.agg(F.max("version")).first()[0]
    version = 0 if last is None else last + 1
    every = dict(tables)
    if events is not None:
        every["event"] = ("append", events.select(event_id(token).alias("event_id"), "event_type", "entity_ref", "payload", F.current_timestamp().alias("created_at"), "actor"))
    rows = []
    for name, (kind, df) in every.items():
        path = f"{store.path}/{name}/v={version}"
        df.write.mode("overwrite").parquet(path)  # over what a failed commit may have left
        rows.append((version, token, name, kind, path))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").parquet(f"{store.path}/log/v={version}")
    return version


def event_id(token: str) -> Column:
    """An event's id: a digest of the commit's token and what the event says, so that a commit that is run again makes the same."""
    return F.concat(F.lit("ev-"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(token), "event_type", F.coalesce("entity_ref", F.lit("")), F.coalesce("payload", F.lit("{}"))), 256), 1, 16))


def _event(rows: DataFrame, kind: str, ref: str, payload: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("event_type"), F.col(ref).cast("string").alias("entity_ref"), payload.alias("payload"), F.lit("system").alias("actor"))


def add_nodes(spark: SparkSession, store: Store, token: str, nodes: DataFrame) -> int:
    """Append nodes (id, revision, layer, type, ...), each with the event that it was made. Revisions that are there already are left as they are."""
    now = read(spark, store, "node")
    new = nodes.dropDuplicates(["id", "revision"])
    new = new if now is None else new.join(now.select("id", "revision"), ["id", "revision"], "left_anti")
    return commit(spark, store, token, {"node": ("append", new)}, _event(new, "node_created", "id", F.to_json(F.struct("revision", "layer", "type"))))


def set_status(spark: SparkSession, store: Store, token: str, changes: DataFrame) -> int:
    """Give nodes the status of ``changes`` (id, revision, new_status; of repeated ones the least), each with its event; what isn't there is passed over."""
    now = read(spark, store, "node")
    told = changes.groupBy("id", "revision").agg(F.min("new_status").alias("new_status"))
    met = now.select("id", "revision").join(told, ["id", "revision"])
    both = now.join(told, ["id", "revision"], "left").withColumn("status", F.coalesce("new_status", "status")).select(*now.columns)
    return commit(spark, store, token, {"node": ("snapshot", both)}, _event(met, "status_changed", "id", F.to_json(F.struct("revision", "new_status"))))


def insert_new(spark: SparkSession, store: Store, token: str, name: str, rows: DataFrame, key: Column, order: str) -> int:
    """Append the rows whose ``key`` no row of the table has; of rows with one key the first by ``order``. Null keys are left out."""
    now = read(spark, store, name)
    once = rows.withColumn("_k", key).where("_k is not null").withColumn("_r", F.row_number().over(W.partitionBy("_k").orderBy(order))).where("_r = 1").drop("_r")
    once = once if now is None else once.join(now.select(key.alias("_k")).distinct(), "_k", "left_anti")
    return commit(spark, store, token, {name: ("append", once.drop("_k"))})
