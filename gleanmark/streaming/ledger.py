"""The gap ledger as a stream: transitions and low-yield runs, folded event by event with state that outlives the batch."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Outcomes that settle a gap, and the states that are worked on.
SETTLES = {"linked": "resolved", "candidates": "candidate_ready", "edge": "needs_review"}
OPEN = ("open", "retry_wait")
#: What a step leaves behind for the next one, and what it tells.
STATE = "state string, attempts int, low_run int, tripped boolean, last_at timestamp, last_id long"
TOLD = "key {kind}, event_id long, state string, attempts int, low_run int, tripped boolean, late boolean"
STORE = "spark.sql.streaming.stateStore.providerClass"


def step(state: tuple, at: datetime, event_id: int, outcome: str | None, value: float | None, most: int, least: float, trip: int) -> tuple:
    """The state after an event. An outcome works on a gap that is open or waits for a retry: the attempt counts, and what settles nothing
    leads to another retry, or after ``most`` attempts to exhaustion; "reopen" begins anew from any state. A
    value below ``least`` makes the low run longer, any other ends it, none leaves it; after ``trip`` in a row the breaker has tripped, for good."""
    name, attempts, run, tripped, _, _ = state
    if outcome == "reopen":
        name, attempts = "open", 0
    elif outcome is not None and name in OPEN:
        attempts += 1
        name = SETTLES.get(outcome) or ("exhausted" if attempts >= most else "retry_wait")
    if value is not None and not pd.isna(value):
        run = run + 1 if value < least else 0
        tripped = tripped or run >= trip
    return name, attempts, run, tripped, at, event_id


class Ledger(StatefulProcessor):
    """``step`` over the events of a key, in order of time and id, whatever batches they come in. An event that isn't after
    the last one that was folded is late: it is told as such and changes nothing, so that a replay gives the same."""

    def __init__(self, most: int = 3, least: float = 40.0, trip: int = 3) -> None:
        self.most, self.least, self.trip = most, least, trip

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # All of a batch's events of one key, a slice of a log; the state itself is one row.
        events = pd.concat(rows).sort_values(["at", "event_id"], kind="stable")
        held = tuple(self.state.get()) if self.state.exists() else ("open", 0, 0, False, None, None)
        out = []
        for at, event_id, outcome, value in zip(events["at"], events["event_id"], events["outcome"], events["value"], strict=True):
            at = pd.Timestamp(at).to_pydatetime()
            late = held[4] is not None and (at, event_id) <= (held[4], held[5])
            if not late:
                held = step(held, at, int(event_id), outcome if isinstance(outcome, str) else None, value, self.most, self.least, self.trip)
            out.append((key[0], event_id, *held[:4], late))
        self.state.update(held)
        yield pd.DataFrame(out, columns=["key", "event_id", "state", "attempts", "low_run", "tripped", "late"])

    def close(self) -> None:
        pass


def folded(events: DataFrame, processor: Ledger | None = None) -> DataFrame:
    """``events`` (key, at, event_id, outcome, value; a stream) with the ledger after each: key, event_id, state, attempts, low_run,
    tripped, late."""
    kind = dict(events.dtypes)["key"]
    return events.groupBy("key").transformWithStateInPandas(processor or Ledger(), TOLD.format(kind=kind), "Append", "None")


def run(spark: SparkSession, events: DataFrame, sink: str, checkpoint: str, processor: Ledger | None = None) -> DataFrame:
    """Fold what the stream has by now into the table at ``sink`` and return it. A second call goes on where the first has stopped, and a
    batch that is run again overwrites its own folder."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        folded(events, processor).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.parquet(sink).drop("batch")


def outcomes(events: DataFrame) -> DataFrame:
    """The event log as work on each user's gap."""
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "linked").when(kind == "signup", "reopen").when(kind == "error", "nothing").when((kind == "click") & (F.col("event_id") % 7 == 0), "candidates")
    return events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), "event_id", outcome.alias("outcome"), "value")
