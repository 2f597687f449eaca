"""Structured Streaming twins of triage, notice counts and state changes.

Every sink writes one folder per micro-batch and overwrites that folder when
the batch is replayed, so a restart after a failure gives each row once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from siteloom.functions.triage import triage
from siteloom.operators.changes import apply_task_changes, apply_ticket_changes, last_change, new_rows, ticket_batch, update_batch
from siteloom.schema import SiteTables
from siteloom.sources import snapshots

EPOCH = "lotto"


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _write_epoch(rows: DataFrame, root: str, epoch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/{EPOCH}={epoch}")


def _start(writer: DataStreamWriter, checkpoint: str, every: str | None) -> StreamingQuery:
    """Run until the input is used up, or on and on at an interval such as "1 minute"."""
    timed = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return timed.option("checkpointLocation", checkpoint).start()


def read_epochs(spark: SparkSession, root: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(root)


# --- messages to tickets ---------------------------------------------------
def messages_to_tickets(
    messages: DataFrame, tickets_out: str, updates_out: str, checkpoint: str, as_of: dt.date, every: str | None = None
) -> StreamingQuery:
    """Triage a message stream into a ticket sink and a field-update sink.

    The stream keeps no state and drops no late message. Copies of a message
    are removed inside a batch here, and across batches by ``once_per_message``.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        sorted_out = triage(batch.dropDuplicates(["id"])).persist()
        _write_epoch(ticket_batch(sorted_out, as_of), tickets_out, epoch)
        _write_epoch(update_batch(sorted_out), updates_out, epoch)
        sorted_out.unpersist()

    return _start(messages.writeStream.foreachBatch(write), checkpoint, every)


def once_per_message(rows: DataFrame) -> DataFrame:
    """Rows of a sink without those of messages that were delivered again."""
    return rows.drop(EPOCH).dropDuplicates(["messaggio_id"])


def rows_to_append(
    spark: SparkSession, tickets_out: str, updates_out: str, tables: SiteTables, now: dt.datetime, after: int = -1, upto: int | None = None
) -> dict[str, DataFrame]:
    """What the sinks hold as rows of their tables: defaults, and ids after those in use, in the order of the messages.

    Only the batches ``after`` one number and ``upto`` another; messages that an earlier batch brought are left out.
    """
    sinks = {"ticket": tickets_out, "aggiornamenti": updates_out}
    made = {}
    for name, path in sinks.items():
        rows = read_epochs(spark, path)
        new = rows.where(F.col(EPOCH) > after)
        new = new if upto is None else new.where(F.col(EPOCH) <= upto)
        before = rows.where(F.col(EPOCH) <= after).select("messaggio_id")
        new = new.join(before, "messaggio_id", "left_anti") if after >= 0 else new
        made[name] = new_rows(once_per_message(new), name, tables[name], "messaggio_id", now)
    return made


#: batches of a snapshot that came from a message stream, by the last batch of the stream that they hold
MERGED = "messaggi-"


def merge_messages(spark: SparkSession, root: str, tickets_out: str, updates_out: str, now: dt.datetime, upto: int | None = None) -> bool:
    """Add to a snapshot what the sinks hold beyond the batches it took before; whether there was anything.

    The snapshot's manifest names the last batch of the stream that it holds, and it is published together with the rows
    of both tables: merging again, or again after a failure, adds nothing twice. While the stream runs, ``upto`` names
    the last batch that it has finished.
    """
    done = max((int(name.removeprefix(MERGED)) for name in snapshots.manifest(spark, root).batches if name.startswith(MERGED)), default=-1)
    # updates are written after tickets
    last = read_epochs(spark, updates_out).agg(F.max(EPOCH)).first()[0]
    last = last if upto is None or last is None else min(last, upto)
    if last is None or last <= done:
        return False
    rows = rows_to_append(spark, tickets_out, updates_out, snapshots.read_tables(spark, root), now, done, last)
    return snapshots.append_batch(spark, root, rows, f"{MERGED}{last}")


# --- running notice counts -------------------------------------------------
RUNNING = "cantiere_id long, ticket_id long, ultima_notifica timestamp, notifiche long"


class RunningNotices(StatefulProcessor):
    """The last notice and the number of notices of each ticket, from where a compacted batch left off.

    A ticket's state begins with its row of ``start`` if it has one. It is dropped when the ticket is closed: a row with
    ``chiuso`` true, which counts as no notice.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "last timestamp, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        last, n = self.kept.get() if self.kept.exists() else (None, 0)
        closed = False
        for part in rows:
            closed = closed or bool(part["chiuso"].any())
            sent = part[~part["chiuso"].astype(bool)]
            n += len(sent)
            times = sent["created_at"].dropna()
            if len(times):
                newest = times.max().to_pydatetime()
                last = newest if last is None else max(last, newest)
        if closed:
            self.kept.clear()
        else:
            self.kept.update((last, n))
        yield pd.DataFrame({"cantiere_id": [key[0]], "ticket_id": [key[1]], "ultima_notifica": [last], "notifiche": [n]})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        newest = initialState["ultima_notifica"].max()
        self.kept.update((None if pd.isna(newest) else newest.to_pydatetime(), int(initialState["notifiche"].max())))

    def close(self) -> None:
        pass


def running_latest_notices(
    notices: DataFrame, out: str, checkpoint: str, every: str | None = None, start: DataFrame | None = None, closings: DataFrame | None = None
) -> StreamingQuery:
    """Keep the last notice and the count per ticket; each batch writes the tickets it changed.

    ``start`` holds compacted counts (``compact_latest_notices``) that a new stream begins with. ``closings`` is a stream
    of closed tickets (cantiere_id, ticket_id), whose state is dropped, so that it doesn't grow with every ticket there
    ever was; what was counted stays in what was written. A notice after that counts from 1 again: name tickets that get
    none any more. Without both, the counts are a plain aggregation.
    """
    linked = notices.where(F.col("ticket_id").isNotNull())
    if start is None and closings is None:
        running = linked.groupBy("cantiere_id", "ticket_id").agg(
            F.max("created_at").alias("ultima_notifica"), F.count(F.lit(1)).alias("notifiche")
        )
    else:
        events = linked.select("cantiere_id", "ticket_id", F.col("created_at").cast("timestamp"), F.lit(False).alias("chiuso"))
        if closings is not None:
            ended = closings.select("cantiere_id", "ticket_id", F.lit(None).cast("timestamp").alias("created_at"), F.lit(True).alias("chiuso"))
            events = events.unionByName(ended)
        keys = ["cantiere_id", "ticket_id"]
        first = None if start is None else start.select(*keys, F.col("ultima_notifica").cast("timestamp"), F.col("notifiche").cast("long")).groupBy(*keys)
        running = events.groupBy(*keys).transformWithStateInPandas(RunningNotices(), RUNNING, "update", "none", first)
        running = running.withColumn("ultima_notifica", F.col("ultima_notifica").cast("timestamp_ntz"))
    writer = running.writeStream.outputMode("update")
    return _start(writer.foreachBatch(lambda batch, epoch: _write_epoch(batch, out, epoch)), checkpoint, every)


def current_latest_notices(spark: SparkSession, *outs: str) -> DataFrame:
    """The newest state of every ticket from the written batches, compacted ones included.

    Count and time only ever grow, so the largest of each is the newest, and it
    does no harm if a batch is read both by itself and compacted.
    """
    batches = reduce(DataFrame.unionByName, [read_epochs(spark, out).drop(EPOCH) for out in outs])
    return batches.groupBy("cantiere_id", "ticket_id").agg(
        F.max("ultima_notifica").alias("ultima_notifica"), F.max("notifiche").alias("notifiche")
    )


def compact_latest_notices(spark: SparkSession, out: str, compacted: str) -> None:
    """One row per ticket in a new folder; the batches it was made of may go then."""
    current_latest_notices(spark, out).write.mode("errorifexists").parquet(compacted)


# --- state changes ---------------------------------------------------------
def changes_to_log(changes: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream of keyed state changes to a change log, one folder per batch.

    The current table is base + log (``with_log``); writing that result as a new
    snapshot now and then keeps the log short. No batch rewrites the table.
    """
    writer = changes.writeStream.foreachBatch(lambda batch, epoch: _write_epoch(batch, out, epoch))
    return _start(writer, checkpoint, every)


def with_log(tables: SiteTables, table: str, log: DataFrame) -> SiteTables:
    """The tables after a change log of tasks or tickets; a log that was merged before changes nothing."""
    apply = {"attivita": apply_task_changes, "ticket": apply_ticket_changes}[table]
    return tables.replaced(table, apply(tables[table], log))


def merge_changes(spark: SparkSession, root: str, table: str, log: DataFrame, batch: str) -> list[str]:
    """Apply a change log of tasks or tickets to a snapshot; the folders that were replaced.

    Only the ranges of ids that the log hits are written anew, the others stay as they are. With the same ``batch`` a
    log is merged once.
    """
    apply = {"attivita": apply_task_changes, "ticket": apply_ticket_changes}[table]
    return snapshots.replace_ranges(spark, root, table, log.select("id"), lambda rows: apply(rows, log), batch)


def latest_states(log: DataFrame) -> DataFrame:
    """Newest logged state per key, by event time, then sequence."""
    return last_change(log, "id", ["ts", "seq"])
