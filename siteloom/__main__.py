"""Batch jobs over a snapshot of the site tables.

python -m siteloom JOB --tables DIR --out DIR [--as-of DAY] [--site ID]

``triage`` turns messages (--messages DIR) into new tickets and field updates, by
the built-in words or by those of a table (--words DIR: lingua, elenco, parola);
``tasks``, ``sites``, ``crews``, ``tickets`` and ``quick-tickets`` complete typed
rows (--rows DIR, numbered by a column ``richiesta``), ``register-notices`` those
typed over proposed notices (by ``ticket_id``). These jobs write the rows to
append, with ids after those of the snapshot; ``append`` adds them to it.

``task-changes``, ``quick-changes``, ``ticket-changes``, ``replies`` and ``budgets``
apply a change set (--rows DIR; a stream's change log too) and write a whole new
snapshot. ``message-stream``, ``notice-stream`` and ``change-stream`` read the files
of --rows as they come, until all are read or on and on (--every "1 minute").

``merge-messages`` adds what a message stream wrote (--rows) to the snapshot in
--tables, ``merge-changes`` applies a change log to one of its tables (--table),
writing only the ranges of ids that it hits. They, and ``append``, name their
batch, so that running one again adds nothing. ``compact-notices`` writes one row
per ticket of what a notice stream wrote.

``load`` fills a place from another snapshot if it holds no site yet, ``purge``
makes an empty one, ``restore`` copies a backup after checking it, and ``use``
lets a snapshot (--name) of a store (--tables) count from now on; with --store
jobs read the one that counts.
Jobs that write rows or snapshots always work on all sites.
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteloom import vocabulary as v
from siteloom.functions import scalars as s
from siteloom.functions.triage import triage, triage_by_language
from siteloom.operators import changes
from siteloom.operators.notices import outbound_notices, registered_notices, retyped_notices
from siteloom.plans import client, dashboard, foreman, notices, reports
from siteloom.schema import MESSAGE_SCHEMA, SCHEMAS, SiteTables
from siteloom.session import build_session
from siteloom.sources import snapshots
from siteloom.streaming import feeds

Parts = dict[str, DataFrame]


def _dashboard(t: SiteTables, day: dt.date, brand: v.Brand) -> Parts:
    return dashboard.operations_dashboard(t, day, brand=brand)


def _foreman(t: SiteTables, day: dt.date, brand: v.Brand) -> Parts:
    return foreman.foreman_view(t, day, brand)


def _client(t: SiteTables, day: dt.date, brand: v.Brand) -> Parts:
    return {"schede": client.client_cards(t, day), "elenchi": client.client_lists(t)}


def _notices(t: SiteTables, day: dt.date, brand: v.Brand) -> Parts:
    return {**notices.notice_centre(t), "messaggi": outbound_notices(t.ticket, t.cantieri, t.artigiani, brand)}


def _new_rows(job: str, t: SiteTables, rows: DataFrame, day: dt.date, now: dt.datetime, given: argparse.Namespace) -> Parts:
    """The rows that a job appends, by table."""
    if job == "register-notices":
        typed = retyped_notices(outbound_notices(t.ticket, t.cantieri, t.artigiani, v.Brand(given.brand, given.brand)), rows)
        sent = registered_notices(typed, now, given.state, given.channel)
        return {"notifiche": changes.new_rows(sent, "notifiche", t.notifiche, "ticket_id", now)}
    if job == "triage":
        words = rows.sparkSession.read.parquet(given.words) if given.words else None
        found = triage(rows) if words is None else triage_by_language(rows, words)
        made = {"ticket": changes.ticket_batch(found, day), "aggiornamenti": changes.update_batch(found)}
        return {name: changes.new_rows(batch, name, t[name], "messaggio_id", now) for name, batch in made.items()}
    table, batch = {
        "tasks": ("attivita", lambda: changes.task_batch(rows, day)),
        "sites": ("cantieri", lambda: changes.site_batch(rows, day)),
        "crews": ("artigiani", lambda: changes.crew_batch(rows)),
        "tickets": ("ticket", lambda: changes.typed_tickets(rows, day)),
        "quick-tickets": ("ticket", lambda: changes.quick_tickets(rows, day)),
    }[job]
    return {table: changes.new_rows(batch(), table, t[table], "richiesta", now)}


def _changed(job: str, t: SiteTables, rows: DataFrame) -> SiteTables:
    """All tables after a change set."""
    if job == "replies":
        tickets = changes.apply_cascade(t.ticket, t.notifiche, rows)
        return t.replaced("ticket", tickets).replaced("notifiche", changes.apply_replies(t.notifiche, rows))
    table, apply = {
        "task-changes": ("attivita", changes.apply_task_changes),
        "quick-changes": ("attivita", changes.apply_quick_task_updates),
        "ticket-changes": ("ticket", changes.apply_ticket_changes),
        "budgets": ("budget_cantiere", changes.upsert_budgets),
    }[job]
    return t.replaced(table, apply(t[table], rows))


def _stream(job: str, spark: SparkSession, rows: str, out: str, day: dt.date, every: str | None) -> StreamingQuery:
    """Start a stream over the files of a folder; its own notes go to ``_checkpoint`` beside what it writes."""
    notes = f"{out}/_checkpoint"
    if job == "message-stream":
        messages = feeds.file_stream(spark, rows, MESSAGE_SCHEMA)
        return feeds.messages_to_tickets(messages, f"{out}/ticket", f"{out}/aggiornamenti", notes, day, every)
    if job == "notice-stream":
        sent = feeds.file_stream(spark, rows, SCHEMAS["notifiche"])
        return feeds.running_latest_notices(sent, f"{out}/ultime", notes, every)
    log = feeds.file_stream(spark, rows, spark.read.parquet(rows).schema)
    return feeds.changes_to_log(log, f"{out}/log", notes, every)


def _in_place(job: str, spark: SparkSession, given: argparse.Namespace) -> None:
    """Jobs that work on a snapshot or a store where it is."""
    root = given.tables
    if job == "append":
        held = {name: f"{given.rows}/{name}" for name in SiteTables.NAMES}
        rows = {name: df for name, path in held.items() if (df := snapshots.if_there(spark, path, SCHEMAS[name])) is not None}
        snapshots.append_batch(spark, root, rows, given.batch)
    elif job == "merge-messages":
        feeds.merge_messages(spark, root, f"{given.rows}/ticket", f"{given.rows}/aggiornamenti", given.now, given.upto)
    elif job == "merge-changes":
        log = spark.read.parquet(given.rows).drop(feeds.EPOCH)
        feeds.merge_changes(spark, root, given.table, log, given.batch)
    else:
        snapshots.make_current(spark, root, given.name)


def _new_place(job: str, spark: SparkSession, given: argparse.Namespace) -> None:
    """Jobs that fill a place."""
    if job == "compact-notices":
        feeds.compact_latest_notices(spark, given.rows, given.out)
    elif job == "purge":
        snapshots.purge(spark, given.out)
    elif job == "load":
        snapshots.load_if_empty(spark, given.out, snapshots.read_tables(spark, given.tables))
    else:
        found = snapshots.restore_snapshot(spark, given.tables)
        snapshots.write_snapshot(found, given.out, given.by_site, given.ranges, snapshots.manifest(spark, given.tables).batches)


WRITERS = ["triage", "tasks", "sites", "crews", "tickets", "quick-tickets", "register-notices"]
CHANGERS = ["task-changes", "quick-changes", "ticket-changes", "replies", "budgets"]
STREAMS = ["message-stream", "notice-stream", "change-stream"]
IN_PLACE = {"append": ["rows", "batch"], "merge-messages": ["rows"], "merge-changes": ["rows", "table", "batch"], "use": ["name"]}
NEW_PLACE = {"compact-notices": ["rows"], "purge": [], "load": ["tables"], "restore": ["tables"]}
VIEWS: dict[str, Callable[[SiteTables, dt.date, v.Brand], Parts]] = {
    "dashboard": _dashboard,
    "foreman": _foreman,
    "client": _client,
    "notices": _notices,
}


def _arguments(arguments: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="siteloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = [*VIEWS, *WRITERS, *CHANGERS, *STREAMS, *IN_PLACE, *NEW_PLACE, "daily-reports", "client-reports", "csv", "backup"]
    parser.add_argument("job", choices=jobs)
    parser.add_argument("--tables", help="folder of a snapshot")
    parser.add_argument("--store", help="instead of --tables: a folder of snapshots, of which the current one is read")
    parser.add_argument("--out", help="folder to write; must not exist, but for a stream that goes on and for load")
    parser.add_argument("--every", help='streams: go on at this interval, such as "1 minute"')
    parser.add_argument("--as-of", type=dt.date.fromisoformat, default=dt.date.today())
    parser.add_argument("--now", type=dt.datetime.fromisoformat, default=dt.datetime.now(), help="creation time of new rows")
    parser.add_argument("--messages", "--rows", dest="rows", help="folder with the rows that a job reads")
    parser.add_argument("--words", help="triage: folder with a table of words, by language")
    parser.add_argument("--table", choices=["attivita", "ticket"], help="merge-changes: the table")
    parser.add_argument("--batch", help="name of what is added; added once")
    parser.add_argument("--upto", type=int, help="merge-messages: the last batch that a running stream has finished")
    parser.add_argument("--name", help="use: the snapshot's name in its store")
    parser.add_argument("--channel", default=v.CHANNELS[0], help="register-notices: channel of notices that name none")
    parser.add_argument("--state", default=v.NOTICE_SENT_BY_HAND, help="register-notices: state of notices that name none")
    parser.add_argument("--site", type=int, help="one site instead of all")
    parser.add_argument("--brand", default="", help="company name printed in texts")
    parser.add_argument("--by-site", action="store_true", help="snapshots: order the files by site")
    parser.add_argument("--ranges", type=int, default=0, help="snapshots: cut tables into so many ranges of ids")
    parser.add_argument("--file-per-site", action="store_true", help="one text file per site and report")
    given = parser.parse_args(arguments)
    needed = {**IN_PLACE, **NEW_PLACE}.get(given.job, ["rows"] if given.job in (*WRITERS, *CHANGERS, *STREAMS) else [])
    if given.job not in (*STREAMS, *NEW_PLACE) and not given.store:
        needed = [*needed, "tables"]
    if given.job not in IN_PLACE:
        needed = [*needed, "out"]
    for name in needed:
        if getattr(given, name) is None:
            parser.error(f"{given.job} needs --{name}")
    return given


def main(arguments: list[str] | None = None) -> None:
    given = _arguments(arguments)
    spark = build_session(f"siteloom-{given.job}")
    if given.store:
        given.tables = snapshots.current(spark, given.store)
        if given.tables is None:
            raise ValueError(f"{given.store} has no current snapshot")
    if given.job in STREAMS:
        _stream(given.job, spark, given.rows, given.out, given.as_of, given.every).awaitTermination()
        return
    if given.job in IN_PLACE:
        _in_place(given.job, spark, given)
        return
    if given.job in NEW_PLACE:
        _new_place(given.job, spark, given)
        return
    everything = snapshots.read_tables(spark, given.tables)
    tables = dashboard.scoped(everything, given.site)
    brand = v.Brand(given.brand, given.brand)
    if given.job in VIEWS:
        for name, part in VIEWS[given.job](tables, given.as_of, brand).items():
            part.write.mode("errorifexists").parquet(f"{given.out}/{name}")
    elif given.job in WRITERS:
        rows = spark.read.parquet(given.rows)
        for name, part in _new_rows(given.job, everything, rows, given.as_of, given.now, given).items():
            part.write.mode("errorifexists").parquet(f"{given.out}/{name}")
    elif given.job in CHANGERS:
        changed = _changed(given.job, everything, spark.read.parquet(given.rows))
        snapshots.write_snapshot(changed, given.out, given.by_site, given.ranges, snapshots.manifest(spark, given.tables).batches)
    elif given.job == "csv":
        snapshots.export_csv(tables, given.out)
    elif given.job == "backup":
        batches = snapshots.manifest(spark, given.tables).batches
        snapshots.write_snapshot(tables, given.out, given.by_site, given.ranges, batches)
    else:
        kind = reports.daily_reports if given.job == "daily-reports" else reports.client_reports
        pages = kind(tables, given.as_of, brand).withColumn("report", s.slug(F.col("report")))
        snapshots.export_reports(pages, given.out, given.file_per_site)


if __name__ == "__main__":
    main()
