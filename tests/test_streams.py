"""A stream gives the rows of its batch twin, also after a restart or a repeated delivery."""

import datetime as dt

from pyspark.sql import functions as F

from checks.change_sets import change_set
from siteloom.functions.triage import triage
from siteloom.operators import changes, lookups
from siteloom.schema import MESSAGE_SCHEMA
from siteloom.streaming import feeds
from tests.helpers import same

DAY = dt.date(2024, 1, 15)


def test_messages_in_two_runs_with_repeats(spark, source, tmp_path):
    messages = source.messages()
    inbox = str(tmp_path / "in")
    paths = [str(tmp_path / p) for p in ("ticket", "updates", "cp")]

    def run():
        stream = feeds.file_stream(spark, inbox, MESSAGE_SCHEMA, files_per_batch=1)
        feeds.messages_to_tickets(stream, *paths, DAY).awaitTermination()

    half = messages.where("id % 2 = 0")
    half.unionByName(half).repartition(3).write.mode("append").parquet(inbox)
    run()
    messages.repartition(3).write.mode("append").parquet(inbox)  # the first half comes again
    run()
    run()  # nothing new
    tickets = feeds.once_per_message(feeds.read_epochs(spark, paths[0]))
    updates = feeds.once_per_message(feeds.read_epochs(spark, paths[1]))
    sorted_out = triage(messages)
    assert same(changes.ticket_batch(sorted_out, DAY), tickets)
    assert same(changes.update_batch(sorted_out), updates)
    tables = source.tables()
    made = feeds.rows_to_append(spark, *paths[:2], tables, dt.datetime(2024, 1, 15))
    first = {name: tables[name].agg(F.max("id")).first()[0] + 1 for name in made}
    for name, rows in made.items():
        ids = sorted(r.id for r in rows.select("id").collect())
        assert rows.columns == tables[name].columns
        assert ids == list(range(first[name], first[name] + messages.count()))
    oldest = messages.orderBy("id").first()
    row = made["aggiornamenti"].where(F.col("id") == first["aggiornamenti"]).first()
    assert (row.testo, row.created_at) == (oldest.testo, dt.datetime(2024, 1, 15))


def test_notice_counts_in_two_runs(spark, source, tmp_path):
    notices = source.table("notifiche").select("id", "cantiere_id", "ticket_id", "created_at")
    inbox, out, cp = (str(tmp_path / p) for p in ("in", "out", "cp"))
    for part in (0, 1):
        notices.where(F.col("id") % 2 == part).repartition(2).write.mode("append").parquet(inbox)
        stream = feeds.file_stream(spark, inbox, notices.schema, files_per_batch=1)
        feeds.running_latest_notices(stream, out, cp).awaitTermination()
    assert same(lookups.latest_notices(notices), feeds.current_latest_notices(spark, out))
    compacted = str(tmp_path / "compacted")
    feeds.compact_latest_notices(spark, out, compacted)
    assert same(spark.read.parquet(compacted), lookups.latest_notices(notices))
    assert same(feeds.current_latest_notices(spark, compacted, out), lookups.latest_notices(notices))


def test_change_log(spark, source, tmp_path):
    tickets = source.table("ticket")
    log = change_set("ticket_changes", tickets)
    inbox, out, cp = (str(tmp_path / p) for p in ("in", "out", "cp"))
    log.repartition(5).write.parquet(inbox)
    stream = feeds.file_stream(spark, inbox, log.schema, files_per_batch=2)
    feeds.changes_to_log(stream, out, cp).awaitTermination()
    written = feeds.read_epochs(spark, out).drop(feeds.EPOCH)
    assert same(changes.apply_ticket_changes(tickets, log), changes.apply_ticket_changes(tickets, written))
    once = feeds.with_log(source.tables(), "ticket", written)
    assert same(once.ticket, changes.apply_ticket_changes(tickets, log))
    assert same(feeds.with_log(once, "ticket", written).ticket, once.ticket)
    newest = {r.id: r.seq for r in feeds.latest_states(written).collect()}
    assert newest == {r.id: r.top for r in log.groupBy("id").agg(F.max("seq").alias("top")).collect()}


def test_merging_twice_adds_nothing(spark, source, tmp_path, monkeypatch):
    """Stream, merge, stream more (with repeats), merge: each message is one ticket and one update, whatever fails between."""
    from siteloom.sources import snapshots

    messages, root, inbox = source.messages(), str(tmp_path / "snap"), str(tmp_path / "in")
    sinks, cp = [str(tmp_path / p) for p in ("ticket", "updates")], str(tmp_path / "cp")
    tables, now = source.tables(), dt.datetime(2024, 1, 15)
    snapshots.write_snapshot(tables, root)
    counts = {n: tables[n].count() for n in ("ticket", "aggiornamenti")}
    taken = 0
    for part in ("id % 3 = 0", "id % 3 < 2"):
        messages.where(part).repartition(2).write.mode("append").parquet(inbox)
        feeds.messages_to_tickets(feeds.file_stream(spark, inbox, MESSAGE_SCHEMA, files_per_batch=1), *sinks, cp, DAY).awaitTermination()
        with monkeypatch.context() as m:
            m.setattr(snapshots.states, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
            try:
                feeds.merge_messages(spark, root, *sinks, now)
                raise AssertionError("not killed")
            except RuntimeError:
                pass
        assert [feeds.merge_messages(spark, root, *sinks, now) for _ in range(2)] == [True, False]
        taken = messages.where(part).count()
        back = snapshots.restore_snapshot(spark, root)
        for name, n in counts.items():
            assert back[name].count() == n + taken
            assert back[name].select("id").distinct().count() == n + taken
    # the batches stay known after a whole new snapshot, and after changes replaced their rows
    copy = str(tmp_path / "copy")
    snapshots.write_snapshot(back, copy, ranges=4, batches=snapshots.manifest(spark, root).batches)
    log = change_set("ticket_changes", back.ticket)
    assert feeds.merge_changes(spark, copy, "ticket", log, "log-1")
    assert not feeds.merge_messages(spark, copy, *sinks, now)


def test_a_small_log_leaves_other_ranges(spark, source, tmp_path):
    from siteloom.sources import snapshots

    tables, root = source.tables(), str(tmp_path / "snap")
    snapshots.write_snapshot(tables, root, ranges=6)
    names = {f.place for f in snapshots.manifest(spark, root).folders}
    log = change_set("ticket_changes", tables.ticket)
    few = log.where(F.col("id") <= tables.ticket.agg(F.min("id")).first()[0] + 50)
    gone = feeds.merge_changes(spark, root, "ticket", few, "log-1")
    assert 0 < len(gone) < 3 and names - {f.place for f in snapshots.manifest(spark, root).folders} == set(gone)
    assert feeds.merge_changes(spark, root, "ticket", few, "log-1") == []
    back = snapshots.restore_snapshot(spark, root)
    assert same(back.ticket, changes.apply_ticket_changes(tables.ticket, few))
    assert same(back.attivita, tables.attivita)


def test_notice_counts_go_on_from_compacted_ones(spark, source, tmp_path):
    """A new stream that begins with compacted counts gives the rows of the batch twin; closed tickets leave its state."""
    notices = source.table("notifiche").select("id", "cantiere_id", "ticket_id", "created_at")
    old, new = notices.where("id % 2 = 0"), notices.where("id % 2 = 1")
    inbox, out, cp, ended, compacted = (str(tmp_path / p) for p in ("in", "out", "cp", "ended", "compacted"))
    lookups.latest_notices(old).write.parquet(compacted)
    new.where("id % 4 = 1").repartition(2).write.parquet(inbox)
    spark.createDataFrame([], "cantiere_id long, ticket_id long").write.parquet(ended)

    def run():
        closings = feeds.file_stream(spark, ended, spark.read.parquet(ended).schema)
        stream = feeds.file_stream(spark, inbox, notices.schema, files_per_batch=1)
        feeds.running_latest_notices(stream, out, cp, start=spark.read.parquet(compacted), closings=closings).awaitTermination()

    run()
    so_far = notices.where("id % 2 = 0 or id % 4 = 1")
    assert same(feeds.current_latest_notices(spark, compacted, out), lookups.latest_notices(so_far))
    new.where("id % 4 = 3").repartition(2).write.mode("append").parquet(inbox)
    run()
    assert same(feeds.current_latest_notices(spark, compacted, out), lookups.latest_notices(notices))
    held = spark.read.format("statestore").option("stateVarName", "kept").load(cp).count()
    tickets = lookups.latest_notices(notices).select("cantiere_id", "ticket_id")
    assert held == tickets.count()
    tickets.limit(7).write.mode("append").parquet(ended)
    run()
    assert spark.read.format("statestore").option("stateVarName", "kept").load(cp).count() == held - 7
    assert same(feeds.current_latest_notices(spark, compacted, out), lookups.latest_notices(notices))
