"""The batch jobs, from a snapshot to written results."""

import datetime as dt

import pytest

from siteloom.__main__ import VIEWS, main
from siteloom.sources import snapshots
from tests.helpers import DAY, demo_tables


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("jobs") / "tables")
    snapshots.write_snapshot(demo_tables(spark), root)
    return root


@pytest.mark.parametrize("job", list(VIEWS))
def test_views(spark, snapshot, tmp_path, job):
    out = str(tmp_path / "out")
    main([job, "--tables", snapshot, "--out", out, "--as-of", str(DAY), "--site", "1"])
    parts = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert parts
    assert all(spark.read.parquet(f"{out}/{part}").count() >= 0 for part in parts)


def test_reports_and_copies(spark, snapshot, tmp_path):
    base = ["--tables", snapshot, "--as-of", str(DAY)]
    main(["client-reports", *base, "--out", str(tmp_path / "a"), "--brand", "Acme"])
    assert snapshots.read_reports(spark, str(tmp_path / "a")).count() == 4
    main(["daily-reports", *base, "--out", str(tmp_path / "b"), "--file-per-site"])
    assert snapshots.read_reports(spark, str(tmp_path / "b"), file_per_site=True).count() == 2
    main(["csv", *base, "--out", str(tmp_path / "c")])
    assert snapshots.read_csv(spark, str(tmp_path / "c"), "attivita").count() == 5
    main(["backup", *base, "--out", str(tmp_path / "d")])
    assert snapshots.restore_snapshot(spark, str(tmp_path / "d")).ticket.count() == 1


T0 = dt.datetime(2024, 1, 2, 8)
LOGS = {
    "task-changes": ("attivita", [(1, T0, 1, "Bloccata", "Alta", 10, "n")], "id bigint, ts timestamp_ntz, seq bigint, stato string, priorita string, percentuale bigint, note string"),
    "quick-changes": ("attivita", [(1, T0, 1, "Bloccata", "Alta", 10, "n")], "id bigint, ts timestamp_ntz, seq bigint, stato string, priorita string, percentuale bigint, nota string"),
    "ticket-changes": ("ticket", [(1, T0, 1, "Chiuso", "Alta", "r", "i")], "id bigint, ts timestamp_ntz, seq bigint, stato string, priorita string, responsabile string, impatto string"),
    "replies": ("notifiche", [(1, T0, 1, "Chiusa", "ok", "Chiuso")], "id bigint, ts timestamp_ntz, seq bigint, stato string, risposta string, stato_ticket string"),
    "budgets": ("budget_cantiere", [(1, 5.0, 1.0, 0.0, "b", T0)], "cantiere_id bigint, budget_iniziale double, costo_effettivo double, extra_approvati double, note_budget string, updated_at timestamp_ntz"),
}


@pytest.mark.parametrize("job", list(LOGS))
def test_change_jobs_write_a_whole_snapshot(spark, snapshot, tmp_path, job):
    table, log, schema = LOGS[job]
    rows, out = str(tmp_path / "rows"), str(tmp_path / "out")
    spark.createDataFrame(log, schema).write.parquet(rows)
    # a site changes nothing: snapshots always hold all sites
    main([job, "--tables", snapshot, "--out", out, "--rows", rows, "--site", "99"])
    old, new = snapshots.read_tables(spark, snapshot), snapshots.restore_snapshot(spark, out)
    assert [df.count() for _, df in new.items()] == [df.count() for _, df in old.items()]
    if job == "budgets":
        assert new[table].where("cantiere_id = 1").first().budget_iniziale == 5.0
    elif old[table].where("id = 1").count():
        assert new[table].where("id = 1").first().stato == log[0][3]


def test_rows_of_one_site_get_free_ids(spark, snapshot, tmp_path):
    rows, out = str(tmp_path / "rows"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, "new")], "richiesta bigint, cantiere_id bigint, titolo string").write.parquet(rows)
    main(["tickets", "--tables", snapshot, "--out", out, "--rows", rows, "--as-of", str(DAY), "--site", "99"])
    highest = max(r.id for r in snapshots.read_table(spark, snapshot, "ticket").collect())
    assert spark.read.parquet(f"{out}/ticket").first().id == highest + 1


def test_stream_jobs(spark, tmp_path):
    rows, out = str(tmp_path / "rows"), str(tmp_path / "out")
    log = spark.createDataFrame([(1, 1, "Bob", "porta rotta", T0)], "id bigint, cantiere_id bigint, autore string, testo string, created_at timestamp_ntz")
    log.write.parquet(rows)
    main(["message-stream", "--out", out, "--rows", rows, "--as-of", str(DAY)])
    main(["message-stream", "--out", out, "--rows", rows, "--as-of", str(DAY)])  # nothing new
    assert spark.read.parquet(f"{out}/ticket").count() == 1
    table, changes, schema = LOGS["ticket-changes"]
    spark.createDataFrame(changes, schema).write.parquet(str(tmp_path / "log"))
    main(["change-stream", "--out", str(tmp_path / "o2"), "--rows", str(tmp_path / "log")])
    assert spark.read.parquet(str(tmp_path / "o2" / "log")).count() == 1


def test_rows_are_appended_once(spark, snapshot, tmp_path):
    root, rows, made = (str(tmp_path / p) for p in ("tables", "rows", "made"))
    main(["restore", "--tables", snapshot, "--out", root, "--ranges", "2"])
    spark.createDataFrame([(1, 1, "porta rotta, lavori fermi", "Bob")], "id bigint, cantiere_id bigint, testo string, autore string").write.parquet(rows)
    main(["triage", "--tables", root, "--out", made, "--messages", rows, "--as-of", str(DAY)])
    for _ in range(2):
        main(["append", "--tables", root, "--rows", made, "--batch", "triage-1"])
    back = snapshots.restore_snapshot(spark, root)
    assert (back.ticket.count(), back.aggiornamenti.count()) == (2, 1)


def test_streams_are_merged_by_jobs(spark, snapshot, tmp_path):
    root, rows, out = (str(tmp_path / p) for p in ("tables", "rows", "out"))
    main(["restore", "--tables", snapshot, "--out", root])
    log = spark.createDataFrame([(1, 1, "Bob", "porta rotta", T0)], "id bigint, cantiere_id bigint, autore string, testo string, created_at timestamp_ntz")
    log.write.parquet(rows)
    main(["message-stream", "--out", out, "--rows", rows, "--as-of", str(DAY)])
    for _ in range(2):
        main(["merge-messages", "--tables", root, "--rows", out, "--now", T0.isoformat()])
    assert snapshots.restore_snapshot(spark, root).ticket.count() == 2
    _, changes, schema = LOGS["ticket-changes"]
    spark.createDataFrame(changes, schema).write.parquet(str(tmp_path / "log"))
    main(["change-stream", "--out", str(tmp_path / "o2"), "--rows", str(tmp_path / "log")])
    for _ in range(2):
        main(["merge-changes", "--tables", root, "--rows", str(tmp_path / "o2" / "log"), "--table", "ticket", "--batch", "log-1"])
    assert snapshots.restore_snapshot(spark, root).ticket.where("id = 1").first().stato == "Chiuso"
    notices = spark.createDataFrame([(1, 1, 1, T0), (2, 1, 1, T0 + dt.timedelta(hours=1))], "id bigint, cantiere_id bigint, ticket_id bigint, created_at timestamp_ntz")
    notices.to(snapshots.SCHEMAS["notifiche"]).write.parquet(str(tmp_path / "sent"))
    main(["notice-stream", "--out", str(tmp_path / "o3"), "--rows", str(tmp_path / "sent")])
    main(["compact-notices", "--out", str(tmp_path / "compacted"), "--rows", str(tmp_path / "o3" / "ultime")])
    assert spark.read.parquet(str(tmp_path / "compacted")).first().notifiche == 2


def test_registered_notices(spark, snapshot, tmp_path):
    rows, out = str(tmp_path / "rows"), str(tmp_path / "out")
    spark.createDataFrame([(1, "Anna", None)], "ticket_id bigint, destinatario string, canale string").write.parquet(rows)
    main(["register-notices", "--tables", snapshot, "--out", out, "--rows", rows, "--channel", "Email", "--now", T0.isoformat()])
    row = spark.read.parquet(f"{out}/notifiche").first()
    assert (row.id, row.ticket_id, row.destinatario, row.canale, row.created_at) == (1, 1, "Anna", "Email", T0)


def test_a_store(spark, snapshot, tmp_path):
    store = str(tmp_path / "store")
    main(["load", "--tables", snapshot, "--out", f"{store}/a"])
    main(["load", "--tables", snapshot, "--out", f"{store}/a"])  # holds sites already
    main(["purge", "--out", f"{store}/b"])
    for name, sites in (("b", 0), ("a", 1)):
        main(["use", "--tables", store, "--name", name])
        main(["backup", "--store", store, "--out", str(tmp_path / name)])
        assert snapshots.restore_snapshot(spark, str(tmp_path / name)).cantieri.count() == sites
