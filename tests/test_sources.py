"""Snapshots, exports and the scratch folder."""

import pytest
from pyspark.sql import functions as F

from siteloom.plans import reports
from siteloom.sources import scratch, snapshots
from tests.helpers import DAY, demo_tables, make_tables, same


def test_snapshot_round_trip(spark, tables, tmp_path):
    root = str(tmp_path / "snap")
    snapshots.write_snapshot(tables, root)
    back = snapshots.restore_snapshot(spark, root)
    for name, df in tables.items():
        assert back[name].dtypes == df.dtypes
        assert same(back[name], df)


def test_snapshot_by_site(spark, tables, tmp_path):
    root = str(tmp_path / "snap")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        snapshots.write_snapshot(tables, root, by_site=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = snapshots.restore_snapshot(spark, root)
    assert same(back.attivita, tables.attivita)
    spans = back.attivita.groupBy(F.input_file_name().alias("file")).agg(F.min("cantiere_id"), F.max("cantiere_id")).collect()
    ordered = sorted((low, high) for _, low, high in spans)
    assert len(ordered) > 4
    assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))


def test_restore_notices_lost_rows(spark, tmp_path):
    root = str(tmp_path / "snap")
    snapshots.write_snapshot(demo_tables(spark), root)
    spark.createDataFrame([], snapshots.SCHEMAS["ticket"]).write.mode("overwrite").parquet(f"{root}/ticket")
    with pytest.raises(ValueError, match="ticket"):
        snapshots.restore_snapshot(spark, root)


def test_snapshot_is_never_overwritten(spark, tmp_path):
    root = str(tmp_path / "snap")
    snapshots.write_snapshot(demo_tables(spark), root)
    with pytest.raises(Exception, match="already exists"):
        snapshots.write_snapshot(demo_tables(spark), root)


def test_load_if_empty(spark, tmp_path):
    root = str(tmp_path / "fresh")
    snapshots.purge(spark, root)
    assert snapshots.load_if_empty(spark, root, demo_tables(spark))
    assert not snapshots.load_if_empty(spark, root, demo_tables(spark))
    assert snapshots.read_tables(spark, root).attivita.count() == 5
    snapshots.append_rows(demo_tables(spark).ticket, root, "ticket")
    assert snapshots.read_table(spark, root, "ticket").count() == 2


def test_a_failed_load_is_done_again(spark, tmp_path):
    root = str(tmp_path / "fresh")
    snapshots.purge(spark, root)
    # a load that stopped after its first table
    demo_tables(spark).cantieri.write.mode("append").parquet(f"{root}/cantieri")
    with pytest.raises(ValueError, match="cantieri"):
        snapshots.restore_snapshot(spark, root)
    assert snapshots.load_if_empty(spark, root, demo_tables(spark))
    back = snapshots.restore_snapshot(spark, root)
    assert (back.cantieri.count(), back.attivita.count()) == (1, 5)


def test_restore_after_append(spark, tmp_path):
    root = str(tmp_path / "snap")
    snapshots.write_snapshot(demo_tables(spark), root)
    snapshots.append_rows(demo_tables(spark).ticket, root, "ticket")
    assert snapshots.restore_snapshot(spark, root).ticket.count() == 2


def test_csv_keeps_hard_texts(spark, tmp_path):
    texts = ['say "hi", now', "two\nlines", "à ü €", "back\\slash", " padded ", None]
    t = make_tables(spark, ticket=[{"id": i, "titolo": x, "tipo": "Blocco"} for i, x in enumerate(texts)])
    root = str(tmp_path / "csv")
    snapshots.export_csv(t, root)
    back = snapshots.read_csv(spark, root, "ticket")
    assert {r.id: r.titolo for r in back.collect()} == dict(enumerate(texts))
    head = spark.read.text(f"{root}/ticket.csv").first()[0]
    assert head.startswith("id,cantiere_id,tipo,titolo,")


@pytest.mark.parametrize("file_per_site", [False, True])
def test_report_files(spark, tmp_path, file_per_site):
    pages = reports.daily_reports(demo_tables(spark), DAY)
    pages = pages.withColumn("report", F.translate(F.lower("report"), " /", "__"))
    root = str(tmp_path / "reports")
    snapshots.export_reports(pages, root, file_per_site)
    back = snapshots.read_reports(spark, root, file_per_site)
    assert sorted(back.collect()) == sorted(pages.collect())


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = scratch.new_folder(spark, "x")
    assert folder != scratch.new_folder(spark, "x")
    if named:
        assert folder.startswith(named.rstrip("/") + "/")


def broken_publish(monkeypatch):
    """Stop every job right before its manifest."""

    def fail(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(snapshots.states, "publish", fail)


def test_an_append_that_was_killed_is_done_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "snap")
    demo = demo_tables(spark)
    snapshots.write_snapshot(demo, root)
    with monkeypatch.context() as m:
        broken_publish(m)
        with pytest.raises(RuntimeError):
            snapshots.append_rows(demo.ticket, root, "ticket", "b1")
    # nobody sees the rows of the failed try
    assert snapshots.restore_snapshot(spark, root).ticket.count() == 1
    assert [snapshots.append_rows(demo.ticket, root, "ticket", "b1") for _ in range(3)] == [True, False, False]
    assert snapshots.restore_snapshot(spark, root).ticket.count() == 2
    assert snapshots.append_rows(demo.ticket, root, "ticket")
    assert snapshots.restore_snapshot(spark, root).ticket.count() == 3


def test_a_batch_of_several_tables_is_added_at_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "snap")
    demo = demo_tables(spark)
    snapshots.write_snapshot(demo, root)
    write = snapshots._write
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_write", lambda rows, path, *rest: (_ for _ in ()).throw(RuntimeError("killed")) if path.endswith("ticket") else write(rows, path, *rest))
        with pytest.raises(RuntimeError):
            snapshots.append_batch(spark, root, {"attivita": demo.attivita, "ticket": demo.ticket}, "b1")
    back = snapshots.restore_snapshot(spark, root)
    assert (back.attivita.count(), back.ticket.count()) == (5, 1)
    assert snapshots.append_batch(spark, root, {"attivita": demo.attivita, "ticket": demo.ticket}, "b1")
    back = snapshots.restore_snapshot(spark, root)
    assert (back.attivita.count(), back.ticket.count()) == (10, 2)


def test_load_into_a_new_place(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "nowhere" / "yet")
    demo = demo_tables(spark)
    with monkeypatch.context() as m:
        broken_publish(m)
        with pytest.raises(RuntimeError):
            snapshots.load_if_empty(spark, root, demo)
    assert snapshots.load_if_empty(spark, root, demo)
    assert not snapshots.load_if_empty(spark, root, demo)
    assert same(snapshots.restore_snapshot(spark, root).attivita, demo.attivita)


def test_appending_needs_a_manifest(spark, tmp_path):
    with pytest.raises(ValueError, match="no manifest"):
        snapshots.append_rows(demo_tables(spark).ticket, str(tmp_path / "x"), "ticket")


def test_changes_replace_only_their_ranges(spark, tables, tmp_path, monkeypatch):
    root = str(tmp_path / "snap")
    snapshots.write_snapshot(tables, root, ranges=8, batches=("older",))
    before = snapshots.manifest(spark, root)
    assert len(before.of("attivita")) == 8 and before.batches == ("older",)
    assert same(snapshots.restore_snapshot(spark, root).attivita, tables.attivita)
    low = min(f.low for f in before.of("attivita"))
    ids = spark.createDataFrame([(low,), (low + 1,), (10**12,), (-5,), (None,)], "id bigint")
    note = F.when(F.col("id") == low, F.lit("changed")).otherwise(F.col("note"))
    with monkeypatch.context() as m:
        broken_publish(m)
        with pytest.raises(RuntimeError):
            snapshots.replace_ranges(spark, root, "attivita", ids, lambda rows: rows.withColumn("note", note), "b")
    assert same(snapshots.restore_snapshot(spark, root).attivita, tables.attivita)
    gone = snapshots.replace_ranges(spark, root, "attivita", ids, lambda rows: rows.withColumn("note", note), "b")
    after = snapshots.manifest(spark, root)
    assert len(gone) == 1 and after.batches == ("older", "b")
    assert {f.place for f in before.folders} - {f.place for f in after.folders} == set(gone)
    assert same(snapshots.restore_snapshot(spark, root).attivita, tables.attivita.withColumn("note", note))
    assert snapshots.replace_ranges(spark, root, "attivita", ids, lambda rows: rows, "b") == []
    assert snapshots.replace_ranges(spark, root, "attivita", ids.where("id is null"), lambda rows: rows, "c") == []


def test_lookup_reads_little(spark, tables, tmp_path):
    """Ids are found in the folders of their ranges, by filters in the files; nothing else is read."""
    root = str(tmp_path / "snap")
    snapshots.write_snapshot(tables, root, ranges=8)
    wanted = [r.id for r in tables.ticket.select("id").orderBy("id").limit(20).collect()]
    found = snapshots.lookup(spark, root, "ticket", [*wanted, -1, 10**15])
    assert same(found, tables.ticket.where(F.col("id").isin(wanted)))
    assert len(found.inputFiles()) < len(snapshots.read_table(spark, root, "ticket").inputFiles()) / 4
    import pyarrow.parquet as pq

    chunk = pq.ParquetFile(found.inputFiles()[0].removeprefix("file://")).metadata.row_group(0)
    columns = {chunk.column(i).path_in_schema: chunk.column(i) for i in range(chunk.num_columns)}
    assert "id" in columns
    assert snapshots.lookup(spark, root, "ticket", []).count() == 0


def test_store_of_snapshots(spark, tmp_path):
    store = str(tmp_path / "store")
    assert snapshots.current(spark, store) is None
    demo = demo_tables(spark)
    snapshots.write_snapshot(demo, f"{store}/one")
    snapshots.make_current(spark, store, "one")
    snapshots.purge(spark, f"{store}/two")
    snapshots.make_current(spark, store, "two")
    assert snapshots.current(spark, store) == f"{store}/two"
    snapshots.make_current(spark, store, "one")
    assert snapshots.read_tables(spark, snapshots.current(spark, store)).attivita.count() == 5
    spark.createDataFrame([], snapshots.SCHEMAS["ticket"]).write.mode("overwrite").parquet(f"{store}/one/ticket")
    with pytest.raises(ValueError, match="ticket"):
        snapshots.make_current(spark, store, "one")
