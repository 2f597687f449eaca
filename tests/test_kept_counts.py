"""Kept counts and stored registers against the full count and the full order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siteloom.operators import changes, counts, kept_counts, lists, pages, risk
from siteloom.sources.scratch import written
from tests.helpers import make_tables, same

DAY = dt.date(2024, 1, 20)
T0 = dt.datetime(2024, 1, 15, 8)


def test_counts_after_ten_change_sets(spark):
    draw = random.Random(5)
    states, ticket_states = ["Da fare", "In corso", "Bloccata", "Completata", "Verificata", None], ["Aperto", "Chiuso", "Bloccante", "Risolto", None]
    due = [None, "n/d", *[f"2024-01-{d:02}" for d in range(10, 28)]]
    tables = make_tables(
        spark,
        cantieri=[{"id": i, "nome": f"s{i}"} for i in range(1, 9)],
        attivita=[{"id": i, "cantiere_id": draw.choice([1, 1, 1, 2, 3, 4, None, 99]), "titolo": "t", "stato": draw.choice(states), "percentuale": draw.randint(-5, 120), "scadenza": draw.choice(due)} for i in range(1, 80)],
        ticket=[{"id": i, "cantiere_id": draw.choice([1, 2, 2, 5, None]), "tipo": draw.choice(["Blocco", "Difetto"]), "titolo": "t", "stato": draw.choice(ticket_states), "priorita": draw.choice(["Alta", "Critica", None])} for i in range(1, 60)],
    )
    sites, tasks, tickets = tables.cantieri, tables.attivita, tables.ticket
    kept = kept_counts.KeptCounts.of(tasks, tickets)
    for turn in range(10):
        at = T0 + dt.timedelta(hours=turn)
        log = [(draw.randrange(1, 90), at, k, draw.choice(states), "Alta", draw.randint(0, 100), "n") for k in range(12)]
        task_log = spark.createDataFrame(log, "id bigint, ts timestamp_ntz, seq bigint, stato string, priorita string, percentuale bigint, note string")
        log = [(draw.randrange(1, 70), at, k, draw.choice(ticket_states), draw.choice(["Alta", "Critica"]), "r", "i") for k in range(9)]
        ticket_log = spark.createDataFrame(log, "id bigint, ts timestamp_ntz, seq bigint, stato string, priorita string, responsabile string, impatto string")
        kept = kept.after_tasks(*kept_counts.changed_rows(tasks, task_log, changes.apply_task_changes))
        kept = kept.after_tickets(*kept_counts.changed_rows(tickets, ticket_log, changes.apply_ticket_changes))
        kept = kept_counts.KeptCounts(*(written(part, "kept") for part in (kept.tasks, kept.due, kept.tickets)))
        tasks = written(changes.apply_task_changes(tasks, task_log), "tasks")
        tickets = written(changes.apply_ticket_changes(tickets, ticket_log), "tickets")
        day = DAY + dt.timedelta(days=turn - 5)
        assert same(kept.kpis(sites, day), counts.kpis(sites, tasks, tickets, day))
        assert same(kept.progress(sites), counts.site_progress(sites, tasks))
        assert same(kept.risk(sites, day), risk.risk_board(sites, tasks, tickets, day))
    # new rows have no rows before; a site that loses all of its rows leaves the counts
    gone = tasks.where("cantiere_id = 1")
    left = kept.after_tasks(gone, gone.limit(0))
    assert same(left.tasks, counts.task_counts(tasks.where("not cantiere_id <=> 1")).drop("scadute"))
    assert same(left.after_tasks(gone.limit(0), gone).tasks, kept.tasks)


@pytest.mark.parametrize("ranges", [1, 5])
def test_pages_of_a_register(spark, tables, tmp_path, ranges):
    rows = tables.ticket.select("id", "cantiere_id", "priorita", "scadenza", "titolo")
    order = lists.by_priority_rank()
    register = pages.store_register(rows, order, str(tmp_path / "r"), ranges)
    whole = [r.id for r in rows.orderBy(*order).collect()]
    assert register.rows == len(whole)
    for number, size in ((1, 10), (3, 7), (len(whole) // 20 + 1, 20), (len(whole) // 50, 50), (10**6, 10), (1, 10**6)):
        page = register.page(spark, number, size)
        assert [r.id for r in page.collect()] == whole[(number - 1) * size : number * size]
        assert page.columns == rows.columns
    if ranges > 1:
        far = register.page(spark, len(whole) // 10, 10)
        read = {r[0] for r in spark.read.parquet(register.path).select(pages.RANGE).distinct().collect()}
        assert len(read) == ranges
        assert "PartitionFilters: [" in far._jdf.queryExecution().executedPlan().toString() and len(far.inputFiles()) >= 1
    empty = pages.store_register(rows.limit(0), order, str(tmp_path / "e"), ranges)
    assert empty.rows == 0 and empty.page(spark, 1, 5).count() == 0


def test_orders_of_registers(spark, tables):
    """Registers come in the order they promise, nulls first where it ascends."""
    from siteloom.plans import registers

    ids = [r.id for r in registers.site_register(tables).collect()]
    wanted = sorted(tables.cantieri.select("id", "created_at").collect(), key=lambda r: (r.created_at is None, -(r.created_at.timestamp() if r.created_at else 0), r.id))
    assert ids == [r.id for r in wanted]
    rows = registers.task_register(tables).collect()
    assert [(r.cantiere_id, r.id) for r in rows] == [(r.cantiere_id, r.id) for r in sorted(rows, key=lambda r: (r.cantiere_id is not None, r.cantiere_id or 0, r.scadenza is not None, r.scadenza or "", r.id))]
    rank = {"Critica": 1, "Alta": 2, "Media": 3}
    rows = registers.ticket_register(tables).collect()
    assert [r.id for r in rows] == [r.id for r in sorted(rows, key=lambda r: (r.cantiere_id is not None, r.cantiere_id or 0, rank.get(r.priorita, 4), r.scadenza is not None, r.scadenza or "", r.id))]
    labels = [(r.cantiere_id, -r.id) for r in registers.task_labels(tables).collect()]
    assert labels == sorted(labels, key=lambda x: (x[0] is not None, x))
    assert same(registers.task_labels(tables), registers.task_labels(tables, ordered=False))
    assert "Sort" not in registers.site_labels(tables, ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert tables.attivita.where(F.col("id").isNull()).count() == 0
