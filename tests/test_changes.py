"""Change sets: folding, stamps, numbering and idempotence."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from checks.change_sets import change_set
from siteloom.operators import changes
from siteloom.operators.notices import registered_notices, retyped_notices
from siteloom.operators.numbering import dense_ids, next_id
from siteloom.schema import with_defaults
from tests.helpers import make_tables, same

T0 = dt.datetime(2024, 1, 1, 8)
CLOSED = {"Risolto", "Chiuso"}
CHANGE = "id bigint, ts timestamp_ntz, seq bigint, stato string, priorita string, responsabile string, impatto string"


def play(rows, log):
    """One update after the other, as separate statements would do it."""
    state = {r["id"]: dict(r) for r in rows}
    for id_, ts, _, stato, prio, owner, impact in sorted(log, key=lambda c: (c[1], c[2])):
        row = state.get(id_)
        if row is None:
            continue
        row.update(stato=stato, priorita=prio, responsabile=owner, impatto=impact)
        row["closed_at"] = (row["closed_at"] or ts) if stato in CLOSED else None
    return state


@pytest.fixture
def random_case(spark):
    rng = random.Random(7)
    rows = [
        {"id": i, "cantiere_id": 1, "stato": rng.choice(["Aperto", "Chiuso", None]), "closed_at": rng.choice([None, T0])}
        for i in range(40)
    ]
    states = ["Aperto", "Chiuso", "Risolto", "In gestione", None]
    log = []
    for seq in range(300):
        # one id takes a third of all changes; some ids do not exist
        id_ = 3 if rng.random() < 0.34 else rng.randrange(48)
        moment = T0 + dt.timedelta(hours=1 + rng.randrange(20))
        log.append((id_, moment, seq, rng.choice(states), f"p{seq}", f"r{seq}", None))
    tables = make_tables(spark, ticket=[{**r, "titolo": "t", "tipo": "Blocco"} for r in rows])
    return tables.ticket, spark.createDataFrame(log, CHANGE), play(rows, log)


def rows_of(df):
    return {r.id: (r.stato, r.priorita, r.responsabile, r.closed_at) for r in df.collect()}


def test_changes_equal_one_by_one_updates(random_case):
    tickets, log, expected = random_case
    got = rows_of(changes.apply_ticket_changes(tickets, log))
    assert got == {
        i: (r["stato"], r.get("priorita"), r.get("responsabile"), r["closed_at"]) for i, r in expected.items()
    }


def test_changes_are_idempotent(random_case):
    tickets, log, _ = random_case
    once = changes.apply_ticket_changes(tickets, log)
    assert rows_of(changes.apply_ticket_changes(once, log)) == rows_of(once)


def test_repeated_and_conflicting_changes(spark):
    """A change that comes again is one; of different changes under one time and sequence one wins whole; nulls are earliest."""
    t = make_tables(spark, ticket=[{"id": i, "stato": "Aperto"} for i in range(1, 6)])
    later = T0 + dt.timedelta(seconds=1)
    log = [(1, T0, 1, "Chiuso", "a", "x", None)] * 4
    log += [(2, T0, 1, "Chiuso", "a", "x", None), (2, T0, 1, "Aperto", "b", "y", None)]
    log += [(3, None, 9, "Chiuso", "a", "x", None), (3, T0, None, "Risolto", "b", "y", None), (3, T0, -5, "In gestione", "c", None, None)]
    log += [(4, T0, (1 << 63) - 1, "Chiuso", "a", "x", None), (4, later, -(1 << 63), "Risolto", "b", None, None)]
    rows = rows_of(changes.apply_ticket_changes(t.ticket, spark.createDataFrame(log, CHANGE)))
    assert len(rows) == 5
    assert rows[1] == ("Chiuso", "a", "x", T0) and rows[5] == ("Aperto", None, None, None)
    assert rows[2][:3] in {("Chiuso", "a", "x"), ("Aperto", "b", "y")}
    assert rows[3] == ("In gestione", "c", None, None)
    assert rows[4] == ("Risolto", "b", None, T0)
    newest = changes.last_change(spark.createDataFrame(log, CHANGE), "id", ["ts", "seq"])
    assert {r.id: r.priorita for r in newest.where("id <> 2").collect()} == {1: "a", 3: "c", 4: "b"}
    assert newest.count() == 4 and set(newest.columns) == set(CHANGE.replace(",", "").split()[::2])


def test_task_changes_are_idempotent(tables):
    log = change_set("task_changes", tables.attivita)
    once = changes.apply_task_changes(tables.attivita, log)
    assert same(once, changes.apply_task_changes(once, log))
    assert once.count() == tables.attivita.count()


def test_reply_keeps_last_stamp(spark):
    t = make_tables(spark, notifiche=[{"id": 1, "stato": "Preparata"}, {"id": 2, "stato": "Preparata", "responded_at": T0}])
    log = [
        (1, T0, 1, "Risposta ricevuta", "ok", None),
        (1, T0 + dt.timedelta(hours=1), 2, "Chiusa", " ", None),
        (2, T0 + dt.timedelta(hours=1), 3, "Chiusa", "", "Non modificare"),
    ]
    replies = spark.createDataFrame(log, "id bigint, ts timestamp_ntz, seq bigint, stato string, risposta string, stato_ticket string")
    rows = {r.id: (r.stato, r.risposta, r.responded_at) for r in changes.apply_replies(t.notifiche, replies).collect()}
    assert rows == {1: ("Chiusa", " ", T0), 2: ("Chiusa", "", T0)}


def test_cascade_skips_unlinked_and_unasked(spark):
    t = make_tables(
        spark,
        ticket=[{"id": 10, "stato": "Aperto"}, {"id": 11, "stato": "Chiuso", "closed_at": T0}, {"id": 12, "stato": "Aperto"}],
        notifiche=[{"id": 1, "ticket_id": 10}, {"id": 2, "ticket_id": 11}, {"id": 3, "ticket_id": 12}, {"id": 4}],
    )
    log = [(i, T0 + dt.timedelta(days=1), i, "Chiusa", "x", s) for i, s in ((1, "Chiuso"), (2, "Aperto"), (3, "Non modificare"), (4, "Chiuso"))]
    replies = spark.createDataFrame(log, "id bigint, ts timestamp_ntz, seq bigint, stato string, risposta string, stato_ticket string")
    rows = {r.id: (r.stato, r.closed_at) for r in changes.apply_cascade(t.ticket, t.notifiche, replies).collect()}
    assert rows == {10: ("Chiuso", T0 + dt.timedelta(days=1)), 11: ("Aperto", None), 12: ("Aperto", None)}


def test_quick_updates_in_order(spark):
    t = make_tables(spark, attivita=[{"id": 1, "note": "a"}, {"id": 2, "note": None}, {"id": 3, "note": None}])
    schema = "id bigint, ts timestamp_ntz, seq bigint, stato string, priorita string, percentuale bigint, nota string"
    later = T0 + dt.timedelta(hours=1)
    log = [
        (1, later, 3, "Completata", "Alta", 10, " d "),
        (1, T0, 1, "In corso", "Bassa", 20, "b"),
        (1, later, 2, "Verificata", "Bassa", 5, "c"),
        (2, T0, 1, "In corso", "Alta", 30, "  "),
    ]
    rows = {r.id: r for r in changes.apply_quick_task_updates(t.attivita, spark.createDataFrame(log, schema)).collect()}
    assert rows[1].note == "a\n[01/01 08:00] b\n[01/01 09:00] c\n[01/01 09:00] d"
    assert (rows[1].stato, rows[1].priorita, rows[1].percentuale, rows[1].closed_at) == ("Completata", "Alta", 100, later)
    assert (rows[2].note, rows[2].percentuale, rows[2].closed_at) == ("", 30, None)
    assert rows[3].note is None


def test_ticket_forms(spark):
    schema = "richiesta bigint, tipo string, priorita string, titolo string, scadenza string"
    batch = spark.createDataFrame([(1, "Blocco", "Alta", " x ", "2030-01-01"), (2, "Difetto", "Media", "y", None), (3, "Blocco", "Alta", " ", None)], schema)
    rows = {r.richiesta: r for r in changes.quick_tickets(batch, dt.date(2024, 1, 15)).collect()}
    assert {k: (r.titolo, r.scadenza, r.stato) for k, r in rows.items()} == {1: ("x", "2030-01-01", "Bloccante"), 2: ("y", "2024-01-16", "Aperto")}
    assert sorted(r.richiesta for r in changes.typed_tickets(batch, dt.date(2024, 1, 15)).collect()) == [1, 2]


def test_budget_changes_of_one_moment(spark):
    t = make_tables(spark, budget_cantiere=[{"id": 5, "cantiere_id": 1}])
    schema = "cantiere_id bigint, budget_iniziale double, costo_effettivo double, extra_approvati double, note_budget string, updated_at timestamp_ntz"
    log = [(1, 2.0, 1.0, None, "b", T0), (1, 3.0, 0.0, None, "a", T0), (1, 9.0, 9.0, 9.0, "old", T0 - dt.timedelta(days=1))]
    for rows in (log, log[::-1]):
        row = changes.upsert_budgets(t.budget_cantiere, spark.createDataFrame(rows, schema).repartition(3)).first()
        assert (row.id, row.budget_iniziale, row.note_budget) == (5, 3.0, "a")


def test_dense_ids_of_a_computed_column(spark):
    batch = spark.range(1000).select((F.col("id") * 7).alias("k"))
    rows = dense_ids(batch, "k", 1)
    rows.write.format("noop").mode("overwrite").save()
    assert [r.id for r in rows.orderBy("k").collect()] == list(range(1, 1001))


def test_budget_upsert(spark):
    t = make_tables(spark, budget_cantiere=[{"id": 5, "cantiere_id": 1, "budget_iniziale": 1.0, "updated_at": T0 + dt.timedelta(days=9)}, {"id": 7, "cantiere_id": 2, "budget_iniziale": 2.0}])
    log = [(1, None, 3.0, None, "new", T0), (9, 4.0, None, None, None, T0), (8, 5.0, 0.0, 0.0, "x", T0)]
    rows = changes.upsert_budgets(
        t.budget_cantiere,
        spark.createDataFrame(log, "cantiere_id bigint, budget_iniziale double, costo_effettivo double, extra_approvati double, note_budget string, updated_at timestamp_ntz"),
    ).collect()
    assert {r.cantiere_id: (r.id, r.budget_iniziale, r.costo_effettivo, r.note_budget) for r in rows} == {
        1: (5, 0.0, 3.0, "new"), 2: (7, 2.0, None, None), 8: (8, 5.0, 0.0, "x"), 9: (9, 4.0, 0.0, None),
    }


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_dense_ids(spark, slices):
    keys = [k * k for k in range(500)] + [10**12 + k for k in range(500)]
    random.Random(1).shuffle(keys)
    batch = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(5)
    got = dense_ids(batch, "k", 101, slices).orderBy("k").collect()
    assert [r.id for r in got] == list(range(101, 1101))


def test_dense_ids_of_an_empty_batch(spark):
    empty = spark.createDataFrame([], "k bigint")
    assert dense_ids(empty, "k", 1).count() == 0
    assert next_id(empty.withColumnRenamed("k", "id")) == 1


def test_defaults_only_fill_left_out_columns(spark):
    batch = spark.createDataFrame([(1, 2, None)], "id bigint, cantiere_id bigint, stato string")
    row = with_defaults(batch, "attivita", F.lit(T0)).first()
    assert (row.stato, row.priorita, row.percentuale, row.created_at, row.closed_at) == (None, "Media", 0, T0, None)


def test_registered_notice_is_stamped_when_sent(spark):
    out = spark.createDataFrame([(1, 2, "Bob", "39", "hi")], "cantiere_id bigint, ticket_id bigint, destinatario string, telefono string, messaggio string")
    assert registered_notices(out, T0).first().sent_at == T0
    assert registered_notices(out, T0, "Preparata").first().sent_at is None


def test_typed_recipient_and_channel(spark):
    schema = "cantiere_id bigint, ticket_id bigint, destinatario string, telefono string, messaggio string"
    out = spark.createDataFrame([(1, 2, "Bob", "39", "hi"), (1, 3, "Eva", "40", "ho"), (1, 4, "Ada", "41", "he")], schema)
    typed = spark.createDataFrame(
        [(2, "Tom", "", "Email", "Preparata"), (3, None, None, "Fax", None)],
        "ticket_id bigint, destinatario string, telefono string, canale string, stato string",
    )
    rows = {r.ticket_id: r for r in registered_notices(retyped_notices(out, typed), T0).collect()}
    assert sorted(rows) == [2, 3]
    assert (rows[2].destinatario, rows[2].telefono, rows[2].canale, rows[2].stato, rows[2].sent_at) == ("Tom", "", "Email", "Preparata", None)
    assert (rows[3].destinatario, rows[3].telefono, rows[3].canale, rows[3].stato, rows[3].sent_at) == ("Eva", "40", "WhatsApp", "Inviata manualmente", T0)
    assert registered_notices(out, T0, channel="Telefonata").first().canale == "Telefonata"
