"""Change sets: inserts, upserts and keyed updates as whole-table jobs.

The table side is read once and joined by key; the change side is first folded
to one row per key by an aggregation of numbers, so a key with many changes is
combined before the shuffle and nothing is sorted. The values of the change that
it finds are fetched by a join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions import predicates as p
from siteloom.functions import scalars as s
from siteloom.operators.budget import AMOUNTS
from siteloom.operators.counts import SITE
from siteloom.operators.numbering import dense_ids, next_id
from siteloom.schema import REQUIRED_TEXT, conform, with_defaults

CLOSED_STATES = {"attivita": v.TASK_DONE, "ticket": v.TICKET_CLOSED}
TASK_FIELDS = ["stato", "priorita", "percentuale", "note"]
TICKET_FIELDS = ["stato", "priorita", "responsabile", "impatto"]


# --- inserts ---------------------------------------------------------------
def validated(batch: DataFrame, table: str) -> DataFrame:
    """Strip the required text and flag in ``accettata`` whether any is left."""
    column = REQUIRED_TEXT[table]
    return batch.withColumn("accettata", p.has_text(F.col(column))).withColumn(column, s.strip(F.col(column)))


def accepted(batch: DataFrame, table: str) -> DataFrame:
    return validated(batch, table).where("accettata").drop("accettata")


def new_rows(batch: DataFrame, table: str, existing: DataFrame, order: str, now: dt.datetime) -> DataFrame:
    """Insert batch completed with ids after the highest in use, defaults and creation time.

    ``order`` names a unique numeric column of the batch: the arrival order.
    """
    numbered = dense_ids(batch, order, next_id(existing))
    return with_defaults(numbered, table, s.literal_time(now))


def appended(existing: DataFrame, batch: DataFrame, table: str, order: str, now: dt.datetime) -> DataFrame:
    return existing.unionByName(new_rows(batch, table, existing, order, now))


def ticket_batch(triaged: DataFrame, as_of: dt.date, owner: str = v.FOREMAN) -> DataFrame:
    """Unedited ticket proposals of triaged messages."""
    return triaged.select(
        F.col("id").alias("messaggio_id"),
        SITE,
        "tipo",
        "titolo",
        F.col("testo").alias("descrizione"),
        F.col("autore").alias("aperto_da"),
        F.lit(owner).alias("responsabile"),
        "priorita",
        "stato",
        "impatto",
        F.lit(str(as_of + dt.timedelta(days=v.TICKET_DUE_DAYS))).alias("scadenza"),
    )


def update_batch(triaged: DataFrame) -> DataFrame:
    """Field-update rows of triaged messages."""
    return triaged.select(
        F.col("id").alias("messaggio_id"), SITE, "autore", "testo", F.col("tipo").alias("categoria")
    )


def task_batch(batch: DataFrame, as_of: dt.date) -> DataFrame:
    """Typed tasks: blank titles are left out, percent follows the state, due in a week unless said."""
    coherent = s.effective_percent(F.col("stato"), F.col("percentuale")).cast("bigint")
    return _with_missing_day(
        accepted(batch, "attivita").withColumn("percentuale", coherent), "scadenza", as_of, v.TASK_DUE_DAYS
    )


def site_batch(batch: DataFrame, as_of: dt.date) -> DataFrame:
    """Typed sites: blank names are left out, start today and end in 45 days unless said."""
    dated = _with_missing_day(accepted(batch, "cantieri"), "data_inizio", as_of, 0)
    return _with_missing_day(dated, "data_fine_prevista", as_of, v.SITE_END_DAYS)


def crew_batch(batch: DataFrame) -> DataFrame:
    """Typed crews: blank names are left out."""
    return accepted(batch, "artigiani")


def _with_missing_day(batch: DataFrame, column: str, as_of: dt.date, days: int) -> DataFrame:
    day = F.lit(str(as_of + dt.timedelta(days=days)))
    if column not in batch.columns:
        return batch.withColumn(column, day)
    return batch.withColumn(column, F.coalesce(column, day))


def typed_tickets(batch: DataFrame, as_of: dt.date) -> DataFrame:
    """Typed tickets: blank titles are left out, due the next day unless said."""
    return _with_missing_day(accepted(batch, "ticket"), "scadenza", as_of, v.TICKET_DUE_DAYS)


def quick_tickets(batch: DataFrame, as_of: dt.date) -> DataFrame:
    """Tickets typed by the foreman: as typed tickets, but the state follows type and priority."""
    state = s.quick_ticket_state(F.col("tipo"), F.col("priorita"))
    return typed_tickets(batch, as_of).withColumns({"stato": state, "aperto_da": F.lit(v.FOREMAN)})


# --- keyed updates ---------------------------------------------------------
#: seq from its smallest value on, and how many values it has: one moment's changes are numbered within this
SEQ_FLOOR, SEQ_VALUES = -(1 << 63), 1 << 64
#: before any moment, in microseconds; for a change without a time
NO_TIME = -(10**18)


def order_key(ts: str = "ts", seq: str = "seq") -> Column:
    """Time, then sequence, as one number: hash aggregation keeps numbers, where structs and texts make it sort.

    Nulls come first. Microseconds have 18 digits at most, so the number fits 38.
    """
    micros = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(NO_TIME)).cast("decimal(20,0)")
    place = F.coalesce(F.col(seq), F.lit(SEQ_FLOOR)).cast("decimal(20,0)") - F.lit(SEQ_FLOOR).cast("decimal(20,0)")
    return (micros * F.expr(f"CAST({SEQ_VALUES} AS DECIMAL(20,0))") + place).cast("decimal(38,0)")


def _keyed(changes: DataFrame, fields: list[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Changes with their order key and a hash of their values."""
    return changes.withColumns({"_key": order_key(ts, seq), "_hash": F.xxhash64(*fields)})


def _last_columns() -> list[Column]:
    """The key and the hash of an id's last change (of different changes with one key, those of one)."""
    return [F.max("_key").alias("_last"), F.max_by("_hash", "_key").alias("_pick")]


def _with_last_values(last: DataFrame, keyed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The rows of ``last``, one for each key, with the values of the change that they name.

    The changes meet them by id, key and hash, so a busy id is spread over the partitions. A change that was delivered
    again is one row.
    """
    values = keyed.select(F.col(key).alias("_id"), "_key", "_hash", *[F.col(f).alias(f"_new_{f}") for f in fields])
    meets = (F.col(key) == F.col("_id")) & (F.col("_last") == F.col("_key")) & (F.col("_pick") == F.col("_hash"))
    return last.join(values, meets).drop("_id", "_key", "_hash").distinct()


def last_change(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest change of every key, by time and sequence: found by aggregation, its values fetched by a join."""
    values = [name for name in changes.columns if name != key]
    keyed = _keyed(changes, values, *order)
    found = _with_last_values(keyed.groupBy(key).agg(*_last_columns()), keyed, key, values)
    return found.select(key, *[F.col(f"_new_{name}").alias(name) for name in values])


def _fold_state_changes(changes: DataFrame, table: str, fields: list[str]) -> DataFrame:
    """Per id: the last values, whether a reopening happened, and when the final closing began.

    Applying the changes one after the other stamps the first closing after the
    last reopening. One aggregation finds the last change, the first closing and
    the last reopening, all as numbers. Only ids that were reopened need their
    closings once more, by a join in which a reopened id is one row; the closings
    of a busy id are split at run time.
    """
    keyed = _keyed(changes, fields)
    closed = F.coalesce(F.col("stato").isin(*CLOSED_STATES[table]), F.lit(False))
    last = keyed.groupBy("id").agg(
        *_last_columns(),
        F.max(F.when(~closed, F.col("_key"))).alias("_reopened"),
        F.min(F.when(closed, F.col("ts"))).alias("_first_closed"),
    )
    reopened = last.where(F.col("_reopened").isNotNull()).select("id", "_reopened")
    closings = keyed.where(closed).select("id", "ts", "_key")
    after = closings.join(reopened, "id").where(F.col("_key") > F.col("_reopened"))
    began = after.groupBy("id").agg(F.min("ts").alias("_closed_again"))
    was_open = F.col("_reopened").isNotNull()
    stamps = last.join(began, "id", "left").select(
        "id",
        "_last",
        "_pick",
        was_open.alias("_was_open"),
        F.when(was_open, F.col("_closed_again")).otherwise(F.col("_first_closed")).alias("_closed_at"),
    )
    return _with_last_values(stamps, keyed, "id", fields)


def apply_changes(existing: DataFrame, changes: DataFrame, table: str, fields: list[str]) -> DataFrame:
    """Existing rows after a change set (id, ts, seq, *fields), close stamps included.

    A change replaces all of ``fields``, null included. Rows without a change
    stay as they are, and changes of unknown ids do nothing. Applying the same
    set again changes nothing.
    """
    folded = _fold_state_changes(changes, table, fields)
    state = F.col("_new_stato")
    kept = F.when(~F.col("_was_open"), F.col("closed_at"))
    stamp = s.close_stamp(CLOSED_STATES[table], state, kept, F.col("_closed_at"))
    changed = F.col("_was_open").isNotNull()
    new_values = {name: F.when(changed, F.col(f"_new_{name}")).otherwise(F.col(name)) for name in fields}
    return (
        existing.join(folded, "id", "left")
        .withColumns({**new_values, "closed_at": F.when(changed, stamp).otherwise(F.col("closed_at"))})
        .select(*existing.columns)
    )


def apply_task_changes(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Full-form task updates: typed percent is made coherent with the state, the note is replaced."""
    coherent = changes.withColumn(
        "percentuale", s.effective_percent(F.col("stato"), F.col("percentuale")).cast("bigint")
    )
    return apply_changes(tasks, coherent, "attivita", TASK_FIELDS)


def apply_ticket_changes(tickets: DataFrame, changes: DataFrame) -> DataFrame:
    return apply_changes(tickets, changes, "ticket", TICKET_FIELDS)


def apply_quick_task_updates(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """Quick updates (id, ts, seq, stato, priorita, percentuale, nota), any number per task.

    State, priority and percent are those of the last update; every note with
    text is appended on a line of its own, with its time, in order.
    """
    coherent = updates.drop("nota").withColumn(
        "percentuale", s.effective_percent(F.col("stato"), F.col("percentuale")).cast("bigint")
    )
    changed = apply_changes(tasks, coherent, "attivita", ["stato", "priorita", "percentuale"])
    line = F.struct("ts", "seq", s.appended_note(F.lit(None).cast("string"), F.col("nota"), F.col("ts")).alias("riga"))
    # the lines of a task become one value of its row, so they have to meet there
    lines = updates.groupBy("id").agg(F.sort_array(F.collect_list(F.when(p.has_text(F.col("nota")), line))).alias("_lines"))
    old = F.coalesce("note", F.lit(""))
    grown = F.concat_ws("\n", F.nullif(F.col("note"), F.lit("")), F.col("_lines.riga"))
    note = F.when(F.col("_lines").isNull(), F.col("note")).when(F.size("_lines") == 0, old).otherwise(grown)
    return changed.join(lines, "id", "left").withColumn("note", note).select(*tasks.columns)


def apply_replies(notices: DataFrame, replies: DataFrame) -> DataFrame:
    """Notice updates (id, ts, seq, stato, risposta). A reply with text stamps its time.

    The stamp is that of the last reply with text, even if a later change is blank.
    """
    fields = ["stato", "risposta"]
    keyed = _keyed(replies, fields)
    replied = F.max_by("ts", F.when(p.has_text(F.col("risposta")), F.col("_key"))).alias("_replied")
    folded = _with_last_values(keyed.groupBy("id").agg(*_last_columns(), replied), keyed, "id", fields)
    changed = F.col("_last").isNotNull()
    return (
        notices.join(folded, "id", "left")
        .withColumns(
            {
                **{name: F.when(changed, F.col(f"_new_{name}")).otherwise(F.col(name)) for name in fields},
                "responded_at": F.coalesce(F.col("_replied"), F.col("responded_at")),
            }
        )
        .select(*notices.columns)
    )


def cascaded_ticket_changes(notices: DataFrame, replies: DataFrame) -> DataFrame:
    """Ticket changes (id, ts, seq, stato) that replies ask for; "do not modify" asks for none."""
    asked = replies.where(F.col("stato_ticket").isNotNull() & (F.col("stato_ticket") != v.NOTICE_KEEP_TICKET))
    links = notices.where(F.col("ticket_id").isNotNull()).select("id", "ticket_id")
    return asked.join(links, "id").select(
        F.col("ticket_id").alias("id"), "ts", "seq", F.col("stato_ticket").alias("stato")
    )


def apply_cascade(tickets: DataFrame, notices: DataFrame, replies: DataFrame) -> DataFrame:
    return apply_changes(tickets, cascaded_ticket_changes(notices, replies), "ticket", ["stato"])


# --- budget upsert ---------------------------------------------------------
def upsert_budgets(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or replace by site; the latest row wins and nulls in amounts become 0.

    Of rows with the same time the one with the larger values wins, compared in
    the order of the columns. A site that already has a row keeps its id; new
    ones take the next free ids. The changes are folded first, and the base
    table is read once, by one join.
    """
    amounts = [F.coalesce(F.col(name), F.lit(0.0)).alias(name) for name in AMOUNTS]
    latest = changes.groupBy(SITE).agg(F.max(F.struct("updated_at", *amounts, "note_budget")).alias("_last"))
    merged = existing.join(latest, SITE, "full").select(
        "id",
        SITE,
        *[
            F.when(F.col("_last").isNotNull(), F.col(f"_last.{name}")).otherwise(F.col(name)).alias(name)
            for name in (*AMOUNTS, "note_budget", "updated_at")
        ],
    )
    fresh = dense_ids(merged.where(F.col("id").isNull()).drop("id"), SITE, next_id(existing))
    kept = merged.where(F.col("id").isNotNull())
    return conform(kept.unionByName(fresh), "budget_cantiere")


def form_state(col: Column, words: list[str]) -> Column:
    """A state outside the list falls back to the first one."""
    return s.one_of(col, words, words[0])
