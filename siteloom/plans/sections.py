"""Bounded bullet lists per site for the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions import predicates as p
from siteloom.operators import lists
from siteloom.operators.counts import SITE

DAILY_ROWS = 6
SHORT_ROWS = 4
NEXT_ROWS = 5
WORKS_ROWS = 8
FULL_ROWS = 6


def task_groups(state: Column) -> dict[str, Column]:
    """Groups of tasks; they overlap, a blocked task is also still to do."""
    return {
        "completate": p.task_done(state),
        "in_corso": p.task_in(state, v.TASK_RUNNING),
        "bloccate": p.task_in(state, v.TASK_BLOCKED),
        "da_fare": p.task_to_do(state),
        "prossime": p.task_unfinished_strict(state),
    }


def task_lists(tasks: DataFrame, names: list[str], k: int) -> DataFrame:
    """Task lines by due date, at most k per group."""
    groups = task_groups(F.col("stato"))
    rows = tasks.select(SITE, "id", "titolo", "stato", "scadenza", "percentuale")
    return lists.section_lists(rows, {n: groups[n] for n in names}, lists.by_due_date(), lists.task_line(), k)


def daily_ticket_lists(tickets: DataFrame, k: int = DAILY_ROWS, priority_order: str = "name") -> DataFrame:
    """Ticket lines of the daily report. Its cut follows the alphabetical priority."""
    state, kind = F.col("stato"), F.col("tipo")
    order = lists.by_priority_name() if priority_order == "name" else lists.by_priority_rank()
    groups = {
        "operativi": p.ticket_operational(state, kind),
        "decisioni_aperte": p.ticket_decision(state, kind),
        "da_confermare": p.ticket_to_confirm(state, kind),
    }
    rows = tickets.select(SITE, "id", "titolo", "stato", "tipo", "priorita", "scadenza")
    return lists.section_lists(rows, groups, order, lists.ticket_line(), k)


def client_ticket_lists(tickets: DataFrame, k: int = WORKS_ROWS) -> DataFrame:
    """Points the client should confirm, most urgent first."""
    groups = {"punti": p.ticket_for_client(F.col("stato"), F.col("tipo"))}
    rows = tickets.select(SITE, "id", "titolo", "stato", "tipo", "priorita", "scadenza")
    return lists.section_lists(rows, groups, lists.by_priority_rank(), lists.ticket_line(), k)
