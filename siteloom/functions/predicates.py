"""Row predicates.

Two meanings of "not in this set" exist side by side and differ on null:
the *strict* one drops a null state (SQL ``NOT IN``), the *lenient* one keeps
it. Every caller names the one it means.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions.scalars import parse_date, strip


def _member(col: Column, words: list[str]) -> Column:
    """Membership that is never null."""
    return F.coalesce(col.isin(*words), F.lit(False))


def ticket_open_strict(state: Column) -> Column:
    return ~state.isin(*v.TICKET_CLOSED)


def ticket_open_lenient(state: Column) -> Column:
    return ~_member(state, v.TICKET_CLOSED)


def task_done(state: Column) -> Column:
    return _member(state, v.TASK_DONE)


def task_unfinished_strict(state: Column) -> Column:
    return ~state.isin(*v.TASK_DONE)


def task_overdue(due: Column, state: Column, as_of: dt.date) -> Column:
    """Due strictly before ``as_of`` and not done; no readable date means not overdue."""
    return F.coalesce(parse_date(due) < F.lit(as_of), F.lit(False)) & ~task_done(state)


def task_in(state: Column, word: str) -> Column:
    return _member(state, [word])


def task_to_do(state: Column) -> Column:
    return _member(state, v.TASK_TODO)


def ticket_urgent(state: Column, priority: Column) -> Column:
    return ticket_open_strict(state) & (
        _member(state, [v.TICKET_BLOCKING]) | _member(priority, v.PRIORITIES_URGENT)
    )


def ticket_for_client(state: Column, kind: Column) -> Column:
    return ticket_open_strict(state) & _member(kind, v.TYPES_FOR_CLIENT)


def ticket_operational(state: Column, kind: Column) -> Column:
    return ticket_open_lenient(state) & _member(kind, v.TYPES_OPERATIONAL)


def ticket_decision(state: Column, kind: Column) -> Column:
    return ticket_open_lenient(state) & _member(kind, [v.TYPE_DECISION])


def ticket_to_confirm(state: Column, kind: Column) -> Column:
    return ticket_open_lenient(state) & _member(kind, v.TYPES_TO_CONFIRM)


def crew_active(flag: Column) -> Column:
    return flag == 1


def notice_sent(state: Column) -> Column:
    return _member(state, v.NOTICE_SENT)


def reply_present(reply: Column) -> Column:
    return F.length(F.coalesce(reply, F.lit(""))) > 0


def has_text(col: Column) -> Column:
    """Not null and not blank."""
    return F.length(F.coalesce(strip(col), F.lit(""))) > 0
