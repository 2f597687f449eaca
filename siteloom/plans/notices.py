"""Notification centre: what to notify, key figures and the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions import scalars as s
from siteloom.operators import counts, lists, lookups
from siteloom.operators.counts import SITE
from siteloom.schema import SiteTables

LOG = ["destinatario", "telefono", "canale", "stato", "created_at", "sent_at", "responded_at", "risposta"]


def to_notify(tables: SiteTables) -> DataFrame:
    rows = lookups.tickets_with_latest_notice(tables.ticket, tables.notifiche)
    return rows.orderBy(SITE, *lists.by_priority_rank())


def figures(tables: SiteTables) -> DataFrame:
    return counts.notice_kpis(tables.cantieri, tables.ticket, tables.notifiche)


def log(tables: SiteTables) -> DataFrame:
    rows = lookups.notice_log(tables.notifiche, tables.ticket)
    return rows.select(SITE, "id", "ticket_id", "ticket", *LOG).orderBy(SITE, *lists.newest_id_first())


def log_labels(tables: SiteTables) -> DataFrame:
    """Pick-list labels of the log, "id - ticket title"."""
    rows = lookups.notice_log(tables.notifiche.select("id", SITE, "ticket_id"), tables.ticket)
    label = s.label_of(F.col("id"), s.or_else(F.col("ticket"), v.NO_TICKET))
    return rows.select("id", label.alias("etichetta"))


def notice_centre(tables: SiteTables) -> dict[str, DataFrame]:
    return {"da_notificare": to_notify(tables), "indicatori": figures(tables), "log": log(tables)}
