"""Foreman view: cards, the day's tasks, tickets to unblock and all open tickets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions import predicates as p
from siteloom.functions import scalars as s
from siteloom.operators import lists
from siteloom.operators.counts import SITE
from siteloom.plans.facts import site_facts
from siteloom.schema import SiteTables


def foreman_cards(tables: SiteTables, as_of: dt.date, brand: v.Brand = v.NO_BRAND) -> DataFrame:
    return site_facts(tables, as_of, brand, budget=False).select(
        F.col("id").alias(SITE),
        F.col("nome").alias("cantiere"),
        s.or_else(F.col("cliente"), v.DASH).alias("cliente"),
        s.or_else(F.col("capo_cantiere"), v.DASH).alias("capo_cantiere"),
        s.or_else(F.col("stato"), v.DASH).alias("stato"),
        "avanzamento",
        "sintesi",
        "livello",
        "rischio_sintesi",
        s.risk_colour(F.col("livello")).alias("colore_rischio"),
        "motivi",
        "azione",
        (F.col("totale") - F.col("completate")).alias("attivita_aperte"),
        "in_corso",
        F.col("attivita_bloccate").alias("bloccate"),
        F.col("ticket_aperti_noti").alias("ticket_aperti"),
        "urgenti",
    )


def _card(owner: str, phase: str) -> list[Column]:
    priority = s.or_else(F.col("priorita"), v.PRIORITY_DEFAULT)
    return [
        priority.alias("priorita"),
        s.card_class(priority).alias("classe"),
        s.priority_colour(priority).alias("colore"),
        F.col("titolo"),
        s.or_else(F.col(owner), v.NO_OWNER).alias("responsabile"),
        s.or_else(F.col("stato"), v.DASH).alias("stato"),
        s.or_else(F.col("scadenza"), v.DASH).alias("scadenza"),
        s.or_else(F.col(phase), "").alias("fase"),
    ]


def task_cards(tasks: DataFrame) -> DataFrame:
    """Card rows of tasks: blanks replaced, colour and class by priority."""
    extra = [c for c in ("posizione",) if c in tasks.columns]
    percent = s.whole_percent(F.col("percentuale")).alias("percentuale")
    return tasks.select("id", SITE, *extra, *_card("assegnato_a", "fase"), percent)


def ticket_cards(tickets: DataFrame) -> DataFrame:
    """Card rows of tickets: the type stands in for the phase; there is no percent."""
    extra = [c for c in ("posizione",) if c in tickets.columns]
    return tickets.select("id", SITE, *extra, *_card("responsabile", "tipo"))


def todays_tasks(tables: SiteTables, k: int = 8) -> DataFrame:
    return task_cards(lists.urgent_tasks(tables.attivita, k))


def todays_blocks(tables: SiteTables, k: int = 6) -> DataFrame:
    return ticket_cards(lists.tickets_to_unblock(tables.ticket, k))


def open_tickets_by_rank(tables: SiteTables) -> DataFrame:
    rows = tables.ticket.where(p.ticket_open_strict(F.col("stato"))).select(SITE, "id", *lists.TICKET_CARD)
    return rows.orderBy(SITE, *lists.by_priority_rank())


def foreman_view(tables: SiteTables, as_of: dt.date, brand: v.Brand = v.NO_BRAND) -> dict[str, DataFrame]:
    return {
        "schede": foreman_cards(tables, as_of, brand),
        "oggi": todays_tasks(tables),
        "blocchi": todays_blocks(tables),
        "ticket": open_tickets_by_rank(tables),
    }
