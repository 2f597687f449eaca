"""Operations dashboard: the datasets behind one screen."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions import predicates as p
from siteloom.functions import scalars as s
from siteloom.operators import counts, lists, lookups
from siteloom.plans.facts import site_facts
from siteloom.schema import SiteTables

NEXT_ROWS = 20
TASK_COLUMNS = ["id", "cantiere", "fase", "titolo", "assegnato_a", "stato", "priorita", "scadenza", "percentuale"]
TICKET_COLUMNS = ["id", "cantiere", "tipo", "titolo", "responsabile", "priorita", "stato", "scadenza", "impatto"]


def scoped(tables: SiteTables, site_id: int | None) -> SiteTables:
    """The tables of one site, or of all; the filter reaches the file scans."""
    if site_id is None:
        return tables
    key = {"cantieri": "id"}
    return SiteTables(
        **{
            name: counts.in_scope(df, site_id, key.get(name, counts.SITE)) if name != "artigiani" else df
            for name, df in tables.items()
        }
    )


def site_rows(tables: SiteTables, as_of: dt.date, brand: v.Brand = v.NO_BRAND) -> DataFrame:
    """KPI, progress and risk of every site in one row."""
    facts = site_facts(tables, as_of, brand, budget=False)
    return facts.select(
        F.col("id").alias("cantiere_id"),
        F.col("nome").alias("cantiere"),
        "totale",
        "completate",
        counts.completion_rate(F.col("completate"), F.col("totale")).alias("tasso_completamento"),
        "in_corso",
        "attivita_bloccate",
        "ticket_aperti",
        "bloccanti",
        "scadute",
        "avanzamento",
        "sintesi",
        "punteggio",
        "livello",
        "rischio_sintesi",
        "motivi",
        "azione",
    )


def open_ticket_list(tables: SiteTables) -> DataFrame:
    rows = lookups.open_tickets_with_site(tables.ticket, tables.cantieri)
    return rows.orderBy(*lists.by_priority_rank()).select(*TICKET_COLUMNS)


def task_list(tables: SiteTables) -> DataFrame:
    rows = lookups.tasks_with_site(tables.attivita, tables.cantieri)
    shown = rows.withColumn("percentuale", s.shown_percent(F.col("percentuale")))
    return shown.orderBy(*lists.by_due_date()).select(*TASK_COLUMNS)


def next_due(tables: SiteTables, k: int = NEXT_ROWS) -> DataFrame:
    """The first k unfinished tasks by due date over the whole scope."""
    unfinished = tables.attivita.where(p.task_unfinished_strict(F.col("stato")))
    rows = lookups.tasks_with_site(unfinished, tables.cantieri)
    return rows.orderBy(*lists.by_due_date()).limit(k).select(*TASK_COLUMNS)


def operations_dashboard(
    tables: SiteTables, as_of: dt.date, site_id: int | None = None, brand: v.Brand = v.NO_BRAND
) -> dict[str, DataFrame]:
    """All parts of the dashboard, lazily."""
    scope = scoped(tables, site_id)
    return {
        "kpi": counts.kpis(scope.cantieri, scope.attivita, scope.ticket, as_of),
        "cantieri": site_rows(scope, as_of, brand),
        "avanzamento": counts.site_progress(scope.cantieri, scope.attivita).orderBy(*lists.newest_created_first()),
        "ticket_aperti": open_ticket_list(scope),
        "attivita_per_stato": counts.tasks_by_state(scope.attivita),
        "attivita_per_stato_e_cantiere": counts.tasks_by_state(scope.attivita, per_site=True),
        "attivita": task_list(scope),
        "prossime": next_due(scope),
    }
