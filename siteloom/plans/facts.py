"""One wide row per site: every figure that dashboards and reports print."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions import scalars as s
from siteloom.operators.budget import site_budgets, with_budget_figures
from siteloom.operators.counts import attach, percent_done, task_counts, ticket_counts
from siteloom.operators.risk import with_risk
from siteloom.schema import SiteTables

SITE_COLUMNS = ["id", "nome", "indirizzo", "cliente", "capo_cantiere", "stato", "data_fine_prevista"]


def site_facts(
    tables: SiteTables, as_of: dt.date, brand: v.Brand = v.NO_BRAND, budget: bool = True
) -> DataFrame:
    """Tasks, tickets and budgets are read once each and reduced to the site before any join.

    Columns that a report does not print are pruned from the plan, and so is an
    aggregate of which it prints nothing; ``budget=False`` leaves the budget out.
    """
    counted = attach(
        tables.cantieri.select(*SITE_COLUMNS), task_counts(tables.attivita, as_of), ticket_counts(tables.ticket)
    )
    percent = percent_done(F.col("totale"), F.col("somma_percentuali"))
    facts = (
        with_risk(counted, brand)
        .withColumn("avanzamento", percent)
        .withColumns(
            {
                "sintesi": s.progress_label(F.col("avanzamento")),
                "barra": s.progress_bar(F.col("avanzamento")),
                "motivi": F.array_join("motivi", ", "),
            }
        )
    )
    return with_budget_figures(site_budgets(facts, tables.budget_cantiere)) if budget else facts
