"""Budget against actual cost of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions import scalars as s

AMOUNTS = ["budget_iniziale", "costo_effettivo", "extra_approvati"]


def _status(position: int) -> Column:
    budget, total = F.col("budget_iniziale"), F.col("totale_aggiornato")
    return (
        F.when(budget == 0, v.BUDGET_MISSING[position])
        .when(total <= budget, v.BUDGET_ALIGNED[position])
        .when(total <= budget * F.lit(v.BUDGET_TOLERANCE), v.BUDGET_WATCH[position])
        .otherwise(v.BUDGET_ALERT[position])
    )


def with_budget_figures(rows: DataFrame) -> DataFrame:
    """Add total, variance, percent used and status to the rows of ``site_budgets``."""
    budget = F.col("budget_iniziale")
    used = s.half_even_percent(F.col("totale_aggiornato"), budget)
    return (
        rows.withColumn("totale_aggiornato", F.col("costo_effettivo") + F.col("extra_approvati"))
        .withColumns(
            {
                # without a budget the whole total is variance
                "scostamento": F.col("totale_aggiornato") - budget,
                "budget_consumato_pct": F.greatest(
                    F.lit(0.0), F.least(F.lit(float(v.BUDGET_PERCENT_MAX)), used)
                ).cast("int"),
                "stato_budget": _status(0),
                "gravita_budget": _status(1),
            }
        )
    )


def site_budgets(sites: DataFrame, budgets: DataFrame) -> DataFrame:
    """Every site with its budget row, or zeros and an empty note where there is none."""
    keyed = budgets.select(F.col("cantiere_id").alias("id"), *AMOUNTS, "note_budget")
    return sites.join(keyed, "id", "left").withColumns(
        {
            **{name: F.coalesce(F.col(name), F.lit(0.0)) for name in AMOUNTS},
            "note_budget": F.coalesce(F.col("note_budget"), F.lit("")),
        }
    )


def budget_summary(sites: DataFrame, budgets: DataFrame) -> DataFrame:
    return with_budget_figures(site_budgets(sites.select("id"), budgets))
