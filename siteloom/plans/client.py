"""Client overview: cards and short lists per site."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions import predicates as p
from siteloom.functions import scalars as s
from siteloom.operators import lists
from siteloom.operators.counts import SITE
from siteloom.plans.facts import site_facts
from siteloom.plans.sections import FULL_ROWS, task_groups
from siteloom.schema import SiteTables


def client_cards(tables: SiteTables, as_of: dt.date) -> DataFrame:
    return site_facts(tables, as_of).select(
        F.col("id").alias(SITE),
        F.col("nome").alias("cantiere"),
        s.or_else(F.col("cliente"), v.DASH).alias("cliente"),
        s.or_else(F.col("indirizzo"), v.DASH).alias("indirizzo"),
        s.or_else(F.col("data_fine_prevista"), v.DASH).alias("consegna_prevista"),
        "avanzamento",
        "sintesi",
        s.euro(F.col("budget_iniziale")).alias("budget_iniziale"),
        s.euro(F.col("costo_effettivo")).alias("costo_effettivo"),
        "budget_consumato_pct",
        s.euro(F.col("totale_aggiornato")).alias("totale_aggiornato"),
        "stato_budget",
        "gravita_budget",
        F.col("punti_cliente").alias("punti_da_confermare"),
    )


def client_lists(tables: SiteTables, k: int = FULL_ROWS) -> DataFrame:
    """At most k rows per site in each of the four lists, one row per entry."""
    state = F.col("stato")
    groups = task_groups(state)
    names = ["completate", "in_corso", "da_fare"]
    labels = F.array_compact(F.array(*[F.when(groups[n], F.lit(n)) for n in names]))
    tasks = tables.attivita.select(
        SITE, "id", "titolo", "fase", "scadenza", "percentuale", F.explode(labels).alias("sezione")
    )
    points = tables.ticket.where(p.ticket_for_client(state, F.col("tipo"))).select(
        SITE, "id", "titolo", "priorita", "scadenza", F.lit("punti").alias("sezione")
    )
    keys = [SITE, "sezione"]
    due = s.or_else(F.col("scadenza"), "")
    when_due = F.when(due != "", F.concat(F.lit("· prevista "), due)).otherwise(F.lit(""))
    percent = F.concat(F.lit(" · "), s.whole_percent(F.col("percentuale")).cast("string"), F.lit("%"))
    task_rows = lists.top_per_group(tasks, keys, lists.by_due_date(), k).select(
        *keys, "posizione", "id", "titolo",
        F.concat(s.or_else(F.col("fase"), ""), percent, F.lit(" "), when_due).alias("riga"),
    )
    point_rows = lists.top_per_group(points, keys, lists.by_priority_rank(), k).select(
        *keys, "posizione", "id", "titolo", F.concat(F.lit(" "), when_due).alias("riga")
    )
    return task_rows.unionByName(point_rows)


def client_task_flags(tables: SiteTables) -> DataFrame:
    """Every task with the client groups it belongs to."""
    groups = task_groups(F.col("stato"))
    shown = {n: groups[n].alias(n) for n in ("completate", "in_corso", "da_fare", "bloccate")}
    return tables.attivita.select("id", SITE, *shown.values())
