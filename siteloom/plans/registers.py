"""Plain sorted registers of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import predicates as p
from siteloom.functions import scalars as s
from siteloom.operators import lists
from siteloom.operators.counts import SITE
from siteloom.schema import SiteTables


def site_register(tables: SiteTables) -> DataFrame:
    columns = ["id", "nome", "cliente", "indirizzo", "capo_cantiere", "stato", "data_inizio", "data_fine_prevista"]
    return tables.cantieri.orderBy(*lists.newest_created_first()).select(*columns)


def site_labels(tables: SiteTables, ordered: bool = True) -> DataFrame:
    label = s.label_of(F.col("id"), F.col("nome")).alias("etichetta")
    rows = tables.cantieri.orderBy(*lists.newest_created_first()) if ordered else tables.cantieri
    return rows.select("id", label)


def crew_register(tables: SiteTables) -> DataFrame:
    active = tables.artigiani.where(p.crew_active(F.col("attivo")))
    return active.orderBy(*lists.by_name()).select("id", "nome", "ruolo", "telefono", "email", "note")


def task_register(tables: SiteTables) -> DataFrame:
    columns = ["fase", "titolo", "assegnato_a", "stato", "priorita", "scadenza", "percentuale", "note"]
    return tables.attivita.select(SITE, "id", *columns).orderBy(SITE, *lists.by_due_date())


def task_labels(tables: SiteTables, ordered: bool = True) -> DataFrame:
    label = s.label_of(F.col("id"), F.col("titolo")).alias("etichetta")
    rows = tables.attivita.select(SITE, "id", label)
    return rows.orderBy(SITE, *lists.newest_id_first()) if ordered else rows


def ticket_register(tables: SiteTables) -> DataFrame:
    columns = ["tipo", "titolo", "aperto_da", "responsabile", "priorita", "stato", "scadenza", "impatto"]
    return tables.ticket.select(SITE, "id", *columns).orderBy(SITE, *lists.by_priority_rank())
