"""Counts per site. Each table is aggregated once, by its site key, before any join.

Partial aggregation runs before the shuffle, so a site that holds a third of all
rows sends one partial row per input partition.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions import predicates as p
from siteloom.functions import scalars as s

SITE = "cantiere_id"


def in_scope(df: DataFrame, site_id: int | None = None, column: str = SITE) -> DataFrame:
    """One site, or all of them."""
    return df if site_id is None else df.where(F.col(column) == site_id)


def in_sites(df: DataFrame, sites: DataFrame, column: str = SITE) -> DataFrame:
    """Only rows of the listed sites (column ``id``)."""
    keys = sites.select(F.col("id").alias(column)).distinct()
    return df.join(keys, column, "left_semi")


def _sum(flag: Column) -> Column:
    return F.count_if(flag)


def task_counts(tasks: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Everything that is ever counted on tasks, per site."""
    state = F.col("stato")
    overdue = p.task_overdue(F.col("scadenza"), state, as_of) if as_of else F.lit(False)
    return tasks.groupBy(SITE).agg(
        F.count(F.lit(1)).alias("totale"),
        _sum(p.task_done(state)).alias("completate"),
        _sum(p.task_in(state, v.TASK_RUNNING)).alias("in_corso"),
        _sum(p.task_in(state, v.TASK_BLOCKED)).alias("attivita_bloccate"),
        _sum(overdue).alias("scadute"),
        F.sum(s.effective_percent(state, F.col("percentuale"))).alias("somma_percentuali"),
    )


def ticket_counts(tickets: DataFrame) -> DataFrame:
    """Everything that is ever counted on tickets, per site."""
    state, kind, priority = F.col("stato"), F.col("tipo"), F.col("priorita")
    lenient = p.ticket_open_lenient(state)
    return tickets.groupBy(SITE).agg(
        _sum(lenient).alias("ticket_aperti"),
        _sum(p.ticket_open_strict(state)).alias("ticket_aperti_noti"),
        _sum(lenient & (priority == v.PRIORITY_CRITICAL)).alias("critici"),
        _sum(lenient & (priority == v.PRIORITY_HIGH)).alias("alti"),
        _sum(state == v.TICKET_BLOCKING).alias("bloccanti"),
        _sum(lenient & kind.isin(*v.TYPES_TO_CONFIRM)).alias("decisioni"),
        _sum(lenient & kind.isin(*v.TYPES_AT_RISK)).alias("a_rischio"),
        _sum(p.ticket_operational(state, kind)).alias("operativi"),
        _sum(p.ticket_urgent(state, priority)).alias("urgenti"),
        _sum(p.ticket_for_client(state, kind)).alias("punti_cliente"),
    )


def notice_counts(notices: DataFrame) -> DataFrame:
    return notices.groupBy(SITE).agg(
        F.count(F.lit(1)).alias("preparate"),
        _sum(p.notice_sent(F.col("stato"))).alias("inviate"),
        _sum(p.reply_present(F.col("risposta"))).alias("risposte"),
    )


def attach(sites: DataFrame, *aggregates: DataFrame) -> DataFrame:
    """Left-join per-site aggregates; a site missing from one gets zeros.

    All sides are unique on the site and the aggregates are already partitioned
    on it, so the chain of joins shuffles only the sites and cannot fan out.
    """
    joined = sites
    for part in aggregates:
        numbers = [name for name in part.columns if name != SITE]
        joined = joined.join(part.withColumnRenamed(SITE, "id"), "id", "left").fillna(0, subset=numbers)
    return joined


def percent_done(total: Column, percent_sum: Column) -> Column:
    """Half-even mean of whole percents. Sum over count does not depend on row order."""
    return F.when(total > 0, F.bround(percent_sum / total, 0)).otherwise(F.lit(0.0)).cast("int")


def completion_rate(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.bround(done / total * F.lit(100.0), 0)).otherwise(F.lit(0.0))


def site_progress(sites: DataFrame, tasks: DataFrame) -> DataFrame:
    """Progress table of all sites, with zeros for a site without tasks."""
    return progress_of(sites, task_counts(tasks))


def progress_of(sites: DataFrame, counted_tasks: DataFrame) -> DataFrame:
    """The progress table from counts of tasks."""
    counted = attach(sites.select("id", "nome", "cliente", "capo_cantiere", "stato", "created_at"), counted_tasks)
    return counted.withColumn(
        "avanzamento", percent_done(F.col("totale"), F.col("somma_percentuali"))
    ).select(
        "id",
        F.col("nome").alias("cantiere"),
        s.or_else(F.col("cliente"), "").alias("cliente"),
        s.or_else(F.col("capo_cantiere"), "").alias("capo_cantiere"),
        s.or_else(F.col("stato"), "").alias("stato"),
        "avanzamento",
        F.col("totale").alias("attivita_totali"),
        "completate",
        "in_corso",
        F.col("attivita_bloccate").alias("bloccate"),
        s.progress_label(F.col("avanzamento")).alias("sintesi"),
        "created_at",
    )


KPI = ["totale", "completate", "attivita_bloccate", "ticket_aperti", "bloccanti", "scadute"]


def kpis(sites: DataFrame, tasks: DataFrame, tickets: DataFrame, as_of: dt.date) -> DataFrame:
    """KPI row of every site, zeros included, of keys without a site, and of all rows together (cantiere_id null).

    The rollup runs over per-site counts, not over tasks and tickets.
    """
    return kpis_of(sites, task_counts(tasks, as_of), ticket_counts(tickets))


def kpis_of(sites: DataFrame, counted_tasks: DataFrame, counted_tickets: DataFrame) -> DataFrame:
    """The KPI rows from counts of tasks and tickets."""
    listed = sites.select(F.col("id").alias(SITE))
    task_part = counted_tasks.select(SITE, "totale", "completate", "attivita_bloccate", "scadute")
    ticket_part = counted_tickets.select(SITE, "ticket_aperti", "bloccanti")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [task_part, ticket_part, listed])
    return (
        stacked.rollup(SITE)
        .agg(
            F.grouping(SITE).alias("_all"),
            *[F.coalesce(F.sum(name), F.lit(0).cast("bigint")).alias(name) for name in KPI],
        )
        .select(
            F.when(F.col("_all") == 1, F.lit("tutti")).otherwise(F.lit("cantiere")).alias("vista"),
            SITE,
            *KPI,
            completion_rate(F.col("completate"), F.col("totale")).alias("tasso_completamento"),
        )
    )


def tasks_by_state(tasks: DataFrame, per_site: bool = False) -> DataFrame:
    """Number of tasks in each state, over all tasks or of each site."""
    return tasks.groupBy(*[SITE] * per_site, "stato").agg(F.count(F.lit(1)).alias("numero"))


def foreman_kpis(sites: DataFrame, tasks: DataFrame, tickets: DataFrame) -> DataFrame:
    counted = attach(
        sites.select("id"),
        task_counts(tasks).select(SITE, "totale", "completate", "in_corso", "attivita_bloccate"),
        ticket_counts(tickets).select(SITE, "ticket_aperti_noti", "urgenti"),
    )
    return counted.select(
        F.col("id").alias(SITE),
        (F.col("totale") - F.col("completate")).alias("attivita_aperte"),
        "in_corso",
        F.col("attivita_bloccate").alias("bloccate"),
        F.col("ticket_aperti_noti").alias("ticket_aperti"),
        "urgenti",
    )


def notice_kpis(sites: DataFrame, tickets: DataFrame, notices: DataFrame) -> DataFrame:
    counted = attach(
        sites.select("id"),
        ticket_counts(tickets).select(SITE, "ticket_aperti_noti"),
        notice_counts(notices),
    )
    return counted.select(
        F.col("id").alias(SITE),
        F.col("ticket_aperti_noti").alias("ticket_aperti"),
        "preparate",
        "inviate",
        "risposte",
    )
