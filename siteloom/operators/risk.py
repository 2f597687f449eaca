"""Explainable operational risk of a site."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.operators.counts import attach, task_counts, ticket_counts

COUNTERS = list(v.RISK_WEIGHTS)
LEVELS = [v.RISK_RED, v.RISK_YELLOW, v.RISK_GREEN]


def risk_score() -> Column:
    return reduce(add, [F.col(name) * F.lit(weight) for name, weight in v.RISK_WEIGHTS.items()])


def _by_level(score: Column, position: int, brand: v.Brand) -> Column:
    texts = [brand.fill(level[position]) for level in LEVELS]
    return (
        F.when(score >= LEVELS[0][0], texts[0]).when(score >= LEVELS[1][0], texts[1]).otherwise(texts[2])
    )


def risk_level(score: Column) -> Column:
    return _by_level(score, 1, v.NO_BRAND)


def risk_summary(score: Column) -> Column:
    return _by_level(score, 2, v.NO_BRAND)


def risk_action(score: Column, brand: v.Brand = v.NO_BRAND) -> Column:
    return _by_level(score, 3, brand)


def risk_reasons() -> Column:
    """Array of reasons in fixed order; never empty."""
    reasons = F.array_compact(
        F.array(
            *[
                F.when(F.col(name) > 0, F.concat(F.col(name).cast("string"), F.lit(f" {words}")))
                for name, words in v.RISK_REASONS
            ]
        )
    )
    return F.when(F.size(reasons) == 0, F.array(F.lit(v.RISK_NO_REASON))).otherwise(reasons)


def with_risk(counted: DataFrame, brand: v.Brand = v.NO_BRAND) -> DataFrame:
    """Add score, level and texts to rows that hold the risk counters."""
    score = F.col("punteggio")
    return counted.withColumn("punteggio", risk_score()).withColumns(
        {
            "livello": risk_level(score),
            "rischio_sintesi": risk_summary(score),
            "azione": risk_action(score, brand),
            "motivi": risk_reasons(),
        }
    )


def risk_counters(sites: DataFrame, tasks: DataFrame, tickets: DataFrame, as_of: dt.date) -> DataFrame:
    """The seven counters of every site. Tasks and tickets are aggregated apart, then joined."""
    return counters_of(sites, task_counts(tasks, as_of), ticket_counts(tickets))


def counters_of(sites: DataFrame, counted_tasks: DataFrame, counted_tickets: DataFrame) -> DataFrame:
    """The seven counters from counts of tasks and tickets."""
    return attach(
        sites.select("id", "nome"),
        counted_tasks.select("cantiere_id", "attivita_bloccate", "scadute"),
        counted_tickets.select("cantiere_id", "critici", "bloccanti", "alti", "decisioni", "a_rischio"),
    )


def risk_board(
    sites: DataFrame, tasks: DataFrame, tickets: DataFrame, as_of: dt.date, brand: v.Brand = v.NO_BRAND
) -> DataFrame:
    return with_risk(risk_counters(sites, tasks, tickets, as_of), brand)
