"""Counts per site that are kept between snapshots: a change set adds and takes away, and nothing is counted again.

Every count of ``counts`` is a sum over rows, so the counts after a change are
the kept ones, less those of the changed rows as they were, plus those of the
same rows as they are now. Only changed rows are read. What is overdue depends
on the day: it is a sum over an index of due dates, kept in the same way.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import predicates as p
from siteloom.functions import scalars as s
from siteloom.operators.counts import SITE, kpis_of, progress_of, task_counts, ticket_counts
from siteloom.operators.risk import counters_of, with_risk
from siteloom.vocabulary import NO_BRAND, Brand

DUE = "giorno"


def due_index(tasks: DataFrame) -> DataFrame:
    """Unfinished tasks per site and due date; tasks without a readable date are in none."""
    day = s.parse_date(F.col("scadenza"))
    unfinished = tasks.where(day.isNotNull() & ~p.task_done(F.col("stato")))
    return unfinished.groupBy(SITE, day.alias(DUE)).agg(F.count(F.lit(1)).alias("scadenze"))


def overdue(index: DataFrame, as_of: dt.date) -> DataFrame:
    """Overdue tasks per site; the filter on the day reaches the scan of a stored index."""
    return index.where(F.col(DUE) < F.lit(as_of)).groupBy(SITE).agg(F.sum("scadenze").alias("scadute"))


def changed_by(kept: DataFrame, keys: list[str], count: Callable[[DataFrame], DataFrame], before: DataFrame, after: DataFrame) -> DataFrame:
    """Kept counts after some rows ``before`` became those ``after``; keys that count nothing any more are left out."""
    numbers = [name for name in kept.columns if name not in keys]
    less = count(before).select(*keys, *[(-F.col(name)).alias(name) for name in numbers])
    parts = [kept, less, count(after).select(*kept.columns)]
    summed = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[F.sum(name).alias(name) for name in numbers])
    return summed.where(reduce(lambda a, b: a | b, [F.col(name) != 0 for name in numbers]))


@dataclass(frozen=True)
class KeptCounts:
    """Counts of tasks and tickets per site, and the index of due dates. Rows without a site have a null one."""

    tasks: DataFrame
    due: DataFrame
    tickets: DataFrame

    @staticmethod
    def of(tasks: DataFrame, tickets: DataFrame) -> KeptCounts:
        """Counted from all rows, to begin with."""
        return KeptCounts(task_counts(tasks).drop("scadute"), due_index(tasks), ticket_counts(tickets))

    def after_tasks(self, before: DataFrame, after: DataFrame) -> KeptCounts:
        """After the changed tasks ``before`` became ``after``; new tasks have none before."""
        counted = changed_by(self.tasks, [SITE], lambda rows: task_counts(rows).drop("scadute"), before, after)
        return KeptCounts(counted, changed_by(self.due, [SITE, DUE], due_index, before, after), self.tickets)

    def after_tickets(self, before: DataFrame, after: DataFrame) -> KeptCounts:
        return KeptCounts(self.tasks, self.due, changed_by(self.tickets, [SITE], ticket_counts, before, after))

    def task_part(self, as_of: dt.date) -> DataFrame:
        """What ``task_counts`` gives for a day."""
        late = overdue(self.due, as_of).withColumnRenamed(SITE, "_site")
        joined = self.tasks.join(late, F.col(SITE).eqNullSafe(F.col("_site")), "left").drop("_site")
        return joined.withColumn("scadute", F.coalesce("scadute", F.lit(0)).cast("bigint"))

    def kpis(self, sites: DataFrame, as_of: dt.date) -> DataFrame:
        return kpis_of(sites, self.task_part(as_of), self.tickets)

    def progress(self, sites: DataFrame) -> DataFrame:
        return progress_of(sites, self.tasks)

    def risk(self, sites: DataFrame, as_of: dt.date, brand: Brand = NO_BRAND) -> DataFrame:
        return with_risk(counters_of(sites, self.task_part(as_of), self.tickets), brand)


def changed_rows(existing: DataFrame, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The rows that a change set hits, as they were and as they are then."""
    before = existing.join(changes.select("id").distinct(), "id", "left_semi")
    return before, apply(before, changes)
