"""Sorted lists and the first k rows of each site.

Every order ends with the id, so that a cut is repeatable. Ascending order puts
nulls first. A cut per site is ``row_number() <= k``: Spark then keeps k rows
per site inside every input partition before the shuffle, so a hot site costs
k rows per partition and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions import predicates as p
from siteloom.functions import scalars as s
from siteloom.operators.counts import SITE


def by_due_date() -> list[Column]:
    return [F.col("scadenza").asc(), F.col("id").asc()]


def by_priority_rank() -> list[Column]:
    return [s.priority_rank(F.col("priorita")).asc(), *by_due_date()]


def by_priority_name() -> list[Column]:
    """Alphabetical priority: Alta, Bassa, Critica, Media."""
    return [F.col("priorita").asc(), *by_due_date()]


def newest_created_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id").asc()]


def newest_id_first() -> list[Column]:
    return [F.col("id").desc()]


def by_name() -> list[Column]:
    return [F.col("nome").asc(), F.col("id").asc()]


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of every group, numbered in ``posizione``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("posizione", F.row_number().over(window)).where(F.col("posizione") <= k)


def top_per_site(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    return top_per_group(rows, [SITE], order, k)


TASK_LIST = ["titolo", "assegnato_a", "stato", "scadenza", "percentuale"]
TASK_CARD = ["fase", "titolo", "assegnato_a", "stato", "priorita", "scadenza", "percentuale"]
TICKET_CARD = ["tipo", "titolo", "responsabile", "stato", "priorita", "scadenza", "impatto"]


def next_tasks(tasks: DataFrame, k: int = 5) -> DataFrame:
    """Next unfinished tasks of every site by due date."""
    unfinished = tasks.where(p.task_unfinished_strict(F.col("stato")))
    return top_per_site(unfinished.select(SITE, "id", *TASK_LIST), by_due_date(), k)


def urgent_tasks(tasks: DataFrame, k: int = 8) -> DataFrame:
    unfinished = tasks.where(p.task_unfinished_strict(F.col("stato")))
    return top_per_site(unfinished.select(SITE, "id", *TASK_CARD), by_priority_rank(), k)


def tickets_to_unblock(tickets: DataFrame, k: int = 6) -> DataFrame:
    open_rows = tickets.where(p.ticket_open_strict(F.col("stato")))
    return top_per_site(open_rows.select(SITE, "id", *TICKET_CARD), by_priority_rank(), k)


def section_lists(
    rows: DataFrame, sections: dict[str, Column], order: list[Column], line: Column, k: int
) -> DataFrame:
    """Per site, one array of at most k lines for each section.

    A row may belong to several sections. All sections share one pass: rows are
    tagged, cut to k per site and section, and only then collected, so no array
    holds more than k lines.
    """
    if len(sections) == 1:
        # the site alone is the key of both the cut and the collection: one shuffle for both
        (flag,) = sections.values()
        first = top_per_site(rows.where(flag).withColumn("_section", F.lit(0)), order, k)
    else:
        numbers = F.array_compact(F.array(*[F.when(flag, F.lit(i)) for i, flag in enumerate(sections.values())]))
        first = top_per_group(rows.withColumn("_section", F.explode(numbers)), [SITE, "_section"], order, k)
    lines = first.select(SITE, "_section", F.struct("posizione", line.alias("riga")).alias("_line"))
    return lines.groupBy(SITE).agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("_section") == i, F.col("_line")))),
                lambda item: item["riga"],
            ).alias(name)
            for i, name in enumerate(sections)
        ]
    )


def bullets(lines: Column, k: int | None = None, empty: str = v.NO_ROWS_BULLET) -> Column:
    """Lines of a bullet list as one text; no lines print the fallback."""
    kept = F.slice(lines, 1, k) if k else lines
    joined = F.array_join(kept, "\n")
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, joined).otherwise(F.lit(empty))


def task_line() -> Column:
    percent = s.whole_percent(F.col("percentuale")).cast("string")
    return F.concat(F.lit("- "), s.text(F.col("titolo")), F.lit(" ("), percent, F.lit("%)"))


def ticket_line() -> Column:
    return F.concat(F.lit("- "), s.text(F.col("titolo")))
