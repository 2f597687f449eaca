"""Joins between the tables, contact resolution and the orphan report.

Site and ticket tables grow with the business, so no join here forces a
broadcast: Spark broadcasts a side only when its measured size is under the
session's threshold, and otherwise splits the partitions of hot keys at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import predicates as p
from siteloom.functions import scalars as s
from siteloom.operators.counts import SITE
from siteloom.schema import FOREIGN_KEYS, SiteTables
from siteloom.sources.scratch import written

TICKET_VIEW = ["tipo", "titolo", "responsabile", "priorita", "stato", "scadenza", "impatto"]
TASK_VIEW = ["fase", "titolo", "assegnato_a", "stato", "priorita", "scadenza", "percentuale"]


def by_keys(rows: DataFrame, keys: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose key is listed; one lookup of many keys instead of many lookups of one."""
    return rows.join(keys.select(column).distinct(), column, "left_semi")


def with_site_name(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Inner join that adds the site name as ``cantiere``; orphans drop out."""
    names = sites.select(F.col("id").alias(SITE), F.col("nome").alias("cantiere"))
    return rows.join(names, SITE, "inner")


def open_tickets_with_site(tickets: DataFrame, sites: DataFrame) -> DataFrame:
    rows = tickets.where(p.ticket_open_strict(F.col("stato"))).select("id", SITE, *TICKET_VIEW)
    return with_site_name(rows, sites)


def tasks_with_site(tasks: DataFrame, sites: DataFrame) -> DataFrame:
    return with_site_name(tasks.select("id", SITE, *TASK_VIEW), sites)


def _spread_null_ids(key: Column, row_id: Column) -> Column:
    """A join key in which null is replaced by a different value per row.

    Null never matches, but left alone all null rows of an outer join meet in
    one partition. The join condition still asks for the real key to be there.
    """
    return F.coalesce(key, -row_id - F.lit(1))


def notice_log(notices: DataFrame, tickets: DataFrame) -> DataFrame:
    """Notices with the title of their ticket, or null where there is none."""
    titles = tickets.select(F.col("id").alias("_t"), F.col("titolo").alias("ticket"))
    matches = (_spread_null_ids(F.col("ticket_id"), F.col("id")) == F.col("_t")) & F.col("ticket_id").isNotNull()
    return notices.join(titles, matches, "left").drop("_t")


def latest_notices(notices: DataFrame) -> DataFrame:
    """Last notice time and number of notices per ticket, within the ticket's site."""
    return (
        notices.where(F.col("ticket_id").isNotNull())
        .groupBy(SITE, "ticket_id")
        .agg(F.max("created_at").alias("ultima_notifica"), F.count(F.lit(1)).alias("notifiche"))
    )


def tickets_with_latest_notice(tickets: DataFrame, notices: DataFrame) -> DataFrame:
    """Open tickets with their last notice; a ticket without one keeps nulls."""
    open_rows = tickets.where(p.ticket_open_strict(F.col("stato")))
    latest = latest_notices(notices).withColumnRenamed("ticket_id", "id")
    return open_rows.select(SITE, "id", *TICKET_VIEW, "descrizione").join(latest, [SITE, "id"], "left")


#: characters of a gram; shorter wanted names have a path of their own
GRAM = 3
#: places in a name that an order of (count, place) has room for
PLACES = 1 << 20


def _grams(name: Column) -> Column:
    """(place, gram) of every ``GRAM`` characters in a row; places count from 1."""
    last = F.length(name) - GRAM + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last))
    return F.transform(places, lambda at: F.struct(at.alias("_at"), F.substring(name, at, F.lit(GRAM)).alias("_gram")))


def _pieces(named: DataFrame, rest: DataFrame) -> DataFrame:
    """(_crew, _key): pieces of crew names that may be wanted names, from an index of grams.

    Each wanted name is looked up by the one of its grams that fewest crew names hold; one that holds a gram of no crew
    name is found nowhere. What meets a crew name is not the wanted names but their different ways to hold the gram
    (place, length), so a name gives one piece for each, however many names are wanted by a common gram.
    """
    crew_grams = named.select("_crew", "_name", F.inline(_grams(F.col("_name"))))
    counts = crew_grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_crews"))
    wanted = rest.select("_key", F.inline(_grams(F.col("_key"))))
    rarity = F.coalesce("_crews", F.lit(0)) * PLACES + F.col("_at")
    rarest = wanted.join(counts, "_gram", "left").groupBy("_key").agg(F.min(rarity).alias("_least"))
    rarest = rarest.where(F.col("_least") >= PLACES).withColumn("_place", F.pmod("_least", F.lit(PLACES)).cast("int"))
    ways = rarest.select(F.expr(f"substring(_key, _place, {GRAM})").alias("_gram"), "_place", F.length("_key").alias("_n")).distinct()
    begin = F.col("_at") - F.col("_place") + 1
    fits = (begin >= 1) & (begin + F.col("_n") - 1 <= F.length("_name"))
    return crew_grams.join(ways, "_gram").where(fits).select("_crew", F.substring(F.col("_name"), begin, F.col("_n")).alias("_key"))


def _short_pieces(named: DataFrame) -> DataFrame:
    """(_crew, _key): pieces of crew names that are shorter than a gram."""

    def of_length(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length("_name") - n + 1, F.lit(1)))
        return F.transform(places, lambda at: F.substring(F.col("_name"), at, F.lit(n)))

    parts = [of_length(n) for n in range(1, GRAM)]
    return named.select("_crew", F.explode(F.array_distinct(F.concat(*parts))).alias("_key"))


def contact_index(names: DataFrame, crews: DataFrame, name_col: str) -> DataFrame:
    """Phone for every wanted name that finds a crew: (_key, telefono), key in lower case.

    A wanted name matches a crew whose name equals it, else one whose name
    contains it; the lowest id wins. Names that equal one are settled by a join.
    "Contains" means equality with a piece of the crew name: the names left over
    are looked up by their rarest gram, short ones among all short pieces. The
    wanted names and those left over are written once, and no name is ever
    compared with all others.
    """
    wanted = written(names.select(F.lower(F.col(name_col)).alias("_key")).where(F.length("_key") > 0).distinct(), "wanted")
    active = crews.where(p.crew_active(F.col("attivo")) & F.col("nome").isNotNull())
    named = active.select(F.col("id").alias("_crew"), F.lower(F.col("nome")).alias("_name"))
    named = named.groupBy("_name").agg(F.min("_crew").alias("_crew"))
    settled = written(wanted.join(named.withColumnRenamed("_name", "_key"), "_key", "left"), "settled")
    equal, rest = settled.where("_crew is not null"), settled.where("_crew is null").select("_key")
    held = [
        pieces.join(rest.where(size), "_key").groupBy("_key").agg(F.min("_crew").alias("_crew"))
        for pieces, size in (
            (_pieces(named, rest.where(F.length("_key") >= GRAM)), F.length("_key") >= GRAM),
            (_short_pieces(named), F.length("_key") < GRAM),
        )
    ]
    phones = crews.select(F.col("id").alias("_crew"), F.coalesce("telefono", F.lit("")).alias("telefono"))
    found = reduce(DataFrame.unionByName, [equal.select("_key", "_crew"), *held])
    return found.join(phones, "_crew").select("_key", "telefono")


def with_contact_phone(rows: DataFrame, crews: DataFrame, name_col: str, row_id: str = "id") -> DataFrame:
    """Add ``telefono`` of the crew named in ``name_col``; empty where nobody is found.

    Names are resolved once each; the rows then look their name up.
    """
    index = contact_index(rows, crews, name_col)
    wanted = F.lower(F.nullif(F.col(name_col), F.lit("")))
    # rows without a name are spread over the partitions and match nothing
    probe = F.coalesce(wanted, F.concat(F.lit("\u0000"), F.col(row_id).cast("string")))
    joined = rows.join(index, (probe == F.col("_key")) & wanted.isNotNull(), "left")
    return joined.withColumn("telefono", F.coalesce("telefono", F.lit(""))).drop("_key")


def orphans(tables: SiteTables) -> DataFrame:
    """Keys that point to no parent row, with the number of rows that hold them.

    Keys are counted first, so a hot key is one row when it meets its parent
    table, and all children of a parent meet it in one join.
    """
    by_parent: dict[str, list[DataFrame]] = {}
    for child, column, parent in FOREIGN_KEYS:
        keys = tables[child].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("chiave"))
        counted = keys.agg(F.count(F.lit(1)).alias("righe"))
        named = counted.select(F.lit(child).alias("tabella"), F.lit(column).alias("colonna"), "chiave", "righe")
        by_parent.setdefault(parent, []).append(named)
    reports = []
    for parent, parts in by_parent.items():
        ids = tables[parent].select(F.col("id").alias("_parent"))
        # an anti join would be pushed below the union and read the parent once for each child
        met = reduce(DataFrame.unionByName, parts).join(ids, F.col("chiave") == F.col("_parent"), "left")
        reports.append(met.where(F.col("_parent").isNull()).drop("_parent"))
    return reduce(DataFrame.unionByName, reports).select("tabella", "colonna", "chiave", "righe")
