"""Reading and writing the seven tables: Parquet snapshots and CSV exports.

Plain Parquet has no MERGE, and no folder is overwritten while it is read. A
snapshot is a folder with a manifest of the folders that hold each table's rows:
the table itself, batches that were added to it, ranges of ids that changes
replaced. The manifest is published last and as a whole, so what a failed job
left behind is never read, and it names the batches it holds, so that a job that
is tried again adds nothing twice. A folder without a manifest is read as plain
tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siteloom.operators.numbering import cuts_below
from siteloom.schema import PURGE_ORDER, SCHEMAS, SiteTables, conform
from siteloom.sources import states

MANIFEST = "_manifest"
BATCHES = "_lotti"
CURRENT = "_corrente"
RANGE = "fetta"
#: one row for each folder of a table: its place, its rows, its smallest and largest id, the batch that wrote it
FOLDER = "tabella string, cartella string, righe long, da long, a long, lotto string"
#: keys that rows are looked up by; files keep a Bloom filter of each
LOOKUP_KEYS = ("id", "ticket_id")


@dataclass(frozen=True)
class Folder:
    table: str
    place: str
    rows: int
    low: int | None
    high: int | None
    batch: str | None


@dataclass(frozen=True)
class Manifest:
    """Its number (0 where there is none), the folders of all tables, and the batches that were ever added."""

    number: int = 0
    folders: tuple[Folder, ...] = ()
    batches: tuple[str, ...] = ()

    def of(self, table: str) -> list[Folder]:
        return [f for f in self.folders if f.table == table]

    def places(self, table: str) -> list[str]:
        return [f.place for f in self.of(table)] if self.number else [table]


# --- the manifest ------------------------------------------------------------
def manifest(spark: SparkSession, root: str) -> Manifest:
    number, rows = states.latest(spark, f"{root}/{MANIFEST}", FOLDER)
    held = [Folder(*r) for r in rows]
    return Manifest(number, tuple(f for f in held if f.table), tuple(f.batch for f in held if not f.table))


def _commit(spark: SparkSession, root: str, old: Manifest, kept: list[Folder], new: list[tuple[str, str]], batch: str | None = None) -> None:
    """Publish the folders that are kept and the new ones (table, place), counted from what is really in them."""
    counted = [*kept]
    if new:
        sizes = [
            _read_places(spark, root, table, [place])
            .agg(F.count(F.lit(1)).alias("righe"), F.min("id").alias("da"), F.max("id").alias("a"))
            .select(F.lit(place).alias("cartella"), "righe", "da", "a")
            for table, place in new
        ]
        found = {r["cartella"]: r for r in reduce(DataFrame.unionByName, sizes).collect()}  # one row for each new folder
        counted += [Folder(table, place, *found[place][1:], batch) for table, place in new]
    names = [*old.batches, *([batch] if batch else [])]
    rows = [(f.table, f.place, f.rows, f.low, f.high, f.batch) for f in counted]
    # a batch stays known when its folders are replaced
    rows += [("", "", 0, None, None, name) for name in names]
    states.publish(spark, f"{root}/{MANIFEST}", FOLDER, rows, old.number + 1)


def _read_places(spark: SparkSession, root: str, table: str, places: list[str]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], SCHEMAS[table])
    return spark.read.schema(SCHEMAS[table]).parquet(*[f"{root}/{place}" for place in places])


def _write(rows: DataFrame, path: str, mode: str, *partitions: str) -> None:
    writer = rows.write.mode(mode)
    for key in LOOKUP_KEYS:
        if key in rows.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


# --- reading -----------------------------------------------------------------
def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return _read_places(spark, root, table, manifest(spark, root).places(table))


def read_tables(spark: SparkSession, root: str) -> SiteTables:
    held = manifest(spark, root)
    return SiteTables(**{name: _read_places(spark, root, name, held.places(name)) for name in SiteTables.NAMES})


def if_there(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The rows of a Parquet folder, or None where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def lookup(spark: SparkSession, root: str, table: str, ids: list[int]) -> DataFrame:
    """Rows with the given ids: folders of other ranges are left out, and of the others the row groups whose filter of
    ids holds none of them."""
    held = manifest(spark, root)
    hit = [f.place for f in held.of(table) if f.low is not None and any(f.low <= i <= f.high for i in ids)]
    return _read_places(spark, root, table, hit if held.number else [table]).where(F.col("id").isin(ids))


def row_counts(tables: SiteTables) -> DataFrame:
    """One row (tabella, righe) per table; only partial counts are shuffled."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("righe")).select(F.lit(name).alias("tabella"), "righe")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def restore_snapshot(spark: SparkSession, root: str) -> SiteTables:
    """Read a snapshot back; a table whose rows are not those of the manifest stops the restore."""
    tables = read_tables(spark, root)
    expected = dict.fromkeys(SiteTables.NAMES, 0)
    for folder in manifest(spark, root).folders:
        expected[folder.table] += folder.rows
    found = {r.tabella: r.righe for r in row_counts(tables).collect()}  # one row per table
    broken = sorted(name for name in expected if found[name] != expected[name])
    if broken:
        raise ValueError(f"snapshot {root} does not match its manifest: {', '.join(broken)}")
    return tables


# --- writing -----------------------------------------------------------------
def _by_site(df: DataFrame, name: str) -> DataFrame:
    """Rows ordered by site over all files; the id splits a hot site over many files."""
    key = "cantiere_id" if "cantiere_id" in SCHEMAS[name].names else "id"
    order = [key] if key == "id" else [key, "id"]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def write_snapshot(tables: SiteTables, root: str, by_site: bool = False, ranges: int = 0, batches: tuple[str, ...] = ()) -> None:
    """The seven tables as Parquet folders, then the manifest of what is really in them.

    ``by_site`` pays one shuffle per table so that every file holds a narrow
    range of sites: a query of one site then skips the files of all others.
    ``ranges`` cuts each table by id into about so many folders, so that changes
    rewrite only the ranges they hit (``replace_ranges``). ``batches`` are those
    that the tables already hold, so that they are not added again.
    """
    spark = tables.cantieri.sparkSession
    new = []
    for name, df in tables.items():
        rows = conform(df, name)
        if ranges:
            new += _write_ranges(rows, root, name, name, _cuts(rows, ranges))
        else:
            _write(_by_site(rows, name) if by_site else rows, f"{root}/{name}", "errorifexists")
            new.append((name, name))
    _commit(spark, root, Manifest(batches=batches), [], new)


def _cuts(rows: DataFrame, ranges: int) -> list[int]:
    """Ids that cut a table into ranges of about equal size."""
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx("id", shares, 10000)).first()[0] if shares else None
    return sorted(set(found or []))


def _write_ranges(rows: DataFrame, root: str, table: str, place: str, cuts: list[int], mode: str = "errorifexists") -> list[tuple[str, str]]:
    """Write rows into one folder for each range of ids between the cuts; the folders that got any."""
    cut = rows.withColumn(RANGE, cuts_below(F.col("id"), cuts)).repartitionByRange(RANGE, "id").sortWithinPartitions(RANGE, "id")
    _write(cut, f"{root}/{place}", mode, RANGE)
    written = rows.sparkSession.read.schema(f"id long, {RANGE} int").parquet(f"{root}/{place}").select(RANGE).distinct()
    # at most one row for each range
    return [(table, f"{place}/{RANGE}={r[0]}") for r in sorted(written.collect())]


def append_batch(spark: SparkSession, root: str, rows: dict[str, DataFrame], batch: str) -> bool:
    """Add rows to several tables at once; whether they were added. A batch that the manifest holds is not added again."""
    old = manifest(spark, root)
    if batch in old.batches:
        return False
    if not old.number:
        raise ValueError(f"{root} has no manifest")
    new = []
    for table, df in rows.items():
        place = f"{BATCHES}/{batch}/{table}"
        # what a try that failed has left there is replaced
        _write(conform(df, table), f"{root}/{place}", "overwrite")
        new.append((table, place))
    _commit(spark, root, old, list(old.folders), new, batch)
    return True


def append_rows(batch: DataFrame, root: str, table: str, batch_id: str | None = None) -> bool:
    """Add rows to a table; with the same ``batch_id`` only once."""
    return append_batch(batch.sparkSession, root, {table: batch}, batch_id or uuid.uuid4().hex)


def replace_ranges(spark: SparkSession, root: str, table: str, ids: DataFrame, change: Callable[[DataFrame], DataFrame], batch: str) -> list[str]:
    """Write anew only the folders whose range of ids holds some of ``ids``; their places before.

    ``change`` gets the rows of those folders and returns as many, with the same
    ids. The folders of other ranges are kept as they are. A batch that the
    manifest holds changes nothing.
    """
    state = manifest(spark, root)
    if not state.number:
        raise ValueError(f"{root} has no manifest")
    if batch in state.batches:
        return []
    own = sorted((f for f in state.of(table) if f.low is not None), key=lambda f: (f.low, f.high))
    # ranges that share ids are one; a range is found by how many end below an id
    groups: list[list[Folder]] = []
    for folder in own:
        if groups and folder.low <= max(f.high for f in groups[-1]):
            groups[-1].append(folder)
        else:
            groups.append([folder])
    ends = [max(f.high for f in group) for group in groups]
    found = ids.where(F.col("id").isNotNull()).select(cuts_below(F.col("id"), ends).alias(RANGE), "id").groupBy(RANGE).agg(F.max("id").alias("high"))
    # at most one row for each range
    hit = [groups[r[RANGE]] for r in found.collect() if r[RANGE] < len(groups) and r["high"] >= groups[r[RANGE]][0].low]
    old = [f for group in hit for f in group]
    if not old:
        return []
    rows = change(_read_places(spark, root, table, [f.place for f in old]))
    new = _write_ranges(conform(rows, table), root, table, f"{BATCHES}/{batch}/{table}", ends, "overwrite")
    _commit(spark, root, state, [f for f in state.folders if f not in old], new, batch)
    return [f.place for f in old]


def purge(spark: SparkSession, root: str) -> None:
    """A new snapshot in which every table is empty, children written before parents."""
    for name in PURGE_ORDER:
        _write(spark.createDataFrame([], SCHEMAS[name]), f"{root}/{name}", "errorifexists")
    _commit(spark, root, Manifest(), [], [(name, name) for name in PURGE_ORDER])


def load_if_empty(spark: SparkSession, root: str, seed: SiteTables) -> bool:
    """Write the seed only where no site is held yet, also into a place that does not exist.

    Rows of a load that failed half-way are in no manifest, so the next load replaces them.
    """
    old = manifest(spark, root)
    if any(f.rows for f in old.of("cantieri")):
        return False
    new = []
    for name, df in seed.items():
        place = f"{BATCHES}/carico/{name}"
        _write(conform(df, name), f"{root}/{place}", "overwrite")
        new.append((name, place))
    _commit(spark, root, old, [], new)
    return True


# --- a store of snapshots ------------------------------------------------------
def current(spark: SparkSession, store: str) -> str | None:
    """The snapshot of a store that counts now."""
    _, rows = states.latest(spark, f"{store}/{CURRENT}", "cartella string")
    return f"{store}/{rows[0][0]}" if rows else None


def make_current(spark: SparkSession, store: str, name: str) -> None:
    """Let a snapshot of a store count from now on, after its rows were verified: a load, a change, or an older one again."""
    restore_snapshot(spark, f"{store}/{name}")
    number, _ = states.latest(spark, f"{store}/{CURRENT}", "cartella string")
    states.publish(spark, f"{store}/{CURRENT}", "cartella string", [(name,)], number + 1)


CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def export_csv(tables: SiteTables, root: str) -> None:
    """One CSV folder per table, header in every part file, no index column.

    Quotes inside a value are doubled and line breaks stay inside their quotes.
    A null and an empty text are both written as nothing between two commas.
    The parts carry no byte-order mark: parts are meant to be read together.
    """
    for name, df in tables.items():
        conform(df, name).write.mode("errorifexists").options(**CSV).csv(f"{root}/{name}.csv")


def read_csv(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).options(**CSV, multiLine=True).csv(f"{root}/{table}.csv")


def export_reports(reports: DataFrame, root: str, file_per_site: bool = False) -> None:
    """Write report texts (report, cantiere_id, testo).

    Default: one folder per kind of report with many sites per JSON file, which
    holds for any number of sites. ``file_per_site`` writes one text file per
    site and kind, for the few sites whose files go out to people; such a file
    ends with exactly the line break that the writer adds.
    """
    if file_per_site:
        body = F.regexp_replace("testo", r"\n\z", "").alias("testo")
        rows = reports.repartition("report", "cantiere_id").select("report", "cantiere_id", body)
        rows.write.mode("errorifexists").partitionBy("report", "cantiere_id").text(root)
    else:
        reports.select("report", "cantiere_id", "testo").write.mode("errorifexists").partitionBy("report").json(root)


def read_reports(spark: SparkSession, root: str, file_per_site: bool = False) -> DataFrame:
    schema = "cantiere_id long, testo string, report string"
    if file_per_site:
        pages = spark.read.schema("value string, report string, cantiere_id long")
        rows = pages.text(root, wholetext=True).withColumnRenamed("value", "testo")
    else:
        rows = spark.read.schema(schema).json(root)
    return rows.select("report", "cantiere_id", "testo")
