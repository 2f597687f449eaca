"""Plans that must hold at any size, and results when one site holds a third of all rows."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from siteloom.operators import counts, lists, lookups
from siteloom.schema import FOREIGN_KEYS, SCHEMAS
from tests.conftest import SMALL

WRITES = ("s09", "s10", "s11", "s12", "s13", "t0")
NUMBERED = ("s05", "s06")  # these give ids


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """What a join plan looks like when no table is small."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(WRITES)])
def test_plan_holds_at_any_size(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "PythonUDF"):
        assert bad not in plan
    windows = [line for line in plan.splitlines() if " Window [" in line]
    if name.startswith(NUMBERED):
        # rows are numbered inside their slice; the offsets are one row per slice
        assert windows and all("_slice" in line for line in windows)
    else:
        assert all("cantiere_id" in line for line in windows)
        assert plan.count("WindowGroupLimit") == 2 * len(windows)
    if not name.startswith(("j08", "j10", "j11", "m10_triage_by_words", "m27", "r12", "s05", "s06")):
        assert "BroadcastHashJoin" not in plan


def test_orphans_join_each_parent_once(spark, no_broadcast):
    """All children of a parent meet it in one join."""
    parents = len({parent for _, _, parent in FOREIGN_KEYS})
    assert plan_of(QUERIES["j09_orphans"](spark, SMALL)).count("SortMergeJoin") == parents


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith(("s07", "s08", "m16"))])
def test_change_sets_are_folded_by_hashing(spark, no_broadcast, name):
    """Keys and stamps are numbers, so that no aggregation of changes sorts them."""
    assert "SortAggregate" not in plan_of(QUERIES[name](spark, SMALL))


@pytest.mark.parametrize(
    "name, columns",
    [
        ("p02_open_tickets_strict", {"event_id", "user_id"}),
        ("a03_tasks_by_state", {"o_orderkey", "o_orderstatus"}),
        ("p10_active_crews", {"s_suppkey", "s_name", "s_nationkey"}),
        ("m13_clean_phone", {"s_suppkey"}),
    ],
)
def test_only_needed_columns_are_read(spark, name, columns):
    plan = plan_of(QUERIES[name](spark, SMALL))
    read = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {part.split(":")[0] for part in read.split(",")} == columns


def test_filters_reach_a_snapshot_scan(spark, tables, tmp_path):
    root = str(tmp_path / "attivita")
    tables.attivita.write.parquet(root)
    stored = spark.read.schema(SCHEMAS["attivita"]).parquet(root)
    plan = plan_of(lists.next_tasks(counts.in_scope(stored, 5)))
    assert "EqualTo(cantiere_id,5)" in plan and "Not(In(stato" in plan
    assert "descrizione" not in plan.split("ReadSchema")[1]


# --- one hot site ----------------------------------------------------------
HOT, ROWS = 7, 30_000


@pytest.fixture(scope="module")
def skewed(spark):
    ids = spark.range(ROWS, numPartitions=6)
    site = F.when(F.col("id") % 3 == 0, F.lit(HOT)).otherwise(F.col("id") % 500).cast("bigint")
    tickets = ids.select(
        "id",
        site.alias("cantiere_id"),
        F.lit("Blocco").alias("tipo"),
        F.concat(F.lit("T"), "id").alias("titolo"),
        F.element_at(F.array(*[F.lit(x) for x in ("Alta", "Critica", "Media", "Bassa")]), (F.col("id") % 4 + 1).cast("int")).alias("priorita"),
        F.when(F.col("id") % 5 == 0, "Chiuso").otherwise("Aperto").alias("stato"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("id") * 7 % 28 + 1).cast("string"), 2, "0")).alias("scadenza"),
    )
    sites = spark.range(500).select("id", F.concat(F.lit("Site "), "id").alias("nome"))
    return tickets.to(SCHEMAS["ticket"]), sites.to(SCHEMAS["cantieri"])


def test_hot_site_counts(skewed):
    tickets, _ = skewed
    rows = tickets.select("cantiere_id", "stato").collect()
    expected = Counter(r.cantiere_id for r in rows if r.stato == "Aperto")
    got = {r.cantiere_id: r.ticket_aperti for r in counts.ticket_counts(tickets).collect()}
    assert got == {site: expected[site] for site in {r.cantiere_id for r in rows}}
    assert got[HOT] > ROWS / 4


def test_hot_site_top_list(skewed):
    tickets, _ = skewed
    rank = {"Critica": 1, "Alta": 2, "Media": 3}
    by_site = defaultdict(list)
    for r in tickets.where("stato = 'Aperto'").collect():
        by_site[r.cantiere_id].append((rank.get(r.priorita, 4), r.scadenza, r.id))
    expected = {(site, i) for site, found in by_site.items() for _, _, i in sorted(found)[:6]}
    got = lists.tickets_to_unblock(tickets, 6)
    assert {(r.cantiere_id, r.id) for r in got.collect()} == expected


def test_hot_site_join_is_split(spark, no_broadcast, skewed):
    """The partition of the hot site is read by several tasks of the join."""
    tickets, sites = skewed
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    old = {key: spark.conf.get(key) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        joined = lookups.with_site_name(tickets, sites)
        assert joined.count() == ROWS
        counted = joined.groupBy("cantiere").count()
        rows = {r.cantiere: r["count"] for r in counted.collect()}
        assert rows[f"Site {HOT}"] == tickets.where(F.col("cantiere_id") == HOT).count()
        ordered = joined.select("id", "cantiere")
        ordered.collect()
        assert "skew=true" in plan_of(ordered)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
