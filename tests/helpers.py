from __future__ import annotations

import datetime as dt

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

from siteloom.schema import SCHEMAS, SiteTables

DAY = dt.date(2024, 5, 6)


def make_tables(spark, **rows) -> SiteTables:
    """Site tables from dict rows; columns that are left out become null."""
    made = {}
    for name in SiteTables.NAMES:
        arrow = to_arrow_schema(SCHEMAS[name])
        values = [{f: row.get(f) for f in arrow.names} for row in rows.get(name, [])]
        made[name] = spark.createDataFrame(pa.Table.from_pylist(values, arrow)).to(SCHEMAS[name])
    return SiteTables(**made)


def demo_tables(spark, day: dt.date = DAY) -> SiteTables:
    """The golden demo site: five tasks, one decision ticket, one budget row."""

    def due(n: int) -> str:
        return str(day + dt.timedelta(days=n))

    tasks = [
        ("In corso", "Alta", 2, 60, None),
        ("Da fare", "Alta", 4, 0, 1),
        ("Da fare", "Alta", 7, 0, 2),
        ("Da fare", "Media", 5, 0, None),
        ("Da fare", "Media", 15, 0, 3),
    ]
    return make_tables(
        spark,
        cantieri=[{"id": 1, "nome": "Demo", "cliente": "Client", "capo_cantiere": "Lead", "stato": "Attivo", "data_inizio": due(0), "data_fine_prevista": due(45)}],
        artigiani=[{"id": i, "nome": n, "attivo": 1} for i, n in enumerate(("Mason", "Plumber", "Electrician", "Tiler"), 1)],
        attivita=[
            {"id": i, "cantiere_id": 1, "titolo": f"Task {i}", "stato": s, "priorita": p, "scadenza": due(d), "percentuale": pc, "dipende_da_id": dep}
            for i, (s, p, d, pc, dep) in enumerate(tasks, 1)
        ],
        ticket=[{"id": 1, "cantiere_id": 1, "tipo": "Richiesta decisione", "titolo": "Confirm position", "priorita": "Alta", "stato": "Aperto", "scadenza": due(1)}],
        budget_cantiere=[{"id": 1, "cantiere_id": 1, "budget_iniziale": 48000.0, "costo_effettivo": 18500.0, "extra_approvati": 1200.0, "note_budget": "demo"}],
    )


def one(spark, expression, **columns):
    """Value of a column expression on a single row of typed columns, given as name=(type, value)."""
    schema = ", ".join(f"{name} {kind}" for name, (kind, _) in columns.items())
    row = tuple(value for _, value in columns.values())
    return spark.createDataFrame([row], schema).select(expression.alias("x")).first()["x"]




def same(a, b) -> bool:
    """Equal as multisets of rows."""
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))
