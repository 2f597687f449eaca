"""The seven tables: column types, defaults and keys.

Timestamps are zone-less UTC wall-clock values. Due dates stay text, because
lists sort on the raw text; the parsed date is only used to find overdue rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES = {
    "long": LongType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "string": StringType(),
    "ts": TimestampNTZType(),
}


def _struct(spec: str) -> StructType:
    columns = (item.split(":") for item in spec.split())
    return StructType([StructField(name, _TYPES[kind], True) for name, kind in columns])


SCHEMAS: dict[str, StructType] = {
    "cantieri": _struct(
        "id:long nome:string indirizzo:string cliente:string capo_cantiere:string stato:string "
        "data_inizio:string data_fine_prevista:string note:string created_at:ts"
    ),
    "artigiani": _struct(
        "id:long nome:string ruolo:string telefono:string email:string note:string attivo:int created_at:ts"
    ),
    "attivita": _struct(
        "id:long cantiere_id:long fase:string titolo:string descrizione:string assegnato_a:string "
        "dipende_da_id:long stato:string priorita:string scadenza:string percentuale:long note:string "
        "created_at:ts closed_at:ts"
    ),
    "ticket": _struct(
        "id:long cantiere_id:long tipo:string titolo:string descrizione:string aperto_da:string "
        "responsabile:string priorita:string stato:string impatto:string scadenza:string "
        "attivita_id:long foto_link:string created_at:ts closed_at:ts"
    ),
    "aggiornamenti": _struct(
        "id:long cantiere_id:long autore:string testo:string categoria:string created_at:ts"
    ),
    "budget_cantiere": _struct(
        "id:long cantiere_id:long budget_iniziale:double costo_effettivo:double extra_approvati:double "
        "note_budget:string updated_at:ts"
    ),
    "notifiche": _struct(
        "id:long cantiere_id:long ticket_id:long destinatario:string telefono:string canale:string "
        "messaggio:string stato:string risposta:string created_at:ts sent_at:ts responded_at:ts"
    ),
}

MESSAGE_SCHEMA = _struct("id:long cantiere_id:long autore:string testo:string created_at:ts")

# What a column holds when an insert leaves it out.
DEFAULTS: dict[str, dict[str, object]] = {
    "cantieri": {"stato": "Attivo"},
    "artigiani": {"attivo": 1},
    "attivita": {"stato": "Da fare", "priorita": "Media", "percentuale": 0},
    "ticket": {"priorita": "Media", "stato": "Aperto"},
    "aggiornamenti": {},
    "budget_cantiere": {"budget_iniziale": 0.0, "costo_effettivo": 0.0, "extra_approvati": 0.0},
    "notifiche": {"canale": "WhatsApp", "stato": "Preparata"},
}

# The text column an insert must not leave blank.
REQUIRED_TEXT = {
    "cantieri": "nome",
    "artigiani": "nome",
    "attivita": "titolo",
    "ticket": "titolo",
}

# (child table, child column, parent table)
FOREIGN_KEYS = [
    ("attivita", "cantiere_id", "cantieri"),
    ("ticket", "cantiere_id", "cantieri"),
    ("ticket", "attivita_id", "attivita"),
    ("aggiornamenti", "cantiere_id", "cantieri"),
    ("budget_cantiere", "cantiere_id", "cantieri"),
    ("notifiche", "cantiere_id", "cantieri"),
    ("notifiche", "ticket_id", "ticket"),
]

# Children come before their parents.
PURGE_ORDER = [
    "notifiche",
    "budget_cantiere",
    "aggiornamenti",
    "ticket",
    "attivita",
    "artigiani",
    "cantieri",
]


class SiteTables:
    """One handle on the seven tables, as attributes.

    A table may be given as a function; it is called when the table is first used.
    """

    NAMES = tuple(SCHEMAS)

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        if set(tables) != set(self.NAMES):
            raise ValueError(f"expected the tables {', '.join(self.NAMES)}")
        self._tables = tables

    def __getitem__(self, name: str) -> DataFrame:
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    def __getattr__(self, name: str) -> DataFrame:
        if name in type(self).NAMES:
            return self[name]
        raise AttributeError(name)

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, self[name]) for name in self.NAMES]

    def replaced(self, name: str, rows: DataFrame) -> SiteTables:
        """The same tables but one."""
        return SiteTables(**{**self._tables, name: rows})


def conform(df: DataFrame, table: str) -> DataFrame:
    """The declared columns in the declared order and types; a column that is missing becomes null."""
    return df.to(SCHEMAS[table])


def with_defaults(df: DataFrame, table: str, now=None) -> DataFrame:
    """Complete an insert batch: only a column that the batch leaves out takes its default.

    A column that is present keeps its nulls, as an explicit null does in an insert.
    """
    have = set(df.columns)
    stamps = {"created_at": now, "updated_at": now}
    filled = {
        f.name: F.lit(value).cast(f.dataType)
        for f in SCHEMAS[table].fields
        for value in [DEFAULTS[table].get(f.name, stamps.get(f.name))]
        if f.name not in have and value is not None
    }
    return conform(df.withColumns(filled) if filled else df, table)
