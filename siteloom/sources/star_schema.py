"""The seven site tables and the message feed, derived from a star-schema dataset.

Each view is one SELECT over one or two Parquet tables. The texts use only SQL
that is common to Spark and other engines. ``{ts}`` stands for the engine's name
of a zone-less timestamp, ``{repeat}`` and ``{end}`` for its way to repeat a row
n times, numbered from 1 as ``k.k``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from siteloom.schema import MESSAGE_SCHEMA, SiteTables, conform

VIEW_SQL: dict[str, str] = {
    "cantieri": """
SELECT c_custkey AS id, c_name AS nome, 'Nation ' || CAST(c_nationkey AS STRING) AS indirizzo,
       CASE WHEN c_custkey % 25 = 3 THEN NULL ELSE c_mktsegment END AS cliente,
       'Lead ' || CAST(c_custkey % 17 AS STRING) AS capo_cantiere,
       CASE c_custkey % 8 WHEN 0 THEN 'In pausa' WHEN 1 THEN 'Completato' WHEN 2 THEN 'Archiviato' ELSE 'Attivo' END AS stato,
       CAST(DATE '2023-01-01' + CAST(c_custkey % 700 AS INT) AS STRING) AS data_inizio,
       CASE WHEN c_custkey % 12 = 5 THEN NULL ELSE CAST(DATE '2023-02-15' + CAST(c_custkey % 700 AS INT) AS STRING) END AS data_fine_prevista,
       CASE WHEN c_custkey % 5 = 0 THEN 'note ' || c_name END AS note,
       CAST(CAST(DATE '2023-01-01' + CAST(c_custkey % 700 AS INT) AS STRING) || ' 08:00:00' AS {ts}) AS created_at
FROM customer""",
    "artigiani": """
SELECT s_suppkey AS id, s_name AS nome,
       CASE s_nationkey % 5 WHEN 0 THEN 'Muratore' WHEN 1 THEN 'Idraulico' WHEN 2 THEN 'Elettricista' WHEN 3 THEN 'Pavimentista' ELSE 'Tinteggiatore' END AS ruolo,
       CASE s_suppkey % 4 WHEN 0 THEN '+39 339 ' || lpad(CAST(s_suppkey AS STRING), 7, '0')
                          WHEN 1 THEN '0039-340.' || lpad(CAST(s_suppkey AS STRING), 7, '0')
                          WHEN 2 THEN '(341) ' || lpad(CAST(s_suppkey AS STRING), 7, '0') ELSE NULL END AS telefono,
       'crew' || CAST(s_suppkey AS STRING) || '@example.org' AS email,
       CASE WHEN s_suppkey % 3 = 0 THEN 'squad ' || CAST(s_suppkey AS STRING) END AS note,
       CASE WHEN s_suppkey % 9 = 5 THEN 0 ELSE 1 END AS attivo,
       CAST('2023-01-01 08:00:00' AS {ts}) AS created_at
FROM supplier""",
    "attivita": """
SELECT o_orderkey AS id, CASE WHEN o_custkey % 40 = 9 THEN 800000000 + o_custkey ELSE o_custkey END AS cantiere_id,
       'Fase ' || CAST(o_orderkey % 13 AS STRING) AS fase, 'Task ' || CAST(o_orderkey AS STRING) AS titolo,
       'total ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS descrizione,
       CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Supplier#' || lpad(CAST(o_orderkey % 10 AS STRING), 9, '0') END AS assegnato_a,
       CASE WHEN o_orderkey % 7 = 3 THEN o_orderkey - 1 END AS dipende_da_id,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL
            WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Completata' ELSE 'Verificata' END
            WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'In corso' ELSE 'Da fare' END
            ELSE CASE WHEN o_orderkey % 9 = 0 THEN 'Bloccata' WHEN o_orderkey % 2 = 0 THEN 'In corso' ELSE 'Da fare' END END AS stato,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Critica' WHEN '2' THEN 'Alta' WHEN '3' THEN 'Media' WHEN '5' THEN 'Bassa' END AS priorita,
       CASE WHEN o_orderkey % 83 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'n/d'
            ELSE CAST(CAST(o_orderdate + INTERVAL 14 DAYS AS DATE) AS STRING) END AS scadenza,
       CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN 130 WHEN o_orderkey % 61 = 0 THEN -5
            ELSE (o_orderkey * 7 % 21) * 5 END AS percentuale,
       CASE o_orderkey % 4 WHEN 0 THEN 'note ' || CAST(o_orderkey AS STRING) WHEN 1 THEN '' END AS note,
       CAST(o_orderdate AS {ts}) AS created_at,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN CAST(o_orderdate + INTERVAL 10 DAYS AS {ts}) END AS closed_at
FROM orders""",
    "ticket": """
SELECT event_id AS id,
       CASE WHEN event_id % 200 = 199 THEN 900000000 + event_id ELSE user_id * 10 + event_id % 7 END AS cantiere_id,
       CASE event_type WHEN 'error' THEN 'Blocco' WHEN 'click' THEN 'Richiesta decisione' WHEN 'purchase' THEN 'Richiesta materiale'
                       WHEN 'view' THEN 'Avanzamento' ELSE CASE event_id % 3 WHEN 0 THEN 'Rischio ritardo' WHEN 1 THEN 'Extra lavoro' ELSE 'Completamento attività' END END AS tipo,
       'Ticket ' || CAST(event_id AS STRING) AS titolo,
       CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'detail ' || props END AS descrizione,
       'Supplier#' || lpad(CAST(user_id % 9 AS STRING), 9, '0') AS aperto_da,
       CASE event_id % 16 WHEN 1 THEN 'Cliente' WHEN 2 THEN NULL WHEN 8 THEN 'plier#00000000' || CAST(user_id % 10 AS STRING) WHEN 9 THEN 'SUPPLIER#00000000'
            WHEN 12 THEN '' ELSE 'Supplier#' || lpad(CAST(user_id % 10 AS STRING), 9, '0') END AS responsabile,
       CASE WHEN value >= 150 THEN 'Critica' WHEN value >= 80 THEN 'Alta' WHEN value >= 20 THEN 'Media' WHEN event_id % 5 = 0 THEN NULL ELSE 'Bassa' END AS priorita,
       CASE event_id % 11 WHEN 0 THEN 'Bloccante' WHEN 1 THEN 'In gestione' WHEN 2 THEN 'Aperto' WHEN 3 THEN NULL
                          WHEN 4 THEN 'Chiuso' WHEN 5 THEN 'Chiuso' WHEN 6 THEN 'Chiuso' ELSE 'Risolto' END AS stato,
       CASE WHEN event_id % 4 = 0 THEN '' ELSE 'impact ' || event_type END AS impatto,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(CAST(ts + INTERVAL 2 DAYS AS DATE) AS STRING) END AS scadenza,
       CASE WHEN event_id % 10 <> 4 THEN event_id END AS attivita_id,
       CASE WHEN event_id % 9 = 1 THEN 'photos/' || CAST(event_id AS STRING) END AS foto_link,
       CAST(ts AS {ts}) AS created_at,
       CASE WHEN event_id % 11 IN (4, 7, 9) THEN CAST(ts + INTERVAL 1 DAYS AS {ts}) END AS closed_at
FROM events""",
    "budget_cantiere": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 15 = 7 THEN 800000000 + c_custkey ELSE c_custkey END AS cantiere_id,
       CASE WHEN c_custkey % 20 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(10000 + (c_custkey % 50) * 1000 AS DOUBLE) END AS budget_iniziale,
       abs(c_acctbal) * (1 + c_custkey % 6) AS costo_effettivo,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST((c_custkey % 10) * 100 AS DOUBLE) END AS extra_approvati,
       CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'note ' || c_name END AS note_budget,
       CAST('2023-06-01 08:00:00' AS {ts}) AS updated_at
FROM customer""",
    "notifiche": """
SELECT e.event_id * 10 + k.k AS id, e.user_id * 10 + e.event_id % 7 AS cantiere_id,
       CASE WHEN e.event_id % 14 = 0 THEN NULL WHEN e.event_id % 50 = 48 THEN 900000000 + e.event_id ELSE e.event_id END AS ticket_id,
       'Supplier#' || lpad(CAST(e.user_id % 10 AS STRING), 9, '0') AS destinatario,
       CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE '+39 33' || CAST(e.event_id AS STRING) END AS telefono,
       CASE WHEN e.event_id % 5 = 0 THEN 'Email' ELSE 'WhatsApp' END AS canale,
       'message for ' || CAST(e.event_id AS STRING) AS messaggio,
       CASE k.k WHEN 1 THEN 'Preparata' WHEN 2 THEN 'Inviata manualmente' ELSE CASE WHEN e.event_id % 4 = 0 THEN 'Chiusa' ELSE 'Risposta ricevuta' END END AS stato,
       CASE WHEN k.k = 3 THEN 'ok' WHEN k.k = 2 THEN '' ELSE NULL END AS risposta,
       CAST(CASE k.k WHEN 1 THEN e.ts + INTERVAL 1 HOURS WHEN 2 THEN e.ts + INTERVAL 2 HOURS ELSE e.ts + INTERVAL 3 HOURS END AS {ts}) AS created_at,
       CASE WHEN k.k = 2 THEN CAST(e.ts + INTERVAL 2 HOURS AS {ts}) END AS sent_at,
       CASE WHEN k.k = 3 THEN CAST(e.ts + INTERVAL 5 HOURS AS {ts}) END AS responded_at
FROM events e {repeat}1 + e.event_id % 3{end}""",
    "messaggi": """
SELECT conv_id * 1000 + turn AS id, conv_id AS cantiere_id, role AS autore,
       CASE (conv_id + turn) % 9
         WHEN 0 THEN 'Sono fermo, manca il materiale. Urgente ' || text WHEN 1 THEN 'Non posso proseguire oggi ' || text
         WHEN 2 THEN 'Servono le piastrelle. Grazie ' || text WHEN 3 THEN 'Serve conferma del cliente sui sanitari ' || text
         WHEN 4 THEN 'Ho finito le tracce, ma manca conferma posizione termoarredo. Domani non posso chiudere. ' || text
         WHEN 5 THEN 'Arrivo subito ' || text WHEN 6 THEN '   ' || text || '  ' WHEN 7 THEN '. punto iniziale ' || text ELSE text END AS testo,
       CAST(CAST(DATE '2024-01-01' + CAST(conv_id % 28 AS INT) AS STRING) || ' 08:00:00' AS {ts}) AS created_at
FROM conversations""",
    "aggiornamenti": """
SELECT conv_id * 1000 + turn AS id, conv_id AS cantiere_id, role AS autore, text AS testo,
       CASE WHEN turn % 2 = 0 THEN 'Avanzamento' END AS categoria,
       CAST(CAST(DATE '2024-01-01' + CAST(conv_id % 28 AS INT) AS STRING) || ' 09:00:00' AS {ts}) AS created_at
FROM conversations""",
}

SPARK_WORDS = {
    "ts": "TIMESTAMP_NTZ",
    "repeat": "LATERAL VIEW explode(slice(array(1, 2, 3, 4), 1, CAST(",
    "end": " AS INT))) k AS k",
}

BASE_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

_BASE = {
    "cantieri": "customer",
    "artigiani": "supplier",
    "attivita": "orders",
    "ticket": "events",
    "budget_cantiere": "customer",
    "notifiche": "events",
    "messaggi": "conversations",
    "aggiornamenti": "conversations",
}


@dataclass(frozen=True)
class StarSchema:
    """Lazy access to the derived views of one dataset directory."""

    spark: SparkSession
    root: str

    def _view(self, name: str) -> DataFrame:
        base = _BASE[name]
        source = self.spark.read.schema(BASE_SCHEMAS[base]).parquet(f"{self.root}/{base}.parquet")
        statement = VIEW_SQL[name].format(**SPARK_WORDS).replace(f"FROM {base}", f"FROM {{{base}}}")
        return self.spark.sql(statement, **{base: source})

    def table(self, name: str) -> DataFrame:
        return conform(self._view(name), name)

    def messages(self) -> DataFrame:
        return self._view("messaggi").select(*MESSAGE_SCHEMA.names)

    def tables(self) -> SiteTables:
        return SiteTables(**{name: partial(self.table, name) for name in SiteTables.NAMES})
