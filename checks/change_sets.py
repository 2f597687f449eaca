"""Change sets made from the site tables, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from siteloom.sources.star_schema import SPARK_WORDS

SETS: dict[str, tuple[str, str]] = {
    # up to three full-form updates per task
    "task_changes": (
        "attivita",
        """
SELECT a.id AS id, k.k AS seq,
       CAST(CASE k.k WHEN 1 THEN '2024-01-15 09:00:00' WHEN 2 THEN '2024-01-15 10:00:00' ELSE '2024-01-15 11:00:00' END AS {ts}) AS ts,
       CASE (a.id + k.k * 2) % 5 WHEN 0 THEN 'Da fare' WHEN 1 THEN 'In corso' WHEN 2 THEN 'Bloccata' WHEN 3 THEN 'Completata' ELSE 'Verificata' END AS stato,
       CASE (a.id + k.k) % 4 WHEN 0 THEN 'Bassa' WHEN 1 THEN 'Media' WHEN 2 THEN 'Alta' ELSE 'Critica' END AS priorita,
       CAST((a.id * k.k) % 140 - 10 AS BIGINT) AS percentuale,
       CASE WHEN (a.id + k.k) % 6 = 0 THEN NULL ELSE 'rev ' || CAST(k.k AS STRING) END AS note
FROM attivita a {repeat}a.id % 4{end}""",
    ),
    # up to four updates per ticket, closing and reopening
    "ticket_changes": (
        "ticket",
        """
SELECT t.id AS id, k.k AS seq,
       CAST(CASE k.k WHEN 1 THEN '2024-02-15 09:00:00' WHEN 2 THEN '2024-02-15 10:00:00' WHEN 3 THEN '2024-02-15 11:00:00' ELSE '2024-02-15 12:00:00' END AS {ts}) AS ts,
       CASE (t.id % 7 + k.k * k.k) % 5 WHEN 0 THEN 'Aperto' WHEN 1 THEN 'Chiuso' WHEN 2 THEN 'Risolto' WHEN 3 THEN 'In gestione' ELSE 'Chiuso' END AS stato,
       CASE (t.id + k.k) % 4 WHEN 0 THEN 'Bassa' WHEN 1 THEN 'Media' WHEN 2 THEN 'Alta' ELSE 'Critica' END AS priorita,
       CASE WHEN (t.id + k.k) % 5 = 0 THEN NULL ELSE 'Owner ' || CAST(k.k AS STRING) END AS responsabile,
       'impact ' || CAST(k.k AS STRING) AS impatto
FROM ticket t {repeat}t.id % 5{end}""",
    ),
    # up to three quick updates per task, two of them at one moment, some with a blank note
    "quick_updates": (
        "attivita",
        """
SELECT a.id AS id, k.k AS seq, CAST(CASE k.k WHEN 1 THEN '2024-01-15 09:30:00' ELSE '2024-01-15 10:45:00' END AS {ts}) AS ts,
       CASE (a.id + k.k) % 3 WHEN 0 THEN 'In corso' WHEN 1 THEN 'Completata' ELSE 'Bloccata' END AS stato,
       CASE (a.id + k.k) % 2 WHEN 0 THEN 'Alta' ELSE 'Media' END AS priorita,
       CAST((a.id * k.k) % 130 AS BIGINT) AS percentuale,
       CASE (a.id + k.k) % 5 WHEN 0 THEN '   ' WHEN 1 THEN NULL ELSE ' note ' || CAST(k.k AS STRING) || ' by ' || COALESCE(a.assegnato_a, 'nobody') || ' ' END AS nota
FROM attivita a {repeat}a.id % 4{end}""",
    ),
    # one reply per notice
    "replies": (
        "notifiche",
        """
SELECT n.id AS id, n.id AS seq, CAST('2024-03-01 09:30:00' AS {ts}) AS ts,
       CASE n.id % 4 WHEN 0 THEN 'Preparata' WHEN 1 THEN 'Inviata manualmente' WHEN 2 THEN 'Risposta ricevuta' ELSE 'Chiusa' END AS stato,
       CASE n.id % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE 'reply ' || CAST(n.id AS STRING) END AS risposta,
       CASE n.id % 6 WHEN 0 THEN 'Non modificare' WHEN 1 THEN 'Chiuso' WHEN 2 THEN 'Aperto' WHEN 3 THEN 'Risolto' WHEN 4 THEN 'In gestione' END AS stato_ticket
FROM notifiche n""",
    ),
    # up to two budget revisions per site
    "budget_changes": (
        "cantieri",
        """
SELECT c.id AS cantiere_id,
       CASE WHEN (c.id + k.k) % 9 = 0 THEN NULL ELSE CAST(20000 + (c.id % 30) * 500 + k.k AS DOUBLE) END AS budget_iniziale,
       CAST((c.id % 11) * 1000 AS DOUBLE) AS costo_effettivo,
       CASE WHEN c.id % 4 = 1 THEN NULL ELSE CAST(k.k * 100 AS DOUBLE) END AS extra_approvati,
       'revision ' || CAST(k.k AS STRING) AS note_budget,
       CAST(CASE k.k WHEN 1 THEN '2024-01-10 08:00:00' ELSE '2024-01-12 08:00:00' END AS {ts}) AS updated_at
FROM cantieri c {repeat}1 + c.id % 2{end}""",
    ),
    # typed rows: some names are blank or padded, some dates are left open
    "new_sites": (
        "cantieri",
        """
SELECT c.id AS richiesta, CASE c.id % 7 WHEN 0 THEN '  ' WHEN 1 THEN NULL WHEN 2 THEN '  New ' || c.nome || ' ' ELSE 'New ' || c.nome END AS nome,
       c.cliente AS cliente, c.indirizzo AS indirizzo, CASE WHEN c.id % 3 = 0 THEN c.data_inizio END AS data_inizio, c.data_fine_prevista AS data_fine_prevista
FROM cantieri c""",
    ),
    "new_crews": (
        "artigiani",
        """
SELECT a.id AS richiesta, CASE a.id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || a.nome ELSE a.nome || ' bis' END AS nome, a.ruolo AS ruolo, a.telefono AS telefono
FROM artigiani a""",
    ),
    "new_tasks": (
        "attivita",
        """
SELECT a.id AS richiesta, a.cantiere_id AS cantiere_id, CASE a.id % 9 WHEN 0 THEN '   ' ELSE ' copy of ' || a.titolo END AS titolo, a.fase AS fase,
       a.stato AS stato, a.percentuale AS percentuale, CASE WHEN a.id % 4 = 0 THEN NULL ELSE a.scadenza END AS scadenza
FROM attivita a""",
    ),
    "new_tickets": (
        "ticket",
        """
SELECT t.id AS richiesta, t.cantiere_id AS cantiere_id, t.tipo AS tipo, CASE t.id % 8 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE ' copy of ' || t.titolo || ' ' END AS titolo,
       t.descrizione AS descrizione, t.aperto_da AS aperto_da, t.responsabile AS responsabile, t.priorita AS priorita, t.stato AS stato, t.impatto AS impatto,
       CASE WHEN t.id % 4 = 2 THEN NULL ELSE t.scadenza END AS scadenza, t.attivita_id AS attivita_id, t.foto_link AS foto_link
FROM ticket t""",
    ),
    "quick_tickets": (
        "ticket",
        """
SELECT t.id AS richiesta, t.cantiere_id AS cantiere_id, t.tipo AS tipo, t.priorita AS priorita, CASE t.id % 8 WHEN 3 THEN '' WHEN 4 THEN NULL ELSE ' quick ' || t.titolo END AS titolo,
       t.descrizione AS descrizione, t.responsabile AS responsabile, t.impatto AS impatto, CASE WHEN t.id % 3 = 0 THEN '2030-01-01' END AS scadenza
FROM ticket t""",
    ),
    # each site asks for one template; some ask for one that does not exist
    "template_requests": (
        "cantieri",
        """
SELECT c.id AS cantiere_id,
       CASE c.id % 5 WHEN 0 THEN 'Bagno completo' WHEN 1 THEN 'Cucina' WHEN 2 THEN 'Appartamento completo' WHEN 3 THEN 'Ristrutturazione leggera' ELSE 'Tetto' END AS template,
       CAST(c.data_inizio AS DATE) AS inizio
FROM cantieri c""",
    ),
}


def change_set(name: str, source: DataFrame) -> DataFrame:
    table, sql = SETS[name]
    statement = sql.format(**SPARK_WORDS).replace(f"FROM {table} ", f"FROM {{{table}}} ")
    return source.sparkSession.sql(statement, **{table: source})
