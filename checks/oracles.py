"""The SQL twin of every registered query, written independently for DuckDB.

Each text is plain SQL over the derived views; ``_with`` puts the views and
shared subqueries that it reads in front of it.
"""

from __future__ import annotations

import re

from checks.change_sets import SETS
from siteloom.sources.star_schema import VIEW_SQL
from siteloom.vocabulary import PLAN_TEMPLATES

DONE = "('Completata', 'Verificata')"
CLOSED = "('Risolto', 'Chiuso')"
RANK = "CASE priorita WHEN 'Critica' THEN 1 WHEN 'Alta' THEN 2 WHEN 'Media' THEN 3 ELSE 4 END"
DUE = "scadenza NULLS FIRST, id"
NL = "chr(10)"


def _quote(value: object) -> str:
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


TEMPLATE_ROWS = ", ".join(
    "(" + ", ".join(_quote(x) for x in (place, *row)) + ")" for place, row in enumerate(PLAN_TEMPLATES)
)

# every character that is blank at the end of a text
BLANKS = " || ".join(f"chr({i})" for i in range(0x3001) if chr(i).isspace())


def _strip(column: str) -> str:
    return f"trim({column}, {BLANKS})"


def _euro(column: str) -> str:
    return f"'€ ' || replace(format('{{:,}}', CAST(round_even(coalesce({column}, 0), 0) AS BIGINT)), ',', '.')"


def _has(words: str) -> str:
    return "(" + " OR ".join(f"contains(raw, '{w}')" for w in words.split("|")) + ")"


def _level(score: str, red: str, yellow: str, green: str) -> str:
    return f"CASE WHEN {score} >= 9 THEN '{red}' WHEN {score} >= 4 THEN '{yellow}' ELSE '{green}' END"


def _label(percent: str) -> str:
    return (
        f"CASE WHEN {percent} >= 100 THEN 'Completato' WHEN {percent} >= 80 THEN 'Fase finale' "
        f"WHEN {percent} >= 50 THEN 'Avanzamento intermedio' WHEN {percent} >= 20 THEN 'Avviato' ELSE 'In partenza' END"
    )


def _changed(table: str, changes: str, fields: list[str], closed: str, extra: str = "") -> str:
    """Changes applied one after the other: last values, first closing after the last reopening."""
    picked = ", ".join(f"CASE WHEN l.id IS NOT NULL THEN l.{f} ELSE t.{f} END AS {f}" for f in fields)
    return f"""
SELECT t.id AS id, {extra} {picked},
       CASE WHEN l.id IS NULL THEN t.closed_at
            WHEN l.stato NOT IN {closed} OR l.stato IS NULL THEN NULL
            WHEN o.at IS NULL THEN coalesce(t.closed_at, c.ts)
            ELSE c.ts END AS closed_at
FROM {table} t
LEFT JOIN (SELECT * FROM {changes} QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1) l ON l.id = t.id
LEFT JOIN (SELECT id, max({{'ts': ts, 'seq': seq}}) AS at FROM {changes} WHERE stato NOT IN {closed} OR stato IS NULL GROUP BY id) o ON o.id = t.id
LEFT JOIN (SELECT x.id, min(x.ts) AS ts FROM {changes} x
           LEFT JOIN (SELECT id, max({{'ts': ts, 'seq': seq}}) AS at FROM {changes} WHERE stato NOT IN {closed} OR stato IS NULL GROUP BY id) y ON y.id = x.id
           WHERE x.stato IN {closed} AND (y.at IS NULL OR {{'ts': x.ts, 'seq': x.seq}} > y.at) GROUP BY x.id) c ON c.id = t.id
"""


def _listed(source: str, condition: str, order: str, line: str, k: int, name: str) -> str:
    return f"""
SELECT cantiere_id, string_agg(riga, {NL} ORDER BY pos) AS {name} FROM (
  SELECT cantiere_id, {line} AS riga, row_number() OVER (PARTITION BY cantiere_id ORDER BY {order}) AS pos
  FROM {source} WHERE {condition}) WHERE pos <= {k} GROUP BY cantiere_id"""


TASK_LINE = "'- ' || titolo || ' (' || CAST(coalesce(percentuale, 0) AS VARCHAR) || '%)'"
TICKET_LINE = "'- ' || titolo"
BY_RANK = f"{RANK}, {DUE}"
BY_NAME = f"priorita NULLS FIRST, {DUE}"
T_DONE = f"stato IN {DONE}"
T_RUN = "stato = 'In corso'"
T_BLOCKED = "stato = 'Bloccata'"
T_TODO = "stato IN ('Da fare', 'Bloccata')"
T_NEXT = f"stato NOT IN {DONE}"
K_LENIENT = f"(stato IS NULL OR stato NOT IN {CLOSED})"
K_STRICT = f"stato NOT IN {CLOSED}"
K_OPER = f"{K_LENIENT} AND tipo IN ('Blocco', 'Richiesta decisione', 'Richiesta materiale', 'Rischio ritardo')"
K_DECISION = f"{K_LENIENT} AND tipo = 'Richiesta decisione'"
K_CONFIRM = f"{K_LENIENT} AND tipo IN ('Richiesta decisione', 'Richiesta materiale')"
K_CLIENT = f"{K_STRICT} AND tipo IN ('Richiesta decisione', 'Richiesta materiale', 'Extra lavoro')"

WORDS = {
    "ts": "TIMESTAMP",
    "repeat": "JOIN LATERAL (SELECT unnest([1, 2, 3, 4][1:CAST(",
    "end": " AS INT)]) AS k) k ON true",
}
SHARED: dict[str, str] = {
    **{name: sql.format(**WORDS) for name, sql in VIEW_SQL.items()},
    **{name: sql.format(**WORDS) for name, (_, sql) in SETS.items()},
    "templates": f"SELECT * FROM (VALUES {TEMPLATE_ROWS}) AS v(posto, template, fase, titolo, descrizione, ruolo, priorita, giorno)",
    "task_facts": f"""
SELECT cantiere_id, count(*) AS totale, count(*) FILTER (WHERE stato IN {DONE}) AS completate,
       count(*) FILTER (WHERE stato = 'In corso') AS in_corso, count(*) FILTER (WHERE stato = 'Bloccata') AS attivita_bloccate,
       count(*) FILTER (WHERE TRY_CAST(scadenza AS DATE) < DATE '1995-09-01' AND coalesce(stato NOT IN {DONE}, true)) AS scadute,
       CAST(sum(CASE WHEN stato IN {DONE} THEN 100 ELSE greatest(0, least(100, coalesce(percentuale, 0))) END) AS BIGINT) AS somma
FROM attivita GROUP BY cantiere_id""",
    "ticket_facts": f"""
SELECT cantiere_id, count(*) FILTER (WHERE {K_LENIENT}) AS ticket_aperti, count(*) FILTER (WHERE {K_STRICT}) AS ticket_aperti_noti,
       count(*) FILTER (WHERE {K_LENIENT} AND priorita = 'Critica') AS critici,
       count(*) FILTER (WHERE {K_LENIENT} AND priorita = 'Alta') AS alti,
       count(*) FILTER (WHERE stato = 'Bloccante') AS bloccanti,
       count(*) FILTER (WHERE {K_CONFIRM}) AS decisioni,
       count(*) FILTER (WHERE {K_LENIENT} AND tipo IN ('Blocco', 'Rischio ritardo')) AS a_rischio,
       count(*) FILTER (WHERE {K_OPER}) AS operativi,
       count(*) FILTER (WHERE {K_STRICT} AND (stato = 'Bloccante' OR priorita IN ('Alta', 'Critica'))) AS urgenti,
       count(*) FILTER (WHERE {K_CLIENT}) AS punti_cliente
FROM ticket GROUP BY cantiere_id""",
    "counted": """
SELECT c.*, coalesce(t.totale, 0) AS totale, coalesce(t.completate, 0) AS completate, coalesce(t.in_corso, 0) AS in_corso,
       coalesce(t.attivita_bloccate, 0) AS attivita_bloccate, coalesce(t.scadute, 0) AS scadute,
       CASE WHEN t.totale > 0 THEN CAST(round_even(CAST(t.somma AS DOUBLE) / t.totale, 0) AS INTEGER) ELSE 0 END AS avanzamento,
       coalesce(k.ticket_aperti, 0) AS ticket_aperti, coalesce(k.ticket_aperti_noti, 0) AS ticket_aperti_noti,
       coalesce(k.critici, 0) AS critici, coalesce(k.alti, 0) AS alti, coalesce(k.bloccanti, 0) AS bloccanti,
       coalesce(k.decisioni, 0) AS decisioni, coalesce(k.a_rischio, 0) AS a_rischio, coalesce(k.operativi, 0) AS operativi,
       coalesce(k.urgenti, 0) AS urgenti, coalesce(k.punti_cliente, 0) AS punti_cliente
FROM cantieri c LEFT JOIN task_facts t ON t.cantiere_id = c.id LEFT JOIN ticket_facts k ON k.cantiere_id = c.id""",
    "scored": """
SELECT *, critici * 4 + bloccanti * 3 + attivita_bloccate * 3 + scadute * 2 + a_rischio * 2 + alti + decisioni AS punteggio
FROM counted""",
    "budgets": """
SELECT c.id AS cantiere_id, coalesce(b.budget_iniziale, 0) AS budget_iniziale, coalesce(b.costo_effettivo, 0) AS costo_effettivo,
       coalesce(b.extra_approvati, 0) AS extra_approvati, coalesce(b.note_budget, '') AS note_budget,
       coalesce(b.costo_effettivo, 0) + coalesce(b.extra_approvati, 0) AS totale_aggiornato
FROM cantieri c LEFT JOIN budget_cantiere b ON b.cantiere_id = c.id""",
    "budget_facts": """
SELECT *, CASE WHEN budget_iniziale <> 0 THEN totale_aggiornato - budget_iniziale ELSE totale_aggiornato END AS scostamento,
       CASE WHEN budget_iniziale <> 0 THEN CAST(greatest(0, least(200, round_even(totale_aggiornato / budget_iniziale * 100, 0))) AS INTEGER) ELSE 0 END AS budget_consumato_pct,
       CASE WHEN budget_iniziale = 0 THEN 'Budget da inserire' WHEN totale_aggiornato <= budget_iniziale THEN 'Allineato al budget'
            WHEN totale_aggiornato <= budget_iniziale * CAST(1.1 AS DOUBLE) THEN 'Scostamento da monitorare' ELSE 'Extra budget rilevante' END AS stato_budget,
       CASE WHEN budget_iniziale = 0 THEN 'watch' WHEN totale_aggiornato <= budget_iniziale THEN 'good'
            WHEN totale_aggiornato <= budget_iniziale * CAST(1.1 AS DOUBLE) THEN 'watch' ELSE 'alert' END AS gravita_budget
FROM budgets""",
    "site_row": f"""
SELECT s.*, {_label('avanzamento')} AS sintesi,
       repeat('█', CAST(round_even(avanzamento / 100.0::DOUBLE * 10, 0) AS INTEGER)) || repeat('░', 10 - CAST(round_even(avanzamento / 100.0::DOUBLE * 10, 0) AS INTEGER)) AS barra,
       {_level('punteggio', 'Rosso', 'Giallo', 'Verde')} AS livello,
       {_level('punteggio', 'Rischio operativo alto', 'Attenzione operativa', 'Cantiere sotto controllo')} AS rischio_sintesi,
       {_level('punteggio', 'Serve intervento immediato del capo cantiere sui blocchi aperti.', 'Monitorare ticket, decisioni e attività critiche entro la giornata.', 'Continuare aggiornamento attività e report giornaliero.')} AS azione,
       CASE WHEN critici + bloccanti + attivita_bloccate + scadute + decisioni = 0 THEN 'nessun blocco rilevante aperto' ELSE
       concat_ws(', ', CASE WHEN critici > 0 THEN critici || ' ticket critici' END, CASE WHEN bloccanti > 0 THEN bloccanti || ' ticket bloccanti' END,
                 CASE WHEN attivita_bloccate > 0 THEN attivita_bloccate || ' attività bloccate' END, CASE WHEN scadute > 0 THEN scadute || ' attività scadute' END,
                 CASE WHEN decisioni > 0 THEN decisioni || ' decisioni/materiali da confermare' END) END AS motivi,
       b.budget_iniziale, b.costo_effettivo, b.extra_approvati, b.note_budget, b.totale_aggiornato, b.scostamento, b.budget_consumato_pct, b.stato_budget, b.gravita_budget
FROM scored s JOIN budget_facts b ON b.cantiere_id = s.id""",
    "flagged": f"""
SELECT *, {_has('blocc|non posso|fermo|manca|impossibile|non riesco')} AS b, {_has('urgente|subito|oggi|domani mattina')} AS u,
       {_has('materiale|piastrel|sanitari|rubinet|massetto|porta|fornitura')} AS m,
       {_has('conferma|decidere|scelta|cliente|autorizzazione')} AS d, {_has('finito|completato|chiuso|terminato')} AS f
FROM (SELECT *, lower(coalesce(testo, '')) AS raw, coalesce({_strip('testo')}, '') AS pulito FROM feed)""",
    "triaged": """
SELECT *, CASE WHEN f THEN 'Completamento attività' WHEN b THEN 'Blocco' WHEN d THEN 'Richiesta decisione' WHEN m THEN 'Richiesta materiale' ELSE 'Avanzamento' END AS tipo,
       CASE WHEN f THEN 'Media' WHEN b AND u THEN 'Critica' WHEN b OR u THEN 'Alta' ELSE 'Media' END AS priorita,
       CASE WHEN b AND NOT f THEN 'Bloccante' ELSE 'Aperto' END AS stato,
       CASE WHEN f THEN 'Verificare e aggiornare avanzamento attività.' WHEN b THEN 'Possibile ritardo se non gestito entro 24 ore.'
            WHEN m THEN 'Verificare disponibilità materiale per evitare fermo cantiere.' WHEN d THEN 'Serve decisione per proseguire senza rilavorazioni.' ELSE '' END AS impatto,
       CASE WHEN pulito = '' THEN 'Nuova segnalazione cantiere' ELSE substring(split_part(pulito, '.', 1), 1, 80) END AS titolo
FROM flagged""",
    "feed": "SELECT * FROM messaggi",
    "kpi_rows": """
SELECT cantiere_id, totale, completate, attivita_bloccate, scadute, 0 AS ticket_aperti, 0 AS bloccanti FROM task_facts
UNION ALL SELECT cantiere_id, 0, 0, 0, 0, ticket_aperti, bloccanti FROM ticket_facts
UNION ALL SELECT id, 0, 0, 0, 0, 0, 0 FROM cantieri""",
    "cascade_changes": """
SELECT n.ticket_id AS id, r.ts AS ts, r.seq AS seq, r.stato_ticket AS stato
FROM replies r JOIN notifiche n ON n.id = r.id
WHERE n.ticket_id IS NOT NULL AND r.stato_ticket IS NOT NULL AND r.stato_ticket <> 'Non modificare'""",
    "contacts": """
SELECT w.nome_cercato, coalesce((SELECT coalesce(a.telefono, '') FROM artigiani a
         WHERE a.attivo = 1 AND w.nome_cercato <> '' AND contains(lower(a.nome), lower(w.nome_cercato))
         ORDER BY lower(a.nome) <> lower(w.nome_cercato), a.id LIMIT 1), '') AS telefono
FROM (SELECT DISTINCT responsabile AS nome_cercato FROM ticket) w""",
    "notice_bodies": f"""
SELECT t.*, c.nome AS cantiere, concat_ws({NL}, 'Azione richiesta', 'Cantiere: ' || c.nome, 'Ticket #' || t.id || ': ' || t.titolo,
       'Tipo: ' || t.tipo || ' · Priorità: ' || coalesce(t.priorita, '-'), 'Responsabile: ' || coalesce(nullif(t.responsabile, ''), 'referente'),
       'Scadenza: ' || coalesce(nullif(t.scadenza, ''), 'da confermare'), '', 'Serve un aggiornamento per sbloccare il flusso del cantiere.',
       CASE WHEN t.impatto <> '' THEN 'Impatto: ' || t.impatto END, CASE WHEN t.descrizione <> '' THEN {NL} || 'Dettaglio: ' || t.descrizione END,
       '', 'Rispondi con:', '1 = confermo / procedo', '2 = mi serve una informazione', '3 = non posso procedere', '', 'Grazie') AS messaggio
FROM ticket t JOIN cantieri c ON c.id = t.cantiere_id""",
    **{
        f"tasks_{name}_{k}": _listed("attivita", cond, DUE, TASK_LINE, k, "elenco")
        for name, cond in {"done": T_DONE, "run": T_RUN, "blocked": T_BLOCKED, "todo": T_TODO, "next": T_NEXT}.items()
        for k in (4, 5, 6, 8)
    },
    **{
        f"tickets_{name}_{k}": _listed("ticket", cond, order, TICKET_LINE, k, "elenco")
        for name, (cond, order) in {
            "oper": (K_OPER, BY_NAME),
            "decision": (K_DECISION, BY_NAME),
            "confirm": (K_CONFIRM, BY_NAME),
            "client": (K_CLIENT, BY_RANK),
        }.items()
        for k in (4, 6, 8)
    },
}

_NAME = re.compile(r"\b[a-z_]+[a-z0-9_]*\b")


def _needed(sql: str, found: list[str]) -> list[str]:
    bare = re.sub(r"'[^']*'", "", sql)
    for word in dict.fromkeys(_NAME.findall(bare)):
        if word in SHARED and re.search(rf"\b(FROM|JOIN)\s+{word}\b", bare) and word not in found:
            _needed(SHARED[word], found)
            if word not in found:
                found.append(word)
    return found


def _with(sql: str, **own: str) -> str:
    """The statement with every view it reads in front; ``own`` replaces shared views by name."""
    names = _needed(sql, [])
    for text in own.values():
        for name in _needed(text, []):
            if name not in names:
                names.insert(0, name)
    parts = ",\n".join(f"{name} AS ({own.get(name, SHARED[name]).strip()})" for name in names)
    return f"WITH {parts}\n{sql.strip()}" if parts else sql.strip()


TS = "TIMESTAMP"
NOW = "TIMESTAMP '2024-01-15 09:30:00'"

TICKET_ALL = (
    "id, cantiere_id, tipo, titolo, descrizione, aperto_da, responsabile, priorita, stato, impatto, scadenza, "
    "attivita_id, foto_link, created_at, closed_at"
)

TASK_ALL = (
    "id, cantiere_id, fase, titolo, descrizione, assegnato_a, dipende_da_id, stato, priorita, scadenza, percentuale, "
    "note, created_at, closed_at"
)


def _fingerprints(cell: str = "{}") -> str:
    words = {
        "cantieri": "nome indirizzo cliente capo_cantiere stato data_inizio data_fine_prevista note",
        "artigiani": "nome ruolo telefono email note",
        "attivita": "fase titolo descrizione assegnato_a stato priorita scadenza note",
        "ticket": "tipo titolo descrizione aperto_da responsabile priorita stato impatto scadenza foto_link",
        "aggiornamenti": "autore testo categoria",
        "budget_cantiere": "note_budget",
        "notifiche": "destinatario telefono canale messaggio stato risposta",
    }
    parts = []
    for table, columns in words.items():
        filled = " + ".join(f"CASE WHEN {cell.format(c)} IS NOT NULL THEN 1 ELSE 0 END" for c in columns.split())
        letters = " + ".join(f"length(coalesce({c}, ''))" for c in columns.split())
        parts.append(
            f"SELECT '{table}' AS tabella, count(*) AS righe, CAST(sum(id) AS BIGINT) AS somma_id, "
            f"CAST(sum({filled}) AS BIGINT) AS valori, CAST(sum({letters}) AS BIGINT) AS lettere FROM {table}"
        )
    return " UNION ALL ".join(parts)


TABLES = ["cantieri", "artigiani", "attivita", "ticket", "aggiornamenti", "budget_cantiere", "notifiche"]


def _counts(column: str, extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS tabella, count(*) AS {column}{extra} FROM {t}" for t in TABLES)


def _orphans() -> str:
    links = [
        ("attivita", "cantiere_id", "cantieri"),
        ("ticket", "cantiere_id", "cantieri"),
        ("ticket", "attivita_id", "attivita"),
        ("aggiornamenti", "cantiere_id", "cantieri"),
        ("budget_cantiere", "cantiere_id", "cantieri"),
        ("notifiche", "cantiere_id", "cantieri"),
        ("notifiche", "ticket_id", "ticket"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS tabella, '{k}' AS colonna, x.{k} AS chiave, count(*) AS righe FROM {c} x "
        f"WHERE x.{k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.id = x.{k}) GROUP BY x.{k}"
        for c, k, p in links
    )


TASK_COLS = "fase, titolo, assegnato_a, stato, priorita, scadenza, percentuale"
TICKET_COLS = "tipo, titolo, responsabile, priorita, stato, scadenza, impatto"
KPI_SUMS = ", ".join(
    f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}"
    for c in ("totale", "completate", "attivita_bloccate", "ticket_aperti", "bloccanti", "scadute")
)

def _top(table: str, condition: str, order: str, columns: str, k: int) -> str:
    return (
        f"SELECT cantiere_id, id, {columns}, CAST(row_number() OVER (PARTITION BY cantiere_id ORDER BY {order}) AS INTEGER) AS posizione "
        f"FROM {table} WHERE {condition} QUALIFY row_number() OVER (PARTITION BY cantiere_id ORDER BY {order}) <= {k}"
    )


def _card(owner: str, phase: str, extra: str = "") -> str:
    prio = "coalesce(nullif(priorita, ''), 'Media')"
    return (
        f"id, cantiere_id, {extra} {prio} AS priorita, CASE {prio} WHEN 'Critica' THEN 'critical' WHEN 'Alta' THEN 'high' ELSE '' END AS classe, "
        f"CASE {prio} WHEN 'Critica' THEN 'red' WHEN 'Alta' THEN 'yellow' WHEN 'Media' THEN 'blue' ELSE 'gray' END AS colore, titolo, "
        f"coalesce(nullif({owner}, ''), 'Da assegnare') AS responsabile, coalesce(nullif(stato, ''), '-') AS stato, "
        f"coalesce(nullif(scadenza, ''), '-') AS scadenza, coalesce(nullif({phase}, ''), '') AS fase"
    )


def _page(lines: list[str]) -> str:
    return f"concat_ws({NL}, {', '.join(lines)}) || {NL}"


def _list(alias: str) -> str:
    return f"coalesce({alias}.elenco, '- Nessuno')"


def _joined(**lists: str) -> str:
    return "FROM site_row s " + " ".join(
        f"LEFT JOIN {view} {alias} ON {alias}.cantiere_id = s.id" for alias, view in lists.items()
    )


DAY = "'01/09/1995'"
PROGRESS = ["s.barra || ' ' || s.avanzamento || '% - ' || s.sintesi"]
CLIENT_HEAD = [
    "''",
    "'Aggiornamento cliente'",
    "'Cantiere: ' || s.nome",
    "'Cliente: ' || coalesce(nullif(s.cliente, ''), '-')",
    f"'Data aggiornamento: ' || {DAY}",
    "''",
]


def _report(name: str, lines: list[str], **lists: str) -> str:
    return _with(f"SELECT '{name}' AS report, s.id AS cantiere_id, {_page(lines)} AS testo {_joined(**lists)}")


DAILY = _report(
    "Report interno",
    [
        f"'REPORT GIORNALIERO - ' || {DAY}", "''", "'Cantiere: ' || s.nome",
        "'Cliente: ' || coalesce(nullif(s.cliente, ''), '-')", "'Capo cantiere: ' || coalesce(nullif(s.capo_cantiere, ''), '-')", "''",
        "'AVANZAMENTO GENERALE CANTIERE: ' || s.avanzamento || '%'", *PROGRESS,
        "'Attività totali: ' || s.totale || ' | Completate: ' || s.completate || ' | In corso: ' || s.in_corso || ' | Bloccate: ' || s.attivita_bloccate", "''",
        "'RISCHIO OPERATIVO: ' || s.livello || ' - ' || s.rischio_sintesi", "'Motivi: ' || s.motivi", "'Azione suggerita: ' || s.azione", "''",
        "'1) ATTIVITÀ COMPLETATE / VERIFICATE'", _list("a"), "''", "'2) ATTIVITÀ IN CORSO'", _list("b"), "''",
        "'3) ATTIVITÀ BLOCCATE'", _list("c"), "''", "'4) TICKET APERTI CRITICI / OPERATIVI'", _list("d"), "''",
        "'5) DECISIONI / AZIONI RICHIESTE'", _list("e"), "''", "'6) RISCHIO TEMPI'", "'- Ticket aperti: ' || s.ticket_aperti",
        "'- Blocchi o rischi aperti: ' || s.operativi", "'- Attività bloccate: ' || s.attivita_bloccate", "''",
        "'7) PROSSIME ATTIVITÀ DA PRESIDIARE'", _list("f"), "''", "'Sintesi:'",
        "'Il cantiere è da monitorare con priorità sui blocchi aperti e sulle decisioni richieste. Aggiornare responsabili e scadenze entro la prossima finestra operativa.'",
    ],
    a="tasks_done_6", b="tasks_run_6", c="tasks_blocked_6", d="tickets_oper_6", e="tickets_decision_6", f="tasks_next_5",
)
SHORT = _report(
    "Versione cliente",
    [
        f"'Aggiornamento cantiere - ' || {DAY}", "''", "'Cantiere: ' || s.nome", "''", "'Avanzamento generale: ' || s.avanzamento || '%'", *PROGRESS, "''",
        "'Stato operativo: ' || s.livello || ' - ' || s.rischio_sintesi", "''", "'Attività completate/verificate:'", _list("a"), "''",
        "'Attività in corso:'", _list("b"), "''", "'Prossimi passaggi previsti:'", _list("c"), "''", "'Punti da confermare / monitorare:'", _list("d"), "''",
        "'Il team sta presidiando le attività aperte per mantenere il corretto avanzamento del cantiere. Eventuali decisioni richieste verranno condivise in modo puntuale.'",
    ],
    a="tasks_done_4", b="tasks_run_4", c="tasks_next_4", d="tickets_confirm_4",
)
PROGRESS_LINES = [
    "'REPORT AVANZAMENTO CANTIERE'", *CLIENT_HEAD, "'Avanzamento generale: ' || s.avanzamento || '%'", *PROGRESS, "''", "'Attività totali: ' || s.totale",
    "'Completate: ' || s.completate", "'In corso: ' || s.in_corso", "'Da presidiare/bloccate: ' || s.attivita_bloccate", "''", "'Prossimi passaggi:'", _list("a"),
]
BUDGET_LINES = [
    "'REPORT BUDGET INIZIALE VS EFFETTIVO'", *CLIENT_HEAD, f"'Budget iniziale: ' || {_euro('s.budget_iniziale')}", f"'Costo effettivo maturato: ' || {_euro('s.costo_effettivo')}",
    f"'Extra approvati: ' || {_euro('s.extra_approvati')}", f"'Totale aggiornato: ' || {_euro('s.totale_aggiornato')}", f"'Scostamento: ' || {_euro('s.scostamento')}",
    "'Budget consumato: ' || s.budget_consumato_pct || '%'", "'Stato: ' || s.stato_budget", "''", "'Nota:'", "coalesce(nullif(s.note_budget, ''), 'Nessuna nota economica specifica.')",
]
WORKS_LINES = [
    "'REPORT LAVORI FATTI / IN CORSO / DA FARE'", *CLIENT_HEAD, "'Lavori completati:'", _list("a"), "''", "'Lavori in corso:'", _list("b"), "''",
    "'Lavori da fare / prossimi passaggi:'", _list("c"), "''", "'Punti da confermare o monitorare:'", _list("d"),
]
FULL_LINES = [
    "'REPORT CLIENTE COMPLETO'", *CLIENT_HEAD, "'1. AVANZAMENTO'", "'Avanzamento generale: ' || s.avanzamento || '%'", *PROGRESS, "''", "'2. BUDGET'",
    f"'Budget iniziale: ' || {_euro('s.budget_iniziale')}", f"'Totale aggiornato: ' || {_euro('s.totale_aggiornato')}", f"'Scostamento: ' || {_euro('s.scostamento')}",
    "'Stato: ' || s.stato_budget", "''", "'3. LAVORI COMPLETATI'", _list("a"), "''", "'4. LAVORI IN CORSO'", _list("b"), "''",
    "'5. PROSSIMI LAVORI / DA FARE'", _list("c"), "''", "'6. PUNTI DA CONFERMARE O MONITORARE'", _list("d"), "''", "'Messaggio:'",
    "'Il cantiere è presidiato con metodo: avanzamento lavori, budget e prossime attività sono monitorati in modo strutturato. Eventuali decisioni richieste saranno condivise in modo puntuale.'",
]
CLIENT_8 = {"a": "tasks_done_8", "b": "tasks_run_8", "c": "tasks_todo_8", "d": "tickets_client_8"}
CLIENT_6 = {"a": "tasks_done_6", "b": "tasks_run_6", "c": "tasks_todo_6", "d": "tickets_client_6"}


def _export() -> str:
    kinds = [
        ("avanzamento_cantiere", PROGRESS_LINES, {"a": "tasks_todo_5"}),
        ("budget_iniziale_vs_effettivo", BUDGET_LINES, {}),
        ("lavori_fatti___in_corso___da_fare", WORKS_LINES, CLIENT_8),
        ("report_cliente_completo", FULL_LINES, CLIENT_6),
    ]
    return _with(
        " UNION ALL ".join(
            f"SELECT '{name}' AS report, s.id AS cantiere_id, {_page(lines)} AS testo {_joined(**lists)}"
            for name, lines, lists in kinds
        )
    )


def _client_list(name: str, condition: str) -> str:
    return (
        f"SELECT cantiere_id, '{name}' AS sezione, CAST(row_number() OVER (PARTITION BY cantiere_id ORDER BY {DUE}) AS INTEGER) AS posizione, id, titolo, "
        f"coalesce(fase, '') || ' · ' || CAST(coalesce(percentuale, 0) AS VARCHAR) || '% ' || CASE WHEN scadenza <> '' THEN '· prevista ' || scadenza ELSE '' END AS riga "
        f"FROM attivita WHERE {condition} QUALIFY row_number() OVER (PARTITION BY cantiere_id ORDER BY {DUE}) <= 6"
    )


LINK = "replace(replace(replace(replace(url_encode({0}), '+', '%20'), '*', '%2A'), '%7E', '~'), '%2F', '/')"
PHONE = "regexp_replace(regexp_replace(coalesce({0}, ''), '[^0-9]', '', 'g'), '^00', '')"


def _link(phone: str, message: str) -> str:
    return f"'https://wa.me/' || {PHONE.format(phone)} || '?text=' || {LINK.format(message)}"


ORACLES: dict[str, str] = {
    # --- scans, sources, sinks
    "s01_full_scan": _with(f"SELECT {TICKET_ALL} FROM ticket"),
    "s02_scoped_scan": _with(
        "SELECT id, cantiere_id, stato, scadenza FROM attivita WHERE cantiere_id IN (SELECT id FROM cantieri WHERE stato = 'Attivo')"
    ),
    "s03_keyed_lookup": _with(
        "SELECT id, cantiere_id, titolo, stato FROM ticket WHERE id IN (SELECT ticket_id FROM notifiche WHERE ticket_id IS NOT NULL)"
    ),
    "s04_schema_defaults": _with(
        f"SELECT id, cantiere_id, CAST(NULL AS VARCHAR) AS fase, titolo, CAST(NULL AS VARCHAR) AS descrizione, CAST(NULL AS VARCHAR) AS assegnato_a, "
        f"CAST(NULL AS BIGINT) AS dipende_da_id, 'Da fare' AS stato, 'Media' AS priorita, CAST(NULL AS VARCHAR) AS scadenza, CAST(0 AS BIGINT) AS percentuale, "
        f"CAST(NULL AS VARCHAR) AS note, {NOW} AS created_at, CAST(NULL AS TIMESTAMP) AS closed_at FROM attivita"
    ),
    "s05_append_batch": _with(
        f"SELECT {TICKET_ALL} FROM ticket UNION ALL "
        f"SELECT (SELECT max(id) FROM ticket) + row_number() OVER (ORDER BY id), cantiere_id, tipo, titolo, testo, autore, 'Capo cantiere', priorita, stato, impatto, "
        f"'2024-01-16', CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), {NOW}, CAST(NULL AS TIMESTAMP) FROM triaged"
    ),
    "s05_append_updates": _with(
        f"SELECT id, cantiere_id, autore, testo, categoria, created_at FROM aggiornamenti UNION ALL "
        f"SELECT (SELECT max(id) FROM aggiornamenti) + row_number() OVER (ORDER BY id), cantiere_id, autore, testo, tipo, {NOW} FROM triaged"
    ),
    "s05_append_sites": _with(
        f"""SELECT * FROM cantieri UNION ALL
SELECT (SELECT max(id) FROM cantieri) + row_number() OVER (ORDER BY richiesta), {_strip('nome')}, indirizzo, cliente, CAST(NULL AS VARCHAR), 'Attivo',
       coalesce(data_inizio, '2024-01-15'), coalesce(data_fine_prevista, '2024-02-29'), CAST(NULL AS VARCHAR), {NOW} FROM new_sites WHERE {_strip('nome')} <> ''"""
    ),
    "s05_append_crews": _with(
        f"""SELECT * FROM artigiani UNION ALL
SELECT (SELECT max(id) FROM artigiani) + row_number() OVER (ORDER BY richiesta), {_strip('nome')}, ruolo, telefono, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 1, {NOW}
FROM new_crews WHERE {_strip('nome')} <> ''"""
    ),
    "s05_append_tasks": _with(
        f"""SELECT {TASK_ALL} FROM attivita UNION ALL
SELECT (SELECT max(id) FROM attivita) + row_number() OVER (ORDER BY richiesta), cantiere_id, fase, {_strip('titolo')}, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), stato, 'Media',
       coalesce(scadenza, '2024-01-22'), CASE WHEN stato IN {DONE} THEN 100 ELSE greatest(0, least(100, coalesce(percentuale, 0))) END, CAST(NULL AS VARCHAR), {NOW}, CAST(NULL AS TIMESTAMP)
FROM new_tasks WHERE {_strip('titolo')} <> ''"""
    ),
    "s05_append_typed_tickets": _with(
        f"""SELECT {TICKET_ALL} FROM ticket UNION ALL
SELECT (SELECT max(id) FROM ticket) + row_number() OVER (ORDER BY richiesta), cantiere_id, tipo, {_strip('titolo')}, descrizione, aperto_da, responsabile, priorita, stato, impatto,
       coalesce(scadenza, '2024-01-16'), attivita_id, foto_link, {NOW}, CAST(NULL AS TIMESTAMP) FROM new_tickets WHERE {_strip('titolo')} <> ''"""
    ),
    "s05_append_quick_tickets": _with(
        f"""SELECT {TICKET_ALL} FROM ticket UNION ALL
SELECT (SELECT max(id) FROM ticket) + row_number() OVER (ORDER BY richiesta), cantiere_id, tipo, {_strip('titolo')}, descrizione, 'Capo cantiere', responsabile, priorita,
       CASE WHEN tipo = 'Blocco' OR priorita = 'Critica' THEN 'Bloccante' ELSE 'Aperto' END, impatto, coalesce(scadenza, '2024-01-16'), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), {NOW}, CAST(NULL AS TIMESTAMP)
FROM quick_tickets WHERE {_strip('titolo')} <> ''"""
    ),
    "s05_append_template_tasks": _with(
        f"""SELECT (SELECT max(id) FROM attivita) + row_number() OVER (ORDER BY r.cantiere_id, t.posto) AS id, r.cantiere_id AS cantiere_id, t.fase AS fase, t.titolo AS titolo, t.descrizione AS descrizione,
       t.ruolo AS assegnato_a, CAST(NULL AS BIGINT) AS dipende_da_id, 'Da fare' AS stato, t.priorita AS priorita, CAST(r.inizio + CAST(t.giorno AS INTEGER) AS VARCHAR) AS scadenza,
       CAST(0 AS BIGINT) AS percentuale, 'Creato da template: ' || t.template AS note, {NOW} AS created_at, CAST(NULL AS TIMESTAMP) AS closed_at
FROM template_requests r JOIN templates t ON t.template = r.template"""
    ),
    "s05_append_notices": _with(
        f"""SELECT (SELECT max(id) FROM notifiche) + row_number() OVER (ORDER BY b.id) AS id, b.cantiere_id AS cantiere_id, b.id AS ticket_id, coalesce(b.responsabile, '') AS destinatario, c.telefono AS telefono,
       'WhatsApp' AS canale, b.messaggio AS messaggio, 'Inviata manualmente' AS stato, CAST(NULL AS VARCHAR) AS risposta, {NOW} AS created_at, {NOW} AS sent_at, CAST(NULL AS TIMESTAMP) AS responded_at
FROM notice_bodies b JOIN contacts c ON c.nome_cercato IS NOT DISTINCT FROM b.responsabile WHERE b.{K_STRICT}"""
    ),
    "s06_budget_upsert": _with(
        """SELECT coalesce(b.id, (SELECT max(id) FROM budget_cantiere) + row_number() OVER (PARTITION BY b.id IS NULL ORDER BY c.cantiere_id)) AS id, c.cantiere_id AS cantiere_id,
       coalesce(c.budget_iniziale, 0) AS budget_iniziale, coalesce(c.costo_effettivo, 0) AS costo_effettivo, coalesce(c.extra_approvati, 0) AS extra_approvati,
       c.note_budget AS note_budget, c.updated_at AS updated_at
FROM (SELECT * FROM budget_changes QUALIFY row_number() OVER (PARTITION BY cantiere_id ORDER BY updated_at DESC) = 1) c
LEFT JOIN budget_cantiere b ON b.cantiere_id = c.cantiere_id
UNION ALL SELECT b.id, b.cantiere_id, b.budget_iniziale, b.costo_effettivo, b.extra_approvati, b.note_budget, b.updated_at
FROM budget_cantiere b WHERE NOT EXISTS (SELECT 1 FROM budget_changes c WHERE c.cantiere_id = b.cantiere_id)"""
    ),
    "s07_task_update": _with(
        "SELECT id, stato, priorita, CASE WHEN cambiata AND stato IN ('Completata', 'Verificata') THEN 100 WHEN cambiata THEN greatest(0, least(100, coalesce(percentuale, 0))) ELSE percentuale END AS percentuale, note, closed_at FROM ("
        + _changed("attivita", "task_changes", ["stato", "priorita", "percentuale", "note"], DONE, "l.id IS NOT NULL AS cambiata,")
        + ")"
    ),
    "s07_ticket_update": _with(_changed("ticket", "ticket_changes", ["stato", "priorita", "responsabile", "impatto"], CLOSED)),
    "s07_notice_update": _with(
        f"SELECT n.id AS id, r.stato AS stato, r.risposta AS risposta, n.sent_at AS sent_at, CASE WHEN {_strip('r.risposta')} <> '' THEN r.ts ELSE n.responded_at END AS responded_at "
        "FROM notifiche n JOIN replies r ON r.id = n.id"
    ),
    "s08_reply_cascade": _with(_changed("ticket", "cascade_changes", ["stato"], CLOSED, "t.cantiere_id AS cantiere_id,")),
    "s09_csv_export": _with(_fingerprints("nullif({}, '')")),
    "s10_report_export": _export(),
    "s11_snapshot_restore": _with(_fingerprints()),
    "s12_purge": _with(_counts("righe_prima", ", CAST(0 AS BIGINT) AS righe_dopo")),
    "s13_load_if_empty": _with(_counts("righe")),
    # --- projections, filters, predicates
    "p01_projection": _with("SELECT id, titolo AS ticket, responsabile AS referente FROM ticket"),
    "p02_open_tickets_strict": _with(f"SELECT id, cantiere_id, stato FROM ticket WHERE {K_STRICT}"),
    "p03_open_tickets_lenient": _with(f"SELECT id, cantiere_id, stato FROM ticket WHERE {K_LENIENT}"),
    "p04_completed_tasks": _with(
        f"SELECT id, coalesce(stato IN {DONE}, false) AS completata, coalesce(stato NOT IN {DONE}, false) AS da_finire FROM attivita"
    ),
    "p05_overdue_tasks": _with(
        f"SELECT id, cantiere_id, scadenza, stato FROM attivita WHERE TRY_CAST(scadenza AS DATE) < DATE '1995-09-01' AND (stato IS NULL OR stato NOT IN {DONE})"
    ),
    "p06_urgent_tickets": _with(
        f"SELECT id, cantiere_id, stato, priorita FROM ticket WHERE {K_STRICT} AND (stato = 'Bloccante' OR priorita IN ('Alta', 'Critica'))"
    ),
    "p07_client_tickets": _with(f"SELECT id, cantiere_id, tipo FROM ticket WHERE {K_CLIENT}"),
    "p08_operational_tickets": _with(f"SELECT id, cantiere_id, tipo FROM ticket WHERE {K_OPER}"),
    "p09_decisions": _with(f"SELECT id, cantiere_id, tipo = 'Richiesta decisione' AS decisione FROM ticket WHERE {K_CONFIRM}"),
    "p10_active_crews": _with("SELECT id, nome, ruolo FROM artigiani WHERE attivo = 1"),
    "p11_required_fields": _with(
        f"SELECT id, {_strip('testo')} AS titolo, coalesce({_strip('testo')}, '') <> '' AS accettata FROM messaggi"
    ),
    "p12_enum_fallback": _with(
        """
SELECT 'attivita' AS tabella, id, CASE WHEN stato IN ('Da fare', 'In corso', 'Bloccata', 'Completata', 'Verificata') THEN stato ELSE 'Da fare' END AS stato,
       CASE WHEN priorita IN ('Bassa', 'Media', 'Alta', 'Critica') THEN priorita ELSE 'Media' END AS priorita FROM attivita
UNION ALL SELECT 'ticket', id, CASE WHEN stato IN ('Aperto', 'In gestione', 'Bloccante', 'Risolto', 'Chiuso') THEN stato ELSE 'Aperto' END,
       CASE WHEN priorita IN ('Bassa', 'Media', 'Alta', 'Critica') THEN priorita ELSE 'Media' END FROM ticket
UNION ALL SELECT 'notifiche', id, CASE WHEN stato IN ('Preparata', 'Inviata manualmente', 'Risposta ricevuta', 'Chiusa') THEN stato ELSE 'Preparata' END, NULL FROM notifiche"""
    ),
    "p13_client_groups": _with(
        f"SELECT id, cantiere_id, coalesce({T_DONE}, false) AS completate, coalesce({T_RUN}, false) AS in_corso, coalesce({T_TODO}, false) AS da_fare, coalesce({T_BLOCKED}, false) AS bloccate FROM attivita"
    ),
    "p14_running_or_blocked": _with("SELECT id, cantiere_id, stato FROM attivita WHERE stato IN ('In corso', 'Bloccata')"),
    "p15_reply_present": _with("SELECT id, coalesce(risposta, '') <> '' AS con_risposta FROM notifiche"),
    "p16_linked_notices": _with("SELECT id, ticket_id FROM notifiche WHERE ticket_id IS NOT NULL"),
    # --- joins
    "j01_tickets_with_site": _with(
        f"SELECT t.id AS id, t.cantiere_id AS cantiere_id, {', '.join('t.' + c.strip() for c in TICKET_COLS.split(','))}, c.nome AS cantiere FROM ticket t JOIN cantieri c ON c.id = t.cantiere_id WHERE t.{K_STRICT}"
    ),
    "j02_tasks_with_site": _with(
        f"SELECT t.id AS id, t.cantiere_id AS cantiere_id, {', '.join('t.' + c.strip() for c in TASK_COLS.split(','))}, c.nome AS cantiere FROM attivita t JOIN cantieri c ON c.id = t.cantiere_id"
    ),
    "j03_notice_log": _with(
        "SELECT n.id AS id, n.ticket_id AS ticket_id, t.titolo AS ticket, n.stato AS stato FROM notifiche n LEFT JOIN ticket t ON t.id = n.ticket_id"
    ),
    "j05_sites_progress": _with("SELECT id, nome AS cantiere, avanzamento, totale AS attivita_totali FROM counted"),
    "j06_risk_aggregates": _with("SELECT id, nome, attivita_bloccate, scadute, critici, bloccanti, alti, decisioni, a_rischio FROM counted"),
    "j07_sites_budget": _with(
        "SELECT c.id AS id, c.nome AS nome, b.budget_iniziale, b.costo_effettivo, b.extra_approvati, b.note_budget FROM cantieri c JOIN budgets b ON b.cantiere_id = c.id"
    ),
    "j08_contact_resolution": _with("SELECT nome_cercato AS responsabile, telefono FROM contacts"),
    "j09_orphans": _with(_orphans()),
    "j10_template_expansion": _with(
        """SELECT r.cantiere_id AS cantiere_id, CAST(t.posto AS INTEGER) AS posto, t.fase, t.titolo, t.descrizione, t.ruolo AS assegnato_a, CAST(NULL AS BIGINT) AS dipende_da_id,
       'Da fare' AS stato, t.priorita, CAST(r.inizio + CAST(t.giorno AS INTEGER) AS VARCHAR) AS scadenza, CAST(0 AS BIGINT) AS percentuale, 'Creato da template: ' || t.template AS note
FROM template_requests r JOIN templates t ON t.template = r.template"""
    ),
    "j11_outbound_notices": _with(
        f"""SELECT b.id AS ticket_id, b.cantiere_id AS cantiere_id, coalesce(b.responsabile, '') AS destinatario, c.telefono AS telefono, b.messaggio AS messaggio,
       {_link('c.telefono', 'b.messaggio')} AS link
FROM notice_bodies b JOIN contacts c ON c.nome_cercato IS NOT DISTINCT FROM b.responsabile WHERE b.{K_STRICT}"""
    ),
    # --- aggregations
    "a01_kpis": _with(
        f"SELECT 'cantiere' AS vista, cantiere_id, {KPI_SUMS} FROM kpi_rows GROUP BY cantiere_id UNION ALL SELECT 'tutti', CAST(NULL AS BIGINT), {KPI_SUMS} FROM kpi_rows"
    ),
    "a02_completion_rate": _with(
        """SELECT 'cantiere' AS vista, cantiere_id, CASE WHEN sum(totale) > 0 THEN CAST(round_even(CAST(sum(completate) AS DOUBLE) / CAST(sum(totale) AS DOUBLE) * 100, 0) AS DOUBLE) ELSE 0 END AS tasso_completamento FROM kpi_rows GROUP BY cantiere_id
UNION ALL SELECT 'tutti', CAST(NULL AS BIGINT), CASE WHEN sum(totale) > 0 THEN CAST(round_even(CAST(sum(completate) AS DOUBLE) / CAST(sum(totale) AS DOUBLE) * 100, 0) AS DOUBLE) ELSE 0 END FROM kpi_rows"""
    ),
    "a03_tasks_by_state": _with("SELECT stato, count(*) AS numero FROM attivita GROUP BY stato"),
    "a03_tasks_by_state_per_site": _with("SELECT cantiere_id, stato, count(*) AS numero FROM attivita GROUP BY cantiere_id, stato"),
    "a04_site_progress": _with(
        "SELECT cantiere_id, CAST(round_even(CAST(somma AS DOUBLE) / totale, 0) AS INTEGER) AS avanzamento, totale, completate, in_corso, attivita_bloccate AS bloccate FROM task_facts"
    ),
    "a05_progress_table": _with(
        f"SELECT id, nome AS cantiere, coalesce(cliente, '') AS cliente, coalesce(capo_cantiere, '') AS capo_cantiere, coalesce(stato, '') AS stato, avanzamento, totale AS attivita_totali, completate, in_corso, attivita_bloccate AS bloccate, {_label('avanzamento')} AS sintesi FROM counted"
    ),
    "a06_risk_counters": _with("SELECT cantiere_id, critici, bloccanti, alti, decisioni, a_rischio FROM ticket_facts"),
    "a07_risk_score": _with(f"SELECT id, nome, punteggio, {_level('punteggio', 'Rosso', 'Giallo', 'Verde')} AS livello FROM scored"),
    "a08_latest_notices": _with(
        "SELECT cantiere_id, ticket_id, max(created_at) AS ultima_notifica, count(*) AS notifiche FROM notifiche WHERE ticket_id IS NOT NULL GROUP BY cantiere_id, ticket_id"
    ),
    "a09_notice_kpis": _with(
        f"""SELECT c.id AS cantiere_id, (SELECT count(*) FROM ticket t WHERE t.cantiere_id = c.id AND t.{K_STRICT}) AS ticket_aperti,
       (SELECT count(*) FROM notifiche n WHERE n.cantiere_id = c.id) AS preparate,
       (SELECT count(*) FROM notifiche n WHERE n.cantiere_id = c.id AND n.stato IN ('Inviata manualmente', 'Risposta ricevuta', 'Chiusa')) AS inviate,
       (SELECT count(*) FROM notifiche n WHERE n.cantiere_id = c.id AND n.risposta <> '') AS risposte FROM cantieri c"""
    ),
    "a10_foreman_kpis": _with(
        "SELECT id AS cantiere_id, totale - completate AS attivita_aperte, in_corso, attivita_bloccate AS bloccate, ticket_aperti_noti AS ticket_aperti, urgenti FROM counted"
    ),
    "a11_report_counters": _with("SELECT id AS cantiere_id, ticket_aperti, operativi AS blocchi_rischi, attivita_bloccate FROM counted"),
    "a12_points_to_confirm": _with("SELECT id AS cantiere_id, punti_cliente AS punti_da_confermare FROM counted"),
    "a13_budget_summary": _with(
        "SELECT cantiere_id AS id, budget_iniziale, costo_effettivo, extra_approvati, note_budget, totale_aggiornato, scostamento, budget_consumato_pct, stato_budget, gravita_budget FROM budget_facts"
    ),
    # --- sorted lists and top-k
    "l01_newest_sites": _with("SELECT id, nome, created_at FROM cantieri ORDER BY created_at DESC NULLS LAST, id"),
    "l02_crews_by_name": _with("SELECT id, nome FROM artigiani ORDER BY nome NULLS FIRST, id"),
    "l03_newest_ids": _with("SELECT id, stato FROM notifiche ORDER BY id DESC"),
    "l04_by_due_date": _with(f"SELECT id, scadenza, titolo FROM attivita ORDER BY {DUE}"),
    "l05_by_priority_rank": _with(f"SELECT id, priorita, scadenza FROM ticket ORDER BY {BY_RANK}"),
    "l06_by_priority_name": _with(_top("ticket", K_OPER, BY_NAME, "priorita, scadenza", 6)),
    "l07_next_tasks": _with(_top("attivita", T_NEXT, DUE, "titolo, assegnato_a, stato, scadenza, percentuale", 5)),
    "l08_next_due": _with(
        f"SELECT a.id AS id, c.nome AS cantiere, a.fase, a.titolo, a.assegnato_a, a.stato, a.priorita, a.scadenza, a.percentuale FROM attivita a JOIN cantieri c ON c.id = a.cantiere_id WHERE a.{T_NEXT} ORDER BY a.scadenza NULLS FIRST, a.id LIMIT 20"
    ),
    "l09_urgent_tasks": _with(_top("attivita", T_NEXT, BY_RANK, TASK_COLS, 8)),
    "l10_tickets_to_unblock": _with(_top("ticket", K_STRICT, BY_RANK, TICKET_COLS, 6)),
    "l11_bounded_bullets": _with(
        f"""SELECT x.cantiere_id AS cantiere_id, {_list('a')} AS completate, {_list('b')} AS in_corso, {_list('c')} AS prossime
FROM (SELECT DISTINCT cantiere_id FROM attivita WHERE stato IS NOT NULL) x LEFT JOIN tasks_done_4 a ON a.cantiere_id = x.cantiere_id
LEFT JOIN tasks_run_6 b ON b.cantiere_id = x.cantiere_id LEFT JOIN tasks_next_5 c ON c.cantiere_id = x.cantiere_id"""
    ),
    # --- scalar functions
    "m01_effective_percent": _with(
        f"SELECT id, CAST(CASE WHEN stato IN {DONE} THEN 100 WHEN percentuale IS NULL OR percentuale < 0 THEN 0 WHEN percentuale > 100 THEN 100 ELSE percentuale END AS INTEGER) AS percentuale_effettiva FROM attivita"
    ),
    "m02_progress_label": _with("SELECT id AS cantiere_id, avanzamento, sintesi FROM site_row"),
    "m03_priority_rank": _with(f"SELECT id, priorita, {RANK} AS rango FROM ticket"),
    "m04_progress_bar": _with("SELECT id AS cantiere_id, barra FROM site_row"),
    "m05_risk_level": _with("SELECT id AS cantiere_id, livello, rischio_sintesi, azione FROM site_row"),
    "m06_risk_reasons": _with("SELECT id AS cantiere_id, motivi FROM site_row"),
    "m07_euro": _with(
        "SELECT cantiere_id, "
        + ", ".join(f"{_euro(c)} AS {c}" for c in ("budget_iniziale", "costo_effettivo", "extra_approvati", "totale_aggiornato", "scostamento"))
        + " FROM budget_facts"
    ),
    "m08_budget_arithmetic": _with("SELECT cantiere_id, totale_aggiornato, scostamento, budget_consumato_pct FROM budget_facts"),
    "m09_budget_status": _with("SELECT cantiere_id, stato_budget, gravita_budget FROM budget_facts"),
    "m10_triage": _with("SELECT id, tipo, priorita, stato, impatto FROM triaged"),
    "m10_triage_updates": _with(
        "SELECT id, tipo, priorita, stato, impatto, titolo FROM triaged", feed="SELECT id, testo FROM aggiornamenti"
    ),
    "m10_triage_by_words": _with(
        "SELECT id, tipo, priorita, stato, impatto, titolo FROM triaged", feed="SELECT id, testo FROM aggiornamenti"
    ),
    "m11_message_title": _with("SELECT id, titolo FROM triaged"),
    "m12_notice_text": _with("SELECT id, messaggio FROM notice_bodies"),
    "m13_clean_phone": _with(f"SELECT id, {PHONE.format('telefono')} AS telefono FROM artigiani"),
    "m13_chat_link": _with(
        f"SELECT id, {_link('telefono', 'messaggio')} AS link FROM notifiche UNION ALL SELECT -id - 1, 'https://wa.me/?text=' || {LINK.format('testo')} FROM messaggi"
    ),
    "m14_close_stamp": _with(f"SELECT id, stato, CASE WHEN stato IN {CLOSED} THEN coalesce(closed_at, {NOW}) END AS closed_at FROM ticket"),
    "m15_quick_ticket_state": _with(
        "SELECT id, tipo, priorita, titolo, CASE WHEN tipo = 'Blocco' OR priorita = 'Critica' THEN 'Bloccante' ELSE 'Aperto' END AS stato, 'Capo cantiere' AS aperto_da, '2024-01-16' AS scadenza FROM ticket"
    ),
    "m16_note_append": _with(
        f"""SELECT x.id AS id, x.stato AS stato, CASE WHEN cambiata AND x.stato = 'Completata' THEN 100 WHEN cambiata THEN least(100, percentuale) ELSE percentuale END AS percentuale,
       CASE WHEN NOT cambiata THEN vecchia WHEN n.righe IS NULL THEN coalesce(vecchia, '') ELSE CASE WHEN coalesce(vecchia, '') = '' THEN '' ELSE vecchia || {NL} END || n.righe END AS note,
       closed_at FROM ({_changed("attivita", "quick_updates", ["stato", "priorita", "percentuale"], DONE, "l.id IS NOT NULL AS cambiata, t.note AS vecchia,")}) x
LEFT JOIN (SELECT id, string_agg('[' || strftime(ts, '%d/%m %H:%M') || '] ' || {_strip('nota')}, {NL} ORDER BY ts, seq) AS righe
           FROM quick_updates WHERE coalesce({_strip('nota')}, '') <> '' GROUP BY id) n ON n.id = x.id"""
    ),
    "m17_notice_stamps": _with(
        f"SELECT id, CASE WHEN stato = 'Inviata manualmente' THEN {NOW} END AS sent_at, CASE WHEN coalesce({_strip('risposta')}, '') <> '' THEN {NOW} ELSE responded_at END AS responded_at FROM notifiche"
    ),
    "m18_date_shift": _with(
        "SELECT id, CAST(CAST(data_inizio AS DATE) + 1 AS VARCHAR) AS scadenza_ticket, CAST(CAST(data_inizio AS DATE) + 7 AS VARCHAR) AS scadenza_attivita, CAST(CAST(data_inizio AS DATE) + 45 AS VARCHAR) AS fine_cantiere FROM cantieri"
    ),
    "m19_date_coerce": _with(
        "SELECT id, scadenza, TRY_CAST(scadenza AS DATE) IS NOT NULL AS leggibile, CAST(TRY_CAST(scadenza AS DATE) - DATE '1995-09-01' AS INTEGER) AS giorni FROM attivita"
    ),
    "m20_percent_coerce": _with("SELECT id, CAST(greatest(0, least(100, coalesce(percentuale, 0))) AS INTEGER) AS percentuale FROM attivita"),
    "m21_date_format": _with("SELECT id, strftime(TRY_CAST(scadenza AS DATE), '%d/%m/%Y') AS giorno FROM attivita"),
    "m22_labels": _with(
        "SELECT n.id AS id, n.id || ' - ' || coalesce(t.titolo, 'senza ticket') AS etichetta, n.id AS id_letto FROM notifiche n LEFT JOIN ticket t ON t.id = n.ticket_id"
    ),
    "m23_placeholders": _with(
        "SELECT id, coalesce(nullif(cliente, ''), '-') AS cliente, coalesce(nullif(data_fine_prevista, ''), '-') AS consegna_prevista, coalesce(note, '') AS note FROM cantieri"
    ),
    "m24_slug": _with("SELECT id, replace(replace(lower(nome || ' / ' || indirizzo), ' ', '_'), '/', '_') AS slug FROM cantieri"),
    "m25_bullets": _with(
        f"SELECT c.id AS cantiere_id, {_list('a')} AS elenco FROM cantieri c LEFT JOIN tickets_client_8 a ON a.cantiere_id = c.id"
    ),
    "m26_colours": _with(
        """SELECT 'ticket' AS tabella, id, CASE priorita WHEN 'Critica' THEN 'red' WHEN 'Alta' THEN 'yellow' WHEN 'Media' THEN 'blue' ELSE 'gray' END AS colore,
       CASE priorita WHEN 'Critica' THEN 'critical' WHEN 'Alta' THEN 'high' ELSE '' END AS classe FROM ticket
UNION ALL SELECT 'cantieri', id, CASE livello WHEN 'Rosso' THEN 'red' WHEN 'Giallo' THEN 'yellow' ELSE 'green' END, '' FROM site_row"""
    ),
    "m27_template_constants": _with(
        "SELECT 'Creato da template: ' || t.template AS note, 'Da fare' AS stato, CAST(0 AS BIGINT) AS percentuale, count(*) AS righe, CAST(0 AS BIGINT) AS con_dipendenza FROM template_requests r JOIN templates t ON t.template = r.template GROUP BY t.template"
    ),
    "m28_cards": _with(f"SELECT {_card('assegnato_a', 'fase')} FROM attivita UNION ALL SELECT {_card('responsabile', 'tipo')} FROM ticket"),
    # --- streams: the batch twin of what the stream wrote
    "t01_message_stream": _with(
        "SELECT id AS messaggio_id, cantiere_id, tipo, titolo, priorita, stato, impatto, '2024-01-16' AS scadenza, tipo AS categoria FROM triaged"
    ),
    "t02_notice_stream": _with(
        "SELECT cantiere_id, ticket_id, max(created_at) AS ultima_notifica, count(*) AS notifiche FROM notifiche WHERE ticket_id IS NOT NULL GROUP BY cantiere_id, ticket_id"
    ),
    "t03_change_stream": _with(_changed("ticket", "ticket_changes", ["stato", "priorita", "responsabile", "impatto"], CLOSED)),
    # --- composite queries and reports
    "r01_dashboard_sites": _with(
        """SELECT id AS cantiere_id, nome AS cantiere, totale, completate, CASE WHEN totale > 0 THEN CAST(round_even(CAST(completate AS DOUBLE) / totale * 100, 0) AS DOUBLE) ELSE 0 END AS tasso_completamento,
       in_corso, attivita_bloccate, ticket_aperti, bloccanti, scadute, avanzamento, sintesi, punteggio, livello, rischio_sintesi, motivi, azione FROM site_row"""
    ),
    "r01_dashboard_tasks": _with(
        "SELECT t.id AS id, c.nome AS cantiere, t.fase, t.titolo, t.assegnato_a, t.stato, t.priorita, t.scadenza, CAST(greatest(0, least(100, coalesce(t.percentuale, 0))) AS INTEGER) AS percentuale FROM attivita t JOIN cantieri c ON c.id = t.cantiere_id"
    ),
    "r01_dashboard_tickets": _with(
        f"SELECT t.id AS id, c.nome AS cantiere, t.tipo, t.titolo, t.responsabile, t.priorita, t.stato, t.scadenza, t.impatto FROM ticket t JOIN cantieri c ON c.id = t.cantiere_id WHERE t.{K_STRICT}"
    ),
    "r02_daily_report": DAILY,
    "r03_short_client_report": SHORT,
    "r04_client_progress_report": _report("Avanzamento cantiere", PROGRESS_LINES, a="tasks_todo_5"),
    "r05_client_budget_report": _report("Budget iniziale vs effettivo", BUDGET_LINES),
    "r06_client_works_report": _report("Lavori fatti / in corso / da fare", WORKS_LINES, **CLIENT_8),
    "r07_client_full_report": _report("Report cliente completo", FULL_LINES, **CLIENT_6),
    "r08_cover_message": _with(
        f"SELECT 'Messaggio breve' AS report, s.id AS cantiere_id, 'Ciao, ti inviamo l''aggiornamento del cantiere ' || s.nome || ' con avanzamento lavori, stato budget e prossimi passaggi.' || {NL} || {NL} || {_page(FULL_LINES)} AS testo {_joined(**CLIENT_6)}"
    ),
    "r09_client_cards": _with(
        f"""SELECT id AS cantiere_id, nome AS cantiere, coalesce(nullif(cliente, ''), '-') AS cliente, coalesce(nullif(indirizzo, ''), '-') AS indirizzo,
       coalesce(nullif(data_fine_prevista, ''), '-') AS consegna_prevista, avanzamento, sintesi, {_euro('budget_iniziale')} AS budget_iniziale, {_euro('costo_effettivo')} AS costo_effettivo,
       budget_consumato_pct, {_euro('totale_aggiornato')} AS totale_aggiornato, stato_budget, gravita_budget, punti_cliente AS punti_da_confermare FROM site_row"""
    ),
    "r09_client_lists": _with(
        " UNION ALL ".join(
            [
                _client_list("completate", T_DONE),
                _client_list("in_corso", T_RUN),
                _client_list("da_fare", T_TODO),
                f"SELECT cantiere_id, 'punti' AS sezione, CAST(row_number() OVER (PARTITION BY cantiere_id ORDER BY {BY_RANK}) AS INTEGER) AS posizione, id, titolo, "
                f"' ' || CASE WHEN scadenza <> '' THEN '· prevista ' || scadenza ELSE '' END AS riga FROM ticket WHERE {K_CLIENT} QUALIFY row_number() OVER (PARTITION BY cantiere_id ORDER BY {BY_RANK}) <= 6",
            ]
        )
    ),
    "r10_foreman_cards": _with(
        """SELECT id AS cantiere_id, nome AS cantiere, coalesce(nullif(cliente, ''), '-') AS cliente, coalesce(nullif(capo_cantiere, ''), '-') AS capo_cantiere, coalesce(nullif(stato, ''), '-') AS stato,
       avanzamento, sintesi, livello, rischio_sintesi, CASE livello WHEN 'Rosso' THEN 'red' WHEN 'Giallo' THEN 'yellow' ELSE 'green' END AS colore_rischio, motivi, azione,
       totale - completate AS attivita_aperte, in_corso, attivita_bloccate AS bloccate, ticket_aperti_noti AS ticket_aperti, urgenti FROM site_row"""
    ),
    "r10_foreman_tasks": _with(
        f"SELECT {_card('assegnato_a', 'fase', 'posizione,')}, coalesce(percentuale, 0) AS percentuale FROM ({_top('attivita', T_NEXT, BY_RANK, TASK_COLS, 8)})"
    ),
    "r10_foreman_blocks": _with(f"SELECT {_card('responsabile', 'tipo', 'posizione,')} FROM ({_top('ticket', K_STRICT, BY_RANK, TICKET_COLS, 6)})"),
    "r10_foreman_open_tickets": _with(f"SELECT cantiere_id, id, {TICKET_COLS} FROM ticket WHERE {K_STRICT}"),
    "r11_notice_log": _with(
        "SELECT n.cantiere_id AS cantiere_id, n.id AS id, n.ticket_id AS ticket_id, t.titolo AS ticket, n.destinatario, n.telefono, n.canale, n.stato, n.created_at, n.sent_at, n.responded_at, n.risposta FROM notifiche n LEFT JOIN ticket t ON t.id = n.ticket_id"
    ),
    "r12_template_preview": _with(
        "SELECT r.cantiere_id AS cantiere_id, t.fase, t.titolo, t.descrizione, t.ruolo AS ruolo_suggerito, t.priorita, CAST(t.giorno AS INTEGER) AS giorno, 0 AS avanzamento FROM template_requests r JOIN templates t ON t.template = r.template"
    ),
    "r13_site_register": _with("SELECT id, nome, cliente, indirizzo, capo_cantiere, stato, data_inizio, data_fine_prevista FROM cantieri"),
    "r13_crew_register": _with("SELECT id, nome, ruolo, telefono, email, note FROM artigiani WHERE attivo = 1"),
    "r13_task_register": _with(f"SELECT cantiere_id, id, {TASK_COLS}, note FROM attivita"),
    "r13_ticket_register": _with("SELECT cantiere_id, id, tipo, titolo, aperto_da, responsabile, priorita, stato, scadenza, impatto FROM ticket"),
}
ORACLES["r11_notice_figures"] = ORACLES["a09_notice_kpis"]
ORACLES["r13_pick_lists"] = _with(
    "SELECT 'cantieri' AS tabella, id, id || ' - ' || nome AS etichetta FROM cantieri UNION ALL SELECT 'attivita', id, id || ' - ' || titolo FROM attivita"
)
_LATEST = (
    "SELECT t.cantiere_id AS cantiere_id, t.id AS id, t.tipo, t.titolo, t.responsabile, t.priorita, t.stato, t.scadenza, t.impatto, t.descrizione, "
    "n.ultima_notifica AS ultima_notifica, n.notifiche AS notifiche FROM ticket t LEFT JOIN (SELECT cantiere_id, ticket_id, max(created_at) AS ultima_notifica, count(*) AS notifiche "
    f"FROM notifiche WHERE ticket_id IS NOT NULL GROUP BY cantiere_id, ticket_id) n ON n.ticket_id = t.id AND n.cantiere_id = t.cantiere_id WHERE t.{K_STRICT}"
)
ORACLES["j04_tickets_latest_notice"] = _with(_LATEST)
ORACLES["r11_notice_centre"] = _with(_LATEST)
