"""Hand-computed values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions import predicates as p
from siteloom.functions import scalars as s
from siteloom.functions import triage as triage_module
from siteloom.functions.triage import LISTS, TriageWords, triage, triage_by_language, word_table
from siteloom.operators import budget, counts, lists, notices, risk, templates
from siteloom.operators.changes import validated
from siteloom.plans import client, dashboard, foreman, reports
from siteloom.plans.facts import site_facts
from tests.helpers import DAY, demo_tables, make_tables, one


def column(spark, values, kind, expression):
    rows = [(i, x) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").select("i", expression.alias("y"))
    return [r.y for r in sorted(df.collect())]


def test_progress_bar(spark):
    cases = {0: 0, 5: 0, 12: 1, 15: 2, 25: 2, 35: 4, 45: 4, 55: 6, 65: 6, 75: 8, 85: 8, 95: 10, 100: 10, 130: 10, -5: 0}
    got = column(spark, list(cases), "int", s.progress_bar(F.col("x")))
    assert [g.count("█") for g in got] == list(cases.values())
    assert all(len(g) == 10 for g in got)
    assert one(spark, s.progress_bar(F.col("x"), 4), x=("int", 50)) == "██░░"


def test_progress_label(spark):
    cases = {
        19: "In partenza", 20: "Avviato", 49: "Avviato", 50: "Avanzamento intermedio", 79: "Avanzamento intermedio",
        80: "Fase finale", 99: "Fase finale", 100: "Completato", None: "In partenza",
    }
    assert column(spark, list(cases), "int", s.progress_label(F.col("x"))) == list(cases.values())


@pytest.mark.parametrize(
    "state, percent, expected",
    [("Verificata", 10, 100), ("In corso", 130, 100), (None, -5, 0), ("Da fare", None, 0), ("In corso", 35, 35)],
)
def test_effective_percent(spark, state, percent, expected):
    got = one(spark, s.effective_percent(F.col("s"), F.col("n")), s=("string", state), n=("bigint", percent))
    assert got == expected


def test_percent_from_dirty_text(spark):
    values = ["40", "12.7", "abc", None, "250", "-3", "NaN"]
    assert column(spark, values, "string", s.whole_percent(F.col("x"))) == [40, 0, 0, 0, 250, -3, 0]
    assert column(spark, values, "string", s.shown_percent(F.col("x"))) == [40, 12, 0, 0, 100, 0, 0]


def test_euro(spark):
    assert column(spark, [1234567.5, 2.5, None, -28300.0], "double", s.euro(F.col("x"))) == [
        "€ 1.234.568", "€ 2", "€ 0", "€ -28.300",
    ]


def test_phone_and_link(spark):
    phones = ["+39 339 1234567", "0039-340.12", None, "", "00 39"]
    assert column(spark, phones, "string", s.clean_phone(F.col("x"))) == ["393391234567", "3934012", "", "", "39"]
    encoded = one(spark, s.percent_encoded(F.col("x")), x=("string", "è/ok a*b~c & 1+1=2"))
    assert encoded == "%C3%A8/ok%20a%2Ab~c%20%26%201%2B1%3D2"
    link = one(spark, s.chat_link(F.col("p"), F.col("m")), p=("string", "0039 1"), m=("string", "a b"))
    assert link == "https://wa.me/391?text=a%20b"


def test_dates(spark):
    values = ["2024-02-29", "n/d", None, "", "2023-02-29", "29/02/2024"]
    got = column(spark, values, "string", s.parse_date(F.col("x")))
    assert got == [dt.date(2024, 2, 29), None, None, None, None, None]
    assert one(spark, s.italian_date(F.col("d")), d=("date", dt.date(2024, 2, 9))) == "09/02/2024"
    assert one(spark, s.shift_days(F.col("d"), 45), d=("date", dt.date(2024, 1, 1))) == "2024-02-15"


def test_strip_takes_every_blank(spark):
    assert one(spark, s.strip(F.col("x")), x=("string", "   \t\nab c\x1f　")) == "ab c"


def test_labels(spark):
    assert one(spark, s.id_of_label(F.col("x")), x=("string", "17 - a - b")) == 17
    assert one(spark, s.slug(F.col("x")), x=("string", "Lavori fatti / in corso / da fare")) == "lavori_fatti___in_corso___da_fare"


# --- triage ----------------------------------------------------------------
TRIAGE = [
    ("Ho finito le tracce, ma manca conferma posizione termoarredo. Domani non posso chiudere.", "Completamento attività", "Media", "Aperto", v.IMPACT_COMPLETION, "Ho finito le tracce, ma manca conferma posizione termoarredo"),
    ("Sono fermo, manca il materiale. Urgente", "Blocco", "Critica", "Bloccante", v.IMPACT_BLOCK, "Sono fermo, manca il materiale"),
    ("Non posso proseguire oggi", "Blocco", "Critica", "Bloccante", v.IMPACT_BLOCK, "Non posso proseguire oggi"),
    ("Serve conferma del cliente sui sanitari", "Richiesta decisione", "Media", "Aperto", v.IMPACT_MATERIAL, "Serve conferma del cliente sui sanitari"),
    ("Servono le piastrelle. Grazie", "Richiesta materiale", "Media", "Aperto", v.IMPACT_MATERIAL, "Servono le piastrelle"),
    ("Arrivo subito", "Avanzamento", "Alta", "Aperto", "", "Arrivo subito"),
    ("Pittura del soggiorno", "Avanzamento", "Alta", "Aperto", "", "Pittura del soggiorno"),
    ("   ", "Avanzamento", "Media", "Aperto", "", "Nuova segnalazione cantiere"),
    (". punto iniziale", "Avanzamento", "Media", "Aperto", "", ""),
    (None, "Avanzamento", "Media", "Aperto", "", "Nuova segnalazione cantiere"),
    ("x" * 90, "Avanzamento", "Media", "Aperto", "", "x" * 80),
    ("y" * 5000 + " urgente", "Avanzamento", "Alta", "Aperto", "", "y" * 80),
]


def test_triage(spark):
    rows = [(i, case[0]) for i, case in enumerate(TRIAGE)]
    got = triage(spark.createDataFrame(rows, "id int, testo string")).orderBy("id").collect()
    assert [(r.testo, r.tipo, r.priorita, r.stato, r.impatto, r.titolo) for r in got] == TRIAGE


def test_triage_with_other_words(spark):
    english = TriageWords(block=["stuck"], urgent=["now"], material=["tiles"], decision=["approve"], completion=["done"])
    df = spark.createDataFrame([("We are STUCK now",)], "testo string")
    row = triage(df, words=english).first()
    assert (row.tipo, row.priorita, row.stato) == ("Blocco", "Critica", "Bloccante")


OUTPUTS = ["tipo", "priorita", "stato", "impatto", "titolo"]


def test_triage_by_a_table_of_words(spark):
    rows = [(i, case[0]) for i, case in enumerate(TRIAGE)]
    messages = spark.createDataFrame(rows, "id int, testo string")
    got = triage_by_language(messages, word_table(spark)).orderBy("id").collect()
    assert [(r.testo, r.tipo, r.priorita, r.stato, r.impatto, r.titolo) for r in got] == TRIAGE


@pytest.mark.parametrize("small", [True, False])
def test_triage_by_language(spark, monkeypatch, small):
    """Each message by its own language's words; words in others, with marks, in capitals; odd rows of the table."""
    monkeypatch.setattr(triage_module, "SMALL_WORDS", 1 << 20 if small else -1)
    english = TriageWords(
        block=["stuck", "a.b", r"c\Ed", "on hold", "hold"], urgent=["now", "on h", "."], material=["tiles", "tile"], decision=["APPROVE"], completion=["done", "aa"]
    )
    words = word_table(spark).union(word_table(spark, english, "en")).union(word_table(spark, english, "en"))
    odd = [("en", "block", ""), ("en", "block", None), ("en", "no such list", "we"), ("en", None, "we"), ("de", "urgent", "sofort")]
    words = words.union(spark.createDataFrame(odd, words.schema))
    texts = ["We are STUCK now", "on hold", "axb", "A.B", r"x c\ed", "approve tiles", "aaa done", "urgente", "sofort", "", None, "n" * 9000 + "ow", "hold on h"]
    plain = {"en": english, "de": TriageWords([], ["sofort"], [], [], []), "fr": TriageWords([], [], [], [], []), None: TriageWords()}
    for language, own in plain.items():
        rows = [(i, text, language, "kept") for i, text in enumerate(texts)]
        messages = spark.createDataFrame(rows, "id int, testo string, lingua string, modello string")
        lowered = TriageWords(**{name: [w.lower() for w in getattr(own, name)] for name in LISTS})
        columns = ["id", "testo", "lingua", "modello", *OUTPUTS]
        expected = triage(messages, words=lowered).select(columns).orderBy("id").collect()
        assert triage_by_language(messages, words).select(columns).orderBy("id").collect() == expected
    nothing = triage_by_language(messages.limit(0), words.limit(0))
    assert nothing.columns == [*messages.columns, *OUTPUTS] and nothing.count() == 0


# --- demo site -------------------------------------------------------------
def test_demo_site(spark):
    t = demo_tables(spark)
    row = site_facts(t, DAY).first()
    assert (row.avanzamento, row.sintesi, row.barra) == (12, "In partenza", "█░░░░░░░░░")
    assert (row.punteggio, row.livello, row.motivi) == (2, "Verde", "1 decisioni/materiali da confermare")
    assert (row.totale_aggiornato, row.scostamento, row.budget_consumato_pct) == (19700.0, -28300.0, 41)
    assert (row.stato_budget, row.gravita_budget) == ("Allineato al budget", "good")
    nexts = lists.next_tasks(t.attivita).orderBy("posizione").collect()
    assert [r.id for r in nexts] == [1, 2, 4, 3, 5]


def test_demo_site_three_days_later(spark):
    row = site_facts(demo_tables(spark), DAY + dt.timedelta(days=3)).first()
    assert (row.scadute, row.punteggio, row.livello) == (1, 4, "Giallo")
    assert row.motivi == "1 attività scadute, 1 decisioni/materiali da confermare"


def test_demo_daily_report(spark):
    t = demo_tables(spark)
    pages = {r.report: r.testo for r in reports.daily_reports(t, DAY, v.Brand("Acme")).collect()}
    text = pages["Report interno"]
    assert text.startswith("REPORT GIORNALIERO ACME - 06/05/2024\n\nCantiere: Demo\nCliente: Client\nCapo cantiere: Lead\n\n")
    assert "AVANZAMENTO GENERALE CANTIERE: 12%\n█░░░░░░░░░ 12% - In partenza\n" in text
    assert "1) ATTIVITÀ COMPLETATE / VERIFICATE\n- Nessuno\n\n2) ATTIVITÀ IN CORSO\n- Task 1 (60%)\n\n" in text
    assert "5) DECISIONI / AZIONI RICHIESTE\n- Confirm position\n\n6) RISCHIO TEMPI\n- Ticket aperti: 1\n- Blocchi o rischi aperti: 1\n" in text
    assert "- Task 1 (60%)\n- Task 2 (0%)\n- Task 4 (0%)\n- Task 3 (0%)\n- Task 5 (0%)\n\nSintesi Acme:\n" in text
    assert text.endswith("finestra operativa.\n")
    assert "Acme sta presidiando" in pages["Versione cliente"]


def test_demo_client_reports(spark):
    t = demo_tables(spark)
    brand = v.Brand("Acme", "Acme OS", "Acme footer")
    pages = {r.report: r.testo for r in reports.client_reports(t, DAY, brand).collect()}
    assert set(pages) == set(v.CLIENT_TITLES)
    head = "\n\nACME OS | Aggiornamento cliente\nCantiere: Demo\nCliente: Client\nData aggiornamento: 06/05/2024\n\n"
    assert all(head in text for text in pages.values())
    money = pages["Budget iniziale vs effettivo"]
    assert "Budget iniziale: € 48.000\nCosto effettivo maturato: € 18.500\nExtra approvati: € 1.200\n" in money
    assert money.endswith("Scostamento: € -28.300\nBudget consumato: 41%\nStato: Allineato al budget\n\nNota Acme:\ndemo\n")
    assert pages["Report cliente completo"].startswith("REPORT CLIENTE COMPLETO ACME\n")
    assert pages["Report cliente completo"].endswith("\n\nAcme footer\n")
    assert pages["Lavori fatti / in corso / da fare"].endswith("Punti da confermare o monitorare:\n- Confirm position\n")


def test_dashboard_scope(spark, tables):
    """One site on its own gives the rows that it has among all sites."""
    day = dt.date(1995, 9, 1)
    site = 5
    whole, single = dashboard.operations_dashboard(tables, day), dashboard.operations_dashboard(tables, day, site)
    assert single["cantieri"].collect() == whole["cantieri"].where(F.col("cantiere_id") == site).collect()
    assert single["avanzamento"].collect() == whole["avanzamento"].where(F.col("id") == site).collect()
    mine = single["kpi"].where("vista = 'tutti'").drop("vista", "cantiere_id").collect()
    assert mine == whole["kpi"].where(F.col("cantiere_id") == site).drop("vista", "cantiere_id").collect()
    name = whole["cantieri"].where(F.col("cantiere_id") == site).first().cantiere
    for part in ("ticket_aperti", "attivita"):
        expected = [r for r in whole[part].collect() if r.cantiere == name]
        assert single[part].collect() == expected
    assert single["prossime"].count() <= 20


def test_views_are_complete(spark, tables):
    view = foreman.foreman_view(tables, dt.date(1995, 9, 1))
    assert set(view) == {"schede", "oggi", "blocchi", "ticket"}
    cards = client.client_cards(tables, dt.date(1995, 9, 1))
    assert cards.count() == tables.cantieri.count()


# --- risk and budget limits ------------------------------------------------
def test_risk_levels(spark):
    scores = [3, 4, 8, 9]
    assert column(spark, scores, "int", risk.risk_level(F.col("x"))) == ["Verde", "Giallo", "Giallo", "Rosso"]
    red = column(spark, [9], "int", risk.risk_action(F.col("x"), v.Brand("Acme")))
    assert red == ["Serve intervento immediato del capo cantiere/Acme sui blocchi aperti."]


def test_one_critical_block_is_red(spark):
    t = make_tables(
        spark,
        cantieri=[{"id": 1, "nome": "A"}, {"id": 2, "nome": "B"}],
        ticket=[{"id": 1, "cantiere_id": 1, "tipo": "Blocco", "priorita": "Critica", "stato": "Bloccante"},
                {"id": 2, "cantiere_id": 2, "tipo": "Blocco", "priorita": "Alta", "stato": None}],
    )
    rows = {r.id: r for r in risk.risk_board(t.cantieri, t.attivita, t.ticket, DAY).collect()}
    assert (rows[1].punteggio, rows[1].livello) == (9, "Rosso")
    assert rows[1].motivi == ["1 ticket critici", "1 ticket bloccanti"]
    # an unknown state counts as open; block and priority score but give no reason
    assert (rows[2].punteggio, rows[2].motivi) == (3, ["nessun blocco rilevante aperto"])


def test_budget_limits(spark):
    cases = [(0.0, 50.0), (100.0, 100.0), (100.0, 110.0), (100.0, 111.0), (100.0, 250.0), (None, None), (200.0, 25.0)]
    t = make_tables(
        spark,
        cantieri=[{"id": i} for i in range(len(cases) + 1)],
        budget_cantiere=[{"id": i, "cantiere_id": i, "budget_iniziale": b, "costo_effettivo": c} for i, (b, c) in enumerate(cases)],
    )
    rows = budget.budget_summary(t.cantieri, t.budget_cantiere).orderBy("id").collect()
    assert [r.stato_budget for r in rows] == [
        "Budget da inserire", "Allineato al budget", "Scostamento da monitorare", "Extra budget rilevante",
        "Extra budget rilevante", "Budget da inserire", "Allineato al budget", "Budget da inserire",
    ]
    assert [r.budget_consumato_pct for r in rows] == [0, 100, 110, 111, 200, 0, 12, 0]
    assert (rows[0].scostamento, rows[7].note_budget) == (50.0, "")


def test_half_even_mean(spark):
    t = make_tables(
        spark,
        cantieri=[{"id": 1}],
        attivita=[{"id": i, "cantiere_id": 1, "stato": "In corso", "percentuale": pc} for i, pc in enumerate((10, 15))],
    )
    assert counts.site_progress(t.cantieri, t.attivita).first().avanzamento == 12


# --- small rules -----------------------------------------------------------
@pytest.mark.parametrize(
    "state, old, expected",
    [("Chiuso", None, "now"), ("Risolto", "old", "old"), ("Aperto", "old", None), (None, "old", None)],
)
def test_close_stamp(spark, state, old, expected):
    stamp = s.close_stamp(v.TICKET_CLOSED, F.col("s"), F.col("o"), F.lit("now"))
    assert one(spark, stamp, s=("string", state), o=("string", old)) == expected


@pytest.mark.parametrize(
    "kind, priority, expected",
    [("Blocco", "Bassa", "Bloccante"), ("Avanzamento", "Critica", "Bloccante"), ("Avanzamento", None, "Aperto"), (None, "Critica", "Bloccante")],
)
def test_quick_ticket_state(spark, kind, priority, expected):
    got = one(spark, s.quick_ticket_state(F.col("k"), F.col("p")), k=("string", kind), p=("string", priority))
    assert got == expected


@pytest.mark.parametrize(
    "old, note, expected",
    [("a", "b", "a\n[06/05 07:08] b"), ("a", "  ", "a"), ("", " b ", "[06/05 07:08] b"), (None, "b", "[06/05 07:08] b"), (None, None, "")],
)
def test_note_append(spark, old, note, expected):
    now = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    assert one(spark, s.appended_note(F.col("o"), F.col("n"), now), o=("string", old), n=("string", note)) == expected


def test_required_text(spark):
    batch = spark.createDataFrame([(1, "  a "), (2, " \n"), (3, None)], "id int, titolo string")
    rows = {r.id: (r.titolo, r.accettata) for r in validated(batch, "ticket").collect()}
    assert rows == {1: ("a", True), 2: ("", False), 3: (None, False)}


def test_open_predicates_differ_on_null(spark):
    strict = one(spark, F.coalesce(p.ticket_open_strict(F.col("s")), F.lit(False)), s=("string", None))
    lenient = one(spark, p.ticket_open_lenient(F.col("s")), s=("string", None))
    assert (strict, lenient) == (False, True)


def test_notice_text(spark):
    columns = {
        "id": ("bigint", 7), "titolo": ("string", "T"), "tipo": ("string", "Blocco"), "priorita": ("string", None),
        "responsabile": ("string", ""), "scadenza": ("string", None), "impatto": ("string", ""), "descrizione": ("string", "long story"),
    }
    body = notices.notice_text(F.lit("Site"), {c: F.col(c) for c in columns}, brand=v.Brand("Acme", "Acme OS"))
    assert one(spark, body, **columns).split("\n") == [
        "Acme OS | Azione richiesta", "Cantiere: Site", "Ticket #7: T", "Tipo: Blocco · Priorità: -", "Responsabile: referente",
        "Scadenza: da confermare", "", "Serve un aggiornamento per sbloccare il flusso del cantiere.", "", "Dettaglio: long story", "",
        "Rispondi con:", "1 = confermo / procedo", "2 = mi serve una informazione", "3 = non posso procedere", "", "Grazie, Acme",
    ]
    named = notices.notice_text(F.lit("Site"), {c: F.col(c) for c in columns}, recipient=F.lit("Bob"))
    assert "Responsabile: Bob" in one(spark, named, **columns)


def test_templates(spark):
    requests = spark.createDataFrame(
        [(1, "Cucina", DAY), (2, "nothing like it", DAY)], "cantiere_id bigint, template string, inizio date"
    )
    rows = templates.expand_templates(requests).orderBy("posto").collect()
    assert len(rows) == 10 and {r.cantiere_id for r in rows} == {1}
    assert (rows[-1].scadenza, rows[-1].stato, rows[-1].note) == ("2024-05-22", "Da fare", "Creato da template: Cucina")
    assert templates.template_tasks(spark).count() == 42
