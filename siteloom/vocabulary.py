"""Words, lookup tables and text formats of the works-coordination domain.

Everything here is a fixed value: results are only right when these words are
exactly these words. No logic lives in this module.
"""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------
# enumerations
# --------------------------------------------------------------------------
TASK_STATES = ["Da fare", "In corso", "Bloccata", "Completata", "Verificata"]
TASK_DONE = ["Completata", "Verificata"]
TASK_TODO = ["Da fare", "Bloccata"]
TASK_RUNNING = "In corso"
TASK_BLOCKED = "Bloccata"

TICKET_STATES = ["Aperto", "In gestione", "Bloccante", "Risolto", "Chiuso"]
TICKET_CLOSED = ["Risolto", "Chiuso"]
TICKET_BLOCKING = "Bloccante"
TICKET_OPEN = "Aperto"

PRIORITIES = ["Bassa", "Media", "Alta", "Critica"]
PRIORITY_DEFAULT = "Media"
PRIORITY_CRITICAL = "Critica"
PRIORITY_HIGH = "Alta"
PRIORITIES_URGENT = ["Alta", "Critica"]

TYPE_PROGRESS = "Avanzamento"
TYPE_BLOCK = "Blocco"
TYPE_DECISION = "Richiesta decisione"
TYPE_MATERIAL = "Richiesta materiale"
TYPE_EXTRA = "Extra lavoro"
TYPE_DELAY = "Rischio ritardo"
TYPE_COMPLETION = "Completamento attività"
TYPES_FOR_CLIENT = [TYPE_DECISION, TYPE_MATERIAL, TYPE_EXTRA]
TYPES_OPERATIONAL = [TYPE_BLOCK, TYPE_DECISION, TYPE_MATERIAL, TYPE_DELAY]
TYPES_TO_CONFIRM = [TYPE_DECISION, TYPE_MATERIAL]
TYPES_AT_RISK = [TYPE_BLOCK, TYPE_DELAY]

SITE_STATES = ["Attivo", "In pausa", "Completato", "Archiviato"]
NOTICE_STATES = ["Preparata", "Inviata manualmente", "Risposta ricevuta", "Chiusa"]
NOTICE_SENT_BY_HAND = "Inviata manualmente"
NOTICE_SENT = ["Inviata manualmente", "Risposta ricevuta", "Chiusa"]
NOTICE_KEEP_TICKET = "Non modificare"
CHANNELS = ["WhatsApp", "WhatsApp gruppo", "Email", "Telefonata", "Altro"]
FOREMAN = "Capo cantiere"

# --------------------------------------------------------------------------
# Default day offsets of a new row
# --------------------------------------------------------------------------
TICKET_DUE_DAYS = 1
TASK_DUE_DAYS = 7
SITE_END_DAYS = 45

# --------------------------------------------------------------------------
# Message triage. A word matches anywhere inside the text.
# --------------------------------------------------------------------------
WORDS_BLOCK = ["blocc", "non posso", "fermo", "manca", "impossibile", "non riesco"]
WORDS_URGENT = ["urgente", "subito", "oggi", "domani mattina"]
WORDS_MATERIAL = ["materiale", "piastrel", "sanitari", "rubinet", "massetto", "porta", "fornitura"]
WORDS_DECISION = ["conferma", "decidere", "scelta", "cliente", "autorizzazione"]
WORDS_COMPLETION = ["finito", "completato", "chiuso", "terminato"]

IMPACT_BLOCK = "Possibile ritardo se non gestito entro 24 ore."
IMPACT_MATERIAL = "Verificare disponibilità materiale per evitare fermo cantiere."
IMPACT_DECISION = "Serve decisione per proseguire senza rilavorazioni."
IMPACT_COMPLETION = "Verificare e aggiornare avanzamento attività."
TITLE_DEFAULT = "Nuova segnalazione cantiere"
TITLE_LENGTH = 80

# --------------------------------------------------------------------------
# Progress labels (lowest percent, label), highest first
# --------------------------------------------------------------------------
PROGRESS_LABELS = [
    (100, "Completato"),
    (80, "Fase finale"),
    (50, "Avanzamento intermedio"),
    (20, "Avviato"),
]
PROGRESS_LABEL_ELSE = "In partenza"
BAR_FULL = "█"
BAR_EMPTY = "░"
BAR_BLOCKS = 10

# --------------------------------------------------------------------------
# Risk score weights, levels (lowest score, level, summary,
# suggested action) and reasons
# --------------------------------------------------------------------------
RISK_WEIGHTS = {
    "critici": 4,
    "bloccanti": 3,
    "attivita_bloccate": 3,
    "scadute": 2,
    "a_rischio": 2,
    "alti": 1,
    "decisioni": 1,
}
RISK_RED = (
    9,
    "Rosso",
    "Rischio operativo alto",
    "Serve intervento immediato del capo cantiere{brand_or} sui blocchi aperti.",
)
RISK_YELLOW = (
    4,
    "Giallo",
    "Attenzione operativa",
    "Monitorare ticket, decisioni e attività critiche entro la giornata.",
)
RISK_GREEN = (
    None,
    "Verde",
    "Cantiere sotto controllo",
    "Continuare aggiornamento attività e report giornaliero.",
)
RISK_REASONS = [
    ("critici", "ticket critici"),
    ("bloccanti", "ticket bloccanti"),
    ("attivita_bloccate", "attività bloccate"),
    ("scadute", "attività scadute"),
    ("decisioni", "decisioni/materiali da confermare"),
]
RISK_NO_REASON = "nessun blocco rilevante aperto"

# --------------------------------------------------------------------------
# Budget status (text, severity) and limits
# --------------------------------------------------------------------------
BUDGET_MISSING = ("Budget da inserire", "watch")
BUDGET_ALIGNED = ("Allineato al budget", "good")
BUDGET_WATCH = ("Scostamento da monitorare", "watch")
BUDGET_ALERT = ("Extra budget rilevante", "alert")
BUDGET_TOLERANCE = 1.1
BUDGET_PERCENT_MAX = 200
BUDGET_NO_NOTE = "Nessuna nota economica specifica."

# --------------------------------------------------------------------------
# Severity colours
# --------------------------------------------------------------------------
PRIORITY_COLOURS = {"Critica": "red", "Alta": "yellow", "Media": "blue"}
PRIORITY_COLOUR_ELSE = "gray"
RISK_COLOURS = {"Rosso": "red", "Giallo": "yellow"}
RISK_COLOUR_ELSE = "green"
CARD_CLASSES = {"Critica": "critical", "Alta": "high"}

# --------------------------------------------------------------------------
# Small texts
# --------------------------------------------------------------------------
DASH = "-"
NO_OWNER = "Da assegnare"
NO_TICKET = "senza ticket"
NO_ROWS_BULLET = "- Nessuno"
TEMPLATE_NOTE = "Creato da template: "
CHAT_LINK = "https://wa.me/"

# --------------------------------------------------------------------------
# Lines of the outbound ticket notice
# --------------------------------------------------------------------------
NOTICE_TITLE = "Azione richiesta"
NOTICE_NO_DUE = "da confermare"
NOTICE_NO_OWNER = "referente"
NOTICE_ASK = "Serve un aggiornamento per sbloccare il flusso del cantiere."
NOTICE_ANSWERS = [
    "Rispondi con:",
    "1 = confermo / procedo",
    "2 = mi serve una informazione",
    "3 = non posso procedere",
]
NOTICE_THANKS = "Grazie"

# --------------------------------------------------------------------------
# Headings and closing lines of the reports
# --------------------------------------------------------------------------
DAILY_TITLE = "REPORT GIORNALIERO"
DAILY_HEADINGS = {
    "completate": "1) ATTIVITÀ COMPLETATE / VERIFICATE",
    "in_corso": "2) ATTIVITÀ IN CORSO",
    "bloccate": "3) ATTIVITÀ BLOCCATE",
    "operativi": "4) TICKET APERTI CRITICI / OPERATIVI",
    "decisioni": "5) DECISIONI / AZIONI RICHIESTE",
    "tempi": "6) RISCHIO TEMPI",
    "prossime": "7) PROSSIME ATTIVITÀ DA PRESIDIARE",
}
DAILY_CLOSING = (
    "Il cantiere è da monitorare con priorità sui blocchi aperti e sulle decisioni richieste. "
    "Aggiornare responsabili e scadenze entro la prossima finestra operativa."
)
SHORT_TITLE = "Aggiornamento cantiere"
SHORT_HEADINGS = {
    "completate": "Attività completate/verificate:",
    "in_corso": "Attività in corso:",
    "prossime": "Prossimi passaggi previsti:",
    "da_confermare": "Punti da confermare / monitorare:",
}
SHORT_CLOSING = (
    "{who} sta presidiando le attività aperte per mantenere il corretto avanzamento del cantiere. "
    "Eventuali decisioni richieste verranno condivise in modo puntuale."
)
CLIENT_UPDATE = "Aggiornamento cliente"
CLIENT_TITLES = {
    "Avanzamento cantiere": "REPORT AVANZAMENTO CANTIERE",
    "Budget iniziale vs effettivo": "REPORT BUDGET INIZIALE VS EFFETTIVO",
    "Lavori fatti / in corso / da fare": "REPORT LAVORI FATTI / IN CORSO / DA FARE",
    "Report cliente completo": "REPORT CLIENTE COMPLETO",
}
WORKS_HEADINGS = {
    "completate": "Lavori completati:",
    "in_corso": "Lavori in corso:",
    "da_fare": "Lavori da fare / prossimi passaggi:",
    "punti": "Punti da confermare o monitorare:",
}
FULL_HEADINGS = {
    "avanzamento": "1. AVANZAMENTO",
    "budget": "2. BUDGET",
    "completate": "3. LAVORI COMPLETATI",
    "in_corso": "4. LAVORI IN CORSO",
    "da_fare": "5. PROSSIMI LAVORI / DA FARE",
    "punti": "6. PUNTI DA CONFERMARE O MONITORARE",
}
FULL_CLOSING = (
    "Il cantiere è presidiato con metodo{brand_after}: avanzamento lavori, budget e prossime attività "
    "sono monitorati in modo strutturato. Eventuali decisioni richieste saranno condivise in modo puntuale."
)
COVER = (
    "Ciao, ti inviamo l'aggiornamento{brand_after} del cantiere ",
    " con avanzamento lavori, stato budget e prossimi passaggi.",
)

# --------------------------------------------------------------------------
# Plan templates
# (template, fase, titolo, descrizione, ruolo, priorità, giorno); every task
# starts at 0 percent
# --------------------------------------------------------------------------
PLAN_TEMPLATES = [
    ("Bagno completo", "Sopralluogo / setup", "Sopralluogo tecnico e conferma scelte bagno", "Verifica misure, layout, vincoli e conferme cliente", "Capo cantiere", "Alta", 0),
    ("Bagno completo", "Demolizioni", "Demolizione bagno", "Rimozione sanitari, rivestimenti, pavimento e smaltimento", "Muratore", "Alta", 2),
    ("Bagno completo", "Murature / tracce", "Apertura tracce bagno", "Tracce per punti acqua, scarichi, prese e termoarredo", "Muratore", "Alta", 4),
    ("Bagno completo", "Impianto idraulico", "Predisposizione impianto idraulico", "Punti lavabo, doccia, wc, bidet e termoarredo", "Idraulico", "Alta", 6),
    ("Bagno completo", "Impianto elettrico", "Predisposizione punti elettrici bagno", "Prese, interruttori, specchio, aspirazione e luci", "Elettricista", "Media", 6),
    ("Bagno completo", "Murature / tracce", "Chiusura tracce", "Chiusura tracce dopo verifica impianti", "Muratore", "Alta", 8),
    ("Bagno completo", "Massetti / sottofondi", "Impermeabilizzazione e sottofondo", "Preparazione fondo per posa pavimenti/rivestimenti", "Muratore", "Media", 10),
    ("Bagno completo", "Pavimenti / rivestimenti", "Posa rivestimenti bagno", "Posa rivestimenti secondo scelte cliente", "Pavimentista", "Media", 14),
    ("Bagno completo", "Pavimenti / rivestimenti", "Posa pavimento bagno", "Posa pavimento e fughe", "Pavimentista", "Media", 16),
    ("Bagno completo", "Sanitari / rubinetterie", "Installazione sanitari e rubinetterie", "Montaggio sanitari, box/doccia e rubinetterie", "Idraulico", "Alta", 19),
    ("Bagno completo", "Impianto elettrico", "Installazione placche/luci bagno", "Montaggio placche, luci e verifica elettrica", "Elettricista", "Media", 20),
    ("Bagno completo", "Pulizia / consegna", "Collaudo e consegna bagno", "Verifica perdite, pulizia e consegna al cliente", "Capo cantiere", "Alta", 22),
    ("Cucina", "Sopralluogo / setup", "Conferma layout cucina e impianti", "Verifica progetto cucina, quote, scarichi, prese e vincoli", "Capo cantiere", "Alta", 0),
    ("Cucina", "Demolizioni", "Demolizione/rimozione cucina esistente", "Rimozione elementi, rivestimenti e preparazione area", "Muratore", "Alta", 2),
    ("Cucina", "Murature / tracce", "Apertura tracce cucina", "Tracce per acqua, gas/elettrico e prese dedicate", "Muratore", "Alta", 4),
    ("Cucina", "Impianto idraulico", "Predisposizione acqua/scarichi cucina", "Punti lavello, lavastoviglie e scarichi", "Idraulico", "Alta", 6),
    ("Cucina", "Impianto elettrico", "Predisposizione prese e punti cucina", "Prese dedicate, forno, piano, frigo, luci sottopensile", "Elettricista", "Alta", 6),
    ("Cucina", "Murature / tracce", "Chiusura tracce cucina", "Chiusura tracce dopo verifica impianti", "Muratore", "Alta", 8),
    ("Cucina", "Pavimenti / rivestimenti", "Posa rivestimento cucina", "Posa rivestimento/paraschizzi", "Pavimentista", "Media", 11),
    ("Cucina", "Tinteggiatura", "Riprese e tinteggiatura cucina", "Riprese muri e tinteggiatura zona cucina", "Tinteggiatore", "Media", 13),
    ("Cucina", "Finiture", "Supporto montaggio cucina", "Verifica quote e supporto alle installazioni", "Capo cantiere", "Media", 15),
    ("Cucina", "Pulizia / consegna", "Collaudo impianti cucina", "Verifica elettrica/idraulica e consegna area", "Capo cantiere", "Alta", 16),
    ("Appartamento completo", "Sopralluogo / setup", "Setup cantiere e piano lavori", "Allestimento, protezioni, piano sicurezza e conferme operative", "Capo cantiere", "Alta", 0),
    ("Appartamento completo", "Demolizioni", "Demolizioni e smaltimento", "Demolizioni interne, rimozioni e smaltimento materiali", "Muratore", "Alta", 5),
    ("Appartamento completo", "Murature / tracce", "Tracce e opere murarie principali", "Tracce, spostamenti e predisposizioni murarie", "Muratore", "Alta", 10),
    ("Appartamento completo", "Impianto idraulico", "Impianto idraulico", "Predisposizione bagno/cucina e verifiche", "Idraulico", "Alta", 15),
    ("Appartamento completo", "Impianto elettrico", "Impianto elettrico", "Quadro, linee, prese, luci e predisposizioni", "Elettricista", "Alta", 15),
    ("Appartamento completo", "Cartongesso", "Cartongessi e controsoffitti", "Strutture, velette, botole e predisposizioni", "Cartongessista", "Media", 22),
    ("Appartamento completo", "Massetti / sottofondi", "Massetti e sottofondi", "Preparazione piani di posa", "Muratore", "Alta", 26),
    ("Appartamento completo", "Pavimenti / rivestimenti", "Posa pavimenti e rivestimenti", "Posa pavimentazioni e rivestimenti principali", "Pavimentista", "Alta", 35),
    ("Appartamento completo", "Serramenti / porte", "Installazione porte/serramenti", "Montaggi porte interne e rifiniture collegate", "Serramentista", "Media", 40),
    ("Appartamento completo", "Tinteggiatura", "Tinteggiatura finale", "Preparazione pareti e tinteggiatura", "Tinteggiatore", "Alta", 45),
    ("Appartamento completo", "Sanitari / rubinetterie", "Montaggi finali impianti", "Sanitari, placche, luci, rubinetterie e collaudi", "Idraulico/Elettricista", "Alta", 49),
    ("Appartamento completo", "Pulizia / consegna", "Pulizia finale e consegna", "Pulizia, punch list, verifiche e consegna cliente", "Capo cantiere", "Alta", 52),
    ("Ristrutturazione leggera", "Sopralluogo / setup", "Setup e protezioni", "Protezione aree, conferme operative e piano lavori", "Capo cantiere", "Alta", 0),
    ("Ristrutturazione leggera", "Demolizioni", "Rimozioni leggere", "Rimozioni puntuali e preparazione superfici", "Muratore", "Media", 2),
    ("Ristrutturazione leggera", "Impianto elettrico", "Adeguamenti elettrici", "Piccoli spostamenti prese/luci e verifiche", "Elettricista", "Media", 5),
    ("Ristrutturazione leggera", "Murature / tracce", "Riprese murarie", "Riprese, rasature e sistemazioni puntuali", "Muratore", "Media", 7),
    ("Ristrutturazione leggera", "Pavimenti / rivestimenti", "Posa/ripresa finiture", "Interventi su pavimenti/rivestimenti o battiscopa", "Pavimentista", "Media", 10),
    ("Ristrutturazione leggera", "Tinteggiatura", "Tinteggiatura", "Preparazione e tinteggiatura aree coinvolte", "Tinteggiatore", "Alta", 13),
    ("Ristrutturazione leggera", "Finiture", "Finiture e ritocchi", "Ritocchi, montaggi e verifica dettagli", "Capo cantiere", "Media", 15),
    ("Ristrutturazione leggera", "Pulizia / consegna", "Pulizia e consegna", "Pulizia finale e consegna cliente", "Capo cantiere", "Alta", 16),
]


@dataclass(frozen=True)
class Brand:
    """The company name printed in texts; empty by default."""

    name: str = ""
    product: str = ""
    footer: str = ""

    def fill(self, text: str) -> str:
        return text.format(
            brand_or=f"/{self.name}" if self.name else "",
            brand_after=f" {self.name}" if self.name else "",
            who=self.name or "Il team",
        )


NO_BRAND = Brand()
