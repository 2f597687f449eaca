"""Report texts of all sites: (report, cantiere_id, testo).

A page is one column expression over the wide site row and its bounded lists
(``daily_rows`` or ``client_rows``); ``printed`` turns pages into report rows.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions import scalars as s
from siteloom.operators.counts import SITE
from siteloom.operators.lists import bullets
from siteloom.plans import sections
from siteloom.plans.facts import site_facts
from siteloom.schema import SiteTables


def _with_lists(facts: DataFrame, *parts: DataFrame) -> DataFrame:
    """Left-join lists keyed on the site; both sides are unique on it."""
    return reduce(lambda rows, part: rows.join(part.withColumnRenamed(SITE, "id"), "id", "left"), parts, facts)


def daily_rows(tables: SiteTables, as_of: dt.date, brand: v.Brand = v.NO_BRAND, priority_order: str = "name") -> DataFrame:
    """Input of the two daily reports."""
    return _with_lists(
        site_facts(tables, as_of, brand, budget=False),
        sections.task_lists(tables.attivita, ["completate", "in_corso", "bloccate", "prossime"], sections.DAILY_ROWS)
        .withColumnsRenamed({n: f"righe_{n}" for n in ("completate", "in_corso", "bloccate", "prossime")}),
        sections.daily_ticket_lists(tables.ticket, priority_order=priority_order)
        .withColumnsRenamed({n: f"righe_{n}" for n in ("operativi", "decisioni_aperte", "da_confermare")}),
    )


def client_rows(tables: SiteTables, as_of: dt.date, brand: v.Brand = v.NO_BRAND) -> DataFrame:
    """Input of the client reports."""
    return _with_lists(
        site_facts(tables, as_of, brand),
        sections.task_lists(tables.attivita, ["completate", "in_corso", "da_fare"], sections.WORKS_ROWS)
        .withColumnsRenamed({n: f"righe_{n}" for n in ("completate", "in_corso", "da_fare")}),
        sections.client_ticket_lists(tables.ticket).withColumnRenamed("punti", "righe_punti"),
    )


def _say(*pieces: str | Column) -> Column:
    return F.concat(*[F.lit(piece) if isinstance(piece, str) else piece.cast("string") for piece in pieces])


def _page(lines: list[str | Column]) -> Column:
    """Lines of a text that ends with a line break."""
    columns = [F.lit(line) if isinstance(line, str) else line for line in lines]
    return F.concat(F.concat_ws("\n", *columns), F.lit("\n"))


def _listing(heading: str, name: str, k: int) -> list[str | Column]:
    return [heading, bullets(F.col(f"righe_{name}"), k), ""]


def printed(rows: DataFrame, pages: dict[str, Column]) -> DataFrame:
    """One row per site and report; all pages are printed in one pass over the input rows."""
    texts = [F.struct(F.lit(name).alias("report"), page.alias("testo")) for name, page in pages.items()]
    return rows.select(F.col("id").alias(SITE), F.inline(F.array(*texts))).select("report", SITE, "testo")


def _day(as_of: dt.date) -> str:
    return as_of.strftime("%d/%m/%Y")


def _progress_lines(heading: str) -> list[str | Column]:
    percent = F.col("avanzamento")
    return [
        _say(f"{heading}: ", percent, "%"),
        _say(F.col("barra"), " ", percent, "% - ", F.col("sintesi")),
    ]


def daily_page(as_of: dt.date, brand: v.Brand = v.NO_BRAND) -> Column:
    """Internal daily report, seven sections."""
    heads = v.DAILY_HEADINGS
    title = brand.fill(f"{v.DAILY_TITLE}{{brand_after}}").upper()
    return _page(
        [
            f"{title} - {_day(as_of)}",
            "",
            _say("Cantiere: ", s.text(F.col("nome"))),
            _say("Cliente: ", s.or_else(F.col("cliente"), v.DASH)),
            _say("Capo cantiere: ", s.or_else(F.col("capo_cantiere"), v.DASH)),
            "",
            *_progress_lines("AVANZAMENTO GENERALE CANTIERE"),
            _say(
                "Attività totali: ", F.col("totale"), " | Completate: ", F.col("completate"),
                " | In corso: ", F.col("in_corso"), " | Bloccate: ", F.col("attivita_bloccate"),
            ),
            "",
            _say("RISCHIO OPERATIVO: ", F.col("livello"), " - ", F.col("rischio_sintesi")),
            _say("Motivi: ", F.col("motivi")),
            _say("Azione suggerita: ", F.col("azione")),
            "",
            *_listing(heads["completate"], "completate", sections.DAILY_ROWS),
            *_listing(heads["in_corso"], "in_corso", sections.DAILY_ROWS),
            *_listing(heads["bloccate"], "bloccate", sections.DAILY_ROWS),
            *_listing(heads["operativi"], "operativi", sections.DAILY_ROWS),
            *_listing(heads["decisioni"], "decisioni_aperte", sections.DAILY_ROWS),
            heads["tempi"],
            _say("- Ticket aperti: ", F.col("ticket_aperti")),
            _say("- Blocchi o rischi aperti: ", F.col("operativi")),
            _say("- Attività bloccate: ", F.col("attivita_bloccate")),
            "",
            *_listing(heads["prossime"], "prossime", sections.NEXT_ROWS),
            brand.fill("Sintesi{brand_after}:"),
            v.DAILY_CLOSING,
        ]
    )


def short_client_page(as_of: dt.date, brand: v.Brand = v.NO_BRAND) -> Column:
    """The daily report as a client reads it; lists hold four rows."""
    listings = [
        line
        for name, heading in v.SHORT_HEADINGS.items()
        for line in _listing(heading, name, sections.SHORT_ROWS)
    ]
    return _page(
        [
            f"{v.SHORT_TITLE} - {_day(as_of)}",
            "",
            _say("Cantiere: ", s.text(F.col("nome"))),
            "",
            *_progress_lines("Avanzamento generale"),
            "",
            _say("Stato operativo: ", F.col("livello"), " - ", F.col("rischio_sintesi")),
            "",
            *listings,
            brand.fill(v.SHORT_CLOSING),
        ]
    )


def _client_head(kind: str, as_of: dt.date, brand: v.Brand) -> list[str | Column]:
    update = f"{brand.product.upper()} | {v.CLIENT_UPDATE}" if brand.product else v.CLIENT_UPDATE
    title = v.CLIENT_TITLES[kind]
    if kind == "Report cliente completo" and brand.name:
        title = f"{title} {brand.name.upper()}"
    return [
        title,
        "",
        update,
        _say("Cantiere: ", s.text(F.col("nome"))),
        _say("Cliente: ", s.or_else(F.col("cliente"), v.DASH)),
        f"Data aggiornamento: {_day(as_of)}",
        "",
    ]


def _money(label: str, name: str) -> Column:
    return _say(f"{label}: ", s.euro(F.col(name)))


def client_progress_page(as_of: dt.date, brand: v.Brand = v.NO_BRAND) -> Column:
    kind = "Avanzamento cantiere"
    return _page(
        [
            *_client_head(kind, as_of, brand),
            *_progress_lines("Avanzamento generale"),
            "",
            _say("Attività totali: ", F.col("totale")),
            _say("Completate: ", F.col("completate")),
            _say("In corso: ", F.col("in_corso")),
            _say("Da presidiare/bloccate: ", F.col("attivita_bloccate")),
            "",
            "Prossimi passaggi:",
            bullets(F.col("righe_da_fare"), sections.NEXT_ROWS),
        ]
    )


def client_budget_page(as_of: dt.date, brand: v.Brand = v.NO_BRAND) -> Column:
    kind = "Budget iniziale vs effettivo"
    return _page(
        [
            *_client_head(kind, as_of, brand),
            _money("Budget iniziale", "budget_iniziale"),
            _money("Costo effettivo maturato", "costo_effettivo"),
            _money("Extra approvati", "extra_approvati"),
            _money("Totale aggiornato", "totale_aggiornato"),
            _money("Scostamento", "scostamento"),
            _say("Budget consumato: ", F.col("budget_consumato_pct"), "%"),
            _say("Stato: ", F.col("stato_budget")),
            "",
            brand.fill("Nota{brand_after}:"),
            s.or_else(F.col("note_budget"), v.BUDGET_NO_NOTE),
        ]
    )


def client_works_page(as_of: dt.date, brand: v.Brand = v.NO_BRAND) -> Column:
    kind = "Lavori fatti / in corso / da fare"
    listings = [
        line for name, heading in v.WORKS_HEADINGS.items() for line in _listing(heading, name, sections.WORKS_ROWS)
    ]
    return _page([*_client_head(kind, as_of, brand), *listings[:-1]])


def client_full_page(as_of: dt.date, brand: v.Brand = v.NO_BRAND) -> Column:
    kind = "Report cliente completo"
    heads = v.FULL_HEADINGS
    listings = [
        line
        for name in ("completate", "in_corso", "da_fare", "punti")
        for line in _listing(heads[name], name, sections.FULL_ROWS)
    ]
    return _page(
        [
            *_client_head(kind, as_of, brand),
            heads["avanzamento"],
            *_progress_lines("Avanzamento generale"),
            "",
            heads["budget"],
            _money("Budget iniziale", "budget_iniziale"),
            _money("Totale aggiornato", "totale_aggiornato"),
            _money("Scostamento", "scostamento"),
            _say("Stato: ", F.col("stato_budget")),
            "",
            *listings,
            brand.fill("Messaggio{brand_after}:"),
            brand.fill(v.FULL_CLOSING),
            *(["", brand.footer] if brand.footer else []),
        ]
    )


def cover_page(as_of: dt.date, brand: v.Brand = v.NO_BRAND) -> Column:
    """Short greeting followed by the full client report."""
    return _say(
        brand.fill(v.COVER[0]), s.text(F.col("nome")), v.COVER[1], "\n\n", client_full_page(as_of, brand)
    )


def daily_reports(tables: SiteTables, as_of: dt.date, brand: v.Brand = v.NO_BRAND, priority_order: str = "name") -> DataFrame:
    """The internal daily report and its short client version, for every site."""
    pages = {"Report interno": daily_page(as_of, brand), "Versione cliente": short_client_page(as_of, brand)}
    return printed(daily_rows(tables, as_of, brand, priority_order), pages)


def client_reports(tables: SiteTables, as_of: dt.date, brand: v.Brand = v.NO_BRAND) -> DataFrame:
    """The four client reports of every site."""
    pages = {
        "Avanzamento cantiere": client_progress_page(as_of, brand),
        "Budget iniziale vs effettivo": client_budget_page(as_of, brand),
        "Lavori fatti / in corso / da fare": client_works_page(as_of, brand),
        "Report cliente completo": client_full_page(as_of, brand),
    }
    return printed(client_rows(tables, as_of, brand), pages)
