"""Outbound ticket notices."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions import predicates as p
from siteloom.functions import scalars as s
from siteloom.operators.counts import SITE
from siteloom.operators.lookups import with_contact_phone, with_site_name


def notice_text(
    site_name: Column, ticket: dict[str, Column], recipient: Column | None = None, brand: v.Brand = v.NO_BRAND
) -> Column:
    """Message body. Impact and detail lines appear only when they hold text."""
    owner = s.or_else(ticket["responsabile"], v.NOTICE_NO_OWNER)
    to = owner if recipient is None else s.or_else(recipient, owner)
    impact, detail = F.nullif(ticket["impatto"], F.lit("")), F.nullif(ticket["descrizione"], F.lit(""))
    head = f"{brand.product} | {v.NOTICE_TITLE}" if brand.product else v.NOTICE_TITLE
    thanks = f"{v.NOTICE_THANKS}, {brand.name}" if brand.name else v.NOTICE_THANKS
    blank = F.lit("")
    lines = [
        F.lit(head),
        F.concat(F.lit("Cantiere: "), s.text(site_name)),
        F.concat(F.lit("Ticket #"), s.text(ticket["id"]), F.lit(": "), s.text(ticket["titolo"])),
        F.concat(F.lit("Tipo: "), s.text(ticket["tipo"]), F.lit(" · Priorità: "), s.text(ticket["priorita"])),
        F.concat(F.lit("Responsabile: "), to),
        F.concat(F.lit("Scadenza: "), s.or_else(ticket["scadenza"], v.NOTICE_NO_DUE)),
        blank,
        F.lit(v.NOTICE_ASK),
        # a null line vanishes from concat_ws, an empty one stays
        F.concat(F.lit("Impatto: "), impact),
        F.concat(F.lit("\nDettaglio: "), detail),
        blank,
        *[F.lit(line) for line in v.NOTICE_ANSWERS],
        blank,
        F.lit(thanks),
    ]
    return F.concat_ws("\n", *lines)


def outbound_notices(
    tickets: DataFrame, sites: DataFrame, crews: DataFrame, brand: v.Brand = v.NO_BRAND
) -> DataFrame:
    """One ready message with phone and chat link for every open ticket of a known site."""
    needed = ["id", SITE, "tipo", "titolo", "responsabile", "priorita", "scadenza", "impatto", "descrizione"]
    open_rows = tickets.where(p.ticket_open_strict(F.col("stato"))).select(*needed)
    rows = with_site_name(with_contact_phone(open_rows, crews, "responsabile"), sites)
    body = notice_text(F.col("cantiere"), {name: F.col(name) for name in needed}, brand=brand)
    return rows.select(
        F.col("id").alias("ticket_id"),
        SITE,
        s.or_else(F.col("responsabile"), "").alias("destinatario"),
        "telefono",
        body.alias("messaggio"),
    ).withColumn("link", s.chat_link(F.col("telefono"), F.col("messaggio")))


def retyped_notices(outbound: DataFrame, typed: DataFrame) -> DataFrame:
    """Proposed notices with what was typed over them, for the tickets that were typed.

    ``typed`` has ticket_id, once each, and any of destinatario, telefono,
    messaggio, canale and stato; null leaves the proposal, an empty text does not.
    The chat link follows the phone and message.
    """
    fields = [c for c in ("destinatario", "telefono", "messaggio", "canale", "stato") if c in typed.columns]
    over = typed.select("ticket_id", *[F.col(c).alias(f"_{c}") for c in fields])
    kept = {c: F.coalesce(f"_{c}", c) if c in outbound.columns else F.col(f"_{c}") for c in fields}
    rows = outbound.join(over, "ticket_id").withColumns(kept).drop(*[f"_{c}" for c in fields])
    return rows.withColumn("link", s.chat_link(F.col("telefono"), F.col("messaggio")))


def registered_notices(
    outbound: DataFrame, now: dt.datetime, state: str = v.NOTICE_SENT_BY_HAND, channel: str = v.CHANNELS[0]
) -> DataFrame:
    """Rows for the notices table, stamped as sent when they were sent by hand.

    Columns ``canale`` and ``stato`` of the rows come before the arguments;
    words outside the lists fall back to them.
    """
    stamp = s.literal_time(now)
    chosen = {
        name: s.one_of(F.col(name), words, fallback) if name in outbound.columns else F.lit(fallback)
        for name, words, fallback in (("canale", v.CHANNELS, channel), ("stato", v.NOTICE_STATES, state))
    }
    return outbound.select(
        SITE,
        "ticket_id",
        "destinatario",
        "telefono",
        chosen["canale"].alias("canale"),
        "messaggio",
        chosen["stato"].alias("stato"),
        stamp.alias("created_at"),
        s.sent_stamp(chosen["stato"], stamp).alias("sent_at"),
    )
