"""Every operator as a query over the dataset: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.change_sets import change_set
from siteloom import vocabulary as v
from siteloom.functions import predicates as p
from siteloom.functions import scalars as s
from siteloom.functions.triage import message_title, triage, triage_by_language, word_table
from siteloom.operators import budget, changes, counts, lists, lookups, notices, risk, templates
from siteloom.operators.counts import SITE
from siteloom.plans import client, dashboard, foreman, registers, reports, sections
from siteloom.plans import notices as notice_plans
from siteloom.plans.facts import site_facts
from siteloom.schema import MESSAGE_SCHEMA, SiteTables, with_defaults
from siteloom.session import tune
from siteloom.sources import snapshots
from siteloom.sources.scratch import new_folder
from siteloom.sources.star_schema import StarSchema
from siteloom.streaming import feeds

AS_OF = dt.date(1995, 9, 1)
TICKET_DAY = dt.date(2024, 1, 15)
NOW = dt.datetime(2024, 1, 15, 9, 30)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def tables_query(fn: Callable[[SiteTables], DataFrame]) -> Callable[[SiteTables], DataFrame]:
    """Register a query over the site tables under the function's name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        tune(spark)
        return fn(StarSchema(spark, folder).tables())

    QUERIES[fn.__name__] = run
    return fn


def source_query(fn: Callable[[StarSchema], DataFrame]) -> Callable[[StarSchema], DataFrame]:
    """Register a query that also needs the message feed."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        tune(spark)
        return fn(StarSchema(spark, folder))

    QUERIES[fn.__name__] = run
    return fn


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- scans, sources, sinks -------------------------------------------------
@tables_query
def s01_full_scan(t: SiteTables) -> DataFrame:
    return t.ticket


@tables_query
def s02_scoped_scan(t: SiteTables) -> DataFrame:
    active = t.cantieri.where(F.col("stato") == v.SITE_STATES[0])
    return counts.in_sites(t.attivita, active).select("id", SITE, "stato", "scadenza")


@tables_query
def s03_keyed_lookup(t: SiteTables) -> DataFrame:
    keys = t.notifiche.select(F.col("ticket_id").alias("id"))
    return lookups.by_keys(t.ticket, keys).select("id", SITE, "titolo", "stato")


@tables_query
def s04_schema_defaults(t: SiteTables) -> DataFrame:
    return with_defaults(t.attivita.select("id", SITE, "titolo"), "attivita", s.literal_time(NOW))


@source_query
def s05_append_batch(src: StarSchema) -> DataFrame:
    batch = changes.ticket_batch(triage(src.messages()), TICKET_DAY)
    return changes.appended(src.table("ticket"), batch, "ticket", "messaggio_id", NOW)


@source_query
def s05_append_updates(src: StarSchema) -> DataFrame:
    batch = changes.update_batch(triage(src.messages()))
    return changes.appended(src.table("aggiornamenti"), batch, "aggiornamenti", "messaggio_id", NOW)


@tables_query
def s05_append_sites(t: SiteTables) -> DataFrame:
    batch = changes.site_batch(change_set("new_sites", t.cantieri), TICKET_DAY)
    return changes.appended(t.cantieri, batch, "cantieri", "richiesta", NOW)


@tables_query
def s05_append_crews(t: SiteTables) -> DataFrame:
    batch = changes.crew_batch(change_set("new_crews", t.artigiani))
    return changes.appended(t.artigiani, batch, "artigiani", "richiesta", NOW)


@tables_query
def s05_append_tasks(t: SiteTables) -> DataFrame:
    batch = changes.task_batch(change_set("new_tasks", t.attivita), TICKET_DAY)
    return changes.appended(t.attivita, batch, "attivita", "richiesta", NOW)


@tables_query
def s05_append_typed_tickets(t: SiteTables) -> DataFrame:
    batch = changes.typed_tickets(change_set("new_tickets", t.ticket), TICKET_DAY)
    return changes.appended(t.ticket, batch, "ticket", "richiesta", NOW)


@tables_query
def s05_append_quick_tickets(t: SiteTables) -> DataFrame:
    batch = changes.quick_tickets(change_set("quick_tickets", t.ticket), TICKET_DAY)
    return changes.appended(t.ticket, batch, "ticket", "richiesta", NOW)


@tables_query
def s05_append_template_tasks(t: SiteTables) -> DataFrame:
    batch = templates.expand_templates(change_set("template_requests", t.cantieri))
    ordered = batch.withColumn("ordine", F.col(SITE) * 100 + F.col("posto"))
    return changes.new_rows(ordered, "attivita", t.attivita, "ordine", NOW)


@tables_query
def s05_append_notices(t: SiteTables) -> DataFrame:
    batch = notices.registered_notices(notices.outbound_notices(t.ticket, t.cantieri, t.artigiani), NOW)
    return changes.new_rows(batch, "notifiche", t.notifiche, "ticket_id", NOW)


@tables_query
def s06_budget_upsert(t: SiteTables) -> DataFrame:
    return changes.upsert_budgets(t.budget_cantiere, change_set("budget_changes", t.cantieri))


@tables_query
def s07_task_update(t: SiteTables) -> DataFrame:
    updated = changes.apply_task_changes(t.attivita, change_set("task_changes", t.attivita))
    return updated.select("id", "stato", "priorita", "percentuale", "note", "closed_at")


@tables_query
def s07_ticket_update(t: SiteTables) -> DataFrame:
    updated = changes.apply_ticket_changes(t.ticket, change_set("ticket_changes", t.ticket))
    return updated.select("id", "stato", "priorita", "responsabile", "impatto", "closed_at")


@tables_query
def s07_notice_update(t: SiteTables) -> DataFrame:
    updated = changes.apply_replies(t.notifiche, change_set("replies", t.notifiche))
    return updated.select("id", "stato", "risposta", "sent_at", "responded_at")


@tables_query
def s08_reply_cascade(t: SiteTables) -> DataFrame:
    updated = changes.apply_cascade(t.ticket, t.notifiche, change_set("replies", t.notifiche))
    return updated.select("id", SITE, "stato", "closed_at")


def _fingerprint(name: str, df: DataFrame, empty_is_null: bool = False) -> DataFrame:
    words = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    cells = [F.nullif(F.col(w), F.lit("")) if empty_is_null else F.col(w) for w in words]
    filled = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cells), F.lit(0))
    letters = sum((F.coalesce(F.length(c), F.lit(0)) for c in cells), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("righe"),
        F.sum("id").alias("somma_id"),
        F.sum(filled).alias("valori"),
        F.sum(letters).alias("lettere"),
    ).select(F.lit(name).alias("tabella"), "*")


@tables_query
def s09_csv_export(t: SiteTables) -> DataFrame:
    spark = t.cantieri.sparkSession
    root = new_folder(spark, "csv")
    snapshots.export_csv(t, root)
    return _stack([_fingerprint(name, snapshots.read_csv(spark, root, name), True) for name, _ in t.items()])


@tables_query
def s10_report_export(t: SiteTables) -> DataFrame:
    spark = t.cantieri.sparkSession
    root = new_folder(spark, "reports")
    pages = reports.client_reports(t, AS_OF)
    snapshots.export_reports(pages.withColumn("report", s.slug(F.col("report"))), root)
    return snapshots.read_reports(spark, root)


@tables_query
def s11_snapshot_restore(t: SiteTables) -> DataFrame:
    spark = t.cantieri.sparkSession
    root = new_folder(spark, "snapshot")
    snapshots.write_snapshot(t, root)
    restored = snapshots.restore_snapshot(spark, root)
    return _stack([_fingerprint(name, df) for name, df in restored.items()])


@tables_query
def s12_purge(t: SiteTables) -> DataFrame:
    spark = t.cantieri.sparkSession
    root = new_folder(spark, "purged")
    snapshots.purge(spark, root)
    before = snapshots.row_counts(t).withColumnRenamed("righe", "righe_prima")
    after = snapshots.row_counts(snapshots.read_tables(spark, root)).withColumnRenamed("righe", "righe_dopo")
    return before.join(after, "tabella")


@tables_query
def s13_load_if_empty(t: SiteTables) -> DataFrame:
    spark = t.cantieri.sparkSession
    root = new_folder(spark, "seeded")
    snapshots.purge(spark, root)
    for _ in range(2):  # the second call finds rows and does nothing
        snapshots.load_if_empty(spark, root, t)
    return snapshots.row_counts(snapshots.read_tables(spark, root))


# --- projections, filters, predicates --------------------------------------
@tables_query
def p01_projection(t: SiteTables) -> DataFrame:
    return t.ticket.select("id", F.col("titolo").alias("ticket"), F.col("responsabile").alias("referente"))


@tables_query
def p02_open_tickets_strict(t: SiteTables) -> DataFrame:
    return t.ticket.where(p.ticket_open_strict(F.col("stato"))).select("id", SITE, "stato")


@tables_query
def p03_open_tickets_lenient(t: SiteTables) -> DataFrame:
    return t.ticket.where(p.ticket_open_lenient(F.col("stato"))).select("id", SITE, "stato")


@tables_query
def p04_completed_tasks(t: SiteTables) -> DataFrame:
    state = F.col("stato")
    unfinished = F.coalesce(p.task_unfinished_strict(state), F.lit(False))
    return t.attivita.select("id", p.task_done(state).alias("completata"), unfinished.alias("da_finire"))


@tables_query
def p05_overdue_tasks(t: SiteTables) -> DataFrame:
    overdue = p.task_overdue(F.col("scadenza"), F.col("stato"), AS_OF)
    return t.attivita.where(overdue).select("id", SITE, "scadenza", "stato")


@tables_query
def p06_urgent_tickets(t: SiteTables) -> DataFrame:
    urgent = p.ticket_urgent(F.col("stato"), F.col("priorita"))
    return t.ticket.where(urgent).select("id", SITE, "stato", "priorita")


@tables_query
def p07_client_tickets(t: SiteTables) -> DataFrame:
    return t.ticket.where(p.ticket_for_client(F.col("stato"), F.col("tipo"))).select("id", SITE, "tipo")


@tables_query
def p08_operational_tickets(t: SiteTables) -> DataFrame:
    return t.ticket.where(p.ticket_operational(F.col("stato"), F.col("tipo"))).select("id", SITE, "tipo")


@tables_query
def p09_decisions(t: SiteTables) -> DataFrame:
    state, kind = F.col("stato"), F.col("tipo")
    return t.ticket.where(p.ticket_to_confirm(state, kind)).select(
        "id", SITE, p.ticket_decision(state, kind).alias("decisione")
    )


@tables_query
def p10_active_crews(t: SiteTables) -> DataFrame:
    return t.artigiani.where(p.crew_active(F.col("attivo"))).select("id", "nome", "ruolo")


@source_query
def p11_required_fields(src: StarSchema) -> DataFrame:
    batch = src.messages().select("id", F.col("testo").alias("titolo"))
    return changes.validated(batch, "ticket")


@tables_query
def p12_enum_fallback(t: SiteTables) -> DataFrame:
    priority = s.one_of(F.col("priorita"), v.PRIORITIES, v.PRIORITY_DEFAULT).alias("priorita")

    def part(df: DataFrame, name: str, words: list[str], prio) -> DataFrame:
        state = changes.form_state(F.col("stato"), words).alias("stato")
        return df.select(F.lit(name).alias("tabella"), "id", state, prio)

    return _stack(
        [
            part(t.attivita, "attivita", v.TASK_STATES, priority),
            part(t.ticket, "ticket", v.TICKET_STATES, priority),
            part(t.notifiche, "notifiche", v.NOTICE_STATES, F.lit(None).cast("string").alias("priorita")),
        ]
    )


@tables_query
def p13_client_groups(t: SiteTables) -> DataFrame:
    return client.client_task_flags(t)


@tables_query
def p14_running_or_blocked(t: SiteTables) -> DataFrame:
    state = F.col("stato")
    return t.attivita.where(p.task_in(state, v.TASK_RUNNING) | p.task_in(state, v.TASK_BLOCKED)).select(
        "id", SITE, "stato"
    )


@tables_query
def p15_reply_present(t: SiteTables) -> DataFrame:
    return t.notifiche.select("id", p.reply_present(F.col("risposta")).alias("con_risposta"))


@tables_query
def p16_linked_notices(t: SiteTables) -> DataFrame:
    return t.notifiche.where(F.col("ticket_id").isNotNull()).select("id", "ticket_id")


# --- joins -----------------------------------------------------------------
@tables_query
def j01_tickets_with_site(t: SiteTables) -> DataFrame:
    return lookups.open_tickets_with_site(t.ticket, t.cantieri)


@tables_query
def j02_tasks_with_site(t: SiteTables) -> DataFrame:
    return lookups.tasks_with_site(t.attivita, t.cantieri)


@tables_query
def j03_notice_log(t: SiteTables) -> DataFrame:
    return lookups.notice_log(t.notifiche, t.ticket).select("id", "ticket_id", "ticket", "stato")


@tables_query
def j04_tickets_latest_notice(t: SiteTables) -> DataFrame:
    return lookups.tickets_with_latest_notice(t.ticket, t.notifiche)


@tables_query
def j05_sites_progress(t: SiteTables) -> DataFrame:
    return counts.site_progress(t.cantieri, t.attivita).select("id", "cantiere", "avanzamento", "attivita_totali")


@tables_query
def j06_risk_aggregates(t: SiteTables) -> DataFrame:
    return risk.risk_counters(t.cantieri, t.attivita, t.ticket, AS_OF)


@tables_query
def j07_sites_budget(t: SiteTables) -> DataFrame:
    return budget.site_budgets(t.cantieri.select("id", "nome"), t.budget_cantiere)


@tables_query
def j08_contact_resolution(t: SiteTables) -> DataFrame:
    names = t.ticket.select("responsabile").distinct()
    return lookups.with_contact_phone(names, t.artigiani, "responsabile", row_id="responsabile")


@tables_query
def j09_orphans(t: SiteTables) -> DataFrame:
    return lookups.orphans(t)


@tables_query
def j10_template_expansion(t: SiteTables) -> DataFrame:
    return templates.expand_templates(change_set("template_requests", t.cantieri))


@tables_query
def j11_outbound_notices(t: SiteTables) -> DataFrame:
    return notices.outbound_notices(t.ticket, t.cantieri, t.artigiani)


# --- aggregations ----------------------------------------------------------
@tables_query
def a01_kpis(t: SiteTables) -> DataFrame:
    return counts.kpis(t.cantieri, t.attivita, t.ticket, AS_OF).drop("tasso_completamento")


@tables_query
def a02_completion_rate(t: SiteTables) -> DataFrame:
    return counts.kpis(t.cantieri, t.attivita, t.ticket, AS_OF).select("vista", SITE, "tasso_completamento")


@tables_query
def a03_tasks_by_state(t: SiteTables) -> DataFrame:
    return counts.tasks_by_state(t.attivita)


@tables_query
def a03_tasks_by_state_per_site(t: SiteTables) -> DataFrame:
    return counts.tasks_by_state(t.attivita, per_site=True)


@tables_query
def a04_site_progress(t: SiteTables) -> DataFrame:
    percent = counts.percent_done(F.col("totale"), F.col("somma_percentuali"))
    return counts.task_counts(t.attivita).select(
        SITE, percent.alias("avanzamento"), "totale", "completate", "in_corso", F.col("attivita_bloccate").alias("bloccate")
    )


@tables_query
def a05_progress_table(t: SiteTables) -> DataFrame:
    return counts.site_progress(t.cantieri, t.attivita).drop("created_at")


@tables_query
def a06_risk_counters(t: SiteTables) -> DataFrame:
    return counts.ticket_counts(t.ticket).select(SITE, "critici", "bloccanti", "alti", "decisioni", "a_rischio")


@tables_query
def a07_risk_score(t: SiteTables) -> DataFrame:
    return risk.risk_board(t.cantieri, t.attivita, t.ticket, AS_OF).select("id", "nome", "punteggio", "livello")


@tables_query
def a08_latest_notices(t: SiteTables) -> DataFrame:
    return lookups.latest_notices(t.notifiche)


@tables_query
def a09_notice_kpis(t: SiteTables) -> DataFrame:
    return counts.notice_kpis(t.cantieri, t.ticket, t.notifiche)


@tables_query
def a10_foreman_kpis(t: SiteTables) -> DataFrame:
    return counts.foreman_kpis(t.cantieri, t.attivita, t.ticket)


@tables_query
def a11_report_counters(t: SiteTables) -> DataFrame:
    return site_facts(t, AS_OF, budget=False).select(
        F.col("id").alias(SITE), "ticket_aperti", F.col("operativi").alias("blocchi_rischi"), "attivita_bloccate"
    )


@tables_query
def a12_points_to_confirm(t: SiteTables) -> DataFrame:
    return site_facts(t, AS_OF, budget=False).select(F.col("id").alias(SITE), F.col("punti_cliente").alias("punti_da_confermare"))


@tables_query
def a13_budget_summary(t: SiteTables) -> DataFrame:
    return budget.budget_summary(t.cantieri, t.budget_cantiere)


# --- sorted lists and top-k ------------------------------------------------
@tables_query
def l01_newest_sites(t: SiteTables) -> DataFrame:
    return t.cantieri.orderBy(*lists.newest_created_first()).select("id", "nome", "created_at")


@tables_query
def l02_crews_by_name(t: SiteTables) -> DataFrame:
    return t.artigiani.orderBy(*lists.by_name()).select("id", "nome")


@tables_query
def l03_newest_ids(t: SiteTables) -> DataFrame:
    return t.notifiche.orderBy(*lists.newest_id_first()).select("id", "stato")


@tables_query
def l04_by_due_date(t: SiteTables) -> DataFrame:
    return t.attivita.orderBy(*lists.by_due_date()).select("id", "scadenza", "titolo")


@tables_query
def l05_by_priority_rank(t: SiteTables) -> DataFrame:
    return t.ticket.orderBy(*lists.by_priority_rank()).select("id", "priorita", "scadenza")


@tables_query
def l06_by_priority_name(t: SiteTables) -> DataFrame:
    operational = t.ticket.where(p.ticket_operational(F.col("stato"), F.col("tipo")))
    rows = lists.top_per_site(operational.select("id", SITE, "priorita", "scadenza"), lists.by_priority_name(), 6)
    return rows.select(SITE, "posizione", "id", "priorita", "scadenza")


@tables_query
def l07_next_tasks(t: SiteTables) -> DataFrame:
    return lists.next_tasks(t.attivita, 5)


@tables_query
def l08_next_due(t: SiteTables) -> DataFrame:
    return dashboard.next_due(t)


@tables_query
def l09_urgent_tasks(t: SiteTables) -> DataFrame:
    return lists.urgent_tasks(t.attivita, 8)


@tables_query
def l10_tickets_to_unblock(t: SiteTables) -> DataFrame:
    return lists.tickets_to_unblock(t.ticket, 6)


@tables_query
def l11_bounded_bullets(t: SiteTables) -> DataFrame:
    rows = sections.task_lists(t.attivita, ["completate", "in_corso", "prossime"], 8)
    return rows.select(
        SITE,
        lists.bullets(F.col("completate"), 4).alias("completate"),
        lists.bullets(F.col("in_corso"), 6).alias("in_corso"),
        lists.bullets(F.col("prossime"), 5).alias("prossime"),
    )


# --- scalar functions ------------------------------------------------------
def _sites(t: SiteTables) -> DataFrame:
    return site_facts(t, AS_OF, budget=False).withColumnRenamed("id", SITE)


@tables_query
def m01_effective_percent(t: SiteTables) -> DataFrame:
    return t.attivita.select("id", s.effective_percent(F.col("stato"), F.col("percentuale")).alias("percentuale_effettiva"))


@tables_query
def m02_progress_label(t: SiteTables) -> DataFrame:
    return _sites(t).select(SITE, "avanzamento", "sintesi")


@tables_query
def m03_priority_rank(t: SiteTables) -> DataFrame:
    return t.ticket.select("id", "priorita", s.priority_rank(F.col("priorita")).alias("rango"))


@tables_query
def m04_progress_bar(t: SiteTables) -> DataFrame:
    return _sites(t).select(SITE, "barra")


@tables_query
def m05_risk_level(t: SiteTables) -> DataFrame:
    return _sites(t).select(SITE, "livello", "rischio_sintesi", "azione")


@tables_query
def m06_risk_reasons(t: SiteTables) -> DataFrame:
    return _sites(t).select(SITE, "motivi")


@tables_query
def m07_euro(t: SiteTables) -> DataFrame:
    return budget.budget_summary(t.cantieri, t.budget_cantiere).select(
        F.col("id").alias(SITE),
        *[s.euro(F.col(c)).alias(c) for c in (*budget.AMOUNTS, "totale_aggiornato", "scostamento")],
    )


@tables_query
def m08_budget_arithmetic(t: SiteTables) -> DataFrame:
    return budget.budget_summary(t.cantieri, t.budget_cantiere).select(
        F.col("id").alias(SITE), "totale_aggiornato", "scostamento", "budget_consumato_pct"
    )


@tables_query
def m09_budget_status(t: SiteTables) -> DataFrame:
    return budget.budget_summary(t.cantieri, t.budget_cantiere).select(
        F.col("id").alias(SITE), "stato_budget", "gravita_budget"
    )


@source_query
def m10_triage(src: StarSchema) -> DataFrame:
    return triage(src.messages()).select("id", "tipo", "priorita", "stato", "impatto")


@source_query
def m10_triage_updates(src: StarSchema) -> DataFrame:
    """The same triage over the whole field-update log."""
    return triage(src.table("aggiornamenti")).select("id", "tipo", "priorita", "stato", "impatto", "titolo")


@source_query
def m10_triage_by_words(src: StarSchema) -> DataFrame:
    """The whole field-update log again, by a table of words."""
    log = src.table("aggiornamenti")
    return triage_by_language(log, word_table(log.sparkSession)).select("id", "tipo", "priorita", "stato", "impatto", "titolo")


@source_query
def m11_message_title(src: StarSchema) -> DataFrame:
    return src.messages().select("id", message_title(F.col("testo")).alias("titolo"))


@tables_query
def m12_notice_text(t: SiteTables) -> DataFrame:
    rows = lookups.with_site_name(t.ticket, t.cantieri)
    body = notices.notice_text(F.col("cantiere"), {c: F.col(c) for c in t.ticket.columns})
    return rows.select("id", body.alias("messaggio"))


@tables_query
def m13_clean_phone(t: SiteTables) -> DataFrame:
    return t.artigiani.select("id", s.clean_phone(F.col("telefono")).alias("telefono"))


@source_query
def m13_chat_link(src: StarSchema) -> DataFrame:
    sent = src.table("notifiche").select("id", s.chat_link(F.col("telefono"), F.col("messaggio")).alias("link"))
    typed = src.messages().select(
        (-F.col("id") - 1).alias("id"), s.chat_link(F.lit(None).cast("string"), F.col("testo")).alias("link")
    )
    return sent.unionByName(typed)


@tables_query
def m14_close_stamp(t: SiteTables) -> DataFrame:
    stamp = s.close_stamp(v.TICKET_CLOSED, F.col("stato"), F.col("closed_at"), s.literal_time(NOW))
    return t.ticket.select("id", "stato", stamp.alias("closed_at"))


@tables_query
def m15_quick_ticket_state(t: SiteTables) -> DataFrame:
    batch = t.ticket.select("id", "tipo", "priorita", "titolo")
    return changes.quick_tickets(batch, TICKET_DAY)


@tables_query
def m16_note_append(t: SiteTables) -> DataFrame:
    updated = changes.apply_quick_task_updates(t.attivita, change_set("quick_updates", t.attivita))
    return updated.select("id", "stato", "percentuale", "note", "closed_at")


@tables_query
def m17_notice_stamps(t: SiteTables) -> DataFrame:
    now = s.literal_time(NOW)
    return t.notifiche.select(
        "id",
        s.sent_stamp(F.col("stato"), now).alias("sent_at"),
        s.reply_stamp(F.col("risposta"), F.col("responded_at"), now).alias("responded_at"),
    )


@tables_query
def m18_date_shift(t: SiteTables) -> DataFrame:
    start = s.parse_date(F.col("data_inizio"))
    return t.cantieri.select(
        "id",
        s.shift_days(start, v.TICKET_DUE_DAYS).alias("scadenza_ticket"),
        s.shift_days(start, v.TASK_DUE_DAYS).alias("scadenza_attivita"),
        s.shift_days(start, v.SITE_END_DAYS).alias("fine_cantiere"),
    )


@tables_query
def m19_date_coerce(t: SiteTables) -> DataFrame:
    day = s.parse_date(F.col("scadenza"))
    return t.attivita.select("id", "scadenza", day.isNotNull().alias("leggibile"), F.datediff(day, F.lit(AS_OF)).alias("giorni"))


@tables_query
def m20_percent_coerce(t: SiteTables) -> DataFrame:
    return t.attivita.select("id", s.shown_percent(F.col("percentuale")).alias("percentuale"))


@tables_query
def m21_date_format(t: SiteTables) -> DataFrame:
    return t.attivita.select("id", s.italian_date(s.parse_date(F.col("scadenza"))).alias("giorno"))


@tables_query
def m22_labels(t: SiteTables) -> DataFrame:
    labels = notice_plans.log_labels(t)
    return labels.select("id", "etichetta", s.id_of_label(F.col("etichetta")).alias("id_letto"))


@tables_query
def m23_placeholders(t: SiteTables) -> DataFrame:
    return t.cantieri.select(
        "id",
        s.or_else(F.col("cliente"), v.DASH).alias("cliente"),
        s.or_else(F.col("data_fine_prevista"), v.DASH).alias("consegna_prevista"),
        s.or_else(F.col("note"), "").alias("note"),
    )


@tables_query
def m24_slug(t: SiteTables) -> DataFrame:
    name = F.concat_ws(" / ", "nome", "indirizzo")
    return t.cantieri.select("id", s.slug(name).alias("slug"))


@tables_query
def m25_bullets(t: SiteTables) -> DataFrame:
    points = sections.client_ticket_lists(t.ticket, 8)
    rows = t.cantieri.select("id").join(points.withColumnRenamed(SITE, "id"), "id", "left")
    return rows.select(F.col("id").alias(SITE), lists.bullets(F.col("punti")).alias("elenco"))


@tables_query
def m26_colours(t: SiteTables) -> DataFrame:
    tickets = t.ticket.select(
        F.lit("ticket").alias("tabella"), "id", s.priority_colour(F.col("priorita")).alias("colore"),
        s.card_class(F.col("priorita")).alias("classe"),
    )
    sites = site_facts(t, AS_OF, budget=False).select(
        F.lit("cantieri").alias("tabella"), "id", s.risk_colour(F.col("livello")).alias("colore"), F.lit("").alias("classe")
    )
    return tickets.unionByName(sites)


@tables_query
def m27_template_constants(t: SiteTables) -> DataFrame:
    rows = templates.expand_templates(change_set("template_requests", t.cantieri))
    return rows.groupBy("note", "stato", "percentuale").agg(
        F.count(F.lit(1)).alias("righe"), F.count("dipende_da_id").alias("con_dipendenza")
    )


@tables_query
def m28_cards(t: SiteTables) -> DataFrame:
    return foreman.task_cards(t.attivita).drop("percentuale").unionByName(foreman.ticket_cards(t.ticket))


# --- streams ---------------------------------------------------------------
def _as_stream(df: DataFrame, purpose: str, files: int = 4) -> tuple[DataFrame, str]:
    """Write rows to several files and read them back as a stream of small batches."""
    spark = df.sparkSession
    root = new_folder(spark, purpose)
    df.repartition(files).write.parquet(f"{root}/in")
    return feeds.file_stream(spark, f"{root}/in", df.schema, files_per_batch=1), root


@source_query
def t01_message_stream(src: StarSchema) -> DataFrame:
    stream, root = _as_stream(src.messages(), "messages")
    feeds.messages_to_tickets(stream, f"{root}/ticket", f"{root}/updates", f"{root}/cp", TICKET_DAY).awaitTermination()
    tickets = feeds.once_per_message(feeds.read_epochs(src.spark, f"{root}/ticket"))
    updates = feeds.once_per_message(feeds.read_epochs(src.spark, f"{root}/updates"))
    return tickets.select("messaggio_id", SITE, "tipo", "titolo", "priorita", "stato", "impatto", "scadenza").join(
        updates.select("messaggio_id", "categoria"), "messaggio_id"
    )


@source_query
def t02_notice_stream(src: StarSchema) -> DataFrame:
    stream, root = _as_stream(src.table("notifiche").select("id", SITE, "ticket_id", "created_at"), "notices")
    feeds.running_latest_notices(stream, f"{root}/out", f"{root}/cp").awaitTermination()
    return feeds.current_latest_notices(src.spark, f"{root}/out")


@source_query
def t03_change_stream(src: StarSchema) -> DataFrame:
    tickets = src.table("ticket")
    stream, root = _as_stream(change_set("ticket_changes", tickets), "changes")
    feeds.changes_to_log(stream, f"{root}/log", f"{root}/cp").awaitTermination()
    log = feeds.read_epochs(src.spark, f"{root}/log").drop(feeds.EPOCH)
    return changes.apply_ticket_changes(tickets, log).select(
        "id", "stato", "priorita", "responsabile", "impatto", "closed_at"
    )


# --- composite queries and reports -----------------------------------------
@tables_query
def r01_dashboard_sites(t: SiteTables) -> DataFrame:
    return dashboard.site_rows(t, AS_OF)


@tables_query
def r01_dashboard_tasks(t: SiteTables) -> DataFrame:
    return dashboard.task_list(t)


@tables_query
def r01_dashboard_tickets(t: SiteTables) -> DataFrame:
    return dashboard.open_ticket_list(t)


@tables_query
def r02_daily_report(t: SiteTables) -> DataFrame:
    return reports.printed(reports.daily_rows(t, AS_OF), {"Report interno": reports.daily_page(AS_OF)})


@tables_query
def r03_short_client_report(t: SiteTables) -> DataFrame:
    return reports.printed(reports.daily_rows(t, AS_OF), {"Versione cliente": reports.short_client_page(AS_OF)})


def _client(t: SiteTables, name: str, page) -> DataFrame:
    return reports.printed(reports.client_rows(t, AS_OF), {name: page(AS_OF)})


@tables_query
def r04_client_progress_report(t: SiteTables) -> DataFrame:
    return _client(t, "Avanzamento cantiere", reports.client_progress_page)


@tables_query
def r05_client_budget_report(t: SiteTables) -> DataFrame:
    return _client(t, "Budget iniziale vs effettivo", reports.client_budget_page)


@tables_query
def r06_client_works_report(t: SiteTables) -> DataFrame:
    return _client(t, "Lavori fatti / in corso / da fare", reports.client_works_page)


@tables_query
def r07_client_full_report(t: SiteTables) -> DataFrame:
    return _client(t, "Report cliente completo", reports.client_full_page)


@tables_query
def r08_cover_message(t: SiteTables) -> DataFrame:
    return _client(t, "Messaggio breve", reports.cover_page)


@tables_query
def r09_client_cards(t: SiteTables) -> DataFrame:
    return client.client_cards(t, AS_OF)


@tables_query
def r09_client_lists(t: SiteTables) -> DataFrame:
    return client.client_lists(t)


@tables_query
def r10_foreman_cards(t: SiteTables) -> DataFrame:
    return foreman.foreman_cards(t, AS_OF)


@tables_query
def r10_foreman_tasks(t: SiteTables) -> DataFrame:
    return foreman.todays_tasks(t)


@tables_query
def r10_foreman_blocks(t: SiteTables) -> DataFrame:
    return foreman.todays_blocks(t)


@tables_query
def r10_foreman_open_tickets(t: SiteTables) -> DataFrame:
    return foreman.open_tickets_by_rank(t)


@tables_query
def r11_notice_centre(t: SiteTables) -> DataFrame:
    return notice_plans.to_notify(t)


@tables_query
def r11_notice_log(t: SiteTables) -> DataFrame:
    return notice_plans.log(t)


@tables_query
def r11_notice_figures(t: SiteTables) -> DataFrame:
    return notice_plans.figures(t)


@tables_query
def r12_template_preview(t: SiteTables) -> DataFrame:
    return templates.template_preview(change_set("template_requests", t.cantieri))


@tables_query
def r13_site_register(t: SiteTables) -> DataFrame:
    return registers.site_register(t)


@tables_query
def r13_pick_lists(t: SiteTables) -> DataFrame:
    sites = registers.site_labels(t, ordered=False).select(F.lit("cantieri").alias("tabella"), "id", "etichetta")
    tasks = registers.task_labels(t, ordered=False).select(F.lit("attivita").alias("tabella"), "id", "etichetta")
    return sites.unionByName(tasks)


@tables_query
def r13_crew_register(t: SiteTables) -> DataFrame:
    return registers.crew_register(t)


@tables_query
def r13_task_register(t: SiteTables) -> DataFrame:
    return registers.task_register(t)


@tables_query
def r13_ticket_register(t: SiteTables) -> DataFrame:
    return registers.ticket_register(t)
