"""Plan expansion from task templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions import scalars as s
from siteloom.operators.counts import SITE

COLUMNS = ["template", "fase", "titolo", "descrizione", "ruolo", "priorita", "giorno"]


def template_tasks(spark: SparkSession) -> DataFrame:
    """The built-in templates, one row per task, with their place in the template."""
    rows = [(place, *row) for place, row in enumerate(v.PLAN_TEMPLATES)]
    schema = "posto int, template string, fase string, titolo string, descrizione string, ruolo string, priorita string, giorno int"
    return spark.createDataFrame(rows, schema)


def _matched(requests: DataFrame, templates: DataFrame | None) -> DataFrame:
    """Requests joined with the tasks of their template.

    The built-in templates are a few dozen rows, so they are broadcast and a
    request is expanded where it is read; an unknown template gives no rows.
    A template table of the caller's own carries no hint.
    """
    tasks = F.broadcast(template_tasks(requests.sparkSession)) if templates is None else templates
    return requests.join(tasks, "template")


def template_preview(requests: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """What would be created for each request (cantiere_id, template)."""
    return _matched(requests, templates).select(
        SITE,
        "fase",
        "titolo",
        "descrizione",
        F.col("ruolo").alias("ruolo_suggerito"),
        "priorita",
        "giorno",
        F.lit(0).alias("avanzamento"),
    )


def expand_templates(requests: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Task insert batch of requests (cantiere_id, template, inizio as a date)."""
    return _matched(requests, templates).select(
        SITE,
        "posto",
        "fase",
        "titolo",
        "descrizione",
        F.col("ruolo").alias("assegnato_a"),
        F.lit(None).cast("bigint").alias("dipende_da_id"),
        F.lit(v.TASK_STATES[0]).alias("stato"),
        "priorita",
        s.shift_days(F.col("inizio"), F.col("giorno")).alias("scadenza"),
        F.lit(0).cast("bigint").alias("percentuale"),
        F.concat(F.lit(v.TEMPLATE_NOTE), F.col("template")).alias("note"),
    )
