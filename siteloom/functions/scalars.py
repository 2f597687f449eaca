"""Scalar column expressions. All of them are built-in Spark functions."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom import vocabulary as v

# Every character that counts as blank at the ends of a typed text.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def _choose(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda rest, pair: F.when(pair[0], pair[1]).otherwise(rest), reversed(pairs), otherwise)


def by_value(col: Column, table: dict[str, str], otherwise: str) -> Column:
    return _choose([(col == key, F.lit(value)) for key, value in table.items()], F.lit(otherwise))


# --- text ------------------------------------------------------------------
def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def or_else(col: Column, default: Column | str) -> Column:
    """Null *or empty* text becomes the default."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(col, F.lit("")), default)


def text(col: Column) -> Column:
    """A value printed into a text line; null prints as a dash."""
    return F.coalesce(col.cast("string"), F.lit(v.DASH))


def label_of(id_col: Column, title: Column) -> Column:
    return F.concat_ws(" - ", id_col.cast("string"), title)


def id_of_label(label: Column) -> Column:
    return F.split_part(label, F.lit(" - "), F.lit(1)).try_cast("bigint")


def slug(name: Column) -> Column:
    return F.translate(F.lower(name), " /", "__")


def italian_date(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


# --- coercion --------------------------------------------------------------
def parse_date(col: Column) -> Column:
    """ISO text to date; anything else is null."""
    return F.try_to_date(col, "yyyy-MM-dd")


def shift_days(day: Column, days: Column | int) -> Column:
    """ISO text of a day moved by some days."""
    return F.date_add(day, days).cast("string")


def _clamp(col: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def whole_percent(col: Column) -> Column:
    """Whole number as stored, unclamped; unreadable or null is 0."""
    return F.coalesce(col.try_cast("bigint"), F.lit(0).cast("bigint"))


def shown_percent(col: Column) -> Column:
    """Percent for display: numbers of any kind, cut to 0..100, decimals dropped."""
    number = F.coalesce(F.nanvl(col.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return _clamp(number, 0, 100).cast("int")


def effective_percent(state: Column, percent: Column) -> Column:
    """Done counts as 100 whatever was typed; everything else is cut to 0..100."""
    return F.when(state.isin(*v.TASK_DONE), F.lit(100)).otherwise(
        _clamp(whole_percent(percent), 0, 100).cast("int")
    )


def one_of(col: Column, words: list[str], default: str) -> Column:
    return F.when(col.isin(*words), col).otherwise(F.lit(default))


# --- ranking and labels ----------------------------------------------------
def priority_rank(col: Column) -> Column:
    order = list(reversed(v.PRIORITIES))[:3]
    return _choose([(col == word, F.lit(i)) for i, word in enumerate(order, 1)], F.lit(len(order) + 1))


def progress_label(percent: Column) -> Column:
    return _choose(
        [(percent >= low, F.lit(label)) for low, label in v.PROGRESS_LABELS],
        F.lit(v.PROGRESS_LABEL_ELSE),
    )


def progress_bar(percent: Column, blocks: int = v.BAR_BLOCKS) -> Column:
    share = _clamp(F.coalesce(percent, F.lit(0)), 0, 100) / F.lit(100.0)
    filled = F.bround(share * F.lit(float(blocks)), 0).cast("int")
    return F.concat(F.repeat(F.lit(v.BAR_FULL), filled), F.repeat(F.lit(v.BAR_EMPTY), F.lit(blocks) - filled))


def priority_colour(col: Column) -> Column:
    return by_value(col, v.PRIORITY_COLOURS, v.PRIORITY_COLOUR_ELSE)


def risk_colour(level: Column) -> Column:
    return by_value(level, v.RISK_COLOURS, v.RISK_COLOUR_ELSE)


def card_class(priority: Column) -> Column:
    return by_value(priority, v.CARD_CLASSES, "")


# --- numbers ---------------------------------------------------------------
def half_even_percent(part: Column, whole: Column) -> Column:
    """part / whole in percent, rounded half to even; 0 when whole is 0."""
    return F.when(whole != 0, F.bround(part / whole * F.lit(100.0), 0)).otherwise(F.lit(0.0))


def euro(col: Column) -> Column:
    amount = F.coalesce(col.try_cast("double"), F.lit(0.0))
    return F.concat(F.lit("€ "), F.translate(F.format_number(amount, 0), ",", "."))


# --- phones and links ------------------------------------------------------
def clean_phone(col: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(col, F.lit("")), "[^0-9]", "")
    return F.regexp_replace(digits, "^00", "")


def percent_encoded(col: Column) -> Column:
    """Percent-encoding that leaves '/' and '~' alone and writes a blank as %20."""
    form = F.url_encode(F.coalesce(col, F.lit("")))
    for wrong, right in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        form = F.replace(form, F.lit(wrong), F.lit(right))
    return form


def chat_link(phone: Column, message: Column) -> Column:
    return F.concat(F.lit(v.CHAT_LINK), clean_phone(phone), F.lit("?text="), percent_encoded(message))


# --- state bookkeeping -----------------------------------------------------
def quick_ticket_state(kind: Column, priority: Column) -> Column:
    blocking = F.coalesce((kind == v.TYPE_BLOCK) | (priority == v.PRIORITY_CRITICAL), F.lit(False))
    return F.when(blocking, F.lit(v.TICKET_BLOCKING)).otherwise(F.lit(v.TICKET_OPEN))


def close_stamp(closed_states: list[str], state: Column, old: Column, now: Column) -> Column:
    """Closing keeps an older stamp, reopening clears it."""
    return F.when(state.isin(*closed_states), F.coalesce(old, now))


def appended_note(old: Column, note: Column, now: Column) -> Column:
    """Old note, then a stamped line; a blank note changes nothing."""
    stamped = F.concat(F.lit("["), F.date_format(now, "dd/MM HH:mm"), F.lit("] "), strip(note))
    grown = F.concat_ws("\n", F.nullif(old, F.lit("")), stamped)
    blank = F.length(F.coalesce(strip(note), F.lit(""))) == 0
    return F.when(blank, F.coalesce(old, F.lit(""))).otherwise(grown)


def sent_stamp(state: Column, now: Column) -> Column:
    return F.when(state == v.NOTICE_SENT_BY_HAND, now)


def reply_stamp(reply: Column, old: Column, now: Column) -> Column:
    return F.when(F.length(F.coalesce(strip(reply), F.lit(""))) > 0, now).otherwise(old)


def literal_day(day: dt.date) -> Column:
    return F.lit(day)


def literal_time(moment: dt.datetime) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
