"""Dates in Bulgarian text and date labels. The clock comes in as ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions import rules
from jobloom.functions.common import col, days_between, first_hit, lookup, micros_between

DAY_MONTH = r"(\d{1,2})\s+(" + "|".join(rules.MONTHS) + ")"


def find_bulgarian(text: Column | str) -> Column:
    """The first ``day month`` of a text, or null."""
    return F.nullif(F.regexp_extract(col(text), f"(?iu){DAY_MONTH}", 0), F.lit(""))


def parse_bulgarian(text: Column | str, as_of: Column) -> Column:
    """That day in the year of ``as_of``; a text without a real day gives ``as_of``."""
    day = F.regexp_extract(col(text), f"(?iu){DAY_MONTH}", 1)
    name = F.lower(F.regexp_extract(col(text), f"(?iu){DAY_MONTH}", 2))
    month = lookup(name, {m: i + 1 for i, m in enumerate(rules.MONTHS)})
    parts = F.concat_ws("-", F.year(as_of).cast("string"), F.coalesce(month.cast("string"), F.lit("x")), day)
    return F.coalesce(F.try_to_date(parts, "yyyy-M-d"), as_of.cast("date"))


def posted(attribute: Column | str, text: Column | str, as_of: Column) -> Column:
    """Posted time: the machine-readable attribute, else a Bulgarian date, else ``as_of``."""
    found = find_bulgarian(text)
    return F.coalesce(
        col(attribute).try_cast("timestamp_ntz"),
        F.when(found.isNotNull(), parse_bulgarian(found, as_of).cast("timestamp_ntz")),
        as_of,
    )


def age_days(time: Column | str, as_of: Column) -> Column:
    return days_between(time, as_of)


def _short(time: Column) -> Column:
    return F.date_format(time, "M/d/yyyy")


def deadline_label(deadline: Column | str, as_of: Column) -> Column:
    t = col(deadline)
    days = F.ceil(micros_between(as_of, t) / F.lit(86_400_000_000.0))
    return F.when(
        t.isNotNull(),
        first_hit(
            (days < 0, F.lit("Expired")),
            (days == 0, F.lit("Today")),
            (days == 1, F.lit("Tomorrow")),
            (days <= 7, F.concat(days.cast("string"), F.lit(" days left"))),
            otherwise=_short(t),
        ),
    )


def posted_label(time: Column | str, as_of: Column) -> Column:
    t = col(time)
    days = days_between(t, as_of)
    weeks = F.floor(days / 7)
    return F.when(
        t.isNotNull(),
        first_hit(
            (days == 0, F.lit("Today")),
            (days == 1, F.lit("Yesterday")),
            (days <= 7, F.concat(days.cast("string"), F.lit(" days ago"))),
            (days <= 30, F.concat(weeks.cast("string"), F.when(weeks == 1, " week ago").otherwise(" weeks ago"))),
            otherwise=_short(t),
        ),
    )
