"""Translation and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions import rules
from jobloom.functions.common import any_contains, col, first_hit, lookup, present


def job_terms(text: Column | str, terms: dict[str, str] | None = None) -> Column:
    """Bulgarian job terms in English, in table order, ignoring case."""
    out = col(text)
    for term, english in (terms or rules.JOB_TERMS).items():
        out = F.regexp_replace(out, f"(?iu){term}", english)
    return out


def location(text: Column | str, table: dict[str, str] | None = None) -> Column:
    return lookup(col(text), table or rules.LOCATIONS, col(text))


def work_model(text: Column | str) -> Column:
    return lookup(col(text), rules.WORK_MODELS, F.lit("on-site"))


def badge_model(badge: Column | str) -> Column:
    text = F.lower(col(badge))
    return first_hit(
        (any_contains(text, ["remote", "дистанционно"]), "remote"),
        (any_contains(text, ["hybrid", "хибридно"]), "hybrid"),
        otherwise="on-site",
    )


def badge_location(badge: Column | str) -> Column:
    """The first non-blank line of a badge, translated."""
    lines = F.filter(F.transform(F.split(col(badge), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    return F.coalesce(location(first), F.lit("Bulgaria"))


def initials(name: Column | str) -> Column:
    words = F.slice(F.split(col(name), " "), 1, 2)
    return F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")


def truncate(text: Column | str, n: int) -> Column:
    c = col(text)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def employment_label(kind: Column | str) -> Column:
    """``full_time`` or ``full-time`` as ``Full Time``; only the first underscore splits words."""
    dashed = F.regexp_replace(present(kind), "^([^_]*)_", "$1-")
    return F.initcap(F.replace(dashed, F.lit("-"), F.lit(" ")))


def best_location(headquarters: Column | str, offices: Column | str, other: Column | str) -> Column:
    return F.coalesce(present(headquarters), F.get(col(offices), F.lit(0)), col(other))


def has_social(*links: Column | str) -> Column:
    return F.coalesce(*[present(x) for x in links]).isNotNull()
