"""URLs and company names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import rules
from jobloom.functions.common import any_contains, col, lookup, text_list

PROFILE_PATH = r"/company/[a-zA-Z0-9\-_]+/?$"


def _part(url: Column | str, part: str) -> Column:
    return F.try_parse_url(col(url), F.lit(part))


def is_http(url: Column | str) -> Column:
    ok = F.lower(_part(url, "PROTOCOL")).isin("http", "https") & (_part(url, "HOST") != "")
    return F.coalesce(ok, F.lit(False))


def _both_ways(text: Column, table: list[str]) -> Column:
    """True when the text holds an entry of the table or lies within one."""
    return F.exists(text_list(table), lambda x: text.contains(x) | x.contains(text))


def is_company_url(url: Column | str, domains: list[str] | None = None) -> Column:
    """http(s), and not a job board; the profile board is fine on a company profile path only."""
    board = rules.PROFILE_BOARD
    others = [d for d in (domains or rules.BOARD_DOMAINS) if d != board]
    host, path = F.lower(_part(url, "HOST")), F.coalesce(_part(url, "PATH"), F.lit(""))
    ok = F.when(host.contains(board), path.rlike(PROFILE_PATH)).otherwise(~_both_ways(host, others))
    return is_http(url) & F.coalesce(ok, F.lit(False))


def slug(name: Column | str) -> Column:
    dashed = F.regexp_replace(F.lower(col(name)), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-|-$", "")


def is_company_name(name: Column | str, boards: list[str] | None = None) -> Column:
    """Not blank and not a job board, by substring in either direction."""
    text = F.trim(F.lower(col(name)))
    table = sorted({b.lower() for b in (boards or rules.BOARD_NAMES)})
    return F.coalesce((text != "") & ~_both_ways(text, table), F.lit(False))


def takes_new_name(old: Column | str, new: Column | str) -> Column:
    """The new name replaces the old only if it is valid and the old is blank or invalid."""
    return is_company_name(new) & ~is_company_name(old)


def sanitize(companies: DataFrame) -> DataFrame:
    """Null in place of invalid names and websites."""
    return companies.withColumns(
        {
            "name": F.when(is_company_name("name"), F.col("name")),
            "website": F.when(is_company_url("website"), F.col("website")),
        }
    )


def _title_case(part: Column) -> Column:
    name = F.trim(F.replace(F.replace(part, F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" ")))
    words = F.transform(
        F.split(name, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
    )
    titled = F.array_join(words, " ")
    lowered = F.lower(titled)
    special = lookup(lowered, rules.SPECIAL_NAMES)
    return F.when(
        (F.length(part) >= 3) & ~lowered.isin(rules.GENERIC_NAMES), F.coalesce(special, titled)
    )


def name_from_job_url(url: Column | str) -> Column:
    """Company name from a job URL: its first one, two or three slug parts, whichever can be a name."""
    parts = F.split(F.nullif(F.regexp_extract(col(url), r"/company/jobads/([^/]+)", 1), F.lit("")), "-")
    tries = [_title_case(F.array_join(F.slice(parts, 1, n), "-")) for n in (1, 2, 3)]
    return F.coalesce(*[F.when(F.length(t) >= 3, t) for t in tries])


def mentions(text: Column, needles: list[str]) -> Column:
    return any_contains(text, needles)
