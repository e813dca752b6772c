"""Small column helpers used everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def moment(text: str) -> Column:
    """A zone-free timestamp literal, the type of every stored time."""
    return F.lit(text).cast("timestamp_ntz")


def trunc(period: str, time: Column | str) -> Column:
    """Start of the week, month, quarter, .. as a zone-free timestamp."""
    return F.date_trunc(period, col(time)).cast("timestamp_ntz")


def half_up(value: Column | str, digits: int = 0) -> Column:
    """Round halves towards plus infinity, as floor(x + 0.5) on a scaled value."""
    if digits == 0:
        return F.floor(col(value) + 0.5)
    scale = float(10**digits)
    return F.floor(col(value) * scale + 0.5) / scale


def micros_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def days_between(start: Column | str, end: Column | str) -> Column:
    """Whole days from start to end, rounded down."""
    return F.floor(micros_between(start, end) / F.lit(86_400_000_000.0))


def present(value: Column | str) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(col(value), F.lit(""))


def non_zero(value: Column | str) -> Column:
    """The number, or null when it is zero."""
    return F.nullif(col(value), F.lit(0))


def first_hit(*choices: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first true condition."""
    chain = None
    for condition, value in choices:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain if otherwise is None else chain.otherwise(otherwise)


def any_contains(text: Column, needles: list[str]) -> Column:
    """True when the text holds one of the needles."""
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def text_list(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lookup(value: Column, table: dict, default: Column | None = None) -> Column:
    """Translate through a small fixed table; null or ``default`` when the key is missing."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), value)
    return found if default is None else F.coalesce(found, default)


SEPARATOR = "\x1f"


def compact(items: list[Column]) -> Column:
    """The texts that are not null, in order.

    Joined and split again rather than filtered: array lambdas are interpreted, and
    would evaluate a shared input such as lower(text) once per item.
    """
    joined = F.concat_ws(SEPARATOR, *items)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, SEPARATOR))


def issues(*rules: tuple[Column, str | Column]) -> Column:
    """The texts of the rules that fire, in order."""
    return compact([F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in rules])


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), make), F.lit(0))
