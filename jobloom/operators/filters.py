"""Filters on vacancies and companies."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.common import moment


def contains_ci(name: str, needle: str) -> Column:
    return F.lower(F.col(name)).contains(needle.lower())


def either_contains(needle: str, *names: str) -> Column:
    return reduce(lambda a, b: a | b, [contains_ci(n, needle) for n in names])


@dataclass(frozen=True)
class VacancyFilter:
    """One predicate for counting and for paging. Empty text and a bound of 0 count as absent."""

    search: str | None = None
    location: str | None = None
    level: str | None = None
    salary_min: int | None = None
    salary_max: int | None = None

    def predicate(self) -> Column:
        parts = [F.col("status") == "active"]
        if self.search:
            parts.append(either_contains(self.search, "title", "description"))
        if self.location:
            parts.append(contains_ci("location", self.location))
        if self.level:
            parts.append(F.col("experience_level") == self.level)
        if self.salary_min:
            parts.append(F.col("salary_min") >= self.salary_min)
        if self.salary_max:
            parts.append(F.col("salary_max") <= self.salary_max)
        return reduce(lambda a, b: a & b, parts)


@dataclass(frozen=True)
class CompanyFilter:
    search: str | None = None
    industry: str | None = None
    size: str | None = None

    def predicate(self) -> Column:
        parts = [F.lit(True)]
        if self.search:
            parts.append(either_contains(self.search, "name", "description"))
        if self.industry:
            parts.append(contains_ci("industry", self.industry))
        if self.size:
            parts.append(F.col("size") == self.size)
        return reduce(lambda a, b: a & b, parts)


def has_words(text: Column, query: str) -> Column:
    """Whether a text holds every word of a query as a whole word, whatever the case."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}#+]+")
    wanted = [w for w in re.split(r"[^\w#+]+", query.lower()) if w]
    return reduce(lambda a, b: a & b, [F.array_contains(words, w) for w in wanted], F.lit(True))


def active(vacancies: DataFrame) -> DataFrame:
    return vacancies.filter(F.col("status") == "active")


def technology_hits(vacancy_tech: DataFrame, wanted: list[str]) -> DataFrame:
    """Per vacancy, how many of the wanted technologies it names.

    One bit per technology, so repeats need no DISTINCT and the map side
    shrinks every vacancy to a single number before the shuffle.
    """
    bit = F.lit(0)
    for i, tech in enumerate(wanted):
        bit = F.when(F.col("tech") == tech, F.lit(1 << i)).otherwise(bit)
    return (
        vacancy_tech.filter(F.col("tech").isin(wanted))
        .groupBy("vacancy_id")
        .agg(F.bit_count(F.bit_or(bit)).alias("n_hits"))
    )


def with_technologies(vacancies: DataFrame, vacancy_tech: DataFrame, wanted: list[str], need_all: bool) -> DataFrame:
    hits = technology_hits(vacancy_tech, wanted)
    if need_all:
        hits = hits.filter(F.col("n_hits") == len(wanted))
    return vacancies.join(hits, "vacancy_id", "left_semi")


def processed(vacancies: DataFrame) -> DataFrame:
    return vacancies.filter(F.col("extraction_confidence") > 0)


def unexpired(vacancies: DataFrame, as_of: str) -> DataFrame:
    return vacancies.filter(F.col("expires_at").isNull() | (F.col("expires_at") > moment(as_of)))


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with this key; no row when there is none."""
    return df.filter(F.col(key) == F.lit(value))
