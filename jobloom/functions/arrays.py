"""Array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import rules
from jobloom.functions.common import any_contains, col


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.array().cast("array<string>"))


def technology_union(a: Column | str, b: Column | str) -> Column:
    """Sorted union of two technology lists."""
    return F.array_sort(F.array_union(_or_empty(col(a)), _or_empty(col(b))))


def clean_titles(titles: Column | str) -> Column:
    """Lowered, trimmed, without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(col(titles), lambda x: F.trim(F.lower(x))), lambda x: x != ""))


def merge_ignoring_case(a: Column | str, b: Column | str) -> Column:
    """Both lists in order, without later repeats that differ only in case; null when empty."""
    joined = F.concat(_or_empty(col(a)), _or_empty(col(b)))
    lowered = F.transform(joined, F.lower)
    kept = F.filter(joined, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return F.when(F.size(joined) > 0, kept)


def categorise(technologies: Column | str) -> Column:
    """Technologies by category plus ``other``; empty categories are left out."""
    techs = col(technologies)
    known = [t for group in rules.TECH_CATEGORIES.values() for t in group]

    def group(name: str, members: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), members.alias("value"))

    def among(names: list[str]) -> Column:
        return F.filter(techs, lambda x: x.isin(names))

    groups = [group(name, among(names)) for name, names in rules.TECH_CATEGORIES.items()]
    groups.append(group("other", F.filter(techs, lambda x: ~x.isin(known))))
    return F.map_from_entries(F.filter(F.array(*groups), lambda g: F.size(g["value"]) > 0))


def display_category(technology: Column) -> Column:
    """The display category of one technology."""
    name, chain = F.lower(technology), None
    for category, words in rules.DISPLAY_CATEGORIES.items():
        hit = any_contains(name, words)
        chain = F.when(hit, category) if chain is None else chain.when(hit, category)
    return chain.otherwise("Other")


def category_counts(vacancy_tech: DataFrame) -> DataFrame:
    """Mentions per display category, without building any per-vacancy array."""
    return vacancy_tech.groupBy(display_category(F.col("tech")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def first_n(values: Column | str, n: int) -> Column:
    return F.slice(_or_empty(col(values)), 1, n)
