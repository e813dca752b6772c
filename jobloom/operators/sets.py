"""Stacking and de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per label with its row count."""
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("label"), "n") for k, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def union_all(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("label"), "*") for k, df in parts.items()])


def first_url_per_target(links: DataFrame, target: str, url: str, position: str) -> DataFrame:
    """The first URL of each target in reading order."""
    return links.groupBy(target).agg(F.min_by(url, position).alias(url), F.min(position).alias(position))


def one_row(parts: list[DataFrame]) -> DataFrame:
    """One-row frames side by side, stacked with nulls and folded, so without any cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
