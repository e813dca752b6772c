"""Sorting, paging and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.common import non_zero
from jobloom.functions.levels import recommendation
from jobloom.operators import aggregates, windows

VACANCY_SORT = ("created_at", "title", "salary_min", "salary_max", "experience_level", "location")

METRICS = {
    "overall": "recommendation_score",
    "culture": "culture_score",
    "workLife": "work_life_balance",
    "career": "career_growth",
    "tech": "tech_culture",
}


def by_field(field: str = "created_at", descending: bool = True) -> list[Column]:
    """Vacancy order with nulls as the largest value, so first when descending; ties by id."""
    if field not in VACANCY_SORT:
        raise ValueError(f"cannot sort vacancies by {field}")
    column = F.col(field)
    first = column.desc_nulls_first() if descending else column.asc_nulls_last()
    return [first, F.col("vacancy_id").asc()]


def by_score_count(vacancies: DataFrame, scores: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Vacancies with their number of scores, and the order most scores first, then newest."""
    counts = scores.groupBy("vacancy_id").agg(F.count(F.lit(1)).alias("n_scores"))
    rows = vacancies.join(counts, "vacancy_id", "left").fillna(0, ["n_scores"])
    return rows, [F.desc("n_scores"), F.col("created_at").desc_nulls_first(), F.col("vacancy_id").asc()]


def by_metric(metric: str, descending: bool = True) -> list[Column]:
    """Company order by a score, 0 and null last either way; ties by id."""
    value = non_zero(METRICS[metric])
    first = value.desc_nulls_last() if descending else value.asc_nulls_last()
    return [first, F.col("company_id").asc()]


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page. Spark keeps offset + size rows per task, never a full sort in one place."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, after: Column, order: list[Column], size: int) -> DataFrame:
    """The page after a known last row: for deep paging, where an offset would grow."""
    return df.filter(after).orderBy(*order).limit(size)


def page_info(df: DataFrame, size: int) -> DataFrame:
    """Row count and page count of a listing."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / F.lit(size)))


def capped(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """At most ``limit`` rows of a run; 0 means all."""
    return df.orderBy(*order).limit(limit) if limit else df


def top_companies(companies: DataFrame, analyses: DataFrame, vacancies: DataFrame, k: int, metric: str = "overall"):
    """The k best companies by their newest analysis that has the metric."""
    field = METRICS[metric]
    latest = windows.latest_analysis(analyses, field)
    counted = aggregates.open_per_company(companies, vacancies)
    return (
        counted.join(latest, "company_id", "inner")
        .withColumn("recommendation", recommendation(F.col("recommendation_score")))
        .orderBy(F.desc(field), F.asc("company_id"))
        .limit(k)
    )
