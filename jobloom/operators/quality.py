"""Data-quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions import urls
from jobloom.functions.common import issues
from jobloom.operators import components, joins, windows

STATUSES = ["active", "filled", "inactive", "expired", "duplicate"]
LEVELS = ["junior", "mid", "senior", "lead", "not_specified"]


def vacancy_violations(vacancies: DataFrame) -> DataFrame:
    """Vacancies that break a rule, with the rules they break."""
    broken = issues(
        (F.col("salary_min") > F.col("salary_max"), "salary_min over salary_max"),
        (~F.col("status").isin(STATUSES), "unknown status"),
        (~F.col("experience_level").isin(LEVELS), "unknown experience level"),
        (~F.col("quality_score").between(0, 100), "quality score out of bounds"),
        (~F.col("extraction_confidence").between(0, 100), "confidence out of bounds"),
        (F.col("duplicate_of") == F.col("vacancy_id"), "duplicate of itself"),
        (F.col("title").isNull(), "title missing"),
    )
    return vacancies.withColumn("broken", broken).filter(F.size("broken") > 0)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def orphans(children: DataFrame, parents: DataFrame, key: str, child_id: str, label: str) -> DataFrame:
    """Child rows whose parent is missing."""
    lost = children.filter(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti")
    return lost.select(F.lit(label).alias("reference"), F.col(child_id).alias("child_id"), F.col(key).alias("missing"))


def name_fixes(companies: DataFrame, vacancies: DataFrame) -> DataFrame:
    """Companies with a job-board name and the name their oldest telling job URL gives."""
    wrong = companies.filter(~urls.is_company_name("name")).select("company_id", "name")
    named = vacancies.select("company_id", "created_at", "vacancy_id", urls.name_from_job_url("source_url").alias("found"))
    best = (
        named.filter(F.col("found").isNotNull())
        .join(wrong.select("company_id"), "company_id", "left_semi")
        .groupBy("company_id")
        .agg(F.min_by("found", F.struct("created_at", "vacancy_id")).alias("new_name"))
    )
    return wrong.join(best, "company_id", "left")


def apply_name_fixes(companies: DataFrame, fixes: DataFrame) -> DataFrame:
    new = fixes.filter(F.col("new_name").isNotNull()).select("company_id", "new_name")
    return companies.join(new, "company_id", "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")


def sure_duplicates(vacancies: DataFrame, least: int = 80) -> DataFrame:
    """The duplicate pairs, by title or by words, whose words are similar enough; an equal title alone is not."""
    return joins.duplicate_pairs(vacancies, least).filter(F.col("similarity") >= least)


def duplicate_groups(vacancies: DataFrame, least: int = 80) -> DataFrame:
    """Vacancies that are linked by duplicate pairs, with the oldest of each group as canonical."""
    groups = components.connected_groups(sure_duplicates(vacancies, least).select("original_id", "duplicate_id"))
    members = groups.join(vacancies.select(F.col("vacancy_id").alias("node"), "created_at"), "node")
    oldest = members.groupBy("group").agg(F.min_by("node", F.struct("created_at", "node")).alias("canonical_id"))
    return windows.split_join(members, oldest, ["group"], "inner").select(
        F.col("node").alias("vacancy_id"), "canonical_id", (F.col("node") != F.col("canonical_id")).alias("is_duplicate")
    )


def stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
