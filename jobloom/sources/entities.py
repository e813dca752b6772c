"""Declared schemas of the stored entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.functions import jsons

TEXTS = "array<string>"

_FACTORS = ", ".join(
    f"{name}: double"
    for name in (
        "tech_innovation dev_practices tools tech_culture culture_align work_env leadership transparency career learning "
        "mentorship skills salary equity benefits perks flexibility time_off workload wellness finance market growth layoff"
    ).split()
)

# the first column of each entity is its key
SCHEMAS: dict[str, str] = {
    "company": "company_id bigint, name string, description string, website string, industry string, size string, "
    "location string, logo string, founded int, employee_count int, created_at timestamp_ntz",
    "company_source": "source_id bigint, company_id bigint, source_site string, source_url string, "
    "last_scraped_at timestamp_ntz, scraped_content string, content_hash string, is_valid boolean",
    "company_analysis": "analysis_id bigint, company_id bigint, analysis_source string, recommendation_score double, "
    "culture_score double, work_life_balance double, career_growth double, salary_competitiveness double, "
    "benefits_score double, tech_culture double, retention_rate double, confidence_score int, data_completeness int, "
    f"industry_percentile double, size_percentile double, factors struct<{_FACTORS}>, pros string, cons string, "
    "tech_stack string, company_values string, raw_data string, created_at timestamp_ntz",
    "vacancy": "vacancy_id bigint, company_id bigint, title string, description string, requirements array<string>, "
    f"responsibilities {TEXTS}, technologies {TEXTS}, benefits {TEXTS}, location string, "
    "salary_min int COMMENT 'whole currency units', salary_max int COMMENT 'whole currency units', currency string, "
    "experience_level string, employment_type string, work_model string, status string, source_site string, "
    "source_url string, content_hash string, extraction_confidence int, quality_score int, duplicate_of bigint, "
    "posted_at timestamp_ntz, expires_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    "vacancy_score": "score_id bigint, vacancy_id bigint, overall_score int, scoring_criteria string, "
    "scored_at timestamp_ntz",
    "cv": f"cv_id bigint, filename string, extracted_text string, skills {TEXTS}, experience int, education {TEXTS}",
    "application": "application_id bigint, vacancy_id bigint, cv_id bigint, status string, applied_at timestamp_ntz, "
    "cover_letter string, notes string, created_at timestamp_ntz",
}


def schema(entity: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[entity])


def key_of(entity: str) -> str:
    return schema(entity).fields[0].name


def scan(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Read a stored entity with its declared schema; no inference, no file listing for types."""
    return spark.read.schema(schema(entity)).parquet(path)


def conform(df: DataFrame, entity: str) -> DataFrame:
    """The declared columns of an entity in order; those the input lacks are null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema(entity).fields
        ]
    )


def public_analysis(analyses: DataFrame) -> DataFrame:
    """An analysis as readers see it: lists parsed, two columns renamed, raw data left out."""
    lists = [c for c in ("pros", "cons", "tech_stack", "company_values") if c in analyses.columns]
    parsed = analyses.withColumns({c: jsons.text_array(c) for c in lists})
    return parsed.withColumnsRenamed({"tech_stack": "technologies", "company_values": "values"}).drop("raw_data")
