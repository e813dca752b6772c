"""Grouped and global aggregates. Every one combines on the map side before its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.common import moment, non_zero, trunc
from jobloom.operators import filters, windows


def open_per_company(companies: DataFrame, vacancies: DataFrame) -> DataFrame:
    counts = filters.active(vacancies).groupBy("company_id").agg(F.count(F.lit(1)).alias("n_open"))
    return companies.join(counts, "company_id", "left").withColumn("n_open", F.coalesce("n_open", F.lit(0)))


def source_stats(sources: DataFrame) -> DataFrame:
    """Counts, validity and age, a row for each site and one of a null site for the total."""
    per_site = sources.groupBy("source_site").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_valid").alias("ok"),
        F.min("last_scraped_at").alias("first"),
        F.max("last_scraped_at").alias("last"),
    )

    def summed(rows):
        return rows.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
            F.coalesce(F.sum("ok"), F.lit(0)).alias("valid"),
            F.coalesce(F.sum("n") - F.sum("ok"), F.lit(0)).alias("invalid"),
            F.min("first").alias("oldest"),
            F.max("last").alias("newest"),
        )

    whole = summed(per_site).withColumn("source_site", F.lit(None).cast("string"))
    return summed(per_site.groupBy("source_site")).unionByName(whole)


def site_stats(vacancies: DataFrame) -> DataFrame:
    """Per site: vacancies, active ones, companies and the last time.

    Companies are counted in two steps, (site, company) then site, so a site
    with a third of all rows is spread over its companies.
    """
    pairs = vacancies.groupBy("source_site", "company_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "active").alias("a"),
        F.max("created_at").alias("t"),
    )
    return pairs.groupBy("source_site").agg(
        F.sum("n").alias("total"),
        F.sum("a").alias("active"),
        F.count("company_id").alias("companies"),
        F.max("t").alias("last_created"),
    )


def site_sketches(vacancies: DataFrame, day: str = "created_at", lg_size: int = 12) -> DataFrame:
    """``site_stats`` of each site and day as rows that add up: counts, last time, and a sketch of the companies.

    The nightly run sketches the new day alone. A sketch has a fixed size (2 ** ``lg_size`` registers at
    most), whatever the number of companies.
    """
    return vacancies.groupBy("source_site", F.to_date(day).alias("day")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.hll_sketch_agg("company_id", lg_size).alias("companies"),
        F.max("created_at").alias("last_created"),
    )


def site_stats_of(sketches: DataFrame) -> DataFrame:
    """Per site the totals of its daily sketches. ``companies`` is an estimate: with ``lg_size`` 12, 1.6% off as a rule."""
    return sketches.groupBy("source_site").agg(
        F.sum("total").alias("total"),
        F.sum("active").alias("active"),
        F.hll_sketch_estimate(F.hll_union_agg("companies")).alias("companies"),
        F.max("last_created").alias("last_created"),
    )


def salary_range(companies: DataFrame, vacancies: DataFrame, newest: int | None = None) -> DataFrame:
    """Least minimum, greatest maximum and newest currency of a company's active vacancies, or of its ``newest`` ones."""
    rows = filters.active(vacancies)
    if newest is not None:
        rows = windows.newest_n(rows, "company_id", [F.col("created_at").desc(), F.col("vacancy_id").desc()], newest)
    paid = rows.withColumn("lo", non_zero("salary_min")).withColumn("hi", non_zero("salary_max"))
    ranges = (
        paid.filter(F.col("lo").isNotNull() | F.col("hi").isNotNull())
        .groupBy("company_id")
        .agg(
            F.min("lo").alias("range_min"),
            F.max("hi").alias("range_max"),
            F.coalesce(F.max_by("currency", F.struct("created_at", "vacancy_id")), F.lit("BGN")).alias("range_currency"),
        )
    )
    return companies.select("company_id").join(ranges, "company_id", "left")


def ratio(part, whole):
    return F.when(whole > 0, part / whole).otherwise(0.0)


def batch_summary(results: DataFrame) -> DataFrame:
    """Outcome of a batch of (ok, quality, millis, cache_hit); means over the good rows, 0 when there are none."""
    ok = F.col("ok")
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.avg(F.when(ok, F.col("quality"))), F.lit(0.0)).alias("mean_quality"),
        F.coalesce(F.avg(F.when(ok, F.col("millis"))), F.lit(0.0)).alias("mean_millis"),
        ratio(F.count_if(ok & F.col("cache_hit")), F.count_if(ok)).alias("cache_hit_rate"),
    )


def ingest_summary(merge_log: DataFrame) -> DataFrame:
    """Actions of each run (run_id, company_id, action, known), and the companies it met that are not known yet, in one pass."""
    fresh = F.when((F.col("action") != "error") & F.col("known").isNull(), F.col("company_id"))
    return merge_log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("action") == "insert").alias("new_vacancies"),
        F.count_if(F.col("action") == "update").alias("updated_vacancies"),
        F.count_if(F.col("action") == "error").alias("errors"),
        F.count_distinct(fresh).alias("new_companies"),
    )


def applications_weekly(applications: DataFrame) -> DataFrame:
    return (
        applications.filter(F.col("applied_at").isNotNull())
        .groupBy(trunc("week", "applied_at").alias("week"), "status")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_k(df: DataFrame, key: str, k: int, out: str = "n") -> DataFrame:
    """The k most frequent keys, ties by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), F.asc(key)).limit(k)


def top_technologies(vacancies: DataFrame, vacancy_tech: DataFrame, k: int) -> DataFrame:
    """Most named technologies of active vacancies."""
    live = filters.active(vacancies).select("vacancy_id")
    return top_k(vacancy_tech.join(live, "vacancy_id", "left_semi"), "tech", k)


def mid_salary():
    return (F.col("salary_min") + F.col("salary_max")) / 2


def salary_trend(vacancies: DataFrame, period: str = "month") -> DataFrame:
    return (
        vacancies.filter(F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull())
        .groupBy(trunc(period, "created_at").alias("period"))
        .agg(F.avg(mid_salary()).alias("mean_salary"), F.count(F.lit(1)).alias("n"))
    )


def new_since(vacancies: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    since = moment(as_of) - F.make_dt_interval(F.lit(days))
    return vacancies.agg(
        F.count_if((F.col("created_at") >= since) & (F.col("created_at") < moment(as_of))).alias("n_new")
    )


def vacancy_trend(vacancies: DataFrame, period: str, vacancy_tech: DataFrame | None = None, tech: str | None = None):
    """Vacancies per week, month or quarter, for all or for one technology."""
    if tech is not None:
        ids = vacancy_tech.filter(F.col("tech") == tech)
        vacancies = vacancies.join(ids, "vacancy_id", "left_semi")
    return vacancies.groupBy(trunc(period, "created_at").alias("period")).agg(F.count(F.lit(1)).alias("n"))


def company_metrics(vacancies: DataFrame, vacancy_tech: DataFrame, k: int = 5) -> DataFrame:
    """Per company: counts, mean salary, k most named technologies, work models."""
    base = vacancies.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("status") == "active").alias("n_active"),
        F.avg(mid_salary()).alias("mean_salary"),
        F.array_sort(F.collect_set("work_model")).alias("work_models"),
    )
    counts = (
        vacancy_tech.join(vacancies.select("vacancy_id", "company_id"), "vacancy_id")
        .groupBy("company_id", "tech")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per (company, technology): the window is bounded by the technology list
    window = Window.partitionBy("company_id").orderBy(F.desc("n"), F.asc("tech"))
    best = counts.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= k)
    named = best.groupBy("company_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "tech"))), lambda x: x["tech"]).alias("top_tech")
    )
    return base.join(named, "company_id", "left")


def scrape_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source_site", "status").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.sum("vacancies_found").alias("found"),
        F.sum("vacancies_new").alias("new"),
        F.sum("vacancies_updated").alias("updated"),
        F.count_if(F.col("status") == "failed").alias("failures"),
    )


def usage(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count(F.lit(1)).alias("requests"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
        ratio(F.count_if("cache_hit"), F.count(F.lit(1))).alias("cache_hit_rate"),
    )
