"""Queries of the relational groups: sources, filters, joins, aggregates, windows, order, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import arrays, jsons, levels
from jobloom.functions.common import days_between, half_up, moment, non_zero
from jobloom.operators import aggregates, filters, joins, listing, ordering, sets, windows, word_index
from jobloom.plans.registry import plan
from jobloom.session import scratch
from jobloom.sources import entities, listing_pages, logs, sinks
from jobloom.sources.inputs import load, view

AS_OF = "2024-02-01 00:00:00"
VACANCY_AS_OF = "2001-09-01 00:00:00"
ACTIVE = "status = 'active'"


def r4(value):
    return half_up(value, 4)


def sql_r4(text: str) -> str:
    return f"floor(({text}) * 10000.0 + 0.5) / 10000.0"


def mean(name: str):
    """Mean over exact decimals, so the order of summing cannot show."""
    return F.avg(F.col(name).cast("decimal(12,4)")).cast("double")


def sql_mean(name: str) -> str:
    return f"CAST(avg(CAST({name} AS DECIMAL(12,4))) AS DOUBLE)"


# ---- sources and sinks ----


@plan(
    "src_entities",
    """SELECT 'company' AS entity, count(*) AS n_rows, count(DISTINCT company_id) AS n_keys FROM companies
    UNION ALL SELECT 'company_source', count(*), count(DISTINCT source_id) FROM company_sources
    UNION ALL SELECT 'company_analysis', count(*), count(DISTINCT analysis_id) FROM company_analyses
    UNION ALL SELECT 'vacancy', count(*), count(DISTINCT vacancy_id) FROM vacancies
    UNION ALL SELECT 'vacancy_score', count(*), count(DISTINCT score_id) FROM vacancy_scores
    UNION ALL SELECT 'cv', count(*), count(DISTINCT cv_id) FROM cvs
    UNION ALL SELECT 'application', count(*), count(DISTINCT application_id) FROM applications""",
)
def src_entities(spark, d):
    views = {
        "company": "companies",
        "company_source": "company_sources",
        "company_analysis": "company_analyses",
        "vacancy": "vacancy_facts",
        "vacancy_score": "vacancy_scores",
        "cv": "cvs",
        "application": "applications",
    }
    return sets.union_all(
        {
            name: entities.conform(view(spark, d, source), name).agg(
                F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col(entities.key_of(name))).alias("n_keys")
            )
            for name, source in views.items()
        }
    ).withColumnRenamed("label", "entity")


@plan(
    "src_listing_pages",
    """WITH runs AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS site, page_id,
      CAST(length(html) - length(replace(html, '<p>', '')) AS BIGINT) // 3 AS n_listings FROM pages),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS page_no FROM runs),
    stops AS (SELECT site, min(page_no) AS stop FROM numbered WHERE n_listings <= 3 GROUP BY site)
    SELECT n.site, n.page_id, n.page_no, n.n_listings FROM numbered n LEFT JOIN stops s ON s.site = n.site
    WHERE s.stop IS NULL OR n.page_no < s.stop""",
)
def src_listing_pages(spark, d):
    pages = load(spark, d, "pages").select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("site"),
        "page_id",
        F.floor((F.length("html") - F.length(F.replace("html", F.lit("<p>"), F.lit("")))) / 3).alias("n_listings"),
    )
    return listing_pages.run_pages(pages, "site", "page_id", F.col("n_listings") <= 3)


@plan(
    "src_json_logs",
    """SELECT CAST(logged_at AS DATE) AS log_date, count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS tokens,
    CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS failures FROM request_logs GROUP BY 1""",
)
def src_json_logs(spark, d):
    path = logs.write_logs(view(spark, d, "request_logs"))
    return (
        logs.read_logs(spark, path)
        .groupBy("log_date")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum("response.usage.total_tokens").alias("tokens"),
            F.count_if(F.col("error").isNotNull()).alias("failures"),
        )
    )


@plan(
    "snk_csv_export",
    """SELECT vacancy_id, location, extraction_confidence, quality_score, created_at FROM vacancies
    WHERE extraction_confidence > 0""",
)
def snk_csv_export(spark, d):
    rows = filters.processed(view(spark, d, "vacancy_facts")).select(
        "vacancy_id", "location", "extraction_confidence", "quality_score", "created_at"
    )
    path = sinks.export_csv(rows, [F.desc("extraction_confidence"), F.asc("vacancy_id")])
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@plan(
    "snk_partitioned",
    "SELECT strftime(created_at, '%Y-%m') AS ym, count(*) AS n, min(vacancy_id) AS first_id FROM vacancies "
    "WHERE created_at >= TIMESTAMP '2000-01-01' GROUP BY 1",
)
def snk_partitioned(spark, d):
    path = sinks.write_by_month(view(spark, d, "vacancy_facts"), "created_at")
    stored = spark.read.parquet(path)
    return (
        stored.filter(F.col("ym") >= "2000-01")
        .groupBy(F.col("ym").cast("string").alias("ym"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("vacancy_id").alias("first_id"))
    )


@plan(
    "snk_archive",
    """SELECT CASE WHEN status = 'filled' AND created_at < TIMESTAMP '2001-03-01' THEN 'archive' ELSE 'live' END AS part,
    status, count(*) AS n FROM vacancies GROUP BY 1, 2""",
)
def snk_archive(spark, d):
    archive, live = sinks.archive(
        view(spark, d, "vacancy_facts"), F.col("status") == "filled", "created_at", VACANCY_AS_OF, months=6
    )
    both = sets.union_all({"archive": spark.read.parquet(archive).drop("run"), "live": spark.read.parquet(live)})
    return both.groupBy(F.col("label").alias("part"), "status").agg(F.count(F.lit(1)).alias("n"))


# ---- filters and projections ----


@plan("flt_active", f"SELECT vacancy_id, company_id, created_at FROM vacancies WHERE {ACTIVE}")
def flt_active(spark, d):
    return filters.active(view(spark, d, "vacancy_facts")).select("vacancy_id", "company_id", "created_at")


def vacancy_filter(key: str, where: str, **conditions):
    @plan(key, f"SELECT vacancy_id, title, location, salary_min, salary_max FROM vacancies WHERE {ACTIVE} AND {where}")
    def run(spark, d):
        rows = view(spark, d, "vacancies").filter(filters.VacancyFilter(**conditions).predicate())
        return rows.select("vacancy_id", "title", "location", "salary_min", "salary_max")

    return run


vacancy_filter("flt_vac_search", "(contains(lower(title), 'brand#1') OR contains(lower(description), 'brand#1'))", search="BRAND#1")
vacancy_filter("flt_vac_location", "contains(lower(location), 'софия')", location="СОФИЯ")
vacancy_filter("flt_vac_level", "experience_level = 'senior'", level="senior")
vacancy_filter("flt_vac_salary", "salary_min >= 3000 AND salary_max <= 6000", salary_min=3000, salary_max=6000)


@plan(
    "flt_vac_tech",
    f"""SELECT v.vacancy_id, count(DISTINCT t.tech) AS n_hits, count(DISTINCT t.tech) = 2 AS has_all FROM vacancies v
    JOIN vacancy_tech t ON t.vacancy_id = v.vacancy_id AND t.tech IN ('java', 'kafka') WHERE {ACTIVE} GROUP BY 1""",
)
def flt_vac_tech(spark, d):
    wanted = ["java", "kafka"]
    hits = filters.technology_hits(view(spark, d, "vacancy_tech"), wanted)
    return (
        filters.active(view(spark, d, "vacancy_facts"))
        .join(hits, "vacancy_id")
        .select("vacancy_id", F.col("n_hits").cast("bigint").alias("n_hits"), (F.col("n_hits") == len(wanted)).alias("has_all"))
    )


def company_filter(key: str, where: str, **conditions):
    @plan(key, f"SELECT company_id, name, industry, size FROM companies WHERE {where}")
    def run(spark, d):
        rows = view(spark, d, "companies").filter(filters.CompanyFilter(**conditions).predicate())
        return rows.select("company_id", "name", "industry", "size")

    return run


company_filter("flt_com_search", "(contains(lower(name), 'mach') OR contains(lower(description), 'mach'))", search="MACH")
company_filter("flt_com_industry", "contains(lower(industry), 'tech')", industry="tech")
company_filter("flt_com_size", "size = 'startup'", size="startup")

LATEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id
    ORDER BY created_at DESC, analysis_id DESC) AS rn FROM company_analyses {where}) q WHERE rn = 1)"""
LATEST_ANY = LATEST.format(where="")


@plan(
    "flt_com_score_range",
    f"""SELECT c.company_id, a.recommendation_score AS score FROM companies c JOIN {LATEST_ANY} a
    ON a.company_id = c.company_id WHERE a.recommendation_score BETWEEN 4.0 AND 8.0""",
)
def flt_com_score_range(spark, d):
    rows = joins.with_latest_analysis(view(spark, d, "companies"), view(spark, d, "company_analyses"))
    return rows.filter(F.col("recommendation_score").between(4.0, 8.0)).select(
        "company_id", F.col("recommendation_score").alias("score")
    )


@plan("flt_processed", "SELECT vacancy_id, extraction_confidence FROM vacancies WHERE extraction_confidence > 0")
def flt_processed(spark, d):
    return filters.processed(view(spark, d, "vacancy_facts")).select("vacancy_id", "extraction_confidence")


@plan(
    "flt_unexpired",
    "SELECT vacancy_id, expires_at FROM vacancies WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2001-09-01'",
)
def flt_unexpired(spark, d):
    return filters.unexpired(view(spark, d, "vacancy_facts"), VACANCY_AS_OF).select("vacancy_id", "expires_at")


@plan("flt_by_key", "SELECT vacancy_id, title, status FROM vacancies WHERE vacancy_id = 77")
def flt_by_key(spark, d):
    return filters.by_key(view(spark, d, "vacancies"), "vacancy_id", 77).select("vacancy_id", "title", "status")


@plan(
    "prj_company_card",
    """SELECT v.vacancy_id, v.company_id, c.name AS card_name, c.industry AS card_industry, c.size AS card_size,
    c.location AS card_location FROM vacancies v JOIN companies c ON c.company_id = v.company_id""",
)
def prj_company_card(spark, d):
    card = view(spark, d, "companies").select(
        "company_id", F.struct("company_id", "name", "industry", "size", "location").alias("card")
    )
    rows = view(spark, d, "vacancy_facts").select("vacancy_id", "company_id").join(card, "company_id")
    return rows.select(
        "vacancy_id", "company_id", *[F.col(f"card.{c}").alias(f"card_{c}") for c in ("name", "industry", "size", "location")]
    )


@plan(
    "prj_public_analysis",
    """SELECT analysis_id, company_id, recommendation_score, 'java,aws,kafka,react,git,docker' AS technologies,
    'Openness,Craft,Trust,Care' AS "values",
    CASE WHEN pros IS NULL THEN '' ELSE array_to_string(from_json(pros, '["VARCHAR"]'), ',') END AS pros,
    CASE WHEN json_valid(cons) THEN 'Pace,Meetings,Tools' ELSE '' END AS cons FROM company_analyses""",
)
def prj_public_analysis(spark, d):
    rows = entities.public_analysis(view(spark, d, "company_analyses"))
    return rows.select(
        "analysis_id",
        "company_id",
        "recommendation_score",
        *[F.array_join(c, ",").alias(c) for c in ("technologies", "values", "pros", "cons")],
    )


RECOMMEND = """CASE WHEN {s} IS NULL OR {s} = 0 THEN 'No rating' WHEN {s} >= 8.5 THEN 'Highly Recommended'
    WHEN {s} >= 7.5 THEN 'Recommended' WHEN {s} >= 6.5 THEN 'Good Option' WHEN {s} >= 5.5 THEN 'Consider Carefully'
    ELSE 'Proceed with Caution' END"""
AGE = "CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us({t})) / 86400000000.0) AS BIGINT)"


@plan(
    "prj_company_summary",
    f"""SELECT c.company_id, c.name, a.analysis_id IS NOT NULL AS has_analysis, {AGE.format(t='a.created_at')} AS age_days,
    {RECOMMEND.format(s='a.recommendation_score')} AS recommendation, a.recommendation_score AS overall, a.culture_score AS culture,
    a.work_life_balance, a.career_growth, a.tech_culture FROM companies c LEFT JOIN {LATEST_ANY} a ON a.company_id = c.company_id""",
)
def prj_company_summary(spark, d):
    rows = joins.with_latest_analysis(view(spark, d, "companies"), view(spark, d, "company_analyses"))
    return rows.select(
        "company_id",
        "name",
        F.col("analysis_id").isNotNull().alias("has_analysis"),
        days_between("created_at", moment(AS_OF)).alias("age_days"),
        levels.recommendation("recommendation_score").alias("recommendation"),
        F.col("recommendation_score").alias("overall"),
        F.col("culture_score").alias("culture"),
        "work_life_balance",
        "career_growth",
        "tech_culture",
    )


@plan(
    "prj_insights",
    f"""SELECT c.company_id, c.name, coalesce(o.n, 0) AS n_open, {AGE.format(t='a.created_at')} AS age_days,
    a.recommendation_score AS overall, a.confidence_score AS confidence,
    CASE WHEN a.pros IS NULL THEN '' ELSE array_to_string(from_json(a.pros, '["VARCHAR"]')[1:3], ',') END AS top_pros,
    CASE WHEN json_valid(a.cons) THEN 'Pace,Meetings' ELSE '' END AS main_concerns,
    CASE WHEN a.analysis_id IS NULL THEN '' ELSE 'java,aws,kafka,react,git' END AS key_technologies,
    CASE WHEN a.analysis_id IS NULL THEN '' ELSE 'Openness,Craft,Trust' END AS core_values,
    {RECOMMEND.format(s='a.recommendation_score')} AS recommendation
    FROM companies c LEFT JOIN {LATEST_ANY} a ON a.company_id = c.company_id
    LEFT JOIN (SELECT company_id, count(*) AS n FROM vacancies WHERE {ACTIVE} GROUP BY 1) o ON o.company_id = c.company_id""",
)
def prj_insights(spark, d):
    counted = aggregates.open_per_company(view(spark, d, "companies"), view(spark, d, "vacancy_facts"))
    rows = joins.with_latest_analysis(counted, view(spark, d, "company_analyses"))

    def top(name, n):
        return F.array_join(arrays.first_n(jsons.text_array(name), n), ",")

    return rows.select(
        "company_id",
        "name",
        "n_open",
        days_between("created_at", moment(AS_OF)).alias("age_days"),
        F.col("recommendation_score").alias("overall"),
        F.col("confidence_score").alias("confidence"),
        top("pros", 3).alias("top_pros"),
        top("cons", 2).alias("main_concerns"),
        top("tech_stack", 5).alias("key_technologies"),
        top("company_values", 3).alias("core_values"),
        levels.recommendation("recommendation_score").alias("recommendation"),
    )


# ---- joins ----


@plan(
    "jn_vac_company",
    """SELECT v.vacancy_id, v.title, c.name AS company_name, c.industry AS company_industry FROM vacancies v
    JOIN companies c ON c.company_id = v.company_id""",
)
def jn_vac_company(spark, d):
    rows = joins.with_company(view(spark, d, "vacancies"), view(spark, d, "companies"))
    return rows.select("vacancy_id", "title", "company_name", "company_industry")


def job_sources(spark, d):
    """Listing sites with their kind, taken from the scrape runs."""
    return (
        view(spark, d, "scrape_runs")
        .groupBy("source_site")
        .agg(F.count(F.lit(1)).alias("n_runs"))
        .withColumn("source_type", F.when(F.col("source_site") == "site0", "company").otherwise("jobboard"))
    )


@plan(
    "jn_active_view",
    f"""SELECT v.vacancy_id, c.name AS company_name, c.size AS company_size, s.source_site, s.source_type FROM vacancies v
    JOIN companies c ON c.company_id = v.company_id
    JOIN (SELECT DISTINCT source_site, CASE source_site WHEN 'site0' THEN 'company' ELSE 'jobboard' END AS source_type FROM scrape_runs) s
      ON s.source_site = v.source_site
    WHERE {ACTIVE} AND (v.expires_at IS NULL OR v.expires_at > TIMESTAMP '2001-09-01')""",
)
def jn_active_view(spark, d):
    rows = joins.active_view(view(spark, d, "vacancy_facts"), view(spark, d, "companies"), job_sources(spark, d), VACANCY_AS_OF)
    return rows.select("vacancy_id", "company_name", "company_size", "source_site", "source_type")


@plan(
    "jn_vac_detail",
    """SELECT v.vacancy_id, v.title, c.name AS company_name, k.child, k.child_id, k.child_at, k.detail, k.cv_file
    FROM vacancies v JOIN companies c ON c.company_id = v.company_id LEFT JOIN (
      SELECT vacancy_id, 'score' AS child, score_id AS child_id, scored_at AS child_at, CAST(overall_score AS VARCHAR) AS detail, NULL AS cv_file
      FROM vacancy_scores UNION ALL
      SELECT a.vacancy_id, 'application', a.application_id, a.created_at, a.status, cv.filename FROM applications a
      LEFT JOIN cvs cv ON cv.cv_id = a.cv_id) k ON k.vacancy_id = v.vacancy_id""",
)
def jn_vac_detail(spark, d):
    return joins.vacancy_detail(
        *[view(spark, d, n) for n in ("vacancies", "companies", "vacancy_scores", "applications", "cvs")]
    )


@plan(
    "jn_app_cv",
    """SELECT a.application_id, a.status, a.cv_id, c.filename, c.experience FROM applications a
    LEFT JOIN cvs c ON c.cv_id = a.cv_id""",
)
def jn_app_cv(spark, d):
    rows = joins.application_with_cv(view(spark, d, "applications"), view(spark, d, "cvs"))
    return rows.select("application_id", "status", "cv_id", "filename", "experience")


@plan(
    "jn_com_detail",
    f"""SELECT c.company_id, c.name, coalesce(a.n, 0) AS n_analyses, l.recommendation_score AS latest_score,
    coalesce(s.n, 0) AS n_sources, coalesce(v.n, 0) AS n_vacancies, coalesce(v.a, 0) AS n_active, coalesce(t.ids, '') AS newest_active
    FROM companies c LEFT JOIN (SELECT company_id, count(*) AS n FROM company_analyses GROUP BY 1) a ON a.company_id = c.company_id
    LEFT JOIN {LATEST_ANY} l ON l.company_id = c.company_id
    LEFT JOIN (SELECT company_id, count(*) AS n FROM company_sources GROUP BY 1) s ON s.company_id = c.company_id
    LEFT JOIN (SELECT company_id, count(*) AS n, count(*) FILTER (WHERE {ACTIVE}) AS a FROM vacancies GROUP BY 1) v ON v.company_id = c.company_id
    LEFT JOIN (SELECT company_id, string_agg(CAST(vacancy_id AS VARCHAR), ',' ORDER BY rn) AS ids FROM (SELECT company_id, vacancy_id,
      row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, vacancy_id DESC) AS rn FROM vacancies WHERE {ACTIVE}) q
      WHERE rn <= 10 GROUP BY 1) t ON t.company_id = c.company_id""",
)
def jn_com_detail(spark, d):
    rows = joins.company_detail(
        *[view(spark, d, n) for n in ("companies", "company_analyses", "company_sources", "vacancy_facts")]
    )
    return rows.select(
        "company_id", "name", "n_analyses", "latest_score", "n_sources", "n_vacancies", "n_active",
        F.coalesce(F.array_join("newest_active", ","), F.lit("")).alias("newest_active"),
    )


@plan(
    "jn_com_latest",
    f"""SELECT c.company_id, a.analysis_id, a.analysis_source, a.created_at FROM companies c
    LEFT JOIN {LATEST_ANY} a ON a.company_id = c.company_id""",
)
def jn_com_latest(spark, d):
    rows = joins.with_latest_analysis(view(spark, d, "companies"), view(spark, d, "company_analyses"))
    return rows.select("company_id", "analysis_id", "analysis_source", "created_at")


def existence(key: str, join, negate: str, child: str, where: str = "TRUE", condition=None):
    @plan(key, f"SELECT company_id, name FROM companies c WHERE {negate} EXISTS (SELECT 1 FROM {child} k WHERE k.company_id = c.company_id AND {where})")
    def run(spark, d):
        rows = view(spark, d, child)
        if condition is not None:
            rows = rows.filter(condition)
        return join(view(spark, d, "companies"), rows, "company_id").select("company_id", "name")

    return run


existence("jn_semi_analysis", joins.having, "", "company_analyses")
existence("jn_anti_analysis", joins.without, "NOT", "company_analyses")
existence("jn_semi_open", joins.having, "", "vacancy_facts", ACTIVE, ACTIVE)


@plan(
    "jn_semi_site",
    "SELECT count(*) AS n FROM companies c WHERE EXISTS (SELECT 1 FROM vacancies v WHERE v.company_id = c.company_id AND source_site = 'site1')",
)
def jn_semi_site(spark, d):
    of_site = view(spark, d, "vacancy_facts").filter(F.col("source_site") == "site1")
    return joins.having(view(spark, d, "companies"), of_site, "company_id").agg(F.count(F.lit(1)).alias("n"))


PROBES = """(SELECT q.company_id, q.source_site, CASE WHEN q.company_id % 5 = 0 THEN q.source_url || '#new' ELSE q.source_url END AS source_url,
      q.company_id % 11 = 0 AS force FROM (SELECT company_id, source_site, min(source_url) AS source_url FROM company_sources GROUP BY 1, 2
      UNION ALL SELECT company_id, 'dev.bg', website FROM companies) q)"""
STORED = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, source_site ORDER BY last_scraped_at DESC, source_id DESC) AS rn
      FROM company_sources) q WHERE rn = 1)"""


def stored_sources(spark, d):
    """One stored page per (company, site), the newest."""
    return windows.pick_per_key(
        view(spark, d, "company_sources"), ["company_id", "source_site"], ["last_scraped_at", "source_id"]
    )


def scrape_requests(spark, d):
    """The pages to look up: every stored one plus a board profile per company."""
    known = (
        view(spark, d, "company_sources").groupBy("company_id", "source_site").agg(F.min("source_url").alias("source_url"))
    )
    profiles = view(spark, d, "companies").select(
        "company_id", F.lit("dev.bg").alias("source_site"), F.col("website").alias("source_url")
    )
    url = F.when(F.col("company_id") % 5 == 0, F.concat("source_url", F.lit("#new"))).otherwise(F.col("source_url"))
    return known.unionByName(profiles).select(
        "company_id", "source_site", url.alias("source_url"), (F.col("company_id") % 11 == 0).alias("force")
    )


@plan(
    "jn_ttl_lookup",
    f"""SELECT p.company_id, p.source_site, p.source_url, s.source_id AS stored_id, s.source_url AS stored_url, s.last_scraped_at AS stored_at
    FROM {PROBES} p LEFT JOIN {STORED} s ON s.company_id = p.company_id AND s.source_site = p.source_site""",
)
def jn_ttl_lookup(spark, d):
    rows = joins.with_stored_source(scrape_requests(spark, d), stored_sources(spark, d))
    return rows.select("company_id", "source_site", "source_url", "stored_id", "stored_url", "stored_at")


MATCHED = """(SELECT l.*, coalesce(u.id, t.id) AS match_id, CASE WHEN u.id IS NOT NULL THEN 'url' WHEN t.id IS NOT NULL THEN 'title' END AS match_by
    FROM listings l LEFT JOIN (SELECT source_url, min(vacancy_id) AS id FROM vacancies WHERE source_url <> '' GROUP BY 1) u ON u.source_url = l.url
    LEFT JOIN (SELECT title, company_id, min(vacancy_id) AS id FROM vacancies GROUP BY 1, 2) t ON t.title = l.title AND t.company_id = l.company_id)"""


@plan("jn_match_existing", f"SELECT listing_id, match_id, match_by FROM {MATCHED} m")
def jn_match_existing(spark, d):
    rows = joins.match_existing(view(spark, d, "listings"), view(spark, d, "vacancies"))
    return rows.select("listing_id", "match_id", "match_by")


@plan(
    "jn_match_analysis",
    """SELECT r.company_id, r.analysis_source, r.n_new, m.analysis_id FROM
    (SELECT user_id AS company_id, event_type AS analysis_source, count(*) AS n_new FROM events GROUP BY 1, 2) r
    LEFT JOIN (SELECT company_id, analysis_source, max(analysis_id) AS analysis_id FROM company_analyses GROUP BY 1, 2) m
    ON m.company_id = r.company_id AND m.analysis_source = r.analysis_source""",
)
def jn_match_analysis(spark, d):
    incoming = (
        load(spark, d, "events")
        .groupBy(F.col("user_id").alias("company_id"), F.col("event_type").alias("analysis_source"))
        .agg(F.count(F.lit(1)).alias("n_new"))
    )
    keys = ["company_id", "analysis_source"]
    stored = view(spark, d, "company_analyses").groupBy(*keys).agg(F.max("analysis_id").alias("analysis_id"))
    return incoming.join(stored, keys, "left")


@plan(
    "jn_merge_sources",
    """SELECT coalesce(c.company_id, s.cid) AS company_id, coalesce(nullif(c.name, ''), s.nm) AS name,
    coalesce(nullif(c.founded, 0), s.f) AS founded,
    CASE WHEN s.cid IS NULL THEN array_to_string(c.technologies, ',')
      WHEN c.company_id IS NULL THEN 'REACT,Cobol' ELSE array_to_string(c.technologies, ',') ||
        CASE WHEN list_contains(c.technologies, 'React') THEN ',Cobol' ELSE ',REACT,Cobol' END END AS technologies
    FROM (SELECT company_id, CASE WHEN company_id % 3 = 0 THEN '' ELSE name END AS name, founded, technologies FROM scoring_inputs) c
    FULL OUTER JOIN (SELECT s_suppkey * 20 AS cid, s_name AS nm, 1999 AS f FROM supplier) s ON s.cid = c.company_id""",
)
def jn_merge_sources(spark, d):
    structured = view(spark, d, "scoring_inputs").select(
        "company_id", F.when(F.col("company_id") % 3 == 0, "").otherwise(F.col("name")).alias("name"), "founded", "technologies"
    )
    legacy = load(spark, d, "supplier").select(
        (F.col("s_suppkey") * 20).alias("company_id"),
        F.col("s_name").alias("name"),
        F.lit(1999).alias("founded"),
        F.array(F.lit("REACT"), F.lit("Cobol")).alias("technologies"),
    )
    merged = joins.merge_profiles(structured, legacy)
    return merged.withColumn("technologies", F.array_join("technologies", ","))


FIRSTS = """(SELECT *, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS tk, min_by(vacancy_id, {'a': created_at, 'b': vacancy_id})
    OVER (PARTITION BY company_id, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS first_id FROM vacancies WHERE title IS NOT NULL)"""


#: Duplicate pairs of the postings: equal titles, and word sets with four fifths in common.
PAIR_CTES = """k AS (SELECT *, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS tk, {'a': created_at, 'b': vacancy_id} AS age,
      list_sort(list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', title, description)), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS w FROM postings),
    f AS (SELECT *, min_by(vacancy_id, age) OVER (PARTITION BY company_id, tk) AS first_id FROM k WHERE title IS NOT NULL),
    g AS (SELECT company_id, w, min(age) AS age, min_by(vacancy_id, age) AS vacancy_id FROM k WHERE len(w) > 0 GROUP BY company_id, w),
    every AS (SELECT o.vacancy_id AS a, f.vacancy_id AS b, o.w AS wa, f.w AS wb, 'title_match' AS method FROM f JOIN k o ON o.vacancy_id = f.first_id WHERE f.vacancy_id <> f.first_id
      UNION ALL SELECT g.vacancy_id, k.vacancy_id, g.w, k.w, 'similarity' FROM g JOIN k ON k.company_id = g.company_id AND k.w = g.w WHERE k.vacancy_id <> g.vacancy_id
      UNION ALL SELECT x.vacancy_id, y.vacancy_id, x.w, y.w, 'similarity' FROM g x JOIN g y ON x.company_id = y.company_id AND x.age < y.age
        WHERE 180 * len(list_intersect(x.w, y.w)) >= 80 * (len(x.w) + len(y.w))),
    pairs AS (SELECT a AS original_id, b AS duplicate_id, max(method) AS detection_method, any_value(CASE WHEN len(wa) + len(wb) = 0 THEN 100 ELSE
      CAST(floor(len(list_intersect(wa, wb)) * 100 / (len(wa) + len(wb) - len(list_intersect(wa, wb))) + 0.5) AS BIGINT) END) AS similarity FROM every GROUP BY a, b)"""


@plan("jn_dup_pairs", f"WITH {PAIR_CTES} SELECT original_id, duplicate_id, similarity, detection_method FROM pairs")
def jn_dup_pairs(spark, d):
    return joins.duplicate_pairs(view(spark, d, "postings"))


# ---- aggregates ----


@plan("agg_total", f"SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM vacancies WHERE {ACTIVE}")
def agg_total(spark, d):
    return ordering.page_info(filters.active(view(spark, d, "vacancy_facts")), 20)


@plan(
    "agg_open_per_company",
    f"""SELECT c.company_id, count(v.vacancy_id) AS n_open FROM companies c
    LEFT JOIN vacancies v ON v.company_id = c.company_id AND {ACTIVE} GROUP BY 1""",
)
def agg_open_per_company(spark, d):
    return aggregates.open_per_company(view(spark, d, "companies"), view(spark, d, "vacancy_facts")).select("company_id", "n_open")


@plan(
    "agg_all_per_company",
    f"SELECT company_id, count(*) AS n_all, count(*) FILTER (WHERE {ACTIVE}) AS n_active FROM vacancies GROUP BY 1",
)
def agg_all_per_company(spark, d):
    return view(spark, d, "vacancy_facts").groupBy("company_id").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("status") == "active").alias("n_active")
    )


@plan("agg_sources_by_site", "SELECT source_site, count(*) AS n FROM company_sources GROUP BY 1")
def agg_sources_by_site(spark, d):
    return view(spark, d, "company_sources").groupBy("source_site").agg(F.count(F.lit(1)).alias("n"))


SOURCE_STATS = """count(*) AS total, count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE NOT is_valid) AS invalid,
    min(last_scraped_at) AS oldest, max(last_scraped_at) AS newest FROM company_sources"""


@plan("agg_source_stats", f"SELECT source_site, {SOURCE_STATS} GROUP BY 1 UNION ALL SELECT NULL, {SOURCE_STATS}")
def agg_source_stats(spark, d):
    return aggregates.source_stats(view(spark, d, "company_sources"))


@plan(
    "agg_site_stats",
    f"""SELECT source_site, count(*) AS total, count(*) FILTER (WHERE {ACTIVE}) AS active, count(DISTINCT company_id) AS companies,
    max(created_at) AS last_created FROM vacancies GROUP BY 1""",
)
def agg_site_stats(spark, d):
    return aggregates.site_stats(view(spark, d, "vacancy_facts"))


COUNTS = """SELECT 'Companies' AS label, count(*) AS n FROM companies UNION ALL SELECT 'Vacancies', count(*) FROM vacancies
    UNION ALL SELECT 'Processed', count(*) FROM vacancies WHERE extraction_confidence > 0"""


@plan("agg_entity_counts", COUNTS)
def agg_entity_counts(spark, d):
    vacancies = view(spark, d, "vacancy_facts")
    return sets.labelled_counts(
        {"Companies": view(spark, d, "companies"), "Vacancies": vacancies, "Processed": filters.processed(vacancies)}
    )


@plan(
    "agg_extract_stats",
    f"""SELECT {sql_r4('avg(extraction_confidence)')} AS mean_confidence, {sql_r4('avg(quality_score)')} AS mean_quality,
    count(*) AS n, max(created_at) AS last_at FROM vacancies WHERE extraction_confidence > 0""",
)
def agg_extract_stats(spark, d):
    return filters.processed(view(spark, d, "vacancy_facts")).agg(
        r4(F.avg("extraction_confidence")).alias("mean_confidence"),
        r4(F.avg("quality_score")).alias("mean_quality"),
        F.count(F.lit(1)).alias("n"),
        F.max("created_at").alias("last_at"),
    )


TOP10 = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, vacancy_id DESC) AS rn
    FROM vacancies WHERE {ACTIVE}) q WHERE rn <= 10)"""


@plan(
    "agg_salary_range",
    f"""SELECT c.company_id, r.lo AS range_min, r.hi AS range_max, r.cur AS range_currency FROM companies c LEFT JOIN
    (SELECT company_id, min(nullif(salary_min, 0)) AS lo, max(nullif(salary_max, 0)) AS hi, arg_min(currency, rn) AS cur
     FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, vacancy_id DESC) AS rn FROM vacancy_facts WHERE {ACTIVE}) t WHERE coalesce(nullif(salary_min, 0), nullif(salary_max, 0)) IS NOT NULL GROUP BY 1) r ON r.company_id = c.company_id""",
)
def agg_salary_range(spark, d):
    return aggregates.salary_range(view(spark, d, "companies"), view(spark, d, "vacancy_facts"))


@plan(
    "agg_batch_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE NOT failed) AS successful, count(*) FILTER (WHERE failed) AS failed,
    {sql_r4('avg(confidence) FILTER (WHERE NOT failed)')} AS mean_quality, {sql_r4('avg(duration) FILTER (WHERE NOT failed)')} AS mean_millis,
    {sql_r4('count(*) FILTER (WHERE NOT failed AND cache_hit) / count(*) FILTER (WHERE NOT failed)')} AS cache_hit_rate FROM request_logs""",
)
def agg_batch_summary(spark, d):
    results = view(spark, d, "request_logs").select(
        (~F.col("failed")).alias("ok"), F.col("confidence").alias("quality"), F.col("duration").alias("millis"), "cache_hit"
    )
    out = aggregates.batch_summary(results)
    return out.withColumns({c: r4(c) for c in ("mean_quality", "mean_millis", "cache_hit_rate")})


@plan(
    "agg_ingest_summary",
    f"""SELECT m.run_id, count(*) AS found, count(*) FILTER (WHERE title IS NOT NULL AND match_id IS NULL) AS new_vacancies,
    count(*) FILTER (WHERE title IS NOT NULL AND match_id IS NOT NULL) AS updated_vacancies, count(*) FILTER (WHERE title IS NULL) AS errors,
    count(DISTINCT CASE WHEN title IS NOT NULL AND c.known IS NULL THEN m.company_id END) AS new_companies
    FROM {MATCHED} m LEFT JOIN (SELECT DISTINCT company_id, TRUE AS known FROM companies) c ON c.company_id = m.company_id GROUP BY 1""",
)
def agg_ingest_summary(spark, d):
    matched = joins.match_existing(view(spark, d, "listings"), view(spark, d, "vacancies"))
    action = F.when(F.col("title").isNull(), "error").when(F.col("match_id").isNull(), "insert").otherwise("update")
    log = matched.select("run_id", "company_id", action.alias("action"))
    known = view(spark, d, "companies").select("company_id", F.lit(True).alias("known"))
    return aggregates.ingest_summary(windows.split_join(log, known, ["company_id"]))


@plan(
    "agg_apps_weekly",
    "SELECT date_trunc('week', applied_at) AS week, status, count(*) AS n FROM applications WHERE applied_at IS NOT NULL GROUP BY 1, 2",
)
def agg_apps_weekly(spark, d):
    return aggregates.applications_weekly(view(spark, d, "applications")).orderBy(F.desc("week"), "status")


@plan("agg_apps_status", "SELECT status, count(*) AS n FROM applications GROUP BY 1")
def agg_apps_status(spark, d):
    return view(spark, d, "applications").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


TOP_TECH = f"""SELECT tech, count(*) AS n FROM vacancy_tech t WHERE EXISTS (SELECT 1 FROM vacancies v WHERE v.vacancy_id = t.vacancy_id AND {ACTIVE})
    GROUP BY 1 ORDER BY n DESC, tech LIMIT 10"""


@plan("agg_top_tech", TOP_TECH)
def agg_top_tech(spark, d):
    return aggregates.top_technologies(view(spark, d, "vacancy_facts"), view(spark, d, "vacancy_tech"), 10)


@plan("agg_top_companies", "SELECT company_id, count(*) AS n FROM vacancies GROUP BY 1 ORDER BY n DESC, company_id LIMIT 10")
def agg_top_companies(spark, d):
    return aggregates.top_k(view(spark, d, "vacancy_facts"), "company_id", 10)


@plan(
    "agg_salary_trend",
    f"""SELECT date_trunc('month', created_at) AS period, {sql_r4('avg((salary_min + salary_max) / 2)')} AS mean_salary, count(*) AS n
    FROM vacancies WHERE salary_min IS NOT NULL AND salary_max IS NOT NULL GROUP BY 1""",
)
def agg_salary_trend(spark, d):
    return aggregates.salary_trend(view(spark, d, "vacancy_facts")).withColumn("mean_salary", r4("mean_salary"))


@plan(
    "agg_new_week",
    "SELECT count(*) AS n_new FROM vacancies WHERE created_at >= TIMESTAMP '2001-07-25' AND created_at < TIMESTAMP '2001-08-01'",
)
def agg_new_week(spark, d):
    return aggregates.new_since(view(spark, d, "vacancy_facts"), "2001-08-01 00:00:00", 7)


@plan(
    "agg_dashboard",
    f"""SELECT (SELECT count(*) FROM vacancies) AS n_total, (SELECT count(*) FROM vacancies WHERE {ACTIVE}) AS n_active,
    (SELECT count(*) FROM vacancies WHERE created_at >= TIMESTAMP '2001-07-25' AND created_at < TIMESTAMP '2001-08-01') AS n_new,
    (SELECT string_agg(status || '=' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, status) FROM (SELECT status, count(*) AS n FROM applications GROUP BY 1) q) AS by_status,
    (SELECT string_agg(tech || '=' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, tech) FROM ({TOP_TECH}) q) AS top_tech,
    (SELECT string_agg(CAST(company_id AS VARCHAR) || '=' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, company_id) FROM
      (SELECT company_id, count(*) AS n FROM vacancies GROUP BY 1 ORDER BY n DESC, company_id LIMIT 10) q) AS top_companies,
    (SELECT string_agg(strftime(p, '%Y-%m') || '=' || CAST(CAST(m AS BIGINT) AS VARCHAR), ',' ORDER BY p) FROM (SELECT date_trunc('month', created_at) AS p,
      floor(avg((salary_min + salary_max) / 2)) AS m FROM vacancies WHERE salary_min IS NOT NULL AND salary_max IS NOT NULL GROUP BY 1) q) AS salary_trend,
    (SELECT count(*) FROM scrape_runs WHERE status = 'failed') AS failed_runs""",
)
def agg_dashboard(spark, d):
    vacancies, tech = view(spark, d, "vacancy_facts"), view(spark, d, "vacancy_tech")
    counts = vacancies.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.expr(ACTIVE)).alias("n_active"))
    by_status = view(spark, d, "applications").groupBy("status").agg(F.count(F.lit(1)).alias("n"))

    def ranked(rows, key, out):
        """One row: the few result rows as text, most frequent first."""
        items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(key).alias("k"))))
        return rows.agg(F.array_join(F.transform(items, lambda x: F.concat_ws("=", x["k"], -x["o"])), ",").alias(out))

    months = aggregates.salary_trend(vacancies).select("period", F.floor("mean_salary").alias("m"))
    trend = months.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("period", "m"))),
                lambda x: F.concat_ws("=", F.date_format(x["period"], "yyyy-MM"), x["m"]),
            ),
            ",",
        ).alias("salary_trend")
    )
    runs = view(spark, d, "scrape_runs").agg(F.count_if(F.col("status") == "failed").alias("failed_runs"))
    parts = [
        aggregates.new_since(vacancies, "2001-08-01 00:00:00", 7),
        ranked(by_status, "status", "by_status"),
        ranked(aggregates.top_technologies(vacancies, tech, 10), "tech", "top_tech"),
        ranked(aggregates.top_k(vacancies, "company_id", 10), "company_id", "top_companies"),
        trend,
        runs,
    ]
    return sets.one_row([counts, *parts])


@plan(
    "agg_vac_trend",
    """SELECT 'all' AS scope, date_trunc('quarter', created_at) AS period, count(*) AS n FROM vacancies GROUP BY 2 UNION ALL
    SELECT 'kafka', date_trunc('month', created_at), count(*) FROM vacancies v WHERE EXISTS
      (SELECT 1 FROM vacancy_tech t WHERE t.vacancy_id = v.vacancy_id AND t.tech = 'kafka') GROUP BY 2""",
)
def agg_vac_trend(spark, d):
    vacancies = view(spark, d, "vacancy_facts")
    return sets.union_all(
        {
            "all": aggregates.vacancy_trend(vacancies, "quarter"),
            "kafka": aggregates.vacancy_trend(vacancies, "month", view(spark, d, "vacancy_tech"), "kafka"),
        }
    ).withColumnRenamed("label", "scope")


@plan(
    "agg_company_metrics",
    f"""SELECT v.company_id, count(*) AS n_total, count(*) FILTER (WHERE {ACTIVE}) AS n_active,
    {sql_r4('avg((salary_min + salary_max) / 2)')} AS mean_salary, string_agg(DISTINCT work_model, ',' ORDER BY work_model) AS work_models,
    coalesce(any_value(t.top_tech), '') AS top_tech
    FROM vacancies v LEFT JOIN (SELECT company_id, string_agg(tech, ',' ORDER BY rn) AS top_tech FROM (SELECT company_id, tech,
      row_number() OVER (PARTITION BY company_id ORDER BY n DESC, tech) AS rn FROM (SELECT v.company_id, t.tech, count(*) AS n FROM vacancy_tech t
      JOIN vacancies v ON v.vacancy_id = t.vacancy_id GROUP BY 1, 2) q) q WHERE rn <= 5 GROUP BY 1) t ON t.company_id = v.company_id GROUP BY 1""",
)
def agg_company_metrics(spark, d):
    rows = aggregates.company_metrics(view(spark, d, "vacancy_facts"), view(spark, d, "vacancy_tech"))
    return rows.select(
        "company_id", "n_total", "n_active", r4("mean_salary").alias("mean_salary"),
        F.array_join("work_models", ",").alias("work_models"),
        F.coalesce(F.array_join("top_tech", ","), F.lit("")).alias("top_tech"),
    )


@plan(
    "agg_scrape_runs",
    """SELECT source_site, status, count(*) AS n_runs, CAST(sum(vacancies_found) AS BIGINT) AS found, CAST(sum(vacancies_new) AS BIGINT) AS "new",
    CAST(sum(vacancies_updated) AS BIGINT) AS updated, count(*) FILTER (WHERE status = 'failed') AS failures FROM scrape_runs GROUP BY 1, 2""",
)
def agg_scrape_runs(spark, d):
    return aggregates.scrape_runs(view(spark, d, "scrape_runs"))


@plan(
    "agg_usage",
    f"""SELECT count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS tokens, {sql_r4('avg(confidence)')} AS mean_confidence,
    {sql_r4('count(*) FILTER (WHERE cache_hit) / count(*)')} AS cache_hit_rate FROM request_logs""",
)
def agg_usage(spark, d):
    out = aggregates.usage(view(spark, d, "request_logs"))
    return out.withColumns({c: r4(c) for c in ("mean_confidence", "cache_hit_rate")})


# ---- windows ----


@plan("win_latest", f"SELECT company_id, analysis_id, created_at FROM {LATEST_ANY} a")
def win_latest(spark, d):
    return windows.latest_analysis(view(spark, d, "company_analyses")).select("company_id", "analysis_id", "created_at")


@plan(
    "win_latest_metric",
    f"SELECT company_id, analysis_id, recommendation_score FROM {LATEST.format(where='WHERE recommendation_score IS NOT NULL')} a",
)
def win_latest_metric(spark, d):
    rows = windows.latest_analysis(view(spark, d, "company_analyses"), "recommendation_score")
    return rows.select("company_id", "analysis_id", "recommendation_score")


@plan("win_top10_vac", f"SELECT company_id, vacancy_id, rn FROM {TOP10} t")
def win_top10_vac(spark, d):
    rows = windows.newest_n(
        filters.active(view(spark, d, "vacancy_facts")), "company_id", [F.desc("created_at"), F.desc("vacancy_id")], 10
    )
    return rows.select("company_id", "vacancy_id", F.col("rn").cast("bigint").alias("rn"))


@plan(
    "win_score_trend",
    f"""SELECT analysis_id, company_id, previous, floor((s - previous) * 100.0 + 0.5) / 100.0 AS change,
    CASE WHEN s - previous >= 0.5 THEN 'improving' WHEN s - previous <= -0.5 THEN 'declining' WHEN previous IS NOT NULL THEN 'stable' END AS trend
    FROM (SELECT analysis_id, company_id, recommendation_score AS s, lag(recommendation_score) OVER (PARTITION BY company_id
      ORDER BY created_at, analysis_id) AS previous FROM company_analyses WHERE recommendation_score IS NOT NULL) q""",
)
def win_score_trend(spark, d):
    rows = windows.score_trend(view(spark, d, "company_analyses"))
    return rows.select("analysis_id", "company_id", "previous", half_up("change", 2).alias("change"), "trend")


@plan(
    "win_dedup_analysis",
    """SELECT analysis_id, company_id, analysis_source FROM (SELECT *, row_number() OVER (PARTITION BY company_id, analysis_source
    ORDER BY created_at DESC, analysis_id DESC) AS rn FROM company_analyses) q WHERE rn = 1""",
)
def win_dedup_analysis(spark, d):
    rows = windows.pick_per_key(
        view(spark, d, "company_analyses"), ["company_id", "analysis_source"], ["created_at", "analysis_id"]
    )
    return rows.select("analysis_id", "company_id", "analysis_source")


@plan("win_dup_canonical", f"SELECT vacancy_id, CASE WHEN first_id <> vacancy_id THEN first_id END AS duplicate_of FROM {FIRSTS} f")
def win_dup_canonical(spark, d):
    rows = view(spark, d, "vacancies").filter(F.col("title").isNotNull()).withColumn("title_key", joins.title_key("title"))
    marked = windows.canonical_of(rows, ["company_id", "title_key"], ["created_at", "vacancy_id"], "vacancy_id")
    return marked.select("vacancy_id", "duplicate_of")


# ---- order, pages, top-k ----


@plan(
    "srt_vac_field",
    f"SELECT vacancy_id, salary_max FROM vacancies WHERE {ACTIVE} ORDER BY salary_max DESC NULLS FIRST, vacancy_id",
)
def srt_vac_field(spark, d):
    rows = filters.active(view(spark, d, "vacancy_facts"))
    return rows.orderBy(*ordering.by_field("salary_max")).select("vacancy_id", "salary_max")


@plan(
    "srt_vac_scores",
    f"""SELECT v.vacancy_id, coalesce(s.n, 0) AS n_scores, v.created_at FROM vacancies v LEFT JOIN (SELECT vacancy_id, count(*) AS n
    FROM vacancy_scores GROUP BY 1) s ON s.vacancy_id = v.vacancy_id WHERE {ACTIVE}
    ORDER BY n_scores DESC, v.created_at DESC, v.vacancy_id""",
)
def srt_vac_scores(spark, d):
    rows, order = ordering.by_score_count(filters.active(view(spark, d, "vacancy_facts")), view(spark, d, "vacancy_scores"))
    return rows.orderBy(*order).select("vacancy_id", "n_scores", "created_at")


@plan("srt_com_name", "SELECT company_id, name FROM companies ORDER BY name, company_id")
def srt_com_name(spark, d):
    return view(spark, d, "companies").orderBy(F.asc("name"), F.asc("company_id")).select("company_id", "name")


@plan(
    "srt_com_metric",
    f"""SELECT c.company_id, a.work_life_balance FROM companies c LEFT JOIN {LATEST_ANY} a ON a.company_id = c.company_id
    ORDER BY nullif(a.work_life_balance, 0) ASC NULLS LAST, c.company_id""",
)
def srt_com_metric(spark, d):
    rows = joins.with_latest_analysis(view(spark, d, "companies"), view(spark, d, "company_analyses"))
    return rows.orderBy(*ordering.by_metric("workLife", descending=False)).select("company_id", "work_life_balance")


@plan(
    "lim_page",
    f"SELECT vacancy_id, created_at FROM vacancies WHERE {ACTIVE} ORDER BY created_at DESC, vacancy_id LIMIT 20 OFFSET 40",
)
def lim_page(spark, d):
    rows = filters.active(view(spark, d, "vacancy_facts"))
    return ordering.page(rows, ordering.by_field(), 3, 20).select("vacancy_id", "created_at")


@plan(
    "lim_page_company",
    f"""SELECT c.company_id, a.culture_score FROM companies c LEFT JOIN {LATEST_ANY} a ON a.company_id = c.company_id
    ORDER BY nullif(a.culture_score, 0) DESC NULLS LAST, c.company_id LIMIT 20 OFFSET 20""",
)
def lim_page_company(spark, d):
    rows = joins.with_latest_analysis(view(spark, d, "companies"), view(spark, d, "company_analyses"))
    return ordering.page(rows, ordering.by_metric("culture"), 2, 20).select("company_id", "culture_score")


# ---- whole list queries: filters, count, sort and page in one ----

TECH_ANY = "vacancy_id IN (SELECT vacancy_id FROM vacancy_tech WHERE tech IN ('java', 'kafka', 'docker'))"
TECH_ALL = "vacancy_id IN (SELECT vacancy_id FROM vacancy_tech WHERE tech IN ('java', 'kafka') GROUP BY 1 HAVING count(DISTINCT tech) = 2)"
LIST_ANY = listing.VacancyQuery(
    filters.VacancyFilter(search="brand#", location="o", salary_min=1500, salary_max=7000), ("java", "kafka", "docker"),
    sort="salary_max", page=2, size=15,
)
LIST_ALL = listing.VacancyQuery(filters.VacancyFilter(level="senior"), ("java", "kafka"), need_all=True, sort="score", size=25)
WHERE_ANY = f"""{ACTIVE} AND (contains(lower(title), 'brand#') OR contains(lower(description), 'brand#')) AND contains(lower(location), 'o')
    AND salary_min >= 1500 AND salary_max <= 7000 AND {TECH_ANY}"""
WHERE_ALL = f"{ACTIVE} AND experience_level = 'senior' AND {TECH_ALL}"


def vacancy_page(spark, d, query):
    return query.rows(*(view(spark, d, n) for n in ("vacancies", "companies", "vacancy_tech", "vacancy_scores")))


@plan(
    "lst_vac_any",
    f"""SELECT v.vacancy_id, v.salary_max, c.name AS company_name, c.size AS company_size FROM (SELECT * FROM vacancies WHERE {WHERE_ANY}
    ORDER BY salary_max DESC NULLS FIRST, vacancy_id LIMIT 15 OFFSET 15) v JOIN companies c ON c.company_id = v.company_id""",
)
def lst_vac_any(spark, d):
    return vacancy_page(spark, d, LIST_ANY).select("vacancy_id", "salary_max", "company_name", "company_size")


@plan(
    "lst_vac_all",
    f"""SELECT v.vacancy_id, v.n_scores, c.name AS company_name FROM (SELECT vacancy_id, company_id, coalesce(n, 0) AS n_scores FROM vacancies
      LEFT JOIN (SELECT vacancy_id AS scored, count(*) AS n FROM vacancy_scores GROUP BY 1) s ON scored = vacancy_id WHERE {WHERE_ALL}
    ORDER BY n_scores DESC, created_at DESC, vacancy_id LIMIT 25) v JOIN companies c ON c.company_id = v.company_id""",
)
def lst_vac_all(spark, d):
    return vacancy_page(spark, d, LIST_ALL).select("vacancy_id", "n_scores", "company_name")


@plan(
    "lst_vac_info",
    f"""SELECT 'any' AS list, count(*) AS total, CAST(ceil(count(*) / 15.0) AS BIGINT) AS pages FROM vacancies WHERE {WHERE_ANY}
    UNION ALL SELECT 'all', count(*), CAST(ceil(count(*) / 25.0) AS BIGINT) FROM vacancies WHERE {WHERE_ALL}""",
)
def lst_vac_info(spark, d):
    parts = {n: q.info(view(spark, d, "vacancies"), view(spark, d, "vacancy_tech")) for n, q in (("any", LIST_ANY), ("all", LIST_ALL))}
    return sets.union_all(parts).withColumnRenamed("label", "list")


LIST_COM = listing.CompanyQuery(filters.CompanyFilter(search="er", industry="tech"), analysed=True, sort="culture", page=2, size=10)
WHERE_COM = """(contains(lower(name), 'er') OR contains(lower(description), 'er')) AND contains(lower(industry), 'tech')
    AND company_id IN (SELECT company_id FROM company_analyses)"""


@plan(
    "lst_com",
    f"""SELECT q.company_id, q.name, q.culture_score, coalesce(n.n, 0) AS n_open FROM (SELECT c.company_id, c.name, a.culture_score FROM
      (SELECT * FROM companies WHERE {WHERE_COM}) c LEFT JOIN {LATEST_ANY} a ON a.company_id = c.company_id
      ORDER BY nullif(a.culture_score, 0) DESC NULLS LAST, c.company_id LIMIT 10 OFFSET 10) q
    LEFT JOIN (SELECT company_id, count(*) AS n FROM vacancies WHERE {ACTIVE} GROUP BY 1) n ON n.company_id = q.company_id""",
)
def lst_com(spark, d):
    rows = LIST_COM.rows(view(spark, d, "companies"), view(spark, d, "company_analyses"), view(spark, d, "vacancy_facts"))
    return rows.select("company_id", "name", "culture_score", "n_open")


@plan("lst_com_info", f"SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM companies WHERE {WHERE_COM}")
def lst_com_info(spark, d):
    return LIST_COM.info(view(spark, d, "companies"), view(spark, d, "company_analyses"))


WORDS_SQL = "regexp_split_to_array(lower(concat_ws(' ', title, description)), '[^\\p{L}\\p{N}#+]+')"


@plan(
    "flt_vac_words",
    f"""WITH t AS (SELECT vacancy_id, status, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, CASE WHEN vacancy_id % 7 = 0 THEN replace(description, 'SMALL', 'TINY')
      ELSE description END)), '[^\\p{{L}}\\p{{N}}#+]+'), lambda x: x <> '') AS w FROM vacancies),
    n AS (SELECT count(*) AS texts, CAST(sum(len(w)) AS BIGINT) AS words FROM t WHERE len(w) > 0),
    p AS (SELECT vacancy_id, term, len(w) AS n, len(list_filter(w, lambda x: x = term)) AS tf FROM t, (VALUES ('small'), ('brand#2')) q(term) WHERE list_contains(w, term)),
    h AS (SELECT term, count(*) AS held FROM p GROUP BY 1),
    s AS (SELECT vacancy_id, count(*) AS hits, CAST(sum(CAST(floor(1000000 * ln(1 + (texts - held + 0.5) / (held + 0.5)) *
      (tf * (1.2e0 + 1) / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * n / (CAST(words AS DOUBLE) / texts))))) AS BIGINT)) AS BIGINT) AS score FROM p JOIN h USING (term), n GROUP BY 1)
    SELECT vacancy_id, score FROM s JOIN t USING (vacancy_id) WHERE hits = 2 AND {ACTIVE}""",
)
def flt_vac_words(spark, d):
    rows = view(spark, d, "vacancies")
    index = word_index.WordIndex(spark, scratch(spark, "words"), rows.schema["vacancy_id"].dataType, buckets=16)
    text = F.concat_ws(" ", "title", "description")
    index.update(rows.select(F.col("vacancy_id").alias("id"), text.alias("text")), 0)
    changed = rows.filter("vacancy_id % 7 = 0").withColumn("description", F.replace("description", F.lit("SMALL"), F.lit("TINY")))
    index.update(changed.select(F.col("vacancy_id").alias("id"), text.alias("text")), 1)
    found = index.search("Brand#2, SMALL").withColumnRenamed("id", "vacancy_id")
    return found.join(filters.active(view(spark, d, "vacancy_facts")).select("vacancy_id"), "vacancy_id", "left_semi")


@plan("lim_run_cap", "SELECT listing_id, url FROM listings ORDER BY posted_at DESC, listing_id LIMIT 50")
def lim_run_cap(spark, d):
    return ordering.capped(view(spark, d, "listings"), [F.desc("posted_at"), F.asc("listing_id")], 50).select("listing_id", "url")


@plan(
    "top_companies",
    f"""SELECT c.company_id, c.name, c.industry, c.size, coalesce(o.n, 0) AS n_open, a.recommendation_score AS overall,
    {AGE.format(t='a.created_at')} AS age_days, {RECOMMEND.format(s='a.recommendation_score')} AS recommendation
    FROM companies c JOIN {LATEST.format(where='WHERE recommendation_score IS NOT NULL')} a ON a.company_id = c.company_id
    LEFT JOIN (SELECT company_id, count(*) AS n FROM vacancies WHERE {ACTIVE} GROUP BY 1) o ON o.company_id = c.company_id
    ORDER BY a.recommendation_score DESC, c.company_id LIMIT 20""",
)
def top_companies(spark, d):
    rows = ordering.top_companies(
        *[view(spark, d, n) for n in ("companies", "company_analyses", "vacancy_facts")], k=20
    )
    return rows.select(
        "company_id", "name", "industry", "size", "n_open", F.col("recommendation_score").alias("overall"),
        days_between("created_at", moment(AS_OF)).alias("age_days"), "recommendation",
    )


@plan(
    "top_recent_processed",
    """SELECT vacancy_id, title, extraction_confidence, quality_score, created_at FROM vacancies WHERE extraction_confidence > 0
    ORDER BY created_at DESC, vacancy_id LIMIT 10""",
)
def top_recent_processed(spark, d):
    rows = filters.processed(view(spark, d, "vacancies")).orderBy(F.desc("created_at"), "vacancy_id").limit(10)
    return rows.select("vacancy_id", "title", "extraction_confidence", "quality_score", "created_at")


# ---- set operations ----


@plan(
    "set_union_all",
    """SELECT 'company' AS label, CAST(company_id AS BIGINT) AS id, name AS text FROM companies
    UNION ALL SELECT 'vacancy', vacancy_id, title FROM vacancies""",
)
def set_union_all(spark, d):
    return sets.union_all(
        {
            "company": view(spark, d, "companies").select(F.col("company_id").alias("id"), F.col("name").alias("text")),
            "vacancy": view(spark, d, "vacancies").select(F.col("vacancy_id").alias("id"), F.col("title").alias("text")),
        }
    )


@plan(
    "set_distinct_urls",
    "SELECT source_site, min_by(source_url, source_id) AS source_url, min(source_id) AS source_id FROM company_sources GROUP BY 1",
)
def set_distinct_urls(spark, d):
    return sets.first_url_per_target(view(spark, d, "company_sources"), "source_site", "source_url", "source_id")
