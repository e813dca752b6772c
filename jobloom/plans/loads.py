"""Queries of the incremental-load group: upserts, change detection, deletes, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.operators import merge, quality, windows
from jobloom.plans.registry import plan
from jobloom.plans.relational import MATCHED, PAIR_CTES, PROBES, STORED, scrape_requests, stored_sources
from jobloom.plans.scalars import CONF, J, VALID
from jobloom.sources import logs
from jobloom.sources.inputs import load, view

CRAWL_AS_OF = "2024-01-18 00:00:00"


@plan(
    "up_company",
    """SELECT CAST(company_id AS VARCHAR) AS company_key, name, industry, FALSE AS is_new FROM companies UNION ALL
    SELECT DISTINCT sha256(s_name), s_name, 'Technology', TRUE FROM supplier""",
)
def up_company(spark, d):
    companies = view(spark, d, "companies")
    none = F.lit(None).cast("string").alias("industry")
    suppliers = load(spark, d, "supplier").select(F.col("s_name").alias("name"), none)
    known = companies.select("name", "industry")
    return merge.find_or_create(companies, suppliers.unionByName(known))


LISTING = f"""(SELECT *, CAST(TRY_CAST(nullif(regexp_extract(salary_range, '(\\d+)', 1), '') AS BIGINT) AS INT) AS lo,
    CAST(coalesce(TRY_CAST(nullif(regexp_extract(salary_range, '\\d+\\D+(\\d+)', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(salary_range, '(\\d+)', 1), '') AS BIGINT)) AS INT) AS hi
    FROM {MATCHED} m WHERE title IS NOT NULL)"""


@plan(
    "up_vacancy",
    f"""WITH l AS (SELECT * FROM {LISTING} q), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY posted_at DESC, listing_id DESC) AS rn
      FROM l WHERE match_id IS NOT NULL) q WHERE rn = 1),
    n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN url <> '' THEN url ELSE 'none ' || CAST(listing_id AS VARCHAR) END ORDER BY posted_at DESC, listing_id DESC) AS r1 FROM l WHERE match_id IS NULL) q WHERE r1 = 1),
    n2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, company_id ORDER BY posted_at DESC, listing_id DESC) AS r2 FROM n1) q WHERE r2 = 1)
    SELECT CAST(v.vacancy_id AS VARCHAR) AS vacancy_key, CASE WHEN u.listing_id IS NULL THEN v.title ELSE u.title END AS title,
      CASE WHEN u.listing_id IS NULL THEN v.company_id ELSE u.company_id END AS company_id, CASE WHEN u.listing_id IS NULL THEN v.salary_min ELSE u.lo END AS salary_min,
      CASE WHEN u.listing_id IS NULL THEN v.salary_max ELSE u.hi END AS salary_max, CASE WHEN u.listing_id IS NULL THEN v.status ELSE 'active' END AS status,
      coalesce(nullif(u.url, ''), v.source_url) AS source_url, CASE WHEN u.listing_id IS NULL THEN 'keep' ELSE 'update' END AS action
    FROM vacancies v LEFT JOIN u ON u.match_id = v.vacancy_id
    UNION ALL SELECT sha256(coalesce(nullif(url, ''), title || chr(10) || CAST(company_id AS VARCHAR))), title, company_id, lo, hi, 'active', url, 'insert' FROM n2""",
)
def up_vacancy(spark, d):
    merged = merge.upsert_vacancies(view(spark, d, "vacancies"), view(spark, d, "listings"))
    return merged.select("vacancy_key", "title", "company_id", "salary_min", "salary_max", "status", "source_url", "action")


CRAWL = """(SELECT CASE WHEN page_id % 2 = 0 THEN page_id % 100 ELSE page_id % 90 + 1000 END AS company_id, regexp_extract(url, '^https?://([^/]+)', 1) AS source_site,
    url || '#2' AS source_url, TS_2 + page_id * INTERVAL '1' HOUR AS last_scraped_at, CASE WHEN page_id % 3 = 0 THEN html || '<p>new</p>' ELSE html END AS scraped_content
    FROM pages)""".replace("TS_2", "TIMESTAMP '2024-02-01 00:00:00'")


def crawl(spark, d):
    even = F.col("page_id") % 2 == 0
    return load(spark, d, "pages").select(
        F.when(even, F.col("page_id") % 100).otherwise(F.col("page_id") % 90 + 1000).alias("company_id"),
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("source_site"),
        F.concat("url", F.lit("#2")).alias("source_url"),
        F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00' + page_id * INTERVAL '1' HOUR").alias("last_scraped_at"),
        F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("<p>new</p>"))).otherwise(F.col("html")).alias("scraped_content"),
        F.lit(None).cast("boolean").alias("is_valid"),
    )


def hashed_sources(spark, d):
    return stored_sources(spark, d).withColumn("content_hash", F.sha2("scraped_content", 256))


@plan(
    "up_source",
    f"""WITH s AS (SELECT * FROM {STORED} q), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, source_site
      ORDER BY last_scraped_at DESC, source_url DESC) AS rn2 FROM {CRAWL} c) q WHERE rn2 = 1)
    SELECT coalesce(n.company_id, s.company_id) AS company_id, coalesce(n.source_site, s.source_site) AS source_site, coalesce(n.source_url, s.source_url) AS source_url,
    coalesce(n.last_scraped_at, s.last_scraped_at) AS last_scraped_at, sha256(coalesce(n.scraped_content, s.scraped_content)) AS content_hash,
    CASE WHEN n.company_id IS NULL THEN s.is_valid ELSE TRUE END AS is_valid,
    CASE WHEN s.company_id IS NULL THEN 'insert' WHEN n.company_id IS NULL THEN 'keep' ELSE 'update' END AS action
    FROM s FULL OUTER JOIN n ON s.company_id = n.company_id AND s.source_site = n.source_site""",
)
def up_source(spark, d):
    merged = merge.upsert_sources(hashed_sources(spark, d), crawl(spark, d))
    return merged.select("company_id", "source_site", "source_url", "last_scraped_at", "content_hash", "is_valid", "action")


@plan(
    "up_analysis",
    """WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, analysis_source ORDER BY created_at, analysis_id) AS rn FROM company_analyses) q WHERE rn = 1),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, analysis_source ORDER BY created_at DESC, analysis_id DESC) AS rn
      FROM (SELECT user_id AS company_id, event_type AS analysis_source, event_id AS analysis_id, ts AS created_at,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 101 / 10.0E0 END AS recommendation_score FROM events) e) q WHERE rn = 1)
    SELECT coalesce(n.company_id, s.company_id) AS company_id, coalesce(n.analysis_source, s.analysis_source) AS analysis_source,
    coalesce(n.recommendation_score, s.recommendation_score) AS recommendation_score, coalesce(n.created_at, s.created_at) AS created_at,
    CASE WHEN s.company_id IS NULL THEN 'insert' WHEN n.company_id IS NULL THEN 'keep' ELSE 'update' END AS action
    FROM s FULL OUTER JOIN n ON n.company_id = s.company_id AND n.analysis_source = s.analysis_source""",
)
def up_analysis(spark, d):
    keys = ["company_id", "analysis_source"]
    stored = windows.pick_per_key(view(spark, d, "company_analyses"), keys, ["created_at", "analysis_id"], newest=False)
    incoming = load(spark, d, "events").select(
        F.col("user_id").alias("company_id"),
        F.col("event_type").alias("analysis_source"),
        F.col("event_id").alias("analysis_id"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 101 / F.lit(10.0)).alias("recommendation_score"),
        F.col("ts").alias("created_at"),
    )
    merged = merge.upsert(stored, incoming, keys, ["created_at", "analysis_id"])
    return merged.select(*keys, "recommendation_score", "created_at", "action")


@plan(
    "up_patch",
    f"""SELECT v.vacancy_id, CASE WHEN r.ok THEN coalesce(r.title, v.title) ELSE v.title END AS title,
    CASE WHEN r.ok THEN coalesce(nullif(r.pay, 0), v.salary_min) ELSE v.salary_min END AS salary_min,
    CASE WHEN r.ok THEN coalesce(nullif(r.conf, 0), v.extraction_confidence) ELSE v.extraction_confidence END AS extraction_confidence,
    CASE WHEN r.ok THEN coalesce(nullif(r.qual, 0), v.quality_score) ELSE v.quality_score END AS quality_score, coalesce(r.ok, FALSE) AS patched
    FROM vacancies v LEFT JOIN (SELECT reply_id, {VALID} AS ok, json_extract_string({J}, '$.title') AS title, CAST({CONF} AS INT) AS conf,
      CAST(json_extract_string({J}, '$.salaryMin') AS INT) AS pay, CAST(json_extract_string({J}, '$.qualityScore') AS INT) AS qual FROM replies) r
    ON r.reply_id = v.vacancy_id""",
)
def up_patch(spark, d):
    replies = view(spark, d, "replies").select(F.col("reply_id").alias("vacancy_id"), "reply")
    rows = merge.patch_vacancies(view(spark, d, "vacancies"), replies)
    return rows.select(
        "vacancy_id", "title", "salary_min", "extraction_confidence", "quality_score", F.col("processing_trace").isNotNull().alias("patched")
    )


@plan(
    "up_enrich",
    """SELECT company_id, CASE WHEN company_id % 3 = 0 THEN 'Fresh ' || CAST(company_id AS VARCHAR) ELSE name END AS name,
    CASE WHEN company_id % 4 = 1 THEN 'Logistics' ELSE industry END AS industry, CASE WHEN company_id % 2 = 1 THEN 42 ELSE employee_count END AS employee_count,
    company_id < 1000000 AS analyzed FROM (SELECT company_id, CASE WHEN company_id % 3 = 0 THEN 'LinkedIn' ELSE name END AS name, industry, employee_count FROM companies) c""",
)
def up_enrich(spark, d):
    key = F.col("company_id")
    companies = view(spark, d, "companies").withColumn("name", F.when(key % 3 == 0, "LinkedIn").otherwise(F.col("name")))
    facts = view(spark, d, "companies").select(
        "company_id",
        F.concat(F.lit("Fresh "), key.cast("string")).alias("name"),
        F.when(key % 4 == 1, "Logistics").otherwise("").alias("industry"),
        F.when(key % 2 == 1, 42).otherwise(0).alias("employee_count"),
    )
    rows = merge.enrich_companies(companies, facts, "2024-02-01 00:00:00")
    return rows.select("company_id", "name", "industry", "employee_count", F.col("last_analyzed_at").isNotNull().alias("analyzed"))


@plan(
    "up_mark_invalid",
    f"""SELECT source_id, CASE WHEN EXISTS (SELECT 1 FROM {PROBES} p WHERE p.force AND p.company_id = s.company_id AND p.source_site = s.source_site)
    THEN FALSE ELSE is_valid END AS is_valid FROM company_sources s""",
)
def up_mark_invalid(spark, d):
    broken = scrape_requests(spark, d).filter("force")
    return merge.mark_invalid(view(spark, d, "company_sources"), broken).select("source_id", "is_valid")


@plan(
    "up_mark_dup",
    f"""WITH {PAIR_CTES}, m AS (SELECT duplicate_id, min(original_id) AS duplicate_of FROM pairs WHERE similarity >= 80 GROUP BY duplicate_id)
    SELECT vacancy_id, CASE WHEN duplicate_of IS NOT NULL THEN 'duplicate' ELSE status END AS status, duplicate_of
    FROM postings LEFT JOIN m ON m.duplicate_id = vacancy_id""",
)
def up_mark_dup(spark, d):
    postings = view(spark, d, "postings")
    return merge.mark_duplicates(postings, quality.sure_duplicates(postings)).select("vacancy_id", "status", "duplicate_of")


HOURS_LEFT = "336 - (epoch_us(TIMESTAMP '2024-01-18') - epoch_us(s.last_scraped_at)) / 3600000000.0"


@plan(
    "cdc_ttl",
    f"""WITH d AS (SELECT p.company_id, p.source_site, CASE WHEN s.source_id IS NULL THEN 'No existing source found' WHEN p.force THEN 'Force flag enabled - bypassing TTL'
    WHEN s.source_url <> p.source_url THEN 'Source URL has changed' WHEN NOT s.is_valid THEN 'Source was marked as invalid'
    WHEN {HOURS_LEFT} < 0 THEN 'TTL expired (336h limit exceeded)' ELSE 'Within TTL window (expires in ' || CAST(CAST(floor({HOURS_LEFT} + 0.5) AS BIGINT) AS VARCHAR) || 'h)' END AS reason
    FROM {PROBES} p LEFT JOIN {STORED} s ON s.company_id = p.company_id AND s.source_site = p.source_site)
    SELECT *, NOT starts_with(reason, 'Within TTL') AS should_scrape FROM d""",
)
def cdc_ttl(spark, d):
    rows = merge.scrape_decision(scrape_requests(spark, d), stored_sources(spark, d), CRAWL_AS_OF)
    return rows.select("company_id", "source_site", "reason", "should_scrape")


@plan(
    "cdc_changed",
    f"""SELECT n.company_id, n.source_site, n.source_url, coalesce(sha256(s.scraped_content) <> sha256(n.scraped_content), TRUE) AS changed
    FROM {CRAWL} n LEFT JOIN {STORED} s ON s.company_id = n.company_id AND s.source_site = n.source_site""",
)
def cdc_changed(spark, d):
    pages = crawl(spark, d).withColumnRenamed("scraped_content", "new_content")
    return merge.changed_content(hashed_sources(spark, d), pages).select("company_id", "source_site", "source_url", "changed")


@plan(
    "cdc_due",
    """SELECT company_id FROM companies c WHERE NOT EXISTS (SELECT 1 FROM company_analyses a WHERE a.company_id = c.company_id
    AND a.created_at > TIMESTAMP '2024-01-29 12:00:00')""",
)
def cdc_due(spark, d):
    due = merge.due_for_analysis(view(spark, d, "companies"), view(spark, d, "company_analyses"), "2024-01-30 12:00:00", 24)
    return due.select("company_id")


@plan(
    "cdc_reuse",
    """SELECT d.doc_id, r.reply_id, r.reply_id IS NOT NULL AS reused FROM (SELECT doc_id, sha256(text) AS h FROM documents) d LEFT JOIN
    (SELECT content_hash, max_by(reply_id, {'a': computed_at, 'b': reply_id}) AS reply_id FROM replies WHERE computed_at > TIMESTAMP '2024-01-20' GROUP BY 1) r ON r.content_hash = d.h""",
)
def cdc_reuse(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    rows = merge.reuse_results(docs, view(spark, d, "replies"), "2024-02-01 00:00:00", hours=24 * 12)
    return rows.select("doc_id", "reply_id", "reused")


@plan(
    "del_stale",
    """SELECT 'kept' AS part, source_id AS value FROM company_sources WHERE is_valid AND last_scraped_at >= TIMESTAMP '2024-01-04'
    UNION ALL SELECT 'removed', count(*) FROM company_sources WHERE NOT is_valid OR last_scraped_at < TIMESTAMP '2024-01-04'""",
)
def del_stale(spark, d):
    kept, removed = merge.drop_stale(view(spark, d, "company_sources"), "2024-01-11 00:00:00", days=7)
    return kept.select(F.lit("kept").alias("part"), F.col("source_id").alias("value")).unionByName(
        removed.select(F.lit("removed").alias("part"), F.col("removed").alias("value"))
    )


@plan(
    "del_log_retention",
    "SELECT CAST(logged_at AS DATE) AS log_date, count(*) AS n FROM request_logs WHERE CAST(logged_at AS DATE) >= DATE '2024-01-18' GROUP BY 1",
)
def del_log_retention(spark, d):
    stored = logs.read_logs(spark, logs.write_logs(view(spark, d, "request_logs")))
    return logs.keep_recent(stored, "2024-02-01", 14).groupBy("log_date").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "del_cascade",
    "SELECT a.application_id, a.vacancy_id FROM applications a WHERE EXISTS (SELECT 1 FROM vacancies v WHERE v.vacancy_id = a.vacancy_id AND status <> 'filled')",
)
def del_cascade(spark, d):
    survivors = view(spark, d, "vacancy_facts").filter(F.col("status") != "filled")
    return merge.cascade(view(spark, d, "applications"), survivors, "vacancy_id").select("application_id", "vacancy_id")


@plan(
    "dq_fix_names",
    """SELECT c.company_id, 'Job board' AS kind, CASE WHEN EXISTS (SELECT 1 FROM vacancies v WHERE v.company_id = c.company_id)
    THEN 'Firm' || CAST(c.company_id AS VARCHAR) END AS new_name FROM companies c WHERE c.size = 'startup'""",
)
def dq_fix_names(spark, d):
    companies = view(spark, d, "companies").withColumn("name", F.when(F.col("size") == "startup", "LinkedIn Jobs").otherwise(F.col("name")))
    fixes = quality.name_fixes(companies, view(spark, d, "vacancy_facts"))
    return fixes.select("company_id", F.lit("Job board").alias("kind"), "new_name")


BROKEN = """SELECT vacancy_id, concat_ws('; ', CASE WHEN salary_min > salary_max - 1000 THEN 'salary_min over salary_max' END,
    CASE WHEN status = 'inactive' THEN 'unknown status' END, CASE WHEN quality_score + 5 > 100 THEN 'quality score out of bounds' END,
    CASE WHEN vacancy_id = company_id * 7 THEN 'duplicate of itself' END, CASE WHEN title IS NULL THEN 'title missing' END) AS broken FROM vacancies"""


@plan(
    "dq_constraints",
    f"""SELECT 'vacancy' AS entity, CAST(vacancy_id AS VARCHAR) AS id, broken FROM ({BROKEN}) q WHERE broken <> '' UNION ALL
    SELECT 'company_analysis', CAST(company_id AS VARCHAR) || '/' || analysis_source, 'repeated key' FROM company_analyses GROUP BY company_id, analysis_source HAVING count(*) > 1""",
)
def dq_constraints(spark, d):
    rows = view(spark, d, "vacancies").withColumns(
        {
            "salary_max": F.col("salary_max") - 1000,
            "status": F.when(F.col("status") == "inactive", "unheard-of").otherwise(F.col("status")),
            "quality_score": F.col("quality_score") + 5,
            "duplicate_of": F.col("company_id") * 7,
        }
    )
    broken = quality.vacancy_violations(rows).select(
        F.lit("vacancy").alias("entity"), F.col("vacancy_id").cast("string").alias("id"), F.array_join("broken", "; ").alias("broken")
    )
    repeated = quality.repeated_keys(view(spark, d, "company_analyses"), ["company_id", "analysis_source"]).select(
        F.lit("company_analysis").alias("entity"), F.concat_ws("/", "company_id", "analysis_source").alias("id"), F.lit("repeated key").alias("broken")
    )
    return quality.stack([broken, repeated])


@plan(
    "dq_refs",
    """SELECT 'application.cv' AS reference, application_id AS child_id, cv_id AS missing FROM applications a WHERE NOT EXISTS (SELECT 1 FROM cvs c WHERE c.cv_id = a.cv_id)
    UNION ALL SELECT 'source.company', source_id, company_id FROM company_sources s WHERE NOT EXISTS (SELECT 1 FROM companies c WHERE c.company_id = s.company_id)
    UNION ALL SELECT 'listing.company', listing_id, company_id FROM listings l WHERE NOT EXISTS (SELECT 1 FROM companies c WHERE c.company_id = l.company_id)""",
)
def dq_refs(spark, d):
    companies = view(spark, d, "companies")
    return quality.stack(
        [
            quality.orphans(view(spark, d, "applications"), view(spark, d, "cvs"), "cv_id", "application_id", "application.cv"),
            quality.orphans(view(spark, d, "company_sources"), companies, "company_id", "source_id", "source.company"),
            quality.orphans(view(spark, d, "listings"), companies, "company_id", "listing_id", "listing.company"),
        ]
    )


@plan(
    "dq_dups",
    f"""WITH RECURSIVE {PAIR_CTES},
    e AS (SELECT original_id AS a, duplicate_id AS b FROM pairs WHERE similarity >= 80), x AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach(n, r) AS (SELECT a, a FROM x UNION SELECT reach.n, x.b FROM reach JOIN x ON x.a = reach.r),
    c AS (SELECT n, min_by(r, {{'a': created_at, 'b': r}}) AS canonical_id FROM reach JOIN postings v ON v.vacancy_id = reach.r GROUP BY 1)
    SELECT n AS vacancy_id, canonical_id, n <> canonical_id AS is_duplicate FROM c""",
)
def dq_dups(spark, d):
    return quality.duplicate_groups(view(spark, d, "postings"))
