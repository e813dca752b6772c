"""Streaming queries, each with the batch SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import jsons
from jobloom.plans.registry import plan
from jobloom.plans.scalars import VALID
from jobloom.session import scratch
from jobloom.sources.inputs import load, view
from jobloom.streaming import streams


def event_stream(spark, d):
    """The events table as a file stream, with a zoned event time."""
    schema = load(spark, d, "events").schema
    rows = streams.read_files(spark, f"{d}/events*.parquet", schema)
    return rows.withColumn("ts", streams.event_time("ts"))


def stored_stream(spark, df, name):
    return streams.read_files(spark, streams.as_files(df, name), df.schema)


TEXT_MATCH = """(SELECT l.*, coalesce(u.id, t.id) AS match_id FROM listings l
    LEFT JOIN (SELECT source_url, min(CAST(vacancy_id AS VARCHAR)) AS id FROM vacancies WHERE source_url <> '' GROUP BY 1) u ON u.source_url = l.url
    LEFT JOIN (SELECT title, company_id, min(CAST(vacancy_id AS VARCHAR)) AS id FROM vacancies GROUP BY 1, 2) t ON t.title = l.title AND t.company_id = l.company_id)"""


@plan(
    "st_ingest",
    f"""WITH l AS (SELECT * FROM {TEXT_MATCH} q WHERE title IS NOT NULL), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY posted_at DESC, listing_id DESC) AS rn
      FROM l WHERE match_id IS NOT NULL) q WHERE rn = 1),
    n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN url <> '' THEN url ELSE 'none ' || CAST(listing_id AS VARCHAR) END ORDER BY posted_at DESC, listing_id DESC) AS r1 FROM l WHERE match_id IS NULL) q WHERE r1 = 1),
    n2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, company_id ORDER BY posted_at DESC, listing_id DESC) AS r2 FROM n1) q WHERE r2 = 1)
    SELECT CAST(v.vacancy_id AS VARCHAR) AS vacancy_id, CASE WHEN u.listing_id IS NULL THEN v.title ELSE u.title END AS title,
      CASE WHEN u.listing_id IS NULL THEN v.status ELSE 'active' END AS status, coalesce(nullif(u.url, ''), v.source_url) AS source_url,
      CASE WHEN u.listing_id IS NULL THEN 'keep' ELSE 'update' END AS action
    FROM vacancies v LEFT JOIN u ON u.match_id = CAST(v.vacancy_id AS VARCHAR)
    UNION ALL SELECT sha256(coalesce(nullif(url, ''), title || chr(10) || CAST(company_id AS VARCHAR))), title, 'active', url, 'insert' FROM n2""",
)
def st_ingest(spark, d):
    vacancies = view(spark, d, "vacancies").withColumn("vacancy_id", F.col("vacancy_id").cast("string"))
    rows = streams.ingest(stored_stream(spark, view(spark, d, "listings"), "listings"), vacancies, scratch(spark, "ingest"), buckets=16)
    return rows.select("vacancy_id", "title", "status", "source_url", "action")


@plan(
    "st_enrich",
    "SELECT e.event_id, e.user_id AS company_id, c.name AS company_name, c.industry FROM events e LEFT JOIN companies c ON c.company_id = e.user_id",
)
def st_enrich(spark, d):
    rows = event_stream(spark, d).select("event_id", F.col("user_id").alias("company_id"))
    joined = streams.enrich(rows, view(spark, d, "companies"))
    return streams.run_append(joined.select("event_id", "company_id", "company_name", "industry"), scratch(spark, "enrich"))


HASH_SQL = "sha256(CAST(user_id AS VARCHAR) || event_type)"


@plan(
    "st_dedup_ttl",
    f"""WITH RECURSIVE e AS (SELECT {HASH_SQL} AS hash, event_id, ts FROM events),
    o AS (SELECT *, min({{'t': ts, 'i': event_id}}) OVER (PARTITION BY hash ORDER BY ts RANGE BETWEEN INTERVAL '24' HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM e),
    k AS (SELECT hash, event_id, ts, nxt FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ts, event_id) AS rn FROM o) q WHERE rn = 1
      UNION ALL SELECT o.hash, o.event_id, o.ts, o.nxt FROM k JOIN o ON o.hash = k.hash AND o.event_id = k.nxt.i)
    SELECT hash, event_id, ts FROM k""",
)
def st_dedup_ttl(spark, d):
    rows = event_stream(spark, d).select(
        F.sha2(F.concat(F.col("user_id").cast("string"), "event_type"), 256).alias("hash"), "event_id", "ts"
    )
    kept, _ = streams.dedup(rows, "hash", "ts", "event_id", scratch(spark, "dedup"))
    return kept.select("hash", "event_id", streams.stored_time("ts").alias("ts"))


@plan("st_new", "SELECT DISTINCT url FROM listings")
def st_new(spark, d):
    return streams.first_seen(stored_stream(spark, view(spark, d, "listings"), "listings"), "url", scratch(spark, "new"), buckets=16)


@plan(
    "st_progress",
    """SELECT source_site, arg_max(event_type, {'t': ts, 's': event_type, 'v': value}) AS stage, max(ts) AS ts, count(*) AS n_events
    FROM (SELECT *, 'site' || CAST(user_id % 4 AS VARCHAR) AS source_site FROM events) e GROUP BY 1""",
)
def st_progress(spark, d):
    rows = event_stream(spark, d).select(
        F.concat(F.lit("site"), (F.col("user_id") % 4).cast("string")).alias("source_site"), F.col("event_type").alias("stage"), "ts"
    )
    out = streams.run_latest(streams.progress(rows, "source_site", "ts", ["stage"]), ["source_site"], scratch(spark, "progress"))
    return out.withColumn("ts", streams.stored_time("ts"))


@plan(
    "st_trend",
    """SELECT time_bucket(INTERVAL '7' DAY, v.created_at, TIMESTAMP '1970-01-01') AS week, t.tech, count(*) AS n FROM vacancies v
    JOIN vacancy_tech t ON t.vacancy_id = v.vacancy_id GROUP BY 1, 2""",
)
def st_trend(spark, d):
    facts = view(spark, d, "vacancy_facts").select("vacancy_id", streams.event_time("created_at").alias("created_at"))
    named = stored_stream(spark, facts, "facts").join(view(spark, d, "vacancy_tech"), "vacancy_id")
    out = streams.run_latest(streams.weekly_trend(named, "created_at", "tech"), ["week", "tech"], scratch(spark, "trend"))
    return out.withColumn("week", streams.stored_time("week"))


@plan(
    "st_app_state",
    "SELECT event_id % 1000 AS application_id, arg_max(event_type, {'t': ts, 'i': event_id}) AS status, max(ts) AS ts FROM events GROUP BY 1",
)
def st_app_state(spark, d):
    rows = event_stream(spark, d).select(
        (F.col("event_id") % 1000).alias("application_id"), F.col("event_type").alias("status"), "ts", "event_id"
    )
    out = streams.run_latest(streams.current_state(rows, "application_id", "status", "ts", "event_id"), ["application_id"], scratch(spark, "app-state"))
    return out.withColumn("ts", streams.stored_time("ts"))


@plan("st_split", f"SELECT reply_id, CASE WHEN NOT {VALID} THEN 'Invalid reply' END AS error FROM replies")
def st_split(spark, d):
    rows = stored_stream(spark, view(spark, d, "replies"), "replies")
    good, bad = streams.split(rows, jsons.reply("reply").isNotNull(), F.lit("Invalid reply"), scratch(spark, "split"))
    none = F.lit(None).cast("string").alias("error")
    return good.select("reply_id", none).unionByName(bad.select("reply_id", "error"))
