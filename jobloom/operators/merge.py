"""Upserts, change detection and deletes over snapshots.

Plain parquet has no MERGE. An upsert is a join of the stored rows with the newest
incoming row per key, written as a new snapshot; the old snapshot stays readable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import jsons, levels, rules, salaries, urls
from jobloom.functions.common import first_hit, half_up, lookup, micros_between, moment, non_zero, present
from jobloom.operators import joins, windows
from jobloom.session import ensure_checkpoint_dir, scratch


def write_snapshot(df: DataFrame, path: str | None = None) -> str:
    """Write a merged table beside the one it was read from; returns the path."""
    path = path or scratch(df.sparkSession, "snapshot")
    df.write.parquet(path)
    return path


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], keep_null: bool = True) -> DataFrame:
    """Stored rows with the newest incoming row per key laid over them, plus an ``action`` column.

    With ``keep_null`` an incoming null leaves the stored value, else it replaces it. Incoming rows
    with a null key are left out: nothing could find them again, and each run would add them anew.
    Columns that only one side has stay with that side's values.
    """
    for key in keys:
        incoming = incoming.filter(F.col(key).isNotNull())
    newest = windows.pick_per_key(incoming, keys, order)
    s, n = stored.withColumn("_s", F.lit(True)).alias("s"), newest.withColumn("_n", F.lit(True)).alias("n")
    on = None
    for key in keys:
        same = F.col(f"s.{key}") == F.col(f"n.{key}")
        on = same if on is None else on & same
    both = s.join(n, on, "full_outer")
    came = F.col("n._n").isNotNull()

    def value(name: str) -> Column:
        if name in keys:
            return F.coalesce(f"n.{name}", f"s.{name}")
        if name not in newest.columns:
            return F.col(f"s.{name}")
        if name not in stored.columns:
            return F.col(f"n.{name}")
        if keep_null:
            return F.coalesce(f"n.{name}", f"s.{name}")
        return F.when(came, F.col(f"n.{name}")).otherwise(F.col(f"s.{name}"))

    names = [*stored.columns, *[c for c in newest.columns if c not in stored.columns]]
    action = first_hit((F.col("s._s").isNull(), "insert"), (came, "update"), otherwise="keep")
    return both.select(*[value(c).alias(c) for c in names], action.alias("action"))


# ---- companies ----


def find_or_create(companies: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored companies plus one new row per unknown name; a new key is the hash of the name."""
    known = companies.select(
        F.col("company_id").cast("string").alias("company_key"), "name", "industry", F.lit(False).alias("is_new")
    )
    fresh = (
        incoming.filter(present("name").isNotNull())
        .groupBy("name")
        .agg(F.min("industry").alias("industry"))
        .join(companies.select("name"), "name", "left_anti")
        .select(
            F.sha2("name", 256).alias("company_key"),
            "name",
            F.coalesce(present("industry"), F.lit("Technology")).alias("industry"),
            F.lit(True).alias("is_new"),
        )
    )
    return known.unionByName(fresh)


def enrich_companies(companies: DataFrame, facts: DataFrame, as_of: str) -> DataFrame:
    """Extracted facts laid over companies; the name only where ``takes_new_name`` allows it.

    ``facts`` has one row per company_id, with the same column names.
    """
    c, f = companies.alias("c"), facts.withColumn("_f", F.lit(True)).alias("f")
    both = c.join(f, "company_id", "left")
    out = []
    for field in companies.schema.fields:
        name = field.name
        if name == "company_id":
            out.append(F.col(name))
        elif name == "name":
            use = urls.takes_new_name(F.col("c.name"), F.col("f.name"))
            out.append(F.when(use, F.col("f.name")).otherwise(F.col("c.name")).alias(name))
        elif name in facts.columns:
            new = F.col(f"f.{name}")
            new = present(new) if field.dataType.typeName() == "string" else non_zero(new)
            out.append(F.coalesce(new, F.col(f"c.{name}")).alias(name))
        else:
            out.append(F.col(f"c.{name}"))
    stamp = F.when(F.col("f._f").isNotNull(), moment(as_of))
    return both.select(*out, stamp.alias("last_analyzed_at"))


# ---- vacancies ----


def listing_columns(listings: DataFrame) -> DataFrame:
    """A listing as vacancy columns, active, salaries in whole units."""
    return listings.withColumns(
        {
            "salary_min": (salaries.range_min("salary_range") / 100).cast("int"),
            "salary_max": (salaries.range_max("salary_range") / 100).cast("int"),
            "experience_level": levels.experience_from_title("title"),
            "employment_type": levels.employment_from_model("work_model"),
            "status": F.lit("active"),
        }
    )


LISTED = (
    "title", "company_id", "location", "salary_min", "salary_max", "experience_level", "employment_type", "work_model",
    "source_site", "status",
)


def upsert_vacancies(vacancies: DataFrame, listings: DataFrame) -> DataFrame:
    """Listings merged into vacancies: a match is overwritten and reactivated, the rest are inserted.

    Of several listings for one vacancy the newest counts, and new listings are
    one per URL, where they have one, and then one per (title, company). The key
    of a new vacancy is the hash of its URL, or of title and company without one.
    Listings without a title or company are left to the ingest log as errors.
    """
    ensure_checkpoint_dir(listings.sparkSession)
    usable = listings.filter(present("title").isNotNull() & F.col("company_id").isNotNull())
    carried = ["match_id", "listing_id", "url", "posted_at", *LISTED]
    # updates and inserts both come from the match: it is made once and written
    matched = joins.match_existing(listing_columns(usable), vacancies).select(*carried).checkpoint()
    newest = ["posted_at", "listing_id"]
    updates = windows.pick_per_key(
        matched.filter(F.col("match_id").isNotNull()).select(*carried), ["match_id"], newest
    ).withColumnRenamed("match_id", "vacancy_id")
    v, u = vacancies.alias("v"), updates.alias("u")
    hit = F.col("u.listing_id").isNotNull()

    def old_or(name: str) -> Column:
        old = F.col(f"v.{name}") if name in vacancies.columns else F.lit(None)
        return F.when(hit, F.col(f"u.{name}")).otherwise(old).alias(name)

    kept = v.join(u, "vacancy_id", "left").select(
        F.col("vacancy_id").cast("string").alias("vacancy_key"),
        *[old_or(c) for c in LISTED],
        F.coalesce(present("u.url"), F.col("v.source_url")).alias("source_url"),
        first_hit((hit, "update"), otherwise="keep").alias("action"),
    )
    new = matched.filter(F.col("match_id").isNull()).select(*[c for c in carried if c != "match_id"])
    linked, bare = new.filter(present("url").isNotNull()), new.filter(present("url").isNull())
    new = windows.pick_per_key(windows.pick_per_key(linked, ["url"], newest).unionByName(bare), ["title", "company_id"], newest)
    named = F.coalesce(present("url"), F.concat_ws("\n", "title", F.col("company_id").cast("string")))
    added = new.select(
        F.sha2(named, 256).alias("vacancy_key"), *LISTED, F.col("url").alias("source_url"), F.lit("insert").alias("action")
    )
    return kept.unionByName(added)


PATCH = {
    "title": "title", "description": "description", "location": "location", "salary_min": "salaryMin",
    "salary_max": "salaryMax", "currency": "currency", "experience_level": "experienceLevel",
    "work_model": "workModel", "extraction_confidence": "confidenceScore", "quality_score": "qualityScore",
}


def patch_vacancies(vacancies: DataFrame, replies: DataFrame) -> DataFrame:
    """Accepted reply facts laid over vacancies; empty text, 0 and null leave the stored value.

    ``replies`` is one (vacancy_id, reply) per vacancy. The processing trace is kept as JSON.
    """
    typed = replies.select("vacancy_id", F.length("reply").alias("_n"), jsons.reply("reply").alias("_r"))
    joined = vacancies.join(typed.filter(F.col("_r").isNotNull()), "vacancy_id", "left")

    def patched(name: str) -> Column:
        if name not in PATCH:
            return F.col(name)
        new = F.col(f"_r.{PATCH[name]}")
        kind = vacancies.schema[name].dataType
        new = present(new) if kind.typeName() == "string" else non_zero(new.cast(kind))
        return F.coalesce(new, F.col(name)).alias(name)

    trace = jsons.trace(processingSteps=F.array(F.lit("quality-validation")), rawResponseLength=F.col("_n"))
    return joined.select(
        *[patched(c) for c in vacancies.columns], F.when(F.col("_n").isNotNull(), trace).alias("processing_trace")
    )


def mark_duplicates(vacancies: DataFrame, pairs: DataFrame) -> DataFrame:
    """Set (original_id, duplicate_id) duplicates to status ``duplicate`` and store the original."""
    originals = pairs.groupBy(F.col("duplicate_id").alias("vacancy_id")).agg(F.min("original_id").alias("duplicate_of"))
    return vacancies.join(originals, "vacancy_id", "left").withColumn(
        "status", F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise(F.col("status"))
    )


# ---- sources ----


def upsert_sources(stored: DataFrame, crawled: DataFrame) -> DataFrame:
    """Crawled pages over stored sources by (company, site), with a fresh content hash and validity."""
    fresh = crawled.select(
        "company_id",
        "source_site",
        "source_url",
        "last_scraped_at",
        "scraped_content",
        F.sha2("scraped_content", 256).alias("content_hash"),
        F.coalesce("is_valid", F.lit(True)).alias("is_valid"),
    )
    return upsert(stored, fresh, ["company_id", "source_site"], ["last_scraped_at", "source_url"])


def mark_invalid(sources: DataFrame, broken: DataFrame) -> DataFrame:
    """Flag the (company, site) sources named in ``broken`` as invalid."""
    keys = ["company_id", "source_site"]
    hit = broken.select(*keys).distinct().withColumn("_hit", F.lit(True))
    valid = F.when(F.col("_hit").isNotNull(), F.lit(False)).otherwise(F.col("is_valid"))
    return sources.join(hit, keys, "left").withColumn("is_valid", valid).drop("_hit")


def scrape_decision(requests: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """Whether to fetch each requested page, with the reason.

    In order: nothing stored, forced, URL changed, marked invalid, too old, fresh.
    The reasons' texts are fixed values.
    """
    rows = joins.with_stored_source(requests, sources)
    hours = lookup(F.col("source_site"), rules.FRESH_HOURS, F.lit(rules.FRESH_HOURS_OTHER))
    left = hours - micros_between("stored_at", moment(as_of)) / 3_600_000_000.0
    reason = first_hit(
        (F.col("stored_id").isNull(), F.lit("No existing source found")),
        (F.col("force"), F.lit("Force flag enabled - bypassing TTL")),
        (~F.col("stored_url").eqNullSafe(F.col("source_url")), F.lit("Source URL has changed")),
        (~F.col("stored_valid"), F.lit("Source was marked as invalid")),
        (left < 0, F.concat(F.lit("TTL expired ("), hours.cast("string"), F.lit("h limit exceeded)"))),
        otherwise=F.concat(F.lit("Within TTL window (expires in "), half_up(left).cast("string"), F.lit("h)")),
    )
    return rows.withColumn("reason", reason).withColumn("should_scrape", ~F.col("reason").startswith("Within TTL"))


def changed_content(stored: DataFrame, crawled: DataFrame) -> DataFrame:
    """Crawled (company, site) pages with a flag: no stored hash, or another one."""
    old = stored.select("company_id", "source_site", "content_hash")
    rows = crawled.join(old, ["company_id", "source_site"], "left")
    same = F.col("content_hash").isNotNull() & (F.col("content_hash") == F.sha2("new_content", 256))
    return rows.withColumn("changed", ~F.coalesce(same, F.lit(False)))


def due_for_analysis(companies: DataFrame, analyses: DataFrame, as_of: str, hours: int = 24, force: bool = False) -> DataFrame:
    """Companies without an analysis in the last hours."""
    if force:
        return companies
    since = moment(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return joins.without(companies, analyses.filter(F.col("created_at") > since), "company_id")


def reuse_results(documents: DataFrame, results: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Each document with the newest stored result of equal content that has not expired, or null.

    Results are reduced to one per hash first, so copies of one page meet one row.
    """
    since = moment(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
    live = results.filter(F.col("computed_at") > since)
    newest = live.groupBy("content_hash").agg(F.max_by("reply_id", F.struct("computed_at", "reply_id")).alias("reply_id"))
    return windows.split_join(documents, newest, ["content_hash"]).withColumn("reused", F.col("reply_id").isNotNull())


# ---- deletes ----


def drop_stale(sources: DataFrame, as_of: str, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Sources to keep, and the count of those removed (invalid or too old)."""
    limit = moment(as_of) - F.make_dt_interval(F.lit(days))
    stale = F.coalesce(~F.col("is_valid") | (F.col("last_scraped_at") < limit), F.lit(False))
    return sources.filter(~stale), sources.agg(F.count_if(stale).alias("removed"))


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent survives."""
    return children.join(parents.select(key), key, "left_semi")
