"""Listing pages to stored rows in one plan: listings, companies, vacancies and what to fetch next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions.common import moment, present
from jobloom.operators import merge, page_facts
from jobloom.operators.windows import split_join
from jobloom.session import ensure_checkpoint_dir

#: Cards of one page are numbered below this.
CARDS = 1 << 20


@dataclass(frozen=True)
class IngestedPages:
    """All companies with the new ones, all vacancies with their action, and the decisions for the companies met."""

    listings: DataFrame
    companies: DataFrame
    vacancies: DataFrame
    decisions: DataFrame


def ingest_pages(pages: DataFrame, companies: DataFrame, vacancies: DataFrame, sources: DataFrame, site: str, as_of: str) -> IngestedPages:
    """Takes listing pages (page_id, html) of a site through every step of a pull.

    Each page is parsed once and its listings are written before they are used. ``companies``
    (company_id, name, industry) get one new row per unknown name; each listing then goes to its
    company's key, is matched to a stored vacancy or inserted, and each company met is judged for a fetch
    of its own page by ``sources``. Of stored companies with one name the least key counts. Listings
    without a title or company take no part.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    listed = page_facts.listings(pages.select("page_id", "html"), moment(as_of))
    listed = listed.withColumns({"listing_id": F.col("page_id").cast("bigint") * CARDS + F.col("position"), "source_site": F.lit(site)}).checkpoint()
    named = listed.filter(present("title").isNotNull() & present("company").isNotNull())
    known = merge.find_or_create(companies, named.select(F.col("company").alias("name"), F.lit(None).cast("string").alias("industry")))
    known = known.checkpoint()
    keys = known.groupBy(F.col("name").alias("company")).agg(F.min("company_key").alias("company_id"))
    placed = split_join(named, keys, ["company"], "inner")
    merged = merge.upsert_vacancies(vacancies, placed)
    met = placed.select("company_id", "source_site").distinct()
    # a pull knows no newer address of a company's page than the stored one
    asked = met.join(sources.select("company_id", "source_site", "source_url"), ["company_id", "source_site"], "left").withColumn("force", F.lit(False))
    return IngestedPages(listed, known, merged, merge.scrape_decision(asked, sources, as_of))
