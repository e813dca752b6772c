"""Runs of listing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.operators.windows import split_join

#: Page ids that are numbered together; a site's pages are counted in such ranges first.
RANGE = 100_000


def run_pages(pages: DataFrame, site: str, order: str, empty: Column, max_pages: int | None = None) -> DataFrame:
    """The pages of each site in order, up to the first one without listings, or at most ``max_pages`` of them.

    ``order`` is a whole number, unique in a site. Pages are numbered inside ranges of it, and
    the pages of earlier ranges are added from their counts, so a huge site is never sorted whole.
    """
    rows = pages.withColumns({"_empty": F.coalesce(empty, F.lit(False)), "_range": F.floor(F.col(order) / RANGE)})
    stops = rows.filter("_empty").groupBy(site).agg(F.min(order).alias("_stop"))
    kept = split_join(rows, stops, [site]).filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))
    counts = kept.groupBy(site, "_range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(site).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(site, "_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(site, "_range").orderBy(order))
    numbered = split_join(kept.withColumn("_inside", inside), counts, [site, "_range"])
    numbered = numbered.withColumn("page_no", (F.col("_before") + F.col("_inside")).cast("bigint"))
    if max_pages is not None:
        numbered = numbered.filter(F.col("page_no") <= max_pages)
    return numbered.drop("_empty", "_range", "_stop", "_before", "_inside")
