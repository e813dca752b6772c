"""Daily sketches that merge, against the exact figures."""

from pyspark.sql import functions as F

from jobloom.operators import aggregates, scoring
from jobloom.session import scratch
from jobloom.sources import sinks


def vacancies(spark, rows=60_000):
    return spark.range(rows).selectExpr(
        "concat('site', id % 3) AS source_site", "xxhash64(id) % 9000 AS company_id", "if(id % 4 = 0, 'filled', 'active') AS status",
        "timestamp_seconds(1704067200 + id * 60) AS created_at",
    )


def test_site_stats_of_stored_days(spark):
    rows, path = vacancies(spark), scratch(spark, "site-days")
    days = [r[0] for r in rows.select(F.to_date("created_at")).distinct().orderBy(F.to_date("created_at")).collect()]
    for low, high in ((0, 20), (20, 30), (20, len(days))):  # one part written again, with more days
        part = rows.filter(F.to_date("created_at").between(F.lit(days[low]), F.lit(days[high - 1])))
        sinks.write_days(aggregates.site_sketches(part), path)
    got = {r.source_site: r for r in aggregates.site_stats_of(spark.read.parquet(path)).collect()}
    want = {r.source_site: r for r in aggregates.site_stats(rows).collect()}
    assert got.keys() == want.keys()
    for site, exact in want.items():
        assert (got[site].total, got[site].active, got[site].last_created) == (exact.total, exact.active, exact.last_created)
        assert abs(got[site].companies - exact.companies) <= 0.05 * exact.companies


def test_industry_percentiles_of_merged_days(spark):
    rows = spark.range(30_000).select(
        (F.col("id") % 5).cast("string").alias("industry"),
        F.to_date(F.timestamp_seconds(F.col("id") * 400)).alias("day"),
        *[(F.pmod(F.xxhash64("id", F.lit(n)), F.lit(1001)) / 100).alias(f) for n, f in enumerate(scoring.FACTORS)],
    )
    sketches = scoring.industry_sketches(rows, F.col("day"))
    assert sketches.groupBy("industry", "factor").count().agg(F.min("count")).first()[0] > 20
    got = {(r.industry, r.factor): r for r in scoring.industry_benchmark_of(sketches).collect()}
    want = {(r.industry, r.factor): r for r in scoring.industry_benchmark(rows).collect()}
    assert got.keys() == want.keys()
    for key, exact in want.items():
        assert got[key].n == exact.n and abs(got[key]["mean"] - exact["mean"]) < 1e-9
        # scores are even over 0..10, so two hundredths of the ranks are 0.2
        assert all(abs(got[key][p] - exact[p]) <= 0.3 for p in ("p25", "p50", "p75", "p90"))


def test_archive_run_that_failed_is_repeated(spark, monkeypatch):
    rows = vacancies(spark, 2000).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    expired, base = F.col("status") == "filled", scratch(spark, "archive-again")
    from pyspark.sql.readwriter import DataFrameWriter

    written, calls = DataFrameWriter.parquet, []

    def fails(self, path, *args, **kwargs):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost between the two writes")
        return written(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", fails)
    try:
        sinks.archive(rows, expired, "created_at", "2024-07-02 00:00:00", path=base)
    except RuntimeError:
        pass
    monkeypatch.setattr(DataFrameWriter, "parquet", written)
    for _ in range(2):
        archive, live = sinks.archive(rows, expired, "created_at", "2024-07-02 00:00:00", path=base)
        assert spark.read.parquet(archive).count() == rows.filter(expired & (F.col("created_at") < "2024-01-02")).count() > 0
        assert spark.read.parquet(archive).count() + spark.read.parquet(live).count() == 2000
    # the next run archives from the live rows of this one
    archive, live = sinks.archive(spark.read.parquet(live), expired, "created_at", "2024-07-03 00:00:00", path=base)
    assert spark.read.parquet(archive).count() + spark.read.parquet(live).count() == 2000


def test_months_are_replaced_not_repeated(spark):
    rows, path = vacancies(spark, 3000), scratch(spark, "months")
    for part in (rows, rows, rows.filter("source_site = 'site1'")):
        sinks.write_by_month(part, "created_at", path)
        assert spark.read.parquet(path).count() == part.count()
