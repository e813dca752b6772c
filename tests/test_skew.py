"""A key with nine tenths of all rows, with broadcasts off: the final plans split it."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from jobloom.operators import components, joins, merge, windows

HOT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.shuffle.partitions": "16",
}
ROWS = 120_000


@pytest.fixture
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in HOT}
    for k, v in HOT.items():
        spark.conf.set(k, v)
    hot = F.col("id") % 10 != 0
    yield spark.range(0, ROWS, 1, 8).select(
        F.col("id").alias("vacancy_id"),
        F.when(hot, 7).otherwise(F.col("id") % 1000).alias("company_id"),
        F.when(hot, "Baker").otherwise(F.concat(F.lit("Job "), F.col("id").cast("string"))).alias("title"),
        F.sha2(F.when(hot, "x").otherwise(F.col("id").cast("string")), 256).alias("content_hash"),
        F.sha2(F.col("id").cast("string"), 256).alias("description"),
        F.timestamp_seconds("id").alias("created_at"),
    )
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def splits(df):
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def canonical(rows):
    return windows.canonical_of(rows, ["company_id", "title"], ["created_at", "vacancy_id"], "vacancy_id").select("vacancy_id", "duplicate_of")


def matched(rows):
    stored = rows.filter("vacancy_id % 50 = 0").withColumn("source_url", F.lit(""))
    return joins.match_existing(rows.withColumn("url", F.lit("")), stored).select("vacancy_id", "match_id")


def reused(rows):
    results = rows.select("content_hash", F.col("vacancy_id").alias("reply_id"), F.lit("2024-01-31 12:00:00").cast("timestamp").alias("computed_at"))
    return merge.reuse_results(rows.select("vacancy_id", "content_hash"), results, "2024-02-01 00:00:00").select("vacancy_id", "reply_id")


def hub(rows):
    """Nine tenths of all links on one node, and copies of the rest."""
    return rows.select(F.col("vacancy_id").alias("a"), F.when(F.col("vacancy_id") % 10 != 0, -1).otherwise(F.col("vacancy_id") - 10).alias("b"))


def large_star(rows):
    return components._large_star(hub(rows))


def small_star(rows):
    # every link leads from the hub, the greatest node, to smaller ones
    return components._small_star(hub(rows).withColumn("b", F.when(F.col("b") < 0, ROWS * 2).otherwise(F.col("b"))))


def same_words(rows):
    return joins.similar_pairs(rows.withColumn("description", F.lit("one and the same")))


@pytest.mark.parametrize("job", [canonical, matched, reused, large_star, small_star, same_words])
def test_hot_key_is_split(skewed, job):
    out = job(skewed)
    assert splits(out)


def test_previous_values_of_a_hot_day_lie_in_many_ranges(spark, skewed):
    rows = skewed.withColumn("created_at", F.timestamp_seconds(F.col("vacancy_id") % 5000))
    ranged = windows.in_ranges(rows, "company_id", "created_at", "vacancy_id")
    largest = ranged.groupBy("company_id", "_range").count().agg(F.max("count")).first()[0]
    assert largest < ROWS / 4
    out = windows.with_previous(rows.select("company_id", "vacancy_id", "created_at"), "company_id", "created_at", "vacancy_id", "vacancy_id", "before")
    order = Window.partitionBy("company_id").orderBy("created_at", "vacancy_id")
    wrong = out.withColumn("want", F.lag("vacancy_id").over(order)).filter(~F.col("before").eqNullSafe(F.col("want")))
    assert wrong.isEmpty() and out.count() == ROWS
