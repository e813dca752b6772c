"""Exports, partitioned tables and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.common import moment
from jobloom.session import scratch


def export_csv(df: DataFrame, order: list[Column], path: str | None = None) -> str:
    """CSV part files with a header, in global order (range-partitioned sort, never one task)."""
    path = path or scratch(df.sparkSession, "csv")
    df.orderBy(*order).write.option("header", True).csv(path)
    return path


def write_by_month(df: DataFrame, time: str, path: str | None = None) -> str:
    """Parquet, one folder per month; readers that filter on ``ym`` open only those folders.

    Rebalancing by month gathers a month's rows into few files, and splits a month
    with most of the rows into tasks of the advisory size. Months that are written again are replaced.
    """
    path = path or scratch(df.sparkSession, "by-month")
    by_month = df.withColumn("ym", F.date_format(F.col(time), "yyyy-MM"))
    return replace_parts(by_month, ["ym"], path)


def replace_parts(df: DataFrame, parts: list[str], path: str) -> str:
    """Writes the folders that the rows belong to, whole, and leaves all others: the same write again changes nothing.

    A folder that was there and has no row now stays as it is; to empty one, write it from its own rows.
    """
    dealt = df.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    dealt.partitionBy(*parts).parquet(path)
    return path


def write_days(df: DataFrame, path: str, day: str = "day") -> str:
    """Figures by day, each day's replaced whole."""
    return replace_parts(df, [day], path)


def archive(
    df: DataFrame, expired: Column, time: str, as_of: str, months: int = 6, path: str | None = None, run: str | None = None
) -> tuple[str, str]:
    """Old expired rows to an archive, all others (null times too) to a new live snapshot.

    ``run`` names the run, the day of ``as_of`` if nothing else: its rows replace what the same run wrote
    before, in the archive as in the live table, so that a run that failed anywhere is simply repeated and
    archives no row twice. Both are read at the run's own folders: ``archive`` holds those of all runs,
    and the live folder counts once its ``_SUCCESS`` mark is there.
    """
    base = path or scratch(df.sparkSession, "archive")
    run = run or as_of[:10]
    limit = F.add_months(moment(as_of).cast("date"), -months).cast("timestamp_ntz")
    old = F.coalesce(expired & (F.col(time) < limit), F.lit(False))
    df.filter(old).write.mode("overwrite").parquet(f"{base}/archive/run={run}")
    df.filter(~old).write.mode("overwrite").parquet(f"{base}/live/run={run}")
    return f"{base}/archive", f"{base}/live/run={run}"
