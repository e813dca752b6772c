"""Request logs: one JSON document per request below a folder per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.session import scratch

SCHEMA = (
    "id string, timestamp timestamp_ntz, method string, request struct<model:string>, "
    "response struct<id:string,model:string,usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>, "
    "duration bigint, error struct<message:string>, log_date date"
)


def write_logs(logs: DataFrame) -> str:
    """Store log rows as JSON, one folder per day; returns the path."""
    path = scratch(logs.sparkSession, "logs")
    failed = F.col("failed")
    documents = logs.select(
        F.col("log_id").cast("string").alias("id"),
        F.col("logged_at").alias("timestamp"),
        "method",
        F.struct(F.lit("default").alias("model")).alias("request"),
        F.struct(
            F.col("log_id").cast("string").alias("id"), F.struct(F.col("total_tokens").alias("total_tokens")).alias("usage")
        ).alias("response"),
        "duration",
        F.when(failed, F.struct(F.lit("failed").alias("message"))).alias("error"),
        F.col("logged_at").cast("date").alias("log_date"),
    )
    documents.hint("rebalance", "log_date").write.partitionBy("log_date").json(path)
    return path


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log documents with the declared schema; a filter on log_date reads only those folders."""
    return spark.read.schema(SCHEMA).json(path)


def read_entry(spark: SparkSession, path: str, day: str, log_id: str) -> DataFrame:
    return read_logs(spark, path).filter((F.col("log_date") == F.lit(day).cast("date")) & (F.col("id") == log_id))


def keep_recent(logs: DataFrame, as_of: str, days: int) -> DataFrame:
    """Logs of the last n days; a partition filter, so older folders are not opened."""
    return logs.filter(F.col("log_date") >= F.date_sub(F.lit(as_of).cast("date"), days))
