"""Streaming jobs over file sources.

Each job takes a streaming DataFrame and runs with ``availableNow``, so the same code
serves a nightly pull and a test. Checkpoints and outputs lie below a ``base`` the caller
gives, in the shared folder: the same base again goes on where the last run stopped.
Batches are bounded by the source's ``maxFilesPerTrigger``. Event time is cast to a
zoned timestamp, because watermarks reject zone-free ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.operators import merge, windows
from jobloom.operators.windows import pick_per_key
from jobloom.session import ensure_checkpoint_dir, scratch
from jobloom.sources.buckets import Buckets, Kept

LATENESS = "1 day"
#: Source files of one micro-batch, unless the caller says otherwise.
FILES_PER_BATCH = 64


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """A parquet folder or glob as a stream, so many files to a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def as_files(df: DataFrame, name: str) -> str:
    """Store rows as source files for a stream."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows below a folder of numbered batches, none where it does not exist yet."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], full)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], base: str, mode: str = "append") -> None:
    """Drive a stream to the end of its input, handing every micro-batch to ``handle``.

    The checkpoint lies in ``base``: a later run with the same base goes on where this one, or
    one that failed, stopped. A batch that is repeated after a failure has the same number, so
    ``handle`` must write by number and overwrite.
    """
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_append(stream: DataFrame, base: str) -> DataFrame:
    """Append a stream to parquet in ``base`` and read all of it back; a later run goes on."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")


def run_latest(stream: DataFrame, keys: list[str], base: str) -> DataFrame:
    """Run an update-mode aggregate and read the last row of every key back; a later run goes on.

    A batch writes to a folder of its own number, so a repeated batch replaces itself.
    """
    spark, path = stream.sparkSession, f"{base}/rows"
    run_batches(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"), base, "update")
    return pick_per_key(stored(spark, path, stream.schema), keys, ["batch"]).select(*stream.columns)


def event_time(name: str) -> Column:
    """A stored zone-free time as the same wall clock in UTC, whatever the session's zone, so windows start alike."""
    return F.from_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone())


def stored_time(name: str) -> Column:
    """An event time back as a zone-free one."""
    return F.to_utc_timestamp(F.col(name), F.current_timezone()).cast("timestamp_ntz")


# ---- jobs ----


def vacancy_tables(start: T.StructType) -> dict[str, Kept]:
    """The vacancies by id, and where a vacancy was ever found by URL or by title and company."""

    def only(*names: str) -> T.StructType:
        return T.StructType([start[n] for n in names])

    by_url, by_title = only("source_url", "vacancy_id"), only("title", "company_id", "vacancy_id")
    rows = T.StructType([*start.fields, T.StructField("action", T.StringType())])
    return {
        "rows": Kept(rows, ("vacancy_id",), ("vacancy_id",)),
        "by_url": Kept(by_url, ("source_url",), ("source_url", "vacancy_id")),
        "by_title": Kept(by_title, ("title", "company_id"), ("title", "company_id", "vacancy_id")),
    }


def commit_vacancies(store: Buckets, rows: DataFrame, version: int) -> None:
    """Writes changed vacancies with their places in the two lists as one batch."""
    rows = rows.checkpoint()
    by_url = rows.filter(F.col("source_url").isNotNull() & (F.trim("source_url") != "")).select("source_url", "vacancy_id")
    store.commit({"rows": rows, "by_url": by_url, "by_title": rows.select("title", "company_id", "vacancy_id")}, version)


def possible_matches(store: Buckets, listings: DataFrame, before: int) -> DataFrame:
    """The stored vacancies that a listing of the batch could be: only the buckets of its keys are read.

    The lists name every vacancy that ever had a URL, or a title and company; which of them still has them
    is left to the match on the rows themselves.
    """
    manifest = store.manifest(before)
    urls = listings.select(F.col("url").alias("source_url")).filter(F.col("source_url").isNotNull()).distinct()
    titles = listings.select("title", "company_id").distinct()
    by_url = store.rows("by_url", store.touched(urls, "by_url"), manifest=manifest).join(urls, "source_url", "left_semi")
    by_title = store.rows("by_title", store.touched(titles, "by_title"), manifest=manifest).join(titles, ["title", "company_id"], "left_semi")
    ids = by_url.select("vacancy_id").unionByName(by_title.select("vacancy_id")).distinct().checkpoint()
    return store.rows("rows", store.touched(ids, "rows"), manifest=manifest).join(ids, "vacancy_id", "left_semi")


def ingest(listings: DataFrame, vacancies: DataFrame, base: str, buckets: int = 64, compact: int = 8) -> DataFrame:
    """Upsert listing batches into vacancies; returns the table as it stands, with the last batch's actions.

    ``vacancies`` has a text ``vacancy_id`` and starts the table at ``base`` on the first run;
    later runs with the same base go on from there. The table lies in buckets: a batch reads the
    vacancies that its URLs, titles and companies lead to, and writes the rows it changes; its
    manifest is its commit. A repeated batch sees the batches before it alone and overwrites its own.
    """
    spark = listings.sparkSession
    ensure_checkpoint_dir(spark)
    columns = ["vacancy_id", *merge.LISTED, "source_url"]

    def conform(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(
            *[F.col(c) if c in have else F.lit(None).cast("int" if c.startswith("salary") else "string").alias(c) for c in columns]
        )

    start = conform(vacancies)

    def store(session: SparkSession) -> Buckets:
        return Buckets(session, f"{base}/table", vacancy_tables(start.schema), buckets, compact)

    if store(spark).newest() is None:
        commit_vacancies(store(spark), start.withColumn("action", F.lit("keep")), -1)

    def handle(batch: DataFrame, number: int) -> None:
        held = store(batch.sparkSession)
        known = possible_matches(held, batch, number).drop("action", "version")
        merged = merge.upsert_vacancies(known, batch)
        changed = merged.filter(F.col("action") != "keep").withColumnRenamed("vacancy_key", "vacancy_id")
        commit_vacancies(held, changed.select(*columns, "action"), number)

    run_batches(listings, handle, base)
    held = store(spark)
    newest = F.col("version") == F.lit(held.newest())
    return held.rows("rows").withColumn("action", F.when(newest, F.col("action")).otherwise("keep")).drop("version")


def enrich(stream: DataFrame, companies: DataFrame) -> DataFrame:
    """Stream-static join of every row with its company."""
    card = companies.select("company_id", F.col("name").alias("company_name"), "industry", "size")
    return stream.join(card, "company_id", "left")


def first_seen(stream: DataFrame, key: str, base: str, buckets: int = 64, compact: int = 8) -> DataFrame:
    """Each key once, over all runs with the same base.

    What was seen is a table in buckets, so no state grows in memory, and a batch is compared with
    the buckets of its own keys alone.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    seen = {"seen": Kept(T.StructType([stream.schema[key]]), (key,), (key,))}

    def store(session: SparkSession) -> Buckets:
        return Buckets(session, f"{base}/seen", seen, buckets, compact)

    def handle(batch: DataFrame, number: int) -> None:
        held = store(batch.sparkSession)
        keys = batch.select(key).distinct().checkpoint()
        known = held.rows("seen", held.touched(keys, "seen"), before=number).select(F.col(key).alias("_known"))
        held.commit({"seen": keys.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")}, number)

    run_batches(stream, handle, base)
    return store(spark).rows("seen").drop("version")


def drop_repeats(stream: DataFrame, keys: list[str], time: str, ttl: str = "24 hours") -> DataFrame:
    """Native duplicate drop: never two rows of a key within ``ttl``; a key may stay blocked for up to twice as long."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


def first_in_slot(rows: DataFrame, passed: DataFrame, key: str, time: str, ident: str, ttl_hours: int) -> DataFrame:
    """The one row of each key of a slot of ``ttl_hours`` that passes, if any: the first that is so much younger than the key's last."""
    last = passed.groupBy(key).agg(F.max(time).alias("_last"))
    ends = F.col("_last") + F.make_dt_interval(F.lit(0), F.lit(ttl_hours))
    free = windows.split_join(rows, last, [key]).filter(F.col("_last").isNull() | (F.col(time) >= ends))
    first = free.groupBy(key).agg(F.min(F.struct(time, ident)).alias("_f"))
    return first.select(key, f"_f.{ident}", f"_f.{time}")


def dedup(stream: DataFrame, key: str, time: str, ident: str, base: str, ttl_hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(passed, late) rows of (key, ident, time) over all runs with the same base.

    A row passes unless a passed row of its key is less than ``ttl_hours`` older. Rows are laid down
    by slots of that length, and the slots taken in order of time: in a slot a key passes at most
    once, so each slot is one minimum per key, which combines on the map side, and the state it
    needs is what passed in the slots around it. No task holds the rows of a key. Within a run
    the cut into micro-batches makes no difference. A row more than ``ttl_hours`` older than the newest
    one of earlier runs is late: it is not judged but kept apart. Rows without a key or time are left
    out. A run that failed is repeated from its first slot.
    """
    spark = stream.sparkSession
    narrow = stream.select(key, ident, time).filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    marks = T.StructType([T.StructField("mark", T.TimestampType()), T.StructField("upto", T.LongType())])
    mark = stored(spark, f"{base}/marks", marks).agg(
        F.max("mark").alias("mark"), F.coalesce(F.max("upto"), F.lit(-1)).alias("upto"), (F.coalesce(F.max("batch"), F.lit(-1)) + 1).alias("run")
    ).first()
    limit = F.lit(mark.mark).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(ttl_hours))
    is_late = F.coalesce(F.col(time) < limit, F.lit(False))
    slot = F.floor(F.unix_micros(time) / (ttl_hours * 3600 * 1_000_000))

    def handle(batch: DataFrame, number: int) -> None:
        batch.filter(is_late).write.mode("overwrite").parquet(f"{base}/late/batch={number}")
        in_time = batch.filter(~is_late).withColumn("slot", slot).hint("rebalance", "slot")
        in_time.write.mode("overwrite").partitionBy("slot").parquet(f"{base}/in_time/batch={number}")

    run_batches(narrow, handle, f"{base}/sorted")
    number = T.StructField("slot", T.LongType())
    new = stored(spark, f"{base}/in_time", T.StructType([*narrow.schema.fields, number])).filter(F.col("batch") > mark.upto)
    for at in sorted(r.slot for r in new.select("slot").distinct().collect()):
        around = stored(spark, f"{base}/passed", T.StructType([*narrow.schema.fields, number]))
        earlier = (F.col("batch") < mark.run) | ((F.col("batch") == mark.run) & (F.col("slot") < at))
        around = around.filter(F.col("slot").between(at - 1, at + 1) & earlier)
        found = first_in_slot(new.filter(F.col("slot") == at), around, key, time, ident, ttl_hours)
        found.write.mode("overwrite").parquet(f"{base}/passed/batch={mark.run}/slot={at}")
    newest = new.agg(F.max(time).alias("mark"), F.coalesce(F.max("batch"), F.lit(mark.upto)).alias("upto"))
    newest.write.mode("overwrite").parquet(f"{base}/marks/batch={mark.run}")
    passed = stored(spark, f"{base}/passed", T.StructType([*narrow.schema.fields, number])).drop("batch", "slot")
    return passed, stored(spark, f"{base}/late", narrow.schema).drop("batch")


def progress(stream: DataFrame, source: str, time: str, facts: list[str]) -> DataFrame:
    """Latest facts per source (update mode)."""
    latest = F.max_by(F.struct(*facts, time), F.struct(time, *facts)).alias("_l")
    return stream.groupBy(source).agg(latest, F.count(F.lit(1)).alias("n_events")).select(source, "_l.*", "n_events")


def weekly_trend(stream: DataFrame, time: str, key: str) -> DataFrame:
    """Rows per 7-day window and key; windows older than the watermark leave the state."""
    windowed = stream.withWatermark(time, LATENESS).groupBy(F.window(time, "7 days"), key)
    return windowed.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("week"), key, "n")


def current_state(stream: DataFrame, key: str, status: str, time: str, tie: str) -> DataFrame:
    """Current status per key from its timeline (update mode)."""
    newest = F.max_by(F.struct(status, time), F.struct(time, tie)).alias("_l")
    return stream.groupBy(key).agg(newest).select(key, f"_l.{status}", f"_l.{time}")


def split(stream: DataFrame, good: Column, error: Column, base: str) -> tuple[DataFrame, DataFrame]:
    """Good rows to one output, the rest with their error to another; a later run with the same base goes on."""
    spark = stream.sparkSession
    marked = stream.withColumn("error", F.when(~F.coalesce(good, F.lit(False)), error))

    def handle(batch: DataFrame, number: int) -> None:
        batch.filter(F.col("error").isNull()).drop("error").write.mode("overwrite").parquet(f"{base}/good/batch={number}")
        batch.filter(F.col("error").isNotNull()).write.mode("overwrite").parquet(f"{base}/bad/batch={number}")

    run_batches(marked, handle, base)
    return stored(spark, f"{base}/good", stream.schema).drop("batch"), stored(spark, f"{base}/bad", marked.schema).drop("batch")
