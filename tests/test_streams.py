"""Streams in several micro-batches against their batch meaning."""

import datetime as dt
import random

from pyspark.sql import functions as F

from jobloom.session import scratch
from jobloom.streaming import streams

START = dt.datetime(2024, 1, 1)


def in_slices(df, name, time, cuts):
    """Source files written one after the other in time order."""
    path = scratch(df.sparkSession, name)
    for low, high in zip(cuts, cuts[1:]):
        part = df.filter((F.col(time) >= F.lit(low)) & (F.col(time) < F.lit(high)))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def test_exact_repeats_over_batches(spark):
    random.seed(4)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", START + dt.timedelta(minutes=random.randrange(60 * 24 * 8))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, t timestamp")
    cuts = [START + dt.timedelta(days=d) for d in (0, 2, 4, 6, 9)]
    stream = streams.read_files(spark, in_slices(df, "repeats", "t", cuts), df.schema, files_per_batch=1)
    passed, late = streams.dedup(stream, "k", "t", "id", scratch(spark, "repeats-out"))
    got = {r.id for r in passed.collect()}
    assert late.count() == 0
    want, last = set(), {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or t >= last[k] + dt.timedelta(hours=24):
            want.add(i)
            last[k] = t
    assert got == want


def chain(rows):
    """The rows that pass, taken in order of time."""
    out, last = set(), {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or t >= last[k] + dt.timedelta(hours=24):
            out.add(i)
            last[k] = t
    return out


def test_runs_with_a_hot_key_and_a_failure(spark, monkeypatch):
    random.seed(9)
    rows = [(i, "hot" if i % 10 else f"k{i % 70}", START + dt.timedelta(minutes=random.randrange(60 * 24 * 6))) for i in range(3000)]
    path, base, schema = scratch(spark, "hot"), scratch(spark, "hot-out"), "id long, k string, t timestamp"
    parts = [[r for r in rows if low <= (r[2] - START).days < high] for low, high in ((0, 2), (2, 3), (3, 6))]

    def run(part):
        if part:
            spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(path)
        stream = streams.read_files(spark, path, spark.read.parquet(path).schema, files_per_batch=2)
        passed, late = streams.dedup(stream, "k", "t", "id", base)
        return {r.id for r in passed.collect()}, late.count()

    assert run(parts[0]) == (chain(parts[0]), 0)
    first = streams.first_in_slot
    calls = []

    def fails(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return first(*args)

    monkeypatch.setattr(streams, "first_in_slot", fails)
    run(parts[1])
    with_failure = parts[2]
    try:
        run(with_failure)
    except RuntimeError:
        monkeypatch.setattr(streams, "first_in_slot", first)
        assert run([]) == (chain(rows), 0)
    else:
        raise AssertionError("the failure did not happen")


def test_native_repeats(spark):
    rows = [(i, f"k{i % 4}", START + dt.timedelta(hours=i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, k string, t timestamp")
    cuts = [START + dt.timedelta(days=d) for d in (0, 1, 2, 3, 5)]
    stream = streams.read_files(spark, in_slices(df, "native", "t", cuts), df.schema, files_per_batch=1)
    kept = streams.run_append(streams.drop_repeats(stream, ["k"], "t"), scratch(spark, "native-out")).collect()
    assert {r.k for r in kept} == {"k0", "k1", "k2", "k3"}
    for key in {r.k for r in kept}:
        times = sorted(r.t for r in kept if r.k == key)
        assert all(b - a >= dt.timedelta(hours=24) for a, b in zip(times, times[1:]))


def test_latest_over_batches(spark):
    rows = [(i, i % 3, f"s{i}", START + dt.timedelta(hours=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k long, s string, t timestamp")
    cuts = [START, START + dt.timedelta(hours=20), START + dt.timedelta(hours=40), START + dt.timedelta(hours=80)]
    stream = streams.read_files(spark, in_slices(df, "latest", "t", cuts), df.schema, files_per_batch=1)
    out = streams.run_latest(streams.current_state(stream, "k", "s", "t", "id"), ["k"], scratch(spark, "latest-out")).collect()
    assert {r.k: r.s for r in out} == {0: "s57", 1: "s58", 2: "s59"}


def test_ingest_over_batches(spark):
    stored = spark.createDataFrame(
        [("1", "Java Dev", 1, "u1", "filled"), ("2", "QA", 1, "u2", "active")],
        "vacancy_id string, title string, company_id long, source_url string, status string",
    )
    listed = [
        (1, "Java Dev", 1, "u1", "1000-2000 BGN", START), (2, "New Job", 2, "u9", None, START),
        (3, "New Job", 2, "u9", "500 BGN", START + dt.timedelta(days=2)), (4, None, 2, "u8", None, START + dt.timedelta(days=2)),
    ]
    df = spark.createDataFrame(
        [(i, t, c, u, s, "remote", "Sofia", "site", at) for i, t, c, u, s, at in listed],
        "listing_id long, title string, company_id long, url string, salary_range string, work_model string, location string, "
        "source_site string, posted_at timestamp_ntz",
    )
    cuts = [START, START + dt.timedelta(days=1), START + dt.timedelta(days=3)]
    stream = streams.read_files(spark, in_slices(df, "ingest", "posted_at", cuts), df.schema, files_per_batch=1)
    rows = streams.ingest(stream, stored, scratch(spark, "ingest-out")).collect()
    got = {r.source_url: (r.title, r.status, r.salary_min, r.action) for r in rows}
    assert got == {
        "u1": ("Java Dev", "active", 1000, "keep"),
        "u2": ("QA", "active", None, "keep"),
        "u9": ("New Job", "active", 500, "update"),
    }


def day(n, hour=0):
    return START + dt.timedelta(days=n, hours=hour)


def add(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_order_of_batches_in_a_run_makes_no_difference(spark):
    rows = [(1, "a", day(9)), (2, "a", day(4)), (3, "a", day(8, 12)), (4, "b", day(1)), (5, "b", day(1, 5))]
    results = []
    for slices in ([rows], [rows[:1], rows[1:2], rows[2:]], [rows[3:], rows[2:3], rows[:2]]):
        path = scratch(spark, "order")
        for part in slices:
            add(spark.createDataFrame(part, "id long, k string, t timestamp"), path)
        stream = streams.read_files(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
        passed, late = streams.dedup(stream, "k", "t", "id", scratch(spark, "order-out"))
        results.append(({r.id for r in passed.collect()}, {r.id for r in late.collect()}))
    assert results == [({2, 3, 4}, set())] * 3


def test_late_rows_of_a_later_run_are_kept_apart(spark):
    path, base, schema = scratch(spark, "late"), scratch(spark, "late-out"), "id long, k string, t timestamp"

    def run(rows):
        add(spark.createDataFrame(rows, schema), path)
        stream = streams.read_files(spark, path, spark.read.parquet(path).schema)
        passed, late = streams.dedup(stream, "k", "t", "id", base)
        return {r.id for r in passed.collect()}, {r.id for r in late.collect()}

    assert run([(1, "a", day(9))]) == ({1}, set())
    assert run([(2, "a", day(4)), (3, "b", day(8, 6)), (4, "a", day(9, 3)), (5, "a", day(11))]) == ({1, 3, 5}, {2})
    assert run([(6, "c", day(3))]) == ({1, 3, 5}, {2, 6})


def test_runs_go_on_where_the_last_one_stopped(spark):
    path, schema = scratch(spark, "runs"), "id long, k string, t timestamp"
    bases = [scratch(spark, f"runs-{i}") for i in range(4)]
    seen = []

    def run(rows):
        add(spark.createDataFrame(rows, schema), path)
        stream = streams.read_files(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
        appended = streams.run_append(stream.select("id"), bases[0])
        latest = streams.run_latest(streams.current_state(stream, "k", "id", "t", "id"), ["k"], bases[1])
        new = streams.first_seen(stream, "k", bases[2])
        good, bad = streams.split(stream, F.col("id") % 2 == 0, F.lit("odd"), bases[3])
        seen.append([sorted(r[0] for r in x.collect()) for x in (appended, latest, new, good.select("id"), bad.select("id"))])

    run([(1, "a", day(1)), (2, "b", day(1))])
    run([(3, "a", day(2)), (4, "c", day(0))])
    assert seen == [[[1, 2], ["a", "b"], ["a", "b"], [2], [1]], [[1, 2, 3, 4], ["a", "b", "c"], ["a", "b", "c"], [2, 4], [1, 3]]]


def test_ingest_goes_on(spark):
    stored = spark.createDataFrame([("1", "Cook", 1, "u1", "filled")], "vacancy_id string, title string, company_id long, source_url string, status string")
    schema = (
        "listing_id long, title string, company_id long, url string, salary_range string, work_model string, location string, "
        "source_site string, posted_at timestamp_ntz"
    )
    path, base = scratch(spark, "goes"), scratch(spark, "goes-out")
    for number, (title, url, want) in enumerate(
        [("Cook", "u1", {"u1": "update"}), ("Diver", "u2", {"u1": "keep", "u2": "insert"}), ("Diver", "", {"u1": "keep", "u2": "update"})]
    ):
        add(spark.createDataFrame([(number, title, 1 if title == "Cook" else 2, url, None, "remote", "Ruse", "s", day(number))], schema), path)
        rows = streams.ingest(streams.read_files(spark, path, spark.read.parquet(path).schema), stored, base).collect()
        assert {r.source_url: r.action for r in rows} == want
