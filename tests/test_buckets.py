"""Bucketed tables, the word index on them, and ingest: what a batch reads, failures, compaction."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.operators.word_index import UNIT, WordIndex, ranked
from jobloom.session import ensure_checkpoint_dir, scratch
from jobloom.sources.buckets import Buckets, Kept
from jobloom.streaming import streams

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def table(spark, base, compact=3):
    return Buckets(spark, base, {"t": Kept(SCHEMA, ("k",), ("k",))}, count=8, compact=compact)


def pairs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_newest_row_of_a_key_counts(spark):
    store = table(spark, scratch(spark, "buckets"))
    assert store.newest() is None and store.rows("t").count() == 0
    want = {}
    for version in range(9):
        rows = [(k, f"{version}-{k}") for k in range(version * 5, version * 5 + 20)]
        store.commit({"t": pairs(spark, rows)}, version)
        want.update(rows)
        assert {r.k: r.v for r in store.rows("t").collect()} == want
    # full buckets were written whole: none has more folders than allowed
    assert max(len(parts) for parts in store.manifest().values()) <= 3
    assert {r.k: r.v for r in store.rows("t", before=1).collect()} == {k: f"0-{k}" for k in range(20)}
    store.commit({"t": pairs(spark, [])}, 9)
    assert {r.k: r.v for r in store.rows("t").collect()} == want and store.newest() == 9


def test_a_batch_that_fails_before_its_commit_changes_nothing(spark, monkeypatch):
    store = table(spark, scratch(spark, "buckets-fail"))
    store.commit({"t": pairs(spark, [(1, "a"), (2, "b")])}, 0)
    written = Buckets._write

    def fails(self, *args):
        written(self, *args)
        raise RuntimeError("executor lost")

    monkeypatch.setattr(Buckets, "_write", fails)
    with pytest.raises(RuntimeError):
        store.commit({"t": pairs(spark, [(1, "x"), (3, "y")])}, 1)
    monkeypatch.setattr(Buckets, "_write", written)
    assert {r.k: r.v for r in store.rows("t").collect()} == {1: "a", 2: "b"}
    for _ in range(2):  # the repeat, and a repeat after the commit
        store.commit({"t": pairs(spark, [(1, "z")])}, 1)
        assert {r.k: r.v for r in store.rows("t").collect()} == {1: "z", 2: "b"}


def test_only_touched_buckets_are_read(spark):
    store = table(spark, scratch(spark, "buckets-read"))
    store.commit({"t": pairs(spark, [(k, "a") for k in range(400)])}, 0)
    asked = pairs(spark, [(5, None)])
    touched = store.touched(asked, "t")
    assert len(touched) == 1
    files = store.rows("t", touched).inputFiles()
    assert files and all(f"bucket={touched[0]}/" in f for f in files)
    assert len(store.rows("t").inputFiles()) >= 8


# ---- word index ----


def brute_search(texts, asked):
    cut = {i: [w for w in re.split(r"[^a-z0-9#+]+", (t or "").lower()) if w] for i, t in texts.items()}
    cut = {i: w for i, w in cut.items() if w}
    mean = sum(map(len, cut.values())) / len(cut)
    out = {}
    for i, w in cut.items():
        if all(a in w for a in asked):
            score = 0
            for a in asked:
                held = sum(a in other for other in cut.values())
                tf = w.count(a)
                score += math.floor(UNIT * math.log(1 + (len(cut) - held + 0.5) / (held + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))))
            out[i] = score
    return out


def test_index_follows_updates(spark):
    rng = random.Random(6)
    vocabulary = ["java", "c#", "c++", "sql", "go", "rust", "kafka", "spark"]
    index, texts = WordIndex(spark, scratch(spark, "index"), buckets=4, compact=2), {}
    for version in range(4):
        changed = {rng.randrange(60): " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12))) for _ in range(30)}
        changed[100 + version] = None
        index.update(spark.createDataFrame(list(changed.items()) + [(None, "java sql")], "id long, text string"), version)
        texts.update(changed)
        for query in ("Java", "SQL, c#", "c++ c++ kafka", "cobol", "java go rust"):
            asked = sorted(set(re.split("[ ,]+", query.lower())))
            assert {r.id: r.score for r in index.search(query).collect()} == brute_search(texts, asked), query
    assert index.search(" ,").count() == 0
    best = ranked(index.search("java"), 5).collect()
    want = sorted(brute_search(texts, ["java"]).items(), key=lambda x: (-x[1], x[0]))[:5]
    assert [(r.id, r.score, r["rank"]) for r in best] == [(i, s, n + 1) for n, (i, s) in enumerate(want)]


def test_search_reads_the_buckets_of_its_words(spark):
    index = WordIndex(spark, scratch(spark, "index-read"))
    index.update(spark.range(300).selectExpr("id", "concat('common w', id) AS text"), 0)
    store = index.store
    touched = store.touched(spark.createDataFrame([("w7",)], "term string"), "postings")
    files = store.rows("postings", touched).inputFiles()
    assert len(files) * 10 < len(store.rows("postings").inputFiles())
    assert [r.id for r in index.search("w7 COMMON").collect()] == [7]
    # a repeated batch replaces itself
    index.update(spark.range(300).selectExpr("id", "concat('common w', id) AS text"), 0)
    assert index.search("common").count() == 300


# ---- ingest ----


def test_ingest_batch_reads_what_its_listings_lead_to(spark):
    ensure_checkpoint_dir(spark)
    start = spark.range(2000).selectExpr(
        "cast(id as string) AS vacancy_id", "concat('Job ', id) AS title", "id % 50 AS company_id", "concat('u', id) AS source_url", "'filled' AS status"
    )
    columns = ["vacancy_id", *streams.merge.LISTED, "source_url"]
    have = set(start.columns)
    full = start.select(*[F.col(c) if c in have else F.lit(None).cast("int" if c.startswith("salary") else "string").alias(c) for c in columns])
    store = Buckets(spark, scratch(spark, "ingest-read"), streams.vacancy_tables(full.schema), 64)
    streams.commit_vacancies(store, full.withColumn("action", F.lit("keep")), -1)
    listed = spark.createDataFrame([("u7", "New title", 7), ("other", "Job 9", 9), ("none", "None", 1)], "url string, title string, company_id long")
    found = streams.possible_matches(store, listed, 0)
    assert sorted(r.vacancy_id for r in found.collect()) == ["7", "9"]
    assert len(found.inputFiles()) <= 6 < len(store.rows("rows").inputFiles())


def test_moved_urls_are_matched_by_their_rows(spark):
    stored = spark.createDataFrame([("1", "Cook", 1, "u1", "filled")], "vacancy_id string, title string, company_id long, source_url string, status string")
    schema = (
        "listing_id long, title string, company_id long, url string, salary_range string, work_model string, location string, "
        "source_site string, posted_at timestamp_ntz"
    )
    path, base = scratch(spark, "moved"), scratch(spark, "moved-out")
    steps = [("Cook", "u2", {"u2": "update"}), ("Chef", "u1", {"u2": "keep", "u1": "insert"}), ("Chef two", "u2", {"u2": "update", "u1": "keep"})]
    for number, (title, url, want) in enumerate(steps):
        row = (number, title, 1, url, None, "remote", "Ruse", "s", dt.datetime(2024, 1, 1 + number))
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)
        rows = streams.ingest(streams.read_files(spark, path, spark.read.parquet(path).schema), stored, base, buckets=4).collect()
        assert {r.source_url: r.action for r in rows} == want
    assert sorted(r.title for r in rows) == ["Chef", "Chef two"]
