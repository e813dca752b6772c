"""Ball trees, decontamination and the pipeline against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobloom.llm import balltree, decontam, mixing, neardup, quality
from jobloom.llm.common import table, utf8
from jobloom.llm.queries import ORACLES


# ---- top k ----


def brute_top(rows, asks, k):
    out = []
    for q, x in rows:
        if not asks(q):
            continue
        scores = sorted((-int(np.dot(*np_pad(x, y))), i) for i, y in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def np_pad(x, y):
    x, y = (np.floor(256 * np.array(v, float)).astype(np.int64) for v in (x, y))
    n = max(len(x), len(y))
    return np.pad(x, (0, n - len(x))), np.pad(y, (0, n - len(y)))


def test_top_k_with_ties_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(2000 + i, [0.5] * (1 + i % 5)) for i in range(20)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    exact = [(r.vec_id, r.embedding) for r in frame.collect()]
    got = balltree.top_k(frame, F.col("vec_id") % 10 == 0, k=5, shard_rows=100)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(exact, lambda q: q % 10 == 0, 5)


def test_top_k_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (10, None), (20, [nan, 1.0]), (30, [inf, 1.0]), (40, [None, 1.0]), (None, [1.0, 1.0]), (50, [1.0, 0.0]), (50, [2.0, 0.0]), (7, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in balltree.top_k(frame, F.col("vec_id") % 10 == 0).collect())
    assert got == [(0, 1, 50, 65536), (0, 2, 7, 0), (50, 1, 0, 65536), (50, 2, 7, 0)]
    assert balltree.top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_tree_keeps_what_ties_the_bound():
    ids = np.arange(300)
    vectors = np.tile(np.array([[3, 4]]), (300, 1))
    tree = balltree.Tree(ids, vectors)
    found, best = tree.search(np.array([5]), np.array([[1, 1]]), np.array([7]), 3)
    assert found.tolist() == [[0, 1, 2]] and best.tolist() == [[7, 7, 7]]
    found, best = tree.search(np.array([5]), np.array([[1, 1]]), np.array([8]), 3)
    assert (best == balltree.LOWEST).all()


def test_large_components_stay_exact():
    big = 1 << 29
    tree = balltree.Tree(np.arange(3), np.array([[big, 1], [big, 2], [big, 3]]))
    _, best = tree.search(np.array([9]), np.array([[big, 1]]), np.array([balltree.LOWEST]), 2)
    assert best.tolist() == [[big * big + 3, big * big + 2]]


# ---- decontamination ----


def edits(window, text):
    """Least edits of the window against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def compared(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return decontam.plain(raw, np.array([0, len(raw)]))[0].tobytes()


def changed(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abcdefg")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("abcdefg"))
    return "".join(out)


@pytest.fixture(scope="module")
def exam(spark):
    rng = random.Random(1)
    items = [" ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for n in (5, 12, 20, 40, 60)]
    texts = []
    for i, item in enumerate(items):
        for n in (0, 1, 3, 6, 12, 25):
            texts.append((f"Before {i}, " + changed(rng, item, n) + " after.").upper() if n % 2 else f"Before\n{i}: " + changed(rng, item, n) + "; after")
    texts += [" ".join(rng.choice(items[3].split()) for _ in range(80)), items[3][:40], "", "short"]
    return items, texts


def test_leaks_against_full_alignment(spark, exam):
    items, texts = exam
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark).collect()}
    want = set()
    for j, item in enumerate(items):
        ix = decontam.index((item.encode(),))
        for i, text in enumerate(texts):
            for w, size, k in zip(ix["text"], ix["length"], ix["k"]):
                if edits(w[:size].tobytes(), compared(text)) <= k:
                    want.add((i, j))
                    break
    assert got == want and len(want) >= 15
    kept = {r.doc_id for r in decontam.drop_contaminated(docs, benchmark).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in want}


def test_every_80_bytes_of_an_item_are_found(spark):
    rng = random.Random(9)
    item = " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9))) for _ in range(50))
    assert len(compared(item)) == len(item) > 200
    parts = [item[s : s + 80] for s in range(len(item) - 79)]
    texts = [f"xyz{p}zyx" for p in parts] + [f"xyz{p[:60]}zyx{p[61:]}" for p in parts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontam.leaks(docs, benchmark).collect()} == set(range(len(texts)))
    assert decontam.drop_contaminated(docs, benchmark).count() == 0


def test_positions_of_a_leak(spark):
    item = "the quick brown fox jumps over the lazy dog and then runs home to sleep for a very long while indeed"
    docs = spark.createDataFrame([(1, "Ünïcode före: " + item.upper() + ". Ende"), (2, "nothing")], "doc_id long, text string")
    row = decontam.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start, r.stop, r.edits) for r in row] == [(1, 7, 14, 14 + len(item), 0)]


def test_blocks_and_odd_rows(spark, odd_docs, no_docs, exam, monkeypatch):
    items, texts = exam
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([*enumerate(items), (None, items[1]), (9, None), (10, ""), (11, "abc")], "item_id long, text string")
    whole = sorted(map(tuple, decontam.leaks(docs, benchmark).collect()), key=str)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 150)
    assert sorted(map(tuple, decontam.leaks(docs, benchmark).collect()), key=str) == whole
    assert decontam.leaks(odd_docs, benchmark).count() == 0
    kept = decontam.drop_contaminated(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert decontam.leaks(no_docs, benchmark).count() == 0
    assert decontam.leaks(docs, benchmark.limit(0)).count() == 0


def test_null_and_sliced_columns():
    import pyarrow as pa

    data, at = utf8(pa.array(["ab", None, "", "cde"]).slice(1))
    assert data.tobytes() == b"cde" and at.tolist() == [0, 0, 0, 3]
    assert utf8(pa.array([], pa.string()))[1].tolist() == [0]


# ---- pipeline and registered queries ----


def test_pipeline_stages_do_what_their_operators_find(spark, small):
    docs = table(spark, small, "documents")
    columns = docs.columns
    scored = {r.doc_id: r.predicted for r in quality.assess(docs, table(spark, small, "labels")).collect()}
    good = corpus_pipeline.quality_stage(spark, docs, small).checkpoint()
    assert {r.doc_id for r in good.collect()} == {i for i, p in scored.items() if p}
    groups = {r.doc_id: r.component_id for r in neardup.near_duplicates(good).collect()}
    single = corpus_pipeline.dedup_stage(spark, good, small).checkpoint()
    assert {r.doc_id for r in single.collect()} == set(groups.values())
    leaked = {r.doc_id for r in decontam.leaks(single, table(spark, small, "benchmark")).collect()}
    items = [r.text for r in table(spark, small, "benchmark").collect()]
    assert {r.doc_id for r in single.collect() if any(t in r.text for t in items)} <= leaked
    clean = corpus_pipeline.decontamination_stage(spark, single, small).checkpoint()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaked
    masked = corpus_pipeline.secrets_stage(spark, clean, small).checkpoint()
    assert masked.count() == clean.count()
    assert all(d.columns == columns for d in (good, single, clean, masked))
    mixed = corpus_pipeline.mixing_stage(spark, masked, small)
    con = duckdb.connect()
    con.register("masked", masked.select("doc_id", "text", "lang", "source").toPandas())
    want = {r[0]: r[-1] for r in con.execute(mixing.oracle("masked")).fetchall()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == want


def test_pipeline_runs(spark, small):
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "decontamination", "secrets", "mixing"]
    rows = corpus_pipeline.run(spark, small)
    assert rows.columns == [*table(spark, small, "documents").columns, "epoch"]
    assert rows.count() > 0


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, small, key):
    from jobloom.llm.queries import QUERIES

    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small}/{name}.parquet')")
    df = QUERIES[key](spark, small)
    result = con.execute(ORACLES[key])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(result.fetchall())


def test_repetitive_texts_are_searched_in_stretches(monkeypatch):
    rng = random.Random(31)
    item = b"abc" * 300 + bytes(rng.choice(b"abcdefgh ") for _ in range(200)) + b"xy" * 150
    texts = [b"abc" * 700, b"zz " * 50 + b"abc" * 200 + b"q" + b"abc" * 100 + b"xy" * 90, bytes(rng.choice(b"abcdefgh ") for _ in range(900)) + item[850:1050] + b"ac" * 100, b"", b"clean words only"]
    ix = decontam.index((item, b"xyx" * 60))
    data, offsets, _ = decontam.plain(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))

    def summary(every):
        out = {}
        for d, w, s, e, x in zip(*(v.tolist() for v in decontam.regions(data, offsets, ix, every))):
            row = out.setdefault((d, int(ix["item"][w])), [s, e, x, set()])
            row[0], row[1], row[2] = min(row[0], s), max(row[1], e), min(row[2], x)
            row[3].add(w)
        return out

    whole, docs = summary(True), set(decontam.regions(data, offsets, ix, False)[0].tolist())
    monkeypatch.setattr(decontam, "HITS", 3000)
    assert summary(True) == whole and len(whole) >= 3
    assert set(decontam.regions(data, offsets, ix, False)[0].tolist()) == docs == {d for d, _ in whole}


def test_repetitive_texts_take_bounded_memory():
    import tracemalloc

    ix = decontam.index((b"abc" * 7000,))
    text = np.frombuffer(b"q" + b"abc" * 33_000, np.uint8)
    tracemalloc.start()
    assert decontam.regions(text, np.array([0, len(text)]), ix, False)[0].tolist()[:1] == [0]
    # no verbatim window of the item: every stretch is searched
    other = np.frombuffer((b"abc" * 25 + b"!") * 100, np.uint8)
    decontam.regions(other, np.array([0, len(other)]), ix, False)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
