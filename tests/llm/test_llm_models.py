"""Language, class bigrams, quality and toxicity: brute force, held-out accuracy, odd rows."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import brown, language, quality, toxicity
from jobloom.llm.common import table
from jobloom.llm.queries import QUERIES as LLM_QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIDDLE = "/root/testdata/sf0.01"


# ---- language ----


def test_codewords():
    for n in (2, 3, 4, 6, 7, 20):
        code = language.codewords(n)
        assert len({tuple(row) for row in code.tolist()}) == n
        assert not (np.abs(code.sum(axis=0)) == n).any()
    assert language.codewords(1).shape[0] == 1


def test_language_held_out(spark, small):
    docs = table(spark, small, "documents")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, odd_docs, no_docs):
    rows = language.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r.doc_id: r for r in rows}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].ambiguous for i in (2, 3, 7, 8))
    assert got[4].lang_pred in ("en", "de", "fr")
    assert language.identify(no_docs).count() == 0
    unlabelled = language.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


# ---- class bigrams ----


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in WORD.findall(low)]


def brute_scores(rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter()
    for i, t in rows:
        if not held[i]:
            counts.update([*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    base = {i: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*tokens(t), None]) for i, t in rows}
    known = {i: sum(counts[w] > 0 for w in [*tokens(t), None]) for i, t in rows}
    return held, counts, n, v, base, known


def test_base_and_class_scores(spark, small, monkeypatch):
    # a small head, few types: all paths are taken on little data
    monkeypatch.setattr(brown, "HEAD", 60)
    monkeypatch.setattr(brown, "OWN", 20)
    monkeypatch.setattr(brown, "SUFFIXES", 15)
    monkeypatch.setattr(brown, "CLASSES", 6)
    seen = {}
    train = brown.train

    def spy(*args):
        seen["model"] = train(*args)
        return seen["model"]

    monkeypatch.setattr(brown, "train", spy)
    docs = table(spark, small, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    held, counts, n, v, base, known = brute_scores(rows)
    got = {r.doc_id: r for r in brown.score_texts(docs).collect()}
    model = seen["model"]

    def kind(word):
        return 0 if word is None else model.own.get(word, model.suffixes.get(brown.suffix_of(word), model.n_types - 1))

    words_of_kind = Counter(kind(w) for w in counts)
    tokens_of_kind = Counter()
    for w, c in counts.items():
        tokens_of_kind[kind(w)] += c
    for i, t in rows:
        total, before = 0.0, 0
        for w in [*tokens(t), None]:
            k = kind(w)
            inner = 1.0 if k <= len(model.own) else (counts[w] + 1) / (tokens_of_kind[k] + words_of_kind[k] + 1)
            emit = model.emit[k] * (1.0 if k <= len(model.own) else tokens_of_kind[k] + words_of_kind[k] + 1)
            c = model.classes[k]
            total += math.log10((1 - brown.MIX) * (counts[w] + 1) / (n + v + 1) + brown.MIX * model.change[before, c] * emit * inner)
            before = c
        r = got[i]
        assert r.held_out == held[i] and r.train_tokens == n and r.n_known == known[i] and r.n_tokens == len(tokens(t)) + 1
        assert r.base_score == pytest.approx(base[i], abs=1e-6) and r.score == pytest.approx(total, abs=1e-6)
        assert r.perplexity == pytest.approx(10 ** (-total / r.n_tokens))


def test_class_model_is_a_distribution(spark, small):
    docs = table(spark, small, "documents").select("text")
    counts = brown.token_counts(docs)
    model = brown.train(docs, counts, brown.head_limit(counts, 100))
    assert np.allclose(model.change.sum(axis=1), 1)
    share = model.emit.copy()
    by_suffix = Counter()
    for r in counts.collect():
        if bytes(r.token) not in model.own:
            by_suffix[model.suffixes.get(brown.suffix_of(bytes(r.token)), model.n_types - 1)] += r.c + 1
    for k in range(1 + len(model.own), model.n_types):
        share[k] *= by_suffix[k] + 1
    for c in range(int(model.classes.max()) + 1):
        assert share[model.classes == c].sum() == pytest.approx(1)


def test_score_beats_the_base(spark):
    rows = brown.score_texts(table(spark, MIDDLE, "documents")).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 9, (40, 40))
    pairs[:20, 20:] += 30
    pairs[20:, :20] += 30

    def likelihood(member):
        one = np.eye(member.max() + 1)[member]
        table_ = one.T @ pairs @ one
        return brown.xlogx(table_.astype(float)).sum() - brown.xlogx(table_.sum(0).astype(float)).sum() - brown.xlogx(table_.sum(1).astype(float)).sum()

    start = np.concatenate([[0], 1 + np.arange(39) % 2])
    got = brown.exchange(pairs, classes=3)
    assert likelihood(got) >= likelihood(start)
    assert (got[1:] != 0).all() and got[0] == 0


def test_brown_odd_rows(spark, odd_docs, no_docs):
    rows = brown.score_texts(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r.doc_id: r for r in rows}
    assert got[2].n_tokens == got[3].n_tokens == got[8].n_tokens == 1
    assert got[4].n_tokens == 30_002
    assert brown.score_texts(no_docs).count() == 0
    only_held = odd_docs.filter("doc_id = 3")
    assert zlib.crc32(b"3") % 7 != 2 or brown.score_texts(only_held).first().score == 0


def gain_of(cells, cls, start, around):
    """Likelihood gain when a word with these neighbours goes from ``start`` to ``cls``."""

    def x(v):
        return v * math.log(v) if v > 1 else 0.0

    sign, half = -1 if cls == start else 1, len(cells) // 2
    gain = sum(x(cells[row, cls] + sign * n) - x(cells[row, cls]) for row, n in around.items())
    c = sum(around.values()) // 2
    for total in (cells[:half, cls].sum(), cells[half:, cls].sum()):
        gain -= x(total + sign * c) - x(total)
    return sign * gain


def test_every_word_has_the_class_that_gains_most(spark, small, monkeypatch):
    # few types, and rows and batches so small that a word's rows go over many of them
    for name, value in {"HEAD": 60, "OWN": 20, "SUFFIXES": 15, "CLASSES": 6, "TOKENS": 500, "READ": 1000, "PARTS": 3, "ROUNDS": 1}.items():
        monkeypatch.setattr(brown, name, value)
    bounded = brown.bounded_batches
    monkeypatch.setattr(brown, "bounded_batches", lambda s: bounded(s) or s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7"))
    seen = {}

    def spy(name):
        real = getattr(brown, name)

        def kept(*args):
            seen[name] = real(*args)
            return seen[name]

        monkeypatch.setattr(brown, name, kept)

    spy("train"), spy("word_classes")
    docs = table(spark, small, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    held, counts, n, v, base, known = brute_scores(rows)
    got = {r.doc_id: r for r in brown.class_scores(docs.repartition(5)).collect()}
    model = seen["train"]
    chosen = {bytes(r.token): (r.c, r["class"]) for r in seen["word_classes"].collect()}

    def kind(word):
        return 0 if word is None else model.own.get(word, model.suffixes.get(brown.suffix_of(word), model.n_types - 1))

    size, around = len(model.between), {}
    for i, t in rows:
        if not held[i]:
            line = [None, *tokens(t), None]
            for a, w, b in zip(line, line[1:], line[2:]):
                around.setdefault(w, Counter()).update([model.classes[kind(a)], size + model.classes[kind(b)]])
    # every counted word, and no other, is there with its whole count
    assert {w: c for w, (c, _) in chosen.items()} == {w: c for w, c in counts.items() if w is not None and w not in model.own}
    parts = {bytes(r.token): r.part for r in seen["word_classes"].select("token", F.expr("pmod(xxhash64(token), 3)").alias("part")).collect()}
    cells, moved = np.concatenate([model.between, model.between.T]), 0
    for part in range(3):
        change = np.zeros_like(cells)
        for w, (_, cls) in chosen.items():
            if parts[w] == part:
                start = model.classes[kind(w)]
                gains = [gain_of(cells, k, start, around[w]) for k in range(1, size)]
                assert cls > 0 and gains[cls - 1] >= max(gains) - 1e-6
                moved += cls != start
                for row, times in around[w].items():
                    change[row, cls] += times
                    change[row, start] -= times
        cells += change
    assert moved > len(chosen) / 4

    def class_of(word):
        return chosen[word][1] if word in chosen else int(model.classes[kind(word)])

    share, pairs = Counter(), Counter()
    for w, c in counts.items():
        share[class_of(w)] += c + 1
    for i, t in rows:
        if not held[i]:
            line = [0, *[class_of(w) for w in [*tokens(t), None]]]
            pairs.update(zip(line, line[1:]))
    into, out = ([sum(c for p, c in pairs.items() if p[side] == k) for k in range(size)] for side in (1, 0))
    prior = [(c + 1) / (sum(into) + size) for c in into]
    change = [[(pairs[a, b] + 10 * prior[b]) / (out[a] + 10) for b in range(size)] for a in range(size)]

    def of_word(k):
        return 1 / (share[k] + (k > 0))

    for row in change:
        # all known words of all classes, and one unknown word in each but the end's
        assert sum(p * (share[k] + (k > 0)) * of_word(k) for k, p in enumerate(row)) == pytest.approx(1)
    for i, t in rows:
        total, last = 0.0, 0
        for w in [*tokens(t), None]:
            k, c = class_of(w), counts[w]
            total += math.log10((1 - brown.MIX) * (c + 1) / (n + v + 1) + brown.MIX * change[last][k] * (c + 1) * of_word(k))
            last = k
        r = got[i]
        assert r.held_out == held[i] and r.train_tokens == n and r.n_known == known[i] and r.n_tokens == len(tokens(t)) + 1
        assert r.base_score == pytest.approx(base[i], abs=1e-6) and r.score == pytest.approx(total, abs=1e-6)
        assert r.perplexity == pytest.approx(10 ** (-total / r.n_tokens))


def test_words_of_one_ending_are_told_apart(spark, tmp_path, monkeypatch):
    """``nuxyz`` follows a and ``vexyz`` follows b, equally often: as one type they would have equal scores anywhere."""
    monkeypatch.setattr(brown, "OWN", 2)
    texts = ["a nuxyz b vexyz"] * 60 + ["b vexyz a nuxyz"] * 60 + ["a", "b"] * 60
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    others = (i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows = [*zip(others, texts), *zip(held, ["a nuxyz", "a vexyz"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in LLM_QUERIES["op3_brown"](spark, str(tmp_path)).collect()}
    right, wrong = (got[i] for i in held)
    assert right.base_score == pytest.approx(wrong.base_score)
    assert right.score > wrong.score + 0.3


def test_types_where_all_words_are_equally_frequent(spark, monkeypatch):
    """More such words than the head may hold leave no word over a limit; the own types are picked all the same."""
    monkeypatch.setattr(brown, "HEAD", 5)
    monkeypatch.setattr(brown, "OWN", 3)
    docs = spark.createDataFrame([("w%d w%d" % (i, i),) for i in range(9)], "text string")
    counts = brown.token_counts(docs)
    model = brown.train(docs, counts, brown.head_limit(counts, brown.HEAD))
    assert list(model.own) == [b"w0", b"w1", b"w2"] and model.head == {b"w0": 2, b"w1": 2, b"w2": 2}
    rows = [(i, "w%d w%d" % (i, i)) for i in range(9)]
    held, counts, n, v, base, known = brute_scores(rows)
    for scores in (brown.score_texts, brown.class_scores):
        for r in scores(spark.createDataFrame(rows, "doc_id long, text string")).collect():
            assert r.base_score == pytest.approx(base[r.doc_id]) and r.n_known == known[r.doc_id] and r.train_tokens == n


def test_class_scores_of_held_out_texts(spark):
    docs = table(spark, MIDDLE, "documents")
    total = [scores(docs).filter("held_out").agg(F.sum("score")).first()[0] for scores in (brown.score_texts, brown.class_scores)]
    assert total[1] > total[0]


def test_class_scores_of_odd_rows(spark, odd_docs, no_docs):
    rows = brown.class_scores(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r.doc_id: r for r in rows}
    plain = {r.doc_id: r for r in brown.score_texts(odd_docs).collect()}
    assert all(got[i].n_tokens == plain[i].n_tokens and got[i].n_known == plain[i].n_known for i in plain)
    assert all(got[i].base_score == pytest.approx(plain[i].base_score) for i in plain)
    assert brown.class_scores(no_docs).count() == 0
    only_held = odd_docs.filter("doc_id = 3")
    assert zlib.crc32(b"3") % 7 != 2 or brown.class_scores(only_held).first().score == 0
    alone = spark.createDataFrame([(held, "x y") for held in range(200) if zlib.crc32(str(held).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r.n_known, r.base_score, r.score) for r in brown.class_scores(alone).collect()} == {(0, 0.0, 0.0)}


# ---- quality ----


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    n = np.array([1, 4, 3])
    emit, change = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs, log_z = quality.marginals(emit, n, change)
    at = 0
    for t, size in enumerate(n):
        total, ones, moves = 0.0, np.zeros(size), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(size)):
            score = sum(emit[at + i] for i, y in enumerate(path) if y) + sum(change[a, b] for a, b in zip(path, path[1:]))
            weight = math.exp(score)
            total += weight
            ones += weight * np.array(path)
            for a, b in zip(path, path[1:]):
                moves[a, b] += weight
        assert log_z[t] == pytest.approx(math.log(total))
        assert np.allclose(good[at : at + size], ones / total)
        assert np.allclose(pairs[t], moves / total)
        at += size


def test_line_features_of_a_batch_are_those_of_each_text():
    texts = ["One line.", "", "two\nlines here here here", "\n", "ends with break\n", "ü | | 12\n\nx"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    x, length, first = quality.line_features(data, at)
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        own, size, _ = quality.line_features(raw, np.array([0, len(raw)]))
        stop = first[i + 1] if i + 1 < len(texts) else len(x)
        assert np.allclose(x[first[i] : stop], own)
        assert length[first[i] : stop].tolist() == size.tolist() == [len(line.encode()) for line in text.split("\n")]


def accuracy(rows, labels, name):
    known = {r.doc_id: r[name] for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in known]
    return sum(r.predicted == known[r.doc_id] for r in held) / len(held)


def test_quality_held_out(spark):
    labels = table(spark, MIDDLE, "labels")
    docs = table(spark, MIDDLE, "documents")
    rows = quality.assess(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert accuracy(rows, labels, "quality") >= 0.95
    kept = {r.doc_id for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in rows if r.predicted}


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 0, 0), (4, 1, 1), (9, None, None), (None, 1, 1), (7, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.assess(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.assess(no_docs, labels).count() == 0
    none = quality.assess(odd_docs, labels.filter("quality = 7")).collect()
    assert {r.predicted for r in none} == {1}
    assert quality.keep_good(odd_docs, labels).columns == odd_docs.columns
    assert quality.keep_good(odd_docs, labels.filter("quality = 7")).count() == odd_docs.count()


# ---- toxicity ----


def test_peaks_by_blocks_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 1 << 45, n) for n in (0, 1, 2, 50, 400)]
    model = toxicity.fit([d for d in docs if len(d)], np.array([0, 1, 0, 1]), epochs=1)
    scorer = toxicity.Scorer(model)
    whole = [scorer.peak(d) for d in docs]
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 7)
    assert all(np.allclose(a, scorer.peak(d)) for a, d in zip(whole, docs))
    blank = np.full(toxicity.WIDTHS[-1], -1)
    for w, d in zip(whole, docs):
        assert np.allclose(w, toxicity.responses(model, np.concatenate([d, blank, blank[:-1]])).max(axis=0), atol=1e-5)


def test_gradient_against_differences():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 1 << 45, n) for n in (6, 9, 4, 12)]
    label = np.array([0, 1, 1, 0])
    model = toxicity.fit(docs, label, epochs=1)
    grads = toxicity.gradient(model, docs, label)

    def loss():
        scorer = toxicity.Scorer(model)
        peaks = np.array([scorer.peak(d) for d in docs])
        z = np.maximum(peaks, 0) @ model.out[:-1].astype(float) + model.out[-1]
        return float(np.mean(np.logaddexp(0, z) - label * z))

    for i in (0, 5, len(model.out) - 1):
        held = model.out[i]
        model.out[i] = held + 1e-2
        up = loss()
        model.out[i] = held - 1e-2
        down = loss()
        model.out[i] = held
        assert grads[-1][i] - 1e-4 * held == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_threshold():
    p, y = np.array([0.9, 0.8, 0.4, 0.2]), np.array([1, 1, 0, 0])
    assert 0.4 < toxicity.best_threshold(p, y, np.ones(4)) < 0.8
    assert toxicity.best_threshold(p, np.zeros(4, int), np.ones(4)) == 0.5


def test_toxicity_held_out(spark):
    labels = table(spark, MIDDLE, "labels")
    docs = table(spark, MIDDLE, "documents")
    rows = toxicity.assess(docs, labels).collect()
    assert len(rows) == docs.count()
    assert accuracy(rows, labels, "toxic") >= 0.88
    assert all((r.score >= 0.5) == (r.predicted == 1) for r in rows)


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 0, 0), (4, 1, 1), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.assess(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.assess(no_docs, labels).count() == 0
    assert {r.predicted for r in toxicity.assess(odd_docs, labels.filter("toxic = 7")).collect()} == {0}


def same_ids(spark, ids, n=6000):
    rows = spark.range(n).selectExpr(
        f"{ids} AS doc_id", "concat('the words of row ', id, ' are like those of all the other rows') AS text", "if(id % 10 = 0, 'de', 'en') AS lang"
    )
    return rows


def test_samples_stay_bounded_whatever_the_ids(spark):
    from jobloom.llm import language, quality

    sizes = []
    seen = language.sample_features

    def counted(rows):
        sizes.append(rows.count())
        return seen(rows)

    language.sample_features = counted
    try:
        for ids in ("cast(null as bigint)", "7L", "id"):
            model = language.train(same_ids(spark, ids), per_language=200)
            assert model.langs == ["de", "en"]
        language.train(same_ids(spark, "7L").withColumn("text", F.lit("one and the same row")), per_language=200)
    finally:
        language.sample_features = seen
    assert all(200 < n < 600 for n in sizes[:3]) and sizes[3] <= 2
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    docs = same_ids(spark, "7L + id % 2")
    sample, classes = quality.labelled_sample(docs, labels, "quality", 5, 9, per_class=100, seed=5)
    assert classes == {0: 1, 1: 1}
    assert {0, 1} == {r.label for r in sample.select("label").distinct().collect()} and 250 < sample.count() < 550


def test_toxicity_thresholds_count_every_labelled_row(spark, monkeypatch):
    """Labelled rows outside the sample, too: all but the held-out ones and those the filters learned from."""
    counted = []
    monkeypatch.setattr(toxicity, "calibrate", lambda raw, label, weight: (counted.append((label, weight)), (1.0, 0.0))[1])
    rows = [(i, f"{'vile' if i % 2 else 'kind'} word {i}", "en", i % 2) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    seen = {}
    real = toxicity.balance

    def balance(model, raw, labels, sizes, learned):
        judged = raw.join(labels, "doc_id").join(learned, "doc_id", "left_anti")
        seen.update(apart=model.apart, n=judged.count(), known=labels.count(), learned=learned.count())
        real(model, raw, labels, sizes, learned)

    monkeypatch.setattr(toxicity, "balance", balance)
    assert toxicity.assess(docs, docs.select("doc_id", "toxic"), per_class=160).count() == 1000
    assert seen["apart"] and seen["n"] == seen["known"] - seen["learned"] > 320
    assert round(sum(w.sum() for _, w in counted)) == seen["known"]
