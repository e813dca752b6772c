"""Fingerprints and groups against brute force."""

import math
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from jobloom.llm import neardup as N
from jobloom.llm import simhash as S
from jobloom.llm.common import table


def plain_fingerprint(text, size=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, budget):
    values = list(values)
    a, b = np.array([(i, j) for i in range(len(values)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= budget] or [(0, 0)]).T
    return S.union(len(values), a, b)


def test_fingerprints(spark, small):
    docs = table(spark, small, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.fingerprint for r in S.simhash_components(docs).collect()}
    assert got == {i: f"{plain_fingerprint(t):016x}" for i, t in texts.items()}


def test_spark_hash_is_the_same(spark):
    row = spark.sql("SELECT xxhash64('some words here') AS h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"some words here", 42)


def test_trie_against_all_pairs():
    rng = random.Random(5)
    for budget, total in ((2, 2), (3, 9), (0, 0), (5, 5)):
        centres = [rng.getrandbits(64) for _ in range(12)]
        values = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for c in centres for _ in range(30)}
        value = np.array(sorted(values), np.uint64)
        label = S.trie_links(np.array([0]), value, value[:, None], budget, total)
        assert np.array_equal(label, brute_components(value.tolist(), min(budget, total)))


def test_buckets_do_not_mix():
    value = np.array([1, 3, 1, 3], np.uint64)
    assert S.trie_links(np.array([0, 2]), value, value[:, None], 1, 1).tolist() == [0, 0, 2, 2]


def test_every_near_pair_shares_a_mask():
    rng = random.Random(2)
    for budget, levels in ((2, 2), (2, 1), (4, 1)):
        masks = S.block_masks(budget, levels)
        for _ in range(300):
            bits = sum(1 << b for b in rng.sample(range(64), budget))
            assert any(not mask & bits for mask in masks)


def test_groups_through_chains(spark, monkeypatch):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ 3 for v in values[:20]] + [v ^ 3 ^ 12 for v in values[:20]] + values[:5] + [0, 1]
    prints = spark.createDataFrame([(i, S.signed(v)) for i, v in enumerate(values)], "doc_id long, f0 long")
    got = {r.doc_id: r.component_id for r in S.grouped(prints, ["f0"], ["f0"], 2, 2, levels=2).collect()}
    assert [got[i] for i in range(len(values))] == brute_components(values, 2).tolist()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = S.simhash_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].fingerprint == "0" * 16 == by_id[3].fingerprint == by_id[8].fingerprint
    assert by_id[2].component_id == by_id[3].component_id == by_id[8].component_id == 2
    assert by_id[6].component_id == 1
    assert S.simhash_components(no_docs).count() == 0


def test_one_of_each_group_stays(spark, odd_docs, no_docs):
    kept = N.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 4, 5, 7, 9]
    assert ids.count(None) == 1
    assert N.keep_one(no_docs).count() == 0


def test_near_copies_are_found_and_others_kept(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(4000)]
    rows, number = [], 0
    for group in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(120, 400))]
        rows.append((number, group, " ".join(words)))
        number += 1
        for _ in range(2):
            copy = list(words)
            for _ in range(max(1, len(copy) // 100)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((number, group, " ".join(copy)))
            number += 1
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs).collect()}
    first = {}
    for i, g, _ in rows:
        first.setdefault(g, i)
    right = sum(got[i] == first[g] for i, g, _ in rows)
    assert right >= 0.97 * len(rows)
    assert all(got[i] // 3 == i // 3 for i, _, _ in rows)


def test_tasks_hold_no_whole_group(spark):
    plan = S.near_links(spark.createDataFrame([(1, 2)], "rep long, f0 long"), ["f0"], ["f0"], 2, 2, 2)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert plan.select(F.count("*")).first()[0] == 0


def test_sketch_measures_similarity():
    rng = np.random.default_rng(6)
    common = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.5, 0.8, 0.9):
        own = int(3000 * share * 2 / (1 + share)), int(3000 - 3000 * share * 2 / (1 + share))
        a = np.concatenate([common[: own[0]], rng.integers(0, 1 << 63, own[1]).astype(np.uint64)])
        b = np.concatenate([common[: own[0]], rng.integers(0, 1 << 63, own[1]).astype(np.uint64)])
        apart = sum(bin(x ^ y).count("1") for x, y in zip(N.bits_of(N.minima(a)), N.bits_of(N.minima(b))))
        assert abs(1 - 2 * apart / N.SKETCH - share) < 0.12


def block_edited(rng, words, similarity, shape):
    """A copy whose five-word shingles have just this similarity or more: one block is cut off, appended or inserted."""
    n = len(words)
    if shape == "truncated":
        return words[: math.ceil((n - 4) * similarity) + 4]
    grown = (n - 8) / similarity - n if shape == "inserted" else (n - 4) / similarity - (n - 4)
    new = [f"n{rng.getrandbits(40)}" for _ in range(int(grown + 1e-9))]
    at = n if shape == "appended" else n // 2
    return words[:at] + new + words[at:]


def test_block_edited_copies_are_found(spark):
    rng = random.Random(11)
    rows, kind = [], {}
    for similarity in (0.8, 0.85, 0.9):
        for shape in ("truncated", "appended", "inserted"):
            for _ in range(40):
                words = [f"w{rng.getrandbits(40)}" for _ in range(rng.choice([200, 1000]))]
                kind[len(rows)] = similarity, shape
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(block_edited(rng, words, similarity, shape)))]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = {k: np.mean([got[i + 1] == i for i, own in kind.items() if own == k]) for k in set(kind.values())}
    print(sorted(share.items()))
    assert all(x >= 0.98 for (s, _), x in share.items())


def test_links_are_the_exact_similarity(spark):
    rng = random.Random(13)
    rows, near = [], {}
    for similarity in (0.72, 0.75, 0.78, 0.8, 0.82):
        for shape in ("truncated", "appended", "inserted"):
            for _ in range(30):
                words = [f"w{rng.getrandbits(40)}" for _ in range(200)]
                copy = block_edited(rng, words, similarity, shape)
                a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, copy))
                near[len(rows)] = 5 * len(a & b) >= 4 * len(a | b)
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy))]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[i + 1] == i for i, is_near in near.items() if not is_near)
    assert sum(got[i + 1] == i for i, is_near in near.items() if is_near) >= 0.98 * sum(near.values())


def test_a_failed_spanning_link_hides_none(spark, monkeypatch):
    # without the filter of bits, each bucket is spanned by links that fail and links that hold
    rng = random.Random(14)
    base = [f"w{rng.getrandbits(40)}" for _ in range(300)]
    cuts = [base[at : at + 240] for at in range(0, 61, 6)] + [base[:220], base[80:]]
    texts = [" ".join(c) for c in cuts]
    sets = [{tuple(c[i : i + 5]) for i in range(len(c) - 4)} for c in cuts]
    links = [(i, j) for i in range(len(cuts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = S.union(len(cuts), *np.array(links).T).tolist()
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), total=N.SKETCH).collect()}
    assert [got[i] for i in range(len(cuts))] == want


def test_parts_and_hot_buckets_lose_no_link(spark, monkeypatch):
    # loose groups of many parts, cut buckets: groups stay those of all pairs
    monkeypatch.setattr(N, "PART_DOCS", 16)
    rng = random.Random(15)
    base = [f"w{rng.getrandbits(40)}" for _ in range(400)]
    cuts = [base[at : at + 300] for at in range(0, 101, 3)] + [base[at : at + 180] for at in range(0, 221, 4)]
    cuts += [base[:200] + [f"x{i}-{j}" for j in range(30)] for i in range(60)]
    rng.shuffle(cuts)
    sets = [{tuple(c[i : i + 5]) for i in range(len(c) - 4)} for c in cuts]
    links = [(i, j) for i in range(len(cuts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = S.union(len(cuts), *np.array(links).T).tolist()
    docs = spark.createDataFrame([(i, " ".join(c)) for i, c in enumerate(cuts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs, total=N.SKETCH).collect()}
    assert [got[i] for i in range(len(cuts))] == want
    assert len(set(want)) > 3
    classes = N.prints(docs).withColumnRenamed("row", "node")
    cut = N.connected_groups(N.loose_links(classes, N.SKETCH, hot_rows=10))
    whole = N.connected_groups(N.loose_links(classes, N.SKETCH))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def test_pairs_just_below_the_bound_make_no_rows(spark):
    rng = random.Random(16)
    base = [f"w{rng.getrandbits(40)}" for _ in range(200)]
    texts = [" ".join(base + [f"x{i}-{j}" for j in range(26)]) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, groups = N.judged(docs)
    assert groups.count() == 0 and rows.count() == 300
    assert N.loose_links(N.prints(docs).withColumnRenamed("row", "node")).count() <= 300 * N.BANDS
    assert N.keep_one(docs).count() == 300


def test_rows_are_kept_by_row_not_by_id(spark):
    rng = random.Random(17)
    texts = [" ".join(f"w{rng.getrandbits(40)}" for _ in range(60)) for _ in range(30)]
    rows = [(i % 3 or None, t, "x", 1, 2) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "x", 1, 2) for i in range(10)] + rows[10:12] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, _gone_doc string, _same_doc int, key int").repartition(4)
    kept = N.keep_one(frame)
    assert kept.columns == frame.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(t for _, t in got) == sorted(texts)
    # a row with an id stays before one without
    assert all(i is not None or t not in texts[:10] for i, t in got)
