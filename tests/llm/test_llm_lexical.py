"""Best-position search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from jobloom.llm import common
from jobloom.llm.bestposition import ImpactLists, rank_documents, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    """docs and items: (id, text) rows."""
    cut = [(i, Counter(plain_terms(t))) for i, t in docs if plain_terms(t)]
    count, words = len(cut), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(plain_terms(t))
    out = []
    for item, terms in asked.items():
        rows = []
        for doc, c in cut:
            m = 100 - 25 + (25 * sum(c.values()) * count) // words
            score = sum(q * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in terms.items() if c[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, n + 1, None if none else doc, -score) for n, (score, none, doc) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def test_terms_are_the_pattern():
    text = "Ünïcode Ünder_score x-Y\x00z\x7fq 日本語, ÀB１２ \U0001f600 a.b{c}~d 0:9;A[Z]`"
    assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)
    assert terms_of(None) == []


def test_ranks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    odds = 1 / np.arange(1, 61)
    odds /= odds.sum()
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=odds))) for i in range(700)]
    docs += [(1000 + i, docs[0][1]) for i in range(300)]  # a group of copies: ties
    docs += [(None, docs[1][1])] * 3 + [(5, docs[2][1])] * 4 + [(2000, None), (2001, ""), (2002, " . , ")]
    docs += [(2003, "W1 w2 " * 40_000)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 12)))) for i in range(25)] + [(3, "w1 w59 w59"), (None, "W0 w1"), (99, None), (98, "unheard of")]
    frame = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, n int, rank int, spread string").repartition(3)
    asked = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, score int")
    got = rank_documents(frame, asked, k=10, shard_postings=700)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 10)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the cat"), (2, "no ID")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in rank_documents(odd_docs, items).collect()), key=str) == brute(docs, [(1, "the cat"), (2, "no ID")], 20)
    assert rank_documents(no_docs, items).count() == 0
    assert rank_documents(odd_docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert rank_documents(odd_docs, items.limit(0)).count() == 0


def test_search_stops_early_and_only_strictly_below():
    many = 20_000
    terms = pa.array([[b"a", b"b"]] * many, pa.list_(pa.binary()))
    counts = [[1 + i % 50, 50 - i % 50] for i in range(many - 5)] + [[900, 900]] * 5
    rows = pa.table({"id": pa.array(range(many)), "n": pa.array([100] * many), "terms": terms, "nums": pa.array(counts, pa.list_(pa.int64()))})
    lists = ImpactLists(rows, many, 100 * many)
    best, scores, looked = lists.search([(b"a", 7), (b"b", 7), (b"missing", 3)], 5)
    assert lists.ids[best].tolist() == list(range(many - 5, many)) and len(set(scores.tolist())) == 1
    assert looked < many // 10
    # the sum of impacts equals the k-th score: the search goes on, and the least ids win
    same = pa.table({"id": pa.array(range(many)[::-1]), "n": pa.array([2] * many), "terms": terms, "nums": pa.array([[1, 1]] * many, pa.list_(pa.int64()))})
    lists = ImpactLists(same, many, 2 * many)
    best, _, looked = lists.search([(b"a", 7), (b"b", 7)], 5)
    assert lists.ids[best].tolist() == [0, 1, 2, 3, 4] and looked == many


def test_map_has_no_false_misses(spark):
    asked = spark.range(5000).selectExpr("concat('t', id) AS term", "id AS item_id")
    bits = common.bit_map(asked.select(F.xxhash64("term")))
    assert len(bits) == common.MAP_BITS // 8
    place = [xxhash.xxh64_intdigest(f"t{i}".encode(), 42) & (common.MAP_BITS - 1) for i in range(5000)]
    assert all(bits[p >> 3] >> (p & 7) & 1 for p in place)
    assert int(np.unpackbits(bits).sum()) == len(set(place))
