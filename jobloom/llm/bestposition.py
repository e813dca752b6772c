"""Ranked lexical search by the Best Position Algorithm.

Documents are cut into terms once; only terms of the asked items stay, tested against a bit map
of fixed size, and go to a table. From it come the statistics of the corpus and, dealt out to
shards of a bounded number of postings, the impact lists: one list per term, highest impact
first. The items stream past each shard. All lists of an item are read downward together; each
document that turns up is looked up in the item's other lists at once, which gives its whole
score and marks its positions there as seen. A list's best position is the end of its unbroken
run of seen positions. No unseen document can score above the sum of the impacts at the best
positions, so the search of a shard ends when that sum is strictly below the k-th score: ties
are never cut. The best of all shards are ranked once more.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lowered. Null and
empty texts have no terms and are in no count. Each row is a document of its own: repeated rows
and rows that share a doc_id all count and are all ranked. Rows with a null doc_id are ranked
too, behind equal scores that have one. Rows that share an item_id, null included, are one item
with the terms of all of them. Items without terms known to the corpus have no rows; neither
have empty tables. Extra columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import MAP_BITS, bit_map, bounded_batches, pieces, served
from jobloom.session import scratch

#: Postings of one shard; what a task holds follows from it.
SHARD_POSTINGS = 2_000_000
#: Terms whose place in the map a task remembers.
REMEMBERED = 200_000
#: Positions read from each list in the first step; each further step reads twice as many.
STEP = 64
RESULT = "item_id long, doc_id long, score long"

_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return (text or b"").translate(_TERM_BYTES).split()


def asked_items(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of all items."""
    bounded_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    cut = items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, terms array<binary>")
    return cut.select("item_id", F.explode("terms").alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def postings(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(spread, doc_id, n, terms, counts): per document with terms, those that the map holds and their counts."""
    bounded_batches(docs.sparkSession)
    schema = "spread long, doc_id long, n long, terms array<binary>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bool] = {}

        def asked(term: bytes) -> bool:
            if len(known) > REMEMBERED:
                known.clear()
            place = xxhash.xxh64_intdigest(term, 42) & (MAP_BITS - 1)
            known[term] = bool(bits[place >> 3] >> (place & 7) & 1)
            return known[term]

        for batch in pieces(batches, "text"):
            rows, sizes, ends, terms, counts = [], [], [0], [], []
            for at, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                rows.append(at), sizes.append(len(words))
                for term, count in Counter(words).items():
                    hit = known.get(term)
                    if asked(term) if hit is None else hit:
                        terms.append(term), counts.append(count)
                ends.append(len(terms))
            kept = pa.array(rows, pa.int64())
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("spread").take(kept),
                    batch.column("doc_id").take(kept),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                ],
                ["spread", "doc_id", "n", "terms", "counts"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("spread"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, schema)


class ImpactLists:
    """The postings of one shard: by term with the highest impact first, and by document for direct access."""

    def __init__(self, rows: pa.Table, docs: int, words: int) -> None:
        ids = rows.column("id")
        self.unnamed = ids.is_null().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        terms, counts = (rows.column(c).combine_chunks() for c in ("terms", "nums"))
        named = terms.flatten().dictionary_encode()
        self.code = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.codes = {term: i for i, term in enumerate(named.dictionary.to_pylist())}
        tf = counts.flatten().to_numpy(zero_copy_only=False)
        self.starts = np.concatenate([[0], np.cumsum(np.diff(terms.offsets.to_numpy()), dtype=np.int64)])
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        length = 100 - 25 + (25 * rows.column("n").to_numpy() * docs) // words
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * length[doc])
        order = np.lexsort((-self.impact, self.code))
        self.list_starts = np.searchsorted(self.code[order], np.arange(len(self.codes) + 1))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order)) - self.list_starts[self.code[order]]
        self.listed_doc, self.listed_impact = doc[order], self.impact[order]
        self.slot = np.full(len(self.codes), -1)

    def better(self, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k of the documents, by score, then id."""
        order = np.lexsort((self.ids[docs], self.unnamed[docs], -scores))[:k]
        return docs[order], scores[order]

    def search(self, asked: list[tuple[bytes, int]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, documents looked up) for terms with their weights."""
        known = [(self.codes[t], w) for t, w in asked if t in self.codes and w > 0]
        best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not known:
            return best, scores, 0
        codes, weight = (np.array(x, np.int64) for x in zip(*known))
        low, size = self.list_starts[codes], self.list_starts[codes + 1] - self.list_starts[codes]
        base = np.concatenate([[0], np.cumsum(size)])
        self.slot[codes] = np.arange(len(codes))
        seen = np.zeros(base[-1], bool)
        met = np.zeros(len(self.ids), bool)
        reach = np.zeros(len(codes), np.int64)
        depth, step, looked = 0, STEP, 0
        while (depth < size).any():
            open_ = np.flatnonzero(depth < size)
            read = [self.listed_doc[low[t] + depth : low[t] + min(depth + step, size[t])] for t in open_]
            fresh = np.unique(np.concatenate(read))
            fresh = fresh[~met[fresh]]
            if len(fresh):
                met[fresh] = True
                looked += len(fresh)
                # direct access: all postings of the new documents, of which the asked lists' count
                start, many = self.starts[fresh], self.starts[fresh + 1] - self.starts[fresh]
                ends = np.cumsum(many)
                at = np.arange(ends[-1]) + np.repeat(start - (ends - many), many)
                which = self.slot[self.code[at]]
                own = which >= 0
                gain = np.concatenate([[0], np.cumsum(np.where(own, weight[which] * self.impact[at], 0))])
                found = gain[ends] - gain[ends - many]
                seen[base[which[own]] + self.place[at[own]]] = True
                fits = found > 0 if len(scores) < k else found >= scores[-1]
                best, scores = self.better(np.concatenate([best, fresh[fits]]), np.concatenate([scores, found[fits]]), k)
            depth += step
            step *= 2
            limit = 0
            for t in range(len(codes)):
                if reach[t] < size[t]:
                    rest = seen[base[t] + reach[t] : base[t + 1]]
                    gap = int(rest.argmin())
                    reach[t] = size[t] if rest[gap] else reach[t] + gap
                if reach[t] < size[t]:
                    limit += int(weight[t] * self.listed_impact[low[t] + reach[t] - 1])
            if len(scores) == k and limit < scores[-1]:
                break
        self.slot[codes] = -1
        return best, scores, looked


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    path = scratch(spark, "asked-terms")
    asked_items(items).write.parquet(path)
    asked = spark.read.parquet(path)
    path = scratch(spark, "postings")
    postings(docs, bit_map(asked.select(F.xxhash64("term")))).write.parquet(path)
    found = spark.read.parquet(path)
    total = found.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("held")).first()
    count, words = total.docs, total.words
    shards = total.held // shard_postings + 1

    held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * count + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(held, "term").select("item_id", "term", (F.col("times") * weight).alias("weight")).filter("weight > 0")
    pairs = weighed.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("pairs"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    queries = pairs.select(
        every.alias("shard"), F.lit(1).alias("kind"), F.col("item_id").alias("id"), F.lit(0).cast("long").alias("n"), F.col("pairs.term").alias("terms"), F.col("pairs.weight").alias("nums")
    )
    shard = F.pmod(F.xxhash64("spread"), F.lit(shards)).cast("int")
    stored = found.filter(F.size("terms") > 0).select(shard.alias("shard"), F.lit(0).alias("kind"), F.col("doc_id").alias("id"), "n", "terms", F.col("counts").alias("nums"))

    def answer(lists: ImpactLists, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, ids, none, points = [], [], [], []
        for name, terms, weights in zip(*(rows.column(c).to_pylist() for c in ("id", "terms", "nums"))):
            docs_, scores, _ = lists.search(list(zip(terms, weights)), k)
            names += [name] * len(docs_)
            ids.append(lists.ids[docs_]), none.append(lists.unnamed[docs_]), points.append(scores)
        if names:
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(np.concatenate(ids), mask=np.concatenate(none)), pa.array(np.concatenate(points))],
                ["item_id", "doc_id", "score"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return served(batches, lambda rows: ImpactLists(rows, count, words), answer)

    dealt = stored.unionByName(queries).repartition("shard").sortWithinPartitions("shard", "kind")
    bounded_batches(spark)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = dealt.mapInArrow(run, RESULT).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = f"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, t, len(t) AS n
        FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PATTERN}') AS t FROM documents) WHERE len(t) > 0
    ), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
    p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM d) GROUP BY ALL),
    f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY term, docs),
    q AS (
        SELECT item_id, term, count(*) AS times
        FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_PATTERN}')) AS term FROM benchmark) GROUP BY ALL
    ), s AS (
        SELECT q.item_id, p.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words)))) AS BIGINT) AS score
        FROM q JOIN p USING (term) JOIN f USING (term), total GROUP BY q.item_id, p.r, p.doc_id
    )
    SELECT item_id, CAST(row_number() OVER o AS INT) AS rank, doc_id, score FROM s WHERE score > 0
    WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER o <= 20
"""
