"""Hard negatives by Kronecker-packed products.

Components are biased so that none is negative, and the same component of several candidates is
packed into separated fields of one wide integer. One multiplication for each component of an
anchor then serves all candidates of the integer at once: the sums stay inside their fields, and
shifting them out and taking the bias away again gives the exact inner products. Field widths
follow from the least and greatest component of the table. As long as a field fits 53 bits the
wide integers are whole numbers in doubles, which are exact there, so that a block of anchors
against a block of candidates is one matrix product; wider fields go into Python integers.

Two rounds deal candidates out to chunks of a bounded size and let the anchors stream past them.
In the first an anchor sees the chunks of its own label and keeps its best rows, its positives.
In the second it sees all chunks and keeps, for each positive, the best rows of other labels whose
score lies between two shares of the positive's. Each chunk keeps a few rows an anchor; those of
all chunks are ranked once more. With many anchors a chunk is dealt out several times, each copy
with a share of them.

Components become floor(256 x). Rows with a null id or label, a null vector, or a null or
non-finite component take no part. A repeated vec_id counts once, with the least of its vectors.
Shorter vectors count as filled up with zeros. Equal scores are in the order of ids. Anchors
without another row of their label, positives without a row in their window and empty tables give
no rows. Extra columns are left out. Inner products must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.balltree import matrix
from jobloom.llm.common import bounded_batches, served
from jobloom.session import ensure_checkpoint_dir

#: Components of one chunk of candidates: a hundredth of the rows, within these bounds.
CHUNK_LEAST, CHUNK_MOST = 1 << 20, 1 << 23
#: Anchors that one copy of a chunk serves.
CHUNK_ANCHORS = 50_000
#: Scores made at once.
BLOCK = 1 << 20
#: Whole numbers below 2 ** 53 are exact in a double.
DOUBLE_BITS = 53
#: Bits of a wide integer beyond doubles.
LONG_BITS = 4096
LOWEST = np.iinfo(np.int64).min


class Packing:
    """How components between ``least`` and ``greatest``, ``width`` to a vector, are packed."""

    def __init__(self, least: int, greatest: int, width: int) -> None:
        self.least, self.width = min(least, 0), max(width, 1)
        span = max(greatest, 0) - self.least
        self.bits = max(1, (self.width * span * span).bit_length())
        self.double = self.bits <= DOUBLE_BITS
        self.fields = DOUBLE_BITS // self.bits if self.double else max(1, LONG_BITS // self.bits)

    def biased(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, width) numbers of at least zero; shorter rows are filled up with zeros first."""
        full = np.zeros((len(vectors), self.width), np.int64)
        full[:, : vectors.shape[1]] = vectors
        return (full if self.double else full.astype(object)) - self.least


class Packed:
    """Candidates of one chunk in the order of their ids, ``fields`` of them to a wide integer."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, packing: Packing) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.packing = ids[order], labels[order], packing
        own = packing.biased(vectors[order])
        self.sums = own.sum(axis=1)
        spare = -len(own) % packing.fields
        own = np.concatenate([own, np.zeros((spare, packing.width), own.dtype)]).reshape(-1, packing.fields, packing.width)
        # field j of each wide integer holds the candidate j places on
        wide = own[:, 0].copy()
        for j in range(1, packing.fields):
            wide += own[:, j] << (packing.bits * j)
        self.wide = wide.T.astype(np.float64) if packing.double else wide.T

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """(anchors, candidates) exact inner products."""
        packing, count = self.packing, len(self.ids)
        asked = packing.biased(anchors)
        if packing.double:
            product = (asked.astype(np.float64) @ self.wide).astype(np.int64)
        else:
            product = asked.dot(self.wide)
        mask = (1 << packing.bits) - 1
        fields = np.stack([(product >> (packing.bits * j)) & mask for j in range(packing.fields)], axis=2)
        biased = fields.reshape(len(asked), -1)[:, :count]
        # (a - l)(c - l) = ac - l(a - l) - l(c - l) - l * l, summed over components
        fix = packing.least * (asked.sum(axis=1)[:, None] + self.sums[None, :]) + packing.width * packing.least * packing.least
        return (biased + fix).astype(np.int64)


def first_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by position; LOWEST is no score."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero((scores >= kth) & (scores > LOWEST))
    else:
        at = np.flatnonzero(scores > LOWEST)
    return at[np.argsort(~scores[at], kind="stable")[:k]]


def windows_of(scores: np.ndarray, fits: np.ndarray, positives: np.ndarray, k: int, low: int, high: int) -> Iterator[np.ndarray]:
    """For each positive score the positions of the k best fitting rows inside its window, ties by position."""
    least, most = -((-low * positives) // 100), (high * positives) // 100
    at = np.flatnonzero(fits & (scores >= least.min()) & (scores <= most.max()))
    down = ~scores[at]
    order = np.argsort(down, kind="stable")
    at, down = at[order], down[order]
    starts, ends = np.searchsorted(down, ~most), np.searchsorted(down, ~least, side="right")
    for start, end in zip(starts, ends):
        yield at[start : min(end, start + k)]


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, chunk_rows: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label).

    A negative's score lies between ``low`` and ``high`` hundredths of its positive's.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    ensure_checkpoint_dir(spark)
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding", is_anchor.alias("asks"))
    rows = rows.filter(sound & F.col("id").isNotNull() & F.col("label").isNotNull())
    rows = rows.groupBy("id").agg(F.min(F.struct("embedding", "label", "asks")).alias("r"))
    rows = rows.select("id", "r.label", F.col("r.embedding").alias("vec"), F.coalesce("r.asks", F.lit(False)).alias("asks")).checkpoint()

    def whole(x: Column) -> Column:
        return F.floor(256 * x.cast("double"))

    size = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("asks").alias("asked"),
        F.coalesce(F.min(whole(F.array_min("vec"))), F.lit(0)).alias("least"),
        F.coalesce(F.max(whole(F.array_max("vec"))), F.lit(0)).alias("greatest"),
        F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("width"),
    ).first()
    packing = Packing(size.least, size.greatest, size.width)
    per_row = max(size.width, 1)
    held = chunk_rows or max(1, min(max(size.n // 100, CHUNK_LEAST // per_row), CHUNK_MOST // per_row))
    chunks, copies = size.n // held + 1, size.asked // CHUNK_ANCHORS + 1
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks))
    copy = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(copies))
    every_chunk, every_copy = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (chunks, copies))
    no_points = F.lit(None).cast("array<long>")
    columns = ["kind", "id", "label", "vec", "names", "points"]

    def dealt(anchors: DataFrame, by_label: bool) -> DataFrame:
        """Candidates (kind 0) and anchors (kind 1) of each chunk, of one label each in the first round."""
        stored = rows.select(chunk.alias("c"), every_copy.alias("g"), F.lit(0).alias("kind"), "id", "label", "vec", no_points.alias("names"), no_points.alias("points"))
        asking = anchors.select(every_chunk.alias("c"), copy.alias("g"), F.lit(1).alias("kind"), "id", "label", "vec", "names", "points")
        label = F.col("label") if by_label else F.lit(0)
        shard = (label * chunks + F.col("c")) * copies + F.col("g")
        return stored.unionByName(asking).select(shard.cast("long").alias("shard"), *columns).repartition("shard").sortWithinPartitions("shard", "kind")

    def build(part: pa.Table) -> Packed:
        return Packed(part.column("id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("vec")), packing)

    def blocks(packed: Packed, part: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        step = max(1, BLOCK // len(packed.ids))
        for start in range(0, part.num_rows, step):
            some = part.slice(start, step)
            yield some, packed.scores(matrix(some.column("vec")))

    def best(packed: Packed, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some, scores in blocks(packed, part):
            names = some.column("id").to_numpy()
            scores[packed.ids[None, :] == names[:, None]] = LOWEST
            found = [first_rows(s, positives) for s in scores]
            at = np.concatenate(found)
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(packed.ids[at]), pa.array(scores[row, at])], ["anchor_id", "id", "score"])

    def between(packed: Packed, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some, scores in blocks(packed, part):
            names, labels = some.column("id").to_numpy(), some.column("label").to_numpy()
            made: list[list[np.ndarray]] = [[] for _ in range(5)]
            for i, (ids, points) in enumerate(zip(some.column("names").to_pylist(), some.column("points").to_pylist())):
                found = windows_of(scores[i], packed.labels != labels[i], np.array(points, np.int64), negatives, low, high)
                for name, score, at in zip(ids, points, found):
                    for column, values in zip(made, (np.full(len(at), names[i]), np.full(len(at), name), packed.ids[at], np.full(len(at), score), scores[i][at])):
                        column.append(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(column)) for column in made], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
            )

    asks = rows.filter("asks").withColumns({"names": no_points, "points": no_points})
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = dealt(asks, True).mapInArrow(lambda batches: served(batches, build, best), "anchor_id long, id long, score long")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    near = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("p"))
    asks = rows.filter("asks").select("id", "label", "vec").join(near.withColumnRenamed("anchor_id", "id"), "id")
    asks = asks.select("id", "label", "vec", F.col("p.id").alias("names"), F.col("p.score").alias("points")).checkpoint()
    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    far = dealt(asks, False).mapInArrow(lambda batches: served(batches, build, between), schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE = """
    WITH v AS (
        SELECT vec_id, list_transform(r.embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e,
            CASE WHEN vec_id % 7 = 0 THEN (r.label + 1) % 10 ELSE r.label END AS label
        FROM (SELECT vec_id, min({'embedding': embedding, 'label': label}) AS r FROM embeddings
              WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND vec_id IS NOT NULL GROUP BY vec_id)
    ), s AS (
        SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
        FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
    ), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER o AS INT) AS rank, n.id AS negative_id,
        p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
    WINDOW o AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER o <= 10
"""
