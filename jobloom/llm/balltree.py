"""Exact inner-product top-k by ball trees, one per shard.

Vectors are dealt to shards of a bounded size by a hash of their ids. In each shard a ball
tree is built; a node's centre and radius bound the inner product of a query with anything
inside. Queries walk the tree together, the child with the higher bounds first, and leave a
node once its bound is below their current k-th score. A first round gives every query the
k-th score of one shard; the second takes it along to all other shards, so most nodes are
cut at once. Equality is never cut, so ties fall to the smaller id exactly.

Queries reach a shard in batches that stream past its tree: memory is one shard and one
batch. With many queries a shard is dealt out several times, each copy with a share of them.

Components become floor(256 x). Vectors that are null, or hold a null or non-finite
component, take no part; neither do rows with a null id. A repeated vec_id counts once, with
the least of its vectors. Shorter vectors count as filled up with zeros. An empty table gives
no rows; a query with fewer than k partners gets all of them. Extra columns are left out.
Inner products must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import bounded_batches
from jobloom.session import ensure_checkpoint_dir

SHARD_ROWS = 4096
SHARD_QUERIES = 50_000
LEAF = 64
LOWEST = np.iinfo(np.int64).min
RESULT = "query_id long, vec_id long, score long"


class Tree:
    """Ranges of rows with centre and radius; node 0 is the root, children follow their parent."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.nodes: list[tuple[int, int, int, int]] = []
        centres, radii = [], []
        rows = np.arange(len(ids))
        parts = []

        def build(own: np.ndarray) -> int:
            node = len(self.nodes)
            self.nodes.append((0, 0, -1, -1))
            points = self.vectors[own].astype(np.float64)
            centre = points.mean(axis=0)
            apart = np.sqrt(((points - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(apart.max())
            if len(own) <= LEAF or radii[-1] == 0:
                start = sum(len(p) for p in parts)
                parts.append(own)
                self.nodes[node] = (start, start + len(own), -1, -1)
                return node
            far = points[apart.argmax()]
            other = points[((points - far) ** 2).sum(axis=1).argmax()]
            side = np.argsort(points @ (other - far), kind="stable")
            half = np.sort(own[side[: len(own) // 2]]), np.sort(own[side[len(own) // 2 :]])
            self.nodes[node] = (0, 0, build(half[0]), build(half[1]))
            return node

        if len(rows):
            build(rows)
            flat = np.concatenate(parts)
            self.ids, self.vectors = self.ids[flat], self.vectors[flat]
            self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), each (queries, k), of what reaches the queries' k-th scores; LOWEST fills the rest."""
        width = max(queries.shape[1], self.vectors.shape[1])
        queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        vectors = np.pad(self.vectors, ((0, 0), (0, width - self.vectors.shape[1])))
        largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * width
        exact = np.float64 if largest < 2**52 else np.int64
        q, x = queries.astype(exact), vectors.astype(exact)
        centres = np.pad(self.centres, ((0, 0), (0, width - self.centres.shape[1])))
        asked = queries.astype(np.float64)
        length = np.sqrt((asked**2).sum(axis=1))
        bounds = centres @ asked.T + self.radii[:, None] * length
        bounds += 1e-9 * (np.abs(bounds) + self.radii[:, None] * length) + 1.0
        best = np.full((len(q), k), LOWEST)
        found = np.full((len(q), k), np.iinfo(np.int64).max)
        kth = kth.copy()
        stack = [(0, np.arange(len(q)))]
        while stack:
            node, own = stack.pop()
            own = own[bounds[node, own] >= kth[own]]
            if not len(own):
                continue
            start, stop, left, right = self.nodes[node]
            if left >= 0:
                first = bounds[left, own] >= bounds[right, own]
                # the last pushed is the first visited: each query sees its better child first
                stack += [(left, own[~first]), (right, own[first]), (right, own[~first]), (left, own[first])]
                continue
            for at in range(start, stop, 1024):
                ids = self.ids[at : min(at + 1024, stop)]
                score = (q[own] @ x[at : at + len(ids)].T).astype(np.int64)  # whole numbers either way
                score[query_ids[own][:, None] == ids] = LOWEST
                better = score.max(axis=1) >= np.maximum(kth[own], LOWEST + 1)
                if not better.any():
                    continue
                rows = own[better]
                both = np.concatenate([best[rows], score[better]], axis=1)
                names = np.concatenate([found[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
                by_id = np.argsort(names, axis=1, kind="stable")
                both = np.take_along_axis(both, by_id, 1)
                names = np.take_along_axis(names, by_id, 1)
                top = np.argsort(-both.astype(np.float64) if exact is np.float64 else ~both, axis=1, kind="stable")[:, :k]
                best[rows] = np.take_along_axis(both, top, 1)
                found[rows] = np.take_along_axis(names, top, 1)
                kth[rows] = np.maximum(kth[rows], best[rows, k - 1])
        return found, best


def matrix(column: pa.Array) -> np.ndarray:
    """floor(256 x) of a column of arrays, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def round_of(dealt: DataFrame, k: int) -> DataFrame:
    """Answers the queries of each shard; rows (shard, kind, id, vec, kth) of kind 0 are its vectors."""

    def answer(tree: Tree | None, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if tree is None or not len(tree.ids):
            return
        for start in range(0, rows.num_rows, 512):
            part = rows.slice(start, 512)
            asked = part.column("id").to_numpy()
            kth = part.column("kth").to_numpy(zero_copy_only=False)
            ids, scores = tree.search(asked, matrix(part.column("vec")), kth, k)
            row, place = np.nonzero(scores >= np.maximum(kth, LOWEST + 1)[:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(asked[row]), pa.array(ids[row, place]), pa.array(scores[row, place])], ["query_id", "vec_id", "score"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, held = None, None, []
        for batch in batches:
            key = batch.column("shard").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for start, stop in zip(cuts, cuts[1:]):
                part = batch.slice(start, stop - start)
                if not part.num_rows:
                    continue
                own, kind = divmod(int(key[start]), 2)
                if own != shard:
                    shard, tree, held = own, None, []
                if kind == 0:
                    held.append(part)
                    continue
                if held:
                    rows = pa.Table.from_batches(held)
                    tree, held = Tree(rows.column("id").to_numpy(), matrix(rows.column("vec"))), []
                yield from answer(tree, part)

    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, RESULT)


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of rows (vec_id, embedding) that satisfy ``is_query`` against all others."""
    bounded_batches(vectors.sparkSession)
    ensure_checkpoint_dir(vectors.sparkSession)
    sound = F.col("embedding").isNotNull() & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    rows = rows.filter(sound & F.col("vec_id").isNotNull())
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("vec"), F.max("asks").alias("asks"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    shards = size.n // shard_rows + 1
    copies = size.q // SHARD_QUERIES + 1
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(copies))
    every = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    stored = rows.select(home.alias("home"), every.alias("g"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "vec", F.lit(LOWEST).alias("kth"))
    stored = stored.select((F.col("home") * copies + F.col("g")).alias("shard"), "kind", "id", "vec", "kth")
    queries = rows.filter("asks").select(home.alias("home"), group.alias("g"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "vec")
    at_home = queries.select((F.col("home") * copies + F.col("g")).alias("shard"), "kind", "id", "vec", F.lit(LOWEST).alias("kth"))
    first = round_of(stored.unionByName(at_home), k).checkpoint()
    reached = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    bound = reached.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("low")).alias("low"))
    away = queries.join(bound, "id", "left").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("s <> home")
    away = away.select((F.col("s") * copies + F.col("g")).alias("shard"), "kind", "id", "vec", F.coalesce("low", F.lit(LOWEST)).alias("kth"))
    found = first.unionByName(round_of(stored.unionByName(away), k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
