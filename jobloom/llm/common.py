"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to a Python worker, so that long texts cannot fill its memory.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000
Store = TypeVar("Store")
#: Bits of a map of hashes, in buckets of one aggregate each: 2 MB.
MAP_BITS = 1 << 24
BUCKET_BITS = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by bytes as well as rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def in_fold(key: str, folds: int, rest: int) -> Column:
    """True where crc32 of the key as text leaves ``rest``; a null key is in no fold."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % folds == rest, F.lit(False))


def seeded_share(*keys: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone; a null key is a key like any other."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``size`` bytes of text, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                yield batch.slice(start, stop - start)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def bit_map(hashes: DataFrame) -> np.ndarray:
    """A bit map of a column of hashes: ``MAP_BITS`` / 8 bytes, however many rows there are."""
    place = F.pmod(F.col(hashes.columns[0]), F.lit(MAP_BITS))
    parts = hashes.groupBy(F.floor(place / BUCKET_BITS).alias("bucket")).agg(F.bitmap_construct_agg(place % BUCKET_BITS).alias("bits"))
    whole = np.zeros((MAP_BITS // BUCKET_BITS, BUCKET_BITS // 8), np.uint8)
    for row in parts.collect():
        whole[row.bucket] = np.frombuffer(row.bits, np.uint8)
    return whole.reshape(-1)


def served(
    batches: Iterator[pa.RecordBatch],
    build: Callable[[pa.Table], Store],
    answer: Callable[[Store, pa.RecordBatch], Iterator[pa.RecordBatch]],
) -> Iterator[pa.RecordBatch]:
    """Answers rows of kind 1 from what their shard's rows of kind 0 are built into.

    Rows come sorted by ``shard`` and ``kind``. Only one shard is held; the asking rows stream past
    it. A shard without rows of kind 0 answers nothing.
    """
    shard, store, held = None, None, []
    for batch in batches:
        key = batch.column("shard").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            part = batch.slice(start, stop - start)
            own, kind = divmod(int(key[start]), 2)
            if own != shard:
                shard, store, held = own, None, []
            if kind == 0:
                held.append(part)
                continue
            if held:
                store, held = build(pa.Table.from_batches(held)), []
            if store is not None:
                yield from answer(store, part)
