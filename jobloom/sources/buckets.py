"""Tables kept in buckets, so that a batch reads and writes only the buckets it touches.

A folder holds several tables. A row lies in the bucket of the hash of its table's key. Each batch
writes the rows it changes below a folder of its own number, one sub-folder for each touched bucket,
and then one small manifest file, which names the folders of every bucket: that file is the commit of
all tables at once. Readers follow the newest manifest; folders that none names are not seen,
so a batch that failed before its manifest has changed nothing and may be repeated, and a repeated
batch reads the state before it. A bucket that has grown by ``compact`` folders is written whole by the
next batch that touches it. Several rows of one identity may lie in a bucket: the newest counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.operators.windows import pick_per_key

_MANIFEST = "table string, bucket int, version long, kind string, at long"


@dataclass(frozen=True)
class Kept:
    """One table: its columns, the key that deals rows to buckets, and what tells rows apart."""

    schema: T.StructType
    key: tuple[str, ...]
    identity: tuple[str, ...]


class Buckets:
    """The tables below ``base``; ``count`` buckets each."""

    def __init__(self, spark: SparkSession, base: str, tables: dict[str, Kept], count: int = 64, compact: int = 8) -> None:
        self.spark, self.base, self.tables, self.count, self.compact = spark, base, tables, count, compact

    def bucket(self, table: str, columns: list[Column] | None = None) -> Column:
        """The bucket of a row, by the table's key columns or those given in their place."""
        kept = self.tables[table]
        typed = [(c if columns is None else columns[i]).cast(kept.schema[k].dataType) for i, (k, c) in enumerate((k, F.col(k)) for k in kept.key)]
        return F.pmod(F.xxhash64(*typed), F.lit(self.count)).cast("int")

    def touched(self, rows: DataFrame, table: str, columns: list[Column] | None = None) -> list[int]:
        """Buckets that hold rows of these keys: at most ``count`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket(table, columns)).distinct().collect())

    def manifest(self, before: int | None = None) -> dict[tuple[str, int], list[tuple[int, str]]]:
        """(table, bucket) -> its folders, as of the newest commit, or the newest under ``before``."""
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.base}/manifest")
        except AnalysisException:
            return {}
        rows = rows if before is None else rows.filter(F.col("at") < before)
        newest = rows.agg(F.max("at")).first()[0]
        out: dict[tuple[str, int], list[tuple[int, str]]] = {}
        for r in rows.filter(F.col("at") == newest).collect() if newest is not None else []:
            out.setdefault((r["table"], r.bucket), []).append((r.version, r.kind))
        return out

    def newest(self) -> int | None:
        """The number of the newest committed batch."""
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.base}/manifest").agg(F.max("at")).first()[0]
        except AnalysisException:
            return None

    def _folder(self, table: str, version: int, kind: str) -> str:
        return f"{self.base}/data/version={version}/{table}-{kind}"

    def rows(self, table: str, buckets: list[int] | None = None, before: int | None = None, manifest: dict | None = None) -> DataFrame:
        """The newest row of each identity, with its ``version``, of all buckets or of those named."""
        kept, folders = self.tables[table], self.manifest(before) if manifest is None else manifest
        paths = [
            f"{self._folder(table, version, kind)}/bucket={bucket}"
            for (name, bucket), parts in folders.items()
            if name == table and (buckets is None or bucket in set(buckets))
            for version, kind in parts
        ]
        schema = T.StructType([*kept.schema.fields, T.StructField("version", T.LongType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).parquet(*paths)
        return pick_per_key(found, list(kept.identity), ["version"])

    def _write(self, rows: DataFrame, table: str, version: int, kind: str) -> list[int]:
        """Writes rows dealt out by bucket; the buckets that got any."""
        path = self._folder(table, version, kind)
        dealt = rows.withColumn("bucket", self.bucket(table)).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
        schema = T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType())])
        return sorted(r[0] for r in self.spark.read.schema(schema).parquet(path).select("bucket").distinct().collect())

    def commit(self, changes: dict[str, DataFrame], version: int) -> None:
        """Writes the changed rows of the tables as batch ``version``, and its manifest last."""
        folders = {k: list(v) for k, v in self.manifest(version).items()}
        for table, rows in changes.items():
            columns = self.tables[table].schema.fieldNames()
            full: list[int] = []
            for bucket in self._write(rows.select(*columns).withColumn("version", F.lit(version).cast("long")), table, version, "part"):
                parts = folders.setdefault((table, bucket), [])
                parts.append((version, "part"))
                if len(parts) > self.compact:
                    full.append(bucket)
            if full:
                self._write(self.rows(table, full, manifest=folders), table, version, "whole")
                for bucket in full:
                    folders[table, bucket] = [(version, "whole")]
        flat = [(t, b, v, k) for (t, b), parts in folders.items() for v, k in parts]
        named = self.spark.createDataFrame(flat, "table string, bucket int, version long, kind string")
        # one file, so the commit is one rename
        named.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/manifest/at={version}")
