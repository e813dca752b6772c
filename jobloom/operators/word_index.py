"""Word search by an inverted index that is kept up in batches, with BM25 ranking.

The index is three tables in buckets (``sources.buckets``): postings by term, texts with their terms
by id, and counts of texts and words. An update compares a text's new terms with its stored ones and
writes only the postings that change; a term that a text has lost becomes a posting of 0. A
search reads the buckets of its words alone, and never a text.

A word is a run of letters, digits, ``#`` and ``+``, whatever the case. Texts without words, null and
empty ones are in no posting and in no count. Of several texts with one id in a batch the greatest
counts; rows with a null id are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.operators.windows import split_join
from jobloom.session import ensure_checkpoint_dir
from jobloom.sources.buckets import Buckets, Kept

_SPLIT = r"[^\p{L}\p{N}#+]+"
#: The usual constants of the ranking: how soon repeats of a word level off, and how far a text's length counts.
K1, B = 1.2, 0.75
#: Scores are whole numbers of this fraction, so that no order of adding changes them.
UNIT = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), lambda w: w != "")


def query_words(query: str) -> list[str]:
    return sorted({w for w in re.split(r"[^\w#+]+", query.lower()) if w})


def idf(n_texts: int, held: Column) -> Column:
    return F.log(1 + (n_texts - held + 0.5) / (held + 0.5))


class WordIndex:
    """An index of (id, text) rows below ``base``."""

    def __init__(self, spark: SparkSession, base: str, id_type: T.DataType | None = None, buckets: int = 64, compact: int = 8) -> None:
        id_type = id_type or T.LongType()

        def schema(*fields: tuple[str, T.DataType]) -> T.StructType:
            return T.StructType([T.StructField(n, t) for n, t in fields])

        text, number, many = T.StringType(), T.LongType(), T.ArrayType(T.StringType())
        tables = {
            "postings": Kept(schema(("term", text), ("id", id_type), ("tf", number), ("n", number)), ("term",), ("term", "id")),
            "texts": Kept(schema(("id", id_type), ("n", number), ("terms", many)), ("id",), ("id",)),
            "sizes": Kept(schema(("part", number), ("texts", number), ("words", number)), ("part",), ("part",)),
        }
        self.store = Buckets(spark, base, tables, buckets, compact)

    def update(self, changed: DataFrame, version: int) -> None:
        """Adds or replaces the texts of rows (id, text) as batch ``version``; a null or empty text is taken out."""
        store = self.store
        ensure_checkpoint_dir(store.spark)
        new = changed.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max("text").alias("text")).select("id", words(F.col("text")).alias("all"))
        new = new.select("id", F.size("all").cast("long").alias("n"), "all").checkpoint()
        parts = store.touched(new, "texts")
        held = store.rows("texts", parts, before=version)
        old = held.join(new.select("id"), "id", "left_semi").select("id", "terms")
        counts = new.select("id", "n", F.explode("all").alias("term")).groupBy("id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
        lost = old.select("id", F.explode("terms").alias("term")).join(counts.select("id", "term"), ["id", "term"], "left_anti")
        lost = lost.select("term", "id", F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("n"))
        texts = new.select("id", "n", F.array_distinct("all").alias("terms"))
        # counts of a bucket: what it held, without the replaced texts, and the new ones
        rest = held.join(new.select("id"), "id", "left_anti").select("id", "n").unionByName(texts.select("id", "n"))
        sizes = rest.groupBy(store.bucket("texts").cast("long").alias("part")).agg(
            F.count_if(F.col("n") > 0).alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")
        )
        store.commit({"postings": counts.select("term", "id", "tf", "n").unionByName(lost), "texts": texts, "sizes": sizes}, version)

    def search(self, query: str) -> DataFrame:
        """(id, score) of the texts that hold every word of the query, by BM25; a query without words finds none."""
        store, asked = self.store, query_words(query)
        spark = store.spark
        manifest = store.manifest()
        total = store.rows("sizes", manifest=manifest).agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        terms = spark.createDataFrame([(w,) for w in asked], "term string")
        buckets = store.touched(terms, "postings") if asked else []
        found = store.rows("postings", buckets, manifest=manifest).filter(F.col("term").isin(asked) & (F.col("tf") > 0))
        held = found.groupBy("term").agg(F.count(F.lit(1)).alias("held"))
        met = split_join(found, held, ["term"], "inner")
        mean = total[1] / total[0] if total[0] else 1.0
        tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / mean))
        gain = F.floor(UNIT * idf(total[0], F.col("held")) * tf)
        return met.groupBy("id").agg(F.count(F.lit(1)).alias("hits"), F.sum(gain).alias("score")).filter(F.col("hits") == len(asked)).select("id", "score")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of (id, score) with their ``rank``; equal scores by id."""
    best = found.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
