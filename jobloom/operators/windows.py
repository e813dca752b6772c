"""Latest rows, ranks, percentiles and trends that hold up under hot keys.

Latest-row picks are first rows of a window: Spark keeps one row per key of each map task
before the shuffle, and reads only the columns that are used. Percentiles and ranks run over a
histogram of distinct values. Trends spread a hot company over ranges of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.session import ensure_checkpoint_dir


def pick_per_key(df: DataFrame, keys: list[str], order: list[str], newest: bool = True) -> DataFrame:
    """One whole row per key: the one with the greatest (or least) order columns."""
    sort = [F.col(c).desc() if newest else F.col(c).asc() for c in order]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort))
    return df.withColumn("_pick", first).filter(F.col("_pick") == 1).drop("_pick")


def split_join(large: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins rows to an aggregate of one row per key so that a hot key can be split.

    An aggregate is already dealt out by its keys, and a join on them would reuse that; Spark
    then cannot split the large side. As one struct the key is dealt anew on both sides, so
    adaptive execution splits large partitions. Null keys match nothing, as in any join.
    """
    key = F.struct(*keys)
    known = small
    for name in keys:
        known = known.filter(F.col(name).isNotNull())
    rest = [c for c in small.columns if c not in keys]
    known = known.select(key.alias("_key"), *rest)
    return large.withColumn("_key", key).join(known, "_key", how).drop("_key")


def latest_analysis(analyses: DataFrame, metric: str | None = None) -> DataFrame:
    """The newest analysis per company, or the newest whose metric is set."""
    if metric:
        analyses = analyses.filter(F.col(metric).isNotNull())
    return pick_per_key(analyses, ["company_id"], ["created_at", "analysis_id"])


def newest_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows per key; Spark limits each map task's groups before the shuffle."""
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n)


def value_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Rows per distinct value of a group. Its size follows the value domain, not the number of rows.

    Nulls count as 0 and drop out after the aggregate: a null test before it would
    be pushed below the projections and compute the value twice per row.
    """
    return df.groupBy(*group, value).agg(F.count(value).alias("_n")).filter(F.col("_n") > 0)


def value_ranks(counts: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per distinct value of a group: rows below it, rows above it, rows in the group.

    The windows see one row per distinct value (scores 0..100, whole salaries), never
    the rows themselves. ``counts`` may be finer than ``group``. Without a group no window
    could be dealt out, so whole numbers are ranked by blocks instead.
    """
    counts = counts.groupBy(*group, value).agg(F.sum("_n").alias("_n"))
    if not group:
        return block_ranks(counts, value)
    whole = Window.partitionBy(*group)
    upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum("_n").over(upto)
    total = F.sum("_n").over(whole)
    return counts.select(
        *group,
        value,
        (running - F.col("_n")).alias("n_below"),
        (total - running).alias("n_above"),
        total.alias("n_group"),
    )


BLOCK_LEVELS = 33


def block_ranks(counts: DataFrame, value: str) -> DataFrame:
    """``value_ranks`` of all rows for whole-number values, by equal joins only.

    On each level numbers fall into blocks of twice the size of the level below. What lies
    below a number is the sum of the blocks to the left of its own, one for each set bit.
    """
    place = F.col(value).cast("bigint") + F.lit(1 << 31)
    counts = counts.withColumn("_i", place)
    levels = F.explode(F.sequence(F.lit(0), F.lit(BLOCK_LEVELS)))
    blocks = counts.select(levels.alias("_k"), "_i", "_n").groupBy("_k", F.expr("shiftright(_i, _k)").alias("_b")).agg(F.sum("_n").alias("_sum"))
    asked = counts.select(value, "_i", "_n", levels.alias("_k"))
    asked = asked.filter((F.expr("shiftright(_i, _k) & 1") == 1) | (F.col("_k") == BLOCK_LEVELS))
    whole = F.col("_k") == BLOCK_LEVELS
    asked = asked.withColumn("_b", F.when(whole, F.lit(0)).otherwise(F.expr("shiftright(_i, _k) - 1")).cast("bigint"))
    met = split_join(asked, blocks, ["_k", "_b"])
    below = F.coalesce(F.sum(F.when(~whole, F.col("_sum"))), F.lit(0)).alias("n_below")
    ranked = met.groupBy(value, "_n").agg(below, F.max(F.when(whole, F.col("_sum"))).alias("n_group"))
    return ranked.select(value, "n_below", (F.col("n_group") - F.col("n_below") - F.col("_n")).alias("n_above"), "n_group")


def join_percentile(df: DataFrame, counts: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    ranks = value_ranks(counts, group, value).select(
        *group,
        value,
        F.when(F.col("n_group") > 1, F.col("n_below") / (F.col("n_group") - 1) * 100).otherwise(0.0).alias(out),
    )
    return df.join(ranks, [*group, value], "left")


def join_peer_rank(df: DataFrame, counts: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    ranks = value_ranks(counts, group, value).select(
        *group, value, F.concat_ws(" of ", F.col("n_above") + 1, F.col("n_group")).alias(out)
    )
    return df.join(ranks, [*group, value], "left")


def with_percentile(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """percent_rank() * 100 of the value within its group."""
    return join_percentile(df, value_counts(df, group, value), group, value, out)


def with_peer_rank(df: DataFrame, groups: dict[str, str], value: str) -> DataFrame:
    """Text ranks such as ``3 of 120`` within each group column, best value first, equal values sharing a rank."""
    counts = value_counts(df, list(groups), value)
    for group, out in groups.items():
        df = join_peer_rank(df, counts, [group], value, out)
    return df


def in_ranges(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ranges of the keys, with the number of their range in ``_range``, written once.

    The ranges come from a sample, so they are fixed before they are used twice. Adaptive execution
    joins small ranges up to its advisory size and no further.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()).checkpoint()


def with_previous(df: DataFrame, key: str, time: str, tie: str, value: str, out: str) -> DataFrame:
    """lag(value) per key in (time, tie) order, with the rows of a key spread over ranges.

    Rows are dealt out by ranges of (key, time, tie), so that a key with most of the rows, all of
    one day even, lies in as many ranges as its size asks for. Inside a range it is a plain lag. The
    first row of a key in a range takes the key's last value in the range before, found on a table
    of one row per key and range.
    """
    ranged = in_ranges(df, key, time, tie)
    inside = Window.partitionBy(key, "_range").orderBy(time, tie)
    rows = ranged.withColumn("_prev", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    ends = ranged.groupBy(key, "_range").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(time, tie)).alias("_end")
    )
    carried = ends.select(
        key, "_range", F.lag("_end").over(Window.partitionBy(key).orderBy("_range")).alias("_carry")
    )
    return (
        rows.join(carried, [key, "_range"], "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_carry.v")).otherwise(F.col("_prev")))
        .drop("_range", "_prev", "_first", "_carry")
    )


def score_trend(analyses: DataFrame, value: str = "recommendation_score", threshold: float = 0.5) -> DataFrame:
    """Each scored analysis with its change against the one before it."""
    scored = analyses.filter(F.col(value).isNotNull())
    rows = with_previous(scored, "company_id", "created_at", "analysis_id", value, "previous")
    change = F.col(value) - F.col("previous")
    return rows.withColumn("change", change).withColumn(
        "trend",
        F.when(F.col("change") >= threshold, "improving")
        .when(F.col("change") <= -threshold, "declining")
        .when(F.col("change").isNotNull(), "stable"),
    )


def canonical_of(df: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """Every row with the key of its group's oldest row; the oldest itself gets null."""
    oldest = df.groupBy(*group).agg(F.min_by(key, F.struct(*order)).alias("_oldest"))
    joined = split_join(df, oldest, group)
    return joined.withColumn("duplicate_of", F.when(F.col("_oldest") != F.col(key), F.col("_oldest"))).drop("_oldest")
