"""Near copies by five-word shingles: sketches find candidates, exact similarity decides.

A document is the set of hashes of its five-word runs; equal sets are one class. Candidates share one
of ``BANDS`` keys of minima of the set, whatever the shape of the edit, and are within a budget of
differing bits of a sketch of the minima, which binary tries find inside each bucket of a key
(``simhash.trie_links``). A bucket gives at most one link a row. These links only say what may
belong together. Each such loose group is then compared exactly: its sets come together in units of
a bounded size, a unit multiplies the matrix of its rows and shingles block by block, and gives
at most one link a row too. A loose group beyond one unit is first held against one part of
itself, which joins what is alike; only between parts that are still apart are all units of two
parts compared. So every pair of a loose group is judged, but no pair is ever a row.

Buckets beyond ``HOT_ROWS`` rows are cut into parts, and each two parts meet in a task of their own.

Rows are judged by themselves, not by their ids: nulls, repeated ids and repeated rows are told apart by
id and text. Of each group the row with the least doc_id stays (rows without one come last, equal
ids by a hash of the text), and of equal rows one. A null text counts as empty; all texts without words
are one group. Columns keep their names and values, whatever the names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import MAP_BITS, bit_map, bounded_batches, pieces
from jobloom.llm.simhash import shingle_hashes, signed, trie_links, union, whole_keys, words_of
from jobloom.operators.components import connected_groups
from jobloom.operators.windows import split_join
from jobloom.session import ensure_checkpoint_dir

WORDS = 5
#: Bits of the sketch, one of each of as many minima; two sets of similarity s differ in (1 - s) / 2 of them on average.
SKETCH = 256
SKETCH_NAMES = [f"s{i}" for i in range(SKETCH // 64)]
#: At a similarity of 0.8 pairs differ in 6.4 of 64 bits and 25.6 of 256; over these bounds in one of a million or fewer.
BUDGET, TOTAL = 19, 50
#: Candidates share one of ``BANDS`` keys of ``BAND_ROWS`` minima: at a similarity of 0.8, 0.9993 of pairs do.
BANDS, BAND_ROWS = 24, 6
#: Rows of a bucket that one task holds.
HOT_ROWS = 200_000
#: Documents and shingles of one part of a unit, which has two at most.
PART_DOCS, PART_SHINGLES = 2048, 2_000_000
#: Shingles multiplied at once.
BLOCK = 4096
#: Keys that may be broadcast (24 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 500_000
FACTORS, SHIFTS = np.random.default_rng(21).integers(1, 1 << 32, (2, SKETCH)).astype(np.uint32) | np.uint32(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of ``SKETCH`` hash functions; two sets agree in each with the odds of their similarity."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    held = np.empty((256, SKETCH), np.uint32)
    for start in range(0, len(short), len(held)):
        part = short[start : start + len(held)]
        tried = held[: len(part)]
        np.multiply(part[:, None], FACTORS, out=tried)
        tried += SHIFTS
        np.minimum(least, tried.min(axis=0), out=least)
    return least


def bits_of(least: np.ndarray) -> list[int]:
    """One bit of each minimum, 64 to a number."""
    bits = np.packbits(((least >> np.uint32(9)) & np.uint32(1)).astype(np.uint8))
    return np.frombuffer(bits.tobytes(), ">u8").astype(np.uint64).tolist()


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's five-word runs, in order."""
    return np.unique(shingle_hashes(words_of(text), WORDS))


def digest(hashes: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return signed(whole >> 64), signed(whole & (1 << 64) - 1)


def row_key() -> list[Column]:
    """(id, t0, t1): what tells rows apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("id"), F.xxhash64(text, F.lit(1)).alias("t0"), F.xxhash64(text, F.lit(2)).alias("t1")]


def prints(docs: DataFrame) -> DataFrame:
    """(row, id, t0, t1, d0, d1, n, s0.., bands): digest, size, sketch and band keys of each row's shingle set."""
    bounded_batches(docs.sparkSession)
    numbers = ["d0", "d1", "n", *SKETCH_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows, bands = [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_set(text)
                least = minima(hashes)
                rows.append([*digest(hashes), len(hashes), *(signed(b) for b in bits_of(least))])
                parts = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
                bands.append([signed(xxhash.xxh64_intdigest(p.tobytes(), i)) for i, p in enumerate(parts)])
            columns = np.array(rows, np.int64).reshape(-1, len(numbers))
            kept = [batch.column(c) for c in ("row", "id", "t0", "t1")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(columns[:, i]) for i in range(len(numbers))), pa.array(bands, pa.list_(pa.int64()))],
                ["row", "id", "t0", "t1", *numbers, "bands"],
            )

    schema = ", ".join([*(f"{c} long" for c in ["row", "id", "t0", "t1", *numbers]), "bands array<long>"])
    return docs.select(F.monotonically_increasing_id().alias("row"), *row_key(), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def loose_links(classes: DataFrame, total: int = TOTAL, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b): at most one link a row of each bucket, between rows (node, s0.., bands) that may be near copies."""
    bounded_batches(classes.sparkSession)
    rows = classes.select("node", *SKETCH_NAMES, F.posexplode("bands").alias("m", "k"))
    hot = rows.groupBy("k").count().filter(F.col("count") > hot_rows)
    hot = hot.select("k", F.ceil(F.col("count") / hot_rows).cast("int").alias("parts")).checkpoint()
    if not hot.isEmpty():
        # each two parts of a hot bucket meet under a key of their own
        met = split_join(rows, hot, ["k"]).withColumn("own", F.pmod(F.xxhash64("node", "m"), F.coalesce("parts", F.lit(1))).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        key = F.when(F.col("parts").isNull(), F.col("k")).otherwise(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")))
        rows = met.select("node", *SKETCH_NAMES, "m", key.alias("k"))
    dealt = rows.repartition("k").sortWithinPartitions("k")
    budget = BUDGET if total < SKETCH else 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_keys(batches):
            order = np.lexsort((part["node"], part["s0"].view(np.uint64), part["m"], part["k"]))
            key, node, m = part["k"][order], part["node"][order], part["m"][order]
            full = np.stack([part[c][order].view(np.uint64) for c in SKETCH_NAMES], 1)
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (m[1:] != m[:-1])))
            label = trie_links(starts, full[:, 0].copy(), full, budget, total)
            # all rows of a group name its least node, so that buckets of the same rows give the same links
            least = node.copy()
            np.minimum.at(least, label, node)
            at = np.flatnonzero(least[label] != node)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(least[label[at]])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_matrix(sets: list[np.ndarray], split: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of sets with a similarity of 0.8 or more.

    With ``split`` between 0 and their number, only pairs of one set before it and one from it on.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    value, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[place]
    owner, place = owner[keep], number[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    across = 0 < split < len(sets)
    first, second = (slice(0, split), slice(split, None)) if across else (slice(None), slice(None))
    common = np.zeros((len(sizes[first]), len(sizes[second])), np.float32)
    for start in range(0, int(shared.sum()), BLOCK):
        low, high = np.searchsorted(place, [start, start + BLOCK])
        held = np.zeros((len(sets), BLOCK), np.float32)
        held[owner[low:high], place[low:high] - start] = 1
        common += held[first] @ held[second].T
    # 5 * common >= 4 * (sum - common); counts below 2 ** 24 are exact
    near = 9 * common.astype(np.int64) >= 4 * (sizes[first][:, None] + sizes[second][None, :])
    near &= common > 0
    a, b = np.nonzero(near)
    return a, b + (split if across else 0)


def unit_links(rows: DataFrame) -> DataFrame:
    """(a, b): links that span the near copies of each unit, from rows (unit, side, node, hashes)."""
    bounded_batches(rows.sparkSession)
    dealt = rows.select("unit", "side", "node", "hashes").repartition("unit").sortWithinPartitions("unit", "side", "node")

    def linked(nodes: list[int], sides: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(nodes) < 2:
            return
        label = union(len(nodes), *near_matrix(sets, sum(s == 0 for s in sides)))
        at = np.flatnonzero(label != np.arange(len(label)))
        named = np.array(nodes)
        yield pa.RecordBatch.from_arrays([pa.array(named[at]), pa.array(named[label[at]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, sides, sets = None, [], [], []
        for batch in batches:
            hashes = batch.column("hashes")
            ends = hashes.offsets.to_numpy()
            flat = hashes.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for i, own in enumerate(batch.column("unit").to_pylist()):
                if own != unit:
                    yield from linked(nodes, sides, sets)
                    unit, nodes, sides, sets = own, [], [], []
                nodes.append(batch.column("node")[i].as_py()), sides.append(batch.column("side")[i].as_py())
                sets.append(flat[ends[i] : ends[i + 1]].copy())
        yield from linked(nodes, sides, sets)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes (node, d0, d1, id, t0, t1), from the texts.

    Texts are not shuffled: a bit map of fixed size lets most others pass, and the digest of what is left is
    joined exactly.
    """
    bounded_batches(docs.sparkSession)
    bits = bit_map(nodes.select(F.xxhash64("id", "t0", "t1")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            place = batch.column("h").to_numpy() & (MAP_BITS - 1)
            rows = np.flatnonzero(bits[place >> 3] >> (place & 7) & 1)
            sets = [shingle_set(t) for t in batch.column("text").take(pa.array(rows)).to_pylist()]
            digests = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["d0", "d1", "hashes"]
            )

    keyed = docs.select(*row_key(), F.col("text").cast("string").alias("text")).select(F.xxhash64("id", "t0", "t1").alias("h"), "text")
    made = keyed.mapInArrow(run, "d0 long, d1 long, hashes array<long>")
    made = made.join(nodes.select("d0", "d1", "node"), ["d0", "d1"])
    return made.groupBy("node").agg(F.any_value("hashes").alias("hashes"))


def parts_of(docs: Column, shingles: Column) -> Column:
    """How many parts of a unit so many documents and shingles make."""
    return F.greatest(F.ceil(docs / PART_DOCS), F.ceil(shingles / PART_SHINGLES), F.lit(1)).cast("int")


def exact_links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): links that span the near copies inside each loose group of nodes (node, loose, n and the row's key)."""
    sets = sets_of(docs, nodes).checkpoint()
    held = nodes.select("node", "loose", "n")
    sizes = held.groupBy("loose").agg(parts_of(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    named = split_join(held, sizes, ["loose"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).checkpoint()
    # every part against the first, which for most groups is the only one
    hub = named.filter("part = 0").select("node", "loose", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    others = named.filter("part > 0").select("node", "loose", F.lit(1).alias("side"), F.col("part").alias("with"))
    units = hub.unionByName(others).select(F.concat_ws(":", "loose", "with").alias("unit"), "side", "node")
    found = unit_links(units.join(sets, "node")).checkpoint()
    large = named.filter("parts > 1")
    if large.isEmpty():
        return found
    groups = connected_groups(found)
    near = large.join(groups, "node", "left").select("node", "loose", "n", F.coalesce("group", "node").alias("near"))
    kinds = near.groupBy("loose", "near").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")).checkpoint()
    open_ = kinds.groupBy("loose").count().filter("count > 1").select("loose")
    kinds = kinds.join(open_, "loose", "left_semi")
    # a large group of near copies has parts of its own, small ones share parts
    alone = (F.col("docs") > PART_DOCS // 4) | (F.col("shingles") > PART_SHINGLES // 4)
    shared = kinds.filter(~alone).groupBy("loose").agg(parts_of(F.sum("docs"), F.sum("shingles")).alias("together"))
    kinds = split_join(kinds, shared, ["loose"])
    own = F.when(alone, parts_of(F.col("docs"), F.col("shingles"))).otherwise(F.col("together"))
    kinds = kinds.select("loose", "near", own.alias("parts"), F.when(alone, F.col("near")).alias("whole"))
    dealt = split_join(near, kinds, ["loose", "near"], "inner")
    salt = F.when(F.col("whole").isNotNull(), F.xxhash64("node")).otherwise(F.xxhash64("near"))
    part = F.concat_ws("/", F.col("whole").cast("string"), F.pmod(salt, F.col("parts")).cast("string"))
    dealt = dealt.select("node", "loose", "whole", part.alias("part")).checkpoint()
    parts = dealt.select("loose", "part", "whole").distinct()
    pairs = parts.join(parts.select("loose", F.col("part").alias("other"), F.col("whole").alias("other_whole")), "loose")
    mixed = F.col("whole").isNull()
    apart = (F.col("part") < F.col("other")) & (mixed | ~F.col("whole").eqNullSafe(F.col("other_whole")))
    pairs = pairs.filter(apart | mixed & (F.col("part") == F.col("other"))).select("loose", "part", "other").checkpoint()
    unit = F.concat_ws(":", "loose", "part", "other").alias("unit")
    left = dealt.join(pairs, ["loose", "part"]).select(unit, F.lit(0).alias("side"), "node")
    right = dealt.withColumnRenamed("part", "other").join(pairs.filter("part <> other"), ["loose", "other"]).select(unit, F.lit(1).alias("side"), "node")
    # what the first units joined goes on as its groups, which need no round of their own
    joined = groups.select(F.col("node").alias("a"), F.col("group").alias("b"))
    return joined.unionByName(unit_links(left.unionByName(right).join(sets, "node")))


def judged(docs: DataFrame, total: int = TOTAL) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows (row, id, t0, t1, d0, d1), and (d0, d1, group) of the classes that have near copies."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = prints(docs).checkpoint()
    kept = [F.any_value(c).alias(c) for c in ["n", *SKETCH_NAMES, "bands"]]
    classes = rows.groupBy("d0", "d1").agg(F.min(F.struct("row", "id", "t0", "t1")).alias("r"), *kept)
    classes = classes.select(F.col("r.row").alias("node"), "r.id", "r.t0", "r.t1", "d0", "d1", "n", *SKETCH_NAMES, "bands").checkpoint()
    loose = connected_groups(loose_links(classes, total))
    nodes = classes.select("node", "id", "t0", "t1", "d0", "d1", "n").join(loose.withColumnRenamed("group", "loose"), "node").checkpoint()
    groups = connected_groups(exact_links(nodes, docs)) if not nodes.isEmpty() else loose
    return rows.select("row", "id", "t0", "t1", "d0", "d1"), groups.join(nodes, "node").select("d0", "d1", "group").checkpoint()


def firsts(rows: DataFrame, groups: DataFrame, *keep: str) -> DataFrame:
    """One row of first values per class (d0, d1), with its ``group``, null where it has no near copies."""
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "t0", "t1")
    return rows.groupBy("d0", "d1").agg(F.min(order).alias("first")).join(groups, ["d0", "d1"], "left")


def near_duplicates(docs: DataFrame, total: int = TOTAL) -> DataFrame:
    """(doc_id, component_id) of each row; component_id is the least doc_id of its near copies, itself included."""
    rows, groups = judged(docs, total)
    classes = firsts(rows, groups).select("d0", "d1", F.col("first.id").alias("least"), "group")
    least = classes.filter("group is not null").groupBy("group").agg(F.min("least").alias("all"))
    named = split_join(classes, least, ["group"]).select("d0", "d1", F.coalesce("all", "least").alias("component_id"))
    return split_join(rows, named, ["d0", "d1"]).select(F.col("id").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group of near copies, all columns as they are."""
    rows, groups = judged(docs)
    classes = firsts(rows, groups)
    best = classes.filter("group is not null").groupBy("group").agg(F.min("first").alias("first"))
    stay = best.select("first.*").unionByName(classes.filter("group is null").select("first.*"))
    key = F.struct("id", "t0", "t1").alias("key")
    stay = stay.select(key).checkpoint()
    keys = rows.groupBy("id", "t0", "t1").count().select(key, "count").checkpoint()
    gone = keys.join(stay, "key", "left_anti").select("key").checkpoint()
    few = gone.count() <= BROADCAST_KEYS
    whole = docs.select(key_of(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    left = whole.join(F.broadcast(gone) if few else gone, "key", "left_anti")
    twice = keys.filter("count > 1").join(stay, "key", "left_semi").select("key").checkpoint()
    if twice.isEmpty():
        return left.select("whole.*")
    single = left.join(twice, "key", "left_anti")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("whole")))
    one = left.join(twice, "key", "left_semi").withColumn("place", place).filter("place = 1").drop("place")
    return single.unionByName(one).select("whole.*")


def key_of(docs: DataFrame) -> Column:
    return F.struct(*row_key()).alias("key")
