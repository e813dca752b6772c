"""SimHash fingerprints and near-duplicate groups by a self-join of binary tries.

A fingerprint row takes part in one trie per block of bits: with an error budget of e, two
fingerprints that differ in at most e bits agree on at least one of e + 1 blocks, so the
tries of all block values, dealt out by key, see every such pair. Blocks are cut a second
time by the same rule where ``levels`` is 2, which keeps buckets small. Inside a bucket the
sorted fingerprints are the trie: a node is a range with a common prefix. Node pairs are
walked together from the root, differing bits add up, and a pair of nodes is dropped once
the budget is exceeded, or when all below it is known to be one component.

Only links that join components leave a task (at most one per row), never all pairs of a
group. Equal fingerprints are one class before the join.

Nulls: a null text counts as empty; rows with a null doc_id keep their fingerprint but form
no group with others' ids (their component_id is that of their fingerprint's class, null if
all its ids are null). Texts without words have fingerprint zero. Repeated doc_id rows are
each returned. An empty table gives an empty result. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import bounded_batches
from jobloom.operators.components import connected_groups
from jobloom.session import ensure_checkpoint_dir

SEED = 42
#: Node pairs walked at once; bounds the memory of a task.
FRONTIER = 1 << 18
#: Pairs of nodes with at most this many rows are compared outright.
LEAF_PAIRS = 16


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of all words where there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        runs = [b" ".join(words)]
    elif size == 1:
        runs = words
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(run, SEED) for run in runs), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")



def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, f0): the 64-bit fingerprint over shingles of ``size`` words, as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(majority(shingle_hashes(words_of(t), size))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "f0"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, f0 long")





def union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least position of the component of each of n positions under the links a-b."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label



def trie_links(starts: np.ndarray, value: np.ndarray, full: np.ndarray, budget: int, total: int) -> np.ndarray:
    """Component label (least position) of each row under links inside buckets."""
    n = len(value)
    a, b = trie_pairs(starts, value, full, budget, total)
    return union(n, a, b)


def trie_pairs(starts: np.ndarray, value: np.ndarray, full: np.ndarray, budget: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): linked rows inside buckets, enough to span each component.

    Rows of a bucket are adjacent and sorted by ``value``; ``starts`` holds the first position
    of each bucket. Two rows link if their values differ in at most ``budget`` bits and the
    rows of ``full`` in at most ``total``.
    """
    n = len(value)
    ends = np.append(starts[1:], n)
    keep = ends - starts > 1
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        near = np.bitwise_count(value[a] ^ value[b]) <= budget
        a, b = a[near], b[near]
        far = np.bitwise_count(full[a] ^ full[b]).sum(axis=1, dtype=np.int64) > total
        return a[~far], b[~far]

    # known components first: neighbours in order, and each large bucket around its middle
    found: list[tuple[np.ndarray, np.ndarray]] = []
    bucket = np.repeat(np.arange(len(starts)), ends - starts)
    rows = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)])
    for step in (1, 2):
        same = bucket[step:] == bucket[:-step]
        found.append(linked(rows[:-step][same], rows[step:][same]))
    for s, e in zip(starts[ends - starts > 64], ends[ends - starts > 64]):
        centre = np.uint64(majority(value[s:e]))
        middle = s + int(np.argmin(np.bitwise_count(value[s:e] ^ centre)))
        found.append(linked(np.full(e - s, middle), np.arange(s, e)))
    label = union(n, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
    change = np.flatnonzero(np.append(label[1:] != label[:-1], True)) + 1
    run_end = change[np.searchsorted(change, np.arange(n), side="right")]

    # stack of (bit, a's range, b's range, differing bits so far); self pairs have equal ranges
    none = np.zeros(len(starts), np.int8)
    stack = [(63, starts, ends, starts, ends, none)]
    links_a, links_b = [], []
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        one = (run_end[alo] >= ahi) & (run_end[blo] >= bhi) & (label[alo] == label[blo])
        small = (ahi - alo) * (bhi - blo) <= (LEAF_PAIRS if bit >= 0 else np.iinfo(np.int64).max)
        leaf = small & ~one
        if leaf.any():
            al, bl, aw, bw = alo[leaf], blo[leaf], (ahi - alo)[leaf], (bhi - blo)[leaf]
            many = aw * bw
            which = np.repeat(np.arange(len(al)), many)
            order = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            a, b = al[which] + order // bw[which], bl[which] + order % bw[which]
            apart = label[a] != label[b]
            a, b = linked(a[apart], b[apart])
            links_a.append(a), links_b.append(b)
        go = ~one & ~small
        if not go.any():
            continue
        alo, ahi, blo, bhi, err = alo[go], ahi[go], blo[go], bhi[go], err[go]
        ones = np.concatenate([[0], np.cumsum((value >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        amid = ahi - (ones[ahi] - ones[alo])
        bmid = bhi - (ones[bhi] - ones[blo])
        own = (alo == blo) & (ahi == bhi)
        more = err < budget
        parts = [
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            (alo[more], amid[more], bmid[more], bhi[more], err[more] + 1),
            (amid[more & ~own], ahi[more & ~own], blo[more & ~own], bmid[more & ~own], err[more & ~own] + 1),
        ]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts))
        full_ = (ahi > alo) & (bhi > blo)
        alo, ahi, blo, bhi, err = alo[full_], ahi[full_], blo[full_], bhi[full_], err[full_]
        for start in range(0, len(alo), FRONTIER):
            at = slice(start, start + FRONTIER)
            stack.append((bit - 1, alo[at], ahi[at], blo[at], bhi[at], err[at]))
    a = np.concatenate([*(f[0] for f in found), *links_a, np.zeros(0, np.int64)]).astype(np.int64)
    b = np.concatenate([*(f[1] for f in found), *links_b, np.zeros(0, np.int64)]).astype(np.int64)
    return a, b


def blocks(bits: int, parts: int, start: int = 0) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``parts`` nearly equal blocks."""
    cuts = [start + bits * i // parts for i in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def block_masks(budget: int, levels: int) -> list[int]:
    """Masks of the bits two fingerprints must share; every pair within the budget shares one."""
    masks = []
    for lo, width in blocks(64, budget + 1):
        first = ((1 << width) - 1) << lo
        if levels == 1:
            masks.append(first)
            continue
        rest = [i for i in range(64) if not first >> i & 1]
        for at, wide in blocks(len(rest), budget + 1):
            masks.append(first | sum(1 << i for i in rest[at : at + wide]))
    return masks


def near_links(classes: DataFrame, tables: list[str], decide: list[str], budget: int, total: int, levels: int) -> DataFrame:
    """(a, b): links that span the components of the classes (columns ``rep`` and fingerprints)."""
    bounded_batches(classes.sparkSession)
    masks = block_masks(budget, levels)
    keys = [
        F.struct(
            F.xxhash64(F.lit(t * 1000 + m), F.col(name).bitwiseAND(F.lit(signed(mask)))).alias("k"),
            F.lit(t * 1000 + m).alias("m"),
            F.col(name).alias("v"),
        )
        for t, name in enumerate(tables)
        for m, mask in enumerate(masks)
    ]
    decide_by = decide if decide != tables else []
    rows = classes.select("rep", *decide_by, F.explode(F.array(*keys)).alias("x")).select("rep", "x.k", "x.m", "x.v", *decide_by)
    return bucket_links(rows, decide_by, budget, total)






def bucket_links(rows: DataFrame, decide_by: list[str], budget: int, total: int) -> DataFrame:
    """Links inside the buckets of rows (rep, k, m, v and the columns that decide)."""
    dealt = rows.repartition("k").sortWithinPartitions("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_keys(batches):
            key, value = part["k"], part["v"].view(np.uint64)
            # a mask's own bits tell buckets of one hash apart, so a clash of hashes links nothing false
            order = np.lexsort((value, part["m"], key))
            key, value, rep, m = key[order], value[order], part["rep"][order], part["m"][order]
            full = np.stack([part[c][order].view(np.uint64) for c in decide_by], 1) if decide_by else value[:, None]
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (m[1:] != m[:-1])))
            label = trie_links(starts, value, full, budget, total)
            at = np.flatnonzero(label != np.arange(len(label)))
            at = at[rep[at] != rep[label[at]]]
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[label[at]])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def whole_keys(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[dict[str, np.ndarray]]:
    """Columns of runs of rows sorted by ``k``; the rows of one key are never parted."""
    held: list[dict[str, np.ndarray]] = []
    count = 0

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
        count += batch.num_rows
        if count < least:
            continue
        rows = joined()
        cut = int(np.searchsorted(rows["k"], rows["k"][-1]))
        if cut:
            yield {c: x[:cut] for c, x in rows.items()}
        held = [{c: x[cut:] for c, x in rows.items()}]
        count = len(held[0]["k"])
    if count:
        yield joined()


def grouped(prints: DataFrame, tables: list[str], decide: list[str], budget: int, total: int, levels: int) -> DataFrame:
    """``prints`` with component_id, the least doc_id of the fingerprints reachable by links."""
    names = list(dict.fromkeys([*tables, *decide]))
    ensure_checkpoint_dir(prints.sparkSession)
    prints = prints.checkpoint()
    classes = prints.groupBy(*names).agg(F.min("doc_id").alias("rep")).checkpoint()
    links = near_links(classes.filter(F.col("rep").isNotNull()), tables, decide, budget, total, levels)
    groups = connected_groups(links)
    named = classes.join(groups, classes.rep == groups.node, "left").select(
        *names, F.coalesce("group", "rep").alias("component_id")
    )
    return prints.join(named.checkpoint(), names)


def simhash_components(docs: DataFrame, size: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints within ``budget`` bits are linked."""
    found = grouped(fingerprints(docs, size), ["f0"], ["f0"], budget, budget, levels=2)
    text = F.lower(F.lpad(F.hex("f0"), 16, "0"))
    return found.select("doc_id", text.alias("fingerprint"), "component_id")

