"""Benchmark decontamination by the q-gram lemma, diagonal bands and banded alignment.

Texts are compared as UTF-8 with A-Z lowered and every run of other ASCII signs and white
space as one blank. Each run of ``WINDOW`` bytes of a benchmark item, at every position, is a
window (a shorter item is one window). A region of a document that matches a window of
m bytes with at most k edits shares at least m - q + 1 - k q of its q-grams, all on
diagonals not more than k apart. Shared q-grams are counted in bands of 2 (k + 1) diagonals
that start every k + 1, so some band holds them all; windows that reach the bound in a band are
aligned there, and kept if the edits stay within k. Windows whose q-grams all follow each
other on one diagonal are verbatim and need no alignment.

A document is contaminated if any window matches. Whole documents are searched: there is no
cap on hits, bands or regions. The benchmark is taken in blocks of a bounded size; each
block is one pass over the documents without a shuffle.

Nulls: null or empty texts match nothing, on either side; so do items of fewer than ``Q``
bytes. Equal rows are each judged; equal items each match. Extra columns are kept by
``drop_contaminated`` whatever their names, and left out by ``leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import bounded_batches, lowered, pieces, utf8

Q = 10
WINDOW = 80
#: Edits allowed for each byte of a window.
EDIT_RATE = 0.075
#: Bytes of benchmark text that one pass holds in memory.
BLOCK_BYTES = 4 << 20
FILTER_BITS = 22
#: Pairs of equal q-grams that are held at once, and what stretches of one document share: no match is longer.
HITS = 1_000_000
OVERLAP = 2 * WINDOW
BASE = 0x9E3779B97F4A7C15
LEAKS = "doc_id long, item_id long, start long, stop long, edits long, n_windows long"

_BLANK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, position of each byte in the source) of the compared form."""
    low = lowered(data)
    blank = _BLANK[low]
    first = np.zeros(len(low), bool)
    first[offsets[:-1][offsets[:-1] < len(low)]] = True
    after = np.append(True, blank[:-1]) | first
    keep = ~(blank & after)
    source = np.flatnonzero(keep)
    out = np.where(blank, 32, low)[source].astype(np.uint8)
    return out, np.concatenate([[0], np.cumsum(keep)])[offsets], source


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes from each position."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        base = np.uint64(BASE)
        one = data.astype(np.uint64) + np.uint64(1)
        two = one[:-1] * base + one[1:]
        b2 = base * base
        four = two[:-2] * b2 + two[2:]
        eight = four[:-4] * (b2 * b2) + four[4:]
        return eight[:n] * b2 + two[8 : 8 + n]


def budget(length: int) -> int:
    """Edits allowed in a window; the lemma's bound stays positive."""
    return max(0, min(int(length * EDIT_RATE), (length - Q) // Q))


@lru_cache(maxsize=4)
def index(texts: tuple[bytes, ...]) -> dict[str, np.ndarray]:
    """The items in one run of bytes, a window at every position of it, and where each q-gram occurs.

    A window is named by its position; ``length`` is 0 where no window of the item begins.
    """
    held, items = [], []
    for i, text in enumerate(texts):
        raw = np.frombuffer(text, np.uint8)
        data, at, _ = plain(raw, np.array([0, len(raw)]))
        data = data.tobytes().strip()
        if len(data) >= Q:
            held.append(data)
            items.append(i)
    size = np.array([len(h) for h in held], np.int64)
    base = np.cumsum(size) - size
    letters = np.frombuffer(b"".join(held) + bytes(WINDOW), np.uint8)
    own = np.repeat(np.arange(len(held), dtype=np.int32), size)
    width = np.minimum(size, WINDOW)
    last = base + size - width
    k = np.array([budget(n) for n in width], np.int64)
    n = int(last[-1]) + 1 if len(held) else 0
    begins = np.arange(n) <= last[own[:n]]
    hashes = [grams(np.frombuffer(h, np.uint8)) for h in held]
    gram = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    offset = np.concatenate([b + np.arange(len(h)) for b, h in zip(base, hashes)]) if hashes else np.zeros(0, np.int64)
    order = np.argsort(gram, kind="stable")
    unique, first = np.unique(gram[order], return_index=True)
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[unique >> np.uint64(64 - FILTER_BITS)] = True
    return {
        "item": np.array(items, np.int64)[own], "length": np.where(begins, width[own[:n]], 0).astype(np.int16), "k": k[own[:n]].astype(np.int16),
        "text": np.lib.stride_tricks.sliding_window_view(letters, WINDOW), "own": own, "base": base, "last": last, "width": width, "budget": k,
        "gram": unique, "first": np.append(first, len(gram)), "offset": offset[order], "maybe": maybe,
    }


def banded(window: np.ndarray, length: np.ndarray, text: np.ndarray, low: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end): best alignment of whole windows on diagonals low .. low + width - 1.

    ``lo`` and ``hi`` bound the document in ``text``; a window may begin on any diagonal.
    """
    column = np.arange(width, dtype=np.int16)
    cost = np.zeros((len(low), width), np.int16)
    best = np.full(len(low), 1 << 30)
    end = np.zeros(len(low), np.int64)
    most = int(length.max())
    at = low[:, None] + np.arange(width + most)
    near = np.where((at >= lo[:, None]) & (at < hi[:, None]), text[np.clip(at, 0, len(text) - 1)], 0).astype(np.uint8)
    for i in range(most):
        step = cost + (near[:, i : i + width] != window[:, i : i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - column, axis=1) + column
        done = length == i + 1
        if done.any():
            where = cost[done].argmin(axis=1)
            best[done] = cost[done][np.arange(done.sum()), where]
            end[done] = low[done] + where + i + 1
    return best, end


def spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the ``many`` numbers from ``first`` on of each row."""
    row = np.repeat(np.arange(len(first)), many)
    return row, np.arange(len(row)) + np.repeat(first - np.cumsum(many) + many, many)


def shared(data: np.ndarray, offsets: np.ndarray, ix: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(position, number of its q-gram) of the q-grams that the benchmark holds too, inside one document each."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = grams(data)
    at = np.flatnonzero(ix["maybe"][gram >> np.uint64(64 - FILTER_BITS)])
    if not len(at) or not len(ix["gram"]):
        return none
    slot = np.searchsorted(ix["gram"], gram[at])
    slot[slot == len(ix["gram"])] = 0
    same = ix["gram"][slot] == gram[at]
    at, slot = at[same], slot[same]
    whole = at + Q <= offsets[np.searchsorted(offsets, at, side="right")]
    return at[whole], slot[whole]


def regions(data: np.ndarray, offsets: np.ndarray, ix: dict[str, np.ndarray], every: bool = True) -> tuple[np.ndarray, ...]:
    """(document, window, start, end, edits) of every match; positions are bytes of the compared form.

    Without ``every``, documents with a verbatim window are not searched further. Texts that repeat
    what the benchmark repeats share a product of q-grams: they are searched in stretches of at most
    ``HITS`` of them, which overlap by more than any match is long, so memory stays bounded; of a window
    that matches often in one stretch, the first start, the last end and the fewest edits are given.
    """
    at, slot = shared(data, offsets, ix)
    upto = np.concatenate([[0], np.cumsum(ix["first"][slot + 1] - ix["first"][slot])])
    if upto[-1] <= HITS:
        return matches(data, offsets, at, slot, ix, every)
    edges = np.searchsorted(at, offsets)
    found: list[tuple[np.ndarray, ...]] = []

    def search(low: int, high: int, cuts: np.ndarray, doc: int) -> tuple[np.ndarray, ...]:
        """Matches of the bytes from low to high, which are the documents ``cuts``."""
        first, last = np.searchsorted(at, [low, max(low, high - Q + 1)])
        d, w, s, e, x = matches(data[low:high], cuts - low, at[first:last] - low, slot[first:last], ix, every)
        return d + doc, w, s + low, e + low, x

    doc = 0
    while doc + 1 < len(offsets):
        # as many whole documents as stay within the bound, else one document by stretches
        last = int(np.searchsorted(upto[edges], upto[edges[doc]] + HITS, side="right")) - 1
        if last > doc:
            found.append(search(int(offsets[doc]), int(offsets[last]), offsets[doc : last + 1], doc))
            doc = last
            continue
        start, stop = int(offsets[doc]), int(offsets[doc + 1])
        while start < stop:
            enough = int(np.searchsorted(upto, upto[np.searchsorted(at, start)] + HITS, side="right")) - 1
            end = int(at[enough]) + Q - 1 if enough < len(at) else stop
            end = min(max(end, start + 2 * OVERLAP), stop)
            d, w, s, e, x = search(start, end, np.array([start, end]), doc)
            if len(w):
                order = np.lexsort((s, w))
                bounds = np.flatnonzero(np.append(True, np.diff(w[order]) != 0))
                s, e, x = (f.reduceat(v[order], bounds) for f, v in ((np.minimum, s), (np.maximum, e), (np.minimum, x)))
                d, w = d[: len(bounds)], w[order][bounds]
            found.append((d, w, s, e, x))
            if end == stop or (not every and len(w)):
                break
            start = end - OVERLAP
        doc += 1
    return tuple(np.concatenate(x) for x in zip(*found))


def matches(
    data: np.ndarray, offsets: np.ndarray, at: np.ndarray, slot: np.ndarray, ix: dict[str, np.ndarray], every: bool
) -> tuple[np.ndarray, ...]:
    """``regions`` of documents whose shared q-grams fit in memory together."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(5))
    doc = np.searchsorted(offsets, at, side="right") - 1
    hit, post = spread(ix["first"][slot], ix["first"][slot + 1] - ix["first"][slot])
    at, doc, spot = at[hit], doc[hit], ix["offset"][post]
    if not len(at):
        return empty
    # q-grams in a row on one diagonal: a window that holds no others is verbatim
    order = np.lexsort((spot, at - spot))
    at, doc, spot = at[order], doc[order], spot[order]
    own, diagonal = ix["own"][spot], at - spot
    ends = np.flatnonzero(np.append((np.diff(diagonal) != 0) | (np.diff(spot) != 1) | (np.diff(own) != 0), True)) + 1
    in_row = ends[np.searchsorted(ends, np.arange(len(at)), side="right")] - np.arange(len(at))
    verbatim = in_row >= ix["width"][own] - Q + 1
    sure = doc[verbatim], spot[verbatim], at[verbatim], at[verbatim] + ix["width"][own[verbatim]], np.zeros(verbatim.sum(), np.int64)
    if not every:
        known = np.zeros(len(offsets), bool)
        known[sure[0]] = True
        rest = ~known[doc]
        at, doc, spot, own, diagonal, verbatim = (x[rest] for x in (at, doc, spot, own, diagonal, verbatim))

    # bands of diagonals, and in each the windows whose count of q-grams reaches the bound
    shift = len(ix["own"]) + 1
    band = (diagonal + shift) // (ix["budget"][own] + 1)
    band, doc, spot, own, verbatim = np.concatenate([band, band - 1]), *(np.concatenate([x, x]) for x in (doc, spot, own, verbatim))
    order = np.lexsort((spot, band, own, doc))
    band, doc, spot, own, verbatim = (x[order] for x in (band, doc, spot, own, verbatim))
    group = np.cumsum(np.append(False, (np.diff(band) != 0) | (np.diff(own) != 0) | (np.diff(doc) != 0))) if len(doc) else doc
    grams_of = ix["width"][own] - Q + 1
    later = np.arange(len(doc)) + grams_of - ix["budget"][own] * Q - 1
    there = np.flatnonzero(later < len(doc))
    other = later[there]
    there, other = (x[(group[there] == group[other]) & (spot[other] - spot[there] < grams_of[there])] for x in (there, other))
    from_ = np.maximum(spot[other] - grams_of[there] + 1, ix["base"][own[there]])
    upto = np.minimum(spot[there], ix["last"][own[there]])
    again = np.flatnonzero(group[there][1:] == group[there][:-1]) + 1
    from_[again] = np.maximum(from_[again], upto[again - 1] + 1)
    row, window = spread(from_, np.maximum(upto - from_ + 1, 0))
    row = there[row]
    size = shift + 1
    new = ~np.isin(group[row] * size + window, group[verbatim] * size + spot[verbatim])
    row, window = row[new], window[new]
    docs, band, k = doc[row], band[row], ix["budget"][own[row]]
    low = band * (k + 1) - shift - k + window
    edits, end = np.zeros(len(window), np.int64), np.zeros(len(window), np.int64)
    for budget_ in np.unique(k):
        mine = np.flatnonzero(k == budget_)
        for part in np.array_split(mine, len(mine) // 4096 + 1):
            w = window[part]
            edits[part], end[part] = banded(
                ix["text"][w], ix["length"][w], data, low[part], offsets[docs[part]], offsets[docs[part] + 1], int(4 * budget_ + 2)
            )
    good = edits <= k
    window, docs, edits, end = window[good], docs[good], edits[good], end[good]
    near = docs, window, np.maximum(end - ix["length"][window], offsets[docs]), end, edits
    return tuple(np.concatenate(x) for x in zip(sure, near))


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items, in blocks of about ``BLOCK_BYTES`` by a hash of their ids."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // BLOCK_BYTES + 1
    dealt = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("b"))
    for b in range(n):
        rows = dealt.filter(F.col("b") == b).collect()
        yield sorted(((r.item_id, r.text.encode()) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it holds text of.

    ``start`` and ``stop`` are the characters from the first to the last matched window,
    within the windows' edits; ``edits`` are those of the best window.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out = spark.createDataFrame([], LEAKS)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    for block in benchmark_blocks(benchmark):
        if block:
            out = out.unionByName(slim.mapInArrow(searcher(block), LEAKS))
    return out


def searcher(block: list[tuple[int, bytes]]):
    ids = [i for i, _ in block]
    texts = tuple(t for _, t in block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index(texts)
        for batch in pieces(batches, "text"):
            raw, at = utf8(batch.column("text"))
            data, offsets, source = plain(raw, at)
            doc, window, start, end, edits = regions(data, offsets, ix)
            found: dict[tuple[int, int], list[int]] = {}
            for d, w, s, e, x in zip(doc.tolist(), window.tolist(), start.tolist(), end.tolist(), edits.tolist()):
                row = found.setdefault((d, int(ix["item"][w])), [s, e, x, set()])
                row[0], row[1], row[2] = min(row[0], s), max(row[1], e), min(row[2], x)
                row[3].add(w)
            char = np.cumsum((raw & 0xC0) != 0x80)
            doc_ids = batch.column("doc_id").to_pylist()
            rows = []
            for (d, item), (s, e, x, ws) in sorted(found.items()):
                before = int(char[at[d] - 1]) if at[d] else 0
                rows.append((doc_ids[d], ids[item], int(char[source[s]]) - 1 - before, int(char[source[e - 1]]) - before, x, len(ws)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            names = ["doc_id", "item_id", "start", "stop", "edits", "n_windows"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark text, all columns as they are; a pass for each block, no shuffle."""
    bounded_batches(docs.sparkSession)
    for block in benchmark_blocks(benchmark):
        if block:
            docs = docs.mapInArrow(keeper(block), docs.schema)
    return docs


def keeper(block: list[tuple[int, bytes]]):
    texts = tuple(t for _, t in block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index(texts)
        for batch in pieces(batches, "text"):
            data, offsets, _ = plain(*utf8(batch.column("text")))
            clean = np.ones(batch.num_rows, bool)
            clean[regions(data, offsets, ix, every=False)[0]] = False
            yield batch.filter(pa.array(clean))

    return run
