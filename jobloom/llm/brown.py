"""Language-model scores from class bigrams after Brown et al.

Word types are clustered by exchange: each type moves to the class that raises the likelihood
of the class bigrams most, until nothing moves. Frequent words are types of their own; all
other words are typed by their last ``SUFFIX`` bytes (rare suffixes share one type), so the
table of type pairs is bounded while the counts cover the whole corpus.

``class_scores`` goes on from there: every other counted word leaves the class of its type for
the class in which its own neighbours raise the likelihood most (``word_classes``). Its counts by
class are made, added up and judged on the cluster, word by word. Then the texts become rows of
classes, of which the class bigrams are counted anew:

    P(w | before) = (1 - MIX) * (c(w) + 1) / (N + V + 1)
                  + MIX * P(class | class before) * (c(w) + 1) / (N_class + V_class + 1)

A word that training lacks has the class of its type. The end mark is alone in its class and
certain there.

``score_texts`` is the plainer form, where all words of a type share its class:

    P(w | before) = (1 - MIX) * (c(w) + 1) / (N + V + 1)
                  + MIX * P(class | class before) * P(type | class) * P(w | type)

P(w | type) is 1 for a word of its own type, else (c(w) + 1) / (N_type + V_type + 1).

In both a text starts after an end mark, and its end counts as a token. Every part sums to one
with one share for unknown words (by classes: one in each class but the end's), as the base does.

What depends on c(w) of an infrequent word is the factor c(w) + 1 alone, and its class. The pass
over the texts does the rest, with a bounded head of frequent words; infrequent tokens are joined
to the counts of the corpus, which never leave the cluster. Tokens are compared as whole bytes,
never by a hash.

Nulls: a null text counts as empty, which is the end mark alone. Without training rows the
base is (0 + 1) / (0 + 0 + 1) and so is the score. Repeated rows are each scored; extra
columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import bounded_batches, in_fold, pieces
from jobloom.session import ensure_checkpoint_dir

#: Words that are types of their own, suffix types, and classes (128 at most, as neighbours are noted in bytes).
OWN, SUFFIXES, CLASSES = 500, 500, 64
#: Frequent words whose counts travel with the tasks.
HEAD = 40_000
SUFFIX = 3
MIX = 0.9
SWEEPS = 12
#: Other words move in parts, one part at a time, and each part this many times (more rounds fit held-out texts less).
PARTS, ROUNDS = 4, 1
#: Bytes of text a task reads at a time, words it counts, or notes the neighbours of, before it hands them on, and rows of a batch.
READ, TOKENS, OUT = 4 << 20, 1 << 21, 1 << 16
_EDGE = b".,;:!?\"'()"


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def suffix_of(word: bytes) -> bytes:
    return word.rstrip(_EDGE)[-SUFFIX:]


@dataclass
class Model:
    """Types: 0 is the end mark, then own words, then suffixes, and the last is for other suffixes."""

    train_tokens: int = 0
    known: int = 0
    ends: int = 0
    own: dict[bytes, int] = field(default_factory=dict)
    suffixes: dict[bytes, int] = field(default_factory=dict)
    head: dict[bytes, int] = field(default_factory=dict)
    classes: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))
    between: np.ndarray = field(default_factory=lambda: np.zeros((2, 2), np.int64))
    change: np.ndarray = field(default_factory=lambda: np.ones((1, 1)))
    emit: np.ndarray = field(default_factory=lambda: np.ones(2))

    @property
    def n_types(self) -> int:
        return 2 + len(self.own) + len(self.suffixes)


class Types(dict):
    """(type, count or -1) of a word packed in one number, remembered for a bounded number of words."""

    def __init__(self, model: Model, limit: int = 200_000) -> None:
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        m = self.model
        kind = m.own.get(word)
        if kind is None:
            kind = m.suffixes.get(suffix_of(word), m.n_types - 1)
        packed = (m.head.get(word, -1) + 1) * (1 << 16) + kind
        self[word] = packed
        return packed


class Kinds:
    """The types of words, many at a time."""

    def __init__(self, model: Model) -> None:
        self.own, self.suffixes = (pa.array(list(words), pa.binary()) for words in (model.own, model.suffixes))

    def of(self, words: pa.Array) -> np.ndarray:
        own = places(words, self.own)
        bare = pc.ascii_rtrim(words.cast(pa.string()), characters=_EDGE.decode()).cast(pa.binary())
        suffix = places(pc.binary_slice(bare, start=-SUFFIX), self.suffixes)
        suffix[suffix < 0] = len(self.suffixes)
        return np.where(own >= 0, 1 + own, 1 + len(self.own) + suffix)


def places(values: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each value stands in a list, or -1."""
    return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy().astype(np.int64)


def split(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts of a batch as ``words_of`` has them, and where each text starts if an end follows every text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
    words = lists.flatten()
    text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    # white space at the edges leaves empty strings
    some = pc.greater(pc.binary_length(words), 0)
    count = np.bincount(text[some.to_numpy(zero_copy_only=False)], minlength=len(lists))
    return words.filter(some).cast(pa.binary()), np.append(0, np.cumsum(count + 1))


def in_line(values: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """A value for each word and each end."""
    line = np.full(first[-1], end, values.dtype)
    inside = np.ones(len(line), bool)
    inside[first[1:] - 1] = False
    line[inside] = values
    return line


def octets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column made of bytes and offsets."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch as several of ``OUT`` rows."""
    for start in range(0, batch.num_rows, OUT):
        yield batch.slice(start, OUT)


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, suffix, c): occurrences of every word; each task adds up what it sees first."""
    bounded_batches(texts.sparkSession)

    def batch_of(words: list[pa.Array]) -> pa.RecordBatch:
        found = pc.value_counts(pa.chunked_array(words, pa.binary()))
        return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[pa.Array] = []
        for batch in pieces(batches, "text", READ):
            words.append(split(batch)[0])
            if sum(map(len, words)) >= TOKENS:
                yield from in_parts(batch_of(words))
                words = []
        yield from in_parts(batch_of(words))

    return texts.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def suffix_column() -> F.Column:
    """The SQL form of ``suffix_of``, over a binary column ``token``."""
    edge = "".join(chr(b) for b in _EDGE)
    # as Latin-1 each byte is one sign, so trimming and cutting work on bytes
    bare = F.rtrim(F.decode("token", "ISO-8859-1"), F.lit(edge))
    return F.encode(F.right(bare, F.lit(SUFFIX)), "ISO-8859-1")


def head_limit(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words have it or more."""
    step = F.floor(F.log2("c") * 8)
    found = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect()
    total, limit = 0, None
    for row in sorted(found, key=lambda r: -r.s):
        total += row.n
        if total > most:
            break
        limit = row.c
    return limit if limit is not None else (1 << 62)


def bigrams(texts: DataFrame, model: Model) -> np.ndarray:
    """Counts of type pairs over all training texts."""
    size = model.n_types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds(model)
        total = np.zeros(size * size, np.int64)
        for batch in pieces(batches, "text", READ):
            words, first = split(batch)
            met = words.dictionary_encode()
            line = np.append(0, in_line(kinds.of(met.dictionary)[met.indices.to_numpy()], first, 0))
            total += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    found = texts.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each type; the end mark (type 0) keeps class 0 to itself."""
    size = len(pairs)
    n = pairs.astype(np.float64)
    classes = max(2, min(classes, size))
    weight = n.sum(axis=0) + n.sum(axis=1)
    member = np.zeros(size, np.int64)
    order = np.argsort(-weight[1:], kind="stable") + 1
    member[order] = 1 + np.arange(size - 1) % (classes - 1)
    onehot = np.eye(classes)[member]
    after, before = n @ onehot, n.T @ onehot  # counts of each type with each class on its right, on its left
    between = onehot.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in order:
            own, loop = member[w], n[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[own] -= loop
            left[own] -= loop
            between[own] -= right
            between[:, own] -= left
            between[own, own] -= loop
            # what each class would gain: its row and column of the class table, and its margins
            diagonal = np.diag(between)
            rows = xlogx(between + right).sum(axis=1) - xlogx(between).sum(axis=1)
            columns = xlogx(between + left[:, None]).sum(axis=0) - xlogx(between).sum(axis=0)
            twice = xlogx(diagonal + right) + xlogx(diagonal + left) - xlogx(diagonal) - xlogx(diagonal + right + left + loop)
            out, into = between.sum(axis=1), between.sum(axis=0)
            margins = xlogx(out + right.sum() + loop) - xlogx(out) + xlogx(into + left.sum() + loop) - xlogx(into)
            gain = rows + columns - twice - margins
            gain[0] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            between[best] += right
            between[:, best] += left
            between[best, best] += loop
            if best != own:
                moved += 1
                member[w] = best
                after[:, own] -= n[:, w]
                after[:, best] += n[:, w]
                before[:, own] -= n[w]
                before[:, best] += n[w]
        if not moved:
            break
    return member


def train(texts: DataFrame, counts: DataFrame, head_count: int) -> Model:
    """Clusters the types and estimates the class model from training texts and their counts.

    Words beyond the own types are clustered one by one in ``word_classes``.
    """
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = texts.count()
    if not ends:
        return Model()
    model = Model(train_tokens=(totals.n or 0) + ends, known=totals.v + 1, ends=ends)
    rows = counts.filter(F.col("c") >= head_count).select("token", "c").collect()
    # where too many words are equally frequent the head is short or empty, but own types are picked all the same
    own = counts.orderBy(F.desc("c"), "token").select("token", "c").limit(OWN).collect()
    model.head = {bytes(r.token): r.c for r in [*rows, *own]}
    frequent = [bytes(r.token) for r in own]
    model.own = {w: i + 1 for i, w in enumerate(frequent)}
    others = counts.filter(~F.col("token").isin(frequent)) if frequent else counts
    by_suffix = others.groupBy(suffix_column().alias("suffix")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    rest = others.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = by_suffix.orderBy(F.desc("n"), "suffix").limit(SUFFIXES).collect()
    model.suffixes = {bytes(r.suffix): 1 + len(frequent) + i for i, r in enumerate(top)}
    pairs = bigrams(texts, model)
    member = exchange(pairs)
    size = int(member.max()) + 1
    onehot = np.eye(size)[member]
    between = onehot.T @ pairs @ onehot
    of_type = pairs.sum(axis=0).astype(np.float64)
    of_class = onehot.T @ of_type
    # add-one over types within a class, so that every type can be met
    emit = (of_type + 1) / (of_class + onehot.sum(axis=0))[member]
    prior = (of_class + 1) / (of_class + 1).sum()
    model.classes, model.between = member, between.astype(np.int64)
    model.change = (between + 10 * prior) / (between.sum(axis=1, keepdims=True) + 10)
    known = np.zeros(model.n_types)
    for i, r in enumerate(top):
        known[1 + len(frequent) + i] = r.n + r.v + 1
    known[-1] = rest.n - sum(r.n for r in top) + rest.v - sum(r.v for r in top) + 1
    known[: 1 + len(frequent)] = 1
    model.emit = emit / known
    return model


def local_scores(texts: DataFrame, model: Model) -> DataFrame:
    """One row per text with what needs no counts, and one per infrequent word of it.

    (key, rid, doc_id, held_out, n, n_known, ones, mixed, tf): ``key`` is the word, or for a text's own row a
    blank and its number, which no word can be. ``ones`` sums log10(c + 1) over the head,
    ``mixed`` all of the score but log10(c + 1) of infrequent words.
    """
    flat = (1 - MIX) / (model.train_tokens + model.known + 1) if model.ends else 1.0
    mix = MIX if model.ends else 0.0
    table = mix * model.change
    own_types = 1 + len(model.own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = Types(model)
        for batch in pieces(batches, "text", 1 << 20):
            out: list[list] = [[] for _ in range(9)]
            columns = [batch.column(c).to_pylist() for c in ("rid", "doc_id", "held_out", "text")]
            for rid, doc_id, held, text in zip(*columns):
                words = words_of(text)
                packed = np.array([types[w] for w in words], np.int64)
                kind = np.append(packed & 0xFFFF, 0)
                count = np.append((packed >> 16) - 1, model.ends)
                cls = model.classes[kind]
                p = table[np.append(0, cls[:-1]), cls] * model.emit[kind]
                grown = np.where(count >= 0, count + 1.0, 1.0)
                # an own word is certain given its type; for others c + 1 is a factor of both parts
                apart = kind < own_types
                score = np.where(apart, np.log10(p + flat * grown), np.log10(p + flat) + np.log10(grown))
                for column, value in zip(
                    out,
                    (b" %d" % rid, rid, doc_id, held, len(kind), int((count > 0).sum()), float(np.log10(grown).sum()), float(score.sum()), 0),
                ):
                    column.append(value)
                tail = Counter(w for w, c in zip(words, count.tolist()) if c < 0)
                k = len(tail)
                for column, value in zip(out, (list(tail), [rid] * k, [None] * k, [None] * k, [0] * k, [0] * k, [0.0] * k, [0.0] * k, list(tail.values()))):
                    column.extend(value)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
            names = ["key", "rid", "doc_id", "held_out", "n", "n_known", "ones", "mixed", "tf"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    schema = "key binary, rid long, doc_id long, held_out boolean, n long, n_known long, ones double, mixed double, tf long"
    return texts.mapInArrow(run, schema)


def score_texts(docs: DataFrame, folds: int = 7, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every text."""
    bounded_batches(docs.sparkSession)
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold("doc_id", folds, rest).alias("held_out"), "text")
    training = rows.filter("not held_out").select("text")
    counts = token_counts(training).checkpoint()
    limit = head_limit(counts, HEAD)
    model = train(training, counts, limit)
    parts = local_scores(rows.withColumn("rid", F.monotonically_increasing_id()), model)
    tail = counts.filter(F.col("c") < limit).withColumnRenamed("token", "key")
    met = parts.join(tail, "key", "left")
    grown = F.col("tf") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1)
    per_text = met.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("ones") + grown).alias("ones"),
        F.sum(F.col("mixed") + grown).alias("score"),
    )
    floor = float(np.log10(model.train_tokens + model.known + 1))
    return per_text.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("ones") - F.col("n_tokens") * floor).alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


class Gains:
    """What the likelihood of class bigrams gains when one word moves, by the counts of classes met beside each class.

    ``cells`` has a row for each class before and then for each class after, and a column for each class of the word.
    """

    def __init__(self, cells: np.ndarray) -> None:
        self.size = cells.shape[1]
        self.cells = cells.astype(np.float64)
        self.totals = self.cells.reshape(2, self.size, self.size).sum(axis=1)
        self.cells_once, self.totals_once = (xlogx(x + 1) - xlogx(x) for x in (self.cells, self.totals))

    @staticmethod
    def grown(table: np.ndarray, once: np.ndarray, row: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
        """What n more in a row of the table adds to each of its cells; in the start's, where they are, what they add now."""
        out = once[row]
        many = np.flatnonzero(n > 1)
        cells = table[row[many]]
        out[many] = xlogx(cells + n[many, None]) - xlogx(cells)
        here = table[row, start]
        out[np.arange(len(row)), start] = xlogx(here) - xlogx(here - n)
        return out

    def best(self, start: np.ndarray, word: np.ndarray, side: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The best class of each word, that in which it starts among equals; class 0 is for the end mark alone.

        ``word`` numbers the words from 0 on, in order; ``side`` is a row of the cells, and ``n`` how often that is met.
        """
        gain = np.add.reduceat(
            self.grown(self.cells, self.cells_once, side, n, start[word]), np.flatnonzero(np.diff(word, prepend=-1)), axis=0
        )
        c = np.bincount(word, weights=n * (side < self.size)).astype(np.int64)
        for i in (0, 1):
            gain -= self.grown(self.totals, self.totals_once, np.full(len(c), i), c, start)
        gain[:, 0] = -np.inf
        best = gain.argmax(axis=1)
        at = np.arange(len(c))
        return np.where(gain[at, best] > gain[at, start] + 1e-9, best, start)


def neighbours(texts: DataFrame, model: Model) -> DataFrame:
    """(token, start, around): words that are not their own type, the class of their type, and the classes around them.

    ``around`` has two bytes for each occurrence: the class before and the class after.
    """
    own_types = 1 + len(model.own)
    classes = model.classes.astype(np.uint8)

    def batch_of(words: list[pa.Array], starts: list[np.ndarray], arounds: list[np.ndarray]) -> pa.RecordBatch:
        met = pa.chunked_array(words, pa.binary()).combine_chunks().dictionary_encode()
        which = met.indices.to_numpy()
        order = np.argsort(which, kind="stable")
        first = np.append(0, np.cumsum(np.bincount(which, minlength=len(met.dictionary))))
        start = np.concatenate([*starts, np.zeros(0, np.uint8)])[order[first[:-1]]].astype(np.int32)
        around = np.concatenate([*arounds, np.zeros((0, 2), np.uint8)])[order]
        return pa.RecordBatch.from_arrays([met.dictionary, pa.array(start), binary(around, 2 * first)], ["token", "start", "around"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, held = Kinds(model), ([], [], [])
        for batch in pieces(batches, "text", READ):
            words, first = split(batch)
            met = words.dictionary_encode()
            kind = kinds.of(met.dictionary)[met.indices.to_numpy()]
            line = in_line(classes[kind], first, 0)
            other = kind >= own_types
            at = np.flatnonzero(in_line(other, first, False))
            # an end comes last, so it also stands before the first token
            for kept, part in zip(held, (words.filter(pa.array(other)), line[at], np.stack([line[at - 1], line[at + 1]], axis=1))):
                kept.append(part)
            if sum(map(len, held[0])) >= TOKENS:
                yield from in_parts(batch_of(*held))
                held = ([], [], [])
        yield from in_parts(batch_of(*held))

    return texts.select("text").mapInArrow(run, "token binary, start int, around binary")


def contexts(texts: DataFrame, model: Model) -> DataFrame:
    """(token, start, side, n) of every word of the training texts that is not its own type.

    ``side`` has a byte for each class met before the word and, counted on from the number of classes, for
    each class after it; ``n`` has how often.
    """
    size = len(model.between)
    sides = 2 * size

    def batch_of(words: pa.Array, start: np.ndarray, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        word, side = np.divmod(cell, sides)
        at = np.searchsorted(word, np.arange(len(words) + 1))
        times = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(n, pa.int64()))
        return pa.RecordBatch.from_arrays([words, pa.array(start), binary(side.astype(np.uint8), at), times], ["token", "start", "side", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last word so far, which the next rows may go on with: (word, start, cells, n)
        for batch in batches:
            if not batch.num_rows:
                continue
            token, start = batch.column("token"), batch.column("start").to_numpy()
            new = np.append(True, pc.not_equal(token.slice(1), token.slice(0, len(token) - 1)).to_numpy(zero_copy_only=False))
            data, at = octets(batch.column("around"))
            word = np.repeat(np.cumsum(new) - 1, np.diff(at) // 2) * sides
            cell, n = np.unique(np.concatenate([word + data[::2], word + size + data[1::2]]), return_counts=True)
            words, start = token.filter(pa.array(new)), start[new]
            if last is not None:
                if last[0].equals(words.slice(0, 1)):
                    cell, back = np.unique(np.concatenate([last[2], cell]), return_inverse=True)
                    n = np.bincount(back, weights=np.concatenate([last[3], n])).astype(np.int64)
                else:
                    words, start = pa.concat_arrays([last[0], words]), np.append(last[1], start)
                    cell, n = np.append(last[2], cell + sides), np.append(last[3], n)
            kept = len(words) - 1
            done = cell < kept * sides
            last = (words.slice(kept), start[kept:], cell[~done] - kept * sides, n[~done])
            yield batch_of(words.slice(0, kept), start[:kept], cell[done], n[done])
        if last is not None:
            yield batch_of(*last)

    met = neighbours(texts, model).repartition("token").sortWithinPartitions("token")
    return met.mapInArrow(run, "token binary, start int, side binary, n array<long>")


def word_classes(texts: DataFrame, model: Model) -> DataFrame:
    """(token, c, class) of every word of the training texts that is not its own type.

    The classes met beside a word are those of the types, and stay. Words move in turns, a part of them at a
    time, because words that see one table together follow each other. A turn is a job over its part that sums
    up what its moves change in the cells. Where a word stands follows from its contexts and the cells before
    each turn of its part, so nothing is kept for a word between turns.
    """
    size = len(model.between)
    part = F.pmod(F.xxhash64("token"), F.lit(PARTS)).cast("int")
    met = contexts(texts, model).checkpoint()

    def walk(batch: pa.RecordBatch, turns: list[Gains]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(class, word, side, n) from the start on, after each turn."""
        side, at = octets(batch.column("side"))
        word = np.repeat(np.arange(batch.num_rows), np.diff(at))
        n = batch.column("n").flatten().to_numpy()
        now = batch.column("start").to_numpy().astype(np.int64)
        yield now, word, side, n
        for gains in turns:
            now = gains.best(now, word, side, n)
            yield now, word, side, n

    def moves(rows: DataFrame, turns: list[np.ndarray]) -> np.ndarray:
        """What the last of the turns changes in the cells."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gains = [Gains(cells) for cells in turns]
            change = np.zeros(2 * size * size, np.int64)
            for batch in batches:
                if batch.num_rows:
                    *_, (old, *_), (now, word, side, n) = walk(batch, gains)
                    gone = (now != old)[word]
                    for where, by in ((now, n), (old, -n)):
                        np.add.at(change, side[gone].astype(np.int64) * size + where[word[gone]], by[gone])
            at = np.flatnonzero(change)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(change[at])], ["cell", "n"])

        out = np.zeros(2 * size * size, np.int64)
        for r in rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            out[r.cell] = r.n
        return out.reshape(2 * size, size)

    cells = [np.concatenate([model.between, model.between.T])]
    for turn in range(ROUNDS * PARTS - 1):
        own = turn % PARTS
        cells.append(cells[-1] + moves(met.filter(part == own), cells[own::PARTS]))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = [Gains(table) for table in cells]
        for batch in batches:
            which = batch.column("part").to_numpy()
            for own in range(PARTS):
                rows = batch.filter(pa.array(which == own))
                if rows.num_rows:
                    *_, (now, word, side, n) = walk(rows, gains[own::PARTS])
                    c = np.bincount(word, weights=n * (side < size)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([rows.column("token"), pa.array(c), pa.array(now.astype(np.int32))], ["token", "c", "class"])

    return met.withColumn("part", part).mapInArrow(settle, "token binary, c long, class int")


def class_rows(texts: DataFrame, model: Model, head: dict[bytes, tuple[int, int]], tail: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_known, ones, line) of every text: ``line`` is the class of each token, a byte each.

    ``head`` has the count and class of frequent words, ``tail`` (token, c, class) of all others.
    ``ones`` sums log10(c + 1) over the tokens.
    """
    of_text = pa.struct(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_known", pa.int64()), ("ones", pa.float64()), ("line", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds(model)
        frequent = pa.array(list(head), pa.binary())
        counts, classes = (np.array([v[i] for v in head.values()] or [0], np.int64) for i in (0, 1))
        names = ["key", "rid", "at", "text"]
        for batch in pieces(batches, "text", READ):
            words, first = split(batch)
            met = words.dictionary_encode()
            which, place = met.indices.to_numpy(), places(met.dictionary, frequent)
            cls = np.where(place >= 0, classes[place], model.classes[kinds.of(met.dictionary)]).astype(np.uint8)
            count = in_line(np.where(place >= 0, counts[place], -1)[which], first, model.ends)
            rid = batch.column("rid")
            ones = np.add.reduceat(np.log10(np.maximum(count, 0) + 1.0), first[:-1])
            found = np.add.reduceat((count > 0).astype(np.int64), first[:-1])
            line = binary(in_line(cls[which], first, 0), first)
            parts = [batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array(ones), line]
            texts = pa.StructArray.from_arrays(parts, fields=list(of_text))
            keys = pa.array([b" %d" % r for r in rid.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, rid, pa.nulls(len(rid), pa.int64()), texts], names)
            rare = np.flatnonzero(count < 0)
            text = np.searchsorted(first, rare, side="right") - 1
            others = words.filter(pa.array((place < 0)[which]))
            yield from in_parts(
                pa.RecordBatch.from_arrays([others, rid.take(pa.array(text)), pa.array(rare - first[text]), pa.nulls(len(rare), of_text)], names)
            )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, at = octets(batch.column("line"))
            line = line.copy()
            told = batch.column("told")
            each = told.flatten().to_numpy()
            line[np.repeat(at[:-1], told.value_lengths().to_numpy()) + (each >> 8)] = each & 0xFF
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], binary(line, at)], [*batch.schema.names[:4], "line"])

    schema = "key binary, rid long, at long, text struct<doc_id: long, held_out: boolean, n_known: long, ones: double, line: binary>"
    met = texts.mapInArrow(run, schema).join(tail.withColumnRenamed("token", "key"), "key", "left")
    per_text = met.groupBy("rid").agg(
        F.first("text", ignorenulls=True).alias("text"),
        F.count("c").alias("met"),
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("more"),
        # words that training lacks have no class to tell
        F.collect_list(F.col("at") * 256 + F.col("class")).alias("told"),
    )
    known, ones = F.col("text.n_known") + F.col("met"), F.col("text.ones") + F.col("more")
    whole = per_text.select("text.doc_id", "text.held_out", known.alias("n_known"), ones.alias("ones"), "text.line", "told")
    return whole.mapInArrow(fill, "doc_id long, held_out boolean, n_known long, ones double, line binary")


def class_pairs(lines: DataFrame, size: int) -> np.ndarray:
    """Counts of class pairs over rows of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            line = np.append(0, octets(batch.column("line"))[0]).astype(np.int64)
            total += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    found = lines.select("line").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size * size, np.int64)
    for r in found:
        out[r.pair] = r.n
    return out.reshape(size, size)


def class_scores(docs: DataFrame, folds: int = 7, rest: int = 2) -> DataFrame:
    """The columns of ``score_texts``, with a class of its own choice for every counted word."""
    bounded_batches(docs.sparkSession)
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold("doc_id", folds, rest).alias("held_out"), "text")
    training = rows.filter("not held_out").select("text")
    counts = token_counts(training).checkpoint()
    limit = head_limit(counts, HEAD)
    model = train(training, counts, limit)
    size = len(model.between)
    words = word_classes(training, model).checkpoint()
    own = {w: (model.head[w], int(model.classes[kind])) for w, kind in model.own.items()}
    head = own | {bytes(r.token): (r.c, r["class"]) for r in words.filter(F.col("c") >= limit).collect()}
    numbered = rows.withColumn("rid", F.monotonically_increasing_id())
    lines = class_rows(numbered, model, head, words.filter(F.col("c") < limit)).checkpoint()

    # tokens and words of each class, and one share for unknown words, which the end has not
    share = np.ones(size)
    for r in words.groupBy("class").agg((F.sum("c") + F.count(F.lit(1))).alias("n")).collect():
        share[r["class"]] += r.n
    for c, kind in own.values():
        share[kind] += c + 1
    share[0] = model.ends + 1
    between = class_pairs(lines.filter("not held_out"), size)
    prior = (between.sum(axis=0) + 1) / (between.sum() + size)
    change = (between + 10 * prior) / (between.sum(axis=1, keepdims=True) + 10)
    flat = (1 - MIX) / (model.train_tokens + model.known + 1) if model.ends else 1.0
    table = np.log10(flat + (MIX if model.ends else 0.0) * change / share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                line, at = octets(batch.column("line"))
                fit = np.add.reduceat(table[np.append(0, line[:-1]), line], at[:-1])
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(at)), pa.array(fit)], [*batch.schema.names[:4], "n_tokens", "fit"])

    scored = lines.mapInArrow(run, "doc_id long, held_out boolean, n_known long, ones double, n_tokens long, fit double")
    floor = float(np.log10(model.train_tokens + model.known + 1))
    score = F.col("ones") + F.col("fit")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("ones") - F.col("n_tokens") * floor).alias("base_score"), score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
