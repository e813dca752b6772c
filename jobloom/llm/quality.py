"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence is its own features and those of the lines
before and after it; transition weights tie neighbours together. Forward-backward gives each
line's probability of being good; their mean, weighted by line length, is the document's raw
quality, which a logistic fit on the training sample turns into the probability of label 1.

Training lines carry their document's label. The sample is bounded: about ``per_class``
labelled documents of each class, whole; the class sizes of all labelled rows restore the
true balance. All documents are scored whole, whatever their number of lines.

Nulls: a null text counts as empty; an empty text is one empty line. Unlabelled rows and
rows with a null label are not learned from; with fewer than two classes every score is the
share of label 1 (1.0 without labels), so that nothing is rejected blindly. Repeated rows
are each scored. ``keep_good`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import bounded_batches, in_fold, pieces, seeded_share, utf8

PER_CLASS = 1500
#: Documents at or above this probability of label 1 are kept.
THRESHOLD = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_lines long, good_lines double"
N_FEATURES = 18

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SPACE = np.isin(_BYTE, [32, *range(9, 14)])
_STOP = np.isin(_BYTE, [ord(c) for c in ".,;:!?"])
_SIGN = ~(_LETTER | _DIGIT | _SPACE | _STOP)
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


@dataclass
class Model:
    weights: np.ndarray
    change: np.ndarray
    scale: float
    shift: float
    share: float


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length, first line of each text) of the lines of every text."""
    texts = len(offsets) - 1
    inner = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], inner + 1]))
    first = np.searchsorted(starts, offsets[:-1], side="left")
    # a break that ends a text opens one more, empty, line of that same text
    n = np.diff(np.append(np.searchsorted(inner, offsets[:-1]), len(inner))) + 1
    owner = np.repeat(np.arange(texts), n)
    first = np.cumsum(n) - n
    starts = np.zeros(len(owner), np.int64)
    starts[first] = offsets[:-1]
    later = np.ones(len(owner), bool)
    later[first] = False
    starts[later] = inner + 1
    stops = np.append(starts[1:] - 1, len(data))
    last = np.append(first[1:], len(owner)) - 1
    stops[last] = offsets[1:]
    length = stops - starts

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[stops] - total[starts]).astype(np.float64)

    space = _SPACE[data]
    begin = ~space
    edge = np.ones(len(data), bool)
    edge[1:] = space[:-1]
    edge[starts[starts < len(data)]] = True
    begin &= edge
    word_at = np.flatnonzero(begin)
    words = per_line(begin)
    repeated = np.zeros(len(owner))
    short = np.zeros(len(owner))
    if len(word_at):
        number = np.cumsum(begin) - 1
        place = np.arange(len(data)) - word_at[np.maximum(number, 0)]
        with np.errstate(over="ignore"):
            value = np.where(space, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63])
            code = np.add.reduceat(value, word_at)
        size = np.add.reduceat((~space).astype(np.int64), word_at)
        line = np.searchsorted(starts, word_at, side="right") - 1
        again = np.zeros(len(word_at), bool)
        for back in (1, 2, 3):
            again[back:] |= (code[back:] == code[:-back]) & (line[back:] == line[:-back])
        repeated = np.bincount(line, again, len(owner))
        short = np.bincount(line, size <= 3, len(owner))
    letters = per_line(_LETTER[data])
    long_ = np.maximum(length, 1)
    many = np.maximum(words, 1)
    tail = np.zeros(len(owner))
    head = np.zeros(len(owner))
    full = length > 0
    tail[full] = _STOP[data[stops[full] - 1]]
    head[full] = _UPPER[data[starts[full]]]
    lonely = np.maximum(per_line(_SIGN[data] & edge), 0)
    columns = [
        np.log1p(length) / 6, letters / long_, per_line(_UPPER[data]) / long_ * 5, per_line(_DIGIT[data]) / long_ * 3,
        per_line(space) / long_ * 3, per_line(_STOP[data]) / long_ * 8, per_line(_SIGN[data]) / long_ * 5, np.log1p(words) / 5,
        np.minimum(letters / many / 12, 3), repeated / many, short / many, tail, head, lonely / many,
        (length == 0).astype(float), (words == 1).astype(float), np.minimum(words / 100, 2), (repeated > 2).astype(float),
    ]
    return np.stack(columns, 1).astype(np.float32), length, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features, marks for the ends of a text, and a constant."""
    start = np.zeros(len(x), bool)
    start[first] = True
    end = np.append(start[1:], True)
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[start], after[end] = 0, 0
    return np.concatenate([x, before, after, start[:, None], end[:, None], np.ones((len(x), 1))], 1).astype(np.float32)


def marginals(emit: np.ndarray, n: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of each line, expected transitions, log partition of each text).

    ``emit`` is the good state's score of all lines in order (bad is 0), ``n`` the lines of
    each text. Texts run side by side, longest first, so one long text costs only itself.
    """
    texts = len(n)
    first = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    live = np.searchsorted(-n[order], -np.arange(1, n.max() + 1), side="right")
    forward = np.zeros((len(emit), 2))
    backward = np.zeros((len(emit), 2))
    for t in range(int(n.max())):
        at = first[order[: live[t]]] + t
        if t:
            a = forward[at - 1]
            forward[at, 0] = np.logaddexp(a[:, 0] + change[0, 0], a[:, 1] + change[1, 0])
            forward[at, 1] = np.logaddexp(a[:, 0] + change[0, 1], a[:, 1] + change[1, 1])
        forward[at, 1] += emit[at]
    for t in range(int(n.max()) - 2, -1, -1):
        at = first[order[: live[t + 1]]] + t
        b0, b1 = backward[at + 1, 0], backward[at + 1, 1] + emit[at + 1]
        backward[at, 0] = np.logaddexp(b0 + change[0, 0], b1 + change[0, 1])
        backward[at, 1] = np.logaddexp(b0 + change[1, 0], b1 + change[1, 1])
    last = first + n - 1
    log_z = np.logaddexp(forward[last, 0], forward[last, 1])
    owner = np.repeat(np.arange(texts), n)
    both = forward + backward - log_z[owner, None]
    good = np.exp(both[:, 1])
    inner = np.ones(len(emit), bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    pairs = np.zeros((texts, 2, 2))
    for i in range(2):
        for j in range(2):
            p = forward[at, i] + change[i, j] + backward[at + 1, j] + (emit[at + 1] if j else 0) - log_z[owner[at]]
            pairs[:, i, j] = np.bincount(owner[at], np.exp(p), texts)
    return good, pairs, log_z


def fit(x: np.ndarray, n: np.ndarray, label: np.ndarray, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights by Adam on the conditional likelihood; each text weighs the same."""
    owner = np.repeat(np.arange(len(n)), n)
    weight = (1.0 / n / len(n))[owner]
    w, change = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = [np.zeros_like(w), np.zeros_like(change)], [np.zeros_like(w), np.zeros_like(change)]
    gold = np.zeros((len(n), 2, 2))
    gold[np.arange(len(n)), label, label] = n - 1
    for t in range(1, rounds + 1):
        good, pairs, _ = marginals(x @ w, n, change)
        steps = (x.T @ ((good - label[owner]) * weight) + decay * w, ((pairs - gold) / n[:, None, None]).mean(axis=0) + 10 * decay * change)
        for i, (p, g) in enumerate(zip((w, change), steps)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return w, change


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def pooled(good: np.ndarray, length: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean line probability of each text, weighted by line length plus one."""
    owner = np.repeat(np.arange(len(n)), n)
    weight = length + 1.0
    return np.bincount(owner, good * weight, len(n)) / np.bincount(owner, weight, len(n))


def calibrate(raw: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 300) -> tuple[float, float]:
    """Scale and shift of the raw log-odds that fit the labels best; the scale is not negative."""
    z, a, b = logit(raw), 1.0, 0.0
    weight = weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r = weight * (p - label)
        h = weight * p * (1 - p)
        haa, hab, hbb = (h * z * z).sum() + 1e-4, (h * z).sum(), h.sum() + 1e-4
        ga, gb = (r * z).sum() + 1e-4 * (a - 1), r.sum() + 1e-4 * b
        det = haa * hbb - hab * hab
        a, b = max(0.05, a - 0.5 * (hbb * ga - hab * gb) / det), b - 0.5 * (haa * gb - hab * ga) / det
    return float(a), float(b)


def sample_lines(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x, length, first = line_features(*utf8(batch.column("text")))
            offsets = pa.array(np.append(first, len(x)).astype(np.int32))
            flat = pa.ListArray.from_arrays(pa.array(np.append(first, len(x)).astype(np.int32) * N_FEATURES), pa.array(x.ravel()))
            sizes = pa.ListArray.from_arrays(offsets, pa.array(length.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("label"), sizes, flat], ["label", "length", "x"])

    return rows.mapInArrow(run, "label int, length array<bigint>, x array<float>")


def train(sample: DataFrame, sizes: dict[int, int]) -> Model:
    """Fits on a bounded sample (doc_id, text, label); ``sizes`` are those of the whole classes."""
    bounded_batches(sample.sparkSession)
    rows = sample_lines(sample.select("text", "label")).toArrow() if len(sizes) == 2 else None
    if rows is None or len(set(rows.column("label").to_pylist())) < 2:
        return Model(np.zeros(3 * N_FEATURES + 3), np.zeros((2, 2)), 0.0, 0.0, float(0 not in sizes))
    found = sorted(
        ((lab, np.array(ln, np.int64), np.array(xs, np.float32)) for lab, ln, xs in zip(*(c.to_pylist() for c in rows.columns))),
        key=lambda r: (r[0], len(r[1]), r[1].tolist()),
    )
    label = np.array([r[0] for r in found], np.int64)
    n = np.array([len(r[1]) for r in found], np.int64)
    length = np.concatenate([r[1] for r in found])
    x = np.concatenate([r[2] for r in found]).reshape(-1, N_FEATURES)
    wide = with_neighbours(x, np.cumsum(n) - n)
    weights, change = fit(wide, n, label)
    raw = pooled(marginals(wide @ weights, n, change)[0], length, n)
    balance = np.array([sizes[0] / max(1, (label == 0).sum()), sizes[1] / max(1, (label == 1).sum())])
    scale, shift = calibrate(raw, label, balance[label])
    return Model(weights, change, scale, shift, sizes[1] / (sizes[0] + sizes[1]))


def scored(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of label 1, lines, share of good lines) of each text."""
    x, length, first = line_features(*utf8(text))
    n = np.diff(np.append(first, len(x)))
    good = marginals(with_neighbours(x, first) @ model.weights, n, model.change)[0]
    raw = pooled(good, length, n)
    p = 1 / (1 + np.exp(-(model.scale * logit(raw) + model.shift)))
    return p if model.scale else np.full(len(n), model.share), n, raw


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines, good_lines) of rows (doc_id, held_out, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            p, n, raw = scored(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)),
                    pa.array(n), pa.array(raw),
                ],
                ["doc_id", "held_out", "score", "predicted", "n_lines", "good_lines"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, SCHEMA)


def known_labels(labels: DataFrame, label: str, folds: int, rest: int) -> DataFrame:
    """(doc_id, label) outside the held-out fold, one row for each doc_id: with several labels the largest counts."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    return known.filter(~in_fold("doc_id", folds, rest)).groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, rest: int, per_class: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """((doc_id, text, label) of a seeded sample outside the held-out fold, size of each class).

    The sample is drawn from the ids, so its size is bounded before any text is read: about
    ``per_class`` ids of each class. Only those ids are broadcast; texts are not shuffled. Where
    the ids stand for many more rows than that, rows are drawn once more, by id and text, to twice
    as many at most, and equal rows count once. A doc_id with several labels counts as the largest.
    """
    known = known_labels(labels, label, folds, rest)
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    zero, one = (min(1.0, per_class / sizes.get(c, 1)) for c in (0, 1))
    picked = known.filter(seeded_share("doc_id", seed=seed) < F.when(F.col("label") == 0, zero).otherwise(one))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")
    held = {r.label: r.n for r in docs.select("doc_id").join(F.broadcast(picked), "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if max(held.values(), default=0) <= 2 * per_class:
        return rows, sizes
    zero, one = (min(1.0, 2 * per_class / held.get(c, 1)) for c in (0, 1))
    again = rows.withColumn("draw", seeded_share("doc_id", "text", seed=seed + 1)).filter(F.col("draw") < F.when(F.col("label") == 0, zero).otherwise(one))
    return again.groupBy("doc_id", "label", "draw").agg(F.min("text").alias("text")).select("doc_id", "text", "label"), sizes


def assess(docs: DataFrame, labels: DataFrame, folds: int = 5, rest: int = 0, per_class: int = PER_CLASS) -> DataFrame:
    """Learns from labelled rows outside the held-out fold and scores every document."""
    model = train(*labelled_sample(docs, labels, "quality", folds, rest, per_class, seed=5))
    return score(docs.select("doc_id", in_fold("doc_id", folds, rest).alias("held_out"), "text"), model)


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, rest: int = 0) -> DataFrame:
    """The documents that are not rejected, all columns as they are; one pass without a shuffle."""
    model = train(*labelled_sample(docs, labels, "quality", folds, rest, PER_CLASS, seed=5))
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield batch.filter(pa.array(scored(model, batch.column("text"))[0] >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
