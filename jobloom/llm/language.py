"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit of the code a logistic classifier over hashed
byte n-grams (two, three and four bytes; A-Z lowered, other ASCII signs one blank) predicts
the bit, and the language whose codeword has the least total logistic loss under the
predicted margins wins. ``ambiguous`` is set where the runner-up is close.

Codes: with up to ``EXHAUSTIVE`` languages every split into two non-empty sides is a bit;
with more, the best of seeded random codes.

Training takes a seeded sample of about ``per_language`` documents of each language (the
bound; all texts of the sample whole), and a short slice of each, so that short texts are
known too. All documents are scored whole.

Null texts and texts without a letter get ``und`` and score 0. Rows with a null lang are not
learned from; without any learned language all rows are ``und``. Repeated rows are each
scored; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import bounded_batches, in_fold, lowered, pieces, seeded_share, utf8

DIMS = 4096
PER_LANGUAGE = 600
EXHAUSTIVE = 6
#: A runner-up whose share comes this near to the winner's makes a text ambiguous.
MARGIN = 0.2
#: Texts counted at once; bounds a worker's memory to some megabytes.
DOCS_AT_ONCE = 128
SLICE = 120
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, runner_up string, ambiguous boolean"
UNKNOWN = "und"

_FOLD = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint64)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of hashed n-gram counts, each row of length one."""
    n = len(offsets) - 1
    codes = _FOLD[lowered(data)]
    counts = np.zeros(n * DIMS, np.float32)
    row = np.repeat(np.arange(n, dtype=np.int64) * DIMS, np.diff(offsets))
    with np.errstate(over="ignore"):
        gram = codes
        for size in (2, 3, 4):
            if len(codes) < size:
                break
            gram = gram[:-1] * np.uint64(0x100000001B3) + codes[size - 1 :]
            slot = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
            at = row[: len(slot)]
            inside = at == row[size - 1 :]
            counts += np.bincount((at + slot)[inside], minlength=n * DIMS).astype(np.float32)
    x = np.sqrt(counts.reshape(n, DIMS))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Rows of +1 and -1, one for each of n classes; no column is constant."""
    if n <= EXHAUSTIVE:
        bits = [[1 if i == 0 else 1 - 2 * (split >> (i - 1) & 1) for i in range(n)] for split in range(1, 1 << (n - 1))]
        return np.array(bits, np.float32).T.reshape(n, -1)
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    best, distance = None, -1.0
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, width))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        apart = (width - code @ code.T) / 2
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > distance:
            best, distance = code, least
    return best


def fit_bits(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.3, decay: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Logistic weights of every bit at once, by Adam over the whole sample."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        pull = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
        for i, (p, g) in enumerate(((w, x.T @ pull + decay * w), (b, pull.sum(axis=0)))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w, b


def decode(model: Model, x: np.ndarray) -> np.ndarray:
    """Shares of the languages from the logistic loss of their codewords."""
    margins = x @ model.weights + model.bias
    loss = np.stack([np.logaddexp(0, -margins * word).sum(axis=1) for word in model.code], 1)
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return share / share.sum(axis=1, keepdims=True)


def sample_features(labelled: DataFrame) -> DataFrame:
    """(lang, slots, values): sparse features of whole texts, and of a slice of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 18):
            data, at = utf8(batch.column("text"))
            key = batch.column("key").to_numpy()
            start = at[:-1] + (key % np.maximum(np.diff(at) - SLICE, 1))
            stop = np.minimum(start + SLICE, at[1:])
            cut = np.concatenate([data[s:e] for s, e in zip(start, stop)]) if len(start) else data
            langs = batch.column("lang").to_pylist()
            for d, o in ((data, at), (cut, np.concatenate([[0], np.cumsum(stop - start)]))):
                for first in range(0, len(langs), DOCS_AT_ONCE):
                    own = o[first : first + DOCS_AT_ONCE + 1]
                    x = features(d[own[0] : own[-1]], own - own[0])
                    slots = [np.flatnonzero(r) for r in x]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(langs[first : first + DOCS_AT_ONCE], pa.string()),
                            pa.array([s.astype(np.int32) for s in slots], pa.list_(pa.int32())),
                            pa.array([r[s] for r, s in zip(x, slots)], pa.list_(pa.float32())),
                        ],
                        ["lang", "slots", "vals"],
                    )

    return labelled.mapInArrow(run, "lang string, slots array<int>, vals array<float>")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fits on rows (doc_id, text, lang); the sample keeps about ``per_language`` rows of each language at most.

    Rows are drawn by id and text, and equal rows count once, so that neither a repeated id nor a repeated
    row brings more of them.
    """
    bounded_batches(labelled.sparkSession)
    labelled = labelled.filter("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(z) for name in langs for z in (name, min(1.0, per_language / sizes[name]))])
    drawn = labelled.withColumn("draw", seeded_share("doc_id", "text", seed=2)).filter(F.col("draw") < share[F.col("lang")])
    kept = drawn.groupBy("lang", "draw").agg(F.min("text").alias("text"))
    keyed = kept.select("lang", "text", F.pmod(F.xxhash64("draw"), F.lit(1 << 30)).alias("key"))
    table = sample_features(keyed).toArrow().combine_chunks()
    names = np.array([langs.index(n) for n in table.column("lang").to_pylist()], np.int64)
    x = np.zeros((len(names), DIMS), np.float32)
    for i, (slots, vals) in enumerate(zip(table.column("slots"), table.column("vals"))):
        x[i, slots.values.to_numpy()] = vals.values.to_numpy()
    order = np.lexsort((x[:, :16].sum(axis=1), x.argmax(axis=1), names))
    code = codewords(len(langs))
    weights, bias = fit_bits(x[order], code[names[order]])
    return Model(langs, code, weights, bias)


def shares_of(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Language shares of each text, a bounded number of texts at a time."""
    parts = []
    for first in range(0, len(offsets) - 1, DOCS_AT_ONCE):
        own = offsets[first : first + DOCS_AT_ONCE + 1]
        parts.append(decode(model, features(data[own[0] : own[-1]], own - own[0])))
    return np.concatenate(parts) if parts else np.zeros((0, len(model.langs)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, runner_up, ambiguous) of rows (doc_id, held_out, text)."""
    bounded_batches(docs.sparkSession)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", letters.alias("known"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            known = batch.column("known").to_numpy(zero_copy_only=False).astype(bool)
            if model is None:
                known[:] = False
                share, langs = np.ones((len(known), 1)), [UNKNOWN]
            else:
                data, at = utf8(batch.column("text"))
                share, langs = shares_of(model, data, at), model.langs
            order = np.argsort(-share, axis=1, kind="stable")
            top = share[np.arange(len(share)), order[:, 0]]
            second = order[:, 1] if len(langs) > 1 else order[:, 0]
            close = (top - share[np.arange(len(share)), second] < MARGIN) & (len(langs) > 1)
            name = [langs[i] if k else UNKNOWN for i, k in zip(order[:, 0], known)]
            after = [langs[i] if k and len(langs) > 1 else None for i, k in zip(second, known)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(name, pa.string()),
                    pa.array(np.where(known, top, 0.0), pa.float64()), pa.array(after, pa.string()), pa.array(~known | close),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "runner_up", "ambiguous"],
            )

    return rows.mapInArrow(run, SCHEMA)


def identify(docs: DataFrame, folds: int = 4, rest: int = 2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learns from the rows outside the held-out fold and predicts every row."""
    held = docs.select("doc_id", "text", "lang", in_fold("doc_id", folds, rest).alias("held_out"))
    model = train(held.filter("not held_out").select("doc_id", "text", "lang"), per_language)
    return predict(held.select("doc_id", "held_out", "text"), model)
