"""Toxicity by a convolutional text classifier in numpy.

Words (A-Z lowered, outer punctuation off) are embedded by three hashes, each into its own
table: two of the whole word, so that two words share both only if both clash, and one of
its first bytes, for inflected forms that were never seen. Filters one, two and
three words wide slide over the whole text; each filter's maximum feeds a logistic output.
Because a filter is linear, its response is a sum of table look-ups, one per word and place.

Training: Adam on a bounded sample of about ``per_class`` labelled documents of each class,
whole; the first embedding dimension starts at the log-odds of the word among them. A fourth
of the sample is kept from training. All labelled rows outside the held-out fold that were not
trained on restore the true balance of the classes and set a threshold for each language (all
of them, if too few are kept). The language is predicted from the text (see ``language``), so
neither lang nor any label enters a score; the score is moved so that 0.5 is the threshold.

Nulls: a null text counts as empty and is scored as such. Unlabelled rows are not learned
from; with fewer than two classes every score is the share of label 1 (0 without labels).
Repeated rows are each scored; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import language
from jobloom.llm.common import bounded_batches, in_fold, pieces, seeded_share, utf8
from jobloom.llm.quality import calibrate, known_labels, labelled_sample
from jobloom.session import ensure_checkpoint_dir

PER_CLASS = 2000
BITS = 15
BUCKETS = 1 << BITS
HASHES = 3
PREFIX = 5
DIMS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Words of a text that are looked up at once; bounds memory, not the text.
WORDS_AT_ONCE = 1 << 18
CACHE = 200_000
#: Part of the sample that the filters learn from, and steps of the log-odds, by which labelled rows are counted.
LEARN = 0.75
STEPS = 128
RAW = "doc_id long, held_out boolean, logit double, lang_pred string"
_EDGE = b".,;:!?\"'()[]{}<>*_~-"


@dataclass
class Model:
    tables: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    share: float | None = None
    thresholds: dict[str, float] | None = None
    apart: bool = False


class Slots(dict):
    """Buckets of a word, packed into one number, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        core = word.strip(_EDGE)
        packed = 0
        for part, salt in ((core, 0), (core[::-1], 77), (core[:PREFIX], 5)):
            packed = packed << BITS | zlib.crc32(part, salt) % BUCKETS
        self[word] = packed
        return packed


def buckets(slots: np.ndarray) -> list[np.ndarray]:
    """One row number for each table; blanks (-1) have a row of zeros."""
    return [np.where(slots < 0, BUCKETS, slots >> (BITS * (HASHES - 1 - h)) & (BUCKETS - 1)) for h in range(HASHES)]


def slots_of(text: str | None, cache: Slots) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.array([cache[w] for w in words], np.int64)


def responses(model: Model, slots: np.ndarray) -> np.ndarray:
    """Filter responses at every place; ``slots`` ends with blanks (-1) for the widest filter."""
    rows = buckets(slots)
    n = len(slots) - WIDTHS[-1] + 1
    out = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    for w, width in enumerate(WIDTHS):
        at = slice(w * FILTERS, (w + 1) * FILTERS)
        for j in range(width):
            for h in range(HASHES):
                out[:, at] += (model.tables[h] @ model.filters[w][j][h * DIMS : (h + 1) * DIMS])[rows[h][j : j + n]]
    return out + model.bias


class Scorer:
    """Scores texts with the filter tables made once."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.cache = Slots()
        self.look = [[[t @ f[h * DIMS : (h + 1) * DIMS] for h, t in enumerate(model.tables)] for f in filters] for filters in model.filters]

    def peak(self, slots: np.ndarray) -> np.ndarray:
        """Largest response of each filter over a whole text, block by block."""
        best = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32)
        padded = np.concatenate([slots, np.full(WIDTHS[-1], -1, np.int64)])
        n = len(padded) - WIDTHS[-1] + 1
        for start in range(0, n, WORDS_AT_ONCE):
            part = padded[start : start + WORDS_AT_ONCE + WIDTHS[-1] - 1]
            rows = buckets(part)
            m = len(part) - WIDTHS[-1] + 1
            for w, width in enumerate(WIDTHS):
                total = np.zeros((m, FILTERS), np.float32)
                for j in range(width):
                    for h in range(HASHES):
                        total += self.look[w][j][h][rows[h][j : j + m]]
                at = slice(w * FILTERS, (w + 1) * FILTERS)
                best[at] = np.maximum(best[at], total.max(axis=0))
        return best + self.model.bias

    def logits(self, texts: list[str | None]) -> np.ndarray:
        peaks = np.array([self.peak(slots_of(t, self.cache)) for t in texts]).reshape(-1, FILTERS * len(WIDTHS))
        return np.maximum(peaks, 0) @ self.model.out[:-1] + self.model.out[-1]


def fit(docs: list[np.ndarray], label: np.ndarray, epochs: int = 8, batch: int = 48, rate: float = 0.01, seed: int = 9) -> Model:
    """Trains tables, filters and output together; only the places of the maxima carry gradient."""
    rng = np.random.default_rng(seed)
    tables = np.zeros((HASHES, BUCKETS + 1, DIMS), np.float32)
    n = np.bincount(label, minlength=2)
    for h in range(HASHES):
        df = np.zeros((2, BUCKETS))
        for d, y in zip(docs, label):
            df[y, np.unique(buckets(d)[h])] += 1
        odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
        seen = df.sum(axis=0)
        tables[h, :BUCKETS, 0] = np.clip(odds * seen / (seen + 2), -3, 3)
        tables[h, :BUCKETS, 1:] = rng.normal(0, 0.05, (BUCKETS, DIMS - 1)) * (seen > 0)[:, None]
    filters = [rng.normal(0, 0.05, (w, HASHES * DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, ::DIMS, :] = 0.3
    out = np.append(rng.uniform(0.05, 0.15, FILTERS * len(WIDTHS)), -1.0).astype(np.float32)
    model = Model(tables, filters, np.full(FILTERS * len(WIDTHS), -0.5, np.float32), out)
    params = [model.tables, *model.filters, model.bias, model.out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for start in range(0, len(order), batch):
            pick = order[start : start + batch]
            t += 1
            grads = gradient(model, [docs[i] for i in pick], label[pick])
            for i, (p, g) in enumerate(zip(params, grads)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-6)
            model.tables[:, BUCKETS] = 0
    return model


def gradient(model: Model, docs: list[np.ndarray], label: np.ndarray) -> list[np.ndarray]:
    blank = np.full(WIDTHS[-1], -1, np.int64)
    slots = np.concatenate([np.concatenate([d, blank]) for d in docs])
    sizes = np.array([len(d) + WIDTHS[-1] for d in docs])
    starts = np.cumsum(sizes) - sizes
    z = responses(model, np.concatenate([slots, blank[:-1]]))
    peak = np.maximum.reduceat(z, starts, axis=0)
    owner = np.repeat(np.arange(len(docs)), sizes)
    rows, cols = np.nonzero(z == peak[owner])
    _, once = np.unique(owner[rows] * z.shape[1] + cols, return_index=True)
    rows, cols = rows[once], cols[once]
    held = np.maximum(peak, 0)
    p = 1 / (1 + np.exp(-np.clip(held @ model.out[:-1] + model.out[-1], -30, 30)))
    pull = (p - label) / len(docs)
    g_out = np.append(held.T @ pull, pull.sum()) + 1e-4 * model.out
    g_peak = pull[:, None] * model.out[None, :-1] * (peak > 0)
    g_bias = g_peak.sum(axis=0)
    g_tables = np.zeros_like(model.tables)
    g_filters = [1e-4 * f for f in model.filters]
    strength = g_peak[owner[rows], cols].astype(np.float32)
    padded = np.concatenate([slots, blank])
    for w, width in enumerate(WIDTHS):
        own = (cols >= w * FILTERS) & (cols < (w + 1) * FILTERS)
        r, c, s = rows[own], cols[own] - w * FILTERS, strength[own]
        for j in range(width):
            for h, bucket in enumerate(buckets(padded[r + j])):
                part = slice(h * DIMS, (h + 1) * DIMS)
                np.add.at(g_filters[w][j].T[:, part], c, s[:, None] * model.tables[h][bucket])
                np.add.at(g_tables[h], bucket, s[:, None] * model.filters[w][j][part, :].T[c])
    return [g_tables, *g_filters, g_bias.astype(np.float32), g_out.astype(np.float32)]


def best_threshold(p: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """Middle of the gap at which the weighted F1 of label 1 is largest; 0.5 if a class is missing."""
    if len(np.unique(label)) < 2:
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, label, weight = p[order], label[order], weight[order]
    hit, all_ = np.cumsum(weight * label), np.cumsum(weight)
    f1 = 2 * hit / (all_ + (weight * label).sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    at = int(f1.argmax())
    low = p[at + 1] if at + 1 < len(p) else 0.0
    return float(np.clip((p[at] + low) / 2, 0.02, 0.98))


def logit(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def train(sample: DataFrame, sizes: dict[int, int]) -> Model:
    """Fits filters on a bounded sample (doc_id, text, label); ``sizes`` are those of the whole classes."""
    bounded_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Slots()
        for batch in pieces(batches, "text"):
            slots = [slots_of(t, cache) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("label"), pa.array(slots, pa.list_(pa.int64()))], ["part", "label", "slots"]
            )

    rows = sample.select("label", "text", seeded_share("doc_id", seed=10).alias("part"))
    found = rows.mapInArrow(run, "part double, label int, slots array<bigint>").toArrow() if len(sizes) == 2 else None
    if found is None or len(set(found.column("label").to_pylist())) < 2:
        return Model(np.zeros(0), [], np.zeros(0), np.zeros(0), share=float(set(sizes) == {1}))
    docs = [s.values.to_numpy() for s in found.column("slots")]
    part, label = found.column("part").to_numpy(), found.column("label").to_numpy()
    order = sorted(range(len(docs)), key=lambda i: (part[i], label[i], len(docs[i])))
    docs, part, label = [docs[i] for i in order], part[order], label[order].astype(np.int64)
    kept = part >= LEARN
    apart = min((label[kept] == 0).sum(), (label[kept] == 1).sum()) >= 20
    learn = ~kept if apart else np.ones(len(docs), bool)
    model = fit([d for d, k in zip(docs, learn) if k], label[learn])
    model.apart = apart
    return model


def balance(model: Model, raw: DataFrame, labels: DataFrame, sizes: dict[int, int], learned: DataFrame) -> None:
    """Scale, shift and thresholds from every labelled row of ``raw`` (doc_id, logit, lang_pred) that the filters did not learn from.

    Rows are counted on the cluster by label, language and step of the log-odds, so what comes
    back is bounded, whatever the number of rows.
    """
    rows = raw.select("doc_id", "lang_pred", F.round(F.col("logit") * STEPS).cast("int").alias("step")).join(labels, "doc_id")
    if model.apart:
        rows = rows.join(F.broadcast(learned), "doc_id", "left_anti")
    held = rows.groupBy("label", "lang_pred", "step").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "lang_pred", "step").collect()
    label, n = np.array([r.label for r in held], np.int64), np.array([float(r.n) for r in held])
    names = np.array([r.lang_pred for r in held])
    share = np.array([sizes[c] / max(1.0, n[label == c].sum()) for c in (0, 1)])
    weight = n * share[label]
    raw_p = 1 / (1 + np.exp(-np.array([r.step for r in held]) / STEPS))
    model.scale, model.shift = calibrate(raw_p, label, weight)
    p = 1 / (1 + np.exp(-(model.scale * logit(raw_p) + model.shift)))
    model.thresholds = {"": best_threshold(p, label, weight)}
    for name in np.unique(names):
        own = names == name
        if min(n[own & (label == 0)].sum(), n[own & (label == 1)].sum()) >= 20:
            model.thresholds[str(name)] = best_threshold(p[own], label[own], weight[own])


def guess(langs: language.Model | None, column: pa.Array) -> list[str]:
    """Language of each text, from the text alone."""
    if langs is None:
        return [language.UNKNOWN] * len(column)
    share = language.shares_of(langs, *utf8(column))
    return [langs.langs[i] for i in share.argmax(axis=1)]


def raw_scores(docs: DataFrame, model: Model, langs: language.Model | None) -> DataFrame:
    """(doc_id, held_out, logit, lang_pred) of rows (doc_id, held_out, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model.share is None else None
        for batch in pieces(batches, "text"):
            names = guess(langs, batch.column("text"))
            z = np.zeros(len(names)) if scorer is None else scorer.logits(batch.column("text").to_pylist())
            z = logit(1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(z), pa.array(names, pa.string())],
                ["doc_id", "held_out", "logit", "lang_pred"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, RAW)


def finish(raw: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, lang_pred, threshold): log-odds moved so that 0.5 is the language's threshold."""
    if model.share is not None:
        score, limit = F.lit(model.share), F.lit(0.5)
    else:
        limit, shift = F.lit(model.thresholds[""]), F.lit(model.shift - float(logit(model.thresholds[""])))
        for name, t in model.thresholds.items():
            if name:
                limit = F.when(F.col("lang_pred") == name, t).otherwise(limit)
                shift = F.when(F.col("lang_pred") == name, model.shift - float(logit(t))).otherwise(shift)
        score = 1 / (1 + F.exp(-(F.col("logit") * model.scale + shift)))
    rows = raw.withColumns({"score": score, "threshold": limit})
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang_pred", "threshold")


def assess(docs: DataFrame, labels: DataFrame, folds: int = 5, rest: int = 0, per_class: int = PER_CLASS) -> DataFrame:
    """Learns from labelled rows outside the held-out fold and scores every document, each text once."""
    ensure_checkpoint_dir(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").filter(~in_fold("doc_id", folds, rest))
    langs = language.train(known, per_language=300)
    sample, sizes = labelled_sample(docs, labels, "toxic", folds, rest, per_class, seed=9)
    model = train(sample, sizes)
    raw = raw_scores(docs.select("doc_id", in_fold("doc_id", folds, rest).alias("held_out"), "text"), model, langs)
    if model.share is None:
        raw = raw.checkpoint()
        learned = sample.filter(seeded_share("doc_id", seed=10) < LEARN).select("doc_id").distinct()
        balance(model, raw, known_labels(labels, "toxic", folds, rest), sizes, learned)
    return finish(raw, model)
