"""Toxicity by a character n-gram linear classifier with naive Bayes scaling (operator 6).

A text's features are the character n-grams it holds (each once), divided by their number. Over all labelled training rows Spark counts
in how many toxic and other texts each n-gram stands; the logarithm of the ratio of these rates, r, scales the
feature. Of n-grams in at least MIN_TEXTS texts the FEATURES with the largest weight of evidence get a logistic
regression, fitted on at most SAMPLE_ROWS rows of each label, drawn by a hash of doc_id. A score depends on the text
alone.

Defined results: a null text counts as empty; texts without n-grams get the score of the intercept; without any
training rows, or with one label only, the score is the share of toxic rows (0 without rows); null labels are no
labels; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import id_and_text, map_batches, texts_of
from archlens.llm.words import BYTE, LOWER, U, mix

#: Lengths of n-grams in bytes, and bits of their keys: so many that other n-grams of a long text don't meet a feature.
LENGTHS, KEY_BITS = (4, 5, 6), 40
#: Distinct n-grams of a text at which a feature counts as one; and n-grams that a task gathers before it sends counts.
SCALE, FLUSH_GRAMS = 1000, 1 << 21
MIN_TEXTS, FEATURES, SAMPLE_ROWS = 5, 4096, 4000
#: Bytes of a text whose n-grams are made at once.
PIECE_BYTES = 1 << 18
#: Labelled rows up to which the labels go to every executor (12 bytes a row); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def ngrams(text: bytes) -> np.ndarray:
    """The distinct n-grams of a text as sorted keys of KEY_BITS bits; a long text in pieces that overlap by an n-gram."""
    data = b" " + text + b" "
    out = _ngrams_of(data[: PIECE_BYTES + max(LENGTHS) - 1])
    for a in range(PIECE_BYTES, len(data), PIECE_BYTES):
        out = np.union1d(out, _ngrams_of(data[a : a + PIECE_BYTES + max(LENGTHS) - 1]))
    return out


def _ngrams_of(data: bytes) -> np.ndarray:
    value = BYTE[LOWER[np.frombuffer(data, np.uint8)]]
    found = [np.zeros(0, np.int64)]
    for n in LENGTHS:
        m = len(value) - n + 1
        if m > 0:
            h = np.zeros(m, U)
            for k in range(n):
                h = h * U(0x9E3779B97F4A7C15) + value[k : k + m]
            found.append((mix(h + U(n)) >> U(64 - KEY_BITS)).view(np.int64))
    every = np.sort(np.concatenate(found))
    return every[np.diff(every, prepend=-1) > 0]


def _places(grams: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Places in `features` of those that a text's n-grams include; both are sorted."""
    few, many = (grams, features) if len(grams) < len(features) else (features, grams)
    if not len(few):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    same = many[at] == few
    return at[same] if many is features else np.flatnonzero(same)


def _scale(grams: np.ndarray) -> float:
    """What a text's sum is multiplied by: longer texts hold more of any n-grams."""
    return SCALE / max(len(grams), 1)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + SCALE * (sum of weight over the text's n-grams) / (number of n-grams))))"""

    bias: float
    features: np.ndarray
    weight: np.ndarray

    def logits(self, texts: list[bytes]) -> np.ndarray:
        return np.array([self.bias + _scale(g) * float(self.weight[_places(g, self.features)].sum()) for g in map(ngrams, texts)])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[list, list] = ([], [])

    def flush() -> pa.RecordBatch:
        both = np.concatenate([np.zeros(0, np.int64), *held[0], *held[1]])
        of = np.arange(len(both)) >= sum(map(len, held[0]))
        gram, place = np.unique(both, return_inverse=True)
        seen = [np.bincount(place[of == k], minlength=len(gram)) for k in (0, 1)]
        held[0].clear()
        held[1].clear()
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(seen[0]), pa.array(seen[1])], ["gram", "other", "toxic"])

    n = 0
    for batch in batches:
        for text, toxic in zip(texts_of(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            held[toxic].append(ngrams(text))
            n += len(held[toxic][-1])
            if n >= FLUSH_GRAMS:
                yield flush()
                n = 0
    yield flush()


def _regression(rows: list[np.ndarray], label: np.ndarray, scale: np.ndarray, share: float, by_row: np.ndarray, steps: int = 300) -> tuple[float, np.ndarray]:
    """Logistic regression with an L2 penalty on scaled features (also by row), by gradient steps with momentum; rows weigh as `share` says."""
    size = np.array([len(r) for r in rows])
    of = np.repeat(np.arange(len(rows)), size)
    feature = np.concatenate([np.zeros(0, np.int64), *rows])
    value = scale[feature] * by_row[of]
    weigh = np.where(label, share / max(label.mean(), 1e-9), (1 - share) / max(1 - label.mean(), 1e-9)) / len(label)
    w, b = np.zeros(len(scale)), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(of, value * w[feature], len(rows))
        off = weigh * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
        g = np.bincount(feature, value * off[of], len(scale)) + 1e-4 * w
        gb = off.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate, fix, fix2 = 0.05, 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        b -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    return b, w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the rows of `docs` that `labels` (id and 0/1) marks."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").distinct()
    few = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    labelled = id_and_text(docs, id_col, text_col).join(F.broadcast(marks) if few else marks, "doc_id")
    rows = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    others, toxics = rows.get(0, 0), rows.get(1, 0)
    if not others or not toxics:
        share = toxics / (others + toxics) if others + toxics else 0.0
        return Model(float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -40, 40)), np.zeros(0, np.int64), np.zeros(0))
    counts = map_batches(labelled.select("text", "label"), _counts, "gram long, other long, toxic long").groupBy("gram").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    often = [(F.col(c) + 0.5) / F.lit(n + 1.0) for c, n in (("other", others), ("toxic", toxics))]
    rated = counts.filter(f"other + toxic >= {MIN_TEXTS}").select("gram", F.log(often[1] / often[0]).alias("ratio"), (often[1] - often[0]).alias("off"))
    top = rated.orderBy(F.desc(F.abs("ratio") * F.abs("off")), "gram").limit(FEATURES).select("gram", "ratio").collect()
    chosen = np.array(sorted(r.gram for r in top), np.int64)
    ratio = np.array([r.ratio for r in sorted(top, key=lambda r: r.gram)])
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = marks.filter("label = 0").orderBy(*order).limit(SAMPLE_ROWS).union(marks.filter("label = 1").orderBy(*order).limit(SAMPLE_ROWS))
    sample = id_and_text(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id").select("text", "label")

    def chosen_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [ngrams(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([_scale(g) for g in grams], pa.float64()), pa.array([_places(g, chosen) for g in grams], pa.list_(pa.int32()))], ["label", "scale", "grams"])

    got = map_batches(sample, chosen_only, "label int, scale double, grams array<int>").toPandas()
    label = got["label"].to_numpy().astype(float)
    bias, fitted = _regression([np.asarray(g, np.int64) for g in got["grams"]], label, ratio, toxics / (others + toxics), got["scale"].to_numpy())
    return Model(bias, chosen, fitted * ratio)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES keys and weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.clip(held.value.logits(texts_of(batch.column("text"))), -40, 40)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z)), pa.float64())], ["doc_id", "score"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, score double")
