"""Language by nearest centroid (operator 12).

A text's vector has, for each of at most FEATURES character n-grams (1 to 4 bytes of UTF-8; A-Z lower-cased, other ASCII than
letters as one space), 1 + log(times) times the n-gram's inverse document frequency, and length one. Each language has up
to CENTROIDS centroids, the means of spherical k-means clusters. A text takes the language of the centroid with the largest
cosine, which is its score. A centroid's reach is the cosine that all but OUTSIDE of its own cluster attain; a text whose
nearest centroid is further away than its reach is rejected.

Fitting: SAMPLE_ROWS documents of each of at most LANGUAGES languages, those with the smallest hashes of doc_id, give the n-grams (each language's most common PER_LANGUAGE)
and the clusters; each language is clustered in one task. Document frequencies count all training documents.

Defined results: a text that is null or has no letter of any script gets `und` and score 0, and is rejected; one with letters but
none of the known n-grams gets the language of most training documents (ties: the smallest), score 0, and is rejected, as does every
text with letters if nothing was learned, with a null language; rows without language, text or doc_id teach nothing; repeated rows are judged each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archlens.llm.common import chunks, cut, id_and_text, map_batches, named, texts_of
from archlens.llm.pieces import pieces
from archlens.llm.words import U

LENGTHS = (1, 2, 3, 4)
#: Sampled rows and n-grams of a language (Spark limits such groups before it shuffles them up to 1000), and n-grams in all.
SAMPLE_ROWS, PER_LANGUAGE, FEATURES = 1000, 1000, 8192
#: Languages that are learned, those of most documents.
LANGUAGES = 500
CENTROIDS, ROUNDS, OUTSIDE = 8, 12, 0.01
UNKNOWN = "und"
#: Bytes of a text that are counted at once.
PIECE_BYTES = 1 << 18
SPACE = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
#: ASCII letters in lower case, other ASCII as a space.
FOLD = np.array([b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def keys(letters: np.ndarray, n: int) -> np.ndarray:
    """The n-gram from each place as a number: its bytes, and n above them; a space alone is none."""
    m = max(len(letters) - n + 1, 0)
    out = np.full(m, n << 32, np.uint64)
    for k in range(n):
        out |= letters[k : k + m].astype(U) << U(8 * k)
    return out if n > 1 else out[letters != 32]


def gram_keys(text: bytes) -> Iterator[np.ndarray]:
    """The n-grams of a text in parts, piece by piece; its letters have one space between words and at both ends."""
    tail, most = np.array([32], np.uint8), max(LENGTHS) - 1
    for piece in itertools.chain(pieces(text, SPACE, PIECE_BYTES), [b" "]):
        letters = np.concatenate((tail, FOLD[np.frombuffer(piece, np.uint8)]))
        letters = letters[np.concatenate(([True], (letters[1:] != 32) | (letters[:-1] != 32)))]
        for n in LENGTHS:  # those that end in this piece
            yield keys(letters[max(len(tail) - n + 1, 0) :], n)
        tail = letters[-most:]


@dataclass
class Grams:
    """n-grams as features: `of` finds the features in a text by a table without collisions among them."""

    key: np.ndarray
    factor: int = 0
    bits: int = 0
    table: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def __post_init__(self):
        draw = np.random.default_rng(5)
        self.bits = max(16, int(np.ceil(np.log2(max(len(self.key), 1)))) + 9)
        place = np.zeros(0, np.int64)
        while not self.factor or len(np.unique(place)) < len(self.key):
            self.factor = int(draw.integers(1 << 62, 1 << 63)) | 1
            place = self._place(self.key)
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.table[place] = np.arange(len(self.key))

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key * U(self.factor)) >> U(64 - self.bits)).view(np.int64)

    def of(self, key: np.ndarray) -> np.ndarray:
        at = self.table[self._place(key)]
        at = at[at >= 0] if not len(self.key) else at
        same = (at >= 0) & (self.key[at] == key) if len(self.key) else np.zeros(len(key), bool)
        return at[same]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """How often each text (a row) holds each feature."""
        out = np.zeros((len(texts), len(self.key)))
        for row, text in enumerate(texts):
            for part in gram_keys(text):
                out[row] += np.bincount(self.of(part), minlength=len(self.key))
        return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length one; a row without features is zero."""
    out = np.where(counts > 0, (1 + np.log(np.maximum(counts, 1))) * idf, 0)
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(size > 0, size, 1)


def cluster(rows: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (of length one) of spherical k-means, and each row's centroid. Rows spread by their likeness to the mean begin."""
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    order = np.argsort(rows @ rows.mean(axis=0), kind="stable")
    first = order[np.unique(np.linspace(0, len(rows) - 1, min(k, len(rows))).round().astype(int))]
    centers = unit(rows[first])
    for _ in range(rounds):
        nearest = (rows @ centers.T).argmax(axis=1)
        full = np.flatnonzero(np.bincount(nearest, minlength=len(centers)))
        centers = unit(np.array([rows[nearest == c].sum(axis=0) for c in full]))
    return centers, (rows @ centers.T).argmax(axis=1)


@dataclass
class Model:
    """lang and reach of each centroid (a row of `centers`); `most` is the language of most training documents."""

    grams: Grams
    idf: np.ndarray
    lang: list[str]
    reach: np.ndarray
    centers: np.ndarray
    most: str | None

    def nearest(self, texts: list[bytes]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Language, cosine, and whether the text is beyond its centroid's reach."""
        if not self.lang:
            return [self.most] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = vectors(self.grams.counts(texts), self.idf) @ self.centers.T
        at = cosine.argmax(axis=1)
        best = np.clip(cosine[np.arange(len(texts)), at], 0, 1).round(9)
        return [self.lang[k] if s > 0 else self.most for k, s in zip(at.tolist(), best.tolist(), strict=True)], best, (best < self.reach[at]) | (best == 0)


def _common_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n: in how many texts of a batch each n-gram stands."""
    for batch in batches:
        held: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch.column("text")), strict=True):
            own = np.zeros(0, U)
            for part in gram_keys(text):
                own = np.unique(np.concatenate((own, part)))
            held.setdefault(lang, []).append(own)
        for lang, each in held.items():
            gram, n = np.unique(np.concatenate(each), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the rows of `docs` that have a language."""
    spark = docs.sparkSession
    train = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"), named(lang_col).cast("string").alias("lang")).dropna()
    largest = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not largest:
        return Model(Grams(np.zeros(0, U)), np.zeros(0), [], np.zeros(0), np.zeros((0, 0)), None)
    train = train.filter(F.col("lang").isin([r.lang for r in largest]))
    total = sum(r["count"] for r in largest)
    # The smallest hashes of a language are among those below a bound that some times as many rows fall under; so no task
    # sees many more rows than it keeps, however large a language is.
    bound = F.element_at(F.create_map(*[F.lit(x) for r in largest for x in (r.lang, 4.0 * SAMPLE_ROWS / r["count"])]), F.col("lang"))
    hashed = train.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)).alias("h")).filter(F.col("h") < bound * float(1 << 62)).distinct()
    place = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    ids = hashed.select("doc_id", "lang", place.alias("r")).filter(f"r <= {SAMPLE_ROWS}").drop("r")
    # At most SAMPLE_ROWS rows of each of LANGUAGES languages, two columns; repeated rows of a document count once.
    sample = cut(train.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")))
    often = map_batches(sample.select("lang", "text"), _common_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = often.select("gram", rank.alias("r")).filter(f"r <= {PER_LANGUAGE}").groupBy("gram").agg(F.min("r").alias("r")).orderBy("r", "gram").limit(FEATURES)
    grams = Grams(np.array(sorted(r.gram for r in top.collect()), np.int64).view(U))
    held = spark.sparkContext.broadcast(grams)  # FEATURES numbers and their table, whatever the input

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(held.value.key), np.int64)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in chunks(texts):
                seen += (held.value.counts(texts[a:b]) > 0).sum(axis=0)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], ["feature", "n"])

    df = np.zeros(len(grams.key))
    for feature, n in map_batches(train.select("text"), document_counts, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect():
        df[feature] = n
    idf = np.log((1 + total) / (1 + df)) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = held.value.counts(texts_of(batch.column("text")))
            at = [np.flatnonzero(r) for r in rows]
            values = [r[a] for r, a in zip(rows, at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["lang", "doc_id", "at", "times"])

    def clustered(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable")
        rows = np.zeros((len(group), len(idf)))
        for k, (at, times) in enumerate(zip(group["at"], group["times"], strict=True)):
            rows[k, np.asarray(at, int)] = times
        rows = vectors(rows, idf)
        rows = rows[rows.any(axis=1)]
        if not len(rows):
            return pd.DataFrame({"lang": [], "reach": [], "center": []})
        centers, of = cluster(rows)
        near = (rows * centers[of]).sum(axis=1)
        full = np.unique(of)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "reach": [float(np.quantile(near[of == c], OUTSIDE)) for c in full], "center": [centers[c] for c in full]})

    vectors_of = map_batches(sample, counted, "lang string, doc_id long, at array<int>, times array<double>")
    found = vectors_of.groupBy("lang").applyInPandas(clustered, "lang string, reach double, center array<double>").collect()  # CENTROIDS rows of a language
    found.sort(key=lambda r: (r.lang, r.reach, r.center))
    centers = np.array([r.center for r in found]).reshape(len(found), len(idf))
    return Model(grams, idf, [r.lang for r in found], np.array([r.reach for r in found]), centers, largest[0].lang)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in chunks(texts):
                lang, score, far = held.value.nearest(texts[a:b])
                none = [not x for x in batch.column("letters").to_pylist()[a:b]]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[a:b], pa.array([UNKNOWN if x else y for x, y in zip(none, lang, strict=True)], pa.string()),
                    pa.array(np.where(none, 0.0, score)), pa.array(far | np.array(none, bool)),
                ], ["doc_id", "lang_pred", "score", "rejected"])

    rows = id_and_text(docs, id_col, text_col).withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return map_batches(rows, run, "doc_id long, lang_pred string, score double, rejected boolean")
