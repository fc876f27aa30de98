"""Quality by hierarchical empirical Bayes (operator 7).

A document's evidence is the log-likelihood ratio of a logistic classifier on shape features of its text (shares of
kinds of characters, of repeated and of frequent words, word lengths), fitted on at most SAMPLE_ROWS labelled rows of
each label. Its site adds a prior: the mean quality over all documents of each host and of each path on a host, by
grouped aggregation, where a path is shrunk toward its host and a host toward the global mean. How strongly is
estimated from the data: the variance between groups beyond what their sizes explain gives the number of documents
that the wider group counts for. So a site with few documents keeps its group's prior.

Defined results: a null text counts as empty; an empty text has no characters and no words, so all its features are 0;
null hosts and paths form groups of their own, apart from empty strings; without labels of both kinds the evidence is 0
and every document is kept; rows come back as often as given; empty tables give empty results. Columns of the input that have
the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import chunks, columns_of, cut, fresh, map_batches, named, texts_of, with_columns
from archlens.llm.words import U, Words, mix

SAMPLE_ROWS = 10_000
#: Paths whose priors go to every executor (about 60 bytes each); beyond, they are joined by a shuffle over salts.
BROADCAST_PATHS = 200_000
SALTS = 32
RESULTS = ["quality_evidence", "quality_host", "quality_path", "quality_score"]


def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(characters)] = 1
    return table


_CLASSES = [_class(bytes(range(65, 91))), _class(b"0123456789"), _class(b"!?"), _class(b"#$%&*<>{}[]=+~^@\\/_"), _class(b"|"), _class(b".,;:"), _class(b"\n"), _class(bytes(range(128, 256)))]
NEWLINE, N_FEATURES = 6, len(_CLASSES) + 6


def features(texts: list[bytes]) -> np.ndarray:
    """A row of N_FEATURES numbers for each text."""
    words = Words(texts)
    size = np.maximum(np.diff(words.first_byte) - 1, 1)[:, None]
    counts = np.stack([np.add.reduceat(c[words.buf], words.first_byte[:-1], dtype=np.int64) for c in _CLASSES], axis=1)
    counts[:, NEWLINE] -= 1  # the one that ends a text in the buffer
    shares = counts / size
    n = np.maximum(words.count, 1)
    per_doc = lambda x: np.bincount(words.doc, x, len(texts))
    length = (words.end - words.start).astype(float)
    mean = per_doc(length) / n
    same = np.zeros(len(words.name))
    same[1:] = (words.name[1:] == words.name[:-1]) & (words.doc[1:] == words.doc[:-1])
    tags = np.sort(mix(words.name ^ mix(words.doc.astype(U) + U(1))) & ~U(0xFFFF) | (words.doc.astype(U) & U(0xFFFF))) if len(words.name) else words.name
    new = np.flatnonzero(np.diff(tags, prepend=~tags[:1])) if len(tags) else np.zeros(0, int)
    times = np.diff(np.append(new, len(tags)))
    whose = (tags[new] & U(0xFFFF)).astype(np.int64)
    distinct = np.bincount(whose, minlength=len(texts))[: len(texts)]
    most = np.zeros(len(texts))
    np.maximum.at(most, whose, times)
    columns = [np.log1p(words.count), mean, np.sqrt(np.maximum(per_doc(length**2) / n - mean**2, 0)), per_doc(same) / n, np.log(np.maximum(distinct, 1) / n), most / n]
    return np.column_stack([shares, *columns])


@dataclass
class Evidence:
    """Log-likelihood ratio of good to bad: bias + weights on standardised features, clipped to what is plausible."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def of(self, texts: list[bytes]) -> np.ndarray:
        x = np.clip((features(texts) - self.mean) / self.scale, -8, 8)
        return np.clip(x @ self.weight + self.bias, -20, 20)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column("text"))
        x = np.concatenate([np.zeros((0, N_FEATURES)), *(features(texts[a:b]) for a, b in chunks(texts))])
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[Evidence | None, float]:
    """The evidence model and the share of good labels; no model without labels of both kinds."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").distinct()
    total = marks.agg(F.count("*").alias("n"), F.sum("label").alias("good")).first()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = marks.filter("label = 0").orderBy(*order).limit(SAMPLE_ROWS).union(marks.filter("label = 1").orderBy(*order).limit(SAMPLE_ROWS))
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(drawn), "doc_id").select("text", "label")
    got = map_batches(sample, _rows, "label int, x array<double>").toPandas()
    y = got["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None, 1.0
    x = np.stack(got["x"].to_list())
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    weigh = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w = np.zeros(x.shape[1])
    ridge = np.append(np.full(N_FEATURES, 1e-3), 0.0)
    for _ in range(30):  # Newton steps; balanced labels, so that the result is a likelihood ratio
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weigh * (p - y)) + ridge * w
        curvature = (x * (weigh * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Evidence(mean, scale, w[:-1], float(w[-1])), total.good / total.n


def with_evidence(docs: DataFrame, model: Evidence | None, text_col: str = "text", name: str = "evidence") -> DataFrame:
    """`docs` with all its columns and, as `name`, the evidence of each row's text."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(text_col).cast(pa.string()))
            z = np.concatenate([np.zeros(0), *(model.of(texts[a:b]) for a, b in chunks(texts))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], [*batch.schema.names, name])

    return map_batches(docs, run, with_columns(docs.schema, **{name: "double"}))


def _strength(groups: DataFrame, n: str, total: str, center: Column) -> float:
    """How many rows the wider group counts for, by the method of moments over groups of `n` rows."""
    rate = F.col(total) / F.col(n)
    sums = groups.agg(
        F.sum(n).alias("n"), F.count("*").alias("g"), F.sum(total).alias("s"), F.sum(F.col(n) * (rate - center) ** 2).alias("v"),
    ).first()
    if not sums.n:
        return 1.0
    m = min(max(sums.s / sums.n, 1e-6), 1 - 1e-6)
    between = sums.v / sums.n - sums.g * m * (1 - m) / sums.n
    return float(min(max(m * (1 - m) / max(between, 1e-9) - 1, 1.0), 1e6))


def site_priors(judged: DataFrame, share: float) -> DataFrame:
    """host, path, host_prior and path_prior from the evidence of all documents (columns host, path, evidence)."""
    logit = float(np.log(share / (1 - share))) if 0 < share < 1 else 20.0
    p = 1 / (1 + F.exp(-(F.col("evidence") + logit)))
    paths = cut(judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")))
    whole = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    mean = whole[1] / whole[0] if whole[0] else 0.5
    k = _strength(hosts, "host_n", "host_s", F.lit(mean))
    hosts = hosts.select("host", "host_n", "host_s", ((F.col("host_s") + k * mean) / (F.col("host_n") + k)).alias("host_prior"))
    joined = paths.join(hosts, paths.host.eqNullSafe(hosts.host)).select(paths.host, "path", "n", "s", "host_prior")
    k = _strength(joined, "n", "s", F.col("host_prior"))
    return joined.select("host", "path", "host_prior", ((F.col("s") + k * F.col("host_prior")) / (F.col("n") + k)).alias("path_prior"))


def site(url: Column) -> tuple[Column, Column]:
    """Host and first segment of the path of a url; both null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    first = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)", 1)
    return F.nullif(host, F.lit("")), F.when(host != "", first)


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with quality_evidence, quality_host, quality_path (priors) and quality_score, the posterior of being good."""
    return _judge(docs.drop(*RESULTS), docs, labels, host, path, id_col, text_col, RESULTS)


def judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """`docs` with all its columns, and the score as a column of the returned name, which `docs` doesn't have."""
    names = fresh(docs, *RESULTS)
    return _judge(docs, docs, labels, host, path, id_col, text_col, names), names[-1]


def _judge(kept: DataFrame, docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str, text_col: str, names: list[str]) -> DataFrame:
    model, share = fit(docs, labels, id_col, text_col)
    h, p, salt = fresh(docs, "quality_h", "quality_p", "quality_salt")
    # A null stays apart from every string.
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    placed = docs.withColumns({h: key(host), p: key(path), salt: F.pmod(F.xxhash64(named(id_col), named(text_col)), F.lit(SALTS)).cast("int")})
    narrow = placed.select(F.col(h).alias("host"), F.col(p).alias("path"), named(text_col).cast("string").alias("text"))
    priors = cut(site_priors(with_evidence(narrow, model), share)).withColumnsRenamed({"host": h, "path": p, "host_prior": names[1], "path_prior": names[2]})
    if priors.count() <= BROADCAST_PATHS:
        keys, priors = [h, p], F.broadcast(priors)
    else:  # a site may hold a third of all documents
        keys, priors = [h, p, salt], priors.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = placed.select(*columns_of(kept), *[F.col(c) for c in (h, p, salt)])
    joined = with_evidence(own, model, text_col, names[0]).join(priors, keys)
    prior = F.least(F.greatest(F.col(names[2]), F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = 1 / (1 + F.exp(-(F.col(names[0]) + F.log(prior / (1 - prior)))))
    score = F.lit(1.0) if model is None else posterior
    return joined.select(*columns_of(kept), *[F.col(c) for c in names[:3]], score.alias(names[3]))
