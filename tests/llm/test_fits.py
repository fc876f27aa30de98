"""Counts, ratios, weights and priors of the fitted operators against plain Python, both ways of each size bound."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from archlens.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.001"


def key_of(gram):
    inner = set(toxicity._ngrams_of(gram[:-1]).tolist()) | set(toxicity._ngrams_of(gram[1:]).tolist())
    return (set(toxicity._ngrams_of(gram).tolist()) - inner).pop()


@pytest.mark.parametrize("bound", [0, 2_000_000])
def test_toxicity_counts_ratios_and_weights(spark, monkeypatch, bound):
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(toxicity, "FEATURES", 300)
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    label = {r.doc_id: r.toxic for r in labels.collect()}
    grams = {}
    for r in docs.collect():
        if label.get(r.doc_id) in (0, 1):
            data = b" " + (r.text or "").encode().lower() + b" "
            grams[r.doc_id] = {data[k : k + n] for n in (4, 5, 6) for k in range(len(data) - n + 1)}
    total = Counter(label[d] for d in grams)
    count = defaultdict(lambda: [0, 0])
    for d, own in grams.items():
        for g in own:
            count[g][label[d]] += 1
    rated = []
    for g, (other, toxic) in count.items():
        if other + toxic >= toxicity.MIN_TEXTS:
            a, b = (other + 0.5) / (total[0] + 1), (toxic + 0.5) / (total[1] + 1)
            rated.append((-abs(math.log(b / a)) * abs(b - a), key_of(g), math.log(b / a), g))
    best = sorted(rated)[:300]
    # Ties at the end by the key; floats of both sides may order equal weights apart.
    model = toxicity.fit(docs, labels)
    assert len(model.features) == 300 and len(set(model.features.tolist()) ^ {k for _, k, _, _ in best}) <= 4
    chosen = {k: (ratio, g) for _, k, ratio, g in rated}
    ratio = np.array([chosen[k][0] for k in model.features.tolist()])
    place = {chosen[k][1]: n for n, k in enumerate(model.features.tolist())}
    ids = sorted(grams)
    rows = [np.array(sorted(place[g] for g in grams[d] if g in place), np.int64) for d in ids]
    y, scale = np.array([label[d] for d in ids], float), np.array([toxicity.SCALE / max(len(grams[d]), 1) for d in ids])
    bias, fitted = toxicity._regression(rows, y, ratio, total[1] / (total[0] + total[1]), scale)
    assert np.allclose(model.weight, fitted * ratio, atol=1e-5) and abs(model.bias - bias) < 1e-5
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for d, row, s in zip(ids, rows, scale, strict=True):
        assert abs(got[d] - 1 / (1 + math.exp(-(model.bias + s * model.weight[row].sum())))) < 1e-9


def test_toxicity_with_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(1, "a toxic text"), (2, None), (None, "x"), (1, "a toxic text")], "doc_id long, text string")
    for label, low, high in ((1, 0.99, 1), (0, 0, 0.01)):
        labels = spark.createDataFrame([(1, label), (2, label), (3, None), (None, 1 - label)], "doc_id long, toxic int")
        scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(scored) == 4 and all(low <= r.score <= high for r in scored)
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r.score < 0.01 for r in toxicity.score(docs, none).collect()) and toxicity.score(docs.limit(0), none).isEmpty()


def strength(groups, center):
    n, s = sum(g[0] for g in groups), sum(g[1] for g in groups)
    m = min(max(s / n, 1e-6), 1 - 1e-6)
    between = sum(a * (b / a - c) ** 2 for (a, b), c in zip(groups, center, strict=True)) / n - len(groups) * m * (1 - m) / n
    return min(max(m * (1 - m) / max(between, 1e-9) - 1, 1.0), 1e6)


@pytest.mark.parametrize("bound", [0, 200_000])
def test_quality_priors_and_posteriors(spark, monkeypatch, bound):
    monkeypatch.setattr(quality, "BROADCAST_PATHS", bound)
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.col("source")))
    _, share = quality.fit(docs, labels)
    got = quality.judge(docs, labels, F.col("source"), F.col("lang")).collect()
    logit = math.log(share / (1 - share))
    each = [(r.source, r.lang, 1 / (1 + math.exp(-(r.quality_evidence + logit)))) for r in got]
    hosts, paths = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for h, p, x in each:
        for g in (hosts[h], paths[h, p]):
            g[0] += 1
            g[1] += x
    mean = sum(x for _, _, x in each) / len(each)
    k = strength(list(hosts.values()), [mean] * len(hosts))
    host = {h: (s + k * mean) / (n + k) for h, (n, s) in hosts.items()}
    k = strength(list(paths.values()), [host[h] for h, _ in paths])
    path = {(h, p): (s + k * host[h]) / (n + k) for (h, p), (n, s) in paths.items()}
    for r in got:
        prior = path[r.source, r.lang]
        assert abs(r.quality_host - host[r.source]) < 1e-7 and abs(r.quality_path - prior) < 1e-7
        assert abs(r.quality_score - 1 / (1 + math.exp(-(r.quality_evidence + math.log(prior / (1 - prior)))))) < 1e-7


def test_quality_by_pages_and_their_urls(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"), "url")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    host, path = quality.site(F.col("url"))
    got = quality.judge(pages, labels, host, path)
    assert got.count() == pages.count() and got.filter("quality_score is null or quality_host is null").isEmpty()
    each = got.select(host.alias("host"), path.alias("path"), "quality_host", "quality_path").groupBy("host").agg(F.count_distinct("quality_host").alias("n"), F.count_distinct("path").alias("paths"))
    assert each.count() > 10 and each.filter("n <> 1").isEmpty()
