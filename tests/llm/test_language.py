import numpy as np
import pytest
from pyspark.sql import functions as F

from archlens.llm import language, queries

FOLDER = "/root/testdata/sf0.01"


def grams_of(text):
    """n-grams by a plain walk over the bytes."""
    kept = []
    for b in b" " + text.encode() + b" ":
        b = b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
        if b != 32 or not kept or kept[-1] != 32:
            kept.append(b)
    out = {}
    for n in language.LENGTHS:
        for k in range(len(kept) - n + 1):
            g = kept[k : k + n]
            if g != [32]:
                key = (n << 32) + sum(b << 8 * i for i, b in enumerate(g))
                out[key] = out.get(key, 0) + 1
    return out


@pytest.fixture(scope="module")
def train(spark):
    docs = queries.table(spark, FOLDER, "documents")
    return docs.filter(~(queries._doc_hash() % 4 == 2)), docs


@pytest.fixture(scope="module")
def model(train):
    return language.fit(train[0])


def test_frequencies_and_cosines_like_plain_ones(spark, train, model):
    texts = [r.text for r in train[0].filter("lang is not null and text is not null").collect()]
    each = [grams_of(t) for t in texts]
    df = np.array([sum(int(k) in g for g in each) for k in model.grams.key])
    assert np.allclose(model.idf, np.log((1 + len(texts)) / (1 + df)) + 1)
    some = texts[:30] + ["", "Ünder the É", "x" * 10, " . "]
    lang, score, far = model.nearest([t.encode() for t in some])
    for k, t in enumerate(some):
        g = grams_of(t)
        v = np.array([(1 + np.log(g[int(key)])) * idf if int(key) in g else 0 for key, idf in zip(model.grams.key, model.idf, strict=True)])
        cos = model.centers @ (v / max(np.sqrt((v * v).sum()), 1e-300))
        assert abs(score[k] - cos.max()) < 1e-8 and (lang[k] == model.lang[int(cos.argmax())] or cos.max() < 1e-12)
        assert far[k] == (score[k] < model.reach[int(cos.argmax())] or score[k] == 0)
    assert np.allclose((model.centers**2).sum(axis=1), 1) and 1 < model.lang.count("en") <= language.CENTROIDS


def test_pieces_of_a_long_text_add_up(model, monkeypatch):
    text = ("Über den Wolken, the end of it all; " * 400).encode()
    whole = model.grams.counts([text])
    monkeypatch.setattr(language, "PIECE_BYTES", 100)
    assert np.array_equal(model.grams.counts([text]), whole)


def test_held_out_documents(spark):
    found = queries.op12_language_id(spark, FOLDER)
    both = found.join(queries.table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'")
    right = both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98 and found.count() == 1000


def test_odd_tables(spark, model):
    schema = "doc_id long, text string, lang string, lang_pred string, score string"
    rows = [(1, None, None, "", ""), (1, "", "en", "", ""), (None, "12 .. —", "en", "", ""), (2, "反反反", "ru", "", ""), (2, "反反反", "ru", "", ""), (3, "The end of the and " * 20000, "en", "", "")]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, language.identify(docs, model).collect()), key=repr)
    assert [g[:2] for g in got] == [(1, "und"), (1, "und"), (2, model.most), (2, model.most), (3, "en"), (None, "und")]
    assert all(g[2:] == (0.0, True) for g in got if g[0] != 3)
    assert language.identify(docs.limit(0), model).isEmpty()
    nothing = language.fit(docs.limit(0))
    assert {tuple(r)[1:] for r in language.identify(docs, nothing).collect()} == {("und", 0.0, True), (None, 0.0, True)}
    small = language.fit(docs)
    assert {r.lang_pred for r in language.identify(docs, small).filter("doc_id in (2, 3)").collect()} == {"ru", "en"}
    clash = docs.withColumn("letters", F.lit(1)).withColumn("h", F.lit(1)).withColumn("r", F.lit(1))
    assert language.identify(clash, language.fit(clash)).count() == 6


def test_a_text_far_from_all_centroids_is_rejected(spark, model):
    docs = spark.createDataFrame([(1, "zqxw qqqq wxzq")], "doc_id long, text string")
    assert language.identify(docs, model).first().rejected
