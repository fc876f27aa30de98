import random
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from archlens.llm import pieces, simhash, toxicity


def text_of(n_words, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice(["The", "of", "Straße", "x", "nothing", str(rng.randrange(5000))]) for _ in range(n_words)).encode()


def plain_fingerprint(text, shingle=3):
    words = text.lower().split()
    parts = [b" ".join(words[k : k + shingle]) for k in range(max(len(words) - shingle + 1, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("n_words", [0, 1, 2, 3, 4, 50, 700])
def test_fingerprints_by_pieces(monkeypatch, n_words):
    text = text_of(n_words)
    want = plain_fingerprint(text)
    assert simhash._fingerprints_of([text], 3, 42).tolist() == [want]
    monkeypatch.setattr(pieces.pieces, "__defaults__", (20,))
    assert simhash._long_fingerprint(text, 3, 42).tolist() == [want]


@pytest.mark.parametrize("size", [1, 7, 100])
def test_ngrams_by_pieces(monkeypatch, size):
    texts = [b"", b"a", text_of(60), b"abcabc" * 40]
    whole = [toxicity.ngrams(t) for t in texts]
    monkeypatch.setattr(toxicity, "PIECE_BYTES", size)
    assert all(np.array_equal(a, toxicity.ngrams(t)) for a, t in zip(whole, texts, strict=True))


@pytest.mark.parametrize(("work", "times"), [(toxicity.ngrams, 12), (lambda t: simhash._fingerprints_of([t], 3, 42), 20)])
def test_memory_of_a_long_text(work, times):
    text = text_of(1_500_000)
    tracemalloc.start()
    work(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < times * len(text) + (60 << 20) and peak < 250 << 20


def test_stages_take_their_own_inner_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({c: F.lit(1) for c in ("gone_id", "contaminated_id", "contaminated_mark", "component_id", "mark", "fp")})
    for stage in (corpus_pipeline.keep_one_of_each, corpus_pipeline.drop_contaminated):
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        plain = stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), "/root/testdata/sf0.001")
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in plain.collect())
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").isEmpty()
