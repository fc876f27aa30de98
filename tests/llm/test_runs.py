import hashlib
import random
import zlib

import numpy as np
import pytest

from archlens.llm import ntt, periodic_runs, queries
from archlens.llm.pieces import pieces

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words):
    """Runs by comparing all words with those q further, for every q."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(3))
def test_runs_like_plain_ones(seed):
    rng = random.Random(seed)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 5)):
            k, n = rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 5, 6, 7, 30, 100, 200])
            words = [str(rng.randrange(k)) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randint(1, 20)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            docs.append(words)
        got = periodic_runs.runs_of([periodic_runs.word_ids(" ".join(w).encode()) for w in docs])
        assert [list(map(tuple, r.tolist())) for r in got] == [plain_runs(w) for w in docs]


def test_transforms_are_exact():
    rng = np.random.default_rng(0)
    for prime, generator in ntt.PRIMES:
        assert pow(generator, (prime - 1) // 2, prime) == prime - 1 and (prime - 1) % (1 << 25) == 0 and prime < 1 << 31
        rows = rng.integers(0, prime, (3, 64)).astype(np.uint64)
        assert np.array_equal(ntt.inverse(ntt.transform(rows, prime, generator), prime, generator), rows)


@pytest.mark.parametrize("largest", [3, 1000, 1 << 20, (1 << 25) - 1])
def test_nearest_copies(largest):
    rng = np.random.default_rng(largest)
    for size in (1, 2, 8, 32):
        values = rng.integers(1, 3, 400) * (largest // 2) + rng.integers(0, 2, 400)
        values = np.concatenate((values, np.zeros(2 * size, int)))
        starts = np.arange(0, 400 - size)
        want = [next((d for d in range(1, size + 1) if np.array_equal(values[s : s + size], values[s + d : s + d + size])), 0) for s in starts]
        assert ntt.first_copies(values, starts, size).tolist() == want
    with pytest.raises(ValueError, match="distinct words"):
        ntt.first_copies(np.full(1 << 10, (1 << 45)), np.array([0]), 8)


def test_query_like_plain_python(spark):
    docs = {r.doc_id: r.text for r in queries.table(spark, FOLDER, "documents").collect()}
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, FOLDER).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert set(got) == set(docs)
    for doc_id, text in docs.items():
        w = (text or "").encode().split()
        words, n, h = [x.decode() for x in w], len(w), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [x if i < a else words[a + (i - a) % p] for i, x in enumerate(words)]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)) and r.collapsed_sha256 == digest(collapsed(words, runs))


def test_odd_tables(spark):
    long = "a b c " * 50000 + "x " * 7
    rows = [(1, None, 5), (1, "", 5), (None, "a a a a a a", 5), (2, " \t a a\va\n a a a  b", 5), (2, " \t a a\va\n a a a  b", 5), (3, long, 5), (4, "é é é é é", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    got = sorted((tuple(r) for r in periodic_runs.find_runs(docs).select("doc_id", "n_words", "runs", "collapsed_text").collect()), key=repr)
    run = lambda *x: [tuple(y) for y in x]
    want = [(1, 0, [], ""), (1, 0, [], ""), (2, 7, [(0, 6, 1)], "a b"), (2, 7, [(0, 6, 1)], "a b"), (3, 150007, [(0, 150000, 3), (150000, 7, 1)], "a b c x"), (4, 5, [], "é é é é é"), (None, 6, [(0, 6, 1)], "a")]
    assert [(a, b, run(*c), d) for a, b, c, d in got] == want
    assert periodic_runs.find_runs(docs.limit(0)).isEmpty()
    best = {r.doc_id: r.best for r in periodic_runs.find_runs(docs).select("doc_id", "best").collect()}
    assert best[4] is None and tuple(best[3]) == (0, 150000, 3)


def test_pieces_cover_a_text():
    for text in (b"", b"abc", b"a b  c " * 9, b"x" * 40 + b" y"):
        for size in (1, 3, 10, 100):
            parts = list(pieces(text, periodic_runs.SPACE, size))
            assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


def test_memory_of_a_long_text():
    import tracemalloc

    words = np.random.default_rng(1).integers(0, 50000, 1_000_000)
    text = " ".join(map(str, words)).encode()
    del words
    tracemalloc.start()
    ids = periodic_runs.word_ids(text)
    periodic_runs._collapsed(text, periodic_runs.kept_words(periodic_runs.runs_of([ids])[0], len(ids)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(text)
