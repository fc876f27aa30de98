import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from archlens.llm import queries, spelling

FOLDER = "/root/testdata/sf0.001"


def is_near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = (x, y) if len(x) > len(y) else (y, x)
    return len(x) == len(y) + 1 and any(x[:k] + x[k + 1 :] == y for k in range(len(x)))


def plain(counts):
    """word -> (form, root, n, n_near, form_n) by comparing words of like lengths."""
    by_size = {}
    for w in counts:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if is_near(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pairs_of_composed_acceptors(seed):
    rng = random.Random(seed)
    for t in range(300):
        alphabet, n = ("ab", "abcé")[t % 2], rng.randint(1, 6)
        word = lambda k, a=alphabet: "".join(rng.choice(a) for _ in range(k))
        first, second = sorted({word(n) for _ in range(rng.randint(1, 12))}), sorted({word(n - 1) for _ in range(rng.randint(0, 12))})
        got = list(spelling.near_pairs(first, second))
        assert len(got) == len(set(got))
        same = {(min(a, b), max(a, b)) for a, b, deletes in got if not deletes}
        assert same == {(a, b) for a in range(len(first)) for b in range(a + 1, len(first)) if is_near(first[a], first[b])}
        assert {(a, b) for a, b, deletes in got if deletes} == {(a, b) for a in range(len(first)) for b in range(len(second)) if is_near(first[a], second[b])}


def test_acceptors_are_minimal():
    words = sorted(a + b for a in ("ab", "cd", "xy") for b in ("12", "13", "22"))
    made = spelling.Acceptor(words)
    assert len(made.next) == 8 and made.size[0] == 9  # the start, one behind each first letter, four of the tails that all share
    for k, w in enumerate(words):
        state = place = 0
        for c in w:
            state, before = made.next[state][c]
            place += before
        assert place == k and not made.next[state]


@pytest.mark.parametrize("group_words", [2, 5, 2000])
def test_variants_like_plain_ones(spark, group_words):
    rng = random.Random(group_words)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"prefix" + "".join(rng.choice("ab") for _ in range(4)) for _ in range(12)} | {"z" * 1500 + "a", "z" * 1500}
    counts = {w: rng.choice([3, 3, 4, 6, 9, 20, 50]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = {r.word: (r.n_near, r.near) for r in spelling.near_words(table, group_words).collect()}
    want = plain(counts)
    assert {w: x[3] for w, x in want.items()} == {w: near.get(w, (0, None))[0] for w in words}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(table).collect()}
    assert got == want


def test_query_like_plain_python(spark):
    total = Counter()
    for r in queries.table(spark, FOLDER, "documents").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            at = h % len(run)
            total[run if h % 97 else run[:at] + run[at + 1 :]] += 1
    want = plain({w: n for w, n in total.items() if len(w) >= 5 and n >= 3})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op13_spelling_variants(spark, FOLDER).collect()}
    assert got == want and len(want) > 100


def test_odd_tables(spark):
    rows = [(1, None, 1), (1, "", 1), (None, "Hello hellO. ĀHello÷Ýhello", 1), (2, "hello " * 3 + "hallo x" + "y" * 100000, 1), (2, "hello " * 3 + "hallo x" + "y" * 100000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = {r.word: r.n for r in spelling.word_counts(docs).collect() if len(r.word) < 99}
    assert got == {"hello": 8, "hello÷Ýhello": 1, "hallo": 2}
    assert spelling.word_counts(docs.limit(0)).isEmpty() and spelling.variants(docs.select(F.col("text").alias("word"), "n").limit(0)).isEmpty()


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k:02}", f"w{k + 1:02}") for k in range(20)], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {f"w{k:02}": "w20" for k in range(20)}
