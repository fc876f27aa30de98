import hashlib
import os
import struct

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from archlens.llm import bpe, components, decontaminate, license_scan, line_dedup, ogg, quality, queries, simhash, substring_dedup, token_counts, toxicity

FOLDER = "/root/testdata/sf0.001"
BPE, PIECES = queries.BPE, queries.PIECES
#: Names that operators use inside.
EXTRA = ", ".join(f"{c} string" for c in ("later", "items", "hits", "h", "w", "own", "mark", "n_words", "component_id", "fp", "label", "score", "name", "asked"))
PASSAGE = " ".join(f"w{k} of the" for k in range(30))


def frame(spark, rows):
    """Documents of (doc_id, text), with extra columns whose names clash."""
    return spark.createDataFrame([(i, t, *["x"] * 14) for i, t in rows], f"doc_id long, text string, {EXTRA}")


ODD = [(None, "a b c"), (None, None), (1, None), (2, ""), (3, " \n\t"), (4, PASSAGE), (4, PASSAGE), (5, "x " + PASSAGE + " y"), (6, "same " * 40), (7, "same " * 50), (8, "é ß 漢字 " * 2000), (9, "Released under the MIT License.\nOne more line here today\n\nOne more line here now")]


@pytest.mark.parametrize("rows", [[], ODD], ids=["empty", "odd"])
def test_every_operator_takes_odd_tables(spark, rows):
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(1, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "w1 of"), (4, PASSAGE)], "item_id long, text string")
    for out in (
        substring_dedup.remove_repeats(docs), token_counts.count_tokens(docs, PIECES), line_dedup.drop_repeated_lines(docs), bpe.digests(docs, BPE), license_scan.scan(docs),
        toxicity.score(docs, toxicity.fit(docs, labels)), quality.judge(docs, labels, F.col("name"), F.col("w")), decontaminate.find_items(docs, bench),
        decontaminate.find_items(docs, bench.limit(0)), ogg.store_texts(docs), simhash.near_duplicates(docs), license_scan.scan(docs, spark.createDataFrame([], "name string, text string")),
    ):
        assert len(out.collect()) == len(rows)


def test_substrings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(["a", "b", "cc"], 300))) for k in range(12)] + [(20, "z " * 60), (21, "z " * 80), (22, None)]
    rows += [(30 + k, " ".join(map(str, rng.integers(0, 9, 20))) + " " + PASSAGE + " " + " ".join(map(str, rng.integers(0, 9, 20)))) for k in range(6)]
    first, want = {}, {}
    for i, text in rows:
        w = (text or "").split()
        gone = [False] * len(w)
        for s in range(len(w) - 12):
            if first.setdefault(tuple(w[s : s + 13]), i) < i:
                gone[s : s + 13] = [True] * 13
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 100


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_lines_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "\n".join(" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 8))) for _ in range(12))) for k in range(8)]
    earlier, want = [], {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            w = line.split()
            if not w:
                kept.append(line)
                continue
            if not any(e == w or (max(len(e), len(w)) >= 5 and abs(len(e) - len(w)) < 2 and distance(e, w) <= 1) for e in earlier):
                kept.append(line)
            earlier.append(w)
        want[i] = "\n".join(kept)
    out = line_dedup.drop_repeated_lines(frame(spark, rows))
    assert {r.doc_id: r.text for r in out.collect()} == want


def test_repeated_rows_keep_their_lines(spark):
    out = line_dedup.drop_repeated_lines(frame(spark, [(1, "one two\nthree four"), (1, "one two\nthree four"), (2, "one two")])).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, "one two\nthree four"), (1, "one two\nthree four"), (2, "")]


@pytest.mark.parametrize("most", [500_000, 3, 0])
def test_bpe_against_the_library(spark, monkeypatch, most):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "TABLE_WORDS", most)

    tokenizer = Tokenizer.from_file(BPE)
    texts = ["Hello  WORLD's don't\tx1234 <|endoftext|>a", "É café ΣΑΣ İ ﬁ 漢字　😀", "", "a" * 500 + " b"]
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(frame(spark, list(enumerate(texts))), BPE), BPE).collect()}
    for k, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert (list(got[k].ids), got[k].ids_text, got[k].decoded) == (ids, " ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False))


def test_bpe_digests_take_one_python_worker_a_task(spark):
    texts = frame(spark, [(1, "Hello  WORLD's x1234 <|endoftext|>a"), (2, None), (3, ""), (None, "É café 漢字　😀"), (1, "a b")])
    made = bpe.digests(texts, BPE)
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    both = bpe.decode(bpe.encode(texts, BPE), BPE)
    plain = both.select("doc_id", F.size("ids").cast("long"), F.sha2("ids_text", 256), F.sha2("decoded", 256))
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, map(tuple, plain.collect())))


def test_token_counts_against_greedy_search():
    rng = np.random.default_rng(3)
    for _ in range(50):
        pieces = {"".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(12)}
        heads = {"_" + p for p in pieces if rng.random() < 0.6} | {"_"}
        automaton = token_counts.LongestMatch(heads, pieces)
        for _ in range(30):
            word = "_" + "".join(rng.choice(list("abcd"), rng.integers(0, 12), p=[0.4, 0.3, 0.28, 0.02]))
            at, n = 0, 0
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if word[at:e] in (heads if at == 0 else pieces)), None)
                if end is None:
                    n = 1
                    break
                at, n = end, n + 1
            assert automaton.count(word) == n, (word, heads, pieces)


def test_fingerprints_and_components_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.choice([f"t{k}" for k in range(50)], 400)
    rows = [(0, None), (1, ""), (2, "One"), (3, "one TWO")]
    for k in range(150):
        words = base.copy()
        words[rng.integers(0, 400)] = f"t{rng.integers(0, 50)}"
        rows.append((10 + k, " ".join(words)))
    fps = {}
    for i, text in rows:
        w = (text or "").lower().split()
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(len(w) - 2, int(len(w) > 0)))]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in fps}
    while True:
        new = {i: min(root[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2) for i in fps}
        if new == root:
            break
        root = new
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (fps[i], root[i]) for i in fps}


@pytest.mark.parametrize("most", [64, 2])
def test_block_keys_of_any_size_connect_close_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "PAIRWISE", most)
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 9, 150, dtype=np.uint64) << np.uint64(40))
    labels = np.arange(len(fps))
    while (new := np.where(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, labels, len(fps)).min(axis=1)).tolist() != labels.tolist():
        labels = new
    reps = spark.createDataFrame([(int(f), k) for k, f in enumerate(fps.view(np.int64))], "fp long, node long")
    found = {r.node: r.component for r in components.components(simhash.links(reps)).collect()}
    assert [found.get(k, k) for k in range(len(fps))] == labels.tolist()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_ogg_round_trip_and_damage():
    rng = np.random.default_rng(6)
    for n in (0, 1, 63, 64, 255, 3999, 4000, 4001, 70_000):
        payload = ogg.padded(rng.bytes(n))
        media = ogg.write(payload)
        streams = ogg.read(media)
        assert b"".join(streams[ogg.AUDIO].packets[1:]) == payload and len(payload) % 64 == 0 and payload
        assert streams[ogg.AUDIO].granules[-1] == len(payload) and streams[ogg.COMMENT].packets == [b"samples=%d" % len(payload)]
        at = int(rng.integers(len(media)))
        with pytest.raises((ValueError, struct.error)):
            ogg.read(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    crc = 0
    for byte in b"OggS\0\x02":
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    assert ogg.page_checksum(b"OggS\0\x02") == crc


@pytest.mark.parametrize("bound", [license_scan.BROADCAST_SHINGLES, 0], ids=["broadcast", "shuffle"])
def test_licenses(spark, monkeypatch, bound):
    monkeypatch.setattr(license_scan, "BROADCAST_SHINGLES", bound)
    words = " ".join(f"word{k}" for k in range(200))
    long = license_scan.TEMPLATES[7][1]
    rows = [(1, words), (2, f"{words}\nReleased under the MIT License. {words}"), (3, f"{words} {long.replace('charge', 'fee')} {words}"), (4, "released under the mit"), (5, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r.licenses for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got == {1: [], 2: ["MIT"], 3: ["MIT"], 4: [], 5: ["CC-BY-NC-4.0"]}


def test_near_identical_notices_go_to_their_own_licence(spark):
    header = "{} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    gnu = {"GPL-2.0": ("This program", ";", "General", "2"), "GPL-3.0": ("Foo", ":", "General", "3"), "LGPL-2.1": ("This library", ";", "Lesser General", "2.1"), "LGPL-3.0": ("This program", ":", "Lesser General", "3"), "AGPL-3.0": ("This program", ":", "Affero General", "3")}
    rest = " ".join(f"word{k}" for k in range(60))
    cases = [({k}, header.format(*v)) for k, v in gnu.items()] + [({name}, text) for name, text in license_scan.TEMPLATES]
    cases += [({"LGPL-3.0", "GPL-3.0"}, f"{header.format(*gnu['LGPL-3.0'])}\n{header.format(*gnu['GPL-3.0'])}"), ({"LGPL-3.0", "GPL-3.0"}, f"{header.format(*gnu['GPL-3.0'])} {rest} {header.format(*gnu['LGPL-3.0'])}")]
    bsd2, bsd3 = (next(text for name, text in license_scan.TEMPLATES if name == f"BSD-{k}-Clause" and "THIS SOFTWARE" in text) for k in (2, 3))
    cases += [({f"BSD-{k}-Clause"}, text.replace("source code", "code").replace("PROVIDED BY", "GIVEN BY")) for k, text in ((2, bsd2), (3, bsd3))]
    docs = frame(spark, [(k, f"{rest}\n{text}\n{rest}") for k, (_, text) in enumerate(cases)])
    got = {r.doc_id: set(r.licenses) for r in license_scan.scan(docs).collect()}
    assert {k: (want, got[k], text) for k, (want, text) in enumerate(cases) if got[k] != want} == {}


def test_items_with_a_sigma_before_other_punctuation(spark):
    bench = spark.createDataFrame([(1, "one ΛΟΓΟΣ ΑΛΛΑ")], "item_id long, text string")
    got = decontaminate.find_items(frame(spark, [(1, "x ONE ΛΟΓΟΣ.ΑΛΛΑ y"), (2, "one λογος αλλα")]), bench).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == {1: (5, 3, ["1"]), 2: (3, 0, [])}


def test_a_long_text_holds_only_its_own_features(spark):
    rng = np.random.default_rng(7)
    long = "".join(rng.choice(list("nopqrstuvwxyz"), 400_000))
    rows = [(k, f"{'bad deed' if k % 2 else 'calm face'} {'abcdefghijkl'[k % 12]}") for k in range(40)]
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int"))
    nothing, alone, repeated = model.logits([b"", b"bad deed", b"bad deed " * 1000])
    assert abs(model.logits([long.encode()])[0] - nothing) < 0.05 and alone > nothing and repeated > nothing


def test_pipeline_drops_contaminated_texts_not_ids(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    far = " ".join(f"x{'abcdefghij'[k % 10]}" for k in range(100))
    rows = [(None, "one two three four"), (None, "clean text"), (1, "a One two, three four"), (1, "another clean text"), (2, f"{far} one two three four"), (3, None), (None, None)]
    want = [(i, t) for i, t in rows if t is None or "two" not in t or len(t.split()) > 80]
    out = corpus_pipeline.drop_contaminated(spark, frame(spark, rows), str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, key):
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    got = queries.queries()[key](spark, FOLDER)
    columns = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {columns} FROM ({queries.oracle_sql()[key]})").fetchall())


def test_toxicity_on_rows_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = queries.op6_toxicity(spark, folder).join(labels, "doc_id").toPandas()
    held = scored[scored.held_out]
    assert ((held.predicted == held.toxic).mean() > 0.93) and (held.toxic[held.predicted == 1].mean() > 0.95)


def test_pipeline_keeps_columns_and_each_decision(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == want, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in docs.select("doc_id").collect()} and kept
        docs = spark.createDataFrame(out.toPandas(), out.schema)
    rows = docs.collect()
    digests = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()}
    assert set(digests) == {r.doc_id for r in rows}
    assert {r.doc_id: tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()} == {k: tuple(v) for k, v in digests.items()}
    assert all(len(v.decoded_sha256) == len(hashlib.sha256().hexdigest()) for v in digests.values())
