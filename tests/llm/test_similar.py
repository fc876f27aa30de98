"""Near duplicates of a stated similarity, against exact shares of common shingles."""

import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from archlens.llm import simhash, sketches


def share(a: str, b: str) -> float:
    x, y = ({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def copies(rng: np.random.Generator, base: list[str], edits: int) -> str:
    out = base.copy()
    for k in rng.choice(len(out), edits, replace=False).tolist():
        out[k] = [f"q{rng.integers(1 << 30)}", "", f"{out[k]} r{rng.integers(1 << 30)}"][rng.integers(3)]
    return " ".join(w for w in out if w)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_planted_copies_go_and_the_rest_stays(spark):
    """Pairs from 0.8 on are found in nine of ten cases at least, pairs below 0.6 hardly ever."""
    rng = np.random.default_rng(11)
    rows, of = [], {}
    for k in range(900):
        base = [f"w{w}" for w in rng.zipf(1.3, int(rng.integers(60, 500))) % 5000]
        rows.append((2 * k, " ".join(base)))
        rows.append((2 * k + 1, copies(rng, base, max(1, int(len(base) * rng.uniform(0.002, 0.12))))))
        of[2 * k + 1] = share(rows[-2][1], rows[-1][1])
    got = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, rows)).collect()}
    found = {i: got[i] == i - 1 for i in of}
    near, edge, far = ([found[i] for i, s in of.items() if a <= s < b] for a, b in ((0.8, 1.1), (0.8, 0.85), (0, 0.6)))
    assert len(near) > 100 and np.mean(near) > 0.95 and len(edge) > 40 and np.mean(edge) > 0.9 and len(far) > 100 and np.mean(far) < 0.02
    assert all(got[i] == i for i in range(0, 1800, 2))
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, frame(spark, rows), "").collect()}
    assert kept == {i for i, c in got.items() if i == c}


@pytest.mark.parametrize("tile", [256, 8])
def test_a_large_group_around_one_text(spark, monkeypatch, tmp_path, tile):
    """Copies that are near the text they come from and not near each other are one group, in bands of any size."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(3)
    base = [f"w{w}" for w in range(300)]
    rows = [(k, copies(rng, base, 6)) for k in range(200)]
    rows.insert(77, (500, " ".join(base)))
    rows += [(600 + k, " ".join(f"x{w}" for w in rng.integers(0, 900, 300))) for k in range(50)]
    assert share(rows[0][1], rows[1][1]) < 0.75
    got = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, rows)).collect()}
    assert np.mean([got[i] == 0 for i in [*range(200), 500]]) > 0.95 and all(got[600 + k] == 600 + k for k in range(50))


def test_all_links_of_a_large_band_count(spark, monkeypatch):
    """Bands of any size and mixture: components are those of all pairs that share a band and are within the distance."""
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(8)
    flipped = lambda bits, k: bits ^ np.isin(np.arange(512), rng.choice(512, k, replace=False))
    hub = rng.random(512) < 0.5
    texts = [hub, *[flipped(hub, 30) for _ in range(60)]]  # a component larger than a part
    for _ in range(60):  # pairs and chains of three far from all else
        start = rng.random(512) < 0.5
        texts += [start, flipped(start, 40), *[flipped(start, 85)] * int(rng.integers(2))]
    end = texts[5]
    for _ in range(5):  # a chain that leads away from the hub
        end = flipped(end, 80)
        texts.append(end)
    nodes = rng.permutation(len(texts)).tolist()
    bands = [[1, 2] if k % 3 else [1, 3] if k % 2 else [2, 3] for k in range(len(texts))]
    bits = [np.packbits(t, bitorder="little").view(np.int64).tolist() for t in texts]
    got = {n: n for n in nodes} | {r.node: r.component for r in simhash.similar_components(spark.createDataFrame(list(zip(nodes, bits, bands, strict=True)), "node long, bits array<long>, bands array<long>"), 90).collect()}
    want = dict(zip(nodes, nodes, strict=True))
    near = [(nodes[i], nodes[j]) for i in range(len(texts)) for j in range(i) if (texts[i] ^ texts[j]).sum() <= 90 and set(bands[i]) & set(bands[j])]
    for _ in texts:
        for i, j in near:
            want[i] = want[j] = min(want[i], want[j])
    assert got == want and len(set(want.values())) < 80


def test_defined_results(spark):
    rows = [(None, "a b"), (3, None), (4, ""), (5, " \n"), (7, "A b"), (8, "a\tB"), (8, "a\tB"), (9, "a b c"), (11, "É x"), (12, "é x")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.similar(frame(spark, rows)).collect()), key=repr)
    want = [(None, None), (3, 3), (4, 3), (5, 3), (7, 7), (8, 7), (8, 7), (9, 9), (11, 11), (12, 12)]
    assert got == sorted(want, key=repr) and simhash.similar(frame(spark, [])).isEmpty()


def test_a_sketch_is_that_of_all_shingles_and_of_pieces():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"W{w}" for w in rng.integers(0, 90, n)) for n in (0, 1, 4, 5, 6, 400, 3000)]
    [(names, bits, full, bands)] = sketches.sketches([t.encode() for t in texts], 5)
    assert full.tolist() == [False] + [True] * 6 and not bits[0].any() and len(set(names)) == 7
    for k, text in enumerate(texts):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(sketches, "PIECE_BYTES", -1)
            patch.setattr(sketches, "pieces", lambda t, gap: simhash.pieces(t, gap, 50))
            [(name, own, has, its)] = sketches.sketches([text.encode()], 5)
        assert name == [names[k]] and (own[0] == bits[k]).all() and has.tolist() == [full[k]]
        assert (its == bands[full[:k].sum() : full[: k + 1].sum()]).all()
    # of the definition: a bit is set if over half of the distinct shingles' hashes have it
    words = sketches.Words([texts[5].encode()], lower=True)
    hashes = sketches._shingles(words, 5)[0]
    assert len(hashes) == len({tuple(texts[5].split()[k : k + 5]) for k in range(396)})
    for part in range(sketches.PARTS):
        values = sketches.mix(hashes + sketches._PART[part]).tolist()
        assert int(bits[5, part]) == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def test_memory_of_a_long_text():
    rng = np.random.default_rng(1)
    text = b" ".join(b"w%d" % w for w in rng.integers(0, 90_000, 1_500_000))
    tracemalloc.start()
    list(sketches.sketches([text], 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text) + (60 << 20)
