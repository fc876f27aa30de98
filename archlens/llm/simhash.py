"""SimHash near-duplicates by pigeonhole blocks (operator 10).

A document's fingerprint has a bit where over half of its word shingles' hashes have it. The 64 bits are split into
max_bits + 2 blocks, and each choice of two blocks is a join key: fingerprints that differ in max_bits bits differ in
so many blocks at most, so they agree in two at least. Documents are first grouped by fingerprint, exact copies
therefore count once, and only fingerprints that share a block key meet. What a key's fingerprints have in common
already fixes half of their bits, so a key holds few distinct ones; where there are more than PAIRWISE, those equal
after clearing a choice of max_bits free bits are grouped (all within the distance, and every such pair shares one of
these), which takes rows in proportion to their number, not to its square.

Defined results: null and empty texts have no words and the fingerprint zero, and are linked like any other; repeated
rows come back as often as they are there; rows without doc_id keep a null component and link nothing; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import chunks, cut, id_and_text, map_batches, texts_of
from archlens.llm.components import components
from archlens.llm.pieces import PIECE_BYTES, SPACE, pieces
from archlens.llm.sketches import BANDS, PARTS, sketches
from archlens.llm.sketches import BITS as SKETCH_BITS
from archlens.llm.words import U, Words

BITS = 64
#: Fingerprints of one block key that are compared pair by pair; and the share of all rows, one in HOT, from which a
#: fingerprint's rows don't travel.
PAIRWISE, HOT = 64, 2000
#: Texts of one band that are compared pair by pair at once, and those of a part of a larger band's components.
TILE, BLOCK = 256, 512
#: Hashes of a long text whose bits are counted at once.
PART = 1 << 14


def _hashes(text: bytes, n: int, shingle: int, seed: int) -> list[int]:
    """Hashes of the shingles of n words joined by one space; of fewer words than a shingle takes, that of all."""
    hash_of = xxhash.xxh64_intdigest
    if n <= shingle:
        return [hash_of(text, seed)] * (n > 0)
    gap = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    start = [0, *(gap + 1).tolist()]
    end = [*gap[shingle - 1 :].tolist(), len(text)]
    return [hash_of(text[a:b], seed) for a, b in zip(start, end, strict=False)]


def _long_fingerprint(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """The fingerprint of one text, piece by piece; the last words of a piece go before the next."""
    counts, total, held = np.zeros(BITS, np.int64), 0, []
    for piece in pieces(text, SPACE):
        held += piece.lower().split()  # of bytes: A-Z only
        if len(held) >= shingle:
            found = np.array(_hashes(b" ".join(held), len(held), shingle, seed), U)
            for part in np.array_split(found, len(found) // PART + 1):
                counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(found)
            held = held[len(held) - shingle + 1 :]
    if not total and held:
        counts, total = np.unpackbits(np.array(_hashes(b" ".join(held), len(held), shingle, seed), U).view(np.uint8), bitorder="little").astype(np.int64), 1
    return np.packbits(2 * counts > total, bitorder="little").view(U)


def _fingerprints_of(texts: list[bytes], shingle: int, seed: int) -> np.ndarray:
    if len(texts) == 1 and len(texts[0]) > PIECE_BYTES:
        return _long_fingerprint(texts[0], shingle, seed)
    words = Words(texts, lower=True)
    hashes, sizes = [], []
    for text, n in zip(words.joined(), words.count.tolist(), strict=True):
        hashes += _hashes(text, n, shingle, seed)
        sizes.append(max(n - shingle + 1, int(n > 0)))
    size = np.array(sizes)
    out = np.zeros(len(texts), U)
    full = np.flatnonzero(size)
    if len(full):
        bits = np.unpackbits(np.array(hashes, U).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, (np.cumsum(size) - size)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * counts > size[full, None], axis=1, bitorder="little").view(U)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and the 64-bit fingerprint (a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            found = [_fingerprints_of(texts[a:b], shingle, seed) for a, b in chunks(texts, 1 << 19)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0, U), *found]).view(np.int64))], ["doc_id", "fp"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, fp long")


def _bucket_links(near: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes of a block key and which of them are near: each node with the lowest node it is linked to inside the key."""
    labels = nodes.copy()
    while True:
        least = np.where(near, labels[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (least == labels).all():
            break
        labels = least
    moved = labels != nodes
    return nodes[moved], labels[moved]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _block_masks(max_bits: int) -> list[int]:
    n = max_bits + 2
    edge = [BITS * k // n for k in range(n + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:], strict=False)]
    return [block[i] | block[j] for i, j in combinations(range(n), 2)]


def links(reps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, node) of distinct fingerprints -> (a, b) node pairs that connect all pairs within `max_bits` bits."""
    masks = _block_masks(max_bits)
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block")) for k, m in enumerate(masks)])
    keyed = reps.select("fp", "node", F.explode(keys).alias("key")).select("fp", "node", "key.*")
    sizes = keyed.groupBy("k", "block").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(sizes, ["k", "block"])
    # At most PAIRWISE rows in a group: no list grows with the input.
    few = shared.filter(F.col("n") <= PAIRWISE).groupBy("k", "block").agg(F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for fps, nodes in zip(batch.column("fps").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
                own = np.array(fps, np.int64).view(U)  # bits of signed numbers are counted without their sign
                x, y = _bucket_links(np.bitwise_count(own[:, None] ^ own[None, :]) <= max_bits, np.array(nodes, np.int64))
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return map_batches(few.select("fps", "nodes"), run, "a long, b long").union(_large_links(shared.filter(F.col("n") > PAIRWISE), masks, max_bits))


def _large_links(keyed: DataFrame, masks: list[int], max_bits: int) -> DataFrame:
    """Links inside large block keys: fingerprints that are equal after clearing a choice of max_bits free bits, each to the
    least node of those, by a grouped minimum. All in such a group are within the distance, and every close pair is in one."""
    full = (1 << BITS) - 1
    choices = [[_signed(full & ~sum(1 << b for b in chosen)) for chosen in combinations([b for b in range(BITS) if not m >> b & 1], max_bits)] for m in masks]
    of_key = F.split(F.get(F.array(*[F.lit(",".join(map(str, c))) for c in choices]), F.col("k")), ",").cast("array<long>")
    cleared = keyed.select("fp", "node", "k", F.explode(of_key).alias("mask")).select("node", "k", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
    least = cleared.groupBy("k", "mask", "rest").agg(F.min("node").alias("b"), F.max("node").alias("top")).filter("b < top").drop("top")
    return cleared.join(least, ["k", "mask", "rest"]).filter("node > b").select(F.col("node").alias("a"), "b").distinct()


def _with_components(found: DataFrame, reps: DataFrame, grouped: DataFrame) -> DataFrame:
    """(doc_id, fp) of all rows, (fp, node, rows) of each fp and (node, component) of linked nodes -> doc_id, fp, component_id."""
    of_fp = reps.join(grouped, "node", "left").select("fp", "rows", F.coalesce("component", "node").alias("component_id"))
    of_fp = cut(of_fp)
    # A fingerprint may be that of a third of all documents. Those with more than 1 / HOT of all rows are fewer than HOT:
    # their rows take the component from a broadcast; only the others meet theirs in a shuffle.
    hot = F.broadcast(of_fp.filter(F.col("rows") > max(1, found.count() // HOT)).select("fp", F.col("component_id").alias("hot_id")))
    marked = found.join(hot, "fp", "left")
    rest = marked.filter("hot_id is null").select("doc_id", "fp").join(of_fp.select("fp", "component_id"), "fp", "left")
    every = marked.filter("hot_id is not null").select("doc_id", "fp", F.col("hot_id").alias("component_id")).union(rest.select("doc_id", "fp", "component_id"))
    return every.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links of at most `max_bits` differing bits)."""
    found = cut(fingerprints(docs, id_col, text_col, shingle))
    reps = cut(found.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")))
    grouped = components(links(reps.select("fp", "node"), max_bits))
    return _with_components(found.select("doc_id", "fp"), reps, grouped)


def _sketched(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, fp (a 128-bit name of the text's words), bits (the fingerprint) and bands (none without words) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = texts_of(batch.column("text")), batch.column("doc_id")
            for a, b in chunks(texts, 1 << 19):
                for fp, bits, full, bands in sketches(texts[a:b], shingle):
                    lists = [
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(values.ravel().view(np.int64)))
                        for size, values in ((np.full(len(fp), PARTS), bits), (full * BANDS, bands))
                    ]
                    yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(fp, pa.binary()), *lists], ["doc_id", "fp", "bits", "bands"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, fp binary, bits array<long>, bands array<long>")


def _near_links(tiles: DataFrame, max_bits: int) -> DataFrame:
    """(nodes, bits) lists of one tile's nodes and their fingerprints -> (a, b) node pairs that connect all pairs within `max_bits` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for nodes, bits in zip(batch.column("nodes"), batch.column("bits"), strict=True):
                own = bits.values.to_numpy().view(U).reshape(-1, PARTS)
                far = np.zeros((len(own), len(own)), np.uint16)
                for part in own.T:
                    far += np.bitwise_count(part[:, None] ^ part[None, :])
                x, y = _bucket_links(far <= max_bits, nodes.values.to_numpy())
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return map_batches(tiles.select("nodes", "bits"), run, "a long, b long")


def _listed(placed: DataFrame, reps: DataFrame, *tile: str) -> DataFrame:
    """(node, tile columns) -> nodes and bits of each tile. Fingerprints come last, so that they travel once for each place of a node."""
    drawn = placed.join(reps.select("node", "bits"), "node")
    return drawn.groupBy(*tile).agg(F.collect_list("node").alias("nodes"), F.flatten(F.collect_list("bits")).alias("bits"))


def _first_links(shared: DataFrame, reps: DataFrame, max_bits: int) -> DataFrame:
    """Links in tiles of about TILE nodes of a band, which are all links of a band of TILE at most, and those to the hub of larger ones."""
    n_tiles = F.ceil(F.col("n") / TILE)
    reach = shared.groupBy("node").agg(F.sum("n").alias("reach"))
    large = shared.filter(F.col("n") > TILE).join(reach, "node")
    hubs = large.groupBy("key", "n").agg(F.max_by("node", F.struct("reach", -F.col("node"))).alias("node"))
    in_all = hubs.select("key", F.explode(F.sequence(F.lit(0).cast("long"), n_tiles - 1)).alias("tile"), "node")
    placed = shared.select("key", F.pmod(F.xxhash64("key", "node"), n_tiles).alias("tile"), "node").union(in_all)
    return _near_links(_listed(placed, reps, "key", "tile"), max_bits)


def _links_across(shared: DataFrame, grouped: DataFrame, reps: DataFrame, max_bits: int) -> DataFrame:
    """Links inside bands of more than TILE nodes between nodes that are in different components so far.

    A band's nodes are cut into parts of about BLOCK, nodes of one component together: a component of more has parts of its own.
    Each part is compared with each other one, but for two of the same component, so every pair of nodes of different components meets.
    """
    of_node = shared.filter(F.col("n") > TILE).join(grouped, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    sizes = of_node.groupBy("key", "component").agg(F.count("*").alias("own"))
    big = F.col("own") > BLOCK
    several = sizes.groupBy("key").agg(F.count("*").alias("groups"), F.sum(F.when(~big, F.col("own"))).alias("rest")).filter("groups > 1")
    sized = of_node.join(sizes, ["key", "component"]).join(several, "key")
    n_parts = F.ceil(F.when(big, F.col("own")).otherwise(F.col("rest")) / BLOCK)
    part = F.pmod(F.when(big, F.xxhash64("node")).otherwise(F.xxhash64("component")), n_parts)
    parted = cut(sized.select("key", "node", F.struct(big.alias("big"), F.when(big, F.col("component")).otherwise(0).alias("of"), part.alias("part")).alias("side")))
    parts = parted.select("key", F.col("side").alias("x")).distinct()
    pairs = parts.join(parts.withColumnRenamed("x", "y"), "key").filter("x < y and not (x.big and y.big and x.of = y.of) or x = y and not x.big")
    goes = pairs.select("key", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("side"))
    placed = parted.join(goes, ["key", "side"]).select("key", "x", "y", "node")
    return cut(_near_links(_listed(placed, reps, "key", "x", "y"), max_bits).distinct(), parted, shared)


def similar_components(reps: DataFrame, max_bits: int) -> DataFrame:
    """(node, bits, bands) of different texts -> (node, component): nodes that share a band and differ in at most `max_bits` bits are linked.

    The nodes of a band are compared in tiles of about TILE. Bands of more are cut into tiles by hashes, another cut in
    each, and their hub is in all of their tiles: the node whose bands hold most nodes, which is what the group's texts
    were made from, if they are copies of one. That leaves few components of a band of copies; the pairs of different components
    are then compared too, so every link is found, whatever the band's size.
    """
    keyed = reps.select("node", F.explode("bands").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keyed.join(met, "key"))
    grouped = components(_first_links(shared, reps, max_bits))
    if shared.filter(F.col("n") > TILE).isEmpty():
        return cut(grouped, shared)
    grouped = cut(grouped)
    across = _links_across(shared, grouped, reps, max_bits)
    return grouped if across.isEmpty() else components(across.union(grouped))


def distance_at(similarity: float) -> int:
    """The Hamming distance of fingerprints that 95 % of pairs with that share of common shingles, and more of closer ones, keep."""
    apart = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(SKETCH_BITS * apart + 1.64 * (SKETCH_BITS * apart * (1 - apart)) ** 0.5)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, fp (a 128-bit name of the text's words, A-Z lower-cased) and component_id (the smallest doc_id reachable).

    Links are texts of equal words and those of which about `similarity` of the distinct shingles are common (see distance_at).
    """
    found = cut(_sketched(docs, id_col, text_col, shingle))
    # Equal names have equal sketches, so any of a group's will do.
    own = [F.first(c).alias(c) for c in ("bits", "bands")]
    reps = cut(found.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows"), *own))
    grouped = similar_components(reps.select("node", "bits", "bands"), distance_at(similarity))
    return _with_components(found.select("doc_id", "fp"), reps.select("fp", "node", "rows"), grouped)
