"""SimHash near-dedup with exact tiled comparison of fingerprints.

Fingerprints are compared once each, however many documents share them. Under a key numpy compares
whole tiles by exclusive-or and bit counts and skips tiles whose population counts differ by more than
the radius. A task returns a spanning forest of the links it finds, never all pairs; keys with more
fingerprints than a tile are dealt into tiles (see tiles.py). Two ways to make keys and links:

* near_groups() links fingerprints of 64 bits within a few bits. Two of them agree on at least
  m - radius of m blocks of bits, so every choice of m - radius blocks makes a table in which they meet
  under the same key; m grows with the number of fingerprints.
* similar_groups() links texts by the Jaccard similarity of their shingles. Two similar texts are sure
  to share one of their first shingles (see shingles.py), which are the keys; fingerprints of 256 bits
  within a wide radius make candidate groups; and within these the sets themselves decide.
"""

from __future__ import annotations

import math
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm import shingles
from sessionmill.llm.common import checkpointed, free_names, named, shared_table, spread_join, table
from sessionmill.llm.components import components
from sessionmill.llm.tiles import Forest, group_links, whole_groups

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
#: Fingerprints of one key that a task compares at once.
TILE = 4096
#: Rows that a task compares at once, about: whole keys.
ROWS = 1 << 16
#: Words of 64 bits in a wide fingerprint, as columns, and the share of pairs just at the limit that may lie beyond its radius.
WIDE_WORDS, WIDE_LOSS = 4, 1e-9
WIDE = tuple(f"word{i}" for i in range(WIDE_WORDS))
#: Sets of at most this many shingles are candidates whatever their fingerprints: a few shingles do not make steady ones.
FEW_SHINGLES = 40
#: Sets of one candidate group that a task compares as wholes.
SET_TILE = 1024
#: Most rows that are sent to all executors as a filter; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64 bits, each set where it is set in over half of the shingles' hashes; 0 for no words."""
    w = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    if len(w) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(w[i:] for i in range(shingle_words)), strict=False)
    n = len(w) - shingle_words + 1
    hashes = np.fromiter((digest(join(s), SEED) for s in shingles), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Return doc_id and fp (a signed 64-bit number), one row per input row; null counts as empty."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(t or b"", shingle_words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    read = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    return read.mapInArrow(run, f"doc_id {dict(read.dtypes)['doc_id']}, fp long")


def block_choices(n_fingerprints: int, radius: int = RADIUS) -> list[tuple[tuple[int, int], ...]]:
    """Tables as tuples of (first bit, bits): few tables while keys stay small, more for more fingerprints."""
    m = radius + 1
    while m < 16 and n_fingerprints > 64 << (64 * (m - radius) // m) and comb(m + 1, radius) <= 40:
        m += 1
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(m)]
    return list(combinations(blocks, m - radius))


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, whose words are along the last axis."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def link_group(fps: np.ndarray, places: np.ndarray, forest: Forest, radius: int, sizes: np.ndarray | None = None, similarity=None) -> None:
    """Join all fingerprints of one group that chains of links connect, tile by tile; with sizes, only those of similar size are linked."""
    pops = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.argsort(pops, kind="stable")
    fps, places, pops = fps[order], places[order], pops[order]
    sizes = None if sizes is None else sizes[order]
    alive = np.arange(len(fps))
    while len(alive):
        frontier, alive = [int(alive[0])], alive[1:]
        root = places[frontier[0]]
        while frontier and len(alive):
            tile, frontier = np.sort(np.array(frontier[:64])), frontier[64:]
            lo = np.searchsorted(pops[alive], pops[tile[0]] - radius, "left")
            hi = np.searchsorted(pops[alive], pops[tile[-1]] + radius, "right")
            if lo == hi:
                continue
            near = np.zeros(len(alive), bool)
            own = alive[lo:hi]
            linked = distance(fps[tile][:, None], fps[own][None]) <= radius
            if sizes is not None:
                linked &= similar_sizes(sizes[tile][:, None], sizes[own][None], similarity)
            near[lo:hi] = linked.any(axis=0)
            if near.any():
                found = alive[near]
                for p in places[found].tolist():
                    forest.union(int(root), p)
                frontier += found.tolist()
                alive = alive[~near]


def similar_sizes(n: np.ndarray, m: np.ndarray, similarity) -> np.ndarray:
    return similarity.denominator * np.minimum(n, m) >= similarity.numerator * np.maximum(n, m)


def _compare(radius: int, similarity=None, small: int = 24):
    """Links among the rows (key, node, words of the fingerprint, size if there is a similarity) that share a key."""

    def run(batches):
        for table in whole_groups(batches, ROWS):
            columns = [table.column(i).to_numpy() for i in range(table.num_columns)]
            key, n_words = columns[0], len(columns) - (2 if similarity is None else 3)
            nodes, first, places = np.unique(columns[1], return_index=True, return_inverse=True)
            fps = np.stack([x[first].view(np.uint64) for x in columns[2 : 2 + n_words]], axis=1)
            sizes = None if similarity is None else columns[-1][first]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            counts = np.diff(np.r_[starts, len(key)])
            forest = Forest(len(nodes))
            for i in np.flatnonzero(counts > small):
                own = np.unique(places[starts[i] : starts[i] + counts[i]])
                link_group(fps[own], own, forest, radius, None if sizes is None else sizes[own], similarity)
                if sizes is not None and (few := own[sizes[own] <= FEW_SHINGLES]).size > 1:
                    link_group(np.zeros((len(few), 1), np.uint64), few, forest, radius, sizes[few], similarity)
            group = np.repeat(np.arange(len(starts)), counts)
            keep = np.repeat(counts <= small, counts)
            group, own = group[keep], places[keep]
            for d in range(1, small):  # all small groups at once
                if len(group) <= d:
                    break
                same = np.flatnonzero(group[d:] == group[:-d])
                x, y = own[same], own[same + d]
                near = distance(fps[x], fps[y]) <= radius
                if sizes is not None:
                    near = (near | (np.maximum(sizes[x], sizes[y]) <= FEW_SHINGLES)) & similar_sizes(sizes[x], sizes[y], similarity)
                for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
                    forest.union(i, j)
            roots = np.fromiter((forest.find(i) for i in range(len(nodes))), np.int64, len(nodes))
            linked = roots != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[roots[linked]])], ["a", "b"])

    return run


def near_links(fps: DataFrame, n_fingerprints: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints `fp` just as all pairs within the radius would."""
    tables = []
    for t, blocks in enumerate(block_choices(n_fingerprints, radius)):
        key = F.lit(0).cast("long")
        for first, bits in blocks:
            part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1)) if bits < 64 else F.col("fp")
            key = F.shiftleft(key, bits).bitwiseOR(part) if bits < 64 else part
        tables.append(F.xxhash64(F.lit(t), key))
    rows = fps.select(F.explode(F.array(*tables)).alias("key"), F.col("fp").alias("node"), "fp")
    return group_links(rows, _compare(radius), tile, F.bit_count("fp"), radius)


def near_groups(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, fp and component_id (the smallest id of the group), one row per input row.

    Documents belong together when a chain of fingerprints, each within `radius` bits of the next,
    connects them. Null, empty and blank texts have fingerprint 0, which links like any other; a
    text of fewer words than a shingle is one shingle. Equal texts share a fingerprint, so copies and
    repeated rows fall in one group. Other columns are ignored; an empty table gives an empty result.
    """
    by_doc = checkpointed(fingerprints(docs, id_col, text_col, shingle_words))
    nodes = checkpointed(by_doc.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(nodes.select("fp"), nodes.count(), radius, tile))
    rooted = checkpointed(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = checkpointed(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = checkpointed(spread_join(rooted.select("fp", "root"), least, "root").select("fp", "component_id"))
    return spread_join(by_doc, named, "fp").select("doc_id", "fp", "component_id")


def wide_fingerprint(shingle_set: np.ndarray) -> list[int]:
    """WIDE_WORDS words of 64 bits, each bit set where it is set in over half of the shingles; all 0 for none."""
    n = len(shingle_set)
    counts = np.zeros(64 * WIDE_WORDS, np.int64)
    with np.errstate(over="ignore"):
        salts = [np.uint64(k) * shingles._STEP for k in range(1, WIDE_WORDS)]
    for i in range(0, n, 1 << 14):
        part = shingle_set[i : i + (1 << 14)]
        words = np.stack([part, *(shingles.scramble(part ^ salt) for salt in salts)], axis=1)
        counts += np.unpackbits(words.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > n).view(np.int64).tolist()


def wide_radius(similarity: float, bits: int = 64 * WIDE_WORDS, loss: float = WIDE_LOSS) -> int:
    """The least radius that at most `loss` of all pairs at the limit exceed, and far fewer above it.

    Sets with a Jaccard similarity of s have a cosine of at least 2s / (1 + s), so that each bit differs with a chance
    of at most acos(2s / (1 + s)) / pi; bits come from separate hashes, so the number that differ is binomial.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    beyond, radius = 1.0, -1
    while beyond > loss and radius < bits:
        radius += 1
        beyond = math.fsum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(radius + 1, bits + 1))
    return radius


def _sketched(docs: DataFrame, common: np.ndarray, similarity: float, shingle_words: int) -> DataFrame:
    """For each row of doc_id, text: mark (a hash of the text), node (a hash of its set), size, fingerprint, and head."""
    wanted = shingles.as_fraction(similarity)

    def run(batches):
        for batch in batches:
            nodes, sizes, prints, heads = [], [], [], []
            for s in shingles.shingle_sets(batch.column(1), shingle_words):
                nodes.append(xxhash.xxh64_intdigest(s.tobytes()))
                sizes.append(len(s))
                prints.append(wide_fingerprint(s))
                heads.append(shingles.head(s, common, wanted))
            flat = np.concatenate(heads).view(np.int64) if heads else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, heads)]), pa.int32()), pa.array(flat))
            own = [np.array(nodes, np.uint64).view(np.int64), *np.array(prints, np.int64).reshape(-1, WIDE_WORDS).T, np.array(sizes, np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, own), lists], ["doc_id", "mark", "node", *WIDE, "size", "head"])

    read = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return read.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, mark long, node long, {', '.join(f'{w} long' for w in WIDE)}, size long, head array<long>")


def _keys(sketches: DataFrame, common: np.ndarray) -> DataFrame:
    """Rows of key and node for the shingles of all heads that several sets have, and perhaps some of one set."""

    def flat(want_common: bool):
        def run(batches):
            for batch in batches:
                _, first = np.unique(np.asarray(batch.column(0)), return_index=True)
                batch = batch.take(pa.array(np.sort(first)))
                lists = batch.column(1)
                counts = np.diff(np.asarray(lists.offsets))
                key, node = np.asarray(lists.flatten()), np.repeat(np.asarray(batch.column(0)), counts)
                keep = shingles.is_common(key.view(np.uint64), common) == want_common
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep])], ["key", "node"])

        return run

    def shared(batches):
        held = np.empty((2, 0), np.int64)  # the last row so far; it is given out with the next, if that shares its key
        out = False
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = np.hstack([held, np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))])])
            new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            again = np.r_[False, key[1:] == key[:-1]] & new
            group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
            many = np.bincount(group, again)[group] > 0  # of a key with two nodes or more
            keep = new & many
            if held.shape[1]:
                keep[0] = not out and many[0]
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep])], ["key", "node"])
            out = bool((out and group[-1] == 0) or many[-1])
            held = np.array([[key[-1]], [node[-1]]])

    heads = sketches.select("node", "head")
    asked = heads.mapInArrow(flat(False), "key long, node long").repartition("key").sortWithinPartitions("key", "node")
    return asked.mapInArrow(shared, "key long, node long").unionByName(heads.mapInArrow(flat(True), "key long, node long"))


def _linked_sets(similarity, shingle_words: int, radius: int):
    """Links among the rows (key, node, size, text) of a candidate group, by the similarity of their sets."""
    num, den = similarity.numerator, similarity.denominator

    def group(rows: pa.Table):
        nodes, first = np.unique(rows.column("node").to_numpy(), return_index=True)
        sets = list(shingles.shingle_sets(rows.column("text").combine_chunks().take(pa.array(first)), shingle_words))
        sizes = np.array([len(s) for s in sets])
        order = np.argsort(sizes, kind="stable")
        nodes, sizes, sets = nodes[order], sizes[order], [sets[i] for i in order]
        fps = np.array([wide_fingerprint(s) for s in sets], np.int64).view(np.uint64)
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ids, cuts = ids.astype(np.int32), np.r_[0, np.cumsum(sizes)]
        marked = np.zeros(len(names), bool)
        alive = np.arange(len(nodes))
        while len(alive) > 1:
            frontier, alive = [int(alive[0])], alive[1:]
            while frontier and len(alive):
                i = frontier.pop()
                least, most = -(-num * sizes[i] // den), den * sizes[i] // num
                lo, hi = np.searchsorted(sizes[alive], [least, most + 1])
                own = alive[lo:hi]
                own = own[(distance(fps[own], fps[i]) <= radius) | (np.maximum(sizes[own], sizes[i]) <= FEW_SHINGLES)]
                if not len(own):
                    continue
                marked[ids[cuts[i] : cuts[i + 1]]] = True
                flat = np.concatenate([ids[cuts[j] : cuts[j + 1]] for j in own])
                both = np.add.reduceat(marked[flat].astype(np.int64), np.r_[0, np.cumsum(sizes[own])[:-1]])
                marked[ids[cuts[i] : cuts[i + 1]]] = False
                found = own[(num + den) * both >= num * (sizes[own] + sizes[i])]
                if len(found):
                    yield nodes[found], np.full(len(found), nodes[i])
                    frontier += found.tolist()
                    alive = alive[~np.isin(alive, found)]

    def run(batches):
        for table in whole_groups(batches, SET_TILE):
            key = table.column("key").to_numpy()
            cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            links = [x for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if hi - lo > 1 for x in group(table.slice(lo, hi - lo))]
            if links:
                a, b = map(np.concatenate, zip(*links, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _bounded(df: DataFrame) -> DataFrame:
    """The rows, to be sent to all executors if their number allows that."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def _similar(docs: DataFrame, similarity: float, shingle_words: int, tile: int, set_tile: int) -> DataFrame:
    """For each row of doc_id, text: doc_id, mark and root, which similar texts share. Checkpointed."""
    wanted, radius = shingles.as_fraction(similarity), wide_radius(similarity)
    common = shingles.common_shingles(docs, shingle_words)
    sketches = shared_table(_sketched(docs, common, similarity, shingle_words))
    facts = sketches.groupBy("node").agg(F.min(F.struct(*WIDE, "size")).alias("f")).select("node", "f.*")
    rows = checkpointed(_keys(sketches, common).join(facts, "node").select("key", "node", *WIDE, "size"))
    # Sizes that differ by more than the similarity allows are at least two ranks apart.
    rank = F.floor(F.log(F.col("size")) / (1.0001 * math.log(1 / similarity) + 1e-9))
    candidates = components(group_links(rows, _compare(radius, wanted), tile, rank, 1))
    candidates = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root").distinct())
    # One text of each set with candidates; the candidate groups hold whole texts, once each.
    members = checkpointed(spread_join(sketches.select("node", "mark", "size"), candidates, "node", "inner").groupBy("node").agg(F.min(F.struct("root", "mark", "size")).alias("m")).select(F.col("m.root").alias("key"), "node", "m.mark", "m.size"))
    texts = docs.select("text", F.xxhash64("text").alias("mark")).join(_bounded(members), "mark")
    texts = checkpointed(texts.groupBy("key", "node", "size").agg(F.min("text").alias("text")))
    links = group_links(texts, _linked_sets(wanted, shingle_words, radius), set_tile, rank, 1)
    return checkpointed(spread_join(sketches.select("doc_id", "mark", "node"), components(links), "node").select("doc_id", "mark", F.coalesce("root", "node").alias("root")))


def similar_groups(docs: DataFrame, similarity: float = shingles.SIMILARITY, shingle_words: int = shingles.SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, set_tile: int = SET_TILE) -> DataFrame:
    """Return doc_id and component_id (the smallest id of the group), one row per input row.

    Documents belong together when a chain of texts connects them, each with a Jaccard similarity of at
    least `similarity` to the next, by distinct shingles in lower case (ASCII only). Null, empty and
    blank texts have no shingle and form one group; a text of fewer words than a shingle is one shingle.
    Sets are told apart by a 64-bit hash. Repeated rows and ids fall in the groups of their texts; other
    columns are ignored; an empty table gives an empty result.
    """
    found = _similar(docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text")), similarity, shingle_words, tile, set_tile)
    least = checkpointed(found.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return spread_join(found, least, "root").select("doc_id", "component_id")


def near_dedup(docs: DataFrame, similarity: float = shingles.SIMILARITY, shingle_words: int = shingles.SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each group of similar_groups().

    It is the row with the smallest id; a null id stays only where a group has no other. Of rows that
    share that id but not the text the one with the least hash stays, and of rows that share both one.
    """
    found = _similar(docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text")), similarity, shingle_words, TILE, SET_TILE)
    mine = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    best = found.groupBy("root").agg(F.min(mine).alias("best"))
    judged = checkpointed(spread_join(found, checkpointed(best), "root").select("doc_id", "mark", (mine == F.col("best")).alias("stays")))
    counts = checkpointed(judged.groupBy("doc_id", "mark").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("rows")).where("not stays or rows > 1"))
    gone_id, gone_mark = free_names(docs, "gone_id", "gone_mark")
    names = [F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark)]
    same = named(id_col).eqNullSafe(F.col(gone_id)) & (F.xxhash64(named(text_col)) == F.col(gone_mark))
    alone = docs.join(_bounded(counts.select(*names)), same, "left_anti")
    again = counts.where("stays").select(*names)
    if again.isEmpty():
        return alone
    several = docs.join(_bounded(again), same).dropDuplicates([gone_id, gone_mark])
    return alone.unionByName(several.select(*map(named, docs.columns)))


def query(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
