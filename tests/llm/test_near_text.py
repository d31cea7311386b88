import math
import random
import re
from collections import Counter

import awkward
import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from sessionmill.llm import shingles as shingle_module
from sessionmill.llm import simhash


def shingles(text, k=5):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def linked(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def slow_groups(rows):
    """The smallest id of each row's group, in the order of the rows."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and linked(sets[i], sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [min((r[0] for r, g in zip(rows, group, strict=True) if g == own and r[0] is not None), default=None) for own in group]


def planted():
    """Texts with copies in which some words differ, common passages, and a crowd of near copies."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.choice((3, 6, 12, 40, 150, 700)))] for _ in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for base in list(texts):
        for changes in (1, max(1, len(base) // 60), max(1, len(base) // 40)):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    texts += [passage + [rng.choice(vocabulary) for _ in range(rng.choice((5, 10, 14, 18, 60)))] for _ in range(50)]
    crowd = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(60):
        copy = list(crowd)
        copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("tile,set_tile,common", [(4096, 1024, 5), (4096, 8, 5), (8, 4096, 10**9), (6, 5, 5)])
def test_planted_near_copies_against_brute_force(spark, monkeypatch, tile, set_tile, common):
    monkeypatch.setattr(shingle_module, "COMMON", common)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs, tile=tile, set_tile=set_tile).collect()}
    want = slow_groups(rows)
    assert [got[i] for i, _ in rows] == want and len(set(want)) < len(rows) - 59


def test_stage_drops_near_copies(spark):
    """Copies with every fortieth word changed: similar by shingles, but often far apart by their fingerprints."""
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in pipeline.dedup_near(spark, docs, "").collect()} == set(slow_groups(rows))


def test_awkward_rows(spark):
    docs = awkward.frame(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = Counter((r.doc_id, r.component_id) for r in simhash.similar_groups(docs).collect())
    groups = slow_groups(rows)
    assert got == Counter(zip((i for i, _ in rows), groups, strict=True))
    kept = simhash.near_dedup(docs)
    assert kept.schema == docs.schema and Counter(r.doc_id for r in kept.collect()) == Counter(set(groups))
    none = awkward.empty(spark).select(F.col("doc_id"), F.col("text"))
    assert simhash.similar_groups(none).count() == 0 and simhash.near_dedup(none).count() == 0


def test_one_row_of_each_group_stays_though_ids_repeat(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    shape = "doc_id long, text string, gone_id int, _gone_mark int"
    rows = [(1, a, 1, 1), (3, a, 2, 2), (3, b, 3, 3), (3, b, 4, 4), (4, b, 5, 5), (None, a, 6, 6)]
    got = simhash.near_dedup(spark.createDataFrame(rows, shape)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, a), (3, b)]
    same = spark.createDataFrame([(7, a if i % 2 else b, i, i) for i in range(60)], shape)
    assert sorted(r.text for r in simhash.near_dedup(same).collect()) == [a, b]
    none = spark.createDataFrame([(None, a, i, i) for i in range(60)], shape)
    assert simhash.near_dedup(none).count() == 1


def bit_differs(both, a, b):
    """The chance that a bit of two fingerprints differs whose sets share `both` shingles and hold a and b more."""
    chance = lambda n: [math.comb(n, k) / 2**n for k in range(n + 1)]

    def above(n, limit):  # more than `limit` of n
        return sum(x for k, x in enumerate(chance(n)) if k > limit)

    out = 0.0
    for x, p in enumerate(chance(both)):
        s, t = above(a, (both + a) / 2 - x), above(b, (both + b) / 2 - x)
        out += p * (s * (1 - t) + t * (1 - s))
    return out


@pytest.mark.parametrize("n", [41, 50, 60, 101, 300])
def test_pairs_at_the_limit_are_within_the_radius(n):
    """The exact chance for sets of n shingles at a similarity of just 0.8, ties of bits included."""
    bits, radius = 64 * simhash.WIDE_WORDS, simhash.wide_radius(0.8)
    for both in {-(-4 * n // 5), -(-9 * n // 10)}:
        p = bit_differs(both, 5 * both // 4 - n, n - both)
        beyond = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(radius + 1, bits + 1))
        assert beyond < 3 * simhash.WIDE_LOSS
    strangers = sum(math.comb(bits, k) for k in range(radius + 1)) / 2**bits
    assert strangers < 1e-9


def test_no_pair_is_lost_just_at_the_limit(spark):
    """2,000 pairs of 41 to 60 shingles of their own words, as far apart as 0.8 allows."""
    rng, rows = random.Random(11), []
    for i in range(2000):
        words = [f"p{i}x{j}" for j in range(rng.randrange(45, 65))]
        n = len(words) - 4
        gone = n - -(-8 * n // 9)  # shingles of an end that are swapped for others: n - gone of n + gone are shared
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: len(words) - gone] + [f"q{i}x{j}" for j in range(gone)]))]
    apart = [len(a & b) / len(a | b) for a, b in ((shingles(rows[k][1]), shingles(rows[k + 1][1])) for k in range(0, len(rows), 2))]
    assert min(apart) >= 0.8 and sum(apart) / len(apart) < 0.82
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got) and len(got) == len(rows)
