import random
from collections import Counter, defaultdict
from fractions import Fraction

import awkward
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionmill.llm import best_fit_packing as P
from sessionmill.llm import pfair_mix as M


def fluid(blocks, weights, t):
    """What each source has been given when t blocks went in all: rounds of sharing what is left among those not dry."""
    given, left = {k: Fraction(0) for k in blocks}, Fraction(t)
    while left:
        wet = [k for k in blocks if given[k] < blocks[k]]
        total = sum(Fraction(weights[k]) for k in wet)
        step = min([left / total] + [(blocks[k] - given[k]) / Fraction(weights[k]) for k in wet])
        for k in wet:
            given[k] += step * Fraction(weights[k])
        left -= step * total
    return given


def slow_schedule(blocks, weights):
    """Slot by slot from the definition: of the sources whose next block is released, the one whose target reaches it first."""
    end = sum(blocks.values())
    x = [fluid(blocks, weights, t) for t in range(end + 1)]
    done, out = dict.fromkeys(blocks, 0), {k: [] for k in blocks}
    for t in range(end):
        free = [k for k in blocks if done[k] < blocks[k] and x[t + 1][k] > done[k]]
        k = min(free, key=lambda k: (next(d for d in range(end + 1) if x[d][k] >= done[k] + 1), k))
        out[k].append(t)
        done[k] += 1
        assert all(abs(done[k] - x[t + 1][k]) < 1 for k in blocks)
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.tuples(st.integers(1, 12), st.floats(0.01, 100)), min_size=1, max_size=8))
def test_schedule_against_a_slow_one(sources):
    blocks, weights = {k: n for k, (n, _) in sources.items()}, {k: w for k, (_, w) in sources.items()}
    assert {k: x.tolist() for k, x in M.schedule(blocks, weights).items()} == slow_schedule(blocks, weights)


@pytest.mark.parametrize("n", [2, 10, 100, 1000, 5000])
def test_a_heavy_source_and_many_light_ones(n):
    """Weights of 1000 and of 1: no source is ever a block from its weight's part, while none has run dry."""
    weights = {f"s{i}": 1000 if not i else 1 for i in range(n)}
    blocks = {k: 20_000 if w > 1 else 20 for k, w in weights.items()}
    total = 1000 + n - 1
    slots = M.schedule(blocks, weights)
    assert np.array_equal(np.sort(np.concatenate(list(slots.values()))), np.arange(sum(blocks.values())))
    for k, own in slots.items():
        i = np.arange(len(own))
        assert (own * weights[k] < total * (i + 1)).all() and ((own + 1) * weights[k] > total * i).all()


def test_mix_against_a_slow_schedule(spark, monkeypatch):
    monkeypatch.setattr(M, "STRETCH", 7)
    rng = random.Random(1)
    data = [(i, rng.choice("aaaaaabbc")) for i in range(500)] + [(1000, None), (1000, None)]
    docs = spark.createDataFrame(data, "doc_id long, source string")
    weights = {"a": 1.0, "b": 2.0, "c": 1.0, None: 0.5}
    rows = M.pfair_mix(docs, weights, block_rows=3).collect()
    assert sorted(r["__place"] for r in rows) and len({r["__place"] for r in rows}) == len(data)
    sizes = Counter(r["source"] for r in rows)
    want = slow_schedule({M_key(k): -(-n // 3) for k, n in sizes.items()}, {M_key(k): w for k, w in weights.items()})
    assert all(want[M_key(r["source"])][r["__block"]] == r["__slot"] for r in rows)
    for source in sizes:
        assert sorted(Counter(r["__block"] for r in rows if r["source"] == source).values(), reverse=True)[: sizes[source] // 3] == [3] * (sizes[source] // 3)


def test_mix_of_one_id_and_of_more_sources_than_rows_of_a_block(spark):
    one = spark.createDataFrame([(7, "a")] * 3000, "doc_id long, source string")
    rows = M.pfair_mix(one).collect()
    assert sorted(r["__place"] for r in rows) == list(range(3000))
    many = spark.range(1500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"), F.lit(1).alias("source_key"), F.lit(2).alias("__slot"))
    rows = M.pfair_mix(many, lambda sizes: dict.fromkeys(sizes, 1.0)).collect()
    assert sorted(r["__slot"] for r in rows) == list(range(1500)) and rows[0].source_key == 1
    with pytest.raises(ValueError, match="positive"):
        M.pfair_mix(many, lambda sizes: dict.fromkeys(sizes, 0.0))


def M_key(source):
    return "" if source is None else f"={source}"


def test_mix_awkward(spark):
    docs = awkward.frame(spark)
    mixed = M.mixed_order(docs)
    assert mixed.schema == docs.schema and Counter(map(str, mixed.collect())) == Counter(map(str, docs.collect()))
    assert M.mixed_order(awkward.empty(spark)).count() == 0
    with pytest.raises(ValueError, match="no weight"):
        M.pfair_mix(docs, {"a": 1.0})


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60))
def test_packing_is_valid(lengths):
    capacities = (8, 16, 64)
    placed = P.pack(lengths, capacities)
    filled, capacity = defaultdict(int), {}
    for n, (b, c) in zip(lengths, placed, strict=True):
        filled[b] += n
        assert capacity.setdefault(b, c) == c
    assert all(filled[b] <= c and not any(filled[b] <= x < c for x in capacities) for b, c in capacity.items())


def slow_pack(lengths, capacities, cost):
    """Straight from the definition, with lists that are scanned from end to end."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins, where = [], {}  # [room left, words inside]
    for nth, i in enumerate(order):
        fits = [b for b, (room, _) in enumerate(bins) if room >= lengths[i]]
        if not fits:
            best = None
            for c in sorted(c for c in capacities if c >= lengths[i]):
                filled = lengths[i]
                for j in order[nth + 1 :]:
                    if filled + lengths[j] <= c:
                        filled += lengths[j]
                price = cost(c) / max(1, filled)
                if best is None or price < best[0]:
                    best = price, c
            bins.append([best[1], 0])
            fits = [len(bins) - 1]
        b = min(fits, key=lambda b: (bins[b][0], b))
        bins[b][0] -= lengths[i]
        bins[b][1] += lengths[i]
        where[i] = b
    return [(where[i], min(c for c in capacities if c >= bins[where[i]][1])) for i in range(len(lengths))]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=40), st.sampled_from([(64,), (8, 16, 64), (10, 30, 64), (1, 2, 4, 8, 16, 32, 64)]), st.sampled_from([0.0, 0.3, 20.0]))
def test_packing_against_a_slow_one(lengths, capacities, fixed):
    cost = lambda c: fixed + c + c * c / 100
    assert P.pack(lengths, capacities, cost) == slow_pack(lengths, capacities, cost)


def test_lanes_split_one_id_and_long_documents_pass_them_by(spark):
    docs = spark.createDataFrame([(5, "a b c")] * 600 + [(5, "x " * 5000), (None, "y " * 64)], "doc_id long, text string")
    rows = P.best_fit_packing(docs, capacities=(8, 64), lane_rows=50).collect()
    sizes = Counter(r.lane for r in rows if r.bin >= 0)
    assert len(sizes) >= 10 and max(sizes.values()) < 100
    full = [r for r in rows if r.bin < 0]
    assert len(full) == 5000 // 64 + 1 == len({(r.lane, r.bin) for r in full}) and all(r.length == r.capacity == 64 for r in full)
    assert sum(r.length for r in rows) == 600 * 3 + 5000 + 64 and len(rows) == 600 + 5000 // 64 + 1 + 1


def test_each_piece_takes_the_tightest_bin():
    assert len({b for b, _ in P.pack([60, 50, 14, 4], (64,))}) == 2
    assert P.pack([60, 50, 14, 4], (64,)) == [(0, 64), (1, 64), (1, 64), (0, 64)]
    assert P.pack([5], (8, 16, 64)) == [(0, 8)]
    assert P.pack([0, 0], (8, 16)) == [(0, 8), (0, 8)] and P.pack([], (8,)) == []


def test_fill_and_waste():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 4000) for _ in range(2000)]
    placed = P.pack(lengths)
    capacity = dict(placed)
    assert sum(lengths) / sum(capacity.values()) > 0.97


def test_packing_awkward(spark):
    data = awkward.rows()
    rows = P.best_fit_packing(awkward.frame(spark), capacities=(32, 64), lane_rows=16).collect()
    by_doc = defaultdict(int)
    bins = defaultdict(int)
    for r in rows:
        by_doc[r.doc_id] += r.length
        bins[(r.lane, r.bin)] += r.length
        assert r.length <= 64 and r.start == 64 * r.piece
    want = defaultdict(int)
    for r in data:
        want[r[0]] += len([x for x in (r[1] or "").replace(" ", "_").split(" ") for x in x.split()])
    assert by_doc == want
    assert all(bins[(r.lane, r.bin)] <= r.capacity for r in rows)
    places = Counter((r.lane, r.bin, r.place) for r in rows)
    assert max(places.values()) == 1
    assert P.best_fit_packing(awkward.empty(spark)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string", "decimal(20,0)"])
def test_packing_keeps_large_ids_beside_null(spark, kind):
    ids = [None, 2**53 + 1, 2**53 + 3, -(2**62) - 1, None]
    docs = spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = P.best_fit_packing(docs, lane_rows=100).select(F.col("doc_id").cast("long")).collect()
    assert sorted(str(r[0]) for r in got) == sorted(map(str, ids))


def test_very_many_sources_of_one_block():
    slots = M.schedule({f"s{i}": 1 for i in range(60_000)}, dict.fromkeys((f"s{i}" for i in range(60_000)), 1.0))
    assert np.array_equal(np.sort(np.concatenate(list(slots.values()))), np.arange(60_000))
