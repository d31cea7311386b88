import re
from collections import Counter, defaultdict

import awkward
import numpy as np
import pytest
import xxhash
from helpers import SMALL, assert_same, duck
from pyspark.sql import functions as F

from sessionmill.llm import components, exact_dedup, queries, simhash


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    data = awkward.rows()
    digest = (lambda c: (F.length(c) % 3).cast("string")) if weak else exact_dedup.sha256_hex
    got = exact_dedup.exact_groups(awkward.frame(spark).repartition(5), digest=digest).collect()
    groups = defaultdict(list)
    for r in data:
        groups[normal(r[1])].append(r[0])
    want = Counter()
    for members in groups.values():
        keep = min((m for m in members if m is not None), default=None)
        want.update((m, keep, len(members), m == keep) for m in members)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want


def test_exact_dedup_keeps_columns_and_one_row(spark):
    docs = awkward.frame(spark)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.schema == docs.schema
    texts = Counter(normal(r.text) for r in kept.collect())
    assert set(texts) == {normal(r[1]) for r in awkward.rows()} and max(texts.values()) == 1
    assert exact_dedup.exact_groups(awkward.empty(spark)).count() == 0 and exact_dedup.exact_dedup(awkward.empty(spark)).count() == 0


def test_two_contents_under_both_digests_stop_the_job(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.lit(1).cast("long"))
    with pytest.raises(Exception, match="share both digests"):
        exact_dedup.exact_groups(awkward.frame(spark), digest=lambda c: F.lit("same")).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_duckdb(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), duck(SMALL), queries.ORACLE_SQL[name])


def slow_fingerprint(text, k=3):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if x]
    shingles = [w[i : i + k] for i in range(len(w) - k + 1)] if len(w) >= k else [w] * bool(w)
    h = [xxhash.xxh64_intdigest(b" ".join(s), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(items, linked):
    """The least member that each item can reach."""
    root = dict.fromkeys(items)
    for i in sorted(items):
        if root[i] is None:
            root[i], todo = i, [i]
            while todo:
                x = todo.pop()
                for y in items:
                    if root[y] is None and linked(x, y):
                        root[y] = i
                        todo.append(y)
    return root


@pytest.mark.parametrize("radius,tile", [(3, 4096), (3, 2), (14, 4), (20, 4096)])
def test_near_groups(spark, radius, tile):
    data = awkward.rows()
    fps = {normal(r[1]): slow_fingerprint(r[1]) for r in data}
    got = simhash.near_groups(awkward.frame(spark), radius=radius, tile=tile).collect()
    assert len(got) == len(data)
    root = classes(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= radius)
    least = {}
    for r in data:
        c = root[fps[normal(r[1])]]
        least[c] = min((x for x in (least.get(c), r[0]) if x is not None), default=None)
    want = Counter((r[0], fps[normal(r[1])], least[root[fps[normal(r[1])]]]) for r in data)
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want


def test_hash_is_that_of_spark(spark):
    for s in ("", "a", "über drei wörter", "x" * 1000):
        assert spark.range(1).select(F.xxhash64(F.lit(s)).alias("h")).first().h & (1 << 64) - 1 == xxhash.xxh64_intdigest(s.encode(), 42)


@pytest.mark.parametrize("n", [10, 10**7, 10**10, 10**13])
def test_block_choices_cover_the_radius(n):
    tables = simhash.block_choices(n)
    rng = np.random.default_rng(1)
    for _ in range(300):
        flips = set(rng.choice(64, 3, replace=False).tolist())
        assert any(not any(f <= x < f + bits for x in flips for f, bits in t) for t in tables)


def test_links_of_a_dense_crowd(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    crowd = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (40, 2))}
    fps = spark.createDataFrame([(x,) for x in crowd], "fp long")
    for tile in (4096, 50):
        links = simhash.near_links(fps, len(crowd), tile=tile).collect()
        assert all((r.a ^ r.b).bit_count() >= 0 for r in links) and len(links) < 5 * len(crowd)
        joined = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
        want = classes(crowd, lambda a, b: (a ^ b).bit_count() <= 3)
        found = defaultdict(set)
        for x in crowd:
            found[joined.get(x, x)].add(x)
        expected = defaultdict(set)
        for x in crowd:
            expected[want[x]].add(x)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("links", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(30)], [(0, i) for i in range(1, 20)], [(i, 50) for i in range(20)], [(5, 9), (9, 7), (7, 5), (2, 3), (3, 2)]])
def test_components(spark, links):
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    items = {x for p in links for x in p if None not in p}
    pairs = {p for p in links if None not in p} | {p[::-1] for p in links}
    want = classes(items, lambda a, b: (a, b) in pairs)
    assert all(got.get(x, x) == want[x] for x in items) and not set(got) - items


@pytest.mark.parametrize("hot", [10_000, 50])
def test_long_chains_fold_in_few_rounds(spark, monkeypatch, hot):
    """Two chains of a thousand that meet at their largest nodes, and a hub."""
    monkeypatch.setattr("sessionmill.llm.common.HOT_ROWS", hot)
    rounds = []
    monkeypatch.setattr(components, "checkpointed", lambda df: rounds.append(1) or df.checkpoint(eager=True))
    n = 1000
    left, right = list(range(0, 2 * n, 2)), list(range(1, 2 * n, 2))
    links = [*zip(left, left[1:], strict=False), *zip(right, right[1:], strict=False), (left[-1], right[-1])]
    links += [(5000, 5001 + i) for i in range(300)] + [(9000 - i, 9001) for i in range(300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[x] == 0 for x in range(1, 2 * n)) and all(got[5001 + i] == 5000 for i in range(300)) and got[9001] == got[8990] == 8701
    assert len(rounds) <= 1 + 2 * 13


def test_no_documents(spark):
    assert simhash.near_groups(awkward.empty(spark)).count() == 0
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0
