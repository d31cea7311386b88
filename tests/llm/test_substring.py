import hashlib
import random
import re
from collections import Counter

import awkward
import numpy as np
import pytest

from sessionmill.llm import substring_dedup as m
from sessionmill.llm.fm_index import FmIndex, WaveletMatrix, suffix_order

END = 1 << 62


def brute(data, window):
    docs = sorted({(END if i is None else i, t or "") for i, t in data})
    first, out = {}, {}
    split = {d: [x for x in re.split(r"[\x20\x09-\x0D]+", d[1]) if x] for d in docs}
    for d in docs:
        for s in range(len(split[d]) - window + 1):
            first.setdefault(tuple(split[d][s : s + window]), (d, s))
    for d, w in split.items():
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (d, s):
                keep[s : s + window] = [False] * window
        kept = " ".join(x for x, k in zip(w, keep) if k)
        out[d] = (len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return Counter((i, *out[(END if i is None else i, t or "")]) for i, t in data)


@pytest.mark.parametrize("options", [{}, {"window": 5, "anchor_words": 2}, {"window": 6, "anchor_words": 3, "hot_runs": 2, "index_rows": 3}, {"window": 20, "hot_runs": 1}])
def test_against_brute_force(spark, options):
    data = [(r[0], r[1]) for r in awkward.rows()]
    got = m.substring_dedup(awkward.frame(spark).repartition(5), **options).collect()
    # Where only the id is shared, either text may count as the earlier: the rows have distinct ids but for full repeats.
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == brute(data, options.get("window", 20))


def test_removed_stretches_and_empty_table(spark):
    data = [(1, " ".join(map(str, range(30)))), (2, "a b " + " ".join(map(str, range(5, 27))) + " c")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in m.substring_dedup(docs).collect()}
    assert got == {1: [], 2: [(2, 24)]}
    assert m.substring_dedup(docs.limit(0)).count() == 0


def test_random_repeats(spark):
    rng = random.Random(5)
    data = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for options in ({"window": 4, "anchor_words": 2}, {"window": 9, "anchor_words": 1}, {"window": 7, "anchor_words": 7}):
        got = m.substring_dedup(docs, **options).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == brute(data, options["window"])


def test_sliding_least():
    x = np.random.default_rng(1).integers(0, 100, 50)
    for width in range(1, 20):
        assert m.sliding_least(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 500):
        symbols = rng.integers(0, 20, n)
        w = WaveletMatrix(symbols, 5)
        for c in range(20):
            at = np.arange(n + 1)
            ranks = w.descend(np.full(n + 1, c), at) - w.descend(np.array([c]), np.array([0]))
            assert ranks.tolist() == [int((symbols[:i] == c).sum()) for i in at]


def test_matching_statistics_against_counting():
    rng = np.random.default_rng(4)
    passages = [rng.integers(1, 4, rng.integers(6, 15)) for _ in range(30)]
    symbols = np.concatenate([np.r_[p, 0] for p in passages])
    index = FmIndex(symbols, 15)
    assert not any(isinstance(x, np.ndarray) and len(x) >= len(symbols) for x in vars(index).values())  # neither text nor suffix order stays
    stretches = Counter(tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1))
    stream, ends, want = [], [], []
    for p in [*passages, np.array([3, 3, 3, 3, 3, 3, 1, 1, 1]), rng.integers(1, 4, 12)]:
        for j in range(5, len(p)):
            ends.append(len(stream) + j)
            want.append(max((n for n in range(1, 6) if stretches[tuple(p[j + 1 - n : j + 1])] >= 2), default=0))
        stream += [*p, 0]
    length, lo = index.matching_statistics(np.array(stream), np.array(ends), 5)
    assert length.tolist() == want
    order = suffix_order(symbols, 15)
    assert sorted(order.tolist()) == list(range(len(symbols)))
    for end, n, first in zip(ends, length.tolist(), lo.tolist(), strict=True):
        if n == 5:
            assert symbols[order[first] : order[first] + 5].tolist() == stream[end - 4 : end + 1]


def test_one_id_on_all_rows(spark):
    """Rows of one id and different texts: one of two texts counts as the earlier, so what they share goes once."""
    shared = " ".join(f"s{i}" for i in range(25))
    texts = [f"a{i} b{i} {shared} c{i}" for i in range(30)]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(7, texts[0])] * 20, "doc_id long, text string")
    rows = m.substring_dedup(docs).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault((r.kept_sha256, r.n_removed), 0)
        by_text[(r.kept_sha256, r.n_removed)] += 1
    assert len(rows) == 50 and len(by_text) == 30 and sorted(n for (_, n) in by_text) == [0] + [25] * 29


def test_rows_given_very_often(spark):
    """Equal rows of a document, in the first document of a passage and in a later one, give what one row gives."""
    text = " ".join(f"w{i}" for i in range(300))
    later = "x " + " ".join(f"w{i}" for i in range(100, 200)) + " y"
    data = [(1, text), (2, later), (3, later), (None, text)]
    want = brute(data, 20)
    docs = spark.createDataFrame(data * 300, "doc_id long, text string").repartition(7)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in m.substring_dedup(docs, hot_runs=50).collect())
    assert got == Counter({k: 300 * n for k, n in want.items()})
