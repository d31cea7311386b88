import itertools
import math
import random
import re
import zlib
from collections import Counter

import awkward
import numpy as np
import pyarrow as pa
import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from sessionmill.llm import arrays, hmm_lm, language_id, quality_model
from sessionmill.llm.common import fold

MID = SMALL.replace("0.001", "0.01")


def words(text):
    return [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if x]


def test_words_of_a_batch():
    data = [r[1] for r in awkward.rows()]
    column = pa.array(["skipped", *data])[1:]
    got, hashes = [], {}
    for t in arrays.texts(column, limit=500):
        for i in range(t.hi - t.lo):
            a, b = t.word_offsets[i], t.word_offsets[i + 1]
            got.append([t.word(j) for j in range(a, b)])
            for j in range(a, b):
                assert hashes.setdefault(t.word(j), t.hashes[j]) == t.hashes[j]
    assert got == [words(x) for x in data] and len(set(hashes.values())) == len(hashes)
    assert arrays.hash_words(["ab", "über"]).tolist() == [int(next(arrays.texts(pa.array([x]))).hashes[0]) for x in ("ab", "über")]


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    trees = quality_model.fit_trees(x, y, trees=40)
    p = trees.probability(x)
    assert ((p > 0.5) == y).mean() > 0.97

    def walk(node, row):
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        return trees.value[node]

    slow = [trees.base + sum(walk(r, row) for r in trees.roots) for row in x[:50]]
    assert np.allclose(trees.raw(x[:50]), slow)
    assert quality_model.fit_trees(np.empty((0, 4)), np.empty(0)).probability(x[:2]).tolist() == [0.5, 0.5]


def test_a_split_is_the_best_of_all():
    """One tree of one split against a trial of every gap between two values."""
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x, y = rng.integers(0, 12, (50, 3)).astype(float), rng.integers(0, 2, 50).astype(float)
        trees = quality_model.fit_trees(x, y, trees=1, depth=1, least=5, ridge=1.0, rate=1.0)
        mean = y.mean()
        g, h = mean - y, np.full(50, mean * (1 - mean))
        score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)
        gains = {(j, cut): score(x[:, j] <= cut) + score(x[:, j] > cut) - score(np.ones(50, bool)) for j in range(3) for cut in range(11) if 5 <= (x[:, j] <= cut).sum() <= 45}
        j, cut = trees.feature[0], np.floor(trees.threshold[0])
        assert math.isclose(gains[(j, cut)], max(gains.values()), rel_tol=1e-9)
        for side in (x[:, j] <= cut, x[:, j] > cut):
            leaf = -g[side].sum() / (h[side].sum() + 1)
            assert np.allclose(trees.raw(x[side]), math.log(mean / (1 - mean)) + leaf)


def test_statistics_do_not_depend_on_the_batch():
    column = pa.array([r[1] for r in awkward.rows()])
    whole = quality_model.all_statistics(column)
    alone = np.concatenate([quality_model.all_statistics(column[i : i + 1]) for i in range(len(column))])
    assert np.allclose(whole, alone) and np.isfinite(whole).all()


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.query(spark, MID).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum((r.score >= 0.5) == r.quality for r in rows) / len(rows) > 0.95
    assert quality_model.query(spark, MID).count() == docs.count()


def test_quality_awkward(spark):
    docs = awkward.frame(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    trees = quality_model.train(docs, labels)
    rows = quality_model.quality_scores(docs, trees).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    good = quality_model.good_documents(docs, trees, 0.0)
    assert good.schema == docs.schema and good.count() == docs.count()
    assert quality_model.quality_scores(awkward.empty(spark), trees).count() == 0
    blank = quality_model.train(awkward.empty(spark), labels.limit(0))
    assert {r.score for r in quality_model.quality_scores(docs, blank).collect()} == {0.5}


def test_languages_held_out(spark):
    rows = language_id.query(spark, MID).join(spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_awkward(spark):
    docs = awkward.frame(spark)
    model = language_id.train(docs)
    rows = language_id.identify(docs, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in awkward.rows())
    text = {r[0]: r[1] for r in awkward.rows()}
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", text[r.doc_id] or "")) for r in rows)
    assert all(r.score == 0 and r.rejected for r in rows if r.lang_pred == "und")
    nothing = language_id.train(awkward.empty(spark))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(awkward.empty(spark), model).count() == 0


def plain_buckets(text):
    """N-grams of one text, letter by letter, as their buckets."""
    raw = re.sub(rb"[\t-\r]", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    out = Counter()
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            gram = raw[i : i + n]
            if b" " in gram[1:-1] or gram[:1] == gram[-1:] == b" ":
                continue
            mixed = (int.from_bytes(gram, "little") + n) * 2654435761 % 2**32
            mixed ^= mixed >> 15
            out[(mixed * 2246822519 % 2**32) >> 16] += 1
    return out


def test_predictions_against_plain_n_grams():
    texts = ["Ein Text\nüber nichts", "some other\t text", "", "noch  ein Text", "a", "x y", "\n\n"]
    model = language_id.fit(pa.array(texts * 10), ["de", "en", "en", "de", "en", "fr", "fr"] * 10, epochs=2)
    for text, p in zip(texts, model.probabilities(pa.array(texts)), strict=True):
        bag = plain_buckets(text)
        z = [sum(model.table[b, j] * c for b, c in bag.items()) / max(1, bag.total()) + model.bias[j] for j in range(len(model.languages))]
        e = [math.exp((v - max(z)) / model.temperature) for v in z]
        assert np.allclose(p, [v / sum(e) for v in e])


def test_one_step_of_training_goes_down_the_gradient():
    """The first step of the descent, against differences of the loss."""
    column, labels = pa.array(["ab ba", "cd dc"]), ["x", "y"]
    one, two = (language_id.fit(column[:n], labels[:n] if n == 2 else ["x"], dims=4, epochs=e, rate=1.0) for n, e in ((2, 0), (2, 8)))
    loss = lambda m: -sum(math.log(p[m.languages.index(k)]) for p, k in zip(m.probabilities(column), labels, strict=True))
    assert loss(two) < loss(one)


def test_each_language_is_learned_and_ids_count_once(spark):
    rare = [(10_000 + i, f"zzz{i} qqq zzqq", "zz", None, 0) for i in range(3)]
    rows = [(i, f"some text number {i}", "en", None, 0) for i in range(400)] + rare + [(7, f"more {i}", "en", None, 0) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    model = language_id.train(docs, None, per_language=20, max_train=60)
    assert model.languages == ("en", "zz")
    found = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert all(found[10_000 + i] == "zz" for i in range(3))
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(spark.createDataFrame([(7, "abc", "en")] * 300, "doc_id long, text string, lang string"), None)).collect()} == {"en"}


def test_folded_table_gives_the_averaged_embedding():
    column = pa.array(["ein text", "some other text", "", "noch ein text", "text"] * 12)
    model = language_id.fit(column, ["de", "en", "en", "de", "en"] * 12, epochs=2)
    for (buckets, share), p in zip(language_id.bags(column), model.probabilities(column), strict=True):
        z = (share @ model.table[buckets] + model.bias) / model.temperature
        assert np.allclose(np.exp(z - z.max()) / np.exp(z - z.max()).sum(), p)


def tokens(text):
    return [w for w in words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))] + [b" end"]


def test_base_scores(spark):
    data = [(r[0], r[1]) for r in awkward.rows()]
    docs = awkward.frame(spark)
    got = hmm_lm.hmm_scores(docs, fold(F.col("doc_id"), 5) == 1, states=3, iterations=2, max_frequent=50, max_symbols=20).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t in data if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in data)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm_lm.hmm_scores(awkward.empty(spark), F.lit(False)).count() == 0
    assert all(r.train_tokens == 0 for r in hmm_lm.hmm_scores(docs, F.lit(True)).collect())


def random_model(rng, states, alphabet):
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm_lm.Hmm(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((alphabet, states)), 0))


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    m = random_model(rng, 3, 5)
    own = sorted((rng.integers(0, 5, n) for n in (1, 6, 3, 6, 2)), key=len, reverse=True)
    logs, _, _ = hmm_lm.Batch(own).forward(m, keep=False)
    for s, log in zip(own, logs, strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
        assert math.isclose(math.log(total), log, rel_tol=1e-9)


def test_expected_counts_are_those_over_paths():
    rng = np.random.default_rng(2)
    m = random_model(rng, 2, 4)
    own = sorted((rng.integers(0, 4, n) for n in (5, 1, 3)), key=len, reverse=True)
    move, emit, start = np.zeros((2, 2)), np.zeros((4, 2)), np.zeros(2)
    hmm_lm.Batch(own).expected(m, move, emit, start)
    want = np.zeros((2, 2)), np.zeros((4, 2)), np.zeros(2)
    for s in own:
        weights = {}
        for path in itertools.product(range(2), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            weights[path] = p
        total = sum(weights.values())
        for path, p in weights.items():
            want[2][path[0]] += p / total
            for t, k in enumerate(path):
                want[1][s[t], k] += p / total
                if t:
                    want[0][path[t - 1], k] += p / total
    for got, expected in zip((move, emit, start), want, strict=True):
        assert np.allclose(got, expected)


def test_probabilities_of_all_words_add_up(spark):
    """Of one-word texts: P(word, end) over all known words and one unknown word for each bucket, plus P(end), is at most 1."""
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices("abcdefg", k=8))) for i in range(40)], "doc_id long, text string")
    v = hmm_lm.vocabulary(hmm_lm.word_counts(docs), 40, max_frequent=4, max_symbols=3)
    inside = 10**v.bucket_log
    counts = {r.word: r.c for r in hmm_lm.word_counts(docs).collect()}
    at, symbol = v.look_up(arrays.hash_words(sorted(counts)))
    share = np.zeros(hmm_lm.BUCKETS)
    for w, s in zip(sorted(counts), symbol.tolist(), strict=True):
        if s >= v.n_symbols:
            share[s - v.n_symbols] += (counts[w] + 0.5) / inside[s - v.n_symbols]
    assert np.allclose(share + 0.5 / inside, 1)


@pytest.mark.parametrize("sf", [MID])
def test_model_beats_single_counts(spark, sf):
    rows = hmm_lm.query(spark, sf).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]
