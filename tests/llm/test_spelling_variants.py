import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from awkward import empty, frame

from sessionmill.llm import spelling_variants as V


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def expected(counts, ratio=10):
    out, forms = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (forms[w], n, len(near), counts[forms[w]] if forms[w] else None)
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def got(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def vocabulary(seed, n, letters="abcde", least=1, most=9):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(least, most))) for _ in range(n)}
    return {w: int(10 ** rng.uniform(0, 6)) for w in sorted(words)}


@pytest.mark.parametrize("cell,sample", [(8, 200), (64, 1 << 17), (8192, 50)])
def test_against_brute_force(spark, cell, sample):
    counts = vocabulary(1, 700) | vocabulary(2, 150, "aéÿxyz", 6, 15) | {"x" * 400: 3, "x" * 401: 40, "x" * 200 + "y" + "x" * 200: 1, "日本語": 5, "日本": 70, "本日": 2}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert got(V.spelling_variants(words, cell_words=cell, sample_words=sample)) == expected(counts)


def test_forms_are_followed_to_the_last(spark):
    word, counts = "abcdefghij", {}
    for i in range(10):
        counts[word] = 10**i
        word = word[:i] + "z" + word[i + 1 :]
    counts["unrelatedword"] = 3
    rows = got(V.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert rows == expected(counts)
    assert rows["abcdefghij"][1] == "zzzzzzzzzj"


def test_ties_take_the_first_word(spark):
    counts = {"wordone": 1, "wordonf": 10, "wordond": 10, "Zordone": 10, "éordone": 10}
    rows = got(V.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert rows["wordone"] == ("Zordone", "Zordone", 1, 4, 10)


def test_repeated_rows_nulls_and_other_columns(spark):
    rows = [("abc", 1, "k"), ("abc", 4, None), (None, 3, "x"), ("", 3, "x"), ("abd", None, "x"), ("ab", 50, "x")]
    words = spark.createDataFrame(rows, "word string, n int, root string")
    assert got(V.spelling_variants(words)) == {"abc": ("ab", "ab", 5, 1, 50), "ab": (None, "ab", 50, 1, None)}
    assert got(V.spelling_variants(words.limit(0))) == {}
    with pytest.raises(ValueError):
        V.spelling_variants(words, ratio=1)


def slow_counts(rows, flawed):
    out = Counter()
    for own, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{own}:{w}".encode())
            if flawed and own is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                out[w] += 1
    return out


@pytest.mark.parametrize("flawed", [True, False])
def test_words_of_texts(spark, flawed):
    rng = random.Random(5)
    letters = "abcXYZÀÉßÿ×ŒſKİ"
    data = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(60))) for i in range(200)] + [(None, "A Nullified Identity"), (5, None), (6, ""), (7, "ab" * 5000), (7, "ab" * 5000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert {r["word"]: r["n"] for r in V.word_counts(docs, flawed).collect()} == slow_counts(data, flawed)


def test_awkward_rows(spark):
    docs = frame(spark)
    found = {r["word"]: r["n"] for r in V.word_counts(docs, True).collect()}
    assert found == slow_counts([(r["doc_id"], r["text"]) for r in docs.collect()], True)
    assert V.word_counts(empty(spark), True).collect() == []


def test_a_tree_holds_every_point_once_and_reaches_every_box():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 4, (500, V.DIMS)).astype(np.int32)
    tree = V.build(points, 10)
    row, leaf = V.reach(tree, points, False, False)
    assert sorted(row.tolist()) == list(range(500)) and np.bincount(leaf).max() <= 10
    home = dict(zip(row.tolist(), leaf.tolist(), strict=True))
    row, leaf = V.reach(tree, points, True, True)
    reached = set(zip(row.tolist(), leaf.tolist(), strict=True))
    assert len(reached) == len(row)
    apart = points[:, None, :] - points[None, :, :]
    for i, j in np.argwhere((np.abs(apart).sum(axis=2) <= 2) & (np.clip(apart, 0, None).sum(axis=2) <= 1) & (np.clip(-apart, 0, None).sum(axis=2) <= 1)):
        assert (i, home[j]) in reached
