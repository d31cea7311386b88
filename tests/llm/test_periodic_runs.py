import hashlib
import random
import re

import pytest
from awkward import empty, frame

from sessionmill.llm import periodic_runs as P


def slow_runs(w):
    """All runs of a list of words, period by period and word by word."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def split(text):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]


def expected(text):
    w = split(text)
    runs = slow_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return [tuple(r) for r in sorted(runs, key=lambda r: (r[0], r[2]))], len(gone), kept


def checked(spark, docs, with_text=True):
    got = P.periodic_runs(docs, with_text=with_text).collect()
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert len(got) == docs.count()
    for r in got:
        answers = [expected(t) for t in texts[r["doc_id"]]]
        own = ([tuple(x) for x in r["runs"]], r["n_removed"], r["kept_sha256"])
        assert own in [(a, b, hashlib.sha256(c.encode()).hexdigest()) for a, b, c in answers]
        if with_text:
            assert r["kept_text"] in [c for _, _, c in answers]
    return got


@pytest.mark.parametrize("with_text", [True, False])
def test_against_brute_force(spark, with_text):
    rng = random.Random(3)
    texts = []
    for i in range(150):
        letters = "ab" if i % 3 else "abcdefgh"
        w = [rng.choice(letters) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 4)):
            at, p = rng.randrange(0, len(w) + 1), rng.randrange(1, 40)
            block = [rng.choice("abcdefghij") for _ in range(p)]
            w[at:at] = (block * 9)[: rng.randrange(3 * p, 9 * p)]
        texts.append("\n ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = checked(spark, docs, with_text)
    assert sum(len(r["runs"]) for r in got) > 150


def test_a_run_over_many_tiles_and_periods_of_all_octaves(spark):
    rng = random.Random(4)
    texts = ["x " * 30_000]
    for p in (1, 2, 3, 4, 7, 8, 63, 64, 65, 1000, 1024, 3001):
        block = [f"w{rng.randrange(10**9)}" for _ in range(p)]
        for times in (3.99, 4, 5.3):
            head = [f"h{i}" for i in range(rng.randrange(50))]
            texts.append(" ".join(head + (block * 6)[: int(times * p)] + ["end", "of", "it"]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.periodic_runs(docs).collect()}
    assert [tuple(x) for x in got[0]["runs"]] == [(0, 30_000, 1)] and got[0]["kept_text"] == "x"
    for i, t in enumerate(texts[1:], 1):
        assert ([tuple(x) for x in got[i]["runs"]], got[i]["n_removed"], got[i]["kept_text"]) == expected_of_one_block(t)


def expected_of_one_block(text):
    """Brute force over the periods that can be there."""
    w = split(text)
    found = {}
    for q in sorted({q for p in (1, 2, 3, 4, 7, 8, 63, 64, 65, 1000, 1024, 3001) for q in (p, 2 * p, 3 * p) if 4 * q <= len(w)}):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    runs = sorted((s, n, q) for (s, n), q in found.items())
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


def test_awkward_rows(spark):
    got = checked(spark, frame(spark).where("doc_id is null or doc_id != 94"))
    assert any(r["doc_id"] is None for r in got)
    assert P.periodic_runs(empty(spark)).collect() == []
    long = frame(spark).where("doc_id = 94")
    row = P.periodic_runs(long).first()
    assert (0, 1202, 3) in [tuple(x) for x in row["runs"]] or row["runs"][0]["period"] == 3


def test_any_names_and_kinds_of_ids(spark):
    docs = spark.createDataFrame([("ä", "a a a a a a b", 1), ("z", None, 2)], "`my.id` string, `the text` string, row long")
    got = {r["doc_id"]: r for r in P.periodic_runs(docs, id_col="my.id", text_col="the text").collect()}
    assert got["ä"]["kept_text"] == "a b" and got["z"]["kept_text"] == ""
    with pytest.raises(ValueError):
        P.periodic_runs(docs, min_exponent=3)


def test_equal_rows_are_one_task_each(spark):
    docs = spark.range(3000).selectExpr("1L as doc_id", "repeat('p q r ', 200) as text")
    got = P.periodic_runs(docs).distinct().collect()
    assert len(got) == 1 and [tuple(x) for x in got[0]["runs"]] == [(0, 600, 3)]
    assert P.periodic_runs(docs).count() == 3000
