"""Every operator on a table in which all rows share one id."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionmill.llm import exact_dedup, hmm_lm, license_scan, pfair_mix, quality_model, quality_rules, simhash

TEXTS = [" ".join(f"{x}{i}" for i in range(60)) for x in "abcde"]
N = 400


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(7, TEXTS[i % 5], "en", "src" if i % 3 else None) for i in range(N)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6).checkpoint()


def test_exact_dedup(docs):
    rows = exact_dedup.exact_groups(docs).collect()
    assert Counter((r.keep_id, r.group_size, r.kept) for r in rows) == {(7, N // 5, True): N}
    assert sorted(r.text for r in exact_dedup.exact_dedup(docs).collect()) == TEXTS


def test_large_groups_are_split(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LARGE", 50)
    assert {(r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()} == {(N // 5, True)}


@pytest.mark.parametrize("hot", [10_000, 10])
def test_near_dedup(docs, monkeypatch, hot):
    monkeypatch.setattr("sessionmill.llm.common.HOT_ROWS", hot)
    assert Counter(r.component_id for r in simhash.near_groups(docs).collect()) == {7: N}
    assert Counter(r.component_id for r in simhash.similar_groups(docs).collect()) == {7: N}
    assert sorted(r.text for r in simhash.near_dedup(docs).collect()) == TEXTS


def test_mix_spreads_the_rows(docs):
    rows = pfair_mix.pfair_mix(docs).collect()
    assert sorted(r["__place"] for r in rows)[0] == 0 and len({r["__place"] for r in rows}) == N


def test_models(spark, docs):
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    assert quality_model.quality_scores(docs, quality_model.train(docs, labels, None)).count() == N
    rows = hmm_lm.hmm_scores(docs, F.lit(False), states=2, iterations=1).collect()
    assert len(rows) == N and {(r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {(61, 61, 61 * N)}


def test_rules_and_licences(docs):
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == N and {(r.n_words, r.base_failed) for r in rows} == {(60, False)}
    assert license_scan.license_scan(docs).count() == N
