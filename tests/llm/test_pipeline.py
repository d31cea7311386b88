import awkward
import corpus_pipeline as pipeline
from helpers import SMALL

import __spark_entry__ as entry
from sessionmill.llm import exact_dedup, quality_model, queries, simhash


def test_names():
    names = entry.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [k for k, _ in pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]


def test_stages_against_the_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality_model.quality_scores(docs, quality_model.train(docs, labels)).collect()}
    good = docs.where(docs.doc_id.isin([i for i, s in scores.items() if s >= pipeline.MIN_QUALITY]))
    once = good.where(good.doc_id.isin([r.doc_id for r in exact_dedup.exact_groups(good).collect() if r.kept]))
    apart = {r.component_id for r in simhash.similar_groups(once).collect()}
    packed = pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in packed} == apart
    words = {r.doc_id: len(r.text.replace(" ", "_").split()) for r in docs.collect()}
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert all(total[i] == words[i] for i in apart)
    known = {r.doc_id: r.quality for r in labels.collect()}
    kept_good = [i for i, s in scores.items() if known.get(i) == 1 and s < pipeline.MIN_QUALITY]
    assert len(kept_good) <= 0.02 * sum(known.get(i) == 1 for i in scores)


def test_stages_keep_columns(spark):
    docs = awkward.frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
    assert pipeline.pack(spark, docs, SMALL).count() >= docs.count()
