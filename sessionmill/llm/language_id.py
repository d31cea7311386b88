"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords: byte n-grams within a word, the white space
on either side standing for the word's edge, hashed to a fixed number of buckets. Embeddings and
softmax are trained together by stochastic gradient descent in numpy on a bounded sample. As the
average is linear, embedding and softmax fold into one table of bucket scores, and whole texts are
scored with array look-ups. A temperature fitted on texts kept from training calibrates the scores,
and the least score that still gives the wanted precision there becomes the rejection threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.llm.arrays import Texts, texts
from sessionmill.llm.common import checkpointed, fold, table

#: Labelled documents that are learned from: PER_LANGUAGE of each language, those with the smallest hashes of their ids, but about MAX_TRAIN of all languages at most.
PER_LANGUAGE, MAX_TRAIN = 625, 10_000
BUCKETS = 1 << 16
SIZES = (2, 3, 4)
UNKNOWN = "und"

_EDGE = np.arange(256, dtype=np.uint32)
_EDGE[[9, 10, 11, 12, 13]] = 32


def subwords(t: Texts):
    """For each n-gram size: the buckets of the n-grams, and the place of each n-gram's first byte."""
    codes = _EDGE[t.data]
    blank = codes == 32
    last = np.repeat(t.offsets[1:], np.diff(t.offsets))  # end of the document of each byte
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        value = codes[:m].copy()
        inside = np.arange(m) + n <= last[:m]
        for i in range(1, n):
            value |= codes[i : i + m] << np.uint32(8 * i)
            if i < n - 1:
                inside &= ~blank[i : i + m]
        inside &= ~(blank[:m] & blank[n - 1 : n - 1 + m])
        at = np.flatnonzero(inside)
        with np.errstate(over="ignore"):
            mixed = (value[at] + np.uint32(n)) * np.uint32(2654435761)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(2246822519)
        yield (mixed >> np.uint32(16)).astype(np.int64), at


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # bucket scores by language
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, t: Texts) -> np.ndarray:
        n = t.hi - t.lo
        total, count = np.zeros((n, len(self.languages))), np.zeros(n)
        for buckets, at in subwords(t):
            cuts = np.searchsorted(at, t.offsets)
            count += np.diff(cuts)
            for j in range(len(self.languages)):
                sums = np.zeros(len(at) + 1)
                np.cumsum(self.table[:, j][buckets], out=sums[1:])
                total[:, j] += np.diff(sums[cuts])
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, column: pa.Array) -> np.ndarray:
        parts = [self.logits(t) for t in texts(column, lower=True)]
        z = np.concatenate(parts) if parts else np.empty((0, len(self.languages)))
        return softmax(z / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True)) if z.size else z
    return e / e.sum(axis=1, keepdims=True) if z.size else z


def counted(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and how often each stands there; none for a text without subwords."""
    out = []
    for t in texts(column, lower=True):
        found = list(subwords(t))
        cuts = [np.searchsorted(at, t.offsets) for _, at in found]
        for i in range(t.hi - t.lo):
            own = [b[c[i] : c[i + 1]] for (b, _), c in zip(found, cuts, strict=True)]
            out.append(np.unique(np.concatenate(own) if own else np.empty(0, np.int64), return_counts=True))
    return out


def bags(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their shares."""
    return [(buckets, n / max(1, n.sum())) for buckets, n in counted(column)]


def _bags(batches):
    """doc_id, lang and the buckets and counts of the text, as bytes: no more than BUCKETS of each, however long the text is."""
    for batch in batches:
        own = counted(batch.column(2))
        columns = [pa.array([b.astype(np.uint16).tobytes() for b, _ in own], pa.binary()), pa.array([n.astype(np.uint32).tobytes() for _, n in own], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "lang", "buckets", "counts"])


def fit(column: pa.Array, labels: list[str], **options) -> LanguageModel:
    """Fit on texts that are here already."""
    return fit_bags(bags(column), labels, **options)


def fit_bags(whole: list[tuple[np.ndarray, np.ndarray]], labels: list[str], dims: int = 16, epochs: int = 6, rate: float = 20.0, precision: float = 0.98, seed: int = 3) -> LanguageModel:
    languages = tuple(sorted(set(labels)))
    y = np.array([languages.index(x) for x in labels], int)
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS, dims)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (dims, len(languages))), np.zeros(len(languages))
    order = rng.permutation(len(y))
    kept = order[: len(y) // 5] if len(y) >= 50 else order[:0]
    learned = order[len(kept) :]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(learned):
            buckets, share = whole[i]
            if not len(buckets):
                continue
            h = share @ embedding[buckets]
            p = softmax((h @ weights + bias)[None, :])[0]
            p[y[i]] -= 1
            back = weights @ p
            weights -= step / 50 * np.outer(h, p)
            bias -= step / 500 * p
            embedding[buckets] -= (step * share[:, None] * back[None, :]).astype(np.float32)
    table = embedding.astype(np.float64) @ weights
    temperature, reject = 1.0, 0.0
    if len(kept):
        z = np.array([whole[i][1] @ table[whole[i][0]] + bias for i in kept])
        losses = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(kept)), y[kept]], 1e-12)).mean() for t in np.geomspace(0.25, 8, 41)}
        temperature = float(min(losses, key=losses.get))
        p = softmax(z / temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y[kept]
        falling = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[falling]) >= precision * np.arange(1, len(kept) + 1))
        reject = float(top[falling[good[-1]]]) if len(good) else 1.0
    return LanguageModel(languages, np.ascontiguousarray(table), bias, temperature, reject)


def train(docs: DataFrame, held_out_fold: int | None = 0, per_language: int = PER_LANGUAGE, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> LanguageModel:
    """Fit on at most `per_language` documents of each language, and `max_train` in all or one of each, outside the held-out fold.

    Of rows that share an id one counts: the least language, and the text of the least hash.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    if held_out_fold is not None:
        known = known.where(fold(F.col("doc_id"), 5) != held_out_fold)
    # Ids first, so that no sort carries texts. Of each language only hashes below a share that holds
    # about four times the limit are sorted, so a language of most rows is no more work than others.
    ids = known.groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    sizes = checkpointed(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    n_languages = sizes.count()
    limit = max(1, min(per_language, max_train // max(1, n_languages)))
    drawn = ids.join(F.broadcast(sizes) if n_languages <= max_train else sizes, "lang").where(F.col("draw") * F.col("rows") < 4.0 * (limit + 10) * (1 << 30))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    chosen = drawn.withColumn("nth", first).where(F.col("nth") <= limit).select("doc_id", "lang")  # bounded, so it may be broadcast
    rows = known.join(F.broadcast(chosen), ["doc_id", "lang"])
    rows = rows.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "lang", "t.text")
    # Texts stay in the tasks: the driver gets their bags, whose size has a bound.
    rows = rows.mapInArrow(_bags, f"doc_id {dict(rows.dtypes)['doc_id']}, lang string, buckets binary, counts binary").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(zero_copy_only=False), kind="stable")
    rows = rows.take(pa.array(order))
    held = zip(rows.column("buckets").to_pylist(), rows.column("counts").to_pylist(), strict=True)
    whole = [(np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(n, np.uint32)) for b, n in held]
    return fit_bags([(b, n / max(1, n.sum())) for b, n in whole], rows.column("lang").to_pylist(), **options)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, lang_pred, score and rejected, one row per input row.

    lang_pred is the likeliest language that the model knows, or `und` with score 0 where the text is
    null or has no letter, or the model knows no language. rejected marks `und` and scores under the
    model's threshold. Repeated rows get equal answers; other columns are ignored; an empty table
    gives an empty result.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches):
        for batch in batches:
            letters = np.asarray(batch.column(2))
            if model.languages:
                p = model.probabilities(batch.column(1))
                best = p.argmax(axis=1)
                score = np.where(letters, p.max(axis=1), 0.0) if len(p) else np.empty(0)
                lang = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            else:
                score, lang = np.zeros(batch.num_rows), [UNKNOWN] * batch.num_rows
            rejected = (score < model.reject_below) | (score == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return read.mapInArrow(run, f"doc_id {dict(read.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
