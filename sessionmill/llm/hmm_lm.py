"""Language-model scoring with a hidden Markov model.

Tokens are words in lower case (A-Z only) and one end per text. The model has K latent states over a
bounded alphabet: each very frequent word is a symbol of its own, every other word falls in a hashed
bucket, and within a bucket words are drawn by their smoothed corpus counts. Baum-Welch runs over all
training texts: each task computes expected counts with scaled forward and backward recursions,
Spark adds them up, and the driver normalises the K x alphabet totals. Scoring is the scaled forward
recursion, which gives the exact likelihood of the whole token sequence.

Counts cover the whole corpus and their table grows with it, so it is never sent whole: only words
with at least a share of 1/MAX_FREQUENT of all tokens are, of which there can be MAX_FREQUENT at most;
the tokens of other words meet their counts in a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.arrays import Texts, hash_words, texts
from sessionmill.llm.common import checkpointed, fold, shared_table, table

STATES = 8
ITERATIONS = 5
#: Words whose counts are sent to all executors: those with a share of at least 1 in so many tokens.
MAX_FREQUENT = 1 << 20
#: Words that are symbols of the hidden Markov model: those with a share of at least 1 in so many tokens.
MAX_SYMBOLS = 1 << 14
BUCKETS = 1 << 12
#: Tokens that the recursions hold at once, in one task (a longer text stands alone).
BATCH_TOKENS = 1 << 19
SMOOTH = 0.1


def unique_words(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Places of one word for each distinct word of the chunk, and how often it occurs."""
    _, first, counts = np.unique(t.hashes, return_index=True, return_counts=True)
    return first, counts


def word_counts(docs: DataFrame) -> DataFrame:
    """Return word and c over the column text; each task adds up its own chunks first."""

    def run(batches):
        for batch in batches:
            for t in texts(batch.column(0), lower=True):
                first, counts = unique_words(t)
                words = pa.array([t.word(i) for i in first.tolist()], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([words, pa.array(counts, pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass(frozen=True)
class Vocabulary:
    """Counts of the frequent words by hash; the symbols of the model; totals by bucket."""

    tokens: int  # N
    types: int  # V
    hashes: np.ndarray  # sorted
    counts: np.ndarray
    symbols: np.ndarray  # of each frequent word: its symbol, or -1
    bucket_log: np.ndarray  # log10 of what the counts of a bucket's words are divided by
    n_symbols: int  # own symbols; then buckets; then the end

    @property
    def end(self) -> int:
        return self.n_symbols + BUCKETS

    @property
    def alphabet(self) -> int:
        return self.end + 1

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word its place among the frequent words, or -1, and its symbol."""
        symbol = self.n_symbols + (hashes >> np.uint64(20)).astype(np.int64) % BUCKETS
        if not len(self.hashes):
            return np.full(len(hashes), -1), symbol
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at[self.hashes[at] != hashes] = -1
        own = np.where(at >= 0, self.symbols[at], -1)
        return at, np.where(own >= 0, own, symbol)


def vocabulary(counts: DataFrame, n_texts: int, max_frequent: int = MAX_FREQUENT, max_symbols: int = MAX_SYMBOLS) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, types = total["n"] + n_texts, total["v"] + (n_texts > 0)
    # Bounded: at most max_frequent words can have such a share.
    frequent = counts.where(F.col("c") * max_frequent >= tokens).toPandas().sort_values(["c", "word"], ascending=[False, True])
    n_symbols = int((frequent["c"] * max_symbols >= tokens).sum())
    hashes, c = hash_words(frequent["word"].tolist()), frequent["c"].to_numpy(np.int64)
    symbols = np.where(np.arange(len(c)) < n_symbols, np.arange(len(c)), -1)
    order = np.argsort(hashes)

    def run(batches):
        for batch in batches:
            h = np.concatenate([t.hashes for t in texts(batch.column(0))]) if batch.num_rows else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(20)).astype(np.int64) % BUCKETS), batch.column(1)], ["bucket", "c"])

    rest = counts.where(F.col("c") * max_symbols < tokens).select("word", "c").mapInArrow(run, "bucket long, c long")
    inside = np.zeros(BUCKETS)
    kinds = np.zeros(BUCKETS)
    for row in rest.groupBy("bucket").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        inside[row["bucket"]], kinds[row["bucket"]] = row["c"], row["v"]
    return Vocabulary(tokens, types, hashes[order], c[order], symbols[order], np.log10(inside + 0.5 * (kinds + 1)), n_symbols)


def encoded(docs: DataFrame, v: Vocabulary, n_texts: int) -> DataFrame:
    """For each row of doc_id, text, held_out: its symbols, what is known at once of its base score, and its rare words."""
    log_types = np.log10(v.tokens + 0.5 * (v.types + 1))
    known_log = np.log10(v.counts + 0.5)
    kind = np.uint16 if v.alphabet <= 1 << 16 else np.uint32

    def run(batches):
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for t in texts(batch.column(1), lower=True):
                n = t.hi - t.lo
                at, symbol = v.look_up(t.hashes)
                frequent = at >= 0
                value = np.where(frequent, known_log[at], 0.0) if len(v.counts) else np.zeros(len(at))
                n_tokens = t.n_words + 1
                base = t.per_doc_words(value) + np.log10(n_texts + 0.5) - n_tokens * log_types
                bucketed = symbol >= v.n_symbols
                inner = np.where(bucketed, value - v.bucket_log[np.where(bucketed, symbol - v.n_symbols, 0)], 0.0)
                within = t.per_doc_words(inner)
                known = t.per_doc_words(frequent) + (n_texts > 0)
                # One entry for each rare word of a document.
                rare = np.flatnonzero(~frequent)
                doc = t.doc_of_word[rare]
                with np.errstate(over="ignore"):
                    mixed = t.hashes[rare] + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                _, first, times = np.unique(mixed, return_index=True, return_counts=True)
                order = np.argsort(first)
                first, times = first[order], times[order]
                rare_offsets = np.searchsorted(doc[first], np.arange(n + 1)).astype(np.int32)
                words = pa.array([t.word(i) for i in rare[first].tolist()], pa.binary()).cast(pa.string())
                rare_words = pa.ListArray.from_arrays(pa.array(rare_offsets), words)
                rare_times = pa.ListArray.from_arrays(pa.array(rare_offsets), pa.array(times, pa.int32()))
                symbol = symbol.astype(kind)
                cuts = t.word_offsets
                codes = [symbol[cuts[i] : cuts[i + 1]].tobytes() for i in range(n)]
                key = (task << 33) + row + np.arange(n)
                row += n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.lo, n), pa.array(key, pa.int64()), batch.column(2).slice(t.lo, n), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(within), pa.array(codes, pa.binary()), rare_words, rare_times],
                    ["doc_id", "key", "held_out", "n_tokens", "n_known", "base", "within", "codes", "words", "times"],
                )

    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", "held_out").mapInArrow(
        run, f"doc_id {id_type}, key long, held_out boolean, n_tokens long, n_known long, base double, within double, codes binary, words array<string>, times array<int>"
    )


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # alphabet x states


def first_guess(frequency: np.ndarray, states: int = STATES, seed: int = 5) -> Hmm:
    rng = np.random.default_rng(seed)
    emit = (frequency[:, None] + SMOOTH) * np.exp(rng.normal(0, 0.7, (len(frequency), states)))
    move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def normalised_model(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
    start, move, emit = start + SMOOTH, move + SMOOTH, emit + SMOOTH
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def sequences(codes: list[bytes], kind, end: int) -> list[np.ndarray]:
    """The symbols of each text with its end."""
    return [np.append(np.frombuffer(c, kind), kind(end)) for c in codes]


def by_length(lengths: list[int], limit: int = BATCH_TOKENS):
    """Groups of places, longest first, of at most `limit` tokens each (one longer text stands alone)."""
    group, size = [], 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if group and size + lengths[i] > limit:
            yield group
            group, size = [], 0
        group.append(i)
        size += lengths[i]
    if group:
        yield group


#: Sequences of like length are worked on together, as a group takes as many steps as its longest: limits of the lengths.
LENGTHS = (256, 2048, 16384)


def like_lengths(batches, column: str, width: int):
    """Tables of rows whose sequences, `width` bytes a token in `column`, have like lengths; each is given out once it has BATCH_TOKENS tokens."""
    held: dict[int, list[pa.RecordBatch]] = {}
    size: dict[int, int] = {}
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False) // width + 1
        kinds = np.searchsorted(LENGTHS, lengths)
        for k in np.unique(kinds).tolist():
            held.setdefault(k, []).append(batch.filter(pa.array(kinds == k)))
            size[k] = size.get(k, 0) + int(lengths[kinds == k].sum())
            if size[k] >= BATCH_TOKENS:
                yield pa.Table.from_batches(held.pop(k))
                size[k] = 0
    for parts in held.values():
        yield pa.Table.from_batches(parts)


class Batch:
    """Sequences, longest first, laid out step by step: step t holds symbol t of all that are so long."""

    def __init__(self, own: list[np.ndarray]):
        lengths = np.array([len(s) for s in own])
        self.n = len(own)
        self.active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # sequences longer than t
        self.offset = np.r_[0, np.cumsum(self.active)]
        flat = np.concatenate(own)
        step = np.concatenate([np.arange(x) for x in lengths])
        self.sequence = np.empty(len(flat), np.int64)
        self.symbol = np.empty(len(flat), np.int64)
        to = self.offset[step] + np.repeat(np.arange(self.n), lengths)
        self.symbol[to] = flat
        self.sequence[to] = np.repeat(np.arange(self.n), lengths)
        self.last = self.offset[lengths - 1] + np.arange(self.n)

    def forward(self, m: Hmm, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Natural log of each sequence's likelihood; scaled alphas and scales if they are to be kept."""
        emit = m.emit[self.symbol]
        scale = np.empty(len(emit), emit.dtype)
        a = m.start * emit[: self.n]
        for t, k in enumerate(self.active.tolist()):
            o = self.offset[t]
            if t:
                a = (a[:k] @ m.move) * emit[o : o + k]
            c = a.sum(axis=1)
            a /= c[:, None]
            scale[o : o + k] = c
            if keep:
                emit[o : o + k] = a
        logs = np.bincount(self.sequence, np.log(scale.astype(np.float64)), minlength=self.n)
        return logs, emit if keep else None, scale if keep else None

    def expected(self, m: Hmm, move: np.ndarray, emit: np.ndarray, start: np.ndarray) -> float:
        """Add the expected counts of these sequences; return their log likelihood."""
        logs, alpha, scale = self.forward(m, keep=True)
        e = m.emit[self.symbol] / scale[:, None]  # then: emission x beta / scale
        b = np.ones((0, e.shape[1]), e.dtype)
        gamma = alpha  # filled from the back, in place, once alpha[t] has served step t + 1
        turned = m.move.T.copy()
        for t in range(len(self.active) - 1, -1, -1):
            o, k = self.offset[t], self.active[t]
            now = np.ones((k, e.shape[1]), e.dtype)
            if len(b):
                now[: len(b)] = b @ turned
                move += m.move * (gamma[o : o + len(b)].T @ b)
            gamma[o : o + k] *= now
            b = e[o : o + k] * now
        start += gamma[: self.n].sum(axis=0, dtype=np.float64)
        for s in range(emit.shape[1]):
            emit[:, s] += np.bincount(self.symbol, gamma[:, s], minlength=len(emit))
        return float(logs.sum())


def baum_welch_step(rows: DataFrame, v: Vocabulary, m: Hmm) -> tuple[Hmm, float]:
    """One iteration over the texts in `rows`; returns the new model and the log likelihood under the old one."""
    kind = np.uint16 if v.alphabet <= 1 << 16 else np.uint32
    states = len(m.start)
    small = Hmm(*(x.astype(np.float32) for x in (m.start, m.move, m.emit)))
    names = [f"s{i}" for i in range(states)]

    def run(batches):
        move, emit, start, logs = np.zeros((states, states)), np.zeros((v.alphabet, states)), np.zeros(states), 0.0
        for table in like_lengths(batches, "codes", kind().nbytes):
            own = sequences(table.column("codes").to_pylist(), kind, v.end)
            for group in by_length([len(s) for s in own]):
                logs += Batch([own[i] for i in group]).expected(small, move, emit, start)
        total = np.vstack([emit, move, start, np.full(states, logs)])
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, s]) for s in range(states))], ["row", *names])

    sums = rows.select("codes").mapInArrow(run, "row long, " + ", ".join(f"{x} double" for x in names))
    got = sums.groupBy("row").agg(*(F.sum(x).alias(x) for x in names)).toPandas()
    total = np.zeros((v.alphabet + states + 2, states))
    total[got["row"].to_numpy(int)] = got[names].to_numpy(float)
    new = normalised_model(total[v.alphabet + states], total[v.alphabet : v.alphabet + states], total[: v.alphabet])
    return new, float(total[-1, 0])


def symbol_frequency(v: Vocabulary, n_texts: int) -> np.ndarray:
    out = np.zeros(v.alphabet)
    own = v.symbols >= 0
    out[v.symbols[own]] = v.counts[own]
    out[v.n_symbols : v.end] = 10.0**v.bucket_log
    out[v.end] = n_texts
    return out


def hmm_scores(docs: DataFrame, held_out: Column, states: int = STATES, iterations: int = ITERATIONS, max_frequent: int = MAX_FREQUENT, max_symbols: int = MAX_SYMBOLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per input row.

    The model learns from the rows where `held_out` is false, all of them; with none it is as good
    as guessing, and every count is 0. Null counts as an empty text, which has one token, its end.
    Scores are log10 probabilities: base_score from smoothed single counts, score from the hidden
    Markov model. Repeated rows count each; other columns are ignored; an empty table gives an empty
    result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learned = rows.where("not held_out")
    counts = checkpointed(word_counts(learned))
    n_texts = learned.count()
    v = vocabulary(counts, n_texts, max_frequent, max_symbols)
    table = shared_table(encoded(rows, v, n_texts))
    m = first_guess(symbol_frequency(v, n_texts), states)
    for _ in range(iterations if n_texts else 0):
        m, _ = baum_welch_step(table.where("not held_out"), v, m)

    kind = np.uint16 if v.alphabet <= 1 << 16 else np.uint32

    def likelihood(batches):
        for table in like_lengths(batches, "codes", kind().nbytes):
            own = sequences(table.column("codes").to_pylist(), kind, v.end)
            logs = np.zeros(len(own))
            for group in by_length([len(s) for s in own]):
                logs[group] = Batch([own[i] for i in group]).forward(m, keep=False)[0]
            total = logs / np.log(10) + table.column("within").to_numpy()
            yield from table.drop_columns(["codes", "within"]).append_column("score", pa.array(total)).to_batches()

    id_type = dict(rows.dtypes)["doc_id"]
    summary = table.select("key", "codes", "doc_id", "held_out", "n_tokens", "n_known", "base", "within")
    summary = summary.mapInArrow(likelihood, f"key long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double")
    rare = table.select("key", F.explode(F.arrays_zip("words", "times")).alias("r")).select("key", F.col("r.words").alias("word"), F.col("r.times").alias("times"))
    found = rare.join(counts, "word", "left").groupBy("key").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    out = summary.join(found, "key", "left")
    rare_log = F.coalesce("rare", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log).alias("base_score"),
        (F.col("score") + rare_log).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hmm_scores(docs, fold(F.col("doc_id"), 5) == 1)
