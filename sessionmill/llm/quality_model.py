"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in numpy inside Spark tasks. The trees are grown on a bounded
sample of labelled documents from quantile-bin histograms, then flattened into one table of arrays
(feature, threshold, children, value) that all documents of a batch walk down together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.arrays import Texts, scramble, texts
from sessionmill.llm.common import fold, table

#: Labelled documents that are learned from, at most: those with the smallest hashes of their ids.
MAX_TRAIN = 8_000
BINS = 64

FEATURES = (
    "log_words", "word_bytes", "long_words", "letters", "capitals", "digits", "symbols", "bangs", "stops", "commas", "pipes", "high_bytes",
    "distinct_words", "top_word", "repeat_bigrams", "repeat_trigrams", "lines", "words_per_line", "repeat_lines", "repeat_line_bytes", "longest_line", "byte_entropy",
    "quotes", "brackets", "slashes", "capital_words", "words_without_letters", "short_words", "sentence_words", "at_signs",
)


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_CAPITAL, _DIGIT = _class(bytes(range(65, 91))), _class(b"0123456789")
_HIGH = _class(bytes(range(128, 256)))
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123))) | _HIGH
_CLASSES = {"symbols": _class(b"#*$%&|<>"), "bangs": _class(b"!"), "stops": _class(b"."), "commas": _class(b",;:"), "pipes": _class(b"|"), "quotes": _class(b"\"'`"), "brackets": _class(b"()[]{}"), "slashes": _class(b"/\\_="), "at_signs": _class(b"@")}


def _repeated(group: np.ndarray, keys: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By group: rows whose key stood before in the group, the count of the most common key, and a mark for each such row."""
    with np.errstate(over="ignore"):
        keys = scramble(keys + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    g, k = group[order], keys[order]
    again = np.r_[False, k[1:] == k[:-1]] if len(g) else np.empty(0, bool)
    repeats = np.bincount(g[again], minlength=n_groups)
    most = np.zeros(n_groups, np.int64)
    if len(g):
        starts = np.flatnonzero(~again)
        np.maximum.at(most, g[starts], np.diff(np.r_[starts, len(g)]))
    marks = np.zeros(len(g), bool)
    marks[order] = again
    return repeats, most, marks


def statistics(t: Texts) -> np.ndarray:
    """One row of FEATURES for each document of the chunk; all 0 for an empty text."""
    n = t.hi - t.lo
    out = dict.fromkeys(FEATURES)
    size = np.maximum(np.diff(t.offsets), 1)
    words = t.n_words
    some = np.maximum(words, 1)
    lengths = t.ends - t.starts
    capitals, letters = t.per_doc(_CAPITAL[t.data]), t.per_doc(_LETTER[t.data])
    out["log_words"] = np.log1p(words)
    out["word_bytes"] = t.per_doc_words(lengths) / some
    out["long_words"] = t.per_doc_words(lengths > 12) / some
    out["short_words"] = t.per_doc_words(lengths <= 2) / some
    out["letters"] = letters / size
    out["capitals"] = capitals / np.maximum(letters, 1)
    out["digits"] = t.per_doc(_DIGIT[t.data]) / size
    out["high_bytes"] = t.per_doc(_HIGH[t.data]) / size
    for name, table in _CLASSES.items():
        out[name] = t.per_doc(table[t.data]) / some
    out["sentence_words"] = np.log1p(words / (1 + t.per_doc(_CLASSES["stops"][t.data])))
    inner = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(_LETTER[t.data], out=inner[1:])
    out["words_without_letters"] = t.per_doc_words(inner[t.ends] == inner[t.starts]) / some
    out["capital_words"] = t.per_doc_words(_CAPITAL[t.data[t.starts]] if len(t.starts) else np.empty(0, bool)) / some

    doc, h = t.doc_of_word, t.hashes
    repeats, most, _ = _repeated(doc, h, n)
    out["distinct_words"], out["top_word"] = 1 - repeats / some, most / some
    with np.errstate(over="ignore"):
        two = h[:-1] * np.uint64(3) ^ (h[1:] >> np.uint64(1))
        three = two[:-1] * np.uint64(5) + h[2:] if len(h) > 2 else np.empty(0, np.uint64)
    for name, keys, k in (("repeat_bigrams", two, 2), ("repeat_trigrams", three, 3)):
        inside = doc[: len(keys)] == doc[k - 1 :] if len(doc) >= k else np.empty(0, bool)
        out[name] = _repeated(doc[: len(keys)][inside], keys[inside], n)[0] / some

    # Lines: words between line ends; a line's key is made from its words.
    ends = np.flatnonzero(t.data == 10)
    line = np.searchsorted(ends, t.starts)  # line ends before each word
    new = np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])] if len(line) else np.empty(0, bool)
    firsts = np.flatnonzero(new)
    line_doc = doc[firsts]
    n_lines = np.bincount(line_doc, minlength=n)
    if len(firsts):
        with np.errstate(over="ignore"):
            place = (np.arange(len(h)) - np.repeat(firsts, np.diff(np.r_[firsts, len(h)]))).astype(np.uint64)
            keys = np.add.reduceat(h * (place * np.uint64(2) + np.uint64(1)), firsts)
        line_words = np.diff(np.r_[firsts, len(h)])
        repeats, _, marks = _repeated(line_doc, keys, n)
        out["repeat_lines"] = repeats / np.maximum(n_lines, 1)
        out["repeat_line_bytes"] = np.bincount(line_doc[marks], line_words[marks], minlength=n) / some
        longest = np.zeros(n)
        np.maximum.at(longest, line_doc, line_words)
        out["longest_line"] = np.log1p(longest)
    else:
        out["repeat_lines"] = out["repeat_line_bytes"] = out["longest_line"] = np.zeros(n)
    out["lines"] = np.log1p(n_lines)
    out["words_per_line"] = np.log1p(words / np.maximum(n_lines, 1))
    entropy = np.zeros(n)
    for i in range(n):
        p = np.bincount(t.data[t.offsets[i] : t.offsets[i + 1]], minlength=256) / size[i]
        p = p[p > 0]
        entropy[i] = -(p * np.log2(p)).sum()
    out["byte_entropy"] = entropy
    return np.column_stack([np.asarray(out[name], np.float64) for name in FEATURES]) if n else np.empty((0, len(FEATURES)))


def all_statistics(column: pa.Array) -> np.ndarray:
    parts = [statistics(t) for t in texts(column)]
    return np.concatenate(parts) if parts else np.empty((0, len(FEATURES)))


@dataclass(frozen=True)
class Trees:
    """All trees in one table of nodes. A leaf points at itself; roots are where the trees begin."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, least: int = 15, ridge: float = 1.0, bins: int = BINS) -> Trees:
    """Newton boosting for log loss; splits are sought among the bin edges of each feature."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(k)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(k)]) if n else np.empty((0, k), int)
    mean = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(n, base)
    columns = np.arange(k) * bins
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        i = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(i), right.append(i), value.append(v)
        return i

    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(leaf(0.0))
        level = [(roots[-1], np.arange(n))]
        for d in range(depth + 1):
            following = []
            for node, rows in level:
                g, h = grad[rows].sum(), hess[rows].sum()
                value[node] = -rate * g / (h + ridge)
                if d < depth and len(rows) >= 2 * least:
                    flat = (binned[rows] + columns).ravel()
                    sums = [np.bincount(flat, np.repeat(w, k), minlength=k * bins).reshape(k, bins).cumsum(axis=1)[:, :-1] for w in (grad[rows], hess[rows], np.ones(len(rows)))]
                    gain = sums[0] ** 2 / (sums[1] + ridge) + (g - sums[0]) ** 2 / (h - sums[1] + ridge) - g * g / (h + ridge)
                    gain[(sums[2] < least) | (len(rows) - sums[2] < least)] = -np.inf
                    j, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(edges[j]):
                        goes = binned[rows, j] <= b
                        feature[node], threshold[node] = int(j), float(edges[j][b])
                        left[node], right[node] = leaf(0.0), leaf(0.0)
                        following += [(left[node], rows[goes]), (right[node], rows[~goes])]
                        continue
                raw[rows] += value[node]
            level = following
    return Trees(np.array(roots, int), np.array(feature, int), np.array(threshold, float), np.array(left, int), np.array(right, int), np.array(value, float), depth, base)


def train(docs: DataFrame, labels: DataFrame, held_out_fold: int | None = 2, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fit on at most `max_train` labelled documents outside the held-out fold, those of the smallest id hashes.

    Null labels, and ids whose labels differ, are left out; of rows that share an id one counts, that
    of the least hash of its text; a label table without rows gives a model that scores every text 0.5.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if held_out_fold is not None:
        known = known.where(fold(F.col(id_col), 4) != held_out_fold)
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("least"), F.max(label_col).alias("most"))
    known = known.where("least = most").select("doc_id", F.col("least").cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    # One row of each id, so that what reaches the driver is bounded too.
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "t.text", "label")

    def run(batches):
        for batch in batches:
            x = all_statistics(batch.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, batch.column(2)], ["doc_id", "x", "label"])

    got = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, x array<double>, label double").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_trees(x, got["label"].to_numpy(float))


def quality_scores(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id and score (0 to 1), one row per input row; null counts as empty and is scored too.

    Repeated rows get equal scores; other columns are ignored; an empty table gives an empty result.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            score = trees.probability(all_statistics(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return read.mapInArrow(run, f"doc_id {dict(read.dtypes)['doc_id']}, score double")


def good_documents(docs: DataFrame, trees: Trees, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose score is at least the threshold."""

    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            score = trees.probability(all_statistics(batch.column(at)))
            yield batch.filter(pa.array(score >= threshold))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # as mapInArrow reads names as paths
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, x) for x in ("documents", "labels"))
    scored = quality_scores(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
