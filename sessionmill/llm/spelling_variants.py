"""Spelling variants: words one edit apart, and the common word that each rare one stands for.

Two words that differ by one inserted, deleted or replaced code point have letter counts that differ by 1 in one place, or by
1 down in one and 1 up in another: an L1 distance of at most two. So words are points of letter counts, one k-d tree for each
length, and each word looks for its neighbours of the same length and for those that are one shorter.

1. Cells. A k-d tree over a bounded sample of the words cuts the points of a length into cells of a few thousand words. Every
   word goes to its own cell as a point, and as a query to each cell whose box it can reach with one letter less and one more
   (for shorter words, with one less).
2. Range searches. A cell is one group of a shuffle. It builds its own k-d tree, whose boxes prune the queries again; the
   words of a bucket are compared with the queries that reach it, first by the distance of letter counts, then letter by letter.
   A pair is found in the cell of its point and nowhere else. A cell tells each word how many near words it holds and the best.
3. Forms. The best near word of all cells is the form of a word if it is common enough; forms of forms are followed by
   doubling, as each is `ratio` times more common than the last, in a few rounds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import checkpointed, shared_table, table
from sessionmill.llm.tiles import whole_groups

MIN_LETTERS, MIN_COUNT, RATIO = 7, 2, 10
#: Of this many words, drawn by hash, the cells are made; with more words than cells can hold at this size, cells grow.
SAMPLE_WORDS = 1 << 17
CELL_WORDS, BUCKET_WORDS = 8192, 64
#: Letters a-z have a dimension each, other characters share the rest.
DIMS, _OTHER = 32, 6
#: Distinct words that a task holds before it hands on their counts.
HELD_WORDS = 1 << 17
_RUN = re.compile("[a-zÀ-ÿ]{7,}")


@dataclass
class Tree:
    """A k-d tree, flattened: nodes ask whether the count of letter `dim` is at most `cut`; a child below 0 is leaf -1 - child."""

    dim: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaves: int


def by_length(words: list[str]):
    """For each length: the places of its words, and their code points as a matrix."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield n, at, np.frombuffer("".join([words[i] for i in at.tolist()]).encode("utf-32-le"), np.uint32).reshape(len(at), n)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """How often each row of code points holds each letter; other characters share dimensions, which brings words nearer, never apart."""
    small = (letters >= 97) & (letters <= 122)
    dims = np.where(small, letters - 97, 26 + letters % _OTHER).astype(np.int64)
    dims += np.arange(len(letters))[:, None] * DIMS
    return np.bincount(dims.ravel(), minlength=len(letters) * DIMS).reshape(-1, DIMS).astype(np.int32)


def build(points: np.ndarray, leaf: int) -> Tree:
    """Cut at the letter and count that halves the points best, down to `leaf` points or points that are all alike."""
    dim, cut, low, high, leaves = [], [], [], [], 0
    waiting = [(np.arange(len(points)), -1, False)]
    while waiting:
        own, parent, is_high = waiting.pop()
        best = None
        if len(own) > leaf:
            held = points[own]
            for t in range(4):
                below = (held <= t).sum(axis=0)
                d = int(np.abs(below - len(own) / 2).argmin())
                if 0 < below[d] < len(own) and (best is None or abs(below[d] - len(own) / 2) < best[0]):
                    best = (abs(below[d] - len(own) / 2), d, t)
            if best is None and (held != held[0]).any():  # high counts only
                d = int(np.ptp(held, axis=0).argmax())
                best = (0, d, int((held[:, d].min() + held[:, d].max() - 1) // 2))
        if best is None:
            here, leaves = -1 - leaves, leaves + 1
        else:
            here = len(dim)
            for x, y in zip((dim, cut, low, high), (best[1], best[2], 0, 0), strict=True):
                x.append(y)
            side = held[:, best[1]] <= best[2]
            waiting += [(own[side], here, False), (own[~side], here, True)]
        if parent >= 0:
            (high if is_high else low)[parent] = here
    return Tree(*(np.array(x, np.int64) for x in (dim, cut, low, high)), leaves)


def reach(tree: Tree, points: np.ndarray, less: bool, more: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `points` with each leaf whose box they reach by taking at most one letter away (`less`) and adding at most one (`more`)."""
    n = len(points)
    row, node = np.arange(n), np.zeros(n, np.int64) if len(tree.dim) else np.full(n, -1)
    free, never = -1, DIMS
    down, up = np.full(n, free if less else never), np.full(n, free if more else never)
    rows, leaves = [], []
    while len(row):
        done = node < 0
        rows.append(row[done])
        leaves.append(-1 - node[done])
        row, node, down, up = (x[~done] for x in (row, node, down, up))
        d, t = tree.dim[node], tree.cut[node]
        v = points[row, d] - (down == d) + (up == d)
        below = v <= t
        over = np.flatnonzero(below & (v == t) & (up == free) & (down != d))
        under = np.flatnonzero(~below & (v == t + 1) & (down == free) & (up != d))
        child = np.where(below, tree.low[node], tree.high[node])
        row, node, down, up = (
            np.concatenate([row, row[over], row[under]]),
            np.concatenate([child, tree.high[node[over]], tree.low[node[under]]]),
            np.concatenate([down, down[over], d[under]]),
            np.concatenate([up, d[over], up[under]]),
        )
    return np.concatenate(rows), np.concatenate(leaves)


def near(longer: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which rows of code points are one edit apart: one replaced, or one more in `longer`."""
    n = other.shape[1]
    if longer.shape[1] == n:
        return (longer != other).sum(axis=1) == 1
    ahead = np.cumprod(longer[:, :n] == other, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    behind = np.cumprod((longer[:, 1:] == other)[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return ahead + behind >= n


def pairs(queries: np.ndarray, points: np.ndarray, bucket: int = BUCKET_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of queries and of points that are one edit apart; queries are as long as points or one longer."""
    same = queries.shape[1] == points.shape[1]
    p, q = letter_counts(points), letter_counts(queries)
    tree = build(p, bucket)
    home = reach(tree, p, False, False)
    by_leaf = home[0][np.argsort(home[1], kind="stable")]
    first = np.searchsorted(np.sort(home[1]), np.arange(tree.leaves + 1))
    row, leaf = reach(tree, q, True, same)
    order = np.argsort(leaf, kind="stable")
    row, asked = row[order], np.searchsorted(leaf[order], np.arange(tree.leaves + 1))
    kind = np.float32 if points.shape[1] < 2048 else np.float64  # whole numbers, exact
    p, q = p.astype(kind), q.astype(kind)
    p2, q2 = (p * p).sum(axis=1), (q * q).sum(axis=1)
    out_q, out_p = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(tree.leaves):
        own = by_leaf[first[k] : first[k + 1]]
        step = max(1, (1 << 20) // len(own))
        for i in range(asked[k], asked[k + 1], step):
            ask = row[i : min(i + step, asked[k + 1])]
            # Letters add up to the lengths, so an L1 distance of at most two is a square distance of at most two.
            apart = q2[ask][:, None] + p2[own][None, :] - 2 * (q[ask] @ p[own].T)
            a, b = np.nonzero(apart <= (2 if same else 1))
            a, b = ask[a], own[b]
            good = near(queries[a], points[b])
            out_q.append(a[good])
            out_p.append(b[good])
    return np.concatenate(out_q), np.concatenate(out_p)


def word_counts(docs: DataFrame, flawed: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n (occurrences) of all words of MIN_LETTERS letters and more: runs of a-z and U+00C0 to U+00FF after A-Z are lower-cased.

    flawed: by the crc32 of document and word, one word in 31 loses a letter first. A null id is no document: its words stay whole.
    """

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                found = _RUN.findall(text.encode().lower().decode())  # bytes: A-Z only
                if not flawed or own is None:
                    held.update(found)
                else:
                    since = zlib.crc32(f"{own}:".encode())
                    for word, n in Counter(found).items():
                        h = zlib.crc32(word.encode(), since)
                        if h % 31 == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < MIN_LETTERS:
                                continue
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
                    held.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    rows = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def cells(words: DataFrame, n_words: int, cell_words: int, sample_words: int) -> dict[int, tuple[Tree, int]]:
    """For each length in a sample of the words a tree and the number of its first cell."""
    share = min(1.0, sample_words / max(n_words, 1))
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else words
    sample = drawn.select("word").limit(2 * sample_words).toArrow().column(0).to_pylist()  # bounded; the limit is never met unless hashes fail
    out, first = {}, 1 << 20
    for n, _, letters in by_length(sample):
        tree = build(letter_counts(letters), max(16, int(cell_words * share)))
        out[n] = (tree, first)
        first += tree.leaves
    return out


def near_words(words: DataFrame, cell_words: int = CELL_WORDS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """word, n_near, and in `best` the count (negative) and name of the most common near word, for each word that has one.

    words: word and n, each word once, with lineage already cut.
    """
    trees = cells(words, words.count(), cell_words, sample_words)
    one = (Tree(*(np.empty(0, np.int64) for _ in range(4)), 1), None)

    def spread(batches):
        for batch in batches:
            names, counts = batch.column(0), np.asarray(batch.column(1))
            places, goes, kinds = [], [], []
            for n, at, letters in by_length(names.to_pylist()):
                points = letter_counts(letters)
                for kind, length, less, more in ((0, n, False, False), (1, n, True, True), (2, n - 1, True, False)):
                    tree, first = trees.get(length, one)
                    row, leaf = reach(tree, points, less, more)
                    places.append(at[row])
                    goes.append((leaf + first if first else np.full(len(row), length)) + (length << 40))
                    kinds.append(np.full(len(row), kind, np.int32))
            if places:
                place, cell, kind = (np.concatenate(x) for x in (places, goes, kinds))
                for i in range(0, len(place), 1 << 16):
                    s = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[s]), pa.array(kind[s]), names.take(pa.array(place[s])), pa.array(counts[place[s]])], ["cell", "kind", "word", "n"])

    def search(batches):
        for group in whole_groups(batches, cell_words):
            cell = group.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield from told(group.slice(lo, hi - lo))

    def told(cell):
        kind, names, counts = cell.column(1).to_numpy(), cell.column(2).combine_chunks(), cell.column(3).to_numpy()
        held = np.flatnonzero(kind == 0)
        word, other = [], []
        if not len(held):
            return
        _, _, points = next(by_length(names.take(pa.array(held)).to_pylist()))
        for k in (1, 2):
            ask = np.flatnonzero(kind == k)
            if len(ask):
                _, _, queries = next(by_length(names.take(pa.array(ask)).to_pylist()))
                a, b = pairs(queries, points)
                word += [ask[a]] if k == 1 else [ask[a], held[b]]
                other += [held[b]] if k == 1 else [held[b], ask[a]]
        word, other = np.concatenate(word or [held[:0]]), np.concatenate(other or [held[:0]])
        if not len(word):
            return
        rank = np.empty(len(names), np.int64)
        rank[np.asarray(pc.array_sort_indices(names))] = np.arange(len(names))
        order = np.lexsort((rank[other], -counts[other], word))
        word, other = word[order], other[order]
        new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        n_near = np.diff(np.r_[new, len(word)])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(word[new])), pa.array(n_near), pa.array(counts[other[new]]), names.take(pa.array(other[new]))], ["word", "n_near", "n", "other"])

    rows = words.select("word", "n").mapInArrow(spread, "cell long, kind int, word string, n long")
    found = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(search, "word string, n_near long, n long, other string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("best"))


def spelling_variants(words: DataFrame, ratio: int = RATIO, cell_words: int = CELL_WORDS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """Return word, form, root, n, n_near and form_n, one row per word.

    words: word and n, the number of its occurrences; rows of one word are added up, rows without a word or a number ignored, as are
    empty words. Two words are near if one edit (a code point inserted, deleted or replaced) makes one of the other. The form of a word
    is its near word of largest n, of equal ones the first in code-point order, if that n is `ratio` (2 or more) times its own or more;
    root is where following forms ends, the word itself if it has none. Other columns are ignored; an empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio is 2 or more")
    known = words.where("word is not null and word != '' and n is not null").groupBy("word").agg(F.sum(F.col("n").cast("long")).alias("n"))
    known = shared_table(known)
    found = near_words(known, cell_words, sample_words)
    rows = known.join(found, "word", "left")
    has = F.col("best").isNotNull() & (-F.col("best.n") >= ratio * F.col("n"))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n"))
    rows = shared_table(rows)
    up = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps; n rises by `ratio` at each step, so there are few
        ends = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = checkpointed(up.join(ends, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not up.where("moved").limit(1).count():
            break
        up = up.select("word", "root")
    return rows.join(up.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    words = word_counts(table(spark, sf_dir, "documents"), flawed=True)
    return spelling_variants(words.where((F.col("n") >= MIN_COUNT) & (F.length("word") >= MIN_LETTERS)))


#: crc32 of each word, bit by bit; near words by the words that a starred or deleted letter leaves.
ORACLE = """
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents
),
k AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
coded AS (
  SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 | (unicode(ch) >> 6), 128 | (unicode(ch) & 63)] END)) AS bytes FROM k
),
h AS (
  SELECT run, c, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(bytes, lambda x: list_transform(range(8), lambda i: CAST((x >> i) & 1 AS BIGINT))))),
           lambda s, b: CASE WHEN xor(s & 1, b) = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) AS h
  FROM coded
),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
holes AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
shorter AS (SELECT DISTINCT word, n, a || b AS other FROM holes),
near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS m FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT s.word, s.n, v.word, v.n FROM shorter s JOIN v ON v.word = s.other
  UNION ALL SELECT v.word, v.n, s.word, s.n FROM shorter s JOIN v ON v.word = s.other
),
best AS (SELECT word, other AS form, m AS form_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM near) WHERE place = 1 AND m >= 10 * n),
up AS (SELECT word, form AS root, 1 AS steps FROM best UNION ALL SELECT up.word, best.form, steps + 1 FROM up JOIN best ON best.word = up.root),
roots AS (SELECT word, arg_max(root, steps) AS root FROM up GROUP BY word),
counts AS (SELECT word, count(*) AS n_near FROM near GROUP BY word)
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0) AS n_near, form_n
FROM v LEFT JOIN counts USING (word) LEFT JOIN best USING (word) LEFT JOIN roots USING (word)
"""
