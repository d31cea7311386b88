"""Periodic runs: stretches of words that repeat with a short period, four times or more, found whatever their period.

Periods are taken by octaves, P .. 2P - 1. In an octave every P-th word of a document is a boundary, so a run of that
octave holds several boundaries.

1. Tiles. A boundary at which 2P words come again one period later (a rolling hash says so, for all periods of the octave at
   once) asks for its surroundings: P words before it and 5P after it. Neighbouring boundaries share a tile. Documents
   without such a boundary have no run and are done here.
2. Solving. Tiles go to any task. At each boundary two Z-functions, one onwards and one backwards over the boundary, give
   how far every period of the octave reaches on either side; a period with a divisor that reaches as far isn't the smallest.
3. Stitching. The fragments meet by document and period, and those that touch or overlap become one run.
4. The runs meet their documents again, which keep one period of each.

A long document is many tiles, and rows are told apart by number, so neither it nor repeated rows meet in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.llm.arrays import Texts, scramble, texts
from sessionmill.llm.common import shared_table, table, words

#: A run repeats its period this often at least, and has this many words at least.
MIN_EXPONENT, MIN_LENGTH = 4, 6
#: Words between the first and the last boundary of a tile, about; tiles of long periods are longer.
TILE_WORDS = 1 << 12
#: Comparisons that are made at once.
_BLOCK = 1 << 20
_RUNS = "array<struct<start:long,length:long,period:long>>"


def word_numbers(t: Texts) -> np.ndarray:
    """Equal numbers for equal words of the chunk, other numbers for others; exact."""
    ends = np.concatenate([[0], np.cumsum(t.ends - t.starts)]).astype(np.int64)
    edge = np.zeros(len(t.data) + 1, np.int64)
    edge[t.starts] += 1
    edge[t.ends] -= 1
    letters = np.ascontiguousarray(t.data[np.cumsum(edge[:-1]).astype(bool)])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return np.asarray(column.dictionary_encode().indices).astype(np.int32)


def boundaries(numbers: np.ndarray, offsets: np.ndarray):
    """For each octave, from the shortest periods: P, and the words of the chunk that are boundaries where a period may go on for 2P words."""
    sizes = np.diff(offsets)
    rng = np.random.default_rng(13)
    h, p = scramble(numbers.astype(np.uint64)), 1
    while (many := np.flatnonzero(sizes >= 4 * p)).size:
        with np.errstate(over="ignore"):
            ahead = np.concatenate([h[p:], np.zeros(min(p, len(h)), np.uint64)])
            h = scramble(h * np.uint64(int(rng.integers(1 << 62)) * 2 + 1) + ahead)  # of 2p words each
        padded = np.concatenate([h, np.zeros(2 * p, np.uint64)])
        each = (sizes[many] - 3 * p) // p + 1
        at = np.repeat(offsets[many], each) + (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * p
        room = np.repeat(offsets[many + 1], each) - at - 3 * p  # the largest period that fits, less p
        shifted = np.lib.stride_tricks.sliding_window_view(padded, p)
        found, step = [], max(1, _BLOCK // p)
        for i in range(0, len(at), step):
            own = at[i : i + step]
            same = shifted[own + p] == padded[own][:, None]
            some = np.flatnonzero(same.any(axis=1))
            fits = np.arange(p)[None, :] <= room[i : i + step][some][:, None]
            found.append(own[some[(same[some] & fits).any(axis=1)]])
        yield p, np.concatenate(found)
        p *= 2


def tiles_of(t: Texts) -> tuple[np.ndarray, list[tuple]]:
    """Which documents of the chunk have tiles, and the tiles: document, P, first word, words, boundaries in it."""
    offsets = t.word_offsets
    has, out = np.zeros(len(offsets) - 1, bool), []
    if not len(t.starts):
        return has, out
    numbers = word_numbers(t)
    for p, at in boundaries(numbers, offsets):
        if not len(at):
            continue
        doc = np.searchsorted(offsets, at, "right") - 1
        has[doc] = True
        block = (at - offsets[doc]) // max(TILE_WORDS, 4 * p)
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])])
        for i, j in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=True):
            lo, hi = int(offsets[doc[i]]), int(offsets[doc[i] + 1])
            first, last = max(lo, int(at[i]) - p), min(hi, int(at[j - 1]) + 5 * p)
            out.append((int(doc[i]), p, first - lo, numbers[first:last].tobytes(), (at[i:j] - first).astype(np.int32).tolist()))
    return has, out


def z_function(s: list[int], upto: int) -> list[int]:
    """For each place i < upto how many items from there on equal those at the start; 0 for i = 0."""
    n, z, left, right = len(s), [0] * upto, 0, 0
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _primes(n: int) -> list[int]:
    out, r = [], 2
    while r * r <= n:
        if n % r == 0:
            out.append(r)
            while n % r == 0:
                n //= r
        r += 1
    return [*out, n] if n > 1 else out


def fragments(w: list[int], p: int, marks: list[int]) -> list[tuple[int, int, int]]:
    """Period, first word and word after the last of each stretch in which every word equals the one a period later, around the boundaries."""
    open_at: dict[int, list[int]] = {}
    out = []
    for b in marks:
        reach = z_function(w[b : b + 5 * p], min(2 * p, len(w) - b))
        hits = [q for q in range(p, len(reach)) if reach[q] >= 2 * p and all(reach[q // r] < q for r in _primes(q))]
        if not hits:
            continue
        left, end = w[max(b - p, 0) : b], min(b + 2 * p, len(w))
        back = z_function([*left[::-1], -1, *w[max(b - p, 0) : end][::-1]], len(left) + 1 + end - b - p + 1)
        for q in hits:
            since, until = b - back[len(left) + 1 + end - b - q], b + reach[q]
            held = open_at.get(q)
            if held and since <= held[1]:
                held[1] = max(held[1], until)
            else:
                if held:
                    out.append((q, *held))
                open_at[q] = [since, until]
    return out + [(q, *held) for q, held in open_at.items()]


def _cut(with_text: bool):
    names = ["row", "doc_id", "n_words", "kept", "text", "octave", "base", "words", "marks"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for t in texts(column):
                has, tiles = tiles_of(t)
                n, held = t.hi - t.lo, column.slice(t.lo, t.hi - t.lo)
                kept = [None if x else hashlib.sha256(b" ".join(t.data[t.offsets[i] : t.offsets[i + 1]].tobytes().split())).hexdigest() for i, x in enumerate(has.tolist())]
                if not with_text:  # only documents that may have runs are needed again
                    held = pa.array([x.as_py() if y else None for x, y in zip(held, has.tolist(), strict=True)], pa.string())
                own = [pa.array(np.arange(row, row + n)), ids.slice(t.lo, n), pa.array(t.n_words.astype(np.int64)), pa.array(kept, pa.string()), held]
                yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(n, k) for k in kinds[5:])], names)
                for i in range(0, len(tiles), 1 << 12):
                    doc, *rest = zip(*tiles[i : i + (1 << 12)], strict=True)
                    blank = [pa.nulls(len(doc), k) for k in kinds[1:5]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(doc) + row), *blank, *(pa.array(x, k) for x, k in zip(rest, kinds[5:], strict=True))], names)
                row += n

    return run


def _solve(batches):
    for batch in batches:
        rows = []
        for row, p, base, held, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(row, q, base + a, base + b) for q, a, b in fragments(np.frombuffer(held, np.int32).tolist(), p, marks)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["row", "period", "since", "until"])


def _collapse(with_text: bool):
    def run(batches):
        for batch in batches:
            ids, n_words, kept, held, runs = (batch.column(i) for i in range(5))
            digests, gone, kept_texts = kept.to_pylist(), [], []
            for i, (text, found) in enumerate(zip(held.to_pylist(), runs.to_pylist(), strict=True)):
                own = (text or "").encode().split()  # bytes: ASCII white space only
                edge = np.zeros(len(own) + 1, np.int64)
                for r in found or ():
                    edge[r["start"] + r["period"]] += 1
                    edge[r["start"] + r["length"]] -= 1
                stays = np.cumsum(edge)[:-1] == 0
                joined = b" ".join([w for w, k in zip(own, stays.tolist(), strict=True) if k])
                gone.append(len(own) - int(stays.sum()))
                digests[i] = digests[i] or hashlib.sha256(joined).hexdigest()
                kept_texts.append(joined)
            columns, names = [ids, n_words, runs, pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "runs", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept_texts, pa.binary()).cast(pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def periodic_runs(docs: DataFrame, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Return doc_id (as text), n_words, runs (start, length, period; by start, then period), n_removed, kept_sha256 and, if wanted, kept_text, one row per input row.

    A run is a stretch of words in which words a period apart are equal, that has no smaller period, can't be made longer, holds
    `min_exponent` (4 or more) periods and `min_length` words. kept_text joins by one space the words that no run holds after its
    first period, kept_sha256 is its digest. Words end at ASCII white space only. Null counts as a text without words. Rows
    are judged one by one, so repeated rows and rows that share an id get equal answers; a null id stays null. Other columns
    are ignored; an empty table gives an empty result.
    """
    if min_exponent < 4:
        raise ValueError("min_exponent is 4 or more")
    read = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = shared_table(read.mapInArrow(_cut(with_text), "row long, doc_id string, n_words long, kept string, text string, octave long, base long, words binary, marks array<int>"))
    # Tiles are few bytes and much work: as many tasks as the session has for a shuffle, not as few as would hold the bytes.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = found.where("octave is not null").select("row", "octave", "base", "words", "marks").repartition(tasks, "row", "octave", "base")
    parts = tiles.mapInArrow(_solve, "row long, period long, since long, until long")
    order = Window.partitionBy("row", "period").orderBy("since", "until")
    before = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("opens", F.when(F.col("since") <= before, 0).otherwise(1)).withColumn("nth", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("row", "period", "nth").agg(F.min("since").alias("start"), (F.max("until") - F.min("since") + F.col("period")).alias("length"))
    whole = whole.where((F.col("length") >= min_length) & (F.col("length") >= min_exponent * F.col("period")))
    in_order = F.array_sort(F.collect_list(F.struct("start", "period", "length")))
    runs = whole.groupBy("row").agg(F.transform(in_order, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    own = found.where("octave is null").select("row", "doc_id", "n_words", "kept", "text").join(runs, "row", "left")
    own = own.select("doc_id", "n_words", "kept", "text", F.coalesce("runs", F.array().cast(_RUNS)).alias("runs"))
    shape = f"doc_id string, n_words long, runs {_RUNS}, n_removed long, kept_sha256 string"
    out = own.mapInArrow(_collapse(with_text), shape + ", kept_text string" * with_text)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as doc_id and text, of which about one in ten is made to repeat some of its words up to its end, by the crc32 of its id; a null id stays as it is."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), h.alias("h"), F.when(h % 10 == 0, words(F.col(f"`{text_col}`"))).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("w", 1, F.col("a")), F.slice(again, 1, left)), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), changed).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(looped(table(spark, sf_dir, "documents")), with_text=False)
    better = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"]) | ((a["length"] * b["period"] == b["length"] * a["period"]) & (F.struct(a["start"], a["period"]) < F.struct(b["start"], b["period"])))
    most = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    found = found.withColumn("most", most).withColumn("lines", F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("most.start").alias("start"), F.col("most.length").alias("length"), F.col("most.period").alias("period"),
        F.floor(1000 * F.col("most.length") / F.col("most.period")).alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.col("kept_sha256").alias("collapsed_sha256"),
    )


#: crc32 of a column of digits, bit by bit; then each pair of equal words a period apart, and the stretches of such pairs.
ORACLE = """
WITH h0 AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL),
hs AS (
  SELECT doc_id, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda k: CAST((ascii(ch) >> k) & 1 AS BIGINT))))),
           lambda c, b: CASE WHEN xor(c & 1, b) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h
  FROM h0
),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         CASE WHEN trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN CAST([] AS VARCHAR[])
              ELSE regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') END AS w
  FROM documents
),
e AS (
  SELECT d.*, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 AND h % 10 = 0 THEN (h // 10) % len(w) END AS a
  FROM d LEFT JOIN hs USING (doc_id)
),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
t AS (
  SELECT r, doc_id, n, i, CASE WHEN a IS NOT NULL AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM f)
),
same AS (SELECT x.r, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same),
found AS (SELECT r, min(i) AS s, count(*) + q AS l, q FROM island GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, s, l, min(q) AS q FROM found GROUP BY r, s, l),
per AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
         max(CAST(l AS DOUBLE) / q) AS top
  FROM runs GROUP BY r
),
best AS (SELECT r, s, l, q FROM (SELECT runs.*, row_number() OVER (PARTITION BY r ORDER BY s, q) AS place FROM runs JOIN per USING (r) WHERE CAST(l AS DOUBLE) / q = top) WHERE place = 1),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT t.r, string_agg(word, ' ' ORDER BY t.i) AS words FROM t LEFT JOIN gone USING (r, i) WHERE gone.i IS NULL GROUP BY t.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS "start", CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
