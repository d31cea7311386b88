"""Substring dedup: words inside a window of `window` words that also starts earlier are removed.

1. Anchors. The least hash of the k-word groups in a window is its anchor; equal windows have equal
   anchors, and neighbouring windows mostly share theirs, so a document becomes a short list of runs
   (anchor, first window, windows). A run whose anchor occurs nowhere else can't repeat and ends
   here. A task tells the others once of each anchor it holds, however often it holds it.
2. Passages. The words of the remaining runs go to shards by their anchor. Equal passages of a batch
   combine before they are shuffled: the first of them stands for all. An anchor with very many runs is
   split window by window, so that no shard is flooded.
3. Index. Each shard builds compressed FM-indexes (wavelet matrix over the Burrows-Wheeler transform)
   of its passages, equal ones being one text of the index with several places, and streams the passages
   through backward search. Their matching statistics give, for each place, the length of the longest
   stretch ending there that the index holds more than once; places of at least `window` words make
   intervals, of which the earliest stays.
4. The removed intervals meet their documents again.

Tasks get their rows sorted and work on stretches of bounded size, never on whole partitions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.arrays import Texts, scramble, texts
from sessionmill.llm.common import shared_table, table
from sessionmill.llm.fm_index import FmIndex
from sessionmill.llm.tiles import whole_groups

WINDOW = 20
#: Words of an anchor.
ANCHOR_WORDS = 6
#: Windows of a run, at most; a longer stretch with one anchor is several runs.
RUN = 48
#: An anchor with this many runs is hot: each of its windows goes to a shard of its own. The anchors with most runs come first, and no more are hot than can be told to every task.
HOT_RUNS = 5_000
MAX_HOT = 100_000
#: Passages in one FM-index, about: whole shards.
INDEX_ROWS = 1 << 14
#: Runs that a task works on at once, about.
RUNS_AT_ONCE = 1 << 20

_ANCHOR_BITS = np.uint64((1 << 48) - 1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    reach, out = 1, x
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - reach :]) if reach < width else out


def runs(t: Texts, window: int, anchor_words: int) -> tuple[np.ndarray, ...]:
    """Document, first word in it, windows, anchor, and occurrences of the anchor (1, or 2 for more) of each run of the chunk."""
    empty = np.empty(0, np.int64)
    if len(t.starts) < window:
        return (empty,) * 5
    with np.errstate(over="ignore"):
        group = np.zeros(len(t.hashes) - anchor_words + 1, np.uint64)
        for j in range(anchor_words):
            group = group * np.uint64(0x100000001B3) + t.hashes[j : j + len(group)]
    group = scramble(group) & _ANCHOR_BITS
    anchors = sliding_least(group, window - anchor_words + 1)
    doc = t.doc_of_word[: len(anchors)]
    whole = np.flatnonzero(doc == t.doc_of_word[window - 1 :])  # windows inside one document
    anchors, doc = anchors[whole], doc[whole]
    if not len(whole):
        return (empty,) * 5
    new = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])])
    length = np.diff(np.r_[new, len(whole)])
    if length.max() > RUN:
        pieces = -(-length // RUN)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        new, length = np.repeat(new, pieces) + part * RUN, np.repeat(length, pieces) - part * RUN
        length = np.minimum(length, RUN)
    # An anchor that stands twice in its run can make equal windows within it.
    first, last = whole[new], whole[new] + length - 1
    stands = np.cumsum(np.r_[0, group[whole] == anchors])
    count = stands[new + length] - stands[new]
    for j in range(1, window - anchor_words + 1):
        count += group[last + j] == anchors[new]
    return doc[new], first - t.word_offsets[doc[new]], length, anchors[new].view(np.int64), np.minimum(count, 2)


def repeated_runs(docs: DataFrame, window: int, anchor_words: int, hot_runs: int) -> DataFrame:
    """key, at (first word), n (windows) and anchor of the runs whose anchor is found twice or more; in rows without a key, hot anchors and the number of their runs."""

    def cut(batches):
        parts, size = [], 0
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for t in texts(batch.column(1)):
                doc, at, n, anchor, times = runs(t, window, anchor_words)
                parts.append((keys[t.lo + doc], at, n, anchor, times))
                size += len(doc)
                if size >= RUNS_AT_ONCE:
                    yield from ask(parts)
                    parts, size = [], 0
        if parts:
            yield from ask(parts)

    def ask(parts):
        key, at, n, anchor, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        # One row of each anchor asks the others; the anchor's other rows here are repeated anyway.
        names, first, inverse = np.unique(anchor, return_index=True, return_inverse=True)
        asks = np.zeros(len(key), np.int64)
        asks[first] = np.bincount(inverse, times, minlength=len(names))
        goes = np.where(asks > 0, anchor, scramble(key.view(np.uint64) + at.astype(np.uint64)).view(np.int64))
        other = np.where(asks > 0, 0, anchor)  # a row that asks goes to its anchor, which is shuffled once
        for i in range(0, len(key), 1 << 17):
            s = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (goes, key, at << 8 | n, other, asks)], ["goes", "key", "place", "anchor", "asks"])

    def answer(batches):
        for table in whole_groups(batches, 1 << 17):
            yield from told(*(table.column(i).to_numpy() for i in range(5)))

    def told(goes, key, place, other, asks):
        anchor = np.where(asks > 0, goes, other)
        asking = np.flatnonzero(asks)
        names, inverse = np.unique(anchor[asking], return_inverse=True)
        total = np.bincount(inverse, asks[asking], minlength=len(names)).astype(np.int64)
        keep = asks == 0
        keep[asking[total[inverse] > 1]] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, place >> 8, place & 255, anchor)], ["key", "at", "n", "anchor"])
        hot = total >= hot_runs
        if hot.any():
            blank = pa.nulls(int(hot.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([blank, blank, pa.array(total[hot]), pa.array(names[hot])], ["key", "at", "n", "anchor"])

    asked = docs.select("key", "text").mapInArrow(cut, "goes long, key long, place long, anchor long, asks long")
    return asked.repartition("goes").sortWithinPartitions("goes").mapInArrow(answer, "key long, at long, n long, anchor long")


def spaced(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk with one space after each word and nothing else between; first and last byte of each word there."""
    lengths = t.ends - t.starts
    starts = np.cumsum(lengths + 1) - lengths - 1
    edge = np.zeros(len(t.data) + 1, np.int64)
    edge[t.starts] += 1
    edge[t.ends] -= 1
    word = np.cumsum(edge[:-1]).astype(bool)
    out = np.full(int(lengths.sum() + len(lengths)), 32, np.uint8)
    own = np.ones(len(out), bool)
    own[starts + lengths] = False
    out[own] = t.data[word]
    return out, starts, starts + lengths


def passages(docs: DataFrame, hot: np.ndarray, window: int) -> DataFrame:
    """Rows of key, text, id and runs become rows of shard, words, id, key, at and n.

    words is null where a copy of the passage with a smaller place is in the same batch: then all
    its windows are repeats, and the row only brings that to its document.
    """

    def run(batches):
        for batch in batches:
            ids, keys = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            lists = batch.column(3)
            offsets, flat = np.asarray(lists.offsets) - lists.offsets[0].as_py(), lists.flatten()
            ats, ns, anchors = (np.asarray(flat.field(i)) for i in range(3))
            for t in texts(batch.column(2)):
                data, starts, ends = spaced(t)
                a, b = offsets[t.lo], offsets[t.hi]
                doc = np.repeat(np.arange(t.hi - t.lo), np.diff(offsets[t.lo : t.hi + 1]))
                at, n, anchor = ats[a:b], ns[a:b], anchors[a:b]
                # Runs are found by key: those of another document of the same key may reach over the end.
                inside = at + n + window - 1 <= t.n_words[doc]
                doc, at, n, anchor = doc[inside], at[inside], n[inside], anchor[inside]
                split = np.isin(anchor, hot)
                if split.any():
                    times = np.where(split, n, 1)
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    doc, anchor, split = np.repeat(doc, times), np.repeat(anchor, times), np.repeat(split, times)
                    at, n = np.repeat(at, times) + nth, np.where(split, 1, np.repeat(n, times))
                first = t.word_offsets[doc] + at
                view = data.tobytes()
                words = [view[i:j] for i, j in zip(starts[first].tolist(), ends[first + n + window - 2].tolist(), strict=True)]
                shard = anchor.copy()
                for i in np.flatnonzero(split).tolist():
                    shard[i] = xxhash.xxh3_64_intdigest(words[i]) >> 16
                words = pa.array(words, pa.binary())
                code = np.asarray(words.dictionary_encode().indices) if len(words) else np.empty(0, np.int64)
                order = np.lexsort((at, keys[t.lo + doc], ids[t.lo + doc], code))
                first_of, again = np.ones(len(order), bool), np.zeros(len(order), bool)
                first_of[1:] = code[order[1:]] != code[order[:-1]]
                # The same document given twice is no repeat: one of equal rows stands for all.
                for x in (code, ids[t.lo + doc], keys[t.lo + doc], at):
                    again[1:] = (again[1:] if x is not code else True) & (x[order[1:]] == x[order[:-1]])
                copy, same = np.empty(len(order), bool), np.empty(len(order), bool)
                copy[order], same[order] = ~first_of, again
                rows = np.flatnonzero(~same)
                shard = np.where(copy, scramble(keys[t.lo + doc].view(np.uint64) + at.astype(np.uint64)).view(np.int64), shard)
                words = pa.array(words.to_numpy(zero_copy_only=False), pa.binary(), mask=copy).take(pa.array(rows)) if len(rows) else pa.array([], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(shard[rows]), words, *(pa.array(x[rows]) for x in (ids[t.lo + doc], keys[t.lo + doc], at, n))], ["shard", "words", "id", "key", "at", "n"])

    # With no_id, so that documents are shuffled in the same shape here and at the end, and so only once.
    return docs.select("id", "key", "text", "runs", "no_id").mapInArrow(run, "shard long, words binary, id long, key long, at long, n long")


def index_shards(rows: DataFrame, window: int, index_rows: int = INDEX_ROWS) -> DataFrame:
    """key, id, since, until: words that a repeated window covers, from the rows of passages()."""

    def run(batches):
        for table in whole_groups(batches, index_rows):
            ids, keys, at, n = (table.column(x).to_numpy() for x in ("id", "key", "at", "n"))
            words = table.column("words").combine_chunks()
            copy = np.asarray(words.is_null())
            out = [(keys[copy], ids[copy], at[copy], (at + n)[copy] + window - 1)]
            held = np.flatnonzero(~copy)
            if len(held):
                row, since, until = repeats(words.take(pa.array(held)), ids[held], keys[held], at[held], n[held], window)
                out.append((keys[held][row], ids[held][row], since, until))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["key", "id", "since", "until"])

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "key long, id long, since long, until long")


def repeats(words: pa.Array, ids: np.ndarray, keys: np.ndarray, at: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and word after the last of each stretch that windows with an earlier equal cover."""
    # Equal passages are one text of the index; of the rows that hold it, the earliest speaks for it.
    encoded = words.dictionary_encode()
    code = np.asarray(encoded.indices)
    place = np.lexsort((at, keys, ids))
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    order = np.lexsort((rank, code))
    owner = order[np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])]
    # Word numbers, exact: the words themselves are looked up, not hashes.
    t = next(texts(encoded.dictionary, limit=1 << 62))
    letters = np.concatenate([[0], np.cumsum(t.ends - t.starts)]).astype(np.int64)
    inside = np.zeros(len(t.data) + 1, np.int64)
    inside[t.starts] += 1
    inside[t.ends] -= 1
    flat = t.data[np.cumsum(inside[:-1]).astype(bool)]
    vocabulary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(letters) - 1, [None, pa.py_buffer(letters), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
    numbers = np.asarray(vocabulary.indices).astype(np.int64) + 1
    lengths = t.n_words
    begin = np.cumsum(lengths + 1) - lengths - 1  # of each passage among the symbols
    symbols = np.zeros(int(lengths.sum() + len(lengths)), np.int64)
    symbols[np.arange(len(numbers)) + t.doc_of_word] = numbers
    index = FmIndex(symbols, int(lengths.max()))
    # Stream the passages through the index: statistics of all places that can end a window.
    windows = lengths - window + 1
    passage = np.repeat(np.arange(len(lengths)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    length, lo = index.matching_statistics(symbols, begin[passage] + offset + window - 1, window)
    # When a window starts: by id, then document, then word.
    pairs = np.stack([ids[owner], keys[owner]], axis=1)
    _, doc = np.unique(pairs, axis=0, return_inverse=True)
    when = doc.ravel()[passage] << 40 | (at[owner][passage] + offset)
    repeated = np.flatnonzero(length >= window)
    earliest = when.copy()
    if len(repeated):
        by_range = repeated[np.argsort(lo[repeated], kind="stable")]
        starts = np.flatnonzero(np.r_[True, lo[by_range][1:] != lo[by_range][:-1]])
        least = np.minimum.reduceat(when[by_range], starts)
        earliest[by_range] = np.repeat(least, np.diff(np.r_[starts, len(by_range)]))
    late = earliest < when
    # Stretches of late windows in one passage.
    new = late.copy()
    new[1:] &= ~(late[:-1] & (passage[1:] == passage[:-1]))
    last = late.copy()
    last[:-1] &= ~(late[1:] & (passage[1:] == passage[:-1]))
    since, until = np.flatnonzero(new), np.flatnonzero(last)
    rows = owner[passage[since]]
    others = np.setdiff1d(np.arange(len(ids)), owner)
    speaker = owner[code[others]]
    others = others[(ids[others] != ids[speaker]) | (keys[others] != keys[speaker]) | (at[others] != at[speaker])]
    return (
        np.r_[rows, others],
        np.r_[at[rows] + offset[since], at[others]],
        np.r_[at[rows] + offset[until] + window, at[others] + n[others] + window - 1],
    )


def repeated_words(docs: DataFrame, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS, hot_runs: int = HOT_RUNS, index_rows: int = INDEX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` as id, key and text, and the removed intervals by key and id: since, until (words, from 0)."""
    last = (1 << 63) - 1
    read = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("id"),
        F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("key"),
        F.col(text_col).cast("string").alias("text"),
        F.col(id_col).isNull().alias("no_id"),
    )
    found = shared_table(repeated_runs(read, window, anchor_words, hot_runs))
    most = found.where("key is null").orderBy(F.desc("n"), "anchor").limit(MAX_HOT)  # bounded
    hot = np.array([r["anchor"] for r in most.select("anchor").collect()], np.int64)
    # A set, as rows given twice have the same runs; a table, so that both sides of the join are plain shuffles and a key of very many rows is split.
    by_doc = shared_table(found.where("key is not null").groupBy("key").agg(F.collect_set(F.struct("at", "n", "anchor")).alias("runs")))
    rows = passages(read.join(by_doc, "key").select("id", "key", "text", "runs", "no_id"), hot, window)
    return read, index_shards(rows, window, index_rows)


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS, hot_runs: int = HOT_RUNS, index_rows: int = INDEX_ROWS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Return doc_id, n_words, n_removed, kept_sha256, removed and, if wanted, kept_text, one row per input row.

    A word is removed when a window of `window` words that covers it has an equal window with an
    earlier start: in a document with a smaller id, or further up in the same document. removed
    lists the removed stretches as (since, until), in words from 0. kept_text joins the other words
    by one space. Null counts as a text without words; ids are whole numbers, and a null id comes
    after all others. Rows that share id and text are one document given twice, and get equal
    answers; of rows that share an id only, one counts as the earlier. A document is named by its id
    and a 64-bit hash of id and text between the steps. Other columns are ignored; an empty table
    gives an empty result.
    """
    read, removed = repeated_words(docs, window, anchor_words, hot_runs, index_rows, id_col, text_col)
    intervals = shared_table(removed.groupBy("key").agg(F.collect_set(F.struct("id", "since", "until")).alias("removed")))
    joined = read.join(intervals, "key", "left").select("id", "no_id", "text", "removed")

    def run(batches):
        for batch in batches:
            sizes, gone, digests, kept_texts, stretches = [], [], [], [], []
            for own, text, found in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text or b"").split()  # bytes: ASCII white space only
                sizes.append(len(words))
                merged: list[list[int]] = []
                for x in sorted((x["since"], x["until"]) for x in found or () if x["id"] == own):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                kept, done = [], 0
                for since, until in merged:
                    kept += words[done:since]
                    done = until
                kept += words[done:]
                gone.append(len(words) - len(kept))
                joined_words = b" ".join(kept)
                digests.append(hashlib.sha256(joined_words).hexdigest())
                stretches.append([{"since": a, "until": b} for a, b in merged])
                kept_texts.append(joined_words)
            ids = pa.array(np.asarray(batch.column(0)), mask=np.asarray(batch.column(1)))
            columns = [ids, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(stretches, pa.list_(pa.struct([("since", pa.int64()), ("until", pa.int64())])))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"]
            if with_text:
                columns, names = [*columns, pa.array(kept_texts, pa.binary()).cast(pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    shape = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<since:long,until:long>>"
    return joined.mapInArrow(run, shape + ", kept_text string" * with_text)


def query(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
