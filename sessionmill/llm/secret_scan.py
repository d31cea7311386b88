"""Secret scans: fixed patterns, and strings that look drawn at random.

1. Patterns: assignments to names of secrets, access keys, long hex strings.
2. Battery. Every other run of 16 and more characters of the usual encodings is a candidate if it holds a digit: words and names in
   mixed case do not, and a random string of 20 letters and digits lacks them 3 times in 100. Its encoding is the smallest alphabet
   that holds it. If it is random over that alphabet, its letters are uniform (chi-squared, by exact moments), its upper and lower
   half alternate by chance (runs test) and neighbours are unrelated (serial correlation). Fisher's method makes one p-value of the
   three, the candidate's score.
3. False-discovery control. Ordinary text fails the battery, but short text may pass it. So for each encoding and class of lengths
   decoys of the least length are written by the corpus's own order of characters, and scored alike. A candidate counts if its score
   is so high that decoys of its kind and length, were all candidates such, would make up at most a twentieth of what passes. Where
   decoys do as well as candidates (digits, short strings) nothing is added.

The corpus is read once. What is gathered of it has a fixed size: pairs of neighbouring characters, and candidates by encoding, length
and score.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import shared_table, table

# The patterns of the base kinds, and how long a match must be.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGNED_LETTERS = 6
KINDS = ("assign", "access", "hex", "random")

MIN_LETTERS = 16
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_DIGIT = re.compile("[0-9]")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: From the smallest alphabet; each in its own order.
ENCODINGS = {
    "decimal": _DIGITS, "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567",
    "lower36": _DIGITS + _LOWER, "upper36": _DIGITS + _UPPER, "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_", "all": _UPPER + _LOWER + _DIGITS + "+/-_",
}
SYMBOLS = ENCODINGS["all"]
#: Least lengths of the classes.
LENGTHS = (16, 20, 24, 28, 32, 40, 48, 64, 96, 128, 256)
LEVELS, DECOYS, FALSE_SHARE = 256, 2000, 0.05
_NAMES = list(ENCODINGS)
_SYMBOL = np.full(256, len(SYMBOLS), np.int64)
_SYMBOL[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
_PLACE = {name: {c: i for i, c in enumerate(letters)} for name, letters in ENCODINGS.items()}
_SETS = [(name, frozenset(letters)) for name, letters in ENCODINGS.items()]
_CANDIDATE = "struct<start:int,end:int,stratum:int,level:int,covered:boolean>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of the matches of the fixed patterns, in order; leftmost and apart within each kind."""
    low = text.lower()
    out = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED_LETTERS]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def inferred(token: str) -> tuple[str, str]:
    """The encoding of a candidate and its letters; dashes between groups of digits of a number are no letters of it."""
    letters = token.rstrip("=")
    plain = letters.replace("-", "").replace("_", "")
    held = set(plain)
    for name, alphabet in _SETS[:3]:
        if held <= alphabet and len(plain) >= MIN_LETTERS:
            return name, plain
    held = set(letters)
    return next((name, letters) for name, alphabet in _SETS if held <= alphabet)


def _two_sided(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(x) / math.sqrt(2)) for x in z.tolist()])


def battery(values: np.ndarray, size: int) -> np.ndarray:
    """For each row of letters (numbers below `size`) the p-value of all three tests together, were its letters drawn at random."""
    rows, n = values.shape
    counts = np.bincount((values + np.arange(rows)[:, None] * size).ravel(), minlength=rows * size).reshape(rows, size)
    # Chi-squared is a matter of equal pairs; their mean and variance are exact for any length.
    equal = (counts * (counts - 1)).sum(axis=1) / 2
    mean = n * (n - 1) / 2 / size
    uniform = np.array([math.erfc(x / math.sqrt(2)) / 2 for x in ((equal - mean) / math.sqrt(mean * (1 - 1 / size))).tolist()])
    high = 2 * values >= size
    up = high.sum(axis=1)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    expected = 2.0 * up * (n - up) / n + 1
    spread = np.sqrt(np.maximum((expected - 1) * (expected - 2) / (n - 1), 0))
    one_side = (up == 0) | (up == n)
    turns = np.where(one_side, 2.0 ** (1 - n), _two_sided((runs - expected) / np.where(spread > 0, spread, 1)))
    apart = values - values.mean(axis=1, keepdims=True)
    power = (apart**2).sum(axis=1)
    lag = (apart[:, 1:] * apart[:, :-1]).sum(axis=1) / np.where(power > 0, power, 1)
    serial = np.where(power > 0, _two_sided((lag + 1 / n) * math.sqrt(n)), 0)
    half = -sum(np.log(np.maximum(p, 1e-300)) for p in (uniform, turns, serial))
    return np.exp(-half) * (1 + half + half**2 / 2)


def level_of(score: np.ndarray) -> np.ndarray:
    return np.minimum((score * LEVELS).astype(np.int64), LEVELS - 1)


def decoys(pairs: np.ndarray, encoding: str, n: int, seed: int = 11) -> np.ndarray:
    """DECOYS rows of n letters of an encoding in the order of ordinary text: pairs[a, b] is how often symbol b follows a, the last symbol being none.

    Text in capitals is rare; an encoding without small letters takes the order of letters whatever their case.
    """
    letters = ENCODINGS[encoding]
    if letters == letters.upper():
        letters = letters.lower()
        fold = np.array([*(SYMBOLS.index(c.lower()) for c in SYMBOLS), len(SYMBOLS)])
        folded = np.zeros_like(pairs)
        np.add.at(folded, (fold[:, None], fold[None, :]), pairs)
        pairs = folded
    own = [SYMBOLS.index(c) for c in letters]
    follow = pairs[np.ix_([*own, len(SYMBOLS)], own)] + 0.5
    upto = np.cumsum(follow / follow.sum(axis=1, keepdims=True), axis=1)
    rng = np.random.default_rng(seed)
    at, out = np.full(DECOYS, len(own)), np.empty((DECOYS, n), np.int64)
    for i in range(n):
        at = np.minimum((upto[at] < rng.random(DECOYS)[:, None]).sum(axis=1), len(own) - 1)
        out[:, i] = at
    return out


def thresholds(pairs: np.ndarray, found: dict[int, np.ndarray], share: float = FALSE_SHARE) -> list[int]:
    """For each stratum the least level that counts; LEVELS where none does. found: by stratum, candidates of each level."""
    out = [LEVELS] * (len(_NAMES) * len(LENGTHS))
    for e, name in enumerate(_NAMES):
        own = [k for k in range(len(LENGTHS)) if e * len(LENGTHS) + k in found]
        if not own:
            continue
        written = decoys(pairs, name, LENGTHS[own[-1]])
        for k in own:
            level = level_of(battery(written[:, : LENGTHS[k]], len(ENCODINGS[name])))
            passing = np.cumsum(np.bincount(level, minlength=LEVELS)[::-1])[::-1]
            counted = np.cumsum(found[e * len(LENGTHS) + k][::-1])[::-1]
            false = counted[0] * (passing + 1) / (DECOYS + 1)
            good = np.flatnonzero((counted > 0) & (false <= share * counted))
            if len(good):
                out[e * len(LENGTHS) + k] = int(good[0])
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """start, end, stratum, level, and whether a base span covers it, of each candidate of a text."""
    out = []
    for m in CANDIDATE.finditer(text):
        if not _DIGIT.search(m[0]):
            continue
        name, letters = inferred(m[0])
        place = _PLACE[name]
        score = battery(np.array([[place[c] for c in letters]]), len(place))
        k = sum(len(letters) >= x for x in LENGTHS) - 1
        out.append((m.start(), m.end(), _NAMES.index(name) * len(LENGTHS) + k, int(level_of(score)[0]), any(a <= m.start() and m.end() <= b for a, _, b in base)))
    return out


def _scan(batches):
    kinds = [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("level", pa.int32()), ("covered", pa.bool_())])), pa.list_(pa.int64())]
    names, none = ["doc_id", "base", "candidates", "pairs"], len(SYMBOLS)
    pairs = np.zeros((none + 1) ** 2, np.int64)
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            ids, base, held, plain = batch.column(0).slice(i, 256), [], [], []
            for text in batch.column(1).slice(i, 256).to_pylist():
                text = text or ""
                spans = base_spans(text)
                found = candidates(text, spans)
                base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in spans])
                held.append([dict(zip(("start", "end", "stratum", "level", "covered"), x, strict=True)) for x in found])
                plain.append(CANDIDATE.sub(" ", text) if found else text)
                if len(plain) == 16:
                    pairs += _pairs(plain)
                    plain = []
            pairs += _pairs(plain)
            yield pa.RecordBatch.from_arrays([ids, pa.array(base, kinds[1]), pa.array(held, kinds[2]), pa.nulls(len(ids), kinds[3])], names)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.nulls(1, kinds[2]), pa.array([pairs.tolist()], kinds[3])], names)


def _pairs(plain: list[str]) -> np.ndarray:
    """How often each symbol follows each other one in the texts, with all that is no symbol as one more."""
    data, out = np.frombuffer(f" {' '.join(plain)} ".encode(), np.uint8), np.zeros((len(SYMBOLS) + 1) ** 2, np.int64)
    for i in range(0, len(data) - 1, 1 << 20):
        symbol = _SYMBOL[data[i : i + (1 << 20) + 1]]
        out += np.bincount(symbol[:-1] * (len(SYMBOLS) + 1) + symbol[1:], minlength=len(out))
    return out


def secret_scan(docs: DataFrame, false_share: float = FALSE_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id and spans (start, kind, end), in code points, by start and kind, one row per input row.

    Kinds are assign, access and hex, which patterns fix, and random: candidates that pass the battery and are not within another span.
    `false_share` is the share of ordinary text that may be among the latter. Null counts as an empty text. Rows are judged one by
    one against what all rows hold, so repeated rows and rows that share an id get equal answers. Other columns are ignored; an
    empty table gives an empty result.
    """
    read = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = shared_table(read.mapInArrow(_scan, f"doc_id string, base array<struct<start:int,kind:int,end:int>>, candidates array<{_CANDIDATE}>, pairs array<long>"))
    levels: dict[int, np.ndarray] = {}
    for r in found.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.level").count().collect():  # bounded
        levels.setdefault(r["stratum"], np.zeros(LEVELS, np.int64))[r["level"]] = r["count"]
    pairs = np.zeros((len(SYMBOLS) + 1) ** 2, np.int64)
    for r in found.where("pairs is not null").select(F.posexplode("pairs")).groupBy("pos").agg(F.sum("col").alias("n")).collect():  # bounded
        pairs[r["pos"]] = r["n"]
    least = F.array(*(F.lit(x) for x in thresholds(pairs.reshape(len(SYMBOLS) + 1, -1), levels, false_share)))
    good = F.filter("candidates", lambda c: (c["level"] >= F.get(least, c["stratum"])) & ~c["covered"])
    added = F.transform(good, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    name = F.array(*(F.lit(k) for k in KINDS))
    spans = F.transform(F.array_sort(F.concat("base", added)), lambda s: F.struct(s["start"].alias("start"), F.get(name, s["kind"]).alias("kind"), s["end"].alias("end")))
    return found.where("pairs is null").select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), spans.alias("spans"))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def query(spark, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *counts, F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))
