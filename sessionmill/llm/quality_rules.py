"""Quality rules as a short-circuit cascade, with DataFrame expressions only.

Each rule is a cheap or dear expression over one document. One job over a bounded sample that is spread
over the table reads the clock before and after every rule, several times and each time on a row of its
own, and keeps which rules reject together. The rule that rejects most per second goes first, then the one that rejects most per second of what is left,
and so on. A CASE chain stops at the first rule that fails, so later rules are not evaluated for
rejected documents. The order changes the running time only: a document is kept when no rule fails, in
any order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import named, table, words


@dataclass(frozen=True)
class Rule:
    """`fails` is a boolean expression in SQL over the columns of measured()."""

    name: str
    fails: str


#: A document of under `MIN_WORDS` words, or with over half its words in repeated three-word windows, fails before the cascade.
MIN_WORDS = 50

#: What fails. A text can't be expected to have new words in proportion to its length: few_distinct_words
#: asks for a twentieth of the words up to 2,000 of them, and from there on for the root of five times as many.
#: repeated_lines lets two lines stand again, as a short text with one refrain would fail else.
RULES = (
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("exclamation", "10 * (length(body) - length(replace(body, '!', ''))) > 3 * n_words"),
    Rule("ellipsis", "10 * regexp_count(body, '(?m)(\\\\.\\\\.\\\\.|…)[ \\\\t\\\\r]*$') > 3 * n_lines"),
    Rule("bullets", "10 * regexp_count(body, '(?m)^[ \\\\t]*[-*•]') > 9 * n_lines"),
    Rule("few_letters", "10 * length(regexp_replace(body, '[^\\\\p{L}]+', '')) < 6 * word_chars"),
    Rule("capitals", "2 * length(regexp_replace(body, '[^\\\\p{Lu}]+', '')) > word_chars"),
    Rule("few_distinct_words", "20 * size(array_distinct(words)) < n_words and pow(size(array_distinct(words)), 2) < 5 * n_words"),
)


def _with(value: Column, f) -> Column:
    """f of a value that is computed once, also where a filter is pushed down and brings the whole expression along."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _repeat_words(words_of_text: Column) -> Column:
    """Words in three-word windows that stand twice or more, windows being told apart by a 64-bit hash."""
    return _with(words_of_text, _repeat_words_of)


def _repeat_words_of(w: Column) -> Column:
    starts = F.when(F.size(w) < 3, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))))
    hash_at = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    hashes = F.transform(starts, hash_at)

    def covered(z: Column) -> Column:
        """z: hash and place of each window, equal ones side by side."""
        same = lambda i, j: F.coalesce(F.get(z, i)["h"] == F.get(z, j)["h"], F.lit(False))
        again = F.filter(z, lambda x, j: same(j, j - 1) | same(j, j + 1))
        return F.aggregate(
            F.sort_array(F.transform(again, lambda x: x["p"])),
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    in_order = F.sort_array(F.transform(starts, lambda i: F.struct(hash_at(i).alias("h"), i.alias("p"))))
    # Most texts repeat no window, which the hashes alone show.
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_with(in_order, covered))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, body, words, n_lines and the base counts, one row per document.

    Null is a text without words or lines. Equal three-word windows are found by a 64-bit hash of
    the three words, within one document only.
    """
    base = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("body"))
    base = base.withColumn("words", words(F.col("body")))
    base = base.withColumn("lines", F.filter(F.split("body", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""))
    return base.select(
        "doc_id",
        "body",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words")


#: Reads the clock in the task, for every row.
CLOCK = "cast(java_method('java.lang.System', 'nanoTime') as bigint)"


def rule_turns(sample: DataFrame, rules, repeats: int, id_col: str, text_col: str) -> DataFrame:
    """row, rule, took (nanoseconds, the least of some readings) and fails, for each row of the sample that reaches the cascade.

    Every reading has a row of its own, with one rule between two looks at the clock, so that nothing which rules share is worked out
    outside of them; what measured() gives is worked out before, on the other side of a shuffle. One more rule, which asks nothing,
    tells what the clock itself takes.
    """
    held = measured(sample, id_col, text_col).where(~base_failed()).withColumn("row", F.monotonically_increasing_id()).repartition("row")
    n = len(rules) + 1
    turns = held.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats * n - 1)))).withColumn("rule", F.col("turn") % n)
    one = F.when(F.col("rule") == len(rules), F.lit(False))
    for i, rule in enumerate(rules):
        one = one.when(F.col("rule") == i, F.expr(rule.fails))
    read = turns.select("row", "rule", F.struct(F.expr(CLOCK).alias("before"), one.alias("fails"), F.expr(CLOCK).alias("after")).alias("t"))
    return read.groupBy("row", "rule").agg(F.min(F.col("t.after") - F.col("t.before")).alias("took"), F.coalesce(F.bool_or("t.fails"), F.lit(False)).alias("fails"))


def measured_rules(docs: DataFrame, rules=RULES, sample_rows: int = 400, repeats: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[int, int], list[int]]:
    """Rows by the set of rules that they fail, as bits; the cost of each rule over all of them, 1 at least.

    About `sample_rows` rows, and twice as many at most, are taken by a hash of id and text over the whole table.
    """
    every = max(1, docs.count() // sample_rows)
    sample = docs.where(F.pmod(F.xxhash64(named(id_col), named(text_col)), F.lit(every)) == 0).limit(2 * sample_rows)
    masks: dict[int, int] = {}
    took = [0] * (len(rules) + 1)
    for r in rule_turns(sample, rules, repeats, id_col, text_col).collect():  # bounded by the sample
        masks[r["row"]] = masks.get(r["row"], 0) | (r["fails"] << r["rule"])
        took[r["rule"]] += r["took"]
    failed: dict[int, int] = {}
    for mask in masks.values():
        failed[mask] = failed.get(mask, 0) + 1
    return failed, [max(1, t - took[-1]) for t in took[:-1]]


def ordered_rules(docs: DataFrame, rules=RULES, sample_rows: int = 400, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """The rules by rejections per cost of what those before them leave. Where no row is left to reject, the cheapest comes next; on an empty sample they stay in the given order."""
    return greedy_order(rules, *measured_rules(docs, rules, sample_rows, id_col=id_col, text_col=text_col))


def greedy_order(rules, failed: dict[int, int], cost: list[int]) -> list[Rule]:
    """`failed`: rows by the set of rules that they fail, as bits; `cost` of each rule over all rows."""
    out, left = [], list(range(len(rules) if failed else 0))
    alive = dict(failed)
    while left:
        rejects = {i: sum(n for mask, n in alive.items() if mask >> i & 1) for i in left}
        best = max(left, key=lambda i: (rejects[i] / max(cost[i], 1), -cost[i], -i))
        out.append(rules[best])
        left.remove(best)
        alive = {mask: n for mask, n in alive.items() if not mask >> best & 1}
    return out or list(rules)


def verdict(rules) -> Column:
    """True when no rule fails; the chain stops at the first that does."""
    chain = F.when(base_failed(), F.lit(False))
    for rule in rules:
        chain = chain.when(F.expr(rule.fails), F.lit(False))
    return chain.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, rules=RULES, sample_rows: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_words, the base counts, base_failed and kept, one row per input row.

    Null and blank texts have no words, so they fail for being short. Repeated rows are judged each
    on its own. Other columns of `docs` are ignored. An empty table gives an empty result.
    """
    order = ordered_rules(docs, rules, sample_rows, id_col, text_col)
    return measured(docs, id_col, text_col).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict(order).alias("kept")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         row_number() OVER () AS rid
  FROM documents
), win AS (
  SELECT rid, p, (w[p], w[p + 1], w[p + 2]) AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM a)
), rep AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY rid
), b AS (
  SELECT doc_id, body, w, CAST(len(w) AS BIGINT) AS n_words, len(lines) AS n_lines,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM a LEFT JOIN cov USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_symbols > 3 * n_words OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines)
            OR 10 * (length(body) - length(replace(body, '!', ''))) > 3 * n_words
            OR 10 * len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) > 3 * n_lines
            OR 10 * len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) > 9 * n_lines
            OR 10 * length(regexp_replace(body, '[^\p{L}]', '', 'g')) < 6 * word_chars
            OR 2 * length(regexp_replace(body, '[^\p{Lu}]', '', 'g')) > word_chars
            OR (20 * len(list_distinct(w)) < n_words AND len(list_distinct(w)) * len(list_distinct(w)) < 5 * n_words)) AS kept
FROM b
"""
