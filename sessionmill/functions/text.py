"""Previews, names and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_all(s: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def first_bytes(s: Column, n: Column) -> Column:
    """The longest prefix of at most n bytes that ends between characters."""
    cut = F.substring(s.cast("binary"), F.lit(1), n).cast("string")
    return F.when(F.is_valid_utf8(cut), cut).otherwise(F.regexp_replace(F.make_valid_utf8(cut), "\ufffd+$", ""))


def on_one_line(s: Column) -> Column:
    return F.replace(trim_all(s), F.lit("\n"), F.lit(" "))


def cut_to(flat: Column, n: Column) -> Column:
    """Over n characters a text is cut at n bytes and gets an ellipsis."""
    return F.when(F.char_length(flat) <= n, flat).otherwise(F.concat(first_bytes(flat, n), F.lit("…")))


def preview(s: Column, n: int) -> Column:
    return cut_to(on_one_line(s), F.lit(n))


def short_filename(session_id: Column) -> Column:
    return F.regexp_replace(session_id, r"(?U)[^\p{Alnum}\-_]", "-")


def short_id(session_id: Column) -> Column:
    return F.when(F.char_length(session_id) <= 14, session_id).otherwise(F.concat(F.left(session_id, F.lit(8)), F.lit("…"), F.right(session_id, F.lit(4))))


def project_name(cwd: Column) -> Column:
    """The last part of a path."""
    last = F.try_element_at(F.filter(F.split(cwd, r"[/\\]"), lambda x: x != ""), F.lit(-1))
    return F.when(F.coalesce(cwd, F.lit("")) == "", F.lit("(unknown project)")).otherwise(F.coalesce(last, cwd))


def seconds_between(earlier: Column, later: Column) -> Column:
    return F.floor((F.unix_millis(later) - F.unix_millis(earlier)) / 1000)


def how_long_ago(t: Column, now: Column) -> Column:
    s = seconds_between(t, now)
    whole = lambda x: F.floor(x).cast("string")
    return (
        F.when(s < 5, F.lit("now"))
        .when(s < 60, F.concat(whole(s), F.lit("s")))
        .when(s < 3600, F.concat(whole(s / 60), F.lit("m")))
        .when(s < 86400, F.concat(whole(s / 3600), F.lit("h")))
        .otherwise(F.concat(whole(s / 86400), F.lit("d")))
    )


def is_live(last_seen: Column, now: Column, seconds: int = 10) -> Column:
    return F.unix_millis(now) - F.unix_millis(last_seen) < seconds * 1000


def fixed(x: Column, places: int) -> Column:
    """With that many decimal places. The exact binary value is rounded, ties to even, as C, Rust and SQL's printf do; format_string() rounds its shortest decimal form, halves up."""
    return F.call_function("format_number", x.cast("double"), F.lit(f"0.{'0' * places}"))


def format_cost(cost: Column) -> Column:
    return F.concat(F.lit("$"), fixed(cost, 4))


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def format_latency(ms: Column) -> Column:
    return (
        F.when(ms.isNull(), F.lit(""))
        .when(ms < 1000, F.format_string("%dms", ms.cast("long")))
        .when(ms < 60000, F.concat(fixed(ms / 1000, 1), F.lit("s")))
        .otherwise(F.format_string("%dm %ds", F.floor(ms / 60000), F.round((ms % 60000) / 1000).cast("long")))
    )
