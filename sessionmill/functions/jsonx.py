"""Type-strict access to VARIANT values.

Spark's own getters convert (5 to '5', true to 1); log fields count as absent unless they have the
expected JSON type. A JSON null is not a missing key: fallbacks between places use `at`, which is
SQL NULL only where the key is missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(value: Column, path: str) -> Column:
    """The value at a path; SQL NULL where it is missing, JSON null where it is null."""
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def str_at(value: Column, path: str) -> Column:
    """A JSON string, else NULL."""
    return F.when(kind(at(value, path)) == "STRING", F.try_variant_get(value, path, "string"))


def text_of(value: Column) -> Column:
    return str_at(value, "$")


def count_at(value: Column, path: str) -> Column:
    """A whole, non-negative JSON number, else 0."""
    number = F.try_variant_get(value, path, "bigint")
    return F.coalesce(F.when((kind(at(value, path)) == "BIGINT") & (number >= 0), number), F.lit(0).cast("long"))


def number_at(value: Column, path: str) -> Column:
    """Any JSON number as a double, else NULL."""
    return F.when(kind(at(value, path)).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(value, path, "double"))


def blocks(value: Column) -> Column:
    """The elements of a JSON array; none for anything else."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def is_kind(block: Column, name: str) -> Column:
    """A content block of this type."""
    return F.coalesce(str_at(block, "$.type") == name, F.lit(False))


def of_kind(items: Column, name: str) -> Column:
    return F.filter(items, lambda b: is_kind(b, name))


def strings_of(items: Column, path: str) -> Column:
    """The strings at a path of each element, without elements that have none."""
    return F.array_compact(F.transform(items, lambda b: str_at(b, path)))


#: Follows a line when it is parsed, to see where the line's value ends.
_MARK = '"<end of line>"'


def parsed_line(line: Column) -> Column:
    """The JSON value of a whole line, or NULL.

    The parser stops at the end of a value and allows trailing text. So the line is parsed as the
    first of two elements, the second a mark: a line that closes the array early, or holds more than
    one value, gives another array. A line that holds the mark itself is parsed in two other ways,
    as a member and as the only element, and must pass both.
    """
    marked = F.try_parse_json(F.concat(F.lit("["), line, F.lit(f",{_MARK}]")))
    only = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"e":'), line, F.lit("}")))
    plain = F.when(F.contains(line, F.lit(_MARK)), F.when(member.isNotNull(), only)).otherwise(marked)
    wanted = F.when(F.contains(line, F.lit(_MARK)), F.lit(1)).otherwise(F.lit(2))
    # Bound to a lambda's variable, so that the line is parsed once.
    return F.get(F.transform(F.array(F.try_variant_get(plain, "$", "array<variant>")), lambda a: F.when((F.size(a) == wanted) & ((wanted == 1) | (text_of(F.get(a, F.lit(1))) == _MARK[1:-1])), F.get(a, F.lit(0)))), F.lit(0))
