"""Expressions on text, categories and lists."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIAL = re.compile(r"([.^$*+?{}\[\]\\|()\-])")


def literal_pattern(text: str) -> str:
    """A regex that matches ``text`` itself, in Java's syntax."""
    return SPECIAL.sub(r"\\\1", text)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fold(text: Column) -> Column:
    """Form in which names are compared: trimmed, lower case, and one form of letters that have two small ones."""
    return F.replace(F.translate(F.lower(trimmed(text)), "\u03c2\u017f", "\u03c3s"), F.lit("\u00df"), F.lit("ss"))


def same_name(left: Column, right: Column) -> Column:
    return fold(left) == fold(right)


def normalise(value: Column, spellings: dict[str, str]) -> Column:
    """Replace known spellings; every other value stays as it is."""
    if not spellings:
        return value
    pairs = [F.lit(part) for pair in spellings.items() for part in pair]
    return F.coalesce(F.create_map(*pairs)[value], value)


def lenient_int(text: Column) -> Column:
    """A whole number, also one written as a decimal such as 3.0, or NULL for anything else."""
    plain, decimal = trimmed(text).try_cast("bigint"), trimmed(text).try_cast("double")
    whole = (decimal == F.floor(decimal)) & (F.abs(decimal) < 2.0**53)
    return F.coalesce(plain, F.when(whole, decimal.cast("bigint")))


def two_way(value: Column, match: str, then: str, otherwise: str) -> Column:
    """``then`` on an exact match, ``otherwise`` for all else and for NULL."""
    return F.when(value.eqNullSafe(F.lit(match)), then).otherwise(otherwise)


def binarise(value: Column, positive: list[str], negative: list[str]) -> Column:
    """1, 0, or NULL for a category in neither list."""
    return F.when(value.isin(positive), 1).when(value.isin(negative), 0)


def without_suffix(name: Column, suffixes: list[str]) -> Column:
    """The trimmed name less one trailing word of the list, in any case; a space must precede it."""
    alternatives = "|".join(literal_pattern(s) for s in suffixes)
    return F.regexp_replace(trimmed(name), rf"(?iU)\s+({alternatives})$", "")


def first_nonempty(*values: Column) -> Column:
    """First value that is neither NULL nor an empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def joined_list(values: Column, delimiter: str = "|", null: str = "None") -> Column:
    """One text from a list, every position kept."""
    return F.array_join(values, delimiter, null)


def before(text: Column, delimiter: str = ":") -> Column:
    return F.substring_index(text, delimiter, 1)


def classify_by_tokens(text: Column, lists: dict[str, list[str]], default: str) -> Column:
    """Code of the first list that has a token inside the text, in any case; else the default.

    NULL text counts as empty.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    chosen = None
    for code, tokens in lists.items():
        hit = lowered.rlike("|".join(literal_pattern(t) for t in tokens))
        chosen = F.when(hit, code) if chosen is None else chosen.when(hit, code)
    return F.lit(default) if chosen is None else chosen.otherwise(default)


def matches_search(query: str, columns: list[str]) -> Column:
    """Whether the trimmed query occurs in the joined columns, in any case; a blank one always does."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted))


def path_problem(path: Column) -> Column:
    """Why a relative path is unsafe, or NULL. Both slash kinds separate segments."""
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(posix.rlike("^[A-Za-z]:") , "drive")
        .when(F.startswith(posix, F.lit("/")), "absolute")
        .when(F.exists(F.split(posix, "/"), lambda part: part.isin("", ".", "..")), "segment")
    )


def canonical_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
