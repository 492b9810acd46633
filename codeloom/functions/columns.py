"""Column expressions that several operators share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: an expression inside a lambda is else computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_fold(text: Column | str) -> Column:
    """Lower case of ASCII letters only: what the trigram index sees, at build and at query time alike."""
    return F.translate(col(text), UPPER, LOWER)


def trigrams(content: Column | str) -> Column:
    """Distinct 3-byte grams of the folded text as six hexadecimal digits each; none for fewer than three bytes."""
    def grams(data: Column) -> Column:
        n = F.octet_length(data) - 2
        found = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.hex(F.substring(data, i, F.lit(3))))
        return F.when(n >= 1, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    return let(F.encode(ascii_fold(content), "UTF-8"), grams)  # of bytes: a substring of text would be sought from its start


def smart_contains(content: Column | str, pattern: str) -> Column:
    """Literal match: as it is if the pattern has an ASCII capital, else without regard to ASCII case, as the trigram index folds."""
    if any(c in UPPER for c in pattern):
        return F.contains(col(content), F.lit(pattern))
    return F.contains(ascii_fold(content), F.lit(pattern))


def whole_word(name: str) -> str:
    r"""A pattern of the name between characters that are no ASCII word characters; `\b` would see letters of all scripts."""
    return rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])"


def name_hash(name: Column | str) -> Column:
    """64 bits of a name without its case, in hexadecimal digits: the key of name postings."""
    return F.substring(F.sha2(F.encode(F.lower(col(name)), "UTF-8"), 256), 1, 16)


def tokens(n: Column) -> Column:
    """Token estimate of n characters: a quarter, rounded up."""
    return F.floor((n + 3) / 4).cast("long")


def path_cost(path: Column | str) -> Column:
    """What a listed path costs of a token budget."""
    return F.greatest(F.lit(1), tokens(F.length(col(path)))) + 1


def truncate(x: Column) -> Column:
    """A number without its fraction, towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def dirname(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"/?[^/]*$", "")


def extension(path: Column | str) -> Column:
    """The extension with its dot in lower case, or nothing."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def common_parts(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b)).cast("long"))


def path_distance(a: Column | str, b: Column | str) -> Column:
    """Segments of two paths that they don't share from the root."""
    x, y = F.split(col(a), "/"), F.split(col(b), "/")
    return (F.size(x) + F.size(y) - 2 * common_parts(x, y)).cast("long")
