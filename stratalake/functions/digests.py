"""Hashes of values and of whole rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from stratalake.functions.scalars import is_blank

NULL_MARK = "nan"
DIGEST_BYTES = 16


def sha256(column: Column) -> Column:
    """64 hex characters; null and blank values pass unchanged."""
    return F.when(is_blank(column), column).otherwise(F.sha2(column, 256))


def row_hash(names: Sequence[str]) -> Column:
    """First 16 hex characters of the SHA-256 over the row's values, joined by ``|``."""
    values = [F.coalesce(F.col(n).cast("string"), F.lit(NULL_MARK)) for n in names]
    return F.substring(F.sha2(F.concat_ws("|", *values), 256), 1, 16)


def row_text(names: Sequence[str]) -> Column:
    """Text that is equal only for rows equal in every column, nulls included.

    Every value is written with its length in front, so that no two different rows give the
    same text.
    """
    parts = []
    for name in names:
        text = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.concat(*parts)


def short_key(text: Column) -> Column:
    """Stand-in for a text in distinct counts: a text shorter than a digest itself, else its digest."""
    return F.when(F.octet_length(text) < DIGEST_BYTES, text.cast("binary")).otherwise(digest(text))


def digest(text: Column) -> Column:
    """The first 128 bits of the SHA-256: among 10^12 texts two are taken for one with a chance of 1 in 10^15."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 2 * DIGEST_BYTES))
