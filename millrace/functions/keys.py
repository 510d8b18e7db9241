"""Identifiers, hash ranks and names that do not clash."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, the separators of ASCII and the
#: byte-order mark included.
SPACE_POINTS = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
SPACE = "".join(map(chr, SPACE_POINTS))


def id_key(value: Column) -> Column:
    """An identifier as it compares: without surrounding white space, in lower
    case; blank and null give null."""
    key = F.lower(F.btrim(value.cast("string"), F.lit(SPACE)))
    return F.when(key != "", key)


def fresh(taken: Iterable[str], name: str) -> str:
    """name, or name_1, name_2 ... if a column is already called so (column
    names compare without case)."""
    low = {x.lower() for x in taken}
    new, n = name, 0
    while new.lower() in low:
        n += 1
        new = f"{name}_{n}"
    return new


def salted_digest(salt: str, *values: Column) -> Column:
    """Hex SHA-256 of salt:value[:value...]; nulls count as empty."""
    parts = [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    return F.sha2(F.concat_ws(":", F.lit(salt), *parts), 256)


def digest_uniform(digest: Column, digits: int = 12) -> Column:
    """A hex digest as a number in [0, 1); 12 digits are exact in a double."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("double") / F.lit(float(16**digits))
