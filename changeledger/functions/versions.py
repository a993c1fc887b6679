"""Version numbers as columns.

``version_key`` turns a raw version into a string whose plain order is the
version order and whose equality is version equality, so joins, ``max`` and
parquet statistics work on it directly.  Store it with the data (``vsort``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from changeledger.schema import INVALID_VERSION, LedgerError

# Fixed value: what a version may look like.
VERSION_PATTERN = r"\d[A-Za-z0-9]*(?:[._-][A-Za-z0-9]+)*"

SEP = "\u0001"
# Key of the number 0: a length of one digit, which is 0, and no digits.
ZERO = "010"


def is_valid_version(version: Column) -> Column:
    return F.coalesce(version.rlike(rf"^{VERSION_PATTERN}\z"), F.lit(False))


def version_key(version: Column) -> Column:
    """Sortable form of a version; NULL for a missing or invalid one.

    Numbers become ``0`` + length of the length + length + digits, so that any
    number of digits sorts by value; words become ``1`` + lower case and come after
    numbers.  Trailing zero
    numbers are cut, since 1.2 and 1.2.0 are one version.
    """
    def token(t: Column) -> Column:
        digits = F.ltrim(t, F.lit("0"))
        length = F.length(digits).cast("string")
        number = F.concat(F.lit("0"), F.length(length).cast("string"), length, digits)
        return F.when(t < ":", number).otherwise(F.concat(F.lit("1"), t))

    tokens = F.regexp_extract_all(F.lower(version), F.lit("[0-9]+|[a-z]+"), F.lit(0))
    joined = F.array_join(F.transform(tokens, token), SEP)
    trimmed = F.regexp_replace(joined, rf"(?:{SEP}{ZERO})+\z", "")
    return F.when(is_valid_version(version),
                  F.when(version.endswith("0"), trimmed).otherwise(joined))


def version_key_of(version: str) -> str:
    """``version_key`` of a literal, for predicates built on the driver."""
    if version is None or not re.fullmatch(VERSION_PATTERN, version, re.ASCII):
        raise LedgerError(INVALID_VERSION, f"not a version: {version!r}")
    parts = []
    for token in re.findall("[0-9]+|[a-z]+", version.lower()):
        digits = token.lstrip("0")
        length = str(len(digits))
        parts.append(f"0{len(length)}{length}{digits}" if token[0].isdigit() else f"1{token}")
    while len(parts) > 1 and parts[-1] == ZERO:
        parts.pop()
    return SEP.join(parts)


def in_family(vsort: Column, family: Column | str) -> Column:
    """True for the family version itself and for everything below it."""
    root = F.lit(family) if isinstance(family, str) else family
    return (vsort == root) | vsort.startswith(F.concat(root, F.lit(SEP)))
