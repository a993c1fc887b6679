"""CRC-32 in SQL, for engines without such a function: a table by rule and a fold over bytes."""

from __future__ import annotations

# Eight steps of the division by the reversed polynomial make a table entry.
_STEP = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"

#: Common table expression crc_table(t): the 256 entries as one list.
CRC_TABLE = f"""crc_table AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(
    list_prepend(n::BIGINT, list_transform(range(0, 8), lambda i: i::BIGINT)), lambda x, i: {_STEP})) AS t)"""


def crc32(hexadecimal: str) -> str:
    """CRC-32 (unsigned) of the bytes of a hexadecimal text, with crc_table among the tables of the query."""
    bytes_ = f"list_transform(regexp_extract_all({hexadecimal}, '..'), lambda h: ('0x' || h)::BIGINT)"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), "
            f"lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])))")
