"""Script checksum that does not depend on line endings or a byte order mark."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normalized_bytes(content: Column) -> Column:
    """``content`` without a UTF-8 BOM and with every line end as LF.

    ISO-8859-1 maps each byte to one character, which lets regular expressions
    work on the bytes of any encoding.
    """
    chars = F.decode(content, "ISO-8859-1")
    no_bom = F.regexp_replace(chars, "^\u00ef\u00bb\u00bf", "")
    return F.encode(F.regexp_replace(no_bom, "\r\n?", "\n"), "ISO-8859-1")


def script_checksum(content: Column) -> Column:
    """CRC-32 of the normalized bytes as a signed INT."""
    crc = F.crc32(normalized_bytes(content))
    return F.when(crc >= 2 ** 31, crc - 2 ** 32).otherwise(crc).cast("int")
