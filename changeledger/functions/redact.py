"""Masking of credentials in text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as a credential, and the mask.
PASSWORD_SETTING = r"(?i)(password[=:]\s*)[^\s]+"
URL_CREDENTIAL = r"(?i)(//[^/:@\s]+:)[^@\s]+@"
MASK = "****"


def redact(text: Column, secret: str | None = None) -> Column:
    masked = F.regexp_replace(text, PASSWORD_SETTING, f"$1{MASK}")
    masked = F.regexp_replace(masked, URL_CREDENTIAL, f"$1{MASK}@")
    if secret:
        masked = F.replace(masked, F.lit(secret), F.lit(MASK))
    return masked
