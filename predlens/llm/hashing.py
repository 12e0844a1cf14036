"""Uniform draws from keys, the same on every engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13  # of the digest that make the number: 52 bits, exact as a double
RANGE = 16**HEX_DIGITS


def ticket(*parts: Column) -> Column:
    """A number from 0 below ``RANGE``, from the parts as text; NULL counts as the text ``null``."""
    text = F.concat_ws(":", *[F.coalesce(part.cast("string"), F.lit("null")) for part in parts])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("long")


def sql_ticket(*parts: str) -> str:
    """The same number in the check SQL."""
    text = ", ".join(f"COALESCE(CAST({part} AS VARCHAR), 'null')" for part in parts)
    return f"CAST('0x' || SUBSTR(MD5(CONCAT_WS(':', {text})), 1, {HEX_DIGITS}) AS BIGINT)"
