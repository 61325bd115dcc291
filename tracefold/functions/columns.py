"""Small column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """value in [low, high]; null stays null, which greatest and least alone would not keep."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def freshness(now: Column, then: Column, fresh_us: int) -> Column:
    """1 for a value of now or later, falling to 0 at fresh_us of age; null without a value."""
    return F.when(then.isNotNull(), F.greatest(F.lit(0.0), 1.0 - F.greatest(now - then, F.lit(0)) / float(fresh_us)))  # never over 1 nor null


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a string column, from the two pads of the key and native SHA-256."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def pseudonym(key: bytes, identifier: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix + ":"), hmac_sha256(key, identifier))


def hashed_id(identifier: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.sha2(identifier, 256))


def whole_number(variant: str, path: str) -> Column:
    """An integer at path of a variant column; fractions and other types are null."""
    return F.expr(f"CASE WHEN schema_of_variant(try_variant_get({variant}, '{path}', 'variant')) = 'BIGINT' THEN try_variant_get({variant}, '{path}', 'bigint') END")
