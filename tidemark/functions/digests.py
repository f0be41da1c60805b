"""Keyed digests as Column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a message's UTF-8 bytes in lower-case hex; null for a null message."""
    padded = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in padded)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def identity_matches(person: Column, signature: Column, key: bytes) -> Column:
    """Whether a person's signature was made with the key; a missing one was not."""
    return F.coalesce(hmac_sha256(person, key) == F.lower(signature), F.lit(False))
