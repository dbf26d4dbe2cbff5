"""Keyed digests as expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(body: Column, secret: bytes) -> Column:
    """The HMAC-SHA256 of the bytes of body in hexadecimal, by its definition: a digest of a padded key and an inner digest."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256)


def signed(body: Column, header: Column, secret: bytes) -> Column:
    """The header is ``sha256=`` and the digest of body. False without a secret or header."""
    if not secret:
        return F.lit(False)
    given = F.trim(F.substr(F.coalesce(header, F.lit("")), F.lit(8)))
    return F.coalesce(header.startswith("sha256=") & (given == hmac_sha256(body, secret)), F.lit(False))
