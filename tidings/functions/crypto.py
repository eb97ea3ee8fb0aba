"""HMAC-SHA256 as plain Spark expressions (sha2 + unhex + concat).

The secret is a job parameter.  Its inner and outer pads are computed once on
the driver (64 bytes each) and enter the plan as binary literals, so the
per-row work is two ``sha2`` calls inside whole-stage codegen.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64  # SHA-256 block size in bytes


def hmac_pads(secret: str | bytes) -> tuple[str, str]:
    if secret is None or secret == "" or secret == b"":
        raise ValueError("a non-empty secret is required")
    key = secret.encode("utf-8") if isinstance(secret, str) else bytes(secret)
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\x00")
    ipad = bytes(b ^ 0x36 for b in key)
    opad = bytes(b ^ 0x5C for b in key)
    return ipad.hex(), opad.hex()


def hmac_sha256_base64(body, secret: str | bytes) -> Column:
    """Standard base64 text of HMAC-SHA256(secret, body) for a binary column."""
    body = F.col(body) if isinstance(body, str) else body
    ipad, opad = hmac_pads(secret)
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(ipad)), body), 256))
    outer = F.sha2(F.concat(F.unhex(F.lit(opad)), inner), 256)
    return F.base64(F.unhex(outer))
