"""HMAC as Catalyst expressions (Spark has no ``hmac`` built-in).

HMAC(K, m) = H((K' xor opad) || H((K' xor ipad) || m)), with K' the key
padded (or first hashed) to the hash block size.  The pads depend only on
the secret, so they are computed once on the driver and enter the plan as
binary literals; the hashing itself runs inside whole-stage codegen.
Use test secrets only in plans you print: literals appear in ``explain()``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = {256: 64, 512: 128}


def _pads(secret: str, bits: int) -> tuple[bytes, bytes]:
    block = _BLOCK[bits]
    key = secret.encode()
    if len(key) > block:
        key = hashlib.new(f"sha{bits}", key).digest()
    key = key.ljust(block, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_hex(secret: str, message: Column, bits: int = 256) -> Column:
    """Lower-case hex HMAC-SHA``bits`` of the UTF-8 bytes of ``message``."""
    ipad, opad = _pads(secret, bits)
    inner = F.unhex(F.sha2(F.concat(F.lit(ipad), message.cast("binary")), bits))
    return F.sha2(F.concat(F.lit(opad), inner), bits)


def hmac_base64(secret: str, message: Column, bits: int = 256) -> Column:
    return F.base64(F.unhex(hmac_hex(secret, message, bits)))
