"""Encryption of stored values: ciphertexts for values, keyed digests for look-ups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(secret: str, use: str) -> Column:
    """A 256-bit key of its own for each use of the secret."""
    if not secret:
        raise ValueError("a cipher needs a secret")
    return F.unhex(F.sha2(F.lit(f"{use}\u0000{secret}").cast("binary"), 256))


def encrypted(value: Column, secret: str, bound: Column | None = None) -> Column:
    """AES-256-GCM of ``value`` in base 64, with a nonce of its own each time; null stays null.

    ``bound``: what the ciphertext belongs to (a placeholder, say); it opens with nothing else.
    """
    return F.base64(F.aes_encrypt(value.cast("binary"), _key(secret, "value"), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.coalesce(bound.cast("binary"), F.lit(b"")) if bound is not None else F.lit(b"")))


def decrypted(stored: Column, secret: str, bound: Column | None = None) -> Column:
    """What ``encrypted`` was given, or null where the secret or what it is bound to is another one."""
    aad = F.coalesce(bound.cast("binary"), F.lit(b"")) if bound is not None else F.lit(b"")
    return F.try_aes_decrypt(F.unbase64(stored), _key(secret, "value"), F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")


def lookup(kind: Column, norm: Column, secret: str) -> Column:
    """Digest of a type and key that only the secret's holder can make, the same each time: joins go by it.

    SHA-256 in two keyed passes, as in HMAC.
    """
    inner = F.unhex(F.sha2(F.concat(_key(secret, "inner"), F.concat(kind, F.lit("\u0000"), norm).cast("binary")), 256))
    return F.sha2(F.concat(_key(secret, "outer"), inner), 256)
