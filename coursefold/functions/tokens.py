"""Keyed hashes and signed tokens, all of built-in expressions.

HMAC-SHA256 of a message is the hash of the outer key and the hash of the inner key and the message; keys are literals.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F


def purpose_key(secret: bytes, purpose: str) -> bytes:
    """HKDF-SHA256 of ``secret`` with no salt, for one purpose."""
    inner = hmac.new(bytes(32), secret, hashlib.sha256).digest()
    return hmac.new(inner, purpose.encode() + b"\x01", hashlib.sha256).digest()


def _signature(key: bytes, *parts: Column) -> Column:
    """HMAC-SHA256 of the parts, one a line, as 32 bytes."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    message = F.concat_ws("\n", *parts) if len(parts) > 1 else parts[0]
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256))


def url64(data: Column) -> Column:
    """Base64url without padding."""
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))


def from_url64(text: Column) -> Column:
    """What ``url64`` made of bytes; null for a text that it makes of none. The last character counts with all of its bits."""
    shaped = text.rlike(r"\A[A-Za-z0-9_-]*\z") & (F.length(text) % 4 != 1)
    data = F.try_to_binary(F.rpad(F.translate(text, "-_", "+/"), (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))
    return F.when(shaped & (url64(data) == text), data)


def keyed_hash(value: Column, secret: bytes, purpose: str = "uid") -> Column:
    return F.lower(F.hex(_signature(purpose_key(secret, purpose), value)))


def seal(payload: Column, binding: Column, secret: bytes, purpose: str) -> Column:
    """``payload`` (JSON) and its signature, which also covers ``binding``. Null if either is."""
    body = url64(payload.cast("binary"))
    sealed = F.concat_ws(".", body, url64(_signature(purpose_key(secret, purpose), body, binding)))
    return F.when(payload.isNotNull() & binding.isNotNull(), sealed)


def open_sealed(token: Column, binding: Column, secret: bytes, purpose: str) -> Column:
    """The payload, or null if the token is malformed or not signed for this purpose and binding.

    Signatures are compared by their hashes, so that how soon a comparison ends says nothing about them.
    """
    parts = F.split(token, r"\.")
    body, given = F.get(parts, 0), F.get(parts, 1)
    made = url64(_signature(purpose_key(secret, purpose), body, binding))
    same = (F.size(parts) == 2) & (F.sha2(given, 256) == F.sha2(made, 256)) & binding.isNotNull()
    data = from_url64(body)
    return F.when(same & F.is_valid_utf8(data.cast("string")), data.cast("string"))


def proven(opened: Column, own: Column, operation: Column, target: Column, now: Column) -> Column:
    """Whether an opened proof (JSON, or null) is this user's for this operation and target, and ends later than now."""
    t = F.from_json(opened, "uidHash string, operation string, target string, expiresAt timestamp")
    same = (t["uidHash"] == own) & (t["operation"] == operation) & (t["target"] == target) & (t["expiresAt"] > now)
    return F.coalesce(same, F.lit(False))


def verdict(opened: Column, uid: Column, own: Column, expires: Column, now: Column) -> Column:
    """Wrong (bad signature or another user) comes before expired; a token ends at its expiry."""
    return F.when(opened.isNull() | (uid != own), "wrong").when(expires <= now, "expired").otherwise("ok")
