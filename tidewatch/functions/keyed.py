"""Keyed hashes as Column expressions: HMAC-SHA256 of RFC 2104, tokens from a secret, and the check of a signed call."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column, functions as F

#: Bytes of a block of the hash, seconds that a call may be old or early, bytes of a token.
BLOCK, REPLAY_SECONDS, TOKEN_BYTES = 64, 300, 24


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The digest of ``message`` (binary) under a key of the driver's: two hashes of padded text, compiled with the query."""
    padded = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in padded)) for x in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256))


def token(secret: bytes, user: Column, measure: Column) -> Column:
    """A token of a user and a measure (null: all), the same whenever it is asked: 24 bytes in base64 for urls."""
    said = F.concat(user.cast("string"), F.coalesce(F.concat(F.lit("\x1f"), measure), F.lit("")))
    mac = F.base64(F.substring(hmac_sha256(secret, F.encode(said, "UTF-8")), 1, TOKEN_BYTES))
    return F.translate(mac, "+/", "-_")


def recent(stamp: Column, now: Column) -> Column:
    """Whether a call's time stamp, seconds as text, is within the window around ``now``; what is no number isn't."""
    seconds = stamp.try_cast("double")
    return F.coalesce(~F.isnan(seconds) & (F.abs(F.unix_micros(now.cast("timestamp")) / 1_000_000 - seconds) <= REPLAY_SECONDS), F.lit(False))


def signed(id_: Column, stamp: Column, body: Column, header: Column, secret: str) -> Column:
    """Whether one of the signatures of a header (``v1,...`` parted by blanks) is that of the call under the secret (``whsec_...``)."""
    key = base64.b64decode(secret.removeprefix("whsec_"))
    expected = F.base64(hmac_sha256(key, F.encode(F.concat_ws(".", id_, stamp, body), "UTF-8")))
    given = F.transform(F.split(header, " "), lambda x: F.get(F.split(x, ","), F.lit(1)))
    whole = id_.isNotNull() & stamp.isNotNull() & body.isNotNull()
    return F.coalesce(whole & F.exists(given, lambda x: F.coalesce((x != "") & (x == expected), F.lit(False))), F.lit(False))


def accepted(id_: Column, stamp: Column, body: Column, header: Column, secret: str, now: Column) -> Column:
    """Whether a call is signed and not older or newer than the window."""
    return recent(stamp, now) & signed(id_, stamp, body, header, secret)
