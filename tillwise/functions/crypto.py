"""Keyed hashes, encryption and pseudonyms as Spark expressions."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex; the key is padded on the driver."""
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    digest = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def canonical_json(columns: list[str]) -> Column:
    """JSON with sorted field names, nulls written out."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def deterministic_key(master: bytes, context: dict | None = None) -> bytes:
    """32 characters derived from the master key and the context."""
    text = "deterministic:" + json.dumps(context or {}, sort_keys=True)
    return hmac.new(master, text.encode(), hashlib.sha256).hexdigest()[:32].encode()


def encrypt_deterministic(value: Column, master: bytes, context: dict | None = None) -> Column:
    key = F.lit(bytearray(deterministic_key(master, context)))
    return F.base64(F.aes_encrypt(value.cast("string"), key, F.lit("ECB"), F.lit("PKCS")))


def decrypt_deterministic(value: Column, master: bytes, context: dict | None = None) -> Column:
    key = F.lit(bytearray(deterministic_key(master, context)))
    return F.try_aes_decrypt(F.unbase64(value), key, F.lit("ECB"), F.lit("PKCS")).cast("string")


ALGORITHM = "AES256_GCM"


def encrypt_random(value: Column, key: bytes, key_id: str, version: int = 1) -> Column:
    """Authenticated encryption in an envelope; null stays null."""
    cipher = F.base64(F.aes_encrypt(value.cast("string"), F.lit(bytearray(key)), F.lit("GCM")))
    envelope = F.struct(
        cipher.alias("ciphertext"), F.lit(key_id).alias("key_id"), F.lit(ALGORITHM).alias("algorithm"), F.lit(version).alias("version")
    )
    return F.when(value.isNotNull(), envelope)


def decrypt_random(envelope: Column, keys: dict[tuple[str, int], bytes]) -> Column:
    """Decrypt by key id and version; unknown keys give null."""
    out = F.lit(None).cast("string")
    for (key_id, version), key in keys.items():
        plain = F.try_aes_decrypt(F.unbase64(envelope["ciphertext"]), F.lit(bytearray(key)), F.lit("GCM")).cast("string")
        out = F.when((envelope["key_id"] == key_id) & (envelope["version"] == version), plain).otherwise(out)
    return out


def encrypt_columns(df, config: dict[str, dict], keys: dict[str, bytes]):
    """``config``: column → key_id, deterministic, context."""
    new = {}
    for name, c in config.items():
        key = keys[c["key_id"]]
        if c.get("deterministic"):
            new[name] = encrypt_deterministic(F.col(name), key, c.get("context"))
        else:
            new[name] = encrypt_random(F.col(name), key, c["key_id"])
    return df.withColumns(new)


# Names a pseudonym is made of.
FIRST_NAMES = ("John", "Jane", "Alex", "Sam", "Chris", "Morgan", "Taylor", "Jordan")
LAST_NAMES = ("Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis")


def pseudonym(value: Column, key: bytes, kind: str | None = None, context: str | None = None) -> Column:
    """Stable fake value of the same kind, keyed by kind, context and value."""
    h = hmac_sha256(key, F.concat(F.lit(f"{kind or 'default'}:{context or 'global'}:"), value.cast("string")))

    def pick(names, at):
        i = F.conv(F.substring(h, at, 2), 16, 10).cast("int") % len(names)
        return F.element_at(F.array(*[F.lit(n) for n in names]), i + 1)

    if kind == "email":
        return F.concat(F.lit("user_"), F.left(h, F.lit(8)), F.lit("@example.com"))
    if kind == "phone":
        return F.concat(F.lit("+1-555-"), F.substring(h, 4, 3), F.lit("-"), F.substring(h, 7, 4))
    if kind == "name":
        return F.concat_ws(" ", pick(FIRST_NAMES, 1), pick(LAST_NAMES, 3))
    if kind == "ssn":
        return F.concat(F.lit("123-45-"), F.substring(h, 5, 4))
    return F.concat(F.lit("PSEUDO_"), F.left(h, F.lit(12)))
