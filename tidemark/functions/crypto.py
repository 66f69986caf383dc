"""Passwords, keys and envelopes. Key derivation needs Python; it runs on Arrow batches. Encryption stays in the JVM."""

from __future__ import annotations

import hashlib
import hmac
import secrets

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..limits import LIMITS

#: The layout of an envelope.
SALT, IV, KEY = 16, 12, 32
#: Cost of the password hash.
N, R, P, LENGTH = 16384, 8, 1, 64


def _scrypt(password: str, salt: str) -> str:
    return hashlib.scrypt(password.encode(), salt=salt.encode(), n=N, r=R, p=P, dklen=LENGTH, maxmem=64 << 20).hex()


@F.pandas_udf(T.StringType())
def hash_password(password: pd.Series, salt_hex: pd.Series) -> pd.Series:
    """``salt:key``; the salt goes in as its hexadecimal text."""
    return pd.Series([None if p is None or s is None else f"{s}:{_scrypt(p, s)}" for p, s in zip(password, salt_hex, strict=True)])


@F.pandas_udf(T.BooleanType())
def verify_password(password: pd.Series, stored: pd.Series) -> pd.Series:
    """False for anything that isn't ``salt:key``; compares in constant time."""

    def one(p, s) -> bool:
        salt, found, key = (s or "").partition(":")
        if not p or not found or not key:
            return False
        return hmac.compare_digest(_scrypt(p, salt), key)

    return pd.Series([one(p, s) for p, s in zip(password, stored, strict=True)])


@F.pandas_udf(T.StringType())
def random_token(rows: pd.Series) -> pd.Series:
    return pd.Series([secrets.token_hex(16) for _ in rows])


@F.pandas_udf(T.StringType())
def random_code(rows: pd.Series) -> pd.Series:
    return pd.Series([f"{secrets.randbelow(1_000_000):06d}" for _ in rows])


def derive_key(password: Column, salt: Column, rounds: int = LIMITS.pbkdf2_rounds) -> Column:
    @F.pandas_udf(T.BinaryType())
    def derived(p: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else hashlib.pbkdf2_hmac("sha256", a.encode(), b, rounds, KEY) for a, b in zip(p, s, strict=True)])

    return derived(password, salt)


def seal(data: Column, key: Column, salt: Column, iv: Column) -> Column:
    """salt, iv, ciphertext and tag, one after the other."""
    return F.concat(salt, F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), iv))


def open_(envelope: Column, key: Column) -> Column:
    """The plain bytes; null if the key is wrong or the envelope was changed."""
    return F.try_aes_decrypt(F.substring(envelope, SALT + 1, F.octet_length(envelope)), key, F.lit("GCM"))


def parts(envelope: Column) -> Column:
    return F.struct(F.substring(envelope, 1, SALT).alias("salt"), F.substring(envelope, SALT + 1, IV).alias("iv"), F.substring(envelope, SALT + IV + 1, F.octet_length(envelope)).alias("ciphertext"))


@F.pandas_udf(T.StringType())
def decode_lenient(data: pd.Series) -> pd.Series:
    """UTF-8 with the replacement character for what isn't."""
    return pd.Series([None if b is None else bytes(b).decode("utf-8", "replace") for b in data])
