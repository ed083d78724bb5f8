"""Stable keys: sample hash, account folds, derived ids, identifier formats and their bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier formats.
TOKEN = r"^tok_[A-Za-z0-9]{24,64}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
MCC = r"^[0-9]{4}$"
COUNTRY = r"^[A-Z]{2}$"

# The polynomial account hash.
_BASE, _MODULUS = 131, 2_147_483_647


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a string as integers."""
    digits = F.hex(F.encode(text, "UTF-8"))
    return F.transform(
        F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)),
        lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"),
    )


def fold_of(account: Column, folds: int) -> Column:
    """Deterministic fold of an account token, the same in every process and row order."""
    text = account.cast("string")
    digest = F.aggregate(
        text_bytes(text),
        F.lit(0).cast("long"),
        lambda acc, b: (acc * F.lit(_BASE) + b) % F.lit(_MODULUS),
    )
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(digest % folds).cast("int")


def sampled(key: Column, seed: int, per_mille: int) -> Column:
    """Whether a row is in the keyed sample: a property of its id, not of where it lies.

    The first 32 bits of an MD5 decide, which other engines compute alike.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1000 < per_mille


def derived_id(*parts: Column) -> Column:
    """A UUID-shaped id that repeats exactly for the same parts."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.substring(digest, 13, 4),
        F.substring(digest, 17, 4),
        F.substring(digest, 21, 12),
    )


def uuid_bytes(uuid: Column) -> Column:
    """The sixteen bytes of a UUID, as an array of numbers."""
    digits = F.regexp_replace(uuid, "-", "")
    return F.transform(
        F.sequence(F.lit(1), F.lit(31), F.lit(2)),
        lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int"),
    )


def token_codes(token: Column) -> Column:
    """Character codes of a token's body, after its four-character prefix."""
    body = F.substring(token, F.lit(5), F.greatest(F.length(token) - 4, F.lit(0)))
    return F.transform(F.filter(F.split(body, ""), lambda c: c != ""), F.ascii)
