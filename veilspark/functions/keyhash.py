"""Hashes of privacy-unit keys and of queries; both are 64 bits, kept in a signed long."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WORLDS = 64
# Fixed value: the odd multiplier of the query hash.
MAGIC = 2983746509182734091
_MASK = (1 << 64) - 1


def signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


@dataclass(frozen=True)
class Settings:
    """mi: bound of the mutual information that one query may give away; 0 releases one world without noise."""

    mi: float = 1 / 128
    seed: int | None = None
    query_number: int = 1

    def seed_used(self) -> int:
        s = 42 if self.seed is None else self.seed
        return (s ^ (MAGIC * self.query_number)) & _MASK if self.mi else s & _MASK

    @property
    def query_hash(self) -> int:
        """The query hash as an unsigned number."""
        return ((self.seed_used() * MAGIC) ^ MAGIC) & _MASK


def _md5_long(text: Column) -> Column:
    """The first 64 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")


def key_hash(*keys: Column) -> Column:
    """The first 64 bits of the MD5 of the key's string form; null if any part is null.

    Parts of a composite key carry their lengths, so that different keys have different forms.
    """
    parts = [k.cast("string") for k in keys]
    return _md5_long(parts[0] if len(parts) == 1 else F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]))


def fast_key_hash(*keys: Column) -> Column:
    """A faster hash that other engines don't have; null if any part is null."""
    return F.when(F.greatest(F.lit(0), *[k.isNull().cast("int") for k in keys]) == 0, F.xxhash64(*keys))


def mixed_units(*hashes: Column, conjunctive: bool = False) -> Column:
    """One hash for several units: XOR, with all but the first hashed again, keeps each world at probability one half; AND is the narrower alternative."""
    out = hashes[0]
    for h in hashes[1:]:
        out = out.bitwiseAND(h) if conjunctive else out.bitwiseXOR(_md5_long(h.cast("string")))
    return out


def in_query(kh: Column, settings: Settings) -> Column:
    return kh.bitwiseXOR(F.lit(signed(settings.query_hash)))
