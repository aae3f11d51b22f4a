"""The routing hash of devices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUPS = 256
# FNV-1a of 32 bits.
OFFSET_BASIS, PRIME = 2166136261, 16777619


def fnv1a32(text: Column) -> Column:
    """FNV-1a of a string's UTF-8 bytes, as a long."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(OFFSET_BASIS).cast("long"), lambda acc, b: (acc.bitwiseXOR(b) * PRIME).bitwiseAND(F.lit(0xFFFFFFFF)))


def group_id(database: str, collection: str, device: Column, groups: int = GROUPS) -> Column:
    """The group that holds a device of a collection."""
    return (fnv1a32(F.concat_ws(":", F.lit(database), F.lit(collection), device)) % groups).cast("int")
