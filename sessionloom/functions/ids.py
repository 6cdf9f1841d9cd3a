"""Deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of ids that are made here: 16 octets.
NAMESPACE = b"sessionloom-uuid"


def uuid5(name: Column, namespace: bytes = NAMESPACE) -> Column:
    """The UUID of version 5 of a name, in Spark's own functions: a SHA-1 with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex())), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
