"""Name-based ids from built-in hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def label_uuid(label: Column | str) -> Column:
    """UUID version 5 of a label in the all-zero namespace (RFC 4122)."""
    digest = F.sha1(F.concat(F.unhex(F.lit("00" * 16)), F.encode(col(label), "UTF-8")))
    variant = F.lower(F.conv(F.lit(8) + F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4, 10, 16))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
