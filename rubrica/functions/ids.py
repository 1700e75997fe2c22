"""Content ids, row fingerprints, stable seeds and hash shards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def content_id(c: Column, prefix: str = "", digits: int = 12) -> Column:
    """``prefix`` and the first hex digits of the text's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, digits))


def row_fingerprint(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted keys; nulls stay in it."""
    row = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def hash_integer(c: Column) -> Column:
    """The first four digest bytes of the text's SHA-256, masked to 31 bits."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(2147483647))


def stable_seed(*parts: Column) -> Column:
    return hash_integer(F.concat_ws("|", *(p.cast("string") for p in parts)))


def shard_of(c: Column, shards: int) -> Column:
    """The whole SHA-256 digest modulo ``shards``, folded eight hex digits at a time."""
    def of(digest: Column) -> Column:
        part = lambda i: F.conv(F.substr(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint")
        step = lambda rest, i: F.pmod(rest * F.lit(4294967296 % shards) + part(i), F.lit(shards))
        return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("bigint"), step)

    return let(F.sha2(c, 256), of)
