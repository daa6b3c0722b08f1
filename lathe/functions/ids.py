"""Stable ids and fingerprints, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _framed(c: Column) -> Column:
    """A part with its length in bytes before it, so that parts never run together."""
    raw = F.encode(c, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw)


def stable_id(namespace: str, *parts: Column | str, prefix: str = "") -> Column:
    """Prefix and 128 bits of the SHA-256 over the framed namespace and parts; null if a part is null."""
    cols = [F.lit(namespace), *[F.col(p) if isinstance(p, str) else p for p in parts]]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(*[_framed(c) for c in cols]), 256), 1, 32))


def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 over names, presence and values in the order given; absent and empty differ."""
    parts = []
    for name, c in fields.items():
        text = c.cast("string")
        parts += [_framed(F.lit(name)), F.when(text.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), _framed(text)))]
    return F.sha2(F.concat(*parts), 256)


def sample_key(seed: int, key: Column | str) -> Column:
    """Order key of a seeded, repeatable shuffle."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")), 256)
