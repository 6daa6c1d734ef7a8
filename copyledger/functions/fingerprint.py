"""Content fingerprints as native Column expressions over BINARY columns.

The sampled fingerprint reads at most ``HASH_MIN_SIZE_FOR_MULTI_CHUNK - 1``
bytes of any value: the whole value below the threshold, otherwise three
``HASH_CHUNK_SIZE`` slices (first, middle, last) whose hex digests are
concatenated and hashed again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from copyledger import constants as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_bytes(text) -> Column:
    """UTF-8 bytes of a string column (fingerprints work on bytes, not characters)."""
    return _col(text).cast("binary")


def byte_length(content) -> Column:
    return F.octet_length(_col(content)).cast("long")


def full_fingerprint(content) -> Column:
    return F.md5(_col(content))


def sampled_fingerprint(content) -> Column:
    b = _col(content)
    n = F.octet_length(b)
    chunk = F.lit(C.HASH_CHUNK_SIZE)
    first = F.md5(b.substr(F.lit(1), chunk))
    middle_start = (F.floor(n / 2) - (C.HASH_CHUNK_SIZE // 2) + 1).cast("int")
    middle = F.md5(b.substr(middle_start, chunk))
    last = F.md5(b.substr((n - C.HASH_CHUNK_SIZE + 1).cast("int"), chunk))
    combined = F.md5(F.concat(first, middle, last).cast("binary"))
    return F.when(n < C.HASH_MIN_SIZE_FOR_MULTI_CHUNK, F.md5(b)).otherwise(combined)


def fingerprint(content, verify: str = "sampled") -> Column:
    if verify == "full":
        return full_fingerprint(content)
    if verify == "sampled":
        return sampled_fingerprint(content)
    raise ValueError(f"unknown verify mode {verify!r}")
