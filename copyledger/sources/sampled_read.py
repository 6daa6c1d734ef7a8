"""Fingerprints of files on storage (the read happens after the size gate, on
candidate rows only).

A fingerprint is made from a list of byte ranges in file order: the whole
file, or three ``HASH_CHUNK_SIZE`` slices of a file of
``HASH_MIN_SIZE_FOR_MULTI_CHUNK`` bytes or more.  ``mapInPandas`` over ``(id,
path)`` rows opens each file once and reads its ranges; a task keeps up to
``READERS`` files open at a time, so the round trips of an object store
overlap while memory stays at one block per reader.  Local paths use ``open``;
URIs go through ``pyarrow.fs``.  Failures give a NULL hash and the error text.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame

from copyledger import constants as C
from copyledger.session import pickle_by_value

pickle_by_value(__name__)

OUT_SCHEMA = "id long, path string, file_hash string, hash_error string"
READERS = 16              # files a task reads at a time
BLOCK = 1 << 20           # bytes a reader holds


def _open(path: str):
    if "://" in path:
        import pyarrow.fs as pafs

        fs, p = pafs.FileSystem.from_uri(path)
        return fs.open_input_file(p)
    return open(path, "rb")


def byte_ranges(size: int, verify: str = "sampled") -> list[tuple[int, int]]:
    """(offset, length) of the bytes that a fingerprint covers, in file order."""
    if verify == "full" or size < C.HASH_MIN_SIZE_FOR_MULTI_CHUNK:
        return [(0, size)]
    half, k = size // 2, C.HASH_CHUNK_SIZE
    return [(start, k) for start in (0, half - k // 2, size - k)]


def _range_digest(source, offset: int, length: int) -> str:
    """MD5 of one range, read in blocks; a file cut short meanwhile is an error."""
    digest = hashlib.md5()
    source.seek(offset)
    while length > 0:
        block = source.read(min(length, BLOCK))
        if not block:
            raise OSError("file became shorter while it was read")
        digest.update(block)
        length -= len(block)
    return digest.hexdigest()


def fingerprint(path: str, verify: str = "sampled", opener=_open) -> str:
    """The digest of a file's only range, or of its ranges' digests joined."""
    with opener(path) as source:
        size = source.seek(0, 2)
        digests = [_range_digest(source, *r) for r in byte_ranges(size, verify)]
    return digests[0] if len(digests) == 1 else hashlib.md5("".join(digests).encode()).hexdigest()


def _hash_batches(verify: str, readers: int = READERS, opener=_open):
    def read_one(path):
        try:
            return fingerprint(path, verify, opener), None
        except OSError as e:
            return None, f"{type(e).__name__}: {e}"

    def fn(batches):
        with ThreadPoolExecutor(readers) as pool:
            for pdf in batches:
                found = list(pool.map(read_one, pdf["path"]))
                yield pd.DataFrame({"id": pdf["id"].astype("int64"), "path": pdf["path"],
                                    "file_hash": [h for h, _ in found], "hash_error": [e for _, e in found]})
    return fn


def read_fingerprints(candidates: DataFrame, verify: str = "sampled",
                      path_col: str = "original_path") -> DataFrame:
    """(id, path, file_hash, hash_error) for the candidate rows."""
    rows = candidates.select("id", candidates[path_col].alias("path"))
    return rows.mapInPandas(_hash_batches(verify), OUT_SCHEMA)


def storage_hasher(verify: str = "sampled"):
    """A ``hasher`` for the incremental scan: fingerprints read from storage."""
    def hasher(need: DataFrame) -> DataFrame:
        return read_fingerprints(need, verify).select("id", "file_hash")
    return hasher
