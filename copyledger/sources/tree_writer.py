"""Materialise the ``documents`` table as a real directory tree (one file per
document, in the fixture layout) so the directory source and the sampled
reader run against files.

Executors write their own rows (``mapInPandas``), idempotently: a retried
task rewrites the same paths with the same bytes.  Documents marked as links
become symbolic links to a copy kept outside the scanned root.  The tree
lives under the shared checkpoint folder, which must be a mounted file
system visible to every executor.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from copyledger.session import scratch_path
from copyledger.sources import fixture as FX
from copyledger.session import pickle_by_value

pickle_by_value(__name__)


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def _write_batches(targets_dir: str):
    def fn(batches):
        for pdf in batches:
            written = []
            for path, text, link, doc_id in zip(pdf["path"], pdf["text"], pdf["is_link"], pdf["doc_id"]):
                data = text.encode("utf-8")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                if link:
                    target = os.path.join(targets_dir, f"{doc_id}.bin")
                    os.makedirs(targets_dir, exist_ok=True)
                    with open(target, "wb") as fh:
                        fh.write(data)
                    if os.path.lexists(path):
                        os.remove(path)
                    os.symlink(target, path)
                else:
                    with open(path, "wb") as fh:
                        fh.write(data)
                written.append(len(data))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("int64"),
                                "bytes": pd.Series(written, dtype="int64")})
    return fn


def new_tree(spark: SparkSession) -> str:
    """The scan root of a tree still to be written."""
    return _local(scratch_path(spark, "tree")) + "/root"


def write_document_tree(spark: SparkSession, sf_dir: str, root: str | None = None,
                        only: Column | None = None) -> str:
    """Write the tree (or the documents ``only`` holds for) and return its scan root."""
    root = root or new_tree(spark)
    base = os.path.dirname(root)
    docs = FX.documents(spark, sf_dir)
    docs = (docs if only is None else docs.filter(only)).select(
        "doc_id", "text", FX.fixture_path(root).alias("path"),
        (F.col("doc_id") % FX.LINK_EVERY == 0).alias("is_link"))
    out = docs.mapInPandas(_write_batches(f"{base}/link_targets"), "doc_id long, bytes long")
    out.write.format("noop").mode("overwrite").save()
    return root
