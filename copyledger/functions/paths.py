"""Path and name functions as native Column expressions.

All of these stay inside whole-stage codegen; none round-trips through
Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from copyledger import constants as C

_INT_MAX = 2147483647


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def relative_to(path, root: str) -> Column:
    """Path below ``root`` (no leading slash); NULL when outside the root."""
    path = _col(path)
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), path.substr(len(prefix) + 1, _INT_MAX))


def layout_parts(rel) -> Column:
    """Directory levels of a root-relative path."""
    return F.split(_col(rel), "/")


def layout_level(parts, level: int) -> Column:
    """Level ``level`` (0 = year, 1 = month, 2 = month_day, 3 = project)."""
    return F.get(_col(parts), level)


def basename(path) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def parent_dir(path) -> Column:
    path = _col(path)
    parent = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when((parent == "") & path.startswith("/"), F.lit("/")).otherwise(parent)


def suffix(name) -> Column:
    """Last suffix of a name: needs a non-empty stem and a non-empty tail."""
    return F.regexp_extract(_col(name), r"(?s)^.+(\.[^.]+)$", 1)


def is_video_name(name) -> Column:
    return F.lower(suffix(name)).isin(*C.VIDEO_EXTENSIONS)


def split_ext(name) -> tuple[Column, Column]:
    """(stem, ext) with leading dots belonging to the stem; a trailing dot is an ext."""
    name = _col(name)
    ext = F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)
    stem = name.substr(F.lit(1), F.length(name) - F.length(ext))
    return stem, ext


def sanitize_name(name) -> Column:
    """Replace unsafe characters by '_' and cap the length, keeping the extension."""
    cleaned = F.translate(_col(name), C.SANITIZE_CHARS, "_" * len(C.SANITIZE_CHARS))
    stem, ext = split_ext(cleaned)
    room = F.lit(C.SANITIZED_NAME_MAX) - F.length(ext)
    # Slicing stem[:room] with a negative room drops characters from the end.
    keep = F.when(room >= 0, room).otherwise(F.greatest(F.length(stem) + room, F.lit(0)))
    capped = F.concat(stem.substr(F.lit(1), keep), ext)
    return F.when(F.length(cleaned) > C.SANITIZED_NAME_MAX, capped).otherwise(cleaned)



def store_dir(store_root: str, file_hash) -> Column:
    """``{store}/files/{h[0:2]}/{h[2:4]}`` (``00/00`` without a hash)."""
    file_hash = _col(file_hash)
    no_hash = file_hash.isNull() | (file_hash == "")
    p1 = F.when(no_hash, F.lit(C.NO_HASH_PREFIX1)).otherwise(file_hash.substr(1, 2))
    p2 = F.when(no_hash, F.lit(C.NO_HASH_PREFIX2)).otherwise(file_hash.substr(3, 2))
    return F.concat_ws("/", F.lit(store_root.rstrip("/") + "/" + C.STORE_SUBDIR), p1, p2)



def relpath(target, start) -> Column:
    """``os.path.relpath(target, start)`` for absolute, normalised paths."""
    a = F.filter(F.split(_col(start), "/"), lambda x: x != "")
    b = F.filter(F.split(_col(target), "/"), lambda x: x != "")
    n = F.least(F.size(a), F.size(b))
    diffs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(a, i) == F.get(b, i))
    first_diff = F.array_position(diffs, False)
    k = F.when(n == 0, F.lit(0)).when(first_diff == 0, n).otherwise(first_diff - 1).cast("int")
    ups = F.array_repeat(F.lit(".."), (F.size(a) - k).cast("int"))
    downs = F.slice(b, k + 1, (F.size(b) - k).cast("int"))
    joined = F.concat_ws("/", F.concat(ups, downs))
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def dotdot_count(p) -> Column:
    """Non-overlapping count of '..' substrings."""
    p = _col(p)
    return ((F.length(p) - F.length(F.replace(p, F.lit(".."), F.lit("")))) / 2).cast("int")



# ---------------------------------------------------------------------------
# DataFrame-level forms: intermediate values become columns, so a value used
# several times is computed once (Catalyst does not re-inline a non-trivial
# expression that is referenced more than once) and generated code stays small.
# ---------------------------------------------------------------------------

def with_sanitized(df, name_col: str, out_col: str):
    df = df.withColumn("_sz_clean", F.translate(F.col(name_col), C.SANITIZE_CHARS,
                                                "_" * len(C.SANITIZE_CHARS)))
    df = df.withColumn("_sz_ext", F.regexp_extract("_sz_clean", r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))
    df = df.withColumn("_sz_stem", F.col("_sz_clean").substr(
        F.lit(1), F.length("_sz_clean") - F.length("_sz_ext")))
    room = F.lit(C.SANITIZED_NAME_MAX) - F.length("_sz_ext")
    keep = F.when(room >= 0, room).otherwise(F.greatest(F.length("_sz_stem") + room, F.lit(0)))
    capped = F.concat(F.col("_sz_stem").substr(F.lit(1), keep), F.col("_sz_ext"))
    df = df.withColumn(out_col, F.when(F.length("_sz_clean") > C.SANITIZED_NAME_MAX, capped)
                       .otherwise(F.col("_sz_clean")))
    return df.drop("_sz_clean", "_sz_ext", "_sz_stem")


def with_store_location(df, store_root: str, hash_col: str, name_col: str,
                        dir_col: str = "dir", base_col: str = "base"):
    """``dir`` = store/files/h1/h2 and ``base`` = {hash|no_hash}_{sanitized}."""
    df = with_sanitized(df, name_col, "_sl_name")
    h = F.col(hash_col)
    part = F.when(h.isNull() | (h == ""), F.lit(C.NO_HASH_PART)).otherwise(h)
    return (df.withColumn(dir_col, store_dir(store_root, hash_col))
            .withColumn(base_col, F.concat(part, F.lit("_"), F.col("_sl_name")))
            .drop("_sl_name"))


def with_counter_name(df, base_col: str, counter_col: str, out_col: str):
    df = df.withColumn("_cn_ext", F.regexp_extract(F.col(base_col), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))
    stem = F.col(base_col).substr(F.lit(1), F.length(base_col) - F.length("_cn_ext"))
    return df.withColumn(out_col, F.when(F.col(counter_col) == 0, F.col(base_col)).otherwise(
        F.concat(stem, F.lit("_"), F.col(counter_col).cast("string"), F.col("_cn_ext")))).drop("_cn_ext")


def with_relpath(df, target_col: str, start_col: str, out_col: str):
    """``os.path.relpath(target, start)`` for absolute, normalised paths."""
    df = (df.withColumn("_rp_a", F.filter(F.split(F.col(start_col), "/"), lambda x: x != ""))
          .withColumn("_rp_b", F.filter(F.split(F.col(target_col), "/"), lambda x: x != "")))
    df = df.withColumn("_rp_n", F.least(F.size("_rp_a"), F.size("_rp_b")))
    diffs = F.transform(F.sequence(F.lit(0), F.col("_rp_n") - 1),
                        lambda i: F.get(F.col("_rp_a"), i) == F.get(F.col("_rp_b"), i))
    df = df.withColumn("_rp_d", F.when(F.col("_rp_n") > 0, F.array_position(diffs, False)))
    df = df.withColumn("_rp_k", F.when(F.col("_rp_n") == 0, F.lit(0))
                       .when(F.col("_rp_d") == 0, F.col("_rp_n"))
                       .otherwise(F.col("_rp_d") - 1).cast("int"))
    ups = F.array_repeat(F.lit(".."), (F.size("_rp_a") - F.col("_rp_k")).cast("int"))
    downs = F.slice("_rp_b", F.col("_rp_k") + 1, (F.size("_rp_b") - F.col("_rp_k")).cast("int"))
    df = df.withColumn("_rp_j", F.concat_ws("/", F.concat(ups, downs)))
    df = df.withColumn(out_col, F.when(F.col("_rp_j") == "", F.lit(".")).otherwise(F.col("_rp_j")))
    return df.drop("_rp_a", "_rp_b", "_rp_n", "_rp_d", "_rp_k", "_rp_j")
