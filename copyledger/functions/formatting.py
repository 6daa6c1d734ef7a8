"""Number formatting and statistic text conversion as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from copyledger import constants as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed2(x) -> Column:
    """Two decimals, half-even on the exact value, no grouping separators."""
    return F.replace(F.format_number(_col(x).cast("double"), 2), F.lit(","), F.lit(""))


def thousands(n) -> Column:
    """Integer with ',' thousands separators."""
    return F.format_number(_col(n).cast("long"), 0)


def format_bytes(x) -> Column:
    """0 -> '0 B'; otherwise divide by 1024 through B..TB, else PB; 2 decimals."""
    v = _col(x).cast("double")
    expr = F.when(v == 0, F.lit("0 B"))
    scale = 1.0
    for unit in C.BYTE_UNITS:
        scaled = v / F.lit(scale)
        expr = expr.when(scaled < 1024.0, F.concat(fixed2(scaled), F.lit(" " + unit)))
        scale *= 1024.0
    return expr.otherwise(F.concat(fixed2(v / F.lit(scale)), F.lit(" " + C.BYTE_UNIT_LAST)))


def ratio_pct(value, total) -> Column:
    """value / total * 100, 0.0 when total is 0 (same operation order)."""
    value, total = _col(value).cast("double"), _col(total).cast("double")
    return F.when(total == 0, F.lit(0.0)).otherwise(value / total * 100.0)


def format_percentage(value, total) -> Column:
    total_c = _col(total)
    return F.when(total_c == 0, F.lit("0.00%")).otherwise(
        F.concat(fixed2(ratio_pct(value, total)), F.lit("%")))


def stat_to_int(text, default: int = 0) -> Column:
    """Statistic text as an integer, ``default`` when missing or not an integer."""
    return F.coalesce(_col(text).try_cast("long"), F.lit(default).cast("long"))


def utc_wall(ts) -> Column:
    """A TIMESTAMP as its UTC wall-clock TIMESTAMP_NTZ (independent of the
    session time zone)."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), _col(ts).cast("timestamp_ntz"))


def iso_utc(ts) -> Column:
    """ISO-8601 text with a '+00:00' offset; fractional seconds only when
    non-zero (as Python's ``isoformat``)."""
    w = utc_wall(ts)
    frac = F.date_format(w, "SSSSSS")
    return F.when(w.isNull(), F.lit(None)).otherwise(F.concat(
        F.date_format(w, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
        F.lit("+00:00")))


def display_ts(ts) -> Column:
    """'YYYY-MM-DD HH:MM:SS' in UTC."""
    return F.date_format(utc_wall(ts), "yyyy-MM-dd HH:mm:ss")


def utc_ts(text: str) -> Column:
    """A run time given as 'YYYY-MM-DD HH:MM:SS' in UTC, as a TIMESTAMP
    (independent of the session time zone)."""
    return F.lit(f"{text}+00:00").cast("timestamp")
