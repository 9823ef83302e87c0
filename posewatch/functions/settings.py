"""Arithmetic on stage settings and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-9
MIB = 1024 * 1024


def normalise_key(key: Column) -> Column:
    return F.translate(F.lower(F.trim(key)), "_", "-")


def close(a: Column, b: Column, rel_tol: float = TOLERANCE, abs_tol: float = TOLERANCE) -> Column:
    bound = F.greatest(F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))
    return F.abs(a - b) <= bound


def whole_steps(quotient: Column) -> Column:
    """True when a quotient is an integer within the tolerance (half-even rounding)."""
    return close(quotient, F.rint(quotient))


def estimated_disk_bytes(
    atoms: Column, production_ns: Column, interval_ps: Column, replicas: Column
) -> Column:
    frames = F.ceil(production_ns * F.lit(1000.0) / interval_ps) + F.lit(1)
    return (atoms * frames * 16 + atoms * 256 + F.lit(20 * MIB)) * replicas


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_utc(value: Column) -> Column:
    """Timestamp of an ISO text; texts with and without a fraction do not sort as text."""
    return value.try_cast("timestamp")
