"""RMSD unit conversion. A unit is always named and never guessed from the value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NM_TO_ANGSTROM = 10.0
UNITS = ("nm", "angstrom")


def nm_to_angstrom(value: Column) -> Column:
    return value * F.lit(NM_TO_ANGSTROM)


def convert_rmsd(value: Column, input_unit: Column | str, output_unit: Column | str) -> Column:
    """Convert between nm and Å; an unknown unit fails the job.

    Units may be plain strings (checked now) or columns (checked per row).
    """
    for unit in (input_unit, output_unit):
        if isinstance(unit, str) and unit not in UNITS:
            raise ValueError(f"unsupported unit: {unit!r}")
    src = F.lit(input_unit) if isinstance(input_unit, str) else input_unit
    dst = F.lit(output_unit) if isinstance(output_unit, str) else output_unit
    unknown = ~(F.coalesce(src, F.lit("")).isin(*UNITS) & F.coalesce(dst, F.lit("")).isin(*UNITS))
    return (
        F.when(unknown, F.raise_error(F.lit("unsupported RMSD unit")).cast("double"))
        .when(src == dst, value)
        .when(src == "nm", value * F.lit(NM_TO_ANGSTROM))
        .otherwise(value / F.lit(NM_TO_ANGSTROM))
    )
