"""Frames: time slice, periodic image shift and ligand RMSD.

A frame is one row with an array of xyz triples; the sums over atoms run inside
the row. Only the reference frame of a trajectory is joined to its frames.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from posewatch.functions.staging import staged

HEAVY_ATOM_MASS = 2.5


def time_slice(frames: DataFrame, begin_ps: float, end_ps: float | None = None) -> DataFrame:
    inside = F.col("time_ps") >= begin_ps
    if end_ps is not None:
        inside = inside & (F.col("time_ps") <= end_ps)
    return frames.filter(inside)


def heavy_atoms(atoms: DataFrame, ligand: DataFrame, resname: str) -> DataFrame:
    """Atoms of the ligand group with the residue name and more than hydrogen's mass."""
    return atoms.join(ligand.select("file", "atom").distinct(), ["file", "atom"], "left_semi").filter(
        (F.col("resname") == resname) & (F.col("mass_da") > HEAVY_ATOM_MASS)
    )


def _pick(xyz: Column, atoms: Column) -> Column:
    return F.transform(atoms, lambda a: F.element_at(xyz, a.cast("int")))


def _mean(points: Column, axis: int) -> Column:
    total = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + F.get(p, F.lit(axis)))
    return total / F.size(points)


def _atoms(group: Sequence[int] | Column) -> Column:
    if isinstance(group, Column):
        return group
    return F.array(*[F.lit(int(a)) for a in group])


def _fit_points(frames: DataFrame, fit: Column) -> DataFrame:
    return staged(
        frames, frames.columns, __fit=_pick(F.col("xyz"), fit), __ref=_pick(F.col("ref_xyz"), fit)
    )


def image_shift(
    frames: DataFrame, complex_atoms: Sequence[int] | Column, ligand_atoms: Sequence[int] | Column
) -> DataFrame:
    """Move the ligand by whole boxes next to the protein; keep the complex atoms only.

    Atoms are 1-based numbers in the frame, as literals or as array columns of the
    trajectory. Ties round half to even.
    """
    whole, ligand = _atoms(complex_atoms), _atoms(ligand_atoms)
    picked = staged(
        frames,
        frames.columns,
        __protein=_pick(F.col("xyz"), F.array_except(whole, ligand)),
        __ligand=_pick(F.col("xyz"), ligand),
    )
    gap = [
        (_mean(F.col("__protein"), a) - _mean(F.col("__ligand"), a)) / F.col("box_nm")
        for a in range(3)
    ]
    shifted = staged(
        picked, frames.columns, shift=F.array(*[F.rint(g) * F.col("box_nm") for g in gap])
    )

    def place(atom: Column) -> Column:
        point = F.element_at(F.col("xyz"), atom.cast("int"))
        moved = F.array(
            *[F.get(point, F.lit(a)) + F.get(F.col("shift"), F.lit(a)) for a in range(3)]
        )
        return F.when(F.array_contains(ligand, atom), moved).otherwise(point)

    return shifted.select(
        *[c for c in frames.columns if c != "xyz"], F.transform(whole, place).alias("xyz"), "shift"
    )


def reference_frames(frames: DataFrame) -> DataFrame:
    """The first frame of each trajectory.

    The least frame number is found on two narrow columns; only then are the
    coordinates of those frames read.
    """
    first = frames.groupBy("trajectory_id").agg(F.min("frame_no").alias("frame_no"))
    return frames.join(first, ["trajectory_id", "frame_no"]).select(
        "trajectory_id", F.col("xyz").alias("ref_xyz")
    )


def with_reference(frames: DataFrame, reference: DataFrame) -> DataFrame:
    """Frames with the coordinates of their reference; frames may be very skewed."""
    return frames.join(reference, "trajectory_id")


def rmsd_translation(
    frames: DataFrame, fit_atoms: Sequence[int] | Column, ligand_atoms: Sequence[int] | Column
) -> DataFrame:
    """Ligand RMSD to the reference after a shift of the fit-group centroid."""
    fit, ligand = _atoms(fit_atoms), _atoms(ligand_atoms)
    ready = _fit_points(frames, fit)
    ready = staged(
        ready,
        frames.columns,
        __t=F.array(*[_mean(F.col("__ref"), a) - _mean(F.col("__fit"), a) for a in range(3)]),
    )

    def squared(atom: Column) -> Column:
        p = F.element_at(F.col("xyz"), atom.cast("int"))
        q = F.element_at(F.col("ref_xyz"), atom.cast("int"))
        total = F.lit(0.0)
        for a in range(3):
            d = F.get(p, F.lit(a)) + F.get(F.col("__t"), F.lit(a)) - F.get(q, F.lit(a))
            total = total + d * d
        return total

    mean = F.aggregate(
        F.transform(ligand, squared), F.lit(0.0), lambda acc, v: acc + v
    ) / F.size(ligand)
    return ready.select("trajectory_id", "frame_no", "time_ps", F.sqrt(mean).alias("rmsd_nm"))


@F.pandas_udf(ArrayType(DoubleType()))
def _rotation(covariance: pd.Series) -> pd.Series:
    """Best proper rotation for each 3×3 covariance, row-major (Kabsch 1976)."""
    h = np.stack(covariance.to_numpy()).reshape(-1, 3, 3)
    u, _, vt = np.linalg.svd(h)
    v = np.swapaxes(vt, 1, 2)
    sign = np.sign(np.linalg.det(v @ np.swapaxes(u, 1, 2)))
    flip = np.ones((len(h), 3))
    flip[:, 2] = np.where(sign == 0, 1.0, sign)
    rotation = (v * flip[:, None, :]) @ np.swapaxes(u, 1, 2)
    return pd.Series(list(rotation.reshape(-1, 9)))


def rmsd_rotation_translation(
    frames: DataFrame, fit_atoms: Sequence[int] | Column, ligand_atoms: Sequence[int] | Column
) -> DataFrame:
    """Ligand RMSD after the best rotation and translation of the fit group, unweighted.

    The covariance and the distances are column expressions; only the 3×3
    decomposition, one small matrix per frame, runs in Python.
    """
    fit, ligand = _atoms(fit_atoms), _atoms(ligand_atoms)
    ready = _fit_points(frames, fit)
    ready = staged(
        ready,
        [*frames.columns, "__fit", "__ref"],
        __c=F.array(*[_mean(F.col("__fit"), a) for a in range(3)]),
        __r=F.array(*[_mean(F.col("__ref"), a) for a in range(3)]),
    )

    def covariance(i: int, j: int) -> Column:
        products = F.zip_with(
            "__fit",
            "__ref",
            lambda p, q: (F.get(p, F.lit(i)) - F.get(F.col("__c"), F.lit(i)))
            * (F.get(q, F.lit(j)) - F.get(F.col("__r"), F.lit(j))),
        )
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    ready = ready.withColumn(
        "__h", F.array(*[covariance(i, j) for i in range(3) for j in range(3)])
    ).withColumn("__rot", _rotation("__h"))

    def squared(atom: Column) -> Column:
        p = F.element_at(F.col("xyz"), atom.cast("int"))
        q = F.element_at(F.col("ref_xyz"), atom.cast("int"))
        total = F.lit(0.0)
        for i in range(3):
            turned = F.lit(0.0)
            for j in range(3):
                turned = turned + F.get(F.col("__rot"), F.lit(3 * i + j)) * (
                    F.get(p, F.lit(j)) - F.get(F.col("__c"), F.lit(j))
                )
            d = turned + F.get(F.col("__r"), F.lit(i)) - F.get(q, F.lit(i))
            total = total + d * d
        return total

    mean = F.aggregate(
        F.transform(ligand, squared), F.lit(0.0), lambda acc, v: acc + v
    ) / F.size(ligand)
    return ready.select("trajectory_id", "frame_no", "time_ps", F.sqrt(mean).alias("rmsd_nm"))
