"""Frames: periodic jumps, translation and rotation fits."""

import json
import math

import numpy as np
import pytest
from conftest import rows

from posewatch import schemas
from posewatch.operators import geometry
from posewatch.sources import frames as source

BASE = [[1.0, 1.0, 1.0], [2.0, 1.0, 1.0], [1.0, 2.0, 1.5], [1.5, 1.5, 2.0], [1.7, 1.2, 2.2]]


def frame(spark, *coordinates):
    data = [("t", i, i * 10.0, 10.0, xyz) for i, xyz in enumerate(coordinates)]
    return spark.createDataFrame(data, schemas.FRAMES)


def jumped(xyz, atoms, by):
    return [[x + (by if i + 1 in atoms else 0.0), y, z] for i, (x, y, z) in enumerate(xyz)]


def test_periodic_jump_vanishes(spark):
    raw = frame(spark, BASE, jumped(BASE, {4, 5}, 10.0), BASE)
    reference = geometry.reference_frames(raw)
    plain = geometry.rmsd_translation(geometry.with_reference(raw, reference), [1, 2, 3], [4, 5])
    assert max(r.rmsd_nm for r in plain.collect()) == pytest.approx(10.0)
    moved = geometry.image_shift(raw, [1, 2, 3, 4, 5], [4, 5])
    fixed = geometry.rmsd_translation(geometry.with_reference(moved, geometry.reference_frames(moved)), [1, 2, 3], [4, 5])
    assert [r.rmsd_nm for r in fixed.collect()] == pytest.approx([0.0, 0.0, 0.0], abs=1e-12)


def test_half_box_rounds_to_even(spark):
    far = [[0.0, 0.0, 0.0], [5.0, 0.0, 0.0], ]
    out = geometry.image_shift(frame(spark, far), [1, 2], [2]).first()
    assert out["shift"] == [0.0, 0.0, 0.0]
    further = [[0.0, 0.0, 0.0], [15.0, 0.0, 0.0]]
    assert geometry.image_shift(frame(spark, further), [1, 2], [2]).first()["shift"] == [-20.0, 0.0, 0.0]


def test_rotation_is_fitted(spark):
    a = math.radians(40)
    turn = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    turned = (np.array(BASE) @ turn.T + [3.0, -1.0, 0.5]).tolist()
    pulled = [*turned[:4], [turned[4][0], turned[4][1], turned[4][2] + 0.3]]
    raw = frame(spark, BASE, turned, pulled)
    ready = geometry.with_reference(raw, geometry.reference_frames(raw))
    got = rows(geometry.rmsd_rotation_translation(ready, [1, 2, 3, 4], [5]).select("rmsd_nm"), "frame_no")
    assert [g[0] for g in got] == pytest.approx([0.0, 0.0, 0.3], abs=1e-9)
    shifted = geometry.rmsd_translation(ready, [1, 2, 3, 4], [5])
    assert shifted.filter("frame_no = 1").first().rmsd_nm > 0.1


def test_mirror_image_is_not_a_rotation(spark):
    mirrored = [[-x, y, z] for x, y, z in BASE]
    raw = frame(spark, BASE, mirrored)
    ready = geometry.with_reference(raw, geometry.reference_frames(raw))
    row = geometry.rmsd_rotation_translation(ready, [1, 2, 3, 4], [1, 2, 3, 4]).filter("frame_no = 1").first()
    assert row.rmsd_nm > 0.05


def test_time_slice_and_documents(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"box_nm": 10, "frames": [{"time_ps": i * 10, "coordinates_nm": BASE} for i in range(4)]}))
    docs = source.read_frame_documents(spark, str(path))
    assert rows(geometry.time_slice(docs, 10.0, 20.0).select("frame_no"), "frame_no") == [(1,), (2,)]
    assert geometry.time_slice(docs, 10.0).count() == 3
    atoms = source.atoms_long(docs)
    assert atoms.count() == 20 and atoms.filter("frame_no = 0 and atom = 2").first().x == 2.0


def test_heavy_atoms(spark):
    atoms = spark.createDataFrame([("f", 1, "LIG", 12.0), ("f", 2, "LIG", 1.0), ("f", 3, "SOL", 16.0), ("f", 4, "LIG", 14.0)],
                                  "file string, atom int, resname string, mass_da double")
    ligand = atoms.filter("atom < 4").select("file", "atom")
    assert rows(geometry.heavy_atoms(atoms, ligand, "LIG").select("atom")) == [(1,)]
