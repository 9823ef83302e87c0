"""Exports of runs: read-back, replacing, and writers that fail."""

import csv
import hashlib
import io
import json
import os
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from posewatch.functions.documents import ORDER
from posewatch.operators import planning
from posewatch.operators import transitions as tr
from posewatch.sources import exports, manifest

ROW = "run_id string, name string, note string, flag boolean, score double, n long"
DATA = [
    ("r", "a", 'he said "x", then\nleft', True, 1.5, 1), ("r", "b", None, False, 1e-7, 2), ("r", "c", "", None, None, 3),
    ("s", "é", "plain", True, 1e16, None),
]
FIELDS = ["name", "note", "flag", "score", "n"]


def written(export, name):
    return {p.parent.name: p for p in Path(export.folder).rglob(name)}


def test_csv_of_every_run(spark, tmp_path):
    export = exports.Export(spark, str(tmp_path))
    export.csv(spark.createDataFrame(DATA, ROW).repartition(3), "names.csv", FIELDS, ["name"])
    files = written(export, "names.csv")
    assert set(files) == {"r", "s"}
    with open(files["r"], newline="", encoding="utf-8") as f:
        got = list(csv.reader(f))
    assert got == [FIELDS, ["a", 'he said "x", then\nleft', "True", "1.5", "1"], ["b", "", "False", "1e-07", "2"], ["c", "", "", "", "3"]]
    back = exports.read_csv(spark, export.folder, "names.csv", "name string, note string, flag boolean, score double, n long")
    assert rows(back.select("name", "score"), "name") == [("a", 1.5), ("b", 1e-7), ("c", None), ("é", 1e16)]


def test_publishing_replaces_as_a_whole(spark, tmp_path):
    poses = spark.createDataFrame([("r", "p1", "COMPLETED", 2, 4.5), ("r", 'p"2', "PRUNED", 1, None)],
                                  "run_id string, pose_id string, status string, n_replicas_requested int, md_score_angstrom double")
    runs = spark.createDataFrame([("r", "COMPLETED")], "run_id string, status string")

    def publish():
        export = exports.Export(spark, str(tmp_path))
        export.lines(tr.run_report(runs, poses), "run_report.md", ["section", "pose_id"])
        export.lines(tr.run_manifest(runs, poses), "run_manifest.json", ORDER)
        return export

    first = publish()
    with pytest.raises(FileNotFoundError):
        exports.current(str(tmp_path))
    first.publish()
    report = written(first, "run_report.md")["r"].read_text().split("\n")
    assert report[:4] == ["# Run report: r", "", "- Status: COMPLETED", "- Pose count: 2"] and report[-2:] == [tr.EXECUTED, ""]
    document = json.loads(written(first, "run_manifest.json")["r"].read_text())
    assert [p["pose_id"] for p in document["poses"]] == ['p"2', "p1"] and document["schema_version"] == 2
    assert document["pose_ids"] == ['p"2', "p1"] and document["run_id"] == "r" and document["poses"][1]["md_score_angstrom"] == 4.5
    listed = {r.path: r for r in exports.listed(spark, first.folder).collect()}
    for name in ("run_report.md", "run_manifest.json"):
        body = written(first, name)["r"].read_bytes()
        assert (listed[name].size_bytes, listed[name].sha256) == (len(body), hashlib.sha256(body).hexdigest())
    sums = written(first, exports.CHECKSUMS)["r"].read_text()
    assert sums == "".join(f"{listed[n].sha256}  {n}\n" for n in sorted(("run_report.md", "run_manifest.json")))
    second = publish()
    assert exports.current(str(tmp_path)) == first.folder  # not yet
    second.publish()
    assert exports.current(str(tmp_path)) == second.folder


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    export = exports.Export(spark, str(tmp_path))
    broken = spark.createDataFrame(DATA, ROW).repartition(4, "run_id").withColumn(
        "note", F.when(F.col("run_id") == "s", F.raise_error(F.lit("lost"))).otherwise(F.col("note")))
    with pytest.raises(Exception, match="lost"):
        export.csv(broken, "names.csv", FIELDS, ["name"])
    left = [f for _, _, names in os.walk(export.folder) for f in names]
    assert left == []
    with pytest.raises(FileNotFoundError):
        exports.current(str(tmp_path))


def test_long_tables_are_cut_into_files(spark, tmp_path):
    export = exports.Export(spark, str(tmp_path))
    many = spark.range(250).select(F.lit("r").alias("run_id"), "id")
    export.csv(many, "ids.csv", ["id"], ["id"], rows_per_file=100)
    export.csv(many.limit(0), "none.csv", ["id"], ["id"])
    found = {p.name: len(p.read_text().splitlines()) - 1 for p in Path(export.folder).rglob("ids*.csv")}
    assert found == {"ids.csv": 100, "ids-00001.csv": 100, "ids-00002.csv": 50}
    assert exports.read_csv(spark, export.folder, "ids.csv", "id long").distinct().count() == 250
    assert rows(export.files().select("path"), "path") == [("ids-00001.csv",), ("ids-00002.csv",), ("ids.csv",)]


def test_execution_plan_document(spark):
    poses = spark.createDataFrame([("r", "b", 1, [5, 6], [0, 2]), ("r", "a", 2, [7], [0, 2])],
                                  "run_id string, pose_id string, pose_no long, seeds array<long>, gpu_ids array<int>")
    poses = poses.withColumns({"pruning_enabled": F.lit(True), "pruning_threshold_angstrom": F.lit(4.5)})
    tasks = planning.expand_tasks(poses).withColumn("resolved_ntomp", F.lit(4))
    sums = spark.createDataFrame([("r", "a", "topol.top", "ab" * 32)], "run_id string, pose_id string, destination string, sha256 string")
    named = planning.pose_documents(poses.withColumn("n_replicas_requested", F.size("seeds")), planning.checksum_maps(sums))
    lines = planning.plan_lines(poses.select("run_id", "gpu_ids").distinct(), tasks, named, ["nvt", "npt"], available_cpus=16)
    plan = json.loads("\n".join(r.line for r in lines.orderBy(*ORDER).collect()))
    assert [t["task_id"] for t in plan["tasks"]] == ["b:replica_01", "b:replica_02", "a:replica_01"]
    assert [t["initial_gpu_id"] for t in plan["tasks"]] == [0, 2, 0] and plan["gpu_ids"] == [0, 2] and plan["worker_count"] == 2
    assert plan["poses"][0] == {"input_checksums": {"topol.top": "ab" * 32}, "pose_id": "a", "replica_count": 1,
                                "pruning": {"enabled": True, "strict_operator": ">", "threshold_angstrom": 4.5}}
    assert (plan["stages"], plan["resolved_ntomp_per_task"], plan["available_cpu_count"]) == (["nvt", "npt"], 4, 16)


def test_manifest_roots(spark):
    texts = [("good", '{"schema_version": 1, "poses": [{"pose_id": "a"}, {"pose_id": "b"}]}'), ("old", '{"schema_version": 2, "poses": [{"pose_id": "c"}]}'),
             ("none", '{"schema_version": 1, "poses": []}'), ("list", "[1]"), ("broken", "{"), ("more", '{"schema_version": 1, "poses": [{}], "x": 1}')]
    entries, wrong = manifest.manifest_documents(spark.createDataFrame(texts, "manifest string, text string"))
    found = {}
    for r in wrong.collect():
        found.setdefault(r.manifest, set()).add(r.reason)
    assert found["old"] == {"schema_version is not 1"} and found["none"] == {"no poses"} and found["more"] == {"unknown field x"}
    assert "not an object" in found["list"] and "not an object" in found["broken"] and "good" not in found
    assert rows(entries.where("manifest = 'good'").select("pose_no", "value"), "pose_no") == [(0, '{"pose_id":"a"}'), (1, '{"pose_id":"b"}')]


def test_fields_are_those_of_the_csv_module(spark, tmp_path):
    texts = ["a,b", "a\rb", '"', "", None, " x ", "é\u2028", "'", "\n", ";", "None"]
    numbers = [0.0, -0.0, 1e16, 1e-7, float("nan"), float("inf"), None, 0.1, 1 / 3, 2.0, -5e-324]
    data = [(i, t, x, i % 3 == 0 if i else None, -i) for i, (t, x) in enumerate(zip(texts, numbers, strict=True))]
    export = exports.Export(spark, str(tmp_path))
    df = spark.createDataFrame([("r", *x) for x in data], "run_id string, i int, t string, x double, b boolean, n long")
    for name, fields in (("all.csv", ["i", "t", "x", "b", "n"]), ("one.csv", ["t"])):
        export.csv(df, name, fields, ["i"])
        want = io.StringIO(newline="")
        csv.writer(want).writerows([fields, *([[dict(zip("itxbn", x, strict=True))[f] for f in fields] for x in data])])
        assert written(export, name)["r"].read_bytes() == want.getvalue().encode()


def test_large_runs_have_a_task_each(spark, tmp_path):
    """Runs of few bytes once compressed are not put together into one task."""
    runs = [f"r{i}" for i in range(6)]
    export = exports.Export(spark, str(tmp_path))
    df = spark.range(6000).select(F.concat(F.lit("r"), F.col("id") % 6).alias("run_id"), "id")
    export.csv(df, "ids.csv", ["id"], ["id"])
    parts = {p.parent.parent.name for p in written(export, "ids.csv").values()}
    want = df.select(F.pmod(F.hash("run_id", F.lit("ids.csv")), F.lit(8)).alias("p")).distinct().count()
    assert set(written(export, "ids.csv")) == set(runs) and len(parts) == want > 1
