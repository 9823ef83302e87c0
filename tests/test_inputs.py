"""Prepared inputs, integrity, audit, identifiers and redaction on small fixtures."""

import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from posewatch.functions import identity, redaction, settings
from posewatch.operators import audit, integrity, planning, prepared
from posewatch.sources import files, manifest, series
from posewatch.sources import prepared as source


def texts(spark, **files_):
    return spark.createDataFrame(list(files_.items()), "path string, text string")


def index(spark, text):
    return source.scan_index(texts(spark, f=text)).withColumnRenamed("path", "file")


GOOD = "; c\n[ C-alpha ]\n10 30\n[ LIG ]\n70\n90\n[ Protein_LIG ]\n10 30 70 90\n[ Water_and_ions ]\n100\n"


def test_index_groups(spark):
    got = rows(index(spark, GOOD).filter("pos > 0").select("group", "pos", "atom"), "group_ord", "pos")
    assert got == [("C-alpha", 1, 10), ("C-alpha", 2, 30), ("LIG", 1, 70), ("LIG", 2, 90), ("Protein_LIG", 1, 10), ("Protein_LIG", 2, 30),
                   ("Protein_LIG", 3, 70), ("Protein_LIG", 4, 90), ("Water_and_ions", 1, 100)]
    assert prepared.index_violations(index(spark, GOOD)).count() == 0


@pytest.mark.parametrize("text, reason", [
    ("[ ]\n1\n", "empty_group_name"), ("1 2\n[ a ]\n3\n", "atoms_before_header"), ("[ a ]\n1 x\n", "non_integer"),
    ("[ a ]\n0\n", "not_positive"), ("; only\n\n", "no_groups")])
def test_index_faults(spark, text, reason):
    assert reason in {r.reason for r in index(spark, text).collect()}


@pytest.mark.parametrize("text, group, reason", [
    (GOOD.replace("[ LIG ]", "[ OTHER ]"), "LIG", "exists 0 times"),
    (GOOD + "[ LIG ]\n70\n", "LIG", "exists 2 times"),
    (GOOD.replace("100\n", "\n"), "Water_and_ions", "empty"),
    (GOOD.replace("70\n90\n", "70\n70\n"), "LIG", "repeated atoms"),
    (GOOD.replace("70\n90\n", "71\n"), "LIG", "not a subset of Protein_LIG")])
def test_required_groups(spark, text, group, reason):
    assert (group, reason) in rows(prepared.index_violations(index(spark, text)).select("group", "reason"))


def test_remap(spark):
    atoms = index(spark, GOOD).filter("pos > 0")
    positions = atoms.filter("group = 'Protein_LIG'").select("file", "atom", F.col("pos").alias("position"))
    generated = atoms.filter("group in ('C-alpha', 'LIG')").unionByName(atoms.filter("group = 'Water_and_ions'"))
    got = rows(prepared.remap_atoms(generated, positions).select("group", "position", "reason"), "group", "pos")
    assert got == [("C-alpha", 1, None), ("C-alpha", 2, None), ("LIG", 3, None), ("LIG", 4, None), ("Water_and_ions", None, "atom outside the complex")]
    ca = atoms.filter("group = 'C-alpha'")
    assert prepared.sequence_differences(ca, ca).count() == 0
    assert prepared.sequence_differences(ca, ca.filter("pos = 1")).count() == 1


def test_includes(spark):
    docs = texts(spark, **{
        "/prep/topol.top": '#include "ff/forcefield.itp"\r\n  #include "ligand.itp"\n; #include "no.itp"\n#include "../outside.itp"\n',
        "/share/ff/forcefield.itp": '#include "ffnonbonded.itp"\n',
        "/share/ff/ffnonbonded.itp": '#include "forcefield.itp"\n', "/prep/ligand.itp": "", "/outside.itp": ""})
    edges = source.scan_includes(docs)
    resolved = prepared.resolve_includes(edges, docs.select("path"), "/prep", ["/share"])
    got = {(r.path, r.include): (r.target, r.is_local, r.reason) for r in resolved.collect()}
    assert got[("/prep/topol.top", "ff/forcefield.itp")] == ("/share/ff/forcefield.itp", False, None)
    assert got[("/prep/topol.top", "ligand.itp")] == ("/prep/ligand.itp", True, None)
    assert got[("/prep/topol.top", "../outside.itp")] == (None, None, "unresolved include")
    roots = spark.createDataFrame([("s", "/prep/topol.top")], "system string, path string")
    reach = prepared.include_closure(roots, resolved.filter("target is not null"))
    assert rows(reach.select("path", "depth"), "depth", "path") == [("/prep/topol.top", 0), ("/prep/ligand.itp", 1),
                                                                  ("/share/ff/forcefield.itp", 1), ("/share/ff/ffnonbonded.itp", 2)]


NVT = "Integrator = MD ; x\ndt = 0.002\nnsteps = 50000\ngen_vel = yes\n"
NPT = "integrator = md\ndt = 0.002\nnsteps = 50000\ngen-vel = no\n"
PRODUCTION = "integrator = md\ndt = 0.002\nnsteps = 2500000\ngen_vel = no\nnstxout-compressed = 5000\n"


def stage_settings(spark, nvt=NVT, npt=NPT, production=PRODUCTION):
    docs = texts(spark, nvt=nvt, npt=npt, production=production)
    return source.scan_settings(docs)


def faults(spark, interval=10.0, time_ns=5.0, **kw):
    parsed = stage_settings(spark, **kw).filter("reason is null").select(F.lit("s").alias("system"), F.col("path").alias("stage"), "key", "value")
    system = spark.createDataFrame([("s", interval, time_ns)], "system string, output_interval_ps double, production_time_ns double")
    return {(r.stage, r.reason) for r in prepared.settings_violations(parsed, system).collect()}


def test_settings(spark):
    assert faults(spark) == set()
    assert faults(spark, interval=10.001) == {("production", "output interval must be a multiple of dt"), ("production", "compressed-output interval does not match")}
    assert faults(spark, npt=NPT.replace("no", "yes")) == {("npt", "gen-vel must be no")}
    assert faults(spark, nvt=NVT.replace("MD", "sd")) == {("nvt", "integrator must be md")}
    assert ("nvt", "duplicate key dt") in faults(spark, nvt=NVT + "DT = 0.002\n")
    assert faults(spark, production=PRODUCTION.replace("nsteps = 2500000", "nsteps = 2.5")) == {("production", "nsteps must be an integer value")}


def test_settings_lines(spark):
    got = rows(source.scan_settings(texts(spark, f="a_B = 1 ; c\n\nbroken\nx =\n; only\n")).select("line_no", "key", "value", "reason"), "line_no")
    assert got == [(1, "a-b", "1", None), (3, None, None, "no_equals"), (4, "x", None, "empty_value")]


def test_resolved_settings(spark):
    parsed = stage_settings(spark).select(F.lit("s").alias("system"), F.col("path").alias("stage"), "key", "value")
    replicas = spark.createDataFrame([("s", "r1", 7, 100, 5)], "system string, replica_id string, velocity_seed int, production_steps int, interval_steps int")
    got = {(r.stage, r.key): r.value for r in prepared.resolved_settings(parsed, replicas).collect()}
    assert got[("nvt", "gen-seed")] == "7" and got[("nvt", "integrator")] == "MD"
    assert got[("production", "nsteps")] == "100" and got[("production", "nstxout-compressed")] == "5"
    assert len(got) == 14


def test_structure_and_disk(spark):
    one = spark.range(1)
    assert one.select(source.structure_atom_count(F.lit("t\n 42 \nx"))).first()[0] == 42
    assert one.select(source.structure_atom_count(F.lit("t"))).first()[0] is None
    estimate = settings.estimated_disk_bytes(F.lit(100), F.lit(5.0), F.lit(10.0), F.lit(5))
    assert one.select(estimate).first()[0] == (100 * 501 * 16 + 100 * 256 + 20 * 1024 * 1024) * 5


def test_missing_paths_and_preflight(spark):
    required = spark.createDataFrame([("a", "/r/a", "x.gro"), ("a", "/r/a", "../b/x.gro"), ("b", "/r/b", "x.gro")], "system string, root string, path string")
    there = spark.createDataFrame([("/r/b/x.gro",)], "path string")
    missing = prepared.missing_paths(required, there)
    assert rows(missing.select("system", "reason"), "reason") == [("a", "missing"), ("a", "outside the root")]
    poses = spark.createDataFrame([("a", 5, None, None, False, None, 100, 5.0, 10.0), ("b", 2, [1, 2], None, True, 4.0, 100, 5.0, 10.0)],
                                  "system string, replicas int, seeds array<bigint>, base_seed bigint, pruning_enabled boolean, pruning_threshold_angstrom double, "
                                  "atoms bigint, production_time_ns double, output_interval_ps double")
    checks = prepared.preflight_checks(poses, missing.select("system", F.lit("files").alias("area"), "reason"))
    codes = {s: {r.code for r in checks.filter(F.col("system") == s).collect()} for s in "ab"}
    assert codes["a"] == {"SEED_CONFIGURATION_VALID", "PRUNING_DISABLED", "INPUT_FILES_MISSING"}
    assert "DISK_ESTIMATE_OK" in codes["b"] and "MDP_SEMANTICS_OK" in codes["b"]
    assert rows(prepared.preflight_summary(checks).select("exit_code", "overall_status"), "system") == [(3, "FAIL"), (0, "PASS")]


def test_manifest(spark, tmp_path):
    path = tmp_path / "poses.jsonl"
    base = '"prepared_system_dir": "d", "start_structure": "s", "topology": "t", "index": "i", "ligand_resname": "LIG"'
    path.write_text(
        '{"pose_id": "a", %s, "overrides": {"trajectory": {"seeds": [5, 6, 7]}}}\n' % base
        + '{"pose_id": "b", %s, "overrides": {"pruning": {"threshold_angstrom": null, "enabled": false}}, "extra": 1}\n' % base
        + '{"pose_id": "c", %s, "overrides": {"trajectory": {"base_seed": 2147483646}}}\n' % base
        + '{"pose_id": "c", %s}\n' % base)
    raw = manifest.read_pose_manifest(spark, str(path))
    assert rows(raw.filter("size(unknown_fields) > 0").select("pose_id", "unknown_fields")) == [("b", ["extra"])]
    entries = raw.select(
        F.lit("r").alias("run_id"), "pose_id", "ligand_resname", *[c for c in raw.columns if c.startswith("has_")],
        *[F.col(f"overrides.trajectory.{n}").alias(f"o_{n}") for n in ("replicas", "base_seed", "seeds")],
        *[F.col(f"overrides.pruning.{n}").alias(f"o_{n}") for n in ("enabled", "threshold_angstrom", "grace_period_seconds")])
    resolved = planning.overlay_manifest(entries, {"replicas": 5, "base_seed": 1, "seeds": None, "enabled": True, "threshold_angstrom": 4.0, "grace_period_seconds": 1.0})
    got = {(r.pose_id, r.replicas, r.base_seed, tuple(r.seeds or ()), r.pruning_enabled, r.pruning_threshold_angstrom) for r in resolved.collect()}
    assert got == {("a", 3, None, (5, 6, 7), True, 4.0), ("b", 5, 1, (), False, None), ("c", 5, 2147483646, (), True, 4.0), ("c", 5, 1, (), True, 4.0)}
    faults_ = rows(planning.manifest_violations(resolved).select("pose_id", "reason"), "reason")
    assert faults_ == [("c", "base_seed range exceeds the 32-bit seed limit"), ("c", "pose_id values must be unique")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_checksum_list(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "artifact.txt").write_text("one")
    (tmp_path / "sub" / "b.txt").write_text("two")
    inventory = files.inventory(spark, str(tmp_path))
    assert rows(inventory.select("path", "size_bytes"), "path") == [("artifact.txt", 3), ("sub/b.txt", 3)]
    lines = spark.createDataFrame([(f"{sha('one')}  artifact.txt",), (f"{sha('x')}  sub/b.txt",), ("",), (f"{sha('x')}  ../outside.txt",), ("bad",),
                                   (f"{sha('x').upper()}  c",), (f"{sha('x')}  gone",)], "line string")
    got = {r.path: r.failure for r in integrity.verify_checksums(files.checksum_lines(lines), inventory).collect()}
    assert got == {"sub/b.txt": "mismatch", "../outside.txt": "unsafe_path", None: "malformed_line", "c": "invalid_digest", "gone": "missing"}


def test_large_files_are_hashed_in_blocks(spark, tmp_path, monkeypatch):
    (tmp_path / "a b.dat").write_bytes(b"0123456789" * 7)
    (tmp_path / "small").write_bytes(b"0123")
    want = rows(files.inventory(spark, str(tmp_path)), "path")
    monkeypatch.setattr(files, "BINARY_CELL_LIMIT", 9)
    monkeypatch.setattr(files, "BLOCK", 16)
    assert rows(files.inventory(spark, str(tmp_path)), "path") == want


def test_file_over_two_gigabytes(spark, tmp_path):
    size = 2**31 + 5
    with open(tmp_path / "big.xvg", "wb") as f:
        f.truncate(size)
    digest = hashlib.sha256()
    for _ in range(size >> 20):
        digest.update(bytes(1 << 20))
    digest.update(bytes(size & ((1 << 20) - 1)))
    assert rows(files.inventory(spark, str(tmp_path))) == [("big.xvg", size, digest.hexdigest())]
    scan = series.scan_series(series.read_files(spark, str(tmp_path)))
    assert [r.reason for r in series.quarantine(scan).collect()] == ["too_large"]
    assert series.accepted(scan).count() == 0


def test_digest_diff_and_sets(spark):
    schema = "pose_id string, identifier string, sha256 string"
    expected = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "3")], schema)
    actual = spark.createDataFrame([("p", "b", "2"), ("p", "c", "9"), ("p", "d", "4"), ("q", "e", "5"), ("q", "e", "5")], schema)
    got = {r.identifier: r.change for r in integrity.digest_diff(expected, actual, ["pose_id", "identifier"]).collect()}
    assert got == {"a": "missing", "c": "changed", "d": "unexpected", "e": "duplicate"}
    assert integrity.set_difference(expected, expected, "identifier").count() == 0


def test_stage_reuse(spark):
    key = ["pose_id"]
    expected = spark.createDataFrame([("a", "production", 1), ("b", "nvt", 1), ("c", "nvt", 1), ("d", "nvt", 1)], "pose_id string, stage string, velocity_seed int")
    markers = spark.createDataFrame([("a", "production", 1, False), ("b", "nvt", 1, False), ("c", "nvt", 2, False)], "pose_id string, stage string, velocity_seed int, corrupt boolean")
    suffixes = [".tpr", ".gro", ".cpt", ".log"]
    outputs = spark.createDataFrame([(p, s, 1) for p in "ab" for s in suffixes] + [("a", ".xtc", 0)], "pose_id string, suffix string, size_bytes int")
    got = rows(integrity.stage_reuse(expected, markers, outputs, key, ["stage", "velocity_seed"]).select("decision"), "pose_id")
    assert got == [("incomplete",), ("reusable",), ("mismatch",), ("absent",)]


def test_required_members(spark):
    docs = spark.createDataFrame([("a.md", "# A"), ("pkg/app.py", "x")], "path string, text string")
    got = {r.path: r.reason for r in integrity.required_members(docs, {"a.md": "# B", "b.md": "x", "pkg/app.py": "x"}, ["app.py", ".whl"]).collect()}
    assert got == {"a.md": "marker missing", "b.md": "missing", ".whl": "missing"}


def test_pose_keys(spark):
    ids = ["TARGET1|p2|model4", "标识", "x" * 505, "a b", "a-b", "..-"]
    got = [r.k for r in spark.createDataFrame([(i,) for i in ids], "i string").select(identity.pose_key(F.col("i")).alias("k")).collect()]
    assert len(set(got)) == 6 and max(map(len, got)) <= 106
    assert got[0] == f"TARGET1-p2-model4--{sha(ids[0])}" and got[1] == f"pose--{sha(ids[1])}"


def test_identifiers(spark):
    def value(c):
        return spark.range(1).select(c).first()[0]

    for text, ok in [("a", True), (" a", False), ("a\u3000", False), ("a\tb", False), ("", False), ("a b", True)]:
        assert value(identity.pose_id_valid(F.lit(text))) is ok
    assert [value(identity.resname_valid(F.lit(t))) for t in ("LIG", "LIG\n", "A" * 17)] == [True, False, False]
    assert [value(identity.safe_relative_path(F.lit(t))) for t in ("a/b", "/a", "a/../b", "a..b")] == [True, False, False, True]
    assert value(identity.external_identifier(F.lit("/opt/x.ff/y.ff/z.itp"))) == "x.ff/y.ff/z.itp"
    assert value(identity.external_identifier(F.lit("/opt/z.itp"))) == "z.itp"
    assert [value(identity.file_suffix(F.lit(t))) for t in ("a/b.TAR.GZ", ".bashrc", "a.b/c", "x.")] == [".gz", "", "", ""]
    assert value(identity.safe_label(F.lit("--a b!c--"))) == "a-b-c" and value(identity.safe_label(F.lit("!!"))) == "run"


def test_redaction(spark):
    def value(c):
        return spark.range(1).select(c).first()[0]

    text = "working=/private/work/stage host=node-a unrelated=node-alpha API_KEY=abc"
    assert value(redaction.redact_log(F.lit(text), ["/", "/private/work"], ["node-a"])) == (
        "working=<REDACTED_PATH>/stage host=<REDACTED> unrelated=node-alpha API_KEY=<REDACTED>")
    assert value(redaction.redact_paths(F.lit("see /a/b c/d x:/e"))) == "see <REDACTED_PATH> c/d x:<REDACTED_PATH>"
    assert value(redaction.redact_json_paths(F.lit('{"/k": ["/a/b", {"x": "y /z"}], "n": 1}'))) == (
        '{"/k": ["<REDACTED_PATH>", {"x": "y <REDACTED_PATH>"}], "n": 1}')
    assert value(redaction.shorten_build_path(F.lit("cc /usr/bin/gcc -I/opt/inc"))) == "cc gcc -Iinc"


def test_audit(spark):
    docs = spark.createDataFrame([
        ("a.md", ".md", "Kd of 10 uM, label = active, contact x.y@z.org"), ("b.py", ".py", "run(shell = True) # IC50"), ("c.txt", ".txt", "éhost@x.com ok"),
        ("d", "", "-----BEGIN PRIVATE KEY-----"), ("e", "", "ghp_" + "a" * 30), ("f", "", "/home/x secret-name"), ("g.md", ".md", "kilo")],
        "path string, suffix string, text string")
    got = {(r.path, r.detail) for r in audit.content_findings(docs, audit.default_rules(forbidden=["secret-name"])).collect()}
    assert got == {("a.md", "activity_measure: Kd"), ("a.md", "activity_threshold_label: 10 uM"), ("a.md", "activity_label: label = active"), ("a.md", "email-like value"),
                   ("b.py", "shell execution enabled"), ("d", "credential-like value"), ("e", "credential-like value"), ("f", "/home/"), ("f", "secret-name")}
    paths = spark.createDataFrame([("../x.gz", 1), ("notes/a", 30 * 2**20), ("ok.md", 1)], "path string, size_bytes bigint")
    kinds = {(r.path, r.category) for r in audit.path_findings(paths, prefixes=["notes/"]).collect()}
    assert kinds == {("../x.gz", "unsafe_member_path"), ("../x.gz", "forbidden_extension"), ("notes/a", "large_file"), ("notes/a", "private_or_out_of_scope_path")}
    clean = audit.finding_summary(paths, audit.content_findings(docs.limit(0), audit.default_rules())).first()
    assert (clean.status, clean.files_checked, clean.n_findings) == ("PASS", 3, 0)
    links = audit.link_findings(docs, "IC50", ["a.md", "zz"])
    assert rows(links, "path") == [("a.md", "text missing"), ("b.py", "text unexpected"), ("zz", "file missing")]


def test_plan_documents_hold_sorted_checksums(spark):
    rows_ = spark.createDataFrame([("r", "p", "b.gro", "2"), ("r", "p", "a.top", "1"), ("r", "p", "<EXTERNAL_GROMACS_DATA>", "3")],
                                  "run_id string, pose_id string, destination string, sha256 string")
    poses = spark.createDataFrame([("r", "p", True, 4.0, 5), ("r", "q", False, None, 1)],
                                  "run_id string, pose_id string, pruning_enabled boolean, pruning_threshold_angstrom double, n_replicas_requested int")
    docs = rows(planning.pose_documents(poses, planning.checksum_maps(rows_)).select("pose_json"), "pose_id")
    assert docs == [
        ('{"input_checksums":{"a.top":"1","b.gro":"2"},"pose_id":"p","pruning":{"enabled":true,"strict_operator":">","threshold_angstrom":4.0},"replica_count":5}',),
        ('{"input_checksums":{},"pose_id":"q","pruning":{"enabled":false,"strict_operator":">","threshold_angstrom":null},"replica_count":1}',)]


def test_utc_texts_sort_as_times(spark):
    data = spark.createDataFrame([("2026-01-01T00:00:00.500000Z",), ("2026-01-01T00:00:00Z",)], "t string")
    got = data.select(settings.utc_text(settings.parse_utc(F.col("t"))).alias("u"))
    assert rows(got, "u") == [("2026-01-01T00:00:00.000000Z",), ("2026-01-01T00:00:00.500000Z",)]


def test_audit_looks_at_every_text(spark):
    """The pattern's own case rules decide: a dotless i matches where they say so."""
    files = spark.createDataFrame([("a.md", ".md", "K\u0131 = 5")], "path string, suffix string, text string")
    found = audit.content_findings(files, audit.default_rules()).collect()
    assert [f.category for f in found] == ["restricted_release_metadata"]


def test_settings_texts_are_spread_by_rows(spark, sf, monkeypatch):
    from posewatch.plans import input_queries, standins

    assert input_queries.settings(spark, sf).rdd.getNumPartitions() == 1
    monkeypatch.setattr(standins, "SPREAD_ROWS", 50)
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    assert input_queries.settings(spark, sf).rdd.getNumPartitions() == -(-parts // 50)
    assert input_queries.include_texts(spark, sf).rdd.getNumPartitions() == -(-parts // 50)


def test_pose_key_reads_no_more_than_the_slug_needs(spark):
    import hashlib
    import random
    import re

    from posewatch.functions import identity

    draw = random.Random(5)
    texts = ["", "---", ".-. \n", "é" * 50, "a" * 41, "a" * 39 + "--b", "x" + "-" * 60 + "y", "-." * 30 + "b c"]
    texts += ["".join(draw.choices("ab_.- \n\u00e9\U0001f600", k=draw.randrange(120))) for _ in range(500)]
    keyed = spark.createDataFrame([(x,) for x in texts], "t string").select("t", identity.pose_key(F.col("t")).alias("k"))

    def slow(x):
        slug = re.sub(r"^[-.]+|[-.]+\Z", "", re.sub(r"[^A-Za-z0-9_.-]+", "-", x))
        return (re.sub(r"[-.]+\Z", "", slug[:40]) or "pose") + "--" + hashlib.sha256(x.encode()).hexdigest()

    assert all(r.k == slow(r.t) for r in keyed.collect())
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1 and plan.count("sha2") == 1
    label = spark.range(1).select(identity.safe_label(F.col("id").cast("string")).alias("label"))
    assert label._jdf.queryExecution().optimizedPlan().toString().count(identity.UNSAFE_RUN) == 1
