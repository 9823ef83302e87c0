"""Operators over whole tables, against plain versions."""

import collections
import math
import zlib

import brute
import numpy as np
import pytest
from given import docs, odd  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from posewatch.llm import (
    anchors, decontaminate, jaccard_join, licenses, queries, relative_lz, suffix_array, suffix_tree, warc,
)


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def mixed(spark):
    """Shared passages, overlapping repeats, near copies, short, empty and null texts."""
    base = [" ".join(f"w{i}x{(j * j + i) % 97}" for j in range(120)) for i in range(6)]
    rows = list(enumerate(base))
    rows += [(10 + i, f"head {i} " + base[0][40:600] + f" tail {i}") for i in range(8)]
    rows += [(30, "ab " * 400), (31, "ab " * 400), (32, "x" * 350), (33, "é" * 120), (34, ""), (35, None), (36, "one two")]
    rows += [(40 + i, base[1].replace("w1x5 ", f"new{i} ", 1)) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("n", F.lit(2))


def pairs_of(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("shard", [None, 1500])
def test_suffix_arrays(docs, mixed, shard):
    for df in (mixed,) if shard else (docs, mixed):
        got = suffix_array.deduplicate(df, **({"shard": shard} if shard else {})).collect()
        found = {(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), brute.sha(r.kept)) for r in got}
        assert found == set(brute.repeated_bytes(pairs_of(df))) and len(got) == df.count()


@pytest.mark.parametrize("shard", [None, 200])
def test_relative_lz(docs, mixed, shard):
    for df in (mixed,) if shard else (docs, mixed):
        got = relative_lz.deduplicate(df, **({"shard": shard} if shard else {})).collect()
        found = {(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), brute.sha(r.kept)) for r in got}
        assert found == set(brute.repeated_windows(pairs_of(df))) and len(got) == df.count()


@pytest.mark.parametrize("held", [None, 0])
def test_repeated_rows_of_long_texts(spark, monkeypatch, held):
    """A row that comes again is the same place, whichever tasks read its copies."""
    if held is not None:
        monkeypatch.setattr(anchors, "HELD", held)
    alone, shared = (" ".join(f"{c}{j}x{j * j % 89}" for j in range(90)) for c in "uv")
    texts = [(1, alone), (2, shared), (3, f"head {shared} tail"), (4, shared)]
    times = {1: 4, 2: 3, 3: 1, 4: 2}
    for parts in (1, 6):
        again = [r for r in texts for _ in range(times[r[0]])]
        df = spark.createDataFrame(spark.sparkContext.parallelize(again, parts), "doc_id long, text string")
        got = suffix_array.deduplicate(df).collect()
        found = collections.Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), brute.sha(r.kept)) for r in got)
        assert found == {r: times[r[0]] for r in brute.repeated_bytes(texts)}
        got = relative_lz.deduplicate(df).collect()
        found = collections.Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), brute.sha(r.kept)) for r in got)
        assert found == {r: times[r[0]] for r in brute.repeated_windows(texts)}


def test_suffix_array_order():
    text = np.frombuffer(b"banana\x00ananas\x00banana\x01\x00", np.uint8)
    order = suffix_array.suffix_array(text)
    want = sorted(range(len(text)), key=lambda i: text[i:].tobytes())
    assert order.tolist() == want


def test_jaccard(docs, mixed):
    for df in (docs, mixed):
        got = {tuple(r) for r in jaccard_join.link(df).collect()}
        assert got == set(brute.components(pairs_of(df)))


def test_jaccard_parts(mixed, monkeypatch):
    # Lists cut into parts, and one leader only: the later rounds do the rest.
    monkeypatch.setattr(jaccard_join, "LIST", 3)
    got = {tuple(r) for r in jaccard_join.link(mixed).collect()}
    assert got == set(brute.components(pairs_of(mixed)))


def test_decontaminate_short_items_and_nulls(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, item), (2, "Short Item here"), (3, None), (4, "..."), (1, item)], "item_id long, text string")
    texts = ["x " + item[:59].upper() + " y", "short item here! short item", item[6:], None, "", "alpha beta gamma", "Épsilon épsilon"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, item, "c")], "doc_id long, text string, item string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.scan(df, items).collect()}
    assert got[None] == (12, 12, ["1"]) and got[1] == (5, 3, ["2"]) and got[2][1:] == (11, ["1"])
    assert got[3] == (0, 0, []) and got[5] == (3, 0, []) and got[6] == (2, 0, []) and got[0][1] >= 10
    assert {r.doc_id for r in decontaminate.clean(df, items).collect()} == {3, 4, 5, 6}
    assert decontaminate.scan(df, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.scan(df.limit(0), items).count() == 0


def test_licences(spark):
    files = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c.py", "print(1)"),
        ("a/b/d.py", "# Released under the MIT License.\nx"), ("z/e.py", None), ("f.py", ""), ("a/b2/g.py", "y"),
    ]
    df = spark.createDataFrame([(p, p, t) for p, t in files], "key string, path string, text string")
    got = {r.path: (r.license, r.origin) for r in licenses.scan(df, licenses.templates(spark), "key", F.col("path")).collect()}
    assert got["a/LICENSE"] == ("Apache-2.0", None) and got["a/b/d.py"] == ("MIT", None)
    assert got["a/b/c.py"] == ("MIT", "a/b") and got["a/b2/g.py"] == ("Apache-2.0", "a")
    assert got["z/e.py"] == (None, None) == got["f.py"]


def test_suffix_tree(docs, odd, rows):
    for df in (docs, odd):
        own = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        cut = [brute.WORD.findall(brute.lower(t or "")) + [None] for _, t in own]
        held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in own]
        c = collections.Counter(x for w, h in zip(cut, held, strict=True) if not h for x in w)
        total, places = sum(c.values()), sum(c.values()) + len(c) + 1
        want = collections.Counter(
            (i, h, len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 1) / places) for x in w), 5))
            for (i, _), w, h in zip(own, cut, held, strict=True)
        )
        got = suffix_tree.score(df).collect()
        assert collections.Counter((*r[:5], round(r.base_score, 5)) for r in got) == want
    scored = suffix_tree.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert scored[0] > scored[1]  # the contexts help on text that was not learned


def test_suffix_tree_chances_add_up(docs):
    model, _ = suffix_tree.train(docs, "text")
    n = len(model.word)
    assert n == model.distinct  # all words are frequent in so small a corpus
    for depth, level in enumerate(model.levels, 1):
        for state in np.flatnonzero(level.kept)[:5]:
            chance = model.root(model.count.astype(float))
            unknown = np.array([1 / model.places])
            for lower in model.levels[:depth]:
                tail = level.words[state : state + 1, depth - lower.words.shape[1] :]
                at = suffix_tree.find(lower.hash, suffix_tree.words.mix(suffix_tree.folded(tail)))
                chance = suffix_tree.stepped(lower, np.repeat(at, n), np.arange(n), chance)
                unknown = suffix_tree.stepped(lower, at, np.array([-1]), unknown)
            assert abs(chance.sum() + unknown[0] - 1) < 1e-9


@pytest.mark.parametrize("split", [37, 1 << 20])
def test_warc_round_trip(spark, split):
    body = "<p>" + "same payload é " * 100
    pages = [(1, "http://a/ b\n", body), (2, "http://b", body), (3, None, body), (4, "u", None), (5, "u", "small"), (6, "u", "small")]
    pages += [(None, "u", "\x1f\x8b\x08 WARC/1.1 " * 200), (7, "u", "z" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    archives = warc.archive(df)
    got = {r.page_id: r for r in warc.read(archives, split=split).collect()}
    assert len(got) == len(pages) == warc.read(archives, split=split).count() and all(r.intact for r in got.values())
    for i, _, html in pages:
        r, b = got[i], (html or "").encode()
        assert r.payload_bytes == len(b) and (r.payload is None or bytes(r.payload) == b)
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 3, 5, 6)] == [
        ("revisit", 3), ("revisit", 3), ("response", None), ("response", None), ("response", None)]
    assert warc.read(warc.archive(df.limit(0))).count() == 0


def test_empty_tables(docs):
    none = docs.limit(0)
    for f in (suffix_array.deduplicate, relative_lz.deduplicate, jaccard_join.link, suffix_tree.score):
        assert f(none).count() == 0


def test_odd_rows(odd):
    n = odd.count()
    for f in (suffix_array.deduplicate, relative_lz.deduplicate, jaccard_join.link, suffix_tree.score):
        assert f(odd).count() == n


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.keep_good(spark, docs, sf)
    bad = {r.doc_id for r in docs.collect() if (q := brute.quality(r.text or ""))[0] < 20 or 100 * q[4] > 30 * q[0]}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad  # too few labels for more
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    distinct = {i for i, _, first in brute.components(rows) if i == first}
    assert {r.doc_id for r in corpus_pipeline.keep_distinct(spark, kept, sf).collect()} == distinct
    out = corpus_pipeline.run(spark, sf)
    assert out.count() <= len(distinct) and set(out.columns) == {"doc_id", "ids", "decoded"}
    for stage in (corpus_pipeline.keep_uncontaminated, corpus_pipeline.redact_secrets):
        assert stage(spark, docs, sf).columns == docs.columns


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_rows_with_null_and_repeated_ids(spark, sf):
    """Verdicts, links and what stays go by row, not by id."""
    import corpus_pipeline

    good, other = (" ".join(f"{c}{j}{'aeiou'[j * j % 5]}" for j in range(60)) for c in "mv")
    near, bad = f"{good} tail", "bad"
    rows = [(5, good), (None, near), (None, bad), (None, other), (None, other), (3, other + " x y z w v u t s"), (3, bad), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(
        "*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    kept = corpus_pipeline.keep_good(spark, docs.repartition(3), sf)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted((i or 0, t) for i, t in rows if len(t) > 3)
    assert kept.columns == docs.columns
    linked = collections.Counter((r.doc_id, r.component) for r in jaccard_join.link(docs).collect())
    assert linked[None, 5] == 1 and linked[5, 5] == 1
    stays = corpus_pipeline.keep_distinct(spark, kept, sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in stays) == [(0, other), (3, rows[5][1]), (5, good)]
    same = corpus_pipeline.keep_distinct(spark, docs.where("doc_id IS NULL").unionByName(docs.where("doc_id IS NULL")), sf)
    assert sorted(r.text for r in same.collect()) == sorted([near, bad, other])


@pytest.mark.parametrize("copies", [1, 40])
def test_license_lines_weigh_every_word_by_its_files(spark, copies):
    import math
    import re
    from collections import Counter

    texts = ["This file is released under the MIT License.", "this file is long\nand this file is plain"]
    texts += [f"this file is number {i}, all rights kept" for i in range(60 * copies)] + ["ALL rights reserved here"]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {r.key: (r.license, r.similarity) for r in licenses.declared(df, licenses.templates(spark), 0.5).collect()}
    split = lambda x: re.findall("[a-z]+|[0-9]+", x.lower())
    seen = Counter(w for x in texts for w in set(split(x)))

    def vector(x):
        return {w: n * (math.log((len(texts) + 1) / (seen[w] + 1)) + 1) for w, n in Counter(split(x)).items()}

    def cosine(a, b):
        length = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / length

    wanted = {}
    for key, text in enumerate(texts):
        found = [(round(cosine(vector(line), vector(t)), 9), name) for line in text.split("\n") for name, t in licenses.TEMPLATES if split(line)]
        if max(found)[0] >= 0.5:
            wanted[key] = max(found)[::-1]
    assert got.keys() == wanted.keys() and 0 in got
    for key, (name, similarity) in wanted.items():
        assert got[key][0] == name and got[key][1] == pytest.approx(similarity, abs=2e-9)
