"""Scores of the suffix tree against a plain tree, and a tree that does not shrink as the corpus grows."""

import collections
import math
import random
import time
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from given import docs, odd  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from posewatch import session
from posewatch.llm import suffix_tree as st


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def plain(rows):
    """Scores of (id, text) by a tree over dicts, as the head of the module states it."""
    cut = [(*brute.WORD.findall(brute.lower(t or "")), None) for _, t in rows]
    learned = [w for (i, _), w in zip(rows, cut, strict=True) if not held_out(i)]
    n = collections.Counter(w[j : j + k] for w in learned for k in range(1, st.DEPTH + 2) for j in range(len(w) - k + 1))
    words = collections.Counter(x for w in learned for x in w)
    places = sum(words.values()) + len(words) + 1
    after = collections.defaultdict(list)
    for g, c in n.items():
        if len(g) > 1 and c >= st.LEAST:
            after[g[:-1]].append(g[-1])
    weight, kept = {}, set()

    def chance(context, w, upto):
        out = (words[w] + 1) / places
        for k in range(1, min(len(context), upto) + 1):
            c = context[len(context) - k :]
            if c in kept:
                out = share(c, w) + weight[c] * out
        return out

    def share(c, w):
        return (n[(*c, w)] - st.DISCOUNT) / n[c] if n[(*c, w)] >= st.LEAST else 0.0

    for c in sorted(after, key=len):
        weight[c] = 1 - sum(share(c, w) for w in after[c])
        below = [chance(c, w, len(c) - 1) for w in after[c]]
        here = [share(c, w) + weight[c] * b for w, b in zip(after[c], below, strict=True)]
        gain = sum(h * math.log(h / b) for h, b in zip(here, below, strict=True))
        rest, rest_below = 1 - sum(here), 1 - sum(below)
        if rest > 1e-12 and rest_below > 1e-12:
            gain += rest * math.log(rest / rest_below)
        if gain >= st.DIVERGENCE:
            kept.add(c)
    return [sum(math.log10(chance(w[max(0, j - st.DEPTH) : j], w[j], st.DEPTH)) for j in range(len(w))) for w in cut]


@pytest.mark.parametrize("most, common", [(28, 1e-6), (15, 1e-3)])
def test_scores_of_a_plain_tree(docs, odd, monkeypatch, most, common):
    """Also with bitmaps that let much through, and with most values from the join."""
    monkeypatch.setattr(st, "MOST_BITS", most)
    monkeypatch.setattr(st, "COMMON", common)
    for df in (docs, odd):
        own = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        want = collections.Counter((i, round(x, 5)) for (i, _), x in zip(own, plain(own), strict=True))
        assert collections.Counter((r.doc_id, round(r.score, 5)) for r in st.score(df).collect()) == want


def test_rare_passages_are_learned_in_a_large_corpus(spark):
    """Thirty copies of a passage count as much beside 400,000 other tokens as beside 4,000."""
    passage = " ".join(f"p{j}" for j in range(40))
    draw = random.Random(5)
    gains = []
    for n in (10, 1000):
        rows = [(i, " ".join(f"w{draw.randrange(5000)}" for _ in range(400))) for i in range(n)]
        copies = [i for i in range(10_000, 10_100) if not held_out(i)][:30]
        new = next(i for i in range(20_000, 20_100) if held_out(i))
        df = spark.createDataFrame(rows + [(i, passage) for i in [*copies, new]], "doc_id long, text string")
        got = st.score(df).where(f"doc_id = {new}").first()
        gains.append(got.score / got.n_tokens)
    assert min(gains) > -0.5 and abs(gains[0] - gains[1]) < 0.1


def test_runs_are_linked_by_few_texts(spark):
    """A passage in 600 texts tells what its runs are made of from the texts of one class, not from all."""
    texts = [f"one passage that all have t{i}" for i in range(600)]
    df = spark.createDataFrame([(x,) for x in texts], "text string").repartition(4)

    def pairs(tok, begin):
        at = np.flatnonzero(st.places(begin, len(tok)) > 0)
        return at, st.run_keys(tok, at, 2)

    listed = st.counted(df, "text", pairs, "run-counts", st.LEAST)
    owners = st.bitmap(st.owned(listed))
    tok, begin = st.tokens(pa.array(texts))
    at, key = pairs(tok, begin)
    runs = {r.key for r in listed.collect()}
    mine = np.isin(key.view(np.int64), list(runs)) & owners.holds(st.marked(key, st.classes(tok, begin)[at]))
    assert len(runs) == 4 and set(key[mine].view(np.int64)) == runs
    assert mine.sum() < 4 * 600 / 20


def test_shuffles_are_removed(spark):
    """Shuffle files of a written table go with its query, not with the next collection of garbage."""
    statuses = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = statuses.size()
    with session.shuffles_removed(spark):
        session.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if statuses.size() <= before:
            break
        time.sleep(0.1)
    assert statuses.size() <= before
