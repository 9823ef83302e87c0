"""Divergence of sources against a plain version, also with colliding digests."""

import re
from collections import Counter, defaultdict

import pytest
from brute import lower
from given import docs, odd  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from posewatch.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs, top):
    n, docs_of = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall(lower(text or ""))
        n[lang or "", source or ""].update(words)
        docs_of[lang or ""].update(set(words))
    out = []
    for lang in docs_of:
        kept = [t for t, d in docs_of[lang].items() if d >= min_docs]
        groups = {s: c for (x, s), c in n.items() if x == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, k + 1) for k, x in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def both(df, min_docs, top, **more):
    want = plain([tuple(r) for r in df.select("text", "lang", "source").collect()], min_docs, top)
    got = divergence.audit(df, min_docs=min_docs, top=top, **more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == want
    return want


@pytest.fixture(scope="module")
def few(odd):
    source = F.when(F.col("spans") % 4 > 0, F.concat(F.lit("s"), F.col("spans") % 4))
    return odd.withColumn("source", source).withColumn("digest", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)


@pytest.mark.parametrize(("bits", "held"), [(64, None), (4, None), (64, 1), (3, 1)])
def test_odd_rows(few, monkeypatch, bits, held):
    if held:
        monkeypatch.setattr(divergence, "HELD", held)
    assert both(few, 2, 3, digest_bits=bits)


def test_documents_with_colliding_digests(docs):
    sample = docs.select("text", "lang", "source")
    assert len(both(sample, 5, 50, digest_bits=10)) > 1000


def test_ties_empty_table_and_no_kept_terms(spark, few):
    rows = [(f"a{c} b{c} é{c} ab".replace("1", "x").replace("2", "y"), "en", f"s{c % 3}") for c in range(9)] + [("", "fr", None)]
    both(spark.createDataFrame(rows, "text string, lang string, source string"), 2, 2)
    none = both(few, 10_000, 5)
    assert {x[2] for x in none} == {"pair"} and {x[4] for x in none} == {0}
    assert divergence.audit(few.limit(0)).count() == 0
