"""Groups, links and counts of two tokenizers against a plain version."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from given import docs, odd  # noqa: F401  (fixtures)
from tokenizers import Tokenizer

from posewatch.llm import alignment, queries
from posewatch.llm.bpe import byte_letters

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    left, right = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    left.encode_special_tokens = True
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    held = []
    for text in texts:
        text = text or ""
        e = left.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        b = []
        for i in right.encode(text) if text else []:
            p = right.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            held.append(None)
            continue
        sides = []
        for side in (a, b):
            ends, at = [], 0
            for _, x in side:
                at += len(x)
                ends.append(at)
            sides.append(ends)
        common = sorted(set(sides[0]) & set(sides[1]))
        groups, low = [], 0
        for end in common:
            groups.append([[t[0] for t, e in zip(s, ends, strict=True) if low < e <= end] for s, ends in zip((a, b), sides, strict=True)])
            low = end
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        held.append((len(a), len(b), groups, links))
    docs_of = Counter(pair for h in held if h for pair in h[3])
    top = Counter()
    for (x, _), n in docs_of.items():
        top[x] = max(top[x], n)
    out = []
    for h in held:
        if h is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = h
        best = sum(m for pair, m in links.items() if docs_of[pair] == top[pair[0]])
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), best, sum(m * docs_of[p] for p, m in links.items()), shown))
    return out


def test_whole_table(spark, sf, docs):
    given = docs.select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(given, plain([r.text for r in given]), strict=True)}
    got = queries.op13_alignment(spark, sf).collect()
    assert len(got) == len(given)
    for r in got:
        *n, shown = want[r.doc_id]
        digest = hashlib.sha256(shown.encode()).hexdigest() if shown else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (*n, digest)


@pytest.mark.parametrize(("chunk", "wide"), [(None, None), (40, 3)])
def test_odd_rows(spark, odd, monkeypatch, chunk, wide):
    if chunk:
        monkeypatch.setattr(alignment, "CHUNK_TOKENS", chunk)
        monkeypatch.setattr(alignment, "WIDE", wide)
    extra = ["▁under▁score", "a\x00b", "  two  spaces ", "tab\tand\r\nline", "<s> </s> <unk> <0x41> <|endoftext|>", "漢字" * 40, "ααβγ€" * 9]
    more = spark.createDataFrame([(100 + i, t, "en", 1) for i, t in enumerate(extra)], odd.schema)
    rows = odd.unionByName(more)
    given = rows.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(given, plain([r.text for r in given]), strict=True))
    shared = rows.repartition(3).withColumnRenamed("spans", "chunk")
    got = alignment.align(shared, *PATHS)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert Counter(tuple(r) for r in got.select(*names).collect()) == want
    assert alignment.align(odd.limit(0), *PATHS).count() == 0


def test_packed_numbers():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**34 + 5])
    parts = alignment.packed(x, np.array([0, 3, 3, 9]))
    assert [alignment.unpacked(p).tolist() for p in parts] == [x[:3].tolist(), [], x[3:].tolist()]
