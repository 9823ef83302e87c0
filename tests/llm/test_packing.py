"""Bin completion against exact search, and whole packings against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from given import docs, odd  # noqa: F401  (fixtures)
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from posewatch.llm import bin_completion, byte_tokens, packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {x for x in bins if x + items[i] <= capacity}:
            j = bins.index(room)
            go(i + 1, [*bins[:j], room + items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def bins_of(solution, counts, capacity):
    given = Counter()
    for n, pattern in solution:
        assert n > 0 and sum(a * b for a, b in pattern) <= capacity
        for length, times in pattern:
            given[length] += n * times
    assert given == Counter(counts)
    return sum(n for n, _ in solution)


def test_fewest_bins_on_small_instances():
    draw, improved = random.Random(5), 0
    for k in range(600):
        capacity = draw.choice([10, 17, 30, 60])
        items = [draw.randint(max(1, capacity // 8) if k % 2 else 1, capacity) for _ in range(draw.randint(0, 11))]
        counts = dict(Counter(items))
        got = bins_of(bin_completion.solve(counts, capacity), counts, capacity)
        assert got == fewest(items, capacity) >= bin_completion.lower_bound(counts, capacity)
        improved += got < bins_of(bin_completion.best_fit(counts, capacity), counts, capacity)
    assert improved


def test_many_pieces_close_to_the_bound():
    lengths = np.clip(np.random.default_rng(3).lognormal(5.9, 0.9, 50_000).astype(int), 2, 1024)
    counts = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True), strict=True)}
    solution = bin_completion.solve(counts, 1024)
    got = bins_of(solution, counts, 1024)
    assert got <= bin_completion.lower_bound(counts, 1024) + 10 and len(solution) < 2048
    with pytest.raises(ValueError):
        bin_completion.solve({1025: 1}, 1024)


def test_fillings():
    assert bin_completion.dominated(((3, 1), (4, 1)), 0, 1 << 7)  # 3 and 4 make room for 7
    assert bin_completion.dominated(((3, 1),), 2, 1 << 5)
    assert not bin_completion.dominated(((7, 1),), 0, 1 << 3 | 1 << 4)
    counts = [0, 2, 1, 1]
    sums = bin_completion.reachable([1, 2, 3], counts, 5)
    found = list(bin_completion.with_sum(4, [1, 2, 3], counts, sums))
    assert sorted(found) == [((2, 1), (1, 2)), ((3, 1), (1, 1))] and found[0][0] == (3, 1)


def whole(placed, capacity, end_id=2):
    """Check that the pieces make up the texts and fill sequences without gaps."""
    spelled = Tokenizer.from_file(PATH)
    rows = placed.collect()
    room = defaultdict(list)
    for r in rows:
        room[r.sequence_id].append((r.offset, r.length))
    for pieces in room.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    texts = Counter()
    for r in rows:
        if r.piece == 0:
            texts[r.doc_id] += 1
    return rows, room, texts, lambda t: [*spelled.encode(t or "", add_special_tokens=False).ids, end_id]


def test_whole_table(spark, sf, docs):
    rows, room, _, ids_of = whole(queries.op12_packing(spark, sf), 1024)
    given = {r.doc_id: ids_of(r.text) for r in docs.select("doc_id", "text").collect()}
    seen = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        ids = given[r.doc_id]
        assert r.start == seen[r.doc_id] and (r.length == 1024 or r.piece == 0)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] += r.length
    assert {k: len(v) for k, v in given.items()} == dict(seen)
    assert all(r.piece == 0 for r in rows if len(given[r.doc_id]) <= 1024)
    assert len(room) <= -(-sum(seen.values()) // 1024) + 2


@pytest.mark.parametrize("capacity", [7, 1024])
def test_odd_rows(spark, odd, capacity):
    packed = packing.pack(odd.repartition(5), PATH, capacity)
    rows, room, texts, ids_of = whole(packed, capacity)
    assert texts == Counter(r.doc_id for r in odd.collect())
    joined = Counter()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(np.frombuffer(r.ids, "<u4").tolist())
        assert len(r.ids) == 4 * r.length
    for r in odd.collect():
        joined[r.doc_id] += len(ids_of(r.text))
    assert {k: sum(map(len, v)) for k, v in by_doc.items()} == dict(joined)
    once = {r.doc_id: ids_of(r.text) for r in odd.where("doc_id not in (3, 5)").collect()}
    for key, ids in once.items():
        own = sorted((r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows if r.doc_id == key)
        assert sum((x for _, x in own), []) == ids
    filled = packing.sequences(packed).collect()
    assert {r.sequence_id: r.n_tokens for r in filled} == {k: sum(n for _, n in v) for k, v in room.items()}
    assert all(len(r.ids) == 4 * r.n_tokens for r in filled)


def test_no_rows_and_clashing_columns(spark, odd):
    assert packing.pack(odd.limit(0), PATH).count() == 0
    clash = odd.withColumn("length", F.lit("x")).withColumn("part", F.lit(1)).withColumn("number", F.lit(None))
    assert packing.pack(clash, PATH).count() == packing.pack(odd, PATH).count()


def test_both_libraries_agree_on_all_code_points():
    both = byte_tokens.load(PATH, True)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}1{chr(c)} {chr(c)}" for c in points[at : at + 50_000]]
        want = [e.ids for e in both.slow.encode_batch(texts, add_special_tokens=False)]
        assert [both.encode(t).tolist() for t in texts] == want
    for text in ["x" * 150_000, " " * 2_000_000 + "a", "<|endoftext|>\n<|endoftext|> <|endof"]:
        assert both.encode(text).tolist() == both.slow.encode(text, add_special_tokens=False).ids
