"""Ranks, packing and batches of whole tables against plain forms."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.operators import batching as B


@pytest.mark.parametrize("part_rows", [10, 1_000_000])
def test_ranks_are_whole_numbers_without_gaps(spark, part_rows):
    rng = random.Random(1)
    rows = [(k, rng.choice(["hot", "hot", "cold", None])) for k in range(300)] + [(7, "hot"), (None, "hot"), (None, None)]
    found = B.ranked(spark.createDataFrame(rows, "k long, g string").repartition(3), "g", "k", part_rows=part_rows).collect()
    by = defaultdict(list)
    for r in found:
        by[r.g].append(r["rank"])
    assert Counter((r.k, r.g) for r in found) == Counter(rows)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 50), max_size=40))
def test_patterns_use_each_item_once(counts):
    used, bins = Counter(), 0
    for chosen, times in B.patterns(counts, 100):
        assert times > 0 and sum(n * k for n, k in chosen) <= 100
        bins += times
        for n, k in chosen:
            used[n] += k * times
    assert used == Counter(counts)
    total = sum(n * c for n, c in counts.items())
    assert bins <= max(1, 2 * total / 100 + 1)
    slots = B.Slots(counts, 100)
    filled = Counter()
    for n, c in counts.items():
        import numpy as np

        for b in slots.bin_of(np.full(c, n), np.arange(c)).tolist():
            filled[b] += n
    assert slots.bins == bins and len(filled) == bins and all(v <= 100 for v in filled.values())


def test_work_does_not_grow_with_the_items():
    rng = random.Random(3)
    small = {n: rng.randint(1, 40) for n in range(5, 4097)}
    steps = [sum(1 for _ in B.patterns({n: c * k for n, c in small.items()}, 4096)) for k in (1, 1_000_000)]
    assert steps[1] < 3 * len(small)
    total = sum(n * c for n, c in small.items())
    assert sum(times for _, times in B.patterns(small, 4096)) <= 1.01 * -(-total // 4096)


def test_packing(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([3, 50, 50, 50, 99, 200, None, 0, -4, rng.randint(1, 100)])) for k in range(800)]
    found = B.packed_by_patterns(spark.createDataFrame(rows, "k long, n int").repartition(4), "k", "n", 100, part_rows=100).collect()
    assert sorted((r.k, r.n) for r in found) == sorted(rows, key=lambda r: r[0])
    bins = defaultdict(list)
    for r in found:
        bins[r.bin].append(max(1, r.n or 1))
    assert all(sum(v) <= 100 or len(v) == 1 for v in bins.values()) and set(bins) == set(range(len(bins)))
    assert len(bins) <= 1.01 * -(-sum(min(100, max(1, n or 1)) for _, n in rows) // 100) + 1
    assert B.packed_by_patterns(spark.createDataFrame([], "k long, n int"), "k", "n", 100).count() == 0


def test_buckets(spark):
    tops = spark.range(1, 5000).select("id", B.bucket_top(F.col("id")).alias("top")).collect()
    assert all(r.id <= r.top <= max(r.id * 2 ** (1 / B.STEPS) + 1e-6, r.id) for r in tops) and len({r.top for r in tops}) < 60


def test_batches(spark):
    rng = random.Random(4)
    rows = []
    for k in range(150):
        n = rng.choice([1, 5, 6, 7, 30, 64, 90])
        ids = [rng.choice([11, 12, 13, 50, 51]) for _ in range(n)]
        rows.append((k, ids, [-100 if x == 50 else x for x in ids], [list(range(n)), [0] * n, [2] * n]))
    frame = spark.createDataFrame(rows, "k long, ids array<int>, labels array<int>, positions array<array<int>>").repartition(3)
    queries, votes = {"current": 50, "replan": 51}, [60, 61, 62]
    found = B.collated(frame, "k", 128, 0, 80, queries, votes, seed=9, part_rows=20).collect()
    source, seen = {r[0]: r[1:] for r in rows}, []
    for r in found:
        longest = max(min(80, len(source[k][0])) for k in r["keys"])
        assert r.width == longest and (len(r["keys"]) * longest <= 128 or len(r["keys"]) == 1) and r["keys"] == sorted(r["keys"])
        seen += r["keys"]
        for k, got, labels, mask, positions, vote, current, replan in zip(r["keys"], r.input_ids, r.labels, r.attention_mask, r.position_ids, r.votes, r.current_place, r.replan_place):
            ids = source[k][0][:80]
            at = max((j for j, x in enumerate(ids) if x == 50), default=-1)
            want = [votes[vote] if j == at else x for j, x in enumerate(ids)] + [0] * (longest - len(ids))
            assert got == want and mask == [x != 0 for x in want] and labels == source[k][1][:80] + [-100] * (longest - len(ids))
            assert positions == [p[:80] + [1] * (longest - len(ids)) for p in source[k][2]]
            assert current == at and replan == max((j for j, x in enumerate(ids) if x == 51), default=-1) and (at >= 0 or vote == 0)
    assert sorted(seen) == list(range(150)) and len({v for r in found for v in r.votes}) == 3
    plain = B.collated(frame, "k", 128, 0, 80).first()
    assert "votes" not in plain.asDict() and "current_place" not in plain.asDict()
