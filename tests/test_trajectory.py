"""Trajectories against hand-made cases, items and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.operators import prep, trajectory
from quernel.streaming import twins


def episode(n, **columns):
    """Still frames with unit quaternions and the given slots."""
    out = np.zeros((n, 16))
    out[:, [3, 11]] = 1
    for slot, values in columns.items():
        out[:, int(slot[1:])] = values
    return out.tolist()


def frames(spark, *episodes):
    rows = [(e, f, list(map(float, s))) for e, states in enumerate(episodes) for f, s in enumerate(states)]
    return spark.createDataFrame(rows, "ep long, f long, state array<double>")


def spans(spark, rows):
    return spark.createDataFrame(rows, "ep long, idx long, start long, end long, left boolean, right boolean")


def test_progress(spark):
    linear = episode(11, s0=np.arange(11) / 10)
    grip = episode(6, s7=[1, 1, 0.7, 0.4, 0.1, 0])
    both = episode(6, s0=[0, 0.5, 1, 1, 1, 1], s7=[1, 1, 1, 0.5, 0, 0])
    still = episode(6)
    df = frames(spark, linear, grip, both, still)
    plan = spans(spark, [(0, 0, 0, 10, True, False), (1, 0, 0, 5, True, False), (2, 0, 0, 5, True, True), (3, 0, 0, 5, True, True)])
    got = {(r.ep, r.f): r.progress for r in trajectory.progress(df, plan).collect()}
    assert [got[0, f] for f in (0, 5, 10)] == pytest.approx([0, 0.5, 1])
    assert [got[1, f] for f in (2, 3)] == pytest.approx([0.3, 0.6])
    assert got[2, 3] == pytest.approx(0.75)
    assert got[3, 3] == pytest.approx(0.6)


def test_done_frames(spark):
    rows = spark.createDataFrame([(0, 0, f, 0, 5, p) for f, p in enumerate([0.0, 0.5, 0.995, 0.9, 0.996, 1.0])] + [(1, 0, f, 0, 2, p) for f, p in enumerate([0.0, 0.2, 0.3])], "ep long, idx long, f long, start long, end long, progress double")
    assert sorted((r.ep, r.f) for r in trajectory.done_frames(rows).collect()) == [(0, 4), (0, 5), (1, 2)]


def test_gripper_events(spark):
    left = [1, 1, 0.7, 0.4, 0.1, 0, 0, 0, 0, 0.5, 1, 1]
    right = [0.5, 0.6, 0.5, 0.6, 0.5, 0.6, 0.5, 0.6, 0.5, 0.6, 0.5, 0.6]
    got = trajectory.gripper_events(frames(spark, episode(12, s7=left, s15=right))).collect()
    assert sorted((r.arm, r.frame, r.kind, r.start_frame, r.end_frame) for r in got) == [("left", 3, "close", 1, 5), ("left", 9, "open", 8, 10)]


def test_motion_segments(spark):
    x = np.zeros(20)
    x[3:7] = np.arange(1, 5) * 0.01
    x[7:] = 0.04
    x[12:] += 0.02
    y = np.zeros(20)
    y[16:] = 0.02
    # the other arm begins within the idle gap, so the second run lasts until then
    got = trajectory.motion_segments(frames(spark, episode(20, s0=x, s8=y))).orderBy("start").collect()
    assert [(r.start, r.end, r.left, r.right) for r in got] == [(2, 7, True, False), (11, 15, True, False), (15, 17, False, True)]


def test_arm_motion(spark):
    df = frames(spark, episode(4, s0=[0, 0.1, 0.3, 0.3], s15=[0, 0.2, 0.7, 0.6]))
    r = trajectory.arm_motion(df, spans(spark, [(0, 0, 0, 3, True, True)])).first()
    assert (r.left_length, r.left_max_step, r.right_grip_range, r.right_grip_change) == pytest.approx((0.3, 0.2, 0.7, 0.6))
    assert r.right_crossed and not r.left_crossed


ITEM = "k int, image array<string>, video array<string>, conversations array<struct<`from`:string,value:string>>"


def test_items(spark):
    ask = lambda q, a="fine": [("human", q), ("gpt", a)]
    rows = [(1, ["a.png", "b.png"], ["v.mp4"], ask("<image> and <video> and <image>")), (2, ["a"], None, ask("<image><image>")), (3, ["a"], None, ask("none")), (4, None, None, ask("hi", "see <image>"))]
    df = spark.createDataFrame(rows, ITEM)
    got = {r.k: r.problems for r in prep.check_items(df).collect()}
    assert got[1] == [] and len(got[2]) == 1 and got[3] == ["unused image"] and got[4] == ["a mark in an answer"]
    bound = prep.bound_media(df.filter("k = 1"), "k").orderBy("pos").collect()
    assert [(r.kind, r.medium) for r in bound] == [("image", "a.png"), ("video", "v.mp4"), ("image", "b.png")]
    with pytest.raises(Exception, match="more image marks"):
        prep.bound_media(df.filter("k = 2"), "k").collect()


def brute_labels(ids, begin, end):
    out, at = [-100] * len(ids), 0
    while at < len(ids):
        if ids[at] == begin:
            stop = at + 2
            while stop < len(ids) and ids[stop] != end:
                stop += 1
            if stop < len(ids):
                out[at + 2 : stop + 2] = ids[at + 2 : stop + 2]
                at = stop
        at += 1
    return out


def test_labels_and_padding(spark):
    rng = np.random.default_rng(3)
    rows = [([1, 7, 9, 5, 6, 8, 4, 7, 9, 5, 5],), ([7],), ([],), ([7, 9, 8],), *(([int(x) for x in rng.choice([1, 2, 3, 8], 12)],) for _ in range(5))]
    df = spark.createDataFrame(rows, "ids array<int>")
    for r in df.select("ids", prep.answer_labels(F.col("ids"), 7, 8).alias("l"), prep.padded(F.col("ids"), 4, 0).alias("p")).collect():
        assert r.l == brute_labels(r.ids, 7, 8)
        assert r.p == (r.ids + [0] * 4)[:4]
    packs = spark.createDataFrame([(1, 0, [1, 2]), (1, 1, [3]), (2, 0, [4, 5, 6])], "pack int, pos int, ids array<int>")
    got = {r.pack: (r.ids, r.bounds) for r in prep.flattened(packs, "pack", "pos", "ids").collect()}
    assert got == {1: ([1, 2, 3], [0, 2, 3]), 2: ([4, 5, 6], [0, 3])}


def test_positions_and_mask(spark):
    ids = [1, 50, 50, 50, 50, 2, 3]
    got = prep.rope_positions(ids, 50, 60, [(1, 4, 4)], [])
    assert got.tolist() == [[0, 1, 1, 1, 1, 3, 4], [0, 1, 1, 2, 2, 3, 4], [0, 1, 2, 1, 2, 3, 4]]
    df = spark.createDataFrame([(ids, [[1, 4, 4]], [])], "ids array<int>, image_grids array<array<int>>, video_grids array<array<int>>")
    assert prep.with_rope(df, 50, 60).first().positions == got.tolist()
    mask = spark.createDataFrame([([5, 9, 6, 0],)], "ids array<int>").select(prep.query_mask(F.col("ids"), 0, [9]).alias("m")).first().m
    assert mask == [[True, False, False, False], [True, True, False, False], [True, False, True, False], [False] * 4]


def test_mixture(spark):
    df = spark.range(1000).withColumn("kind", F.when(F.col("id") % 4 == 0, "a").otherwise("b"))
    got = {r.kind: r["count"] for r in prep.mixture(df, {"a": 0.7, "b": 0.3}, "kind", 2000, 5, "id").groupBy("kind").count().collect()}
    assert got["a"] == pytest.approx(1400, rel=0.05) and got["b"] == pytest.approx(600, rel=0.1)


def test_streams(spark, tmp_path):
    rows = [(0, f"2024-01-01T00:00:{s:02d}", float(v)) for s, v in enumerate([0, 5, 9, 9, 4, 4, 4, 8, 8])] + [(0, "2024-01-01T05:00:00", 8.0)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"ep": e, "ts": t, "v": v, "rule": "r"}) for e, t, v in rows))
    source = spark.readStream.schema("ep long, ts timestamp, v double, rule string").json(str(tmp_path / "in"))

    def run(df, name):
        stream = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        return spark.table(name).collect()

    assert [(r.kind, r.change) for r in run(twins.signal_events(source, 0.5, 4.0), "signal_twin")] == [("open", 9.0), ("close", -5.0), ("open", 4.0)]
    assert [r.n for r in run(twins.segments(source), "segment_twin")] == [9]
    assert [r.n for r in run(twins.counts(source), "count_twin")] == [9]


def test_streams_end(spark, tmp_path):
    import os

    (tmp_path / "in").mkdir()
    batches = [[(0, f"2024-01-01T00:00:{s:02d}", float(3 * s)) for s in range(4)], [(1, "2024-01-02T00:00:00", 0.0)], [(1, "2024-01-03T00:00:00", 0.0)]]
    for k, rows in enumerate(batches):
        path = tmp_path / "in" / f"{k}.json"
        path.write_text("\n".join(json.dumps({"ep": e, "ts": t, "v": v}) for e, t, v in rows))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    source = spark.readStream.schema("ep long, ts timestamp, v double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    def run(df, name):
        stream = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        return spark.table(name).collect()

    # the run under way is given once the episode has ended
    assert [(r.ep, r.kind, r.change) for r in run(twins.signal_events(source, 0.5, 4.0, quiet=1000), "ended_twin")] == [(0, "open", 9.0)]
    got = sorted((r.ep, r.ts, r.window) for r in run(twins.memory(source, 3, 2), "memory_twin"))
    assert [w for e, _, w in got if e == 0] == [[0.0, 0.0, 0.0], [0.0, 0.0, 3.0], [0.0, 0.0, 6.0], [0.0, 3.0, 9.0]]


def test_labels_of_long_lists(spark):
    """Lists of 20,000 ids with thousands of marks; a place that looks through all answers takes minutes."""
    import time

    rng = np.random.default_rng(4)
    rows = [([int(x) for x in rng.choice([1, 2, 7, 8], n)],) for n in (20_000, 0, 3, 20_000)] + [(None,), ([7, 3, None, 8, 7],)]
    df = spark.createDataFrame(rows, "ids array<int>").coalesce(1)
    began = time.monotonic()
    got = df.select("ids", prep.answer_labels(F.col("ids"), 7, 8).alias("l")).collect()
    assert time.monotonic() - began < 60
    assert got[4].l is None and got[5].l == [-100, -100, None, 8, 7]
    for r in got[1:3]:
        assert r.l == brute_labels(r.ids, 7, 8)
    for r in (got[0], got[3]):
        nxt, inside = len(r.ids), [False] * (len(r.ids) + 2)
        ends = [0] * (len(r.ids) + 3)
        for i in range(len(r.ids) + 2, -1, -1):
            nxt = i if i < len(r.ids) and r.ids[i] == 8 else nxt
            ends[i] = nxt
        reach = -1
        for i, x in enumerate(r.ids):
            if i >= 2 and r.ids[i - 2] == 7 and ends[i] < len(r.ids):
                reach = max(reach, ends[i] + 1)
            inside[i] = i <= reach
        assert r.l == [x if inside[i] else -100 for i, x in enumerate(r.ids)]
