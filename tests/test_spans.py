"""Spans from steps, events and motion: golden cases in one walk each, and tables of many episodes at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.functions import goals as G
from quernel.operators import spans as S


def still(n):
    return np.zeros((n, 16))


def ramp(states, first, last, column, low, high):
    states[first:last, column] = np.linspace(low, high, last - first)
    return states


def event(frame, arm, kind, start=None, end=None):
    return S.Event(frame, arm, kind, frame if start is None else start, frame if end is None else end)


def ends(spans):
    return [(s["start"], s["end"]) for s in spans]


GRASP = [S.Step("Move to the grasp pose of the block.", "move", "left"), S.Step("Close the gripper.", "close", "left")]
PLACE = [S.Step("Move to the place pose of the block on the pad.", "move", "left"), S.Step("Open the gripper.", "open", "left")]


def test_events_end_spans():
    steps = [S.Step("Grasp the block.", "close", "left"), S.Step("Place the block on the pad.", "open", "left")]
    got = S.fine_spans(steps, [event(10, "left", "close"), event(30, "left", "open")], 50)
    assert ends(got) == [(0, 29), (30, 49)]
    assert [(s["source"], s["subtask_type"], s["rule"]) for s in got] == [("before_gripper_left_open", "close", "gripper_open"), ("episode_end", "open", "episode_end")]
    assert got[0]["goal"] == "Grasp the block with the left arm."
    got = S.fine_spans(GRASP + PLACE, [event(10, "left", "close"), event(30, "left", "open")], 50)
    assert ends(got) == [(0, 9), (10, 29), (30, 49)] and [s["source"] for s in got] == ["before_gripper_left_close", "before_gripper_left_open", "episode_end"]
    assert [s["goal"] for s in got][:2] == ["Move the left arm to the grasp pose of the block.", "Close the gripper of the left arm."]
    with pytest.raises(ValueError):
        S.fine_spans([], [], 0)


def test_motion_ends_spans():
    states = ramp(ramp(still(20), 0, 9, 0, 0, 0.08), 16, 20, 0, 0.1, 0.2)
    got = S.fine_spans([*GRASP, S.Step("Lift the block.", "final", "left")], [event(11, "left", "close", 10, 12)], 20, states)
    assert ends(got) == [(0, 9), (10, 15), (16, 19)]
    drift = still(30)
    drift[14, 0] = 0.00002
    got = S.fine_spans([S.Step("Close the gripper of the left arm.", "close", "left"), S.Step("Lift the object with the left arm.", "move", "left")], [event(8, "left", "close", 5, 10)], 30, drift)
    assert ends(got) == [(0, 29)] and got[0]["source"] == "episode_end"
    minor = still(40)
    minor[18:21, 8] = [0.003, 0.006, 0.009]
    steps = [S.Step("Move the left arm to the grasp pose of the block.", "move", "left"), S.Step("Close the gripper of the left arm.", "close", "left"), S.Step("Lift the block with the left arm.", "move", "left")]
    got = S.fine_spans(steps, [event(22, "left", "close", 22, 24)], 40, minor)
    assert (got[0]["end"], got[0]["source"]) == (21, "before_gripper_left_close")


def test_press_ends_with_the_rise():
    states = still(8)
    states[:, 2] = [0.4, 0.3, 0.2, 0.05, 0.1, 0.2, 0.3, 0.4]
    after = S.Step("Lift up the left arm after pressing.", "move", "left")
    assert ends(S.fine_spans([S.Step("Press the button with the left arm.", "press", "left"), after], [], 8, states)) == [(0, 7)]
    got = S.fine_spans([S.Step("Press the button with the left arm.", "press", "left", ("press_lift",)), after], [], 8, states)
    assert ends(got) == [(0, 3), (4, 7)] and (got[0]["source"], got[0]["rule"]) == ("before_eef_left_z_increase", "press_lift")


def both_lift():
    states = still(40)
    for z in (2, 10):
        ramp(states, 10, 21, z, 0, 0.12)
        states[21:, z] = 0.12
    return ramp(states, 26, 40, 8, 0, 0.1)


def test_motion_of_both_breaks():
    steps = [
        S.Step("Close the grippers of both arms.", "close"), S.Step("Lift both objects to about 10 cm above the table with both arms.", "move"),
        S.Step("Move the right arm to the place pose.", "move", "right"), S.Step("Open the gripper of the right arm.", "open", "right"),
    ]
    got = S.fine_spans(steps, [event(9, "left", "close"), event(9, "right", "close"), event(35, "right", "open")], 40, both_lift())
    assert ends(got) == [(0, 10), (11, 26), (27, 34), (35, 39)]
    assert [(s["subtask_type"], s["source"]) for s in got[1:3]] == [("dual_move", "before_eef_right_motion"), ("move", "before_gripper_right_open")]
    motion = S.Motion(both_lift())
    assert motion.breaks("right", 11, 39) == 27
    assert motion.settles(0, 39) == 20 and S.Motion(still(40)).settles(0, 39) is None
    together = ramp(ramp(still(40), 10, 30, 2, 0, 0.2), 10, 30, 10, 0, 0.2)
    assert S.Motion(together).breaks("right", 11, 39) is None


def test_searches_against_loops():
    rng = np.random.default_rng(3)
    for _ in range(60):
        on = rng.random(rng.integers(1, 30)) < 0.6
        first, last, length = int(rng.integers(0, 12)), int(rng.integers(0, 35)), int(rng.integers(1, 4))
        want = next((f for f in range(first, min(last, len(on) - 1) + 1) if f + length - 1 <= min(last, len(on) - 1) and all(on[f : f + length])), None)
        assert S.Motion.first_run(on, first, last, length) == want


def test_passes_over_spans():
    span = lambda goal, source="x", kind="move", a=0, b=9: {"goal": goal, "source": source, "subtask_type": kind, "start": a, "end": b, "rule": "r", "gap_fill": None}
    assert S.arms_named([span("Close the gripper of the right arm.", "before_gripper_left_open")])[0]["goal"] == "Close the gripper of the right arm."
    got = S.arms_named([span("Grasp the can with the first arm.", "before_gripper_left_close"), span("Grasp it.", "before_gripper_right_close"), span("Give it from the first arm to the receiving arm.")])
    assert got[-1]["goal"] == "Give it from the left arm to the right arm."
    got = S.retreats_merged([span("Open the gripper of the left arm.", kind="open"), span("Return the left arm.", "episode_end", b=19)])
    assert len(got) == 1 and got[0]["goal"] == "Open the gripper of the left arm while return the left arm." and (got[0]["end"], got[0]["source"]) == (19, "episode_end")
    moving = S.Motion(ramp(ramp(still(10), 0, 10, 0, 0, 0.1), 0, 10, 8, 0, 0.09))
    assert S.others_told([span("Move the left arm to the grasp pose.")], moving)[0]["goal"] == "Move the left arm to the grasp pose while returning the right arm to a neutral pose."
    assert S.others_told([span("Lift the left arm.")], moving)[0]["goal"] == "Lift the left arm while moving the right arm."
    tiny = S.tiny_retreat_merged([span("Open the gripper of the left arm.", kind="open"), span("Lift the left arm after releasing the can.", "episode_end", a=10, b=12)], S.Motion(still(13)))
    assert len(tiny) == 1 and tiny[0]["end"] == 12
    switched = S.switches_told([span("Open.", "before_gripper_left_open"), span("Grasp the cup with the right arm.", "before_gripper_right_close")], True)
    assert switched[1]["goal"] == "Return the left arm to a neutral pose while grasping the cup with the right arm."
    first = S.first_place_of_both([span("Move the left arm to the place pose of the shoe.")], moving, "place_dual_shoes")[0]
    assert first["subtask_type"] == "dual_move" and first["goal"].endswith("while moving the right arm aside.")


COARSE = {
    # states, steps, events; then types, ends and fills
    "grasp": (ramp(still(40), 5, 16, 0, 0, 0.1), [S.Step("Grasp the block with the left arm.", "close", "left")], [event(18, "left", "close", 17, 20)], ["single_grasp"], (0, 20), "extended_to_episode_start"),
    "waiting": (ramp(still(35), 8, 18, 0, 0, 0.1), [S.Step("Move the left arm.", "move", "left")], [event(3, "left", "close", 2, 4)], ["single_move"], (0, 34), "extended_to_episode_start"),
    "both": (
        ramp(ramp(still(40), 5, 16, 0, 0, 0.1), 5, 16, 8, 0, 0.1), [S.Step("Place both objects with both arms.", "open")],
        [event(18, "left", "open", 17, 20), event(19, "right", "open", 18, 21)], ["dual_place"], (0, 21), "extended_to_episode_start",
    ),
    "handed": (
        ramp(ramp(ramp(ramp(still(50), 5, 11, 0, 0, 0.05), 11, 18, 0, 0.05, 0.1), 11, 18, 8, 0, 0.05), 18, 26, 8, 0.05, 0.15),
        [S.Step("Grasp the green block with the right arm.", "close", "right")], [event(28, "right", "close", 27, 30)], ["single_grasp"], (0, 30), "extended_to_episode_start",
    ),
    "left_open": (
        ramp(ramp(still(50), 5, 12, 0, 0, 0.1), 24, 32, 0, 0.1, 0.2),
        [S.Step("Place the block on the pad with the left arm.", "open", "left"), S.Step("Move the left arm to a safe pose.", "move", "left")],
        [event(15, "left", "open", 14, 16)], ["single_place"], (0, 49), "extended_to_next_subtask_start",
    ),
    "lifted": (
        ramp(ramp(still(50), 5, 12, 0, 0, 0.1), 24, 32, 2, 0, 0.2),
        [S.Step("Grasp the block with the left arm.", "close", "left"), S.Step("Lift the block with the left arm.", "move", "left")],
        [event(15, "left", "close", 14, 16)], ["single_grasp", "single_move"], (0, 23), "extended_to_next_subtask_start",
    ),
    "handover": (
        ramp(ramp(ramp(still(40), 5, 13, 0, 0, 0.08), 5, 13, 8, 0, 0.08), 16, 24, 8, 0.08, 0.2),
        [S.Step("Open the gripper of the left arm to release the bottle.", "handover", "right"), S.Step("Move the right arm to drop the bottle into the dustbin.", "open", "right")],
        [event(10, "left", "open", 9, 12), event(25, "right", "open", 24, 27)], ["handover"], (0, 27), None,
    ),
}


@pytest.fixture(scope="module")
def tables(spark):
    frames = [(ep, k, row.tolist()) for ep, case in COARSE.items() for k, row in enumerate(case[0])]
    events = [(ep, e.arm, e.kind, e.frame, e.start, e.end) for ep, case in COARSE.items() for e in case[2]]
    steps = [(ep, k, s.text, s.kind, s.arm, list(s.ends)) for ep, case in COARSE.items() for k, s in enumerate(case[1])]
    return (
        spark.createDataFrame(frames, "ep string, f long, state array<double>").repartition(3),
        spark.createDataFrame(events, "ep string, arm string, kind string, frame long, start_frame long, end_frame long"),
        spark.createDataFrame(steps, "ep string, pos int, text string, kind string, arm string, ends array<string>"),
    )


def test_coarse_spans(tables):
    got: dict = {}
    for r in S.assign_coarse(*tables).orderBy("ep", "idx").collect():
        got.setdefault(r.ep, []).append(r)
    for ep, (*_, types, span, fill) in COARSE.items():
        assert [r.subtask_type for r in got[ep]] == types, ep
        assert (got[ep][0].start, got[ep][0].end) == span, (ep, got[ep])
        if fill == "extended_to_episode_start":
            assert got[ep][0].gap_fill == fill, ep
    assert "while" not in got["left_open"][0].goal.lower()
    assert got["lifted"][1].end == 49 and "while move the right arm to drop the bottle" in got["handover"][0].goal.lower()


def test_fine_tables(spark, tables):
    slugs = spark.createDataFrame([(ep, "stack_blocks_two") for ep in COARSE], "ep string, slug string")
    rows = S.assign(*tables, slugs=slugs, retreat_tasks=("stack_blocks_two",)).orderBy("ep", "idx").collect()
    for ep, (states, steps, events, *_) in COARSE.items():
        want = S.tiny_retreat_merged(S.fine_spans(steps, events, len(states), states), S.Motion(states))
        assert [(r.start, r.end, r.source) for r in rows if r.ep == ep] == [(s["start"], s["end"], s["source"]) for s in S.switches_told(want, True)]
    frames, events, steps = tables
    assert S.assign(frames.filter("false"), events, steps).count() == 0
    assert S.assign(frames, events.filter("false"), steps.filter("false")).count() == 0


def test_upcoming(spark, tables):
    points = spark.createDataFrame([("left_open", 0, 0), ("left_open", 15, 3), ("handover", 9, 12), ("handover", 10, 11), ("none", 1, 1)], "ep string, f long, start long")
    got = {(r.ep, r.f): (r.frame, r.source) for r in S.upcoming(points, tables[1], kinds=["open"]).collect()}
    assert got == {("left_open", 0): (13, "before_gripper_left_open"), ("left_open", 15): (None, None), ("handover", 9): (11, "before_gripper_left_open"), ("handover", 10): (23, "before_gripper_right_open"), ("none", 1): (None, None)}


TEXTS = [
    "Move to the pad.", "Open the gripper.", "Close the gripper.", "Lift it with the left arm.", "Lift both objects.", "Move the left arm while moving the right arm.", "Grasp with the RIGHT arm",
    "Open the gripper of the right arm to release the can.", "The left arm will release it.", "Hand from the first arm to the receiving arm.", "Use the other arm.", "Place it to the left of the cup, left to right.",
    "", "drop the can.", "Wait while returning the left arm to its default pose.",
]


def test_columns_agree_with_plain_forms(spark):
    rows = spark.createDataFrame([(t, a) for t in TEXTS for a in ("left", "right", None)], "t string, a string")
    t, a = F.col("t"), F.col("a")
    out = rows.select(
        "t", "a", G.arm_context(t).alias("context"), G.uses_both(t).alias("both"), G.with_arm(t, a).alias("with_arm"), G.with_event_arm(t, a).alias("event_arm"), G.release_arm(t).alias("release"),
        G.concurrent(t).alias("clause"), G.joined_while(F.lit("Go."), t).alias("joined"), G.flip_places(G.flip_arms(t)).alias("flipped"), G.returns_meanwhile(t).alias("returns"),
    )
    for r in out.collect():
        assert r.context == G.arm_context_of(r.t) and r.both == G.uses_both_of(r.t) and r.release == G.release_arm_of(r.t), r
        assert r.with_arm == G.with_arm_of(r.t, r.a) and r.event_arm == G.with_event_arm_of(r.t, r.a), r
        assert r.clause == G.concurrent_of(r.t) and r.joined == G.joined_while_of("Go.", r.t), r
        assert r.returns == ("while returning" in r.t)
        if r.t.startswith("Place it"):
            assert r.flipped == "Place it to the right of the cup, right to left."


def test_labels_of_real_arms(spark):
    rows = spark.createDataFrame([("Place the mouse with the left arm to the left of the phone.", "before_gripper_left_open", {"{a}": "right", "{A}": "left over"})], "goal string, source string, scene map<string,string>")
    r = S.published(rows).withColumn("scene", S.flipped_scene(F.col("scene"))).first()
    assert (r.goal, r.source, r.scene) == ("Place the mouse with the right arm to the right of the phone.", "before_gripper_right_open", {"{a}": "left", "{A}": "left over"})
    x = spark.sql("select 'flipped from state' as m").select(
        G.acting_arms(F.lit("move"), F.lit("Lift the left arm.")).alias("one"), G.acting_arms(F.lit("dual_move"), F.lit("")).alias("two"), G.state_arms(F.array(F.lit("left")), F.col("m")).alias("state"),
        G.expected_event(F.lit("episode_end_after_before_gripper_left_open")).alias("e"), G.expected_event(F.lit("gripper_left_open")).alias("none"), G.height_above_table(F.lit(0.865)).alias("h"),
    ).first()
    assert (x.one, x.two, x.state, x.e.arm, x.e.kind, x.none, x.h) == (["left"], ["left", "right"], ["right"], "left", "open", None, 12)
