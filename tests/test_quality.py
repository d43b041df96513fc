"""Each quality rule on a small episode that breaks it alone."""

import numpy as np

from quernel.operators import quality


def test_rules(spark):
    def states(n=40, **columns):
        out = np.zeros((n, 16))
        out[:, [3, 11]] = 1
        for slot, values in columns.items():
            out[:, int(slot[1:])] = values
        return out.tolist()

    ramp = lambda a, b: np.interp(np.arange(40), [a, b], [0, 1])
    left = {"s0": ramp(0, 19), "s7": 1 - ramp(20, 30)}
    good = [(0, 0, "Move the left arm to the cup.", None, 0, 19, "before_gripper_left_close", None), (1, 1, "Close the gripper of the left arm.", None, 20, 39, "episode_end", None)]
    swap = lambda k, **new: [tuple(new.get(n, v) for n, v in zip(("pos", "index", "goal", "type", "start", "end", "source", "rule"), row)) if k == i else row for i, row in enumerate(good)]
    event = [("left", "close", 25, 20)]
    cases = {
        "none": (good, left, event, 40),
        "num_frames_matches_state": (good, left, event, 41),
        "has_subtasks": ([], left, event, 40),
        "sequential_subtask_index": (swap(1, index=5), left, event, 40),
        "continuous_spans": (swap(1, start=21), left, [("left", "close", 25, 21)], 40),
        "single_arm_label_maybe_flipped": (swap(0, goal="Move the right arm to the cup."), left, event, 40),
        "single_arm_other_arm_static": (good, left | {"s8": ramp(0, 19) * 0.5}, event, 40),
        "open_close_no_displacement": (good, left | {"s0": ramp(0, 19) + ramp(32, 38) * 0.1}, event, 40),
        "gripper_boundary_next_action": (swap(0, source="before_gripper_left_open"), left, [("left", "open", 25, 20)], 40),
        "gripper_boundary_next_arm": (swap(0, source="before_gripper_right_close"), left, [("right", "close", 25, 20)], 40),
        "gripper_boundary_matches_detected_event": (good, left, [("left", "close", 25, 19)], 40),
        "eef_boundary_current_action": (swap(0, goal="Wait with the left arm.", source="before_eef_left_motion"), left, event, 40),
        "last_subtask_reaches_episode_end": (swap(1, end=38), left, event, 40),
        "dual_arm_both_changed": (swap(0, goal="Move both arms."), left, event, 40),
        "move_no_gripper_change": (swap(0, goal="Lift with the left arm."), {"s0": ramp(0, 19), "s7": 1 - ramp(5, 12)}, event, 40),
        "min_frames": ([*swap(0, end=2), (1, 1, "Move the left arm up.", None, 3, 19, "before_gripper_left_close", None), (2, 2, *good[1][2:])], left, [("left", "close", 5, 3), *event], 40),
    }
    annos, spans, frames, events = [], [], [], []
    for ep, (name, (rows, columns, found, n)) in enumerate(cases.items()):
        annos.append((ep, "task", n))
        spans += [(ep, *r) for r in rows]
        frames += [(ep, f, [float(x) for x in s]) for f, s in enumerate(states(**columns))]
        events += [(ep, *e) for e in found]
    got = quality.issues(
        spark.createDataFrame(annos, "ep long, slug string, num_frames long"),
        spark.createDataFrame(spans, "ep long, pos int, subtask_index int, goal string, subtask_type string, start long, end long, source string, rule string"),
        spark.createDataFrame(frames, "ep long, f long, state array<double>"),
        spark.createDataFrame(events, "ep long, arm string, kind string, frame long, start_frame long"),
    )
    broken = {}
    for r in got.collect():
        broken.setdefault(r.ep, []).append(r.rule)
    for ep, name in enumerate(cases):
        if name == "none":
            assert ep not in broken, broken
        else:
            assert name in broken.get(ep, []), (name, broken.get(ep))
    first = {r.ep: r.rule for r in quality.first_issue(got).collect()}
    assert first[1] == "num_frames_matches_state" and len(first) == len(cases) - 1
