"""Quality rules over annotated spans of two-armed trajectories.

Inputs: ``annos`` (ep, slug, num_frames), ``spans`` (ep, pos, subtask_index, goal, subtask_type, start, end, source, rule),
``frames`` (ep, f, state) and ``events`` (ep, arm, kind, frame, start_frame). Each rule is one boolean column of a span, so all
rules are judged in one pass; broken ones come out as rows in the order of the catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions import text as T
from quernel.operators import trajectory
from quernel.operators.series import inside

#: Least length, least path and gripper change, and the tasks whose other arm may move further.
LEAST_FRAMES, MOTION, GRIP_CHANGE, GRIP_STILL = 7, 0.015, 0.25, 1e-4
OTHER_ARM = {"handover_mic": 0.05, "place_bread_basket": 0.04, "place_bread_skillet": 0.04, "put_object_cabinet": 0.04}
EXCUSED_TASKS = ("place_dual_shoes", "place_cans_plasticbox")
GRIP_BOUNDARY = r"^(?:episode_end_after_)?before_gripper_(left|right)_(open|close)$"
MOTION_BOUNDARY = r"^(?:episode_end_after_)?before_eef_(left|right)_motion$"


def truncation_rule(rule: Column, source: Column) -> Column:
    """The given rule, else one told from the boundary's name."""
    given, name = F.trim(F.coalesce(rule, F.lit(""))), F.trim(F.coalesce(source, F.lit("")))
    return (
        F.when(given != "", given)
        .when(name.contains("gripper") & name.contains("open"), "gripper_open")
        .when(name.contains("gripper") & name.contains("close"), "gripper_close")
        .when(name.contains("eef") & name.contains("motion"), "eef_motion")
        .when(name != "", name)
        .otherwise("unknown")
    )


def after_grip(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """For each span, each arm's path after its gripper's last step (or from the start, if it never moves)."""
    within = inside(spans.withColumnRenamed("pos", "idx"), "idx", "start")
    moved = trajectory.with_steps(frames.join(within, ["ep", "f"]), ["ep", "idx"])
    whole = Window.partitionBy("ep", "idx")
    sums = []
    for arm in trajectory.ARMS:
        moved = moved.withColumn(f"{arm}_last", F.coalesce(F.max(F.when(F.abs(f"{arm}_grip") > GRIP_STILL, F.col("f"))).over(whole), F.col("start")))
        sums.append(F.sum(F.when(F.col("f") > F.col(f"{arm}_last"), F.col(f"{arm}_path")).otherwise(0.0)).alias(f"{arm}_after"))
    return moved.groupBy("ep", F.col("idx").alias("pos")).agg(*sums)


def issues(annos: DataFrame, spans: DataFrame, frames: DataFrame, events: DataFrame) -> DataFrame:
    """(ep, pos, ord, rule): the broken rules. A span out of range is judged by the rules up to the range alone."""
    order = Window.partitionBy("ep").orderBy("pos")
    sizes = frames.groupBy("ep").agg(F.count("*").alias("n"))
    left, right = T.arm_flags(F.col("goal"))
    stype = F.when(F.trim(F.coalesce("subtask_type", F.lit(""))) != "", F.trim("subtask_type")).otherwise(T.action_kind(F.col("goal")))
    dual = F.col("stype").startswith("dual_")
    seen = (
        spans.join(annos, "ep").join(sizes, "ep", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("stype", stype).withColumn("named_left", left | dual).withColumn("named_right", right | dual)
        .withColumn("kind", F.when(dual, F.regexp_replace("stype", "^dual_", "")).otherwise(T.action_kind(F.col("goal"))))
        .withColumn("before", F.coalesce(F.lag("end").over(order), F.lit(-1))).withColumn("next_start", F.lead("start").over(order)).withColumn("next_goal", F.lead("goal").over(order))
        .withColumn("want_arm", F.regexp_extract("source", GRIP_BOUNDARY, 1)).withColumn("want_kind", F.regexp_extract("source", GRIP_BOUNDARY, 2))
    )
    motion = trajectory.arm_motion(frames, spans.withColumn("idx", F.col("pos"))).withColumnRenamed("idx", "pos")
    met = events.select("ep", F.col("arm").alias("want_arm"), F.col("kind").alias("want_kind"), F.coalesce("start_frame", "frame").alias("next_start")).distinct().withColumn("met", F.lit(True))
    seen = seen.join(motion, ["ep", "pos"], "left").join(after_grip(frames, spans), ["ep", "pos"], "left").join(met, ["ep", "want_arm", "want_kind", "next_start"], "left")

    grip = lambda arm: F.col(f"{arm}_crossed") | (F.col(f"{arm}_grip_range") >= GRIP_CHANGE)
    changed = lambda arm, least=F.lit(MOTION): (F.col(f"{arm}_length") >= least) | grip(arm)
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in OTHER_ARM.items() for x in kv)), F.col("slug")), F.lit(MOTION))
    last, in_range = F.col("next_start").isNull(), (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") < F.col("n"))
    ended = F.trim("source").rlike("^episode_end(_after_.*)?$") | (truncation_rule(F.col("rule"), F.col("source")) == "episode_end")
    tail = last & (F.col("end") == F.col("n") - 1) & ended
    only_left, only_right = F.col("named_left") & ~F.col("named_right"), F.col("named_right") & ~F.col("named_left")
    other = lambda test: (only_left & test("right", "left")) | (only_right & test("left", "right"))
    disturbed = lambda o, m: changed(o, limit)
    further = lambda o, m: F.col(f"{o}_length") > F.col(f"{m}_length") + MOTION
    excused = F.col("slug").isin(*EXCUSED_TASKS) & (F.col("stype") == "dual_move") & F.col("goal").rlike("^Move the (left|right) arm to the place pose") & ~F.lower("goal").rlike(r"\bwhile returning\b") & (changed("left") != changed("right"))
    boundary, both_moved = F.col("want_kind") != "", changed("left") & changed("right")
    next_left, next_right = T.arm_flags(F.col("next_goal"))
    names_other = F.when(F.col("want_arm") == "left", next_right & ~next_left).otherwise(next_left & ~next_right)
    rules = [
        ("sequential_subtask_index", F.coalesce("subtask_index", "pos") != F.col("pos"), False),
        ("continuous_spans", F.col("start") != F.col("before") + 1, False),
        ("valid_frame_range", ~in_range, False),
        ("min_frames", (F.col("end") - F.col("start") + 1 < LEAST_FRAMES) & ~tail, True),
        ("single_arm_label_maybe_flipped", other(lambda o, m: disturbed(o, m) & further(o, m)), True),
        ("single_arm_other_arm_static", other(lambda o, m: disturbed(o, m) & ~further(o, m)), True),
        ("dual_arm_both_changed", F.col("named_left") & F.col("named_right") & ~both_moved & ~excused, True),
        ("open_close_no_displacement", F.col("kind").isin("open", "close") & ((F.col("left_after") >= MOTION) | (F.col("right_after") >= MOTION)), True),
        ("move_no_gripper_change", (F.col("kind") == "move") & (grip("left") | grip("right")), True),
        ("gripper_boundary_next_action", boundary & ~last & (T.action_kind(F.col("next_goal")) != F.col("want_kind")), True),
        ("gripper_boundary_next_arm", boundary & ~last & names_other & ~both_moved, True),
        ("gripper_boundary_matches_detected_event", boundary & ~last & F.col("met").isNull(), True),
        ("eef_boundary_current_action", F.col("source").rlike(MOTION_BOUNDARY) & (F.col("kind") == "unknown"), True),
    ]
    found = [F.when(F.coalesce(bad & in_range if needs_range else bad, F.lit(False)), F.struct(F.lit(k).alias("ord"), F.lit(name).alias("rule"))) for k, (name, bad, needs_range) in enumerate(rules, 1)]
    found.append(F.when(last & (F.col("end") != F.col("n") - 1), F.struct(F.lit(99).alias("ord"), F.lit("last_subtask_reaches_episode_end").alias("rule"))))
    per_span = seen.select("ep", "pos", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("ep", "pos", "i.ord", "i.rule")
    whole = annos.join(sizes, "ep", "left").join(spans.select("ep").distinct().withColumn("some", F.lit(True)), "ep", "left")
    head = F.array(
        F.when(F.col("num_frames") != F.coalesce("n", F.lit(0)), F.struct(F.lit(-1).alias("ord"), F.lit("num_frames_matches_state").alias("rule"))),
        F.when(F.col("some").isNull(), F.struct(F.lit(0).alias("ord"), F.lit("has_subtasks").alias("rule"))),
    )
    of_anno = whole.select("ep", F.lit(-1).alias("pos"), F.explode(F.filter(head, lambda x: x.isNotNull())).alias("i")).select("ep", "pos", "i.ord", "i.rule")
    return of_anno.unionByName(per_span.withColumn("pos", F.col("pos").cast("int")))


def first_issue(rows: DataFrame) -> DataFrame:
    """One issue an annotation: the first by span and catalogue; what concerns the whole annotation comes first."""
    key = F.when(F.col("ord") == 99, 10**6).otherwise(F.col("pos"))
    return rows.groupBy("ep").agg(F.min(F.struct(key.alias("at"), "ord", "rule", "pos")).alias("i")).select("ep", "i.pos", "i.rule")
