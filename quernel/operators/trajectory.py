"""Two-armed trajectories: steps, progress, path lengths, gripper events and motion segments from state vectors.

A frame is (ep, f, state) with 16 numbers: left x y z, left quaternion w x y z, left gripper, and the same for the right.
Windows are partitioned by episode (and span) and ordered by frame.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quernel.functions import geometry as G
from quernel.operators.series import inside, plain, spaced

#: Where each arm's numbers begin, what counts as motion, when a subtask is done, and the frames of a stretch in which segments and groups meet.
ARMS = {"left": 0, "right": 8}
LEAST_PATH, LEAST_TURN_DEGREES, LEAST_GRIP = 0.01, 2.0, 0.05
STEP_MOVES, STEP_TURNS = 0.0015, 0.01
GRIP_STILL, GRIP_CHANGE, GRIP_GAP = 1e-4, 0.25, 3
DONE = 0.995
MEETING = 16


def slots(arm: str, first: int, last: int, column: str = "state") -> list[Column]:
    return [F.col(column)[ARMS[arm] + k] for k in range(first, last)]


def with_steps(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Add each arm's step of path, turn and grip since the frame before in the same window (0 at its first frame)."""
    order = Window.partitionBy(*keys).orderBy("f")
    out = frames.withColumn("was", F.lag("state").over(order))
    for arm in ARMS:
        path = G.distance(slots(arm, 0, 3), slots(arm, 0, 3, "was"))
        turn = G.turn(G.unit_quaternion(slots(arm, 3, 7), False), G.unit_quaternion(slots(arm, 3, 7, "was"), False))
        raw_turn = G.distance(slots(arm, 3, 7), slots(arm, 3, 7, "was"))
        grip = F.col("state")[ARMS[arm] + 7] - F.col("was")[ARMS[arm] + 7]
        for name, value in (("path", path), ("turn", turn), ("raw_turn", raw_turn), ("grip", grip)):
            out = out.withColumn(f"{arm}_{name}", F.coalesce(value, F.lit(0.0)))
    return out.drop("was")


def progress_parts(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """(ep, idx, f, start, end, path, turn, grip, timed, progress) of the frames inside each span (ep, idx, start, end, left, right: the arms that act).

    Path, turn and grip are shares of their whole in the span, null where it is too small. Progress is the mean of those that move enough, by time
    where none does; 0 up to the start and 1 from the end on.
    """
    keys = ["ep", "idx"]
    moved = with_steps(frames.join(inside(spans, "idx", "start", "end", "left", "right"), ["ep", "f"]), keys)
    order, whole = Window.partitionBy(*keys).orderBy("f").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    parts = []
    for name, least in (("path", LEAST_PATH), ("turn", F.radians(F.lit(LEAST_TURN_DEGREES))), ("grip", LEAST_GRIP)):
        step = sum((F.when(F.col(arm), F.abs(f"{arm}_{name}")).otherwise(0.0) for arm in ("right",)), F.when(F.col("left"), F.abs(f"left_{name}")).otherwise(0.0))
        so_far, total = F.sum(step).over(order), F.sum(step).over(whole)
        parts.append(F.when(total >= least, F.least(F.lit(1.0), F.greatest(F.lit(0.0), so_far / total))).alias(name))
    timed = (F.col("f") - F.col("start")) / F.greatest(F.lit(1), F.col("end") - F.col("start"))
    shares = moved.select("ep", "idx", "f", "start", "end", *parts, timed.alias("timed"))
    known = F.filter(F.array("path", "turn", "grip"), lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(F.col("timed"))
    return shares.withColumn("progress", F.when(F.col("f") <= F.col("start"), 0.0).when(F.col("f") >= F.col("end"), 1.0).otherwise(mean))


def progress(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """(ep, idx, f, start, end, progress) of the frames inside each span."""
    return progress_parts(frames, spans).select("ep", "idx", "f", "start", "end", "progress")


def done_frames(rows: DataFrame, threshold: float = DONE) -> DataFrame:
    """The last run of frames of each span whose progress reaches the threshold; the end alone if there is none."""
    below = F.max(F.when(F.col("progress") + 1e-9 < threshold, F.col("f"))).over(Window.partitionBy("ep", "idx"))
    return rows.withColumn("below", below).filter((F.col("f") > F.coalesce("below", F.lit(-1))) | (F.col("f") == F.col("end"))).drop("below")


def gripper_events(frames: DataFrame) -> DataFrame:
    """(ep, arm, frame, kind, start_frame, end_frame): runs of gripper steps of one sign that change enough.

    The frame is the middle of the run; an event follows the last taken one of its arm by at least 3 frames.
    """
    moved = with_steps(frames, ["ep"])
    arms = moved.select("ep", "f", F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"{a}_grip").alias("d")) for a in ARMS))).alias("x")).select("ep", "f", "x.arm", "x.d")
    order = Window.partitionBy("ep", "arm").orderBy("f")
    signed = arms.withColumn("sign", F.when(F.abs("d") > GRIP_STILL, F.signum("d").cast("int")).otherwise(0))
    runs = signed.withColumn("new", (F.col("sign") != F.coalesce(F.lag("sign").over(order), F.lit(9))).cast("int")).withColumn("run", F.sum("new").over(order))
    found = runs.filter("sign != 0").groupBy("ep", "arm", "run", "sign").agg((F.min("f") - 1).alias("start"), F.max("f").alias("end"), F.sum("d").alias("change")).filter(F.abs("change") >= GRIP_CHANGE)
    kind = F.when(F.col("sign") > 0, "open").otherwise("close")
    events = found.select("ep", "arm", "start", "end", F.floor((F.col("start") + F.col("end")) / 2).alias("mid"), kind.alias("kind"))
    return spaced(events, GRIP_GAP, ("ep", "arm")).select("ep", "arm", F.col("mid").alias("frame"), "kind", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"))


def motion_segments(frames: DataFrame, idle: int = 2) -> DataFrame:
    """(ep, start, end, left, right): maximal runs of frames in which the same set of arms moves.

    A moving frame marks the next one too. At most ``idle`` still frames inside a run are bridged, and a run ends
    before a frame with another set; its start is the frame before its first step.
    """
    moved = with_steps(frames, ["ep"])
    order = Window.partitionBy("ep").orderBy("f")
    for arm in ARMS:
        now = (F.col(f"{arm}_path") > STEP_MOVES) | (F.col(f"{arm}_raw_turn") > STEP_TURNS)
        moved = moved.withColumn(f"{arm}_now", now).withColumn(arm, F.col(f"{arm}_now") | F.coalesce(F.lag(f"{arm}_now").over(order), F.lit(False)))
    code = F.col("left").cast("int") + 2 * F.col("right").cast("int")
    active = moved.select("ep", "f", code.alias("set")).filter("set > 0")
    before = F.struct(F.lag("f").over(order).alias("f"), F.lag("set").over(order).alias("set"))
    marked = active.withColumn("b", before).withColumn("new", F.coalesce(((F.col("f") - F.col("b.f") > idle + 1) | (F.col("set") != F.col("b.set"))).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("new").over(order)).groupBy("ep", "run", "set").agg((F.min("f") - 1).alias("start"), F.max("f").alias("last"))
    later = Window.partitionBy("ep").orderBy("run")
    # a change of the set within the idle gap closes the run just before the next one's first frame
    until = F.lead("start").over(later)
    end = F.when(until - F.col("last") <= idle, until).otherwise(F.col("last"))
    closed = runs.select("ep", "run", "set", F.greatest(F.lit(0), "start").alias("start"), F.coalesce(end, "last").alias("end"))
    # neighbours with one set and a short way between them are one segment
    apart = F.coalesce(((F.col("set") != F.lag("set").over(later)) | (F.col("start") - F.lag("end").over(later) > idle + 1)).cast("int"), F.lit(1))
    joined = closed.withColumn("apart", apart).withColumn("part", F.sum("apart").over(later)).groupBy("ep", "part", "set").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.select("ep", "start", "end", ((F.col("set") % 2) == 1).alias("left"), (F.col("set") >= 2).alias("right"))


def gripper_groups(events: DataFrame, gap: int = 3) -> DataFrame:
    """(ep, start, end, frame, kind, left, right): events of one kind and different arms at most ``gap`` frames apart are one group.

    Each event, in order, takes all free partners, so the choice depends on those before it. A task reads its episodes in
    order in one pass and holds the groups that may still grow alone.
    """

    def table(groups: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g[k] for g in groups], field.type) for k, field in enumerate(schema)], schema=schema)

    def grouped(batches):
        # a group is a row of the result and the arm of its first event
        was, growing = None, []
        for batch in batches:
            done = []
            for ep, frame, arm, kind, start, end in zip(*(plain(batch.column(c)) for c in ("ep", "frame", "arm", "kind", "start_frame", "end_frame"))):
                if ep != was:
                    done += growing
                    was, growing = ep, []
                elif growing and frame - growing[0][3] > gap:
                    done += [g for g in growing if frame - g[3] > gap]
                    growing = [g for g in growing if frame - g[3] <= gap]
                for lead in growing:
                    if lead[4] == kind and lead[7] != arm:
                        lead[1], lead[2] = min(lead[1], start), max(lead[2], end)
                        lead[5], lead[6] = lead[5] or arm == "left", lead[6] or arm == "right"
                        break
                else:
                    growing.append([ep, start, end, frame, kind, arm == "left", arm == "right", arm])
            yield table(done)
        yield table(growing)

    names = f"ep {events.schema['ep'].dataType.simpleString()}, start long, end long, frame long, kind string, left boolean, right boolean"
    whole = events.select("ep", "arm", "kind", "frame", F.coalesce("start_frame", "frame").alias("start_frame"), F.coalesce("end_frame", "frame").alias("end_frame"))
    schema = to_arrow_schema(StructType.fromDDL(names))
    return whole.repartition("ep").sortWithinPartitions("ep", "frame", "arm", "kind").mapInArrow(grouped, names)


def compatible(a: str, b: str) -> Column:
    """Whether a segment and a group share an arm (a segment of both arms goes with any group)."""
    return (F.col(f"{a}.left") & F.col(f"{b}.left")) | (F.col(f"{a}.right") & F.col(f"{b}.right"))


def joined_segments(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """Neighbouring segments with the same arms become one, unless a gripper group starts between them."""
    order = Window.partitionBy("ep").orderBy("start", "end")
    same = (F.col("left") == F.lag("left").over(order)) & (F.col("right") == F.lag("right").over(order))
    numbered = segments.select("ep", "start", "end", "left", "right", F.lag("end").over(order).alias("before"), F.coalesce(same, F.lit(False)).alias("same"), F.lit(None).cast("long").alias("group"))
    # the last group that starts before a segment is between it and the one before, or none is
    starts = groups.select("ep", F.col("start").cast("long").alias("start"), F.col("start").cast("long").alias("group"))
    earlier = Window.partitionBy("ep").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    both = numbered.withColumn("start", F.col("start").cast("long")).unionByName(starts, allowMissingColumns=True).withColumn("last", F.max("group").over(earlier))
    cut = F.coalesce(F.col("last") > F.col("before"), F.lit(False))
    marked = both.filter("group IS NULL").withColumn("new", (~F.col("same") | cut).cast("int"))
    parts = marked.withColumn("part", F.sum("new").over(order)).groupBy("ep", "part").agg(F.min("start").alias("start"), F.max_by("end", "start").alias("end"), F.first("left").alias("left"), F.first("right").alias("right"))
    return parts.drop("part")


def split_segments(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """Segments cut after the ends of the compatible gripper groups inside them."""
    # they meet by short stretches of frames, so a long episode is as many small joins
    part = lambda c: F.floor(F.col(c) / MEETING)
    s = segments.withColumn("part", F.explode(F.sequence(part("start"), part("end")))).alias("s")
    g = groups.withColumn("part", part("end")).alias("g")
    inside = (F.col("s.ep") == F.col("g.ep")) & (F.col("s.part") == F.col("g.part")) & (F.col("g.end") >= F.col("s.start")) & (F.col("g.end") < F.col("s.end")) & (F.col("g.start") <= F.col("s.end")) & compatible("s", "g")
    cuts = s.join(g, inside, "left").groupBy(*(F.col(f"s.{c}").alias(c) for c in ("ep", "start", "end", "left", "right"))).agg(F.array_sort(F.collect_set("g.end")).alias("cuts"))
    begins = F.concat(F.array("start"), F.transform("cuts", lambda c: c + 1))
    ends = F.concat("cuts", F.array("end"))
    pieces = F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b")))
    return cuts.select("ep", "left", "right", pieces.alias("p")).select("ep", F.col("p.a").alias("start"), F.col("p.b").alias("end"), "left", "right").filter("start <= end")


def arm_motion(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """For each span (ep, idx, start, end): each arm's path, longest step, grip range, change and whether it crossed half open."""
    moved = with_steps(frames.join(inside(spans, "idx"), ["ep", "f"]), ["ep", "idx"])
    out = []
    for arm in ARMS:
        grip = F.col("state")[ARMS[arm] + 7]
        out += [
            F.sum(f"{arm}_path").alias(f"{arm}_length"), F.max(f"{arm}_path").alias(f"{arm}_max_step"), (F.max(grip) - F.min(grip)).alias(f"{arm}_grip_range"),
            (F.max_by(grip, "f") - F.min_by(grip, "f")).alias(f"{arm}_grip_change"), ((F.max(grip) >= 0.5) & (F.min(grip) < 0.5)).alias(f"{arm}_crossed"),
        ]
    return moved.groupBy("ep", "idx").agg(*out)
