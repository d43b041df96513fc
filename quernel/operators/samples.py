"""Training samples from annotated spans: plans, and frames that are not done, just done, or done for the span before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators import trajectory

#: Fixed value: so many first frames of a span still count for the one before it.
PREVIOUS_FRAMES = 8


def bucketed(rows: DataFrame, size: float) -> DataFrame:
    """For each span and progress bucket, the frame nearest to the bucket's centre; of two, the later one. Size 0 keeps all."""
    if size <= 0:
        return rows
    most = max(0, int(round(1 / size)) - 1)
    inside = rows.filter("progress < 1").withColumn("bucket", F.least(F.lit(most), F.floor(F.col("progress") / size)))
    order = Window.partitionBy("ep", "idx", "bucket").orderBy(F.round(F.abs(F.col("progress") - (F.col("bucket") + 0.5) * size), 9), F.desc("f"))
    return inside.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn", "bucket")


def build(frames: DataFrame, spans: DataFrame, stride: int = 1, bucket: float = 0.0, threshold: float = trajectory.DONE) -> DataFrame:
    """(ep, kind, group, idx, f, done, progress): a plan row for each span, then the frames by group.

    ``frames``: ep, f, state; ``spans``: ep, idx, start, end, left, right. A plan row has no frame; labels that do not apply are null.
    """
    curve = trajectory.progress(frames, spans)
    done = trajectory.done_frames(curve, threshold)
    begins = done.groupBy("ep", "idx").agg(F.min("f").alias("done_start"))
    before = curve.join(begins, ["ep", "idx"]).filter(F.col("f") < F.col("done_start"))
    undone = bucketed(before, bucket) if bucket > 0 else before.filter((F.col("f") - F.col("start")) % max(1, stride) == 0)
    after = curve.filter((F.col("idx") > 0) & (F.col("f") - F.col("start") < PREVIOUS_FRAMES))

    def part(rows: DataFrame, kind: str, group: str | None, idx, f, is_done, progress) -> DataFrame:
        return rows.select("ep", F.lit(kind).alias("kind"), F.lit(group).cast("string").alias("group"), idx.cast("long").alias("idx"), f.cast("long").alias("f"), is_done.cast("int").alias("done"), progress.cast("double").alias("progress"))

    none, idx, f = F.lit(None), F.col("idx"), F.col("f")
    return (
        part(spans, "plan", None, idx, none, none, none)
        .unionByName(part(undone, "frame", "undone", idx, f, F.lit(0), F.col("progress")))
        .unionByName(part(done, "frame", "current_done", idx, f, F.lit(1), F.col("progress")))
        .unionByName(part(after, "frame", "prev_done", idx - 1, f, F.lit(1), F.lit(1.0)))
    )


def plan_start(rows: DataFrame) -> DataFrame:
    """Add the first span of the plan at a frame: the next one (if there is one) once the current one is done. Columns idx, f, done_start, n_spans."""
    return rows.withColumn("plan_start", F.when(F.col("f") >= F.col("done_start"), F.least(F.col("idx") + 1, F.col("n_spans") - 1)).otherwise(F.col("idx")))


def rows_of(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Every frame of every span with its progress and whether the span is done: (ep, idx, f, done, progress), in order of frame and span."""
    curve = trajectory.progress(frames, spans)
    done = trajectory.done_frames(curve).select("ep", "idx", "f", F.lit(1).alias("done"))
    return curve.join(done, ["ep", "idx", "f"], "left").select("ep", "idx", "f", F.coalesce("done", F.lit(0)).alias("done"), "progress").orderBy("ep", "f", "idx")


# ---- Rows for looking at episodes


def curve_rows(frames: DataFrame, spans: DataFrame, stride: int = 1) -> DataFrame:
    """(ep, f, idx, done, progress, timed, path, turn, grip): every ``stride``-th frame with what each part of the motion tells."""
    curve = trajectory.progress_parts(frames, spans)
    done = trajectory.done_frames(curve).select("ep", "idx", "f", F.lit(1.0).alias("done"))
    rows = curve.filter(F.col("f") % max(1, stride) == 0).join(done, ["ep", "idx", "f"], "left")
    is_done = F.coalesce("done", F.lit(0.0))
    return rows.select("ep", "f", "idx", is_done.alias("done"), F.when(is_done == 1, 1.0).otherwise(F.col("progress")).alias("progress"), F.least(F.lit(1.0), "timed").alias("timed"), "path", "turn", "grip")


def entries(frames: DataFrame, spans: DataFrame, stride: int = 1, bucket: float = 0.0) -> DataFrame:
    """The frame rows of ``build`` in order of frame and span, numbered in each episode."""
    rows = build(frames, spans, stride, bucket).filter("kind = 'frame'").drop("kind")
    rows = rows.withColumn("progress", F.when(F.col("group") == "current_done", 1.0).otherwise(F.col("progress")))
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("ep").orderBy("f", "idx", "group")) - 1)


def perfect(rows: DataFrame) -> DataFrame:
    """Entries as if they had been predicted without a fault."""
    done = F.col("done").cast("double")
    return rows.select(
        "ep", "number", "f", "idx", "group", done.alias("done_label"), done.alias("done_prob"), (done >= 0.5).cast("int").alias("done_pred"), F.lit(1).alias("done_correct"), F.col("progress").alias("progress_label"), F.col("progress").alias("progress_pred"),
        F.lit(0.0).alias("progress_abs_err"), F.lit(0.0).alias("progress_sq_err"),
    )


def status_rows(samples: DataFrame, predictions: DataFrame, key: list[str], threshold: float = 0.5, votes: int | None = None) -> DataFrame:
    """Samples (done_label, progress_label) with predictions (probs: one or several, progress_pred) as rows of a result.

    With ``votes`` a span is done when so many heads say so, and its probability is their mean.
    """
    rows = samples.join(predictions, key)
    n, said = F.size("probs"), F.size(F.filter("probs", lambda p: p >= threshold))
    prob = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p) / n if votes else F.get("probs", F.lit(0))
    pred = (said >= votes) if votes else (prob >= threshold)
    error = F.col("progress_pred") - F.col("progress_label")
    voted = lambda value: value if votes else F.lit("")
    return rows.select(
        *samples.columns, prob.alias("done_prob"), pred.cast("int").alias("done_pred"), F.when(pred, "done").otherwise("undone").alias("done_pred_label"), (pred == (F.col("done_label") >= threshold)).cast("int").alias("done_correct"),
        said.alias("done_vote_count"), voted(F.concat_ws(":", said, n - said)).alias("done_vote_pattern"), voted(F.lit(str(votes or ""))).alias("done_vote_threshold"), voted(F.to_json("probs")).alias("done_vote_probs"),
        "progress_pred", F.abs(error).alias("progress_abs_err"), F.pow(error, 2).alias("progress_sq_err"),
    )


def asked_rows(points: DataFrame, frames: DataFrame, spans: DataFrame) -> DataFrame:
    """For given (ep, f, idx), in their order ``number``, whether the span is done and how far it is; a frame out of its span is before or after it."""
    curve = trajectory.progress(frames, spans)
    done = trajectory.done_frames(curve).select("ep", "idx", "f", F.lit(True).alias("is_done"))
    known = points.join(spans.select("ep", "idx", "start", "end"), ["ep", "idx"]).join(curve.select("ep", "idx", "f", "progress"), ["ep", "idx", "f"], "left").join(done, ["ep", "idx", "f"], "left")
    outside = F.when(F.col("f") <= F.col("start"), 0.0).otherwise(1.0)
    value = F.when(F.col("is_done"), 1.0).otherwise(F.coalesce("progress", outside))
    return known.select("ep", "number", "f", "idx", F.coalesce("is_done", F.lit(False)).cast("double").alias("done"), value.alias("progress")).orderBy("ep", "number")


def timed_rows(spans: DataFrame, probes: bool = False) -> DataFrame:
    """The older labels: done from the frame before the end on, progress by time alone. ``probes`` adds frames around each boundary for both spans."""
    order = Window.partitionBy("ep").orderBy("idx")
    last = F.max("end").over(Window.partitionBy("ep"))
    known = spans.withColumn("last", last).withColumn("before_idx", F.lag("idx").over(order)).withColumn("before_end", F.lag("end").over(order))
    inside = known.filter("start <= end").select("ep", "idx", "start", "end", F.explode(F.sequence("start", "end")).alias("f"))
    done = F.col("f") >= F.col("end") - 1
    share = (F.col("f") - F.col("start")) / F.greatest(F.lit(1), F.col("end") - F.col("start"))
    rows = inside.select("ep", "f", "idx", done.cast("double").alias("done"), F.when(done, 1.0).otherwise(share).alias("progress"), F.lit("active").alias("group"))
    if not probes:
        return rows
    around = F.array_distinct(F.array(F.col("before_end") - 1, F.col("before_end"), F.col("start"), F.col("start") + 1, F.col("start") + 2))
    near = known.filter("before_idx is not null").select("ep", "idx", "before_idx", "last", F.explode(around).alias("f")).filter("f between 0 and last")
    probe = lambda idx, value, group: near.select("ep", "f", F.col(idx).alias("idx"), F.lit(value).alias("done"), F.lit(value).alias("progress"), F.lit(group).alias("group"))
    return rows.unionByName(probe("before_idx", 1.0, "prev_done_probe")).unionByName(probe("idx", 0.0, "current_not_done_probe"))


def done_runs(curve: DataFrame, threshold: float) -> DataFrame:
    """(ep, idx, tail, total, fixed): how many frames of a span are done in a row at its end, in all, and by the last three frames."""
    reached = F.col("progress") + 1e-9 >= threshold
    sums = curve.groupBy("ep", "idx").agg(F.max(F.when(~reached, F.col("f"))).alias("bad"), F.max("f").alias("last"), F.min("f").alias("first"), F.count_if(reached).alias("total"))
    size = F.col("last") - F.col("first") + 1
    return sums.select("ep", "idx", (F.col("last") - F.coalesce("bad", F.col("first") - 1)).alias("tail"), "total", F.least(F.lit(3), size).alias("fixed"))


# ---- Plans


def undone_end(end: Column, done_start: Column) -> Column:
    """The last frame that is not done."""
    return F.least(end, F.coalesce(done_start - 1, end))


def drawn(low: Column, high: Column, seed: int, *key: str) -> Column:
    """A frame between two, the same in every run; null where there is none."""
    return F.when(low <= high, low + F.pmod(F.xxhash64(F.lit(seed), *key), high - low + 1))


def plan_frame(start: Column, end: Column, seed: int, *key: str) -> Column:
    """A frame of a span, not its first or last one where it has three or more."""
    low, high = F.least(start, end), F.greatest(start, end)
    inner = (high - low >= 2).cast("int")
    return drawn(low + inner, high - inner, seed, *key)


def ahead(goals: Column, current: Column) -> Column:
    """The goals from the current one on."""
    return F.slice(goals, current + 1, F.greatest(F.lit(0), F.size(goals) - current))


def without_previous(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("group").eqNullSafe("prev_done"))


def only_previous(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("group") == "prev_done")


def grouped_previous(rows: DataFrame) -> DataFrame:
    """(ep, idx, frames): the frames that still count for a span after its end, in order."""
    return only_previous(rows).groupBy("ep", "idx").agg(F.array_sort(F.collect_list("f")).alias("frames"))
