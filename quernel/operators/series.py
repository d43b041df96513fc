"""Ordered sequences: frames of an episode, steps, running sums, runs, islands, spans and look-ups between them.

All windows are partitioned by the episode ``ep`` and ordered by the frame ``f``, so they share one exchange.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame_order():
    return Window.partitionBy("ep").orderBy("f")


def up_to():
    return frame_order().rowsBetween(Window.unboundedPreceding, 0)


def frames(events: DataFrame) -> DataFrame:
    """Events as frames: a user is an episode, the order of time and id counts the frames from 0, the value is the signal."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("ep"), (F.row_number().over(order) - 1).alias("f"), F.col("value").alias("v"), F.col("event_type").alias("kind"))


def steps(rows: DataFrame) -> DataFrame:
    """Add ``d``, the change since the frame before (null at the first)."""
    return rows.withColumn("d", F.col("v") - F.lag("v").over(frame_order()))


def running_progress(rows: DataFrame, least: float) -> DataFrame:
    """Add the path so far and the progress: its share of the episode's path, or of the time where the path is too short."""
    moved = steps(rows).withColumn("path", F.sum(F.coalesce(F.abs("d"), F.lit(0.0))).over(up_to()))
    whole = Window.partitionBy("ep")
    total, last = F.max("path").over(whole), F.max("f").over(whole)
    timed = F.least(F.lit(1.0), F.col("f") / F.greatest(F.lit(1), last))
    return moved.withColumn("progress", F.when(total >= least, F.least(F.lit(1.0), F.col("path") / total)).otherwise(timed))


def trailing_run(rows: DataFrame, value: Column, threshold: float) -> DataFrame:
    """(ep, first, n): the run of frames up to the end whose value reaches the threshold; the last frame alone if there is none."""
    below = rows.withColumn("bad", F.when(value < threshold, F.col("f")))
    out = below.groupBy("ep").agg(F.max("bad").alias("bad"), F.max("f").alias("last"))
    n = F.col("last") - F.coalesce("bad", F.lit(-1))
    return out.select("ep", F.when(n > 0, F.col("last") - n + 1).otherwise(F.col("last")).alias("first"), n.alias("n"))


def monotone_runs(rows: DataFrame, still: float, least: float) -> DataFrame:
    """Runs of steps of one sign: (ep, start, end, mid, change, kind), for changes of at least ``least``.

    A step no larger than ``still`` ends a run.
    """
    sign = F.when(F.abs("d") > still, F.signum("d").cast("int")).otherwise(F.lit(0))
    marked = steps(rows).withColumn("sign", F.coalesce(sign, F.lit(0)))
    island = marked.withColumn("new", (F.col("sign") != F.coalesce(F.lag("sign").over(frame_order()), F.lit(9))).cast("int")).withColumn("run", F.sum("new").over(up_to()))
    out = island.filter("sign != 0").groupBy("ep", "run", "sign").agg((F.min("f") - 1).alias("start"), F.max("f").alias("end"), F.sum("d").alias("change"))
    kind = F.when(F.col("sign") > 0, "open").otherwise("close")
    return out.filter(F.abs("change") >= least).select("ep", "start", "end", F.floor((F.col("start") + F.col("end")) / 2).alias("mid"), F.round("change", 4).alias("change"), kind.alias("kind"))


def plain(column: pa.Array) -> list:
    """A column as Python values, whole numbers, flags and texts by way of numpy, which is faster."""
    kind = column.type
    quick = pa.types.is_string(kind) or (column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_boolean(kind)))
    return column.to_numpy(zero_copy_only=False).tolist() if quick else column.to_pylist()


def spaced(events: DataFrame, gap: int, keys: tuple[str, ...] = ("ep",)) -> DataFrame:
    """Events of an episode at least ``gap`` frames after the last one that was taken: each choice depends on the one before.

    A task reads its episodes in order in one pass and keeps the last taken event alone, however many and long they are. ``keys`` tell an episode.
    """

    def pick(batches):
        was, last = None, None
        for batch in batches:
            taken = []
            for k, (mid, *key) in enumerate(zip(*(plain(batch.column(c)) for c in ("mid", *keys)))):
                if key != was or (None not in (mid, last) and mid - last >= gap):
                    taken.append(k)
                    was, last = key, mid
            yield batch.take(pa.array(taken, pa.int64()))

    order = [F.col(c) for c in keys] + [F.col("mid").asc_nulls_last(), F.col("start").asc_nulls_last()]
    return events.repartition(*keys).sortWithinPartitions(*order).mapInArrow(pick, events.schema)


def first_sustained(rows: DataFrame, moving: Column, run: int) -> DataFrame:
    """(ep, start): the first frame that begins ``run`` moving steps in a row; null without one."""
    ahead = frame_order().rowsBetween(0, run - 1)
    marked = steps(rows).withColumn("m", F.coalesce(moving, F.lit(False)).cast("int"))
    whole = marked.withColumn("ok", (F.min("m").over(ahead) == 1) & (F.count("*").over(ahead) == run))
    return whole.groupBy("ep").agg(F.min(F.when(F.col("ok"), F.col("f"))).alias("start"))


def islands(rows: DataFrame, active: Column, gap: int) -> DataFrame:
    """(ep, start, end, n): runs of active frames, joined over at most ``gap`` idle frames."""
    on = rows.filter(active).withColumn("new", (F.col("f") - F.lag("f").over(frame_order()) > gap + 1).cast("int"))
    numbered = on.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(up_to()))
    return numbered.groupBy("ep", "run").agg(F.min("f").alias("start"), F.max("f").alias("end"), F.count("*").alias("n")).drop("run")


def filled(spans: DataFrame, last: DataFrame) -> DataFrame:
    """Spans that touch: the first begins at 0, each ends before the next one, the last at the episode's last frame."""
    order = Window.partitionBy("ep").orderBy("start")
    ordered = spans.join(last, "ep").withColumn("idx", F.row_number().over(order) - 1)
    begin = F.when(F.col("idx") == 0, F.lit(0)).otherwise(F.col("start"))
    return ordered.select("ep", "idx", begin.alias("start"), F.coalesce(F.lead("start").over(order) - 1, F.col("last")).alias("end"))


def inside(spans: DataFrame, *columns: str) -> DataFrame:
    """A row for each frame of each span. Frames then meet spans by an equi-join: as many rows as there are frames in spans."""
    return spans.filter("start <= end").select("ep", *columns, F.explode(F.sequence("start", "end")).alias("f"))


def span_at(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(ep, f, idx, before): the first span around each frame; ``before`` is the last span that ended before it (else 0)."""
    around = inside(spans, "idx").groupBy("ep", "f").agg(F.min("idx").alias("idx"))
    frame = points.select("ep", "f").distinct()
    # an ended span is known from the frame after its end on
    kind = spans.select(F.struct("end", "idx").alias("e")).schema["e"].dataType
    ended = spans.select("ep", (F.col("end") + 1).cast("long").alias("f"), F.struct("end", "idx").alias("e"), F.lit(False).alias("asked"))
    both = frame.select("ep", F.col("f").cast("long").alias("f"), F.lit(None).cast(kind).alias("e"), F.lit(True).alias("asked")).unionByName(ended)
    order = Window.partitionBy("ep").orderBy("f", "asked").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("e", F.max("e").over(order)).filter("asked")
    return known.join(around, ["ep", "f"], "left").select("ep", "f", "idx", F.coalesce("e.idx", F.lit(0)).alias("before"))


def next_of(rows: DataFrame, kind: str) -> DataFrame:
    """Add the frame and value of the next row of a kind, strictly later: one pass from the last frame back."""
    later = Window.partitionBy("ep").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.last(F.when(F.col("kind") == kind, F.struct("f", "v")), ignorenulls=True).over(later)
    return rows.withColumn("hit", hit).select("ep", "f", F.col("hit.f").alias("next_f"), F.col("hit.v").alias("next_v"))


def memory_frames(n: int, stride: int) -> Column:
    """The n frames before and at a frame, oldest first, never below 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.greatest(F.lit(0), F.col("f") - (n - 1 - k) * stride).cast("int"))


def bucket_pick(rows: DataFrame, size: float) -> DataFrame:
    """For each progress bucket below 1, the frame nearest to its centre; of two, the later one."""
    most = int(round(1 / size)) - 1
    inside = rows.filter("progress < 1").withColumn("bucket", F.least(F.lit(most), F.floor(F.col("progress") / size)).cast("int"))
    order = Window.partitionBy("ep", "bucket").orderBy(F.round(F.abs(F.col("progress") - (F.col("bucket") + 0.5) * size), 9), F.desc("f"))
    return inside.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("ep", "bucket", "f")
