"""Number functions as column expressions: image sizes, video frames, boxes, quaternions and projections.

Rounding is half to even throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def near(x: Column, factor: int) -> Column:
    return F.bround(x / factor) * factor


def up(x: Column, factor: int) -> Column:
    return F.ceil(x / factor) * factor


def down(x: Column, factor: int) -> Column:
    return F.floor(x / factor) * factor


def resized(height: Column, width: Column, factor: int, least: int, most: int, floor_side: bool = True, long_side: int | None = None) -> Column:
    """Height and width as multiples of a factor, with an area within bounds and about the same aspect; null beyond 200 to 1.

    ``floor_side``: no side is rounded below the factor. ``long_side``: longer sides are first shrunk to it.
    """
    h, w = height.cast("double"), width.cast("double")
    if long_side is not None:
        shrink = F.least(F.lit(1.0), long_side / F.greatest(h, w))
        h, w = F.floor(h * shrink).cast("double"), F.floor(w * shrink).cast("double")
    at_least = (lambda x: F.greatest(F.lit(float(factor)), x)) if floor_side else (lambda x: x)
    hr, wr = at_least(near(h, factor)), at_least(near(w, factor))
    down_by, up_by = F.sqrt(h * w / most), F.sqrt(least / (h * w))
    big, small = hr * wr > most, hr * wr < least
    out_h = F.when(big, at_least(down(h / down_by, factor).cast("double"))).when(small, up(h * up_by, factor).cast("double")).otherwise(hr)
    out_w = F.when(big, at_least(down(w / down_by, factor).cast("double"))).when(small, up(w * up_by, factor).cast("double")).otherwise(wr)
    fits = F.greatest(h, w) / F.least(h, w) <= 200
    return F.when(fits, F.struct(out_h.cast("long").alias("height"), out_w.cast("long").alias("width")))


def frame_count(total: Column, video_fps: Column, fps: float, least: int, most: int, factor: int = 2) -> Column:
    """How many frames to take: by rate, at least and at most so many, a multiple of the factor; null outside [factor, total]."""
    low, high = up(F.lit(least), factor), down(F.least(F.lit(most), total), factor)
    wanted = total / video_fps * fps
    n = down(F.least(F.least(F.greatest(wanted, low), high), total), factor)
    return F.when((n >= factor) & (n <= total), n.cast("long"))


def frame_range(start: Column, end: Column, total: Column, fps: Column) -> Column:
    """First and last frame of a time range, clamped to the video; null if nothing is left."""
    duration = total / fps
    s = F.ceil(F.greatest(F.lit(0.0), F.least(start, duration)) * fps)
    e = F.least(F.floor(F.greatest(F.lit(0.0), F.least(end, duration)) * fps), total - 1)
    return F.when(s < e, F.struct(s.cast("long").alias("first"), e.cast("long").alias("last")))


def even_frames(start: Column, end: Column, n: Column) -> Column:
    """n frame numbers evenly from start to end, both included."""
    step = (end - start) / F.greatest(F.lit(1), n - 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.bround(start + k * step).cast("long"))


def pixel_budget(total: Column, n_frames: Column, factor: int, least: int) -> Column:
    """The most pixels of a video's frame, when all frames share a total."""
    return F.greatest(F.least(F.lit(768 * factor * factor).cast("double"), total / n_frames * 2), F.lit(float(int(least * 1.05)))).cast("long")


def box_to_thousandths(box: Column, height: Column, width: Column) -> Column:
    sides = F.array(width, height, width, height)
    return F.transform(F.arrays_zip(box.alias("x"), sides.alias("s")), lambda p: F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(p["x"] / p["s"] * 1000).cast("int"))))


def box_to_resized(box: Column, height: Column, width: Column, new_height: Column, new_width: Column) -> Column:
    ratios, tops = F.array(new_width / width, new_height / height, new_width / width, new_height / height), F.array(new_width, new_height, new_width, new_height)
    zipped = F.arrays_zip(box.alias("x"), ratios.alias("r"), tops.alias("t"))
    return F.transform(zipped, lambda p: F.greatest(F.lit(0), F.least((p["t"] - 1).cast("int"), F.bround(p["x"] * p["r"]).cast("int"))))


def corners_to_sides(box: Column) -> Column:
    return F.array(box[0], box[1], box[2] - box[0], box[3] - box[1])


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two corner boxes."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    both = area(a) + area(b) - w * h
    return F.when(both > 0, w * h / both).otherwise(0.0)


def unit_quaternion(q: list[Column], identity: bool) -> list[Column]:
    """Length 1; a vanishing one stays as it is, or becomes the identity."""
    norm = F.sqrt(sum((x * x for x in q[1:]), q[0] * q[0]))
    return [F.when(norm > 1e-12, x / norm).otherwise(F.lit(float(k == 0)) if identity else x) for k, x in enumerate(q)]


def turn(p: list[Column], q: list[Column]) -> Column:
    """The angle between two unit quaternions."""
    dot = sum((a * b for a, b in zip(p[1:], q[1:])), p[0] * q[0])
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(dot)))


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0])))


def box_corners(x, y, z, sx, sy, sz, pitch, yaw, roll) -> list[tuple[Column, Column, Column]]:
    """The corners of a box turned about x, then y, then z (degrees)."""
    cp, sp, cy, sy_, cr, sr = F.cos(F.radians(pitch)), F.sin(F.radians(pitch)), F.cos(F.radians(yaw)), F.sin(F.radians(yaw)), F.cos(F.radians(roll)), F.sin(F.radians(roll))
    out = []
    for i in (-0.5, 0.5):
        for j in (-0.5, 0.5):
            for k in (-0.5, 0.5):
                a, b, c = sx * i, sy * j, sz * k
                b, c = b * cp - c * sp, b * sp + c * cp
                a, c = a * cy + c * sy_, c * cy - a * sy_
                a, b = a * cr - b * sr, a * sr + b * cr
                out.append((x + a, y + b, z + c))
    return out


def pinhole(point: tuple[Column, Column, Column], fx: float, fy: float, cx: float, cy: float) -> Column:
    """Where a camera sees a point; null behind it."""
    x, y, z = point
    return F.when(z > 0, F.struct((x / z * fx + cx).alias("u"), (y / z * fy + cy).alias("v")))


def box_in_pixels(box: Column, width: Column, height: Column, seen_width: Column, seen_height: Column, relative: bool = False) -> Column:
    """A predicted box in pixels of the image: from the size that the model saw, or from thousandths."""
    w, h = (width / 1000, height / 1000) if relative else (width / seen_width, height / seen_height)
    return F.array(box[0] * w, box[1] * h, box[2] * w, box[3] * h)


def camera(width: Column, height: Column, fov: float) -> Column:
    half = 2 * F.tan(F.radians(F.lit(fov)) / 2)
    return F.struct(F.bround(width / half, 2).alias("fx"), F.bround(height / half, 2).alias("fy"), F.bround(width / 2, 2).alias("cx"), F.bround(height / 2, 2).alias("cy"))
