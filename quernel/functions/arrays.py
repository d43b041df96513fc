"""Array functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled_down(values: Column, by: int, more: float = 0.0) -> Column:
    """Each number times ``by``, and some more, rounded down. All is done in single precision, as the values are; a whole number would widen them."""
    return F.transform(values.cast("array<float>"), lambda x: F.floor(x * F.lit(by).cast("float") + F.lit(more).cast("float")).cast("int"))


def clipped_frames(frames: Column, n: Column) -> Column:
    """Sorted distinct frames inside a video."""
    return F.array_sort(F.array_distinct(F.filter(frames, lambda f: (f >= 0) & (f < n))))


def options(values: Column) -> Column:
    """Option strings "A. text" as a map from letter to text."""
    return F.map_from_entries(F.transform(values, lambda v: F.struct(F.trim(F.substring_index(v, ".", 1)), F.trim(F.substr(v, F.locate(".", v) + 1)))))


def last_place(values: Column, wanted: int) -> Column:
    """The place of the last equal element from 0 on, -1 without one."""
    back = F.array_position(F.reverse(values), wanted)
    return F.when(back > 0, F.size(values) - back).otherwise(F.lit(-1)).cast("int")


def expanded(values: Column, wanted: int, by: list[int]) -> Column:
    """The last equal element replaced by several."""
    at = last_place(values, wanted)
    put = F.concat(F.slice(values, 1, F.greatest(at, F.lit(0))), F.array(*map(F.lit, by)), F.slice(values, at + 2, F.size(values)))
    return F.when(at >= 0, put).otherwise(values)


def one_vote(values: Column, wanted: int, votes: list[int], *key: str, seed: int = 0) -> Column:
    """The last equal element replaced by one of several, chosen by a hash of the key."""
    at = last_place(values, wanted)
    chosen = F.element_at(F.array(*map(F.lit, votes)), (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(len(votes))) + 1).cast("int"))
    return F.transform(values, lambda x, k: F.when(k == at, chosen).otherwise(x))


def observation(left: Column, left_grip: Column, right: Column, right_grip: Column) -> Column:
    """16 numbers of a state from two poses of seven and two grippers, with unit quaternions (identity where they vanish)."""

    def part(pose: Column, grip: Column) -> Column:
        q = F.slice(pose, 4, 4)
        norm = F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, x: a + x * x))
        unit = F.when(norm > 1e-12, F.transform(q, lambda x: x / norm)).otherwise(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
        return F.concat(F.slice(pose, 1, 3), unit, F.array(grip.cast("double")))

    good = (F.size(left) == 7) & (F.size(right) == 7)
    return F.when(good, F.concat(part(left, left_grip), part(right, right_grip))).otherwise(F.raise_error(F.lit("a pose needs 7 numbers")))


def prompt_values(state: Column) -> Column:
    """Both grippers and heights of a state; null for short states."""
    return F.when(F.size(state) > 15, F.struct(state[7].alias("left_grip"), state[15].alias("right_grip"), state[2].alias("left_z"), state[10].alias("right_z")))


def messages(parts: Column) -> Column:
    """Content parts with a type of their own: text, image or video; others are dropped."""
    typed = F.transform(parts, lambda p: F.struct(F.when(p["text"].isNotNull(), "text").when(p["image"].isNotNull(), "image").when(p["video"].isNotNull(), "video").alias("type"), F.coalesce(p["text"], p["image"], p["video"]).alias("value")))
    return F.filter(typed, lambda p: p["type"].isNotNull())


def even_fill(frames: Column) -> Column:
    """The last frame again where the number is odd."""
    return F.when(F.size(frames) % 2 == 1, F.concat(frames, F.array(F.element_at(frames, -1)))).otherwise(frames)
