"""Preparing training items: checks, placeholder binding, labels, positions, masks, padding and packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The label that the loss passes over, and the marks of media.
IGNORED = -100
MARKS = ("<image>", "<video>")


def check_items(items: DataFrame) -> DataFrame:
    """Add the counts of placeholders and media of each item, and its problems.

    ``items``: image, video (arrays), conversations (array of from, value). Marks count in human turns; one in an answer is a problem.
    """
    value = lambda role: F.array_join(F.transform(F.filter("conversations", lambda t: t["from"] == role), lambda t: t["value"]), "\n")
    count = lambda text, mark: F.size(F.split(text, mark)) - 1
    out = items.withColumn("asked", value("human")).withColumn("answered", value("gpt"))
    for mark, column in zip(MARKS, ("image", "video")):
        out = out.withColumn(f"n_{column}_marks", count(F.col("asked"), mark)).withColumn(f"n_{column}", F.coalesce(F.array_size(column), F.lit(0)))
    problems = [F.when(F.col(f"n_{c}_marks") > F.col(f"n_{c}"), f"more {c} marks than media") for c in ("image", "video")]
    problems += [F.when(F.col(f"n_{c}_marks") < F.col(f"n_{c}"), f"unused {c}") for c in ("image", "video")]
    problems.append(F.when(F.col("answered").rlike("|".join(MARKS)), "a mark in an answer"))
    return out.withColumn("problems", F.filter(F.array(*problems), lambda p: p.isNotNull())).drop("asked", "answered")


def bound_media(items: DataFrame, key: str) -> DataFrame:
    """(key, pos, kind, medium): the k-th mark of a kind takes the k-th medium; a count that differs fails the job."""
    checked = check_items(items)
    marks = F.array_join(F.transform(F.filter("conversations", lambda t: t["from"] == "human"), lambda t: t["value"]), "\n")
    found = F.regexp_extract_all(marks, F.lit("<(image|video)>"), F.lit(1))
    good = F.when(F.size("problems") == 0, found).otherwise(F.raise_error(F.concat_ws("; ", "problems")))
    nth = lambda x, i, kind: F.size(F.filter(F.slice(F.col("found"), 1, i + 1), lambda k: k == kind))
    bound = F.transform("found", lambda x, i: F.struct(i.alias("pos"), x.alias("kind"), F.when(x == "image", F.get("image", nth(x, i, "image") - 1)).otherwise(F.get("video", nth(x, i, "video") - 1)).alias("medium")))
    return checked.withColumn("found", good).select(key, F.explode(bound).alias("b")).select(key, "b.*")


def answer_labels(ids: Column, begin: int, end: int) -> Column:
    """Labels: the ids of answers, from two after each begin mark to one after the next end mark; all others are ignored.

    An answer without an end stays ignored. All lists of a batch are one row of numbers, in which the next end is looked up, so the work is
    in proportion to the ids.
    """

    @F.arrow_udf("array<int>")
    def labels(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.list_(pa.int32()))
        ids, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.r_[0, np.cumsum(sizes)]
        there = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy()
        begins, ends = (np.flatnonzero(there & (values == mark)) for mark in (begin, end))
        stop = np.r_[ends, len(values)][np.searchsorted(ends, begins + 2)]
        last = bounds[np.searchsorted(bounds, begins, "right")]
        good = stop < last
        marks = np.zeros(len(values) + 2, np.int64)
        np.add.at(marks, begins[good] + 2, 1)
        # one after the end, as long as the list goes
        np.add.at(marks, np.minimum(stop[good] + 2, last[good]), -1)
        inside = np.cumsum(marks)[: len(values)] > 0
        out = pc.if_else(pa.array(inside), ids, pa.scalar(IGNORED, pa.int32()))
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), out, mask=lists.is_null() if lists.null_count else None)

    return labels(ids)


class Rooms:
    """Bins of one size; the first that has room for an item is found in a tree of the largest room below each node."""

    def __init__(self, size: int, most: int):
        self.size, self.leaves = size, 1 << max(0, (most - 1).bit_length())
        self.room = [size] * (2 * self.leaves)

    def put(self, n: int) -> int:
        """The bin that takes an item. One larger than a bin goes to the first empty one, alone."""
        wanted, node = min(n, self.size), 1
        while node < self.leaves:
            node = 2 * node if self.room[2 * node] >= wanted else 2 * node + 1
        place = node - self.leaves
        self.room[node] -= wanted
        while node > 1:
            node //= 2
            self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])
        return place


def packed(items: DataFrame, key: str, size: str, shard: str, most: int) -> DataFrame:
    """(shard, bin, key, size): first-fit packing, largest first, in each shard. A shard is a bounded number of items."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values([size, key], ascending=[False, True])
        rooms = Rooms(most, len(ordered))
        return ordered.assign(bin=[rooms.put(int(n)) for n in ordered[size]])[[shard, "bin", key, size]]

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    return items.select(shard, key, size).groupBy(shard).applyInPandas(pack, f"{shard} {kinds[shard]}, bin long, {key} {kinds[key]}, {size} {kinds[size]}")


def padded(values: Column, length: int, fill: int) -> Column:
    """Cut or filled on the right to a length."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), length)), 1, length)


def flattened(rows: DataFrame, pack: str, order: str, ids: str) -> DataFrame:
    """(pack, ids, bounds): a pack's sequences in a row and the running sums of their lengths, from 0 on. A pack is bounded by its size."""
    joined = rows.groupBy(pack).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, ids))), lambda x: x[ids]).alias("all"))
    sizes = F.transform("all", lambda x: F.size(x))
    bounds = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return joined.select(pack, F.flatten("all").alias("ids"), bounds.alias("bounds"))


def rope_positions(ids: list[int], image: int, video: int, image_grids: list, video_grids: list, merge: int = 2, per_frame: bool = True) -> np.ndarray:
    """Time, height and width positions (3 rows) of a sequence with vision blocks.

    Text counts up on all axes. A vision block of t x h x w patches, merged ``merge`` to one on both sides, takes a grid that
    begins after the last position; ``per_frame``: a video is a block of one time step for each frame.
    """
    out = np.zeros((3, len(ids)), np.int64)
    grids = {image: [tuple(g) for g in image_grids], video: []}
    for t, h, w in video_grids:
        grids[video] += [(1, h, w)] * t if per_frame else [(t, h, w)]
    at = position = 0
    used = {image: 0, video: 0}
    marks = {k: np.flatnonzero(np.asarray(ids) == k) for k in grids}
    while at < len(ids):
        kind = ids[at]
        if kind in grids and used[kind] < len(grids[kind]):
            t, h, w = grids[kind][used[kind]]
            used[kind] += 1
            h, w = h // merge, w // merge
            block = np.indices((t, h, w)).reshape(3, -1) + position
            out[:, at : at + block.shape[1]] = block[:, : len(ids) - at]
            at += block.shape[1]
            position = int(block.max()) + 1
        else:
            # a run of text up to the next block
            ahead = [places[places >= at] for k, places in marks.items() if used[k] < len(grids[k])]
            until = min((int(p[0]) for p in ahead if len(p) and p[0] > at), default=len(ids))
            out[:, at:until] = position + np.arange(until - at)
            at, position = until, position + until - at
    return out


def with_rope(rows: DataFrame, image: int, video: int, per_frame: bool = True) -> DataFrame:
    """Add ``positions`` (3 arrays) to rows with ids, image_grids and video_grids."""
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("positions", ArrayType(ArrayType(LongType())))])

    def add(frames):
        for pdf in frames:
            found = [rope_positions(list(i), image, video, list(a), list(b), per_frame=per_frame).tolist() for i, a, b in zip(pdf.ids, pdf.image_grids, pdf.video_grids)]
            yield pdf.assign(positions=pd.Series(found, index=pdf.index, dtype=object))

    return rows.mapInPandas(add, schema)


def query_mask(ids: Column, pad: int, queries: list[int]) -> Column:
    """The attention mask, a row for each place: earlier or equal places that are not padding; a query is seen by itself alone."""
    is_query = lambda x: F.array_contains(F.array(*map(F.lit, queries)), x)
    return F.transform(ids, lambda x, i: F.transform(ids, lambda y, j: (j <= i) & (y != pad) & (x != pad) & (~is_query(y) | (i == j))))


def mixture(rows: DataFrame, kinds: dict[str, float], kind: str, n: int, seed: int, key: str) -> DataFrame:
    """About n rows drawn with replacement so that kinds come in the given shares: a row comes as often as its hashed uniform tells."""
    sizes = rows.groupBy(kind).agg(F.count("*").alias("n_kind"))
    share = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col(kind))
    wanted = rows.join(sizes, kind).withColumn("rate", n * share / F.col("n_kind"))
    unit = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / (1 << 30)
    times = F.floor("rate") + (unit < F.col("rate") - F.floor("rate")).cast("long")
    return wanted.withColumn("times", times.cast("int")).select(*rows.columns, F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("one")).drop("one")
