"""Whole tables into bins and batches: ranks without a global sort, packing by patterns of lengths, and collated batches.

What the driver sees is a histogram of lengths, which is bounded by the size of a bin. Rows are numbered within their group part by part: a part is
a bounded number of rows by a hash of their key, and parts are put behind each other by their counts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions import arrays
from quernel.operators.prep import IGNORED, padded

#: Rows of a part, which one task sorts.
PART_ROWS = 1_000_000
#: Lengths of one bucket differ by a factor of 2 ** (1 / STEPS) at most.
STEPS = 4
#: Fixed value: what positions are filled with.
POSITION_FILL = 1


def ranked(rows: DataFrame, group: str, key: str, name: str = "rank", part_rows: int = PART_ROWS) -> DataFrame:
    """Add a number from 0 on within each group. A group of any size is several parts, of about ``part_rows`` rows of the table each; rows with one key are numbered in any order."""
    parts = max(1, -(-rows.count() // part_rows))
    part = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(parts)).cast("int")
    dealt = rows.withColumn("_part", part)
    counts = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_part").orderBy(key)) - 1
    numbered = dealt.withColumn("_own", own).join(places, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return numbered.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_group", "_of", "_before")


# ---- Packing


def patterns(counts: dict[int, int], most: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Bins for a histogram of lengths: pairs of (lengths with how many of each, how many such bins).

    A bin takes the longest length that fits, as often as it fits, then the next one. The same bin is made as often as the counts allow, so each
    step uses up a length, and the work depends on the number of lengths, not of items.
    """
    left = dict(sorted((n, c) for n, c in counts.items() if c > 0))
    lengths = list(left)
    while lengths:
        room, at, chosen = most, len(lengths), []
        while at and room > 0:
            at = min(at, bisect_left(lengths, room + 1)) - 1
            if at < 0:
                break
            n = lengths[at]
            times = min(room // n, left[n])
            chosen.append((n, times))
            room -= n * times
        bins = min(left[n] // times for n, times in chosen)
        yield chosen, bins
        for n, times in chosen:
            left[n] -= bins * times
            if not left[n]:
                del left[n]
                lengths.remove(n)


class Slots:
    """Which bin takes the item of a length and rank."""

    def __init__(self, counts: dict[int, int], most: int):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        self.bins = 0
        for chosen, bins in patterns(counts, most):
            for n, times in chosen:
                rows.setdefault(n, []).append((used.get(n, 0), times, self.bins))
                used[n] = used.get(n, 0) + bins * times
            self.bins += bins
        self.rows = {n: tuple(np.array(x) for x in zip(*found)) for n, found in rows.items()}

    def bin_of(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            mine = length == n
            first, times, begin = self.rows[n]
            k = np.searchsorted(first, rank[mine], side="right") - 1
            out[mine] = begin[k] + (rank[mine] - first[k]) // times[k]
        return out


def packed_by_patterns(items: DataFrame, key: str, size: str, most: int, part_rows: int = PART_ROWS) -> DataFrame:
    """(key, size, bin): items of a whole table in bins of ``most``. An item that is larger has a bin of its own; null and sizes below 1 count as 1."""
    sized = items.select(key, size, F.least(F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(1)), F.lit(1)), F.lit(most)).alias("_length"))
    counts = {r["_length"]: r["count"] for r in sized.groupBy("_length").count().collect()}  # a row a length, ``most`` at most
    slots = Slots(counts, most)
    schema = sized.withColumn("bin", F.lit(0).cast("long")).drop("_length", "_rank").schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = slots.bin_of(batch.column("_length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(size), pa.array(found)], [key, size, "bin"])

    return ranked(sized, "_length", key, "_rank", part_rows).mapInArrow(place, schema)


# ---- Batches


def bucket_top(length: Column) -> Column:
    """The largest length of a length's bucket: lengths grow by a fixed factor from bucket to bucket."""
    step = F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double")) * STEPS - 1e-9)
    return F.greatest(F.floor(F.pow(F.lit(2.0), step / STEPS) + 1e-9), F.lit(1)).cast("long")


def batch_numbers(rows: DataFrame, key: str, length: str, tokens: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Add ``batch_top`` and ``batch_at``: rows of like lengths in batches that take at most ``tokens`` when all are filled to their bucket's largest length. A longer row is a batch alone."""
    numbered = ranked(rows.withColumn("batch_top", bucket_top(F.col(length))), "batch_top", key, "_rank", part_rows)
    return numbered.withColumn("batch_at", F.floor(F.col("_rank") / F.greatest(F.lit(1), F.floor(F.lit(tokens) / F.col("batch_top")))).cast("long")).drop("_rank")


def places_of(tokens: list[int]) -> Column:
    """For each member of a batch the last place of any of some tokens."""
    return F.transform("m", lambda x: F.greatest(*(arrays.last_place(x["ids"], t) for t in tokens), F.lit(-1)))


def collated(rows: DataFrame, key: str, tokens: int, pad: int, longest: int, queries: dict[str, int] | None = None, votes: list[int] | None = None, seed: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """Batches of rows with ``ids``, ``labels`` and ``positions`` (3 arrays): one row a batch, its members in the order of the key.

    Sequences are cut to ``longest`` and filled to the batch's longest one: ids with ``pad``, labels with the one that is ignored, positions with 1. The mask
    is what is not padding. ``votes`` (with ``queries``) puts one of several tokens, drawn by a hash, in the place of the last "current" token, and
    tells which; for each query the last place of its token is given, -1 without one ("current" finds votes too).
    """
    cut = rows.withColumn("ids", F.slice("ids", 1, longest)).withColumn("labels", F.slice("labels", 1, longest)).withColumn("positions", F.transform("positions", lambda p: F.slice(p, 1, longest)))
    queries = queries or {}
    member = {"key": F.col(key), "ids": F.col("ids"), "labels": F.col("labels"), "positions": F.col("positions")}
    if votes:
        current = queries["current"]
        drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(len(votes))).cast("int")
        member["ids"] = arrays.one_vote(F.col("ids"), current, votes, key, seed=seed)
        member["vote"] = F.when(F.array_contains("ids", current), drawn).otherwise(F.lit(0))
    dealt = batch_numbers(cut.withColumn("_n", F.size("ids")), key, "_n", tokens, part_rows)
    packed = dealt.groupBy("batch_top", "batch_at").agg(F.array_sort(F.collect_list(F.struct(*(v.alias(k) for k, v in member.items())))).alias("m"))
    width = F.array_max(F.transform("m", lambda x: F.size(x["ids"])))
    wide = packed.withColumn("width", width)
    each = lambda name, fill: F.transform("m", lambda x: padded(x[name], F.col("width"), fill))
    out = {
        "batch_top": F.col("batch_top"), "batch_at": F.col("batch_at"), "width": F.col("width"), "keys": F.transform("m", lambda x: x["key"]), "input_ids": each("ids", pad), "labels": each("labels", IGNORED),
        "attention_mask": F.transform("m", lambda x: F.transform(padded(x["ids"], F.col("width"), pad), lambda t: t != pad)),
        "position_ids": F.transform("m", lambda x: F.transform(x["positions"], lambda p: padded(p, F.col("width"), POSITION_FILL))),
    }
    for name, token in queries.items():
        out[f"{name}_place"] = places_of([token, *(votes or [])] if name == "current" else [token])
    if votes:
        out["votes"] = F.transform("m", lambda x: x["vote"])
    return wide.select(*(v.alias(k) for k, v in out.items()))
