"""Choices: top rows of groups, seeded samples, splits and shares. Randomness is a hash of a key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: str, seed: int) -> Column:
    """An order by hash, the same in every run."""
    return F.xxhash64(F.lit(seed), key)


def error_type(label: Column, pred: Column, threshold: float) -> Column:
    return F.when((label < threshold) & (pred == 1), "fp").when((label >= threshold) & (pred == 0), "fn")


def worst(rows: DataFrame, kind: str, score: str, limit: int, tie: str) -> DataFrame:
    """The first ``limit`` of false positives by falling and of false negatives by rising score."""
    signed = F.when(F.col(kind) == "fp", -F.col(score)).otherwise(F.col(score))
    order = Window.partitionBy(kind).orderBy(signed, tie)
    return rows.filter(F.col(kind).isNotNull()).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def best_of(rows: DataFrame, group: list[str], score: str, tie: str) -> DataFrame:
    """The row of the highest score of each group; the first by ``tie`` among equals."""
    fields = F.struct((-F.col(score)).alias("_first"), F.col(tie).alias("_then"), *(F.col(c) for c in rows.columns if c not in group))
    return rows.groupBy(*group).agg(F.min(fields).alias("b")).select(*group, *(F.col(f"b.{c}") for c in rows.columns if c not in group))


def per_group(rows: DataFrame, group: str, order: list[Column], each: int, total: int | None = None) -> DataFrame:
    """At most ``each`` rows of each group and ``total`` rows in all, in the given order."""
    kept = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_rn") <= each).drop("_rn")
    return kept if total is None else kept.orderBy(*order).limit(total)


def error_score(kind: Column, prob: Column) -> Column:
    """How bad an error is: the probability of a false positive, what lacks to it for a false negative."""
    return F.when(kind == "fp", prob).when(kind == "fn", 1 - prob)


def episode_errors(rows: DataFrame, episode: list[str], selection: str, seed: int, number: str, each: str | None = None, limit: int | None = None) -> DataFrame:
    """The worst error of each episode (columns kind, score), ranked: worst first, in a seeded order, or by number; at most ``limit`` of all or of each group.

    ``rank`` counts from 1 on. Episodes of one score are in the order of their numbers.
    """
    best = best_of(rows.filter(F.col("kind").isNotNull()), episode, "score", number)
    orders = {"worst": [F.desc("score"), F.col(number)], "random": [F.xxhash64(F.lit(seed), *episode), F.col(number)]}
    order = orders.get(selection, [F.col(number)])
    if each is None:
        kept = best.orderBy(*order)
        return kept if limit is None else kept.limit(limit)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(each).orderBy(*order)))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def one_episode_a_task(samples: DataFrame, task: str, episode: str, seed: int, tasks: int | None = None) -> DataFrame:
    """All samples of one episode of each task, drawn by a hash; at most so many tasks, in a seeded order."""
    episodes = samples.select(task, episode).distinct()
    drawn = episodes.groupBy(task).agg(F.min(F.struct(F.xxhash64(F.lit(seed), task, episode).alias("h"), F.col(episode).alias("e")))["e"].alias(episode))
    if tasks is not None:
        drawn = drawn.orderBy(F.xxhash64(F.lit(seed), task), task).limit(tasks)
    return samples.join(drawn, [task, episode], "left_semi")


def sample(rows: DataFrame, key: str, n: int, seed: int, shuffle: bool = True) -> DataFrame:
    """n rows by hash (or by key); all rows for n of 0 or less."""
    return rows if n <= 0 else rows.orderBy(shuffled(key, seed) if shuffle else F.col(key), key).limit(n)


def one_per_group(rows: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    return per_group(rows, group, [shuffled(key, seed), F.col(key)], 1)


def batches(rows: DataFrame, order: str, size: int, group: str) -> DataFrame:
    """Numbers batches of ``size`` rows inside each group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size))


def nearest_boundary(candidates: DataFrame, key: list[str], lead: int = 4) -> DataFrame:
    """The boundary of a move: the first gripper candidate, unless a motion precedes it by more than ``lead`` frames; else the earliest."""
    out = candidates.groupBy(*key).agg(
        F.min(F.when(F.col("source").contains("gripper"), F.struct("frame", "source"))).alias("grip"), F.min(F.when(~F.col("source").contains("gripper"), F.struct("frame", "source"))).alias("move")
    )
    early = F.col("move.frame") < F.col("grip.frame") - lead
    pick = F.when(F.col("grip").isNull() | early, F.col("move")).otherwise(F.col("grip"))
    return out.select(*key, pick["frame"].alias("frame"), pick["source"].alias("source"))


def first_by_hash(rows: DataFrame, groups: list[str], hashed: Column, tie: str, wanted) -> DataFrame:
    """The first ``wanted(n)`` of each group's n rows in order of a hex hash and ``tie``.

    Rows are counted by the hash's first four digits, and only the bucket in which the last wanted row lies is ranked, so no task
    sorts a whole group.
    """
    marked = rows.withColumn("_hash", hashed).withColumn("_bucket", F.left("_hash", F.lit(4)))
    counted = marked.groupBy(*groups, "_bucket").agg(F.count("*").alias("n"))
    order, whole = Window.partitionBy(*groups).orderBy("_bucket"), Window.partitionBy(*groups)
    sums = counted.withColumn("upto", F.sum("n").over(order)).withColumn("want", wanted(F.sum("n").over(whole)).cast("long"))
    named = [F.col(g).alias(f"_{g}") for g in groups]
    edges = sums.filter("upto >= want").groupBy(*named, F.col("want").alias("_want")).agg(F.min(F.struct("_bucket", (F.col("upto") - F.col("n")).alias("below"))).alias("_edge"))
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    # one row a group: groups are few beside their rows
    met = marked.join(edges, same) if groups else marked.crossJoin(F.broadcast(edges))
    place = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("_hash", tie))
    sure = met.filter(F.col("_bucket") < F.col("_edge._bucket"))
    last = met.filter(F.col("_bucket") == F.col("_edge._bucket")).withColumn("_rn", place).filter(F.col("_rn") + F.col("_edge.below") <= F.col("_want"))
    return sure.select(*rows.columns).unionByName(last.select(*rows.columns))


#: Groups whose tables of a few numbers each are broadcast; with more groups they are joined by shuffle.
BROADCAST_GROUPS = 200_000


def values_at(rows: DataFrame, group: str, value: str, places: dict[str, Column], bins: int = 4096) -> DataFrame:
    """For each group the values at some places of its rows in order of the value (0 is the first); a place is a column of ``n``.

    Values are counted by bins between the group's extremes; only the bins that hold a place are looked at value by value.
    """
    few = rows.select(group).distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    short = F.broadcast if few else lambda table: table
    bounds = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    width = F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-300))
    number = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_low")) / width * bins)).cast("long")
    binned = rows.select(group, value).join(short(bounds), group).withColumn("_bin", number)
    counted = binned.groupBy(group, "_bin").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy(group).orderBy("_bin")))
    asked = bounds.select(group, F.explode(F.array(*(F.struct(F.lit(k).alias("name"), p.cast("long").alias("place")) for k, p in places.items()))).alias("a")).select(group, "a.*")
    hits = counted.join(short(asked), group).filter((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place")))
    hits = hits.select(group, "_bin", "name", (F.col("place") - (F.col("upto") - F.col("c"))).alias("at"))
    near = binned.join(short(hits), [group, "_bin"]).groupBy(group, "name", "at", value).agg(F.count("*").alias("c"))
    near = near.withColumn("upto", F.sum("c").over(Window.partitionBy(group, "name").orderBy(value))).filter(F.col("upto") > F.col("at"))
    return near.groupBy(group).agg(*(F.min(F.when(F.col("name") == k, F.col(value))).alias(k) for k in places))
