"""Annotations of whole episodes: events, steps, spans and the passes after them, and repositories of episodes by their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions import goals as G
from quernel.operators import spans as S
from quernel.operators import tasks, trajectory

#: What an annotation tells of how it was made.
POLICIES = {"fine": "atomic actions with simultaneous delayed termination candidates", "coarse": "coarse motion segments with at most one terminal gripper event"}
KEEP_PLACES = ("place_a2b_left", "place_a2b_right")


def annotate(episodes: DataFrame, frames: DataFrame, granularity: str = "fine") -> DataFrame:
    """(ep, task_slug, task_goal, num_frames, subtasks, events, policy) of episodes (ep, slug, goal, info map) that have frames.

    Places to the left and right are told as seen from the other side, but for the two tasks that are about them.
    """
    events = trajectory.gripper_events(frames)
    steps = tasks.steps_of(episodes, events, granularity)
    slugs = episodes.select("ep", "slug")
    found = S.assign(frames, events, steps, slugs, retreat_tasks=tasks.RETREAT_TASKS, in_time_order=tasks.IN_TIME_ORDER) if granularity == "fine" else S.assign_coarse(frames, events, steps, slugs, unmerged=tasks.UNMERGED_TEXTS)
    told = found.join(slugs, "ep")
    goal = F.when(F.coalesce("slug", F.lit("")).isin(*KEEP_PLACES), F.col("goal")).otherwise(G.flip_places(F.col("goal")))
    span = F.struct(F.col("idx").alias("subtask_index"), goal.alias("subtask_goal"), "subtask_type", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), F.col("source").alias("boundary_source"), F.col("rule").alias("truncation_rule"), F.col("gap_fill").alias("gap_fill_policy"))
    listed = told.groupBy("ep").agg(F.array_sort(F.collect_list(span)).alias("subtasks"))
    seen = events.groupBy("ep").agg(F.array_sort(F.collect_list(F.struct("frame", "arm", "kind", "start_frame", "end_frame"))).alias("events"))
    sizes = frames.groupBy("ep").agg(F.count("*").alias("num_frames"))
    out = episodes.join(sizes, "ep").join(listed, "ep", "left").join(seen, "ep", "left")
    whole = canonical(F.col("slug"), F.coalesce("goal", F.lit("")))
    shown = F.when(F.coalesce("slug", F.lit("")).isin(*KEEP_PLACES), whole).otherwise(G.flip_places(whole))
    return out.select("ep", F.col("slug").alias("task_slug"), shown.alias("task_goal"), "num_frames", "subtasks", F.coalesce("events", F.array().cast(out.schema["events"].dataType)).alias("events"), F.lit(POLICIES[granularity]).alias("policy"))


def canonical(slug: Column, goal: Column) -> Column:
    """The goal that an annotation has."""
    out = F.when(slug == "place_bread_basket", F.array_join(F.filter(F.split(F.regexp_replace(goal, r"(?i)\b(the|a|an)(?:\s+\1\b)+", "$1"), r"\s+"), lambda w: w != ""), " ")).otherwise(goal)
    for name, fixed in tasks.GOALS.items():
        out = F.when(slug == name, fixed).otherwise(out)
    return out


def discovered(files: DataFrame, path: str = "path", wanted: str | None = None, exact: bool = False) -> DataFrame:
    """(repo, episode, path) of episode files below repositories, which have data and meta folders; some repositories by a part of their name or the whole."""
    parts = files.select(F.col(path).alias("path"), F.regexp_extract(path, r"([^/]+)/data/chunk-[^/]+/episode_(\d+)\.parquet$", 1).alias("repo"), F.regexp_extract(path, r"/episode_(\d+)\.parquet$", 1).try_cast("int").alias("episode"))
    meta = files.select(F.regexp_extract(path, r"([^/]+)/meta/info\.json$", 1).alias("repo")).filter("repo != ''").distinct()
    found = parts.filter("repo != ''").join(meta, "repo", "left_semi")
    if wanted is None:
        return found
    return found.filter(F.col("repo") == wanted if exact else F.contains("repo", F.lit(wanted)))


def scenes(episodes: DataFrame, scene: DataFrame, metas: DataFrame) -> DataFrame:
    """(repo, episode, info): the scene of each episode (repo, episode, folder) from scene files (folder, key, info map).

    A file of the source (repo, episode, source_path) tells which raw episode it is; without one, or without a number in it, the number is the same. No
    scene gives an empty map.
    """
    raw = F.coalesce(F.regexp_extract("source_path", r"episode(\d+)\.hdf5$", 1).try_cast("int"), F.col("episode"))
    keyed = episodes.join(metas, ["repo", "episode"], "left").withColumn("key", F.concat(F.lit("episode_"), raw.cast("string")))
    none = F.create_map().cast("map<string,string>")
    return keyed.join(scene, ["folder", "key"], "left").select("repo", "episode", F.coalesce("info", none).alias("info"))


def with_frames(annotations: DataFrame, views: DataFrame, needed: tuple[str, ...], least: int = 1, most: int | None = None) -> DataFrame:
    """Annotations with spans and all needed views, of at least and at most so many frames."""
    there = views.filter(F.col("view").isin(*needed)).groupBy("ep").agg(F.count_distinct("view").alias("n")).filter(F.col("n") == len(set(needed)))
    kept = annotations.filter((F.size("subtasks") > 0) & (F.col("num_frames") >= least)).join(there, "ep", "left_semi")
    return kept if most is None else kept.filter(F.col("num_frames") <= most)
