"""Figures and tables of evaluations: windows of goals, errors, splits, detection results and sample manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions import jsonx
from quernel.functions import names as N
from quernel.functions import text as T

#: Fixed value: what the codes of tested programs mean.
CODES = {1: "passed", 0: "failed", -1: "errors", -2: "timeouts"}


def flattened(predictions: DataFrame) -> DataFrame:
    """A prediction's record as columns: those of its annotation, and the answer as text."""
    fields = [F.col(f"annotation.{f.name}").alias(f.name) for f in predictions.schema["annotation"].dataType]
    return predictions.select(*(F.col(c) for c in predictions.columns if c not in ("annotation", "result")), *fields, F.col("result.gen").cast("string").alias("prediction"))


def wide_choices(choices: Column, letters: str = "ABCDE") -> list[Column]:
    """A map of choices as a column each; null for those that are not there."""
    return [F.element_at(choices, x).alias(x) for x in letters]


def gold_letter(answer: Column) -> Column:
    """A capital letter, else A."""
    return F.when(answer.rlike("^[A-Z]$"), answer).otherwise("A")


def in_order(predictions: DataFrame, index: str) -> DataFrame:
    """By the index; rows of one index by all their values, so that the order is the same each time."""
    return predictions.orderBy(F.col(index).asc_nulls_last(), F.xxhash64(*predictions.columns))


def of_kind(samples: DataFrame, kind: str | None = None, group: str | None = None) -> DataFrame:
    """Samples of a kind, or of a group of frames; all without either."""
    out = samples if kind is None else samples.filter(F.col("kind") == kind)
    return out if group is None else out.filter(F.col("group") == group)


def plan_samples(samples: DataFrame, all_states: bool = False, span: int = 0) -> DataFrame:
    """Plan samples of all spans, or of one."""
    return samples if all_states else samples.filter(F.col("idx") == span)


def exact_rate(rows: DataFrame, said: str, wanted: str, task: str) -> DataFrame:
    """How many rows and tasks there are, and the share of rows whose texts are the same when normalised."""
    same = F.coalesce(jsonx.canonical(F.col(said)) == jsonx.canonical(F.col(wanted)), F.lit(False))
    return rows.agg(F.count("*").alias("n"), F.count_distinct(task).alias("tasks"), (F.coalesce(F.sum(same.cast("long")), F.lit(0)) / F.greatest(F.lit(1), F.count("*"))).alias("exact"))


def window_summary(rows: DataFrame, wanted: str, said: str, windows: list[int]) -> DataFrame:
    """For each window the means of its scores over all rows. Rows are scored once, and windows come in one pass."""
    scored = rows.select(F.explode(F.array(*(F.struct(F.lit(w).alias("window"), T.window_scores(F.col(wanted), F.col(said), w).alias("s")) for w in windows))).alias("x"))
    return scored.groupBy("x.window").agg(
        F.count("*").alias("n"), F.avg("x.s.bleu").alias("bleu"), F.avg("x.s.edits").alias("edits"), F.avg("x.s.share").alias("share"), F.avg(F.col("x.s.exact").cast("int")).alias("exact")
    )


def error_counts(rows: DataFrame, label: str, pred: str, threshold: float = 0.5, group: list[str] | None = None) -> DataFrame:
    """False positives and false negatives, in all or by group."""
    wanted, said = F.col(label) >= threshold, F.col(pred) == 1
    fp, fn = F.count_if(said & ~wanted), F.count_if(wanted & ~said)
    return rows.groupBy(*(group or [])).agg(fp.alias("fp"), fn.alias("fn"))


def worst_progress(rows: DataFrame, limit: int, tie: str) -> DataFrame:
    """The rows of the largest progress errors, largest first."""
    error = F.abs(F.col("progress_pred") - F.col("progress_label"))
    return rows.withColumn("error", error).orderBy(F.desc_nulls_last("error"), tie).limit(limit)


def available_frames(views: DataFrame, annotations: DataFrame, states: DataFrame) -> DataFrame:
    """(ep, n): the fewest frames over an episode's views, its annotation and its states. An episode needs a view and an annotation."""
    sums = views.groupBy("ep").agg(F.min("n").alias("seen"))
    had = states.groupBy("ep").agg(F.count("*").alias("had"))
    return sums.join(annotations.select("ep", "num_frames"), "ep").join(had, "ep", "left").select("ep", F.least("seen", "num_frames", F.coalesce("had", "num_frames")).cast("long").alias("n"))


def split_counts(groups: DataFrame, is_test: str) -> DataFrame:
    """How many groups there are in all, in training and in test."""
    test = F.count_if(F.col(is_test))
    return groups.agg(F.count("*").alias("n_all"), (F.count("*") - test).alias("n_train"), test.alias("n_test"))


def split_manifest(groups: DataFrame, name: str, is_test: str) -> DataFrame:
    """One row: names and numbers of all, training and test groups. Groups are tasks, so the row is short."""
    names = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col(name))))
    out = groups.agg(names(F.lit(True)).alias("all_tasks"), names(~F.col(is_test)).alias("train_tasks"), names(F.col(is_test)).alias("test_tasks"))
    return out.select(*(F.size(f"{k}_tasks").alias(f"num_{k}_tasks") for k in ("all", "train", "test")), "all_tasks", "train_tasks", "test_tasks")


def sample_key(samples: DataFrame, main_view: str = "main_path") -> DataFrame:
    """The five columns that tell a sample in a manifest."""
    return samples.select("repo", N.episode_of(F.col(main_view)).alias("episode_index"), "frame_index", "current_subtask_index", "q2_group")


def issue_report(issues: DataFrame, most: int = 50) -> DataFrame:
    """Counts by rule, and the repositories with the most issues: (of, name, n)."""
    by = lambda of, column: issues.groupBy(F.lit(of).alias("of"), F.col(column).alias("name")).agg(F.count("*").alias("n"))
    return by("rule", "rule").unionByName(by("repo", "repo").orderBy(F.desc("n"), "name").limit(most))


def tested(results: DataFrame, codes: str = "codes") -> DataFrame:
    """For each tested program how many tests passed, failed, broke and ran out of time, the share passed, and whether all did."""
    count = lambda code: F.size(F.filter(codes, lambda c: c == code))
    n = F.size(codes)
    return results.select(*(c for c in results.columns if c != codes), n.alias("total"), *(count(k).alias(name) for k, name in CODES.items()), (count(1) / F.greatest(F.lit(1), n)).alias("accuracy"), (count(1) == n).alias("all_passed"))


def conversion_report(episodes: DataFrame) -> DataFrame:
    """Per repository how many episodes are converted, skipped (there already) and failed (an error is told)."""
    failed = F.col("error").isNotNull()
    return episodes.groupBy("repo").agg(F.count_if(~failed & ~F.col("there")).alias("converted"), F.count_if(~failed & F.col("there")).alias("skipped"), F.count_if(failed).alias("failed"))


def class_index(boxes: DataFrame, classes: list[str]) -> DataFrame:
    """Boxes with the number of their class, in any case; unknown labels fall away."""
    places = F.create_map(*(F.lit(x) for k, name in reversed(list(enumerate(classes))) for x in (name.lower(), k))) if len({c.lower() for c in classes}) == len(classes) else None
    if places is None:
        raise ValueError("two classes have one name")
    return boxes.withColumn("category", F.element_at(places, F.lower("label"))).filter(F.col("category").isNotNull())


def boxes_of_images(boxes: DataFrame) -> DataFrame:
    """One row for each data set and image: its boxes, classes and scores, in one order."""
    item = F.struct("category", "box", F.coalesce("score", F.lit(1.0)).alias("score"))
    return boxes.groupBy("dataset", "image_id").agg(F.array_sort(F.collect_list(item)).alias("items")).select("dataset", "image_id", F.col("items.box").alias("bboxes"), F.col("items.category").alias("labels"), F.col("items.score").alias("scores"))


def detection_rows(images: DataFrame, categories: list[int]) -> DataFrame:
    """A row for each box of a result: the image, x, y, width and height, the score and the category's id."""
    each = F.explode(F.arrays_zip("bboxes", "labels", "scores")).alias("x")
    box = F.col("x.bboxes")
    ids = F.array(*map(F.lit, categories))
    return images.select("image_id", each).select("image_id", F.array(box[0], box[1], box[2] - box[0], box[3] - box[1]).alias("bbox"), F.col("x.scores").cast("double").alias("score"), F.element_at(ids, F.col("x.labels") + 1).alias("category_id"))


#: Results of one video at most, where no column tells videos apart.
LISTED = 10_000


def captioned(frames: DataFrame, results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each frame caption the last result whose text holds it; null without one.

    ``by`` has the columns that tell videos apart: each frame meets the list of its own video's results. Without them all results are one video's; more than ``LISTED`` are refused.
    """
    own = [F.lit(0).alias("_video")] if not by else [F.struct(*by).alias("_video")]
    if not by and results.limit(LISTED + 1).count() > LISTED:
        raise ValueError("too many results for one video; name the columns that tell videos apart")
    listed = results.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("pos", "text", "result"))).alias("found"))
    both = frames.withColumn("_video", F.lit(0) if not by else F.struct(*by)).join(listed, "_video", "left")
    holds = lambda x: F.contains(x["text"], F.col("caption"))
    return both.select(*frames.columns, F.when(F.exists("found", holds), F.element_at(F.filter("found", holds), -1)["result"]).alias("result"))


def seeded(rows: DataFrame, group: str, key: str, n: int, seed: int, first: bool = False) -> DataFrame:
    """n rows of each group, the first by key or by a hash of seed, group and key; all of them for n of 0 or less, or where there are no more."""
    if n <= 0:
        return rows
    order = [F.col(key)] if first else [F.xxhash64(F.lit(seed), group, key), F.col(key)]
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def survival(runs: DataFrame, least: tuple[int, ...] = (1, 2, 3, 4, 5, 10, 20, 50), value: str = "n") -> DataFrame:
    """(least, share): how many of all runs are at least so long."""
    means = runs.agg(*(F.avg((F.col(value) >= k).cast("int")).alias(f"k{k}") for k in least))
    return means.select(F.explode(F.array(*(F.struct(F.lit(k).alias("least"), F.col(f"k{k}").alias("share")) for k in least))).alias("x")).select("x.*")


def compact_span(span: Column) -> Column:
    """Four fields of a span for a report; null without a span."""
    return F.when(span.isNotNull(), F.struct(*(span[c].alias(c) for c in ("subtask_index", "subtask_type", "truncation_rule", "boundary_source"))))


def review(annotations: DataFrame, key: Column, source: Column, target: Column) -> DataFrame:
    """What a review of an episode's video lists."""
    spans = F.transform(
        "subtasks",
        lambda s: F.struct(s["subtask_index"].alias("index"), s["start_frame"].alias("start_frame"), s["end_frame"].alias("end_frame"), F.coalesce(s["boundary_source"], F.lit("")).alias("boundary_source"), s["subtask_goal"].alias("goal")),
    )
    return annotations.select("repo", N.slug_of_export(F.col("repo")).alias("task_slug"), "episode_index", F.coalesce("task_goal", F.lit("")).alias("task_goal"), key.alias("video_key"), source.alias("source_video"), target.alias("review_video"), F.lit("libx264").alias("codec"), F.lit("yuv420p").alias("pix_fmt"), spans.alias("subtasks"))


def boundary_frames(spans: DataFrame, reach: int) -> DataFrame:
    """(ep, idx, f): the frames around every boundary but the first, inside the episode."""
    last = F.max("end").over(Window.partitionBy("ep"))
    around = F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.col("start") + d))
    return spans.withColumn("last", last).filter("idx > 0").select("ep", "idx", "last", around.alias("f")).filter("f between 0 and last").drop("last")
