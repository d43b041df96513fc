"""Annotations of episodes from frames alone, repositories by their files, and rows made from spans."""

import numpy as np
from pyspark.sql import functions as F

from quernel.operators import annotate, samples, trajectory


def episode():
    """The left arm goes to a thing, grasps it, carries it and lets it go."""
    states = np.zeros((60, 16))
    states[:, 3] = states[:, 11] = 1
    states[:, 7] = states[:, 15] = 1
    states[3:15, 0] = np.linspace(0, 0.12, 12)
    states[15:, 0] = 0.12
    states[18:23, 7] = np.linspace(1, 0, 5)
    states[23:45, 7] = 0
    states[28:40, 1] = np.linspace(0, 0.2, 12)
    states[40:, 1] = 0.2
    states[45:50, 7] = np.linspace(0, 1, 5)
    return states


def tables(spark):
    frames = spark.createDataFrame([(1, k, row.tolist()) for k, row in enumerate(episode())], "ep long, f long, state array<double>").repartition(3)
    episodes = spark.createDataFrame([(1, "place_shoe", "Put the shoe on the mat, left side.", {"{A}": "041_shoe/base3", "{a}": "left"}), (2, "place_shoe", "no frames", {})], "ep long, slug string, goal string, info map<string,string>")
    return episodes, frames


def test_fine_annotation(spark):
    episodes, frames = tables(spark)
    (r,) = annotate.annotate(episodes, frames).collect()
    assert (r.ep, r.task_slug, r.num_frames, r.task_goal) == (1, "place_shoe", 60, "Put the shoe on the mat, right side.")
    assert [(e.frame, e.arm, e.kind) for e in r.events] == [(20, "left", "close"), (47, "left", "open")]
    assert [(s.subtask_index, s.subtask_type, s.start_frame, s.end_frame) for s in r.subtasks] == [(0, "move", 0, 17), (1, "close", 18, 28), (2, "move", 29, 44), (3, "open", 45, 59)]
    assert r.subtasks[0].subtask_goal == "Move the left arm to the grasp pose of the shoe." and r.subtasks[-1].truncation_rule == "episode_end"
    assert annotate.annotate(episodes, frames.filter("false")).count() == 0


def test_coarse_annotation(spark):
    (r,) = annotate.annotate(*tables(spark), granularity="coarse").collect()
    assert [s.subtask_type for s in r.subtasks] == ["single_grasp", "single_place"]
    assert r.subtasks[0].subtask_goal == "Grasp the shoe with the left arm." and r.subtasks[1].end_frame >= 49


def test_goals_of_annotations(spark):
    rows = spark.createDataFrame([("place_bread_basket", "Put the the the bread  in"), ("blocks_ranking_rgb", "x"), (None, "the the")], "slug string, goal string")
    got = [r.g for r in rows.select(annotate.canonical(F.col("slug"), F.col("goal")).alias("g")).collect()]
    assert got[0] == "Put the bread in" and got[1].startswith("Arrange") and got[2] == "the the"


def test_repositories(spark):
    files = spark.createDataFrame([(p,) for p in ("/d/one/data/chunk-000/episode_000003.parquet", "/d/one/meta/info.json", "/d/two/data/chunk-000/episode_000001.parquet", "/d/one/other.txt")], "path string")
    assert [(r.repo, r.episode) for r in annotate.discovered(files).collect()] == [("one", 3)]
    assert annotate.discovered(files, wanted="on").count() == 1 and annotate.discovered(files, wanted="on", exact=True).count() == 0
    episodes = spark.createDataFrame([("one", 3, "clean"), ("one", 4, "clean"), ("one", 5, "none")], "repo string, episode int, folder string")
    scene = spark.createDataFrame([("clean", "episode_9", {"{A}": "x"}), ("clean", "episode_4", {"{A}": "y"})], "folder string, key string, info map<string,string>")
    metas = spark.createDataFrame([("one", 3, "/raw/episode9.hdf5"), ("one", 4, "/raw/else")], "repo string, episode int, source_path string")
    assert {r.episode: r.info for r in annotate.scenes(episodes, scene, metas).collect()} == {3: {"{A}": "x"}, 4: {"{A}": "y"}, 5: {}}
    annos = spark.createDataFrame([(1, 10, [1]), (2, 10, []), (3, 99, [1])], "ep int, num_frames int, subtasks array<int>")
    views = spark.createDataFrame([(e, v) for e in (1, 2, 3) for v in ("main", "left_wrist")] + [(1, "main")], "ep int, view string")
    assert [r.ep for r in annotate.with_frames(annos, views, ("main", "left_wrist"), most=50).collect()] == [1]
    assert annotate.with_frames(annos, views, ("main", "right_wrist")).count() == 0


def test_rows_of_spans(spark):
    _, frames = tables(spark)
    spans = spark.createDataFrame([(1, 0, 0, 17, True, False), (1, 1, 18, 59, True, True)], "ep long, idx int, start long, end long, left boolean, right boolean")
    rows = {(r.idx, r.f): r for r in samples.curve_rows(frames, spans).collect()}
    assert len(rows) == 60 and rows[(0, 17)].done == 1 and rows[(0, 0)].progress == 0 and rows[(0, 8)].turn is None and 0 < rows[(0, 8)].path < 1
    assert samples.curve_rows(frames, spans, 10).count() == 6
    made = samples.entries(frames, spans, stride=5)
    assert [r.number for r in made.orderBy("number").collect()] == list(range(made.count()))
    ordered = made.orderBy("number").collect()
    assert [(r.f, r.idx) for r in ordered] == sorted((r.f, r.idx) for r in ordered)
    assert samples.perfect(made).filter("done_prob != done_label or progress_abs_err != 0").count() == 0
    assert samples.only_previous(made).count() == 8 and samples.without_previous(made).count() == made.count() - 8
    assert samples.grouped_previous(made).first().frames == list(range(18, 26))
    timed = {(r.idx, r.f): r for r in samples.timed_rows(spans).collect()}
    assert timed[(0, 16)].done == 1 and timed[(0, 8)].progress == 8 / 17 and len(timed) == 60
    probes = samples.timed_rows(spans, probes=True).filter("group != 'active'").orderBy("f", "idx").collect()
    assert [(r.f, r.idx, r.done) for r in probes] == [(f, i, 1.0 - i) for f in range(16, 21) for i in (0, 1)]
    runs = {r.idx: r for r in samples.done_runs(trajectory.progress(frames, spans), 0.995).collect()}
    assert runs[0].tail == 4 and runs[0].total == 4 and runs[0].fixed == 3
    asked = spark.createDataFrame([(1, 0, 30, 0), (1, 1, 17, 0), (1, 2, 3, 1)], "ep long, number int, f long, idx int")
    assert [(r.f, r.done, r.progress) for r in samples.asked_rows(asked, frames, spans).collect()] == [(30, 0.0, 1.0), (17, 1.0, 1.0), (3, 0.0, 0.0)]


def test_status_rows(spark):
    made = spark.createDataFrame([(1, 1.0, 0.5), (2, 0.0, 0.25)], "k int, done_label double, progress_label double")
    said = spark.createDataFrame([(1, [0.9, 0.6, 0.1], 0.75), (2, [0.9, 0.2, 0.1], 0.25)], "k int, probs array<double>, progress_pred double")
    votes = {r.k: r for r in samples.status_rows(made, said, ["k"], votes=2).collect()}
    assert (votes[1].done_pred, votes[1].done_vote_pattern, votes[1].done_correct, votes[2].done_pred_label) == (1, "2:1", 1, "undone")
    assert votes[1].progress_sq_err == 0.0625 and abs(votes[1].done_prob - 1.6 / 3) < 1e-12
    plain = {r.k: r for r in samples.status_rows(made, said, ["k"]).collect()}
    assert (plain[2].done_pred, plain[2].done_correct, plain[2].done_vote_pattern, plain[2].done_vote_count) == (1, 0, "", 1)


def test_plan_frames(spark):
    rows = spark.createDataFrame([(k, 0, 4, 2) for k in range(200)] + [(500, 3, 4, None), (501, 5, 4, None)], "k int, s int, e int, d int")
    k = rows.select("k", samples.plan_frame(F.col("s"), F.col("e"), 1, "k").alias("inner"), samples.drawn(F.col("s"), samples.undone_end(F.col("e"), F.col("d")), 1, "k").alias("undone"), samples.ahead(F.array(F.lit("a"), F.lit("b")), F.lit(1)).alias("goals"))
    got = {r.k: r for r in k.collect()}
    assert {got[x].inner for x in range(200)} == {1, 2, 3} and {got[x].undone for x in range(200)} == {0, 1}
    assert got[500].inner in (3, 4) and got[501].undone is None and got[0].goals == ["b"]
