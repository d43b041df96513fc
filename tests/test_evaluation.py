"""Evaluation tables, names and media: small cases, empty tables and nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.functions import jsonx
from quernel.functions import media as M
from quernel.functions import names as N
from quernel.functions import text as T
from quernel.operators import evaluation as E
from quernel.operators import prep, sampling, series


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_names(spark):
    lit = F.lit
    r = one(
        spark, N.safe_name(lit("a b/é.ü-1")).alias("safe"), N.task_folder(lit("stack-aloha-agilex_clean_50")).alias("kit"), N.task_folder(lit("a-b-c")).alias("rest"), N.task_folder(lit("abc")).alias("same"),
        N.view_paths(lit("/r"), lit(1203), lit("main")).alias("views"), N.episode_of(lit("/x/anno/episode_000012.json")).alias("ep"), N.episode_of(lit("/x/other.json")).alias("none"),
        N.repo_of(lit(None), lit(None), lit("/d/repo/anno/episode_000001.json")).alias("repo"), N.converted_path(lit("/r/data/chunk-000/episode_000001.parquet")).alias("out"),
        N.is_video(lit("A.MP4")).alias("video"), N.is_video(lit("a.png")).alias("image"), N.absolute(lit("/a/b/"), lit("../c/./d")).alias("abs"), N.absolute(lit("/a"), lit("/z/y")).alias("kept"),
        N.windows(lit("3, 1,,0,-2,3, 10")).alias("windows"), N.run_stamp(lit("2026-01-02 03:04:05").cast("timestamp")).alias("stamp"), N.annotation_path(lit(None), lit("/r"), lit(7)).alias("anno"),
        N.episode_key(lit(None), lit(None), lit("r"), lit(3)).alias("key"), N.slug_of_export(lit("plain")).alias("export"),
    )
    assert (r.safe, r.kit, r.rest, r.same) == ("a_b_é.ü-1", "aloha-agilex_clean_50", "b-c", "abc")
    assert r.views == ["/r/observation.images.cam_main/episode_001203.hdf5", "/r/videos_240x320_240x320/chunk-001/observation.images.cam_main/episode_001203.hdf5"]
    assert (r.ep, r.none, r.repo, r.out) == (12, None, "repo", "/r/data-lerobot/chunk-000/episode_000001.parquet")
    assert (r.video, r.image, r.abs, r.kept, r.windows, r.stamp) == (True, False, "/a/c/d", "/z/y", [1, 3, 10], "20260102_030405")
    assert (r.anno, r.key, r.export) == ("/r/anno/episode_000007.json", "r#3", "plain")
    assert N.views(" main, left_wrist,") == ["main", "left_wrist"]
    for wrong in ("", "main,top"):
        with pytest.raises(ValueError):
            N.views(wrong)
    assert len(N.special_tokens(3)) == 7


def test_issue_texts(spark):
    row = "struct(named_struct('rule', 'min frames', 'repo', 'a/b', 'episode_index', 4, 'subtask_index', 2, 'left_subtask', named_struct('subtask_type', 'move', 'truncation_rule', cast(null as string)), 'current_subtask', cast(null as struct<subtask_type:string,truncation_rule:string>)) as i)"
    r = spark.sql(f"select {row} as x").select(N.issue_summary(F.col("x.i")).alias("line"), N.issue_file(F.col("x.i"), F.lit(1)).alias("file"), E.compact_span(F.lit(None).cast("struct<subtask_index:int,subtask_type:string,truncation_rule:string,boundary_source:string>")).alias("none")).first()
    assert r.line == "issue: min frames  |  left move/? -> current none  |  subtask 3 (index 2)"
    assert r.file == "issue_01_a_b_episode_000004_subtask_03_idx02_min_frames_review.mp4" and r.none is None


def test_media(spark):
    lit, rng = F.lit, np.random.default_rng(2)
    depth = rng.integers(0, 5000, 77).tolist()
    r = one(
        spark, M.over_white(F.array(lit(10), lit(20), lit(30), lit(127))).alias("white"), M.frames_of_duration(lit(100.4), lit(2), 4, 65).alias("frames"), M.packed_frames(lit(24.0), lit(100)).alias("packed"),
        M.rescaled(F.array(lit(999.0), lit(0.0)), lit(640), lit(480)).alias("point"), M.view_sizes(lit(641), lit(1)).alias("sizes"), M.depth_levels(F.array(*map(lit, depth))).alias("depth"),
        M.shrunk(lit(1000), lit(333), 100).alias("small"), M.shrunk(lit(10), lit(20), 100).alias("kept"), M.data_url(lit(b"abc")).alias("url"), M.from_base64(lit("data:image/png;base64,YWJj")).alias("back"), M.from_base64(lit("*?")).alias("bad"),
    )
    share = 127 / 255
    assert r.white == [round(c * share + 255 * (1 - share)) for c in (10, 20, 30)]
    assert (r.frames, r.packed) == (64, [0, 19, 39, 59, 79, 99]) and r.point == [640.0, 0.0] and r.sizes == {"main": [641, 1], "wrist": [320, 1]}
    low, high = np.percentile(depth, (2, 98))
    assert r.depth == (np.clip((np.array(depth) - low) / (high - low), 0, 1) * 255).astype(int).tolist()
    assert (r.small, r.kept, r.url, bytes(r.back), r.bad) == ([100, 33], [10, 20], "data:image/png;base64,YWJj", b"abc", None)
    image = M.png(3, 2, bytes(range(18)))
    assert M.image_size(image) == (3, 2) and M.image_size(b"") is None and M.image_size(None) is None
    jpeg = bytes.fromhex("ffd8ffe000104a46494600010100000100010000ffc0000b080020004001011100")
    assert M.image_size(jpeg) == (64, 32)
    assert M.video_key(["a.x", "b.y"], "y") == "b.y" and M.video_key(["b", "observation.images.cam_main"], None) == "observation.images.cam_main" and M.video_key(["q"], None) == "q"
    for keys, wanted in (([], None), (["a.x", "b.x"], "x"), (["a"], "z")):
        with pytest.raises(ValueError):
            M.video_key(keys, wanted)
    with pytest.raises(Exception, match="smaller"):
        one(spark, M.resized_strictly(lit(3), lit(100), 28, 100, 10**6).alias("x"))


def test_texts(spark):
    lit = F.lit
    marked = "one\n\n```python\na = b < 3\n```\nend"
    r = one(
        spark, jsonx.canonical(lit(' {"b": 1,  "a": [1, 2]} ')).alias("json"), jsonx.canonical(lit(" some \n text ")).alias("plain"), T.without_image_marks(lit("a<ref>b</ref><box>(1,2)</box>c<box>open")).alias("marks"), T.as_html(lit(marked)).alias("html"),
        T.same_output(F.array(lit(" a"), lit("b ")), lit("a\nb")).alias("same"), T.same_output(F.array(lit("a")), lit("b")).alias("other"), T.interleaved(lit("see ![image](x.png) and ![image](y)"), F.array(lit("i0"), lit("i1"))).alias("parts"),
        T.window_scores(F.array(lit("Move  it"), lit("x")), F.array(lit("move it"), lit("y")), 1).alias("w1"), T.window_scores(F.array(lit("a b")), F.array().cast("array<string>"), 3).alias("w3"),
    )
    assert r.plain == "some text" and r.json.replace(" ", "") in ('{"a":[1,2],"b":1}', '{"b":1,"a":[1,2]}')
    assert r.marks == "abc"
    assert r.html == 'one<pre><code class="language-python"><br>a&nbsp;=&nbsp;b&nbsp;&lt;&nbsp;3<br></code></pre><br>end'
    assert r.same and not r.other and [(p.type, p.value) for p in r.parts] == [("text", "see "), ("image", "i0"), ("text", " and "), ("image", "i1")]
    assert (r.w1.bleu, r.w1.edits, r.w1.exact) == (pytest.approx(1.0), 0, True) and (r.w3.bleu, r.w3.edits, r.w3.share, r.w3.exact) == (0.0, 2, 1.0, False)


def test_tables(spark):
    predictions = spark.createDataFrame([(1, {"q": "a"}, (5,))], "question_id int, annotation map<string,string>, result struct<gen:int>").selectExpr("question_id", "named_struct('index', 7, 'split', 'dev') as annotation", "result")
    assert E.flattened(predictions).first().asDict() == {"question_id": 1, "index": 7, "split": "dev", "prediction": "5"}
    rows = spark.createDataFrame([(3, "c"), (1, "a"), (None, "n"), (1, "b")], "i int, t string")
    assert [r.i for r in E.in_order(rows, "i").collect()] == [1, 1, 3, None]
    r = one(spark, *E.wide_choices(F.create_map(F.lit("B"), F.lit("x"))), E.gold_letter(F.lit("C")).alias("gold"), E.gold_letter(F.lit("12")).alias("other"))
    assert (r.A, r.B, r.gold, r.other) == (None, "x", "C", "A")
    frames = spark.createDataFrame([(1, "cat"), (2, "dog"), (3, "none")], "f int, caption string")
    results = spark.createDataFrame([(1, "a cat", "r1"), (2, "cat and dog", "r2")], "pos int, text string, result string")
    assert {r.f: r.result for r in E.captioned(frames, results).collect()} == {1: "r2", 2: "r2", 3: None}
    assert {r.f: r.result for r in E.captioned(frames, results.filter("false")).collect()} == {1: None, 2: None, 3: None}
    of_videos = E.captioned(frames.withColumn("v", F.col("f") % 2), results.withColumn("v", F.lit(1)), ["v"])
    assert {r.f: r.result for r in of_videos.collect()} == {1: "r2", 2: None, 3: None}
    samples = spark.createDataFrame([("frame", "undone", 0), ("plan", None, 1), ("plan", None, 0)], "kind string, group string, idx int")
    assert E.of_kind(samples, "plan").count() == 2 and E.of_kind(samples, group="undone").count() == 1 and E.of_kind(samples).count() == 3
    assert E.plan_samples(samples).count() == 2 and E.plan_samples(samples, True).count() == 3
    keyed = spark.createDataFrame([("r", "/x/episode_000003.hdf5", 4, 1, "undone")], "repo string, main_path string, frame_index int, current_subtask_index int, q2_group string")
    assert tuple(E.sample_key(keyed).first()) == ("r", 3, 4, 1, "undone")
    progress = spark.createDataFrame([(1, 0.2, 0.9), (2, 0.5, 0.5), (3, None, 0.1)], "k int, progress_pred double, progress_label double")
    assert [r.k for r in E.worst_progress(progress, 2, "k").collect()] == [1, 2]
    with pytest.raises(ValueError):
        E.class_index(spark.createDataFrame([], "label string"), ["Cat", "cat"])
    groups = spark.createDataFrame([("a", True), ("b", False)], "g string, test boolean")
    assert tuple(E.split_counts(groups, "test").first()) == (2, 1, 1) and tuple(E.split_counts(groups.filter("false"), "test").first()) == (0, 0, 0)
    assert E.seeded(rows, "t", "i", 0, 1).count() == 4 and E.seeded(rows, "t", "i", 1, 1).count() == 4
    annos = spark.createDataFrame([("task-aloha-x", 1, "go", [(0, 0, 9, None, "g")])], "repo string, episode_index int, task_goal string, subtasks array<struct<subtask_index:int,start_frame:int,end_frame:int,boundary_source:string,subtask_goal:string>>")
    r = E.review(annos, F.lit("k"), F.lit("in"), F.lit("out")).first()
    assert (r.task_slug, r.subtasks[0].goal, r.subtasks[0].boundary_source, r.codec) == ("task", "g", "", "libx264")


def test_exact_places(spark):
    rng = np.random.default_rng(4)
    data = [(g, float(v)) for g, n in (("a", 1), ("b", 1000), ("c", 77)) for v in rng.integers(0, 30, n)]
    rows = spark.createDataFrame(data, "g string, v double").repartition(4)
    n = F.col("n")
    got = {r.g: r for r in sampling.values_at(rows, "g", "v", {"first": F.lit(0), "mid": F.floor(n / 2), "last": n - 1}, bins=5).collect()}
    for g in "abc":
        values = sorted(v for x, v in data if x == g)
        assert (got[g].first, got[g].mid, got[g].last) == (values[0], values[len(values) // 2], values[-1])
    picked = sampling.first_by_hash(rows.withColumn("k", F.monotonically_increasing_id()), ["g"], F.md5(F.col("k").cast("string")), "k", lambda n: F.floor(n / 4))
    assert {r.g: r["count"] for r in picked.groupBy("g").count().collect()} == {"b": 250, "c": 19}
    assert sampling.first_by_hash(rows.filter("false"), ["g"], F.md5("g"), "v", lambda n: n).count() == 0


def test_rooms_and_rope():
    rng = np.random.default_rng(5)
    sizes = sorted(rng.integers(1, 60, 200).tolist(), reverse=True)
    rooms, naive, places = prep.Rooms(50, len(sizes)), [], []
    for n in sizes:
        place = next((k for k, left in enumerate(naive) if left >= min(n, 50)), len(naive))
        naive += [50] * (place == len(naive))
        naive[place] -= min(n, 50)
        places.append(place)
        assert rooms.put(n) == place
    ids = [1, 2, 9, 9, 9, 9, 3, 4, 9, 9, 5]
    got = prep.rope_positions(ids, 9, 8, [(1, 4, 4), (1, 2, 4)], [])
    assert got[0].tolist() == [0, 1, 2, 2, 2, 2, 4, 5, 6, 6, 8] and got[2].tolist() == [0, 1, 2, 3, 2, 3, 4, 5, 6, 7, 8]


def test_long_episode_is_linear(spark):
    n = 200_000
    rows = spark.range(n).selectExpr("0 as ep", "id as f", "double(id % 17) as v", "case when id % 1000 = 0 then 'x' else 'y' end as kind")
    spans = rows.filter("f % 100 = 0").selectExpr("ep", "f div 100 as idx", "f as start", "f + 98 as end")
    got = series.span_at(rows.select("ep", "f"), spans).filter("f in (99, 150, 199999)").orderBy("f").collect()
    assert [(r.f, r.idx, r.before) for r in got] == [(99, None, 0), (150, 1, 0), (199999, None, 1999)]
    assert series.next_of(rows, "x").agg(F.count("next_f")).first()[0] == 199_000
