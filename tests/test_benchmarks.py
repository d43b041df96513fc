"""Benchmark jobs: equality of answers, prompts, media, judges, detection jobs, tools, outputs, configurations, manifests and files."""

import base64
import gzip
import json

import pytest
from pyspark.sql import functions as F

from quernel.functions import mathx
from quernel.operators import benchmarks as B
from quernel.sources import config, readers, sinks


def test_numbers_are_read():
    cases = {
        "3": 3, "-2.5": -2.5, "1/4": 0.25, "2**3": 8, "2^-1": 0.5, r"\frac{3}{4}": 0.75, r"\dfrac{1}{2}+\sqrt{9}": 3.5, r"\sqrt[3]{27}": 3, r"2\pi": 6.283185307179586, "(1+2)*3": 9, "-(2)^2": -4,
        r"\left(1+\frac{1}{2}\right)": 1.5, "1e3": 1000, "$7$": 7, r"3\cdot 4": 12, r"\sqrt{\frac{1}{4}}": 0.5, "2(3)": 6,
    }
    for text, want in cases.items():
        assert mathx.value_of(text) == pytest.approx(want), text
    for text in ("", "x", "1/0", "3 apples", "A", "(1", "import os", "9^9^9^9", "__class__", "[1, 2]"):
        assert mathx.value_of(text) is None, text
    assert mathx.same_of("0.5", r"\frac{1}{2}") and mathx.same_of(" Yes", "yes ") and not mathx.same_of("1", "2") and not mathx.same_of("x", "y")


def test_checks(spark):
    rows = spark.createDataFrame([("0.50", "1/2"), ("2", "2.0"), (None, "1"), ("a", "b"), ("Same ", "same")], "a string, b string")
    assert [r.s for r in rows.select(mathx.same(F.col("a"), F.col("b")).alias("s")).collect()] == [True, True, False, False, True]
    options = F.create_map(F.lit("A"), F.lit("12"), F.lit("B"), F.lit("13"))
    none = F.create_map().cast("map<string,string>")
    r = spark.range(1).select(
        mathx.checked(F.lit("The answer is B."), F.lit("B"), options).alias("right"), mathx.checked(F.lit("The answer is B."), F.lit("A"), options, True).alias("picked"), mathx.checked(F.lit("1/2"), F.lit("0.5"), none, True).alias("open"),
        mathx.checked(F.lit("1/3"), F.lit("0.5"), none, True).alias("left"),
    ).first()
    assert (r.right, r.picked, r.open, r.left) == (True, "B", "1/2", None)


def test_judges(spark):
    rows = spark.createDataFrame([(1, "q", "I say B.", "B"), (2, "q", "unclear", "B"), (3, "q", "Cannot determine the answer", "A")], "k int, question string, prediction string, answer string")
    options = F.create_map(F.lit("A"), F.lit("aa"), F.lit("B"), F.lit("bb"))

    def judge(prompt, heat):
        if heat < 1:
            raise TimeoutError
        return "B" if prompt.endswith("Extracted answer: ") else "?"

    got = {r.k: (r.res, r.extract_model, r.extract_flag) for r in B.extracted(rows, options, judge).collect()}
    assert got == {1: ("B", "rule", True), 2: ("B", "judge", True), 3: ("Z", "rule", False)}
    got = {r.k: (r.res, r.extract_model) for r in B.extracted(rows, options).collect()}
    assert got[2] == ("", "none")
    assert B.asked(rows.withColumn("p", F.when(F.col("k") == 1, "x")), "p", lambda *_: "Failed to obtain answer via API").filter("judged is not null").count() == 0


def test_prompts(spark):
    lit = F.lit
    r = spark.range(1).select(
        B.extraction_prompt(lit("Q?"), lit(7)).alias("extract"), B.picture_prompt(lit("Q?"), F.array(lit("a.jpg"), lit("b.jpg"))).alias("parts"), B.detection_prompt(F.array(lit("cat"), lit("dog"))).alias("detect"),
        B.code_prompt(lit("Sum."), lit(None).cast("string"), lit("")).alias("standard"), B.code_prompt(lit("Sum."), lit("def f():"), lit("f")).alias("called"),
    ).first()
    assert r.extract.startswith("\nPlease read the following example.\nThen extract") and r.extract.endswith("Extracted answer: B\n\nQ?\nModel response: 7\nExtracted answer: ") and r.extract.count("Hint:") == 5
    assert [(p.type, p.value, p.min_pixels) for p in r.parts] == [("image", "a.jpg", 602112), ("image", "b.jpg", 602112), ("text", "Q?", None)]
    assert r.detect == "Locate every instance that belongs to the following categories: 'cat, dog'. Report bbox coordinates in JSON format."
    assert "Standard IO" in r.standard and "starter" not in r.standard and "Call-Based format.\nThe starter code is provided as below. Please finish the code.\ndef f():\n\nANSWER:\n" in r.called


def test_media_of_messages(spark):
    part = lambda **k: {"type": None, "text": None, "image": None, "image_url": None, "video": None} | k
    rows = spark.createDataFrame(
        [(1, [{"role": "user", "parts": [part(text="hi"), part(image="i1", video="v0"), part(video="v1")]}, {"role": "x", "parts": None}]), (2, [{"role": "user", "parts": [part(text="no media")]}]), (3, [{"role": "user", "parts": [part(type="image_url", image_url="u")]}])],
        f"k int, messages array<struct<role:string,parts:array<{B.PART}>>>",
    )
    parts = B.vision_parts(rows, "k")
    assert sorted((r.k, r.pos, r.kind, r.medium) for r in parts.collect()) == [(1, 1, "image", "i1"), (1, 2, "video", "v1"), (3, 0, "image", "u")]
    assert {r.k: (r.images, r.videos) for r in B.routed(parts, "k").collect()} == {1: (["i1"], ["v1"]), 3: (["u"], None)}
    broken = spark.createDataFrame([(1, [{"role": "user", "parts": [part(type="image")]}])], rows.schema)
    with pytest.raises(Exception, match="neither an image nor a video"):
        B.vision_parts(broken, "k").collect()


def test_detection_jobs(spark):
    images = spark.createDataFrame([("d", 1, "a.jpg", 333, 500), ("d", 2, "b.jpg", 4000, 3000)], "dataset string, img_id int, file_name string, height int, width int")
    boxes = spark.createDataFrame([("d", 1, 5, [1.0, 2.0, 3.0, 4.0])], "dataset string, img_id int, category_id int, bbox array<double>")
    sets = spark.createDataFrame([("d", "/x/", ["cat"])], "dataset string, folder string, classes array<string>")
    got = {r.img_id: r for r in B.detection_jobs(images, boxes, sets).collect()}
    assert got[1].img_path == "/x/a.jpg" and got[1].resized_h % 32 == 0 and got[1].resized_h * got[1].resized_w >= 768 * 1024 and got[2].resized_h * got[2].resized_w <= 12800 * 1024
    assert got[1].annotation[0].category_id == 5 and got[2].annotation is None
    text = "base = 'data/odinw/'\nd1 = dict(metainfo=dict(classes=('a', 'b')), data_root=base + 'd1/', ann_file='x.json', data_prefix=dict(img='i/'))\ndataset_prefixes = ['D1']\ndatasets = [d1]\nx = open('y')\nimport os\n"
    assert config.detection_sets(text) == {"D1": {"metainfo": {"classes": ["a", "b"]}, "data_root": "data/odinw/d1/", "ann_file": "x.json", "data_prefix": {"img": "i/"}}}


def test_tools_and_outputs(spark):
    rows = spark.createDataFrame([('{"action": "swipe", "coordinate": [1, 2], "coordinate2": [3, 4]}',), ('{"action": "swipe", "coordinate": [1, 2]}',), ('{"action": "fly"}',), ("no",)], "t string")
    got = [r.c for r in rows.select(B.tool_call(F.col("t"), B.PHONE).alias("c")).collect()]
    assert got[0].action == "swipe" and got[0].arguments == {"coordinate": "[1,2]", "coordinate2": "[3,4]"} and got[1:] == [None, None, None]
    assert rows.select(B.tool_call(F.lit('{"action": "left_click"}'), B.COMPUTER).alias("c")).first().c.action == "left_click"
    yes = [(["a", "b"], "a\nb"), ([" a"], "a"), (["1.0000000001"], "1"), ([[1, 2]], [1, 2]), (["b a"], "a b"), (["1.0001 2"], "2 1.00011"), ([3], [3]), (["x "], ["x"])]
    no = [(["a"], "b"), ([], "x"), (["1.5"], "1"), ([[1]], [2]), (["a a b"], "c")]
    assert all(B.output_matches_of(o, w) for o, w in yes) and not any(B.output_matches_of(o, w) for o, w in no)
    table = spark.createDataFrame([(json.dumps(o), json.dumps(w)) for o, w in yes + no] + [(None, "1")], "o string, w string")
    assert [r.m for r in table.select(B.output_matches(F.col("o"), F.col("w")).alias("m")).collect()] == [True] * len(yes) + [False] * (len(no) + 1)


def test_configurations(tmp_path, monkeypatch):
    monkeypatch.setenv("QUERNEL_ROOT", "/r")
    known = {"model": {"model_name_or_path": "m"}, "data": {"robot_views": "main", "robot_q2_progress_bucket_size": 0.1, "path_if_exists": str(tmp_path), "gone_if_exists": "/none"}, "training": {"output_dir": "$QUERNEL_ROOT/{robot_views}", "bf16": True, "no": None, "odd": "{unknown}"}}
    assert config.training_arguments(known) == [
        "--model_name_or_path", "m", "--robot_views", "main", "--robot_q2_progress_bucket_size", "0.1", "--path", str(tmp_path), "--output_dir", "/r/main", "--bf16", "True", "--odd", "{unknown}",
    ]
    known["eval"] = {"seed": 1, "q1": {"seed": 2}, "q2": {"batch": 3, "seed": 4}, "q2_vis": {"seed": 5}}
    assert config.evaluation_values(known, "q1") == {"base_model": "m", "views": "main", "seed": 2}
    assert config.evaluation_values(known, "q2_vis") == {"base_model": "m", "views": "main", "q2_progress_bucket_size": 0.1, "seed": 5, "batch": 3}
    assert config.with_defaults({"a": None, "b": 1}, {"a": 2}, {"a": 3, "c": 4}) == {"a": 2, "b": 1, "c": 4}
    with pytest.raises(ValueError):
        config.sections({"data": []})


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "short", "q", ["A"]), (2, "long", "q", ["B"])], "videoID string, duration string, question string, options array<string>")
    rows.write.parquet(str(tmp_path / "v"))
    assert readers.video_questions(spark, str(tmp_path / "v"), "long").count() == 1 and readers.video_questions(spark, str(tmp_path / "v")).columns == ["videoID", "duration", "question", "options"]
    image = base64.b64encode(b"abc").decode()
    with gzip.open(tmp_path / "p.jsonl.gz", "wt") as out:
        out.write(json.dumps({"question": "q", "images": [image, "*"]}) + "\n\n")
    (r,) = readers.problems(spark, str(tmp_path / "p.jsonl.gz")).collect()
    assert [bytes(i) for i in r.images] == [b"abc"]
    (tmp_path / "f").write_bytes(b"x")
    assert readers.checked_file(str(tmp_path / "f"), "9dd4e461268c8034f5c8564e155c67a6") and not readers.checked_file(str(tmp_path / "f"), "0") and not readers.checked_file(str(tmp_path / "g"), "0")
    boxes = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 0.5, 9)], "image_id int, bbox array<double>, score double, category_id int")
    sinks.write_detections(boxes, str(tmp_path / "d"))
    assert json.loads(spark.read.text(str(tmp_path / "d")).first().value) == {"image_id": 1, "bbox": [1.0, 2.0, 3.0, 4.0], "score": 0.5, "category_id": 9}
    manifest = json.loads(sinks.write_manifest(spark.createDataFrame([(2, "b"), (1, None)], "k int, t string"), {"seed": 3}, ["k"]).first().value)
    assert manifest == {"seed": 3, "samples": [{"k": 1, "t": None}, {"k": 2, "t": "b"}]}
    files = sinks.image_files(spark.createDataFrame([("7", [image, image]), ("8", [image]), ("9", ["*"])], "index string, image array<string>"), str(tmp_path / "img"))
    assert sorted(r.path.rpartition("/")[2] for r in files.collect()) == ["7_0.jpg", "7_1.jpg", "8.jpg"]
    assert [r.written for r in sinks.write_images(files).collect()] == [True] * 3 and [r.written for r in sinks.write_images(files).collect()] == [False] * 3
    assert (tmp_path / "img" / "8.jpg").read_bytes() == b"abc"


def test_tables_and_frames_are_checked(spark, tmp_path):
    (tmp_path / "tiny.tsv").write_text("index\tquestion\tA\n1\tq\tx\n")
    digest = __import__("hashlib").md5((tmp_path / "tiny.tsv").read_bytes()).hexdigest()
    assert readers.benchmark(spark, str(tmp_path), "tiny", {"tiny": digest}).first()["index"] == 1 and readers.benchmark(spark, str(tmp_path), "tiny", {}).count() == 1
    with pytest.raises(ValueError, match="not the table"):
        readers.benchmark(spark, str(tmp_path), "tiny", {"tiny": "0"})
    frame = spark.range(2).select(F.array_repeat(F.lit(0.0), 16).alias("observation.state"), F.array_repeat(F.lit(0.0), 16).alias("action"), F.lit(0.0).alias("timestamp"), *(F.lit(0).alias(c) for c in ("frame_index", "episode_index", "index", "task_index")))
    sinks.validated(frame)
    for wrong, says in ((frame.filter("false"), "no rows"), (frame.drop("action"), "missing"), (frame.withColumn("action", F.array(F.lit(1.0))), "2 rows")):
        with pytest.raises(ValueError, match=says):
            sinks.validated(wrong)


def test_choices_of_episodes(spark):
    from quernel.functions import arrays
    from quernel.operators import sampling

    rows = spark.createDataFrame([(e, n, "fp" if n % 2 else "fn", n / 10) for e in range(3) for n in range(4 * e, 4 * e + 4)], "e int, n int, kind string, prob double")
    scored = rows.withColumn("score", sampling.error_score(F.col("kind"), F.col("prob")))
    assert [r.e for r in sampling.episode_errors(scored, ["e"], "worst", 0, "n", limit=2).collect()] == [2, 0]
    assert [r.n for r in sampling.episode_errors(scored, ["e"], "number", 0, "n").collect()] == [0, 7, 11]
    assert sorted(r.e for r in sampling.episode_errors(scored, ["e"], "random", 5, "n").collect()) == [0, 1, 2]
    samples = spark.createDataFrame([(f"t{e % 2}", e, k) for e in range(6) for k in range(3)], "task string, e int, k int")
    drawn = sampling.one_episode_a_task(samples, "task", "e", 3).collect()
    assert len(drawn) == 6 and len({r.e for r in drawn}) == 2 and sampling.one_episode_a_task(samples, "task", "e", 3, tasks=1).count() == 3
    ids = F.array(*map(F.lit, [5, 7, 5]))
    got = {tuple(r.x) for r in spark.range(40).select(arrays.one_vote(ids, 5, [1, 2], "id").alias("x")).collect()}
    assert got == {(5, 7, 1), (5, 7, 2)} and spark.range(1).select(arrays.one_vote(ids, 4, [1], "id").alias("x")).first().x == [5, 7, 5]
