"""Small expressions and choices by cases."""

import pytest
from pyspark.sql import functions as F

from quernel.functions import arrays, jsonx
from quernel.operators import sampling, trajectory


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_json_answers(spark):
    one = '```json\n[{"bbox_2d": [1, 2, 3, 4], "label": "a"}, {"bbox_2d": [1, 2], "label": "b"}]\n```'
    assert [b.label for b in value(spark, jsonx.boxes(F.lit(one)))] == ["a"]
    assert value(spark, jsonx.boxes(F.lit('[{"bbox_2d": [1, "x", 3, 4]}]'))) == []
    assert value(spark, jsonx.boxes(F.lit("no boxes"))) == []
    assert [p.label for p in value(spark, jsonx.points(F.lit('see [{"point_2d": [1, 2]}, {"point_2d": [3, 4], "label": "x"}]')))] == ["point_1", "x"]
    assert len(value(spark, jsonx.boxes_3d(F.lit('{"bbox_3d": [1,2,3,4,5,6,7,8,9], "label": "c"}')))) == 1
    assert value(spark, jsonx.document(F.lit("```json\n{\"a\": 1}"))).json == '{"a":1}' and value(spark, jsonx.document(F.lit("nope {"))).error
    assert value(spark, jsonx.canonical(F.lit('{"b": 1, "a": 2}'))) == '{"a":2,"b":1}' and value(spark, jsonx.canonical(F.lit(" a \n b"))) == "a b"
    assert value(spark, jsonx.tool_call(F.lit('x <tool_call>{"n": 3}</tool_call>'), "n int")).n == 3
    assert value(spark, jsonx.whole_number_keys(F.create_map(F.lit("4"), F.lit("x")))) == {4: "x"}


def test_parsing_is_done_once(spark):
    texts = ["{}", " [1]", '"x"', "-1", "0.5", "true", "false", "null", "nul", "-", "", "  ", "NaN", "Infinity", "+1", ".5", "'a'", "I see {1", "\ufeff1", "\n\t{\"a\": 1}", "// x", "{} x", "\u00a01"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", jsonx.parsed_or_null(F.col("t")).isNull().alias("a"), F.try_parse_json("t").isNull().alias("b")).collect()
    assert [r.t for r in got if r.a != r.b] == []
    plan = rows.select(jsonx.boxes(F.col("t")).alias("b"), jsonx.document(F.col("t")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("parseJson") <= 1


def test_arrays(spark):
    ids = F.array(*map(F.lit, [5, 7, 5, 9]))
    assert value(spark, arrays.last_place(ids, 5)) == 2 and value(spark, arrays.last_place(ids, 1)) == -1
    assert value(spark, arrays.expanded(ids, 5, [1, 2])) == [5, 7, 1, 2, 9] and value(spark, arrays.expanded(ids, 3, [1])) == [5, 7, 5, 9]
    assert value(spark, arrays.clipped_frames(F.array(*map(F.lit, [9, 3, -1, 3, 10])), F.lit(10))) == [3, 9]
    assert value(spark, arrays.options(F.array(F.lit("A. one. two"), F.lit("B.three")))) == {"A": "one. two", "B": "three"}
    pose = F.array(*map(F.lit, [1.0, 2.0, 3.0, 0.0, 0.0, 2.0, 0.0]))
    none = F.array(*map(F.lit, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0]))
    state = arrays.observation(pose, F.lit(0.5), none, F.lit(1))
    assert value(spark, state) == [1, 2, 3, 0, 0, 1, 0, 0.5, 1, 2, 3, 1, 0, 0, 0, 1]
    assert tuple(value(spark, arrays.prompt_values(state))) == (0.5, 1, 3, 3) and value(spark, arrays.prompt_values(pose)) is None
    assert value(spark, arrays.even_fill(F.array(F.lit(1), F.lit(2), F.lit(3)))) == [1, 2, 3, 3]


def test_choices(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2], k % 5 / 5, k % 3 % 2) for k in range(40)], "k int, g string, score double, pred int")
    typed = rows.withColumn("kind", sampling.error_type(F.col("score"), F.col("pred"), 0.5))
    worst = sampling.worst(typed, "kind", "score", 3, "k").collect()
    assert {r.kind for r in worst} == {"fp", "fn"} and len(worst) == 6
    assert {r.g: r.k for r in sampling.best_of(rows.select("g", "score", "k"), ["g"], "score", "k").collect()} == {"a": 4, "b": 9}
    assert sampling.per_group(rows, "g", [F.col("k")], 2).count() == 4 and sampling.per_group(rows, "g", [F.col("k")], 2, 3).count() == 3
    assert [r.k for r in sampling.sample(rows, "k", 5, 1).collect()] == [r.k for r in sampling.sample(rows, "k", 5, 1).collect()]
    assert sampling.sample(rows, "k", 0, 1).count() == 40 and sampling.one_per_group(rows, "g", "k", 1).count() == 2
    assert {r.batch for r in sampling.batches(rows, "k", 8, "g").collect()} == {0, 1, 2}
    found = spark.createDataFrame([(1, 10, "left_gripper_open"), (1, 5, "left_motion"), (2, 10, "gripper"), (2, 7, "motion"), (3, 9, "motion")], "s int, frame int, source string")
    assert {r.s: r.frame for r in sampling.nearest_boundary(found, ["s"]).collect()} == {1: 5, 2: 10, 3: 9}


def test_groups_and_segments(spark):
    events = spark.createDataFrame([(0, "left", 10, "close", 9, 11), (0, "right", 12, "close", None, None), (0, "left", 30, "open", 29, 31), (0, "right", 40, "open", 39, 41)], "ep long, arm string, frame long, kind string, start_frame long, end_frame long")
    groups = trajectory.gripper_groups(events)
    assert [(r.start, r.end, r.frame, r.left, r.right) for r in groups.orderBy("start").collect()] == [(9, 12, 10, True, True), (29, 31, 30, True, False), (39, 41, 40, False, True)]
    segments = spark.createDataFrame([(0, 0, 8, True, False), (0, 14, 20, True, False), (0, 24, 35, True, False), (0, 36, 50, False, True)], "ep long, start long, end long, left boolean, right boolean")
    joined = trajectory.joined_segments(segments, groups)
    assert [(r.start, r.end) for r in joined.orderBy("start").collect()] == [(0, 8), (14, 35), (36, 50)]
    parts = trajectory.split_segments(joined, groups)
    assert [(r.start, r.end, r.left) for r in parts.orderBy("start").collect()] == [(0, 8, True), (14, 31, True), (32, 35, True), (36, 41, False), (42, 50, False)]


def test_prompts(spark):
    from quernel.functions import prompts

    rows = spark.createDataFrame([("1", "What?", "red", "blue", None, "A", "A."), ("2", "Why?", None, None, None, "because", "it is because of that"), ("3", "Who?", "x", "y", "z", "C", "no idea")], "index string, question string, A string, B string, C string, answer string, prediction string")
    options = prompts.choices(rows.columns)
    shown = {r["index"]: r for r in rows.select("index", options.alias("o"), prompts.question_prompt(F.col("question"), options).alias("p")).collect()}
    assert shown["1"].o == {"A": "red", "B": "blue"} and shown["1"].p.startswith("Question: What?\nOptions:\nA. red\nB. blue\nPlease") and shown["2"].p == "Question: Why?"
    closed = prompts.closed(rows)
    assert {r["index"]: (r.A, r.B) for r in closed.collect()}["2"] == ("because", "Other Answers")
    got = {r["index"]: r for r in prompts.scored(closed, prompts.choices(rows.columns)).collect()}
    assert (got["1"].extracted_answer, got["1"].extraction_method, got["1"].hit) == ("A", "rule", 1)
    assert got["2"].extracted_answer == "A" and got["2"].extraction_success and got["3"].extraction_method == "random"
    assert value(spark, prompts.video_prompt(F.lit("q"), F.array(F.lit("A. a"), F.lit("B. b")))).endswith("\nQuestion: q\nA. a\nB. b\nThe best answer is:")
    assert value(spark, prompts.answer_number(F.lit("C"))) == 2
    with pytest.raises(Exception, match="not an option"):
        value(spark, prompts.answer_number(F.lit("F")))


def test_scores_of_windows_are_found_once(spark):
    from quernel.functions import text as T

    rows = spark.createDataFrame([(["Put it  down", None], ["put it down", "Go"]), ([], ["a"])], "a array<string>, b array<string>")
    out = rows.select(T.window_scores(F.col("a"), F.col("b"), 2).alias("s"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("levenshtein") == 1
    assert [(r.s.edits, round(r.s.share, 6), r.s.exact) for r in out.collect()] == [(1, round(1 / 3, 6), False), (1, 1.0, False)]
