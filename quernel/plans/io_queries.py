"""Registered queries that write the driver's tables in a layout and read them back, and that parse what answers hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.functions import arrays, jsonx, prompts
from quernel.functions import geometry as G
from quernel.functions import images as I
from quernel.operators import benchmarks as B
from quernel.operators import trajectory
from quernel.plans.annotation_queries import annotated
from quernel.plans.queries import AF, FR, arm_frames, query, read
from quernel.session import scratch
from quernel.sources import formats, readers, sinks

# ---- Layouts


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lines(spark, sf_dir):
    """Conversations as JSON lines and back."""
    path = scratch(spark, "lines")
    sinks.write_lines(read(spark, sf_dir, "conversations"), path)
    return readers.lines(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT s_suppkey, s_name, s_acctbal, s_nationkey FROM supplier")
def sheet_rows(spark, sf_dir):
    """Suppliers as a spreadsheet for each nation, written by tasks, and all sheets back."""
    folder = scratch(spark, "sheets")
    rows = read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name", "s_acctbal")
    sinks.write_spreadsheets(rows.withColumn("nation", F.col("s_nationkey")), "nation", folder, "s_suppkey")
    return formats.register(spark).read.format("quernel_sheet").schema("s_suppkey long, s_name string, s_acctbal double, s_nationkey long").load(folder)


@query("""WITH p AS (SELECT page_id // 64 AS ep, html, row_number() OVER (PARTITION BY page_id // 64 ORDER BY page_id) - 1 AS frame_index FROM pages)
SELECT ep, frame_index, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, sha256(html) AS frame_sha256 FROM p WHERE frame_index >= 16 OR frame_index = 3""")
def stored_frames(spark, sf_dir):
    """Pages as the frames of HDF5 files, 64 a file, in chunks; frames from 16 on and number 3 are read back by ranged reads."""
    folder = scratch(spark, "frames")
    pages = read(spark, sf_dir, "pages").select((F.col("page_id") - F.pmod("page_id", F.lit(64))).alias("first"), "page_id", F.col("html").cast("binary").alias("html"))
    sinks.write_frame_files(pages.withColumn("ep", (F.col("first") / 64).cast("long")), "ep", "page_id", "html", folder, chunk=8, deflate=True)
    asked = formats.frames(spark, folder, "frame_index >= 16", splitBytes=str(1 << 20)).unionByName(formats.frames(spark, folder, "frame_index = 3"))
    ep = F.regexp_extract("path", r"([0-9]+)\.hdf5$", 1).cast("long")
    return asked.select(ep.alias("ep"), "frame_index", F.octet_length("frame").cast("long").alias("n_bytes"), F.sha2("frame", 256).alias("frame_sha256"))


@query("""WITH p AS (SELECT page_id, encode(html) AS b, octet_length(encode(html)) AS n FROM pages), s AS (SELECT *, (n + 95) // 96 AS height FROM p),
r AS (SELECT *, greatest(28, CAST(round_even(CAST(height AS DOUBLE) / 28, 0) * 28 AS BIGINT)) AS rh FROM s)
SELECT page_id, CAST(height AS INT) AS height, 32 AS width, sha256(b) AS pixels_sha256, CAST(CASE WHEN rh * 28 > 50176 THEN greatest(28, floor(height / sqrt(height * 32 / 50176) / 28) * 28) WHEN rh * 28 < 3136 THEN ceil(height * sqrt(3136 / (height * 32)) / 28) * 28 ELSE rh END
 * CASE WHEN rh * 28 > 50176 THEN greatest(28, floor(32 / sqrt(height * 32 / 50176) / 28) * 28) WHEN rh * 28 < 3136 THEN ceil(32 * sqrt(3136 / (height * 32)) / 28) * 28 ELSE 28 END * 3 AS BIGINT) AS input_bytes FROM r""")
def decoded_images(spark, sf_dir):
    """Pages as the pixels of PNG files, decoded again, and resampled to what a model takes."""
    data = F.col("html").cast("binary")
    size = F.ceil(F.octet_length("html") / 96).cast("int")
    files = read(spark, sf_dir, "pages").select("page_id", F.octet_length("html").alias("n"), I.written_png(size, F.lit(32), data).alias("file"))
    pixels = files.select("page_id", "n", I.rgb(F.col("file")).alias("p"))
    resized = pixels.select("page_id", "n", "p", I.sized(F.col("p"), 28, 3136, 50176).alias("m"))
    return resized.select("page_id", "p.height", "p.width", F.sha2(F.substring("p.rgb", F.lit(1), F.col("n")), 256).alias("pixels_sha256"), F.octet_length("m.rgb").cast("long").alias("input_bytes"))


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0")
def json_document(spark, sf_dir):
    """Customers as one JSON array and back."""
    rows = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = scratch(spark, "document")
    sinks.write_document(rows, ["c_custkey"], path)
    return readers.document_rows(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def tab_table(spark, sf_dir):
    """Orders as a table of strings and back."""
    path = scratch(spark, "table")
    sinks.write_table(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, "\t")
    return readers.text_table(spark, path, "\t")


@query("SELECT p_partkey AS \"index\", p_name AS question, CASE WHEN p_partkey % 3 = 1 THEN md5((p_partkey - 1)::VARCHAR) ELSE md5(p_partkey::VARCHAR) END AS image FROM part")
def question_images(spark, sf_dir):
    """A benchmark's table, in which some rows' images are another row's, read with these resolved. (Images are told by their digests.)"""
    own = F.repeat(F.md5(F.col("p_partkey").cast("string")), F.lit(3))
    image = F.when(F.col("p_partkey") % 3 == 1, (F.col("p_partkey") - 1).cast("string")).otherwise(own)
    path = scratch(spark, "questions")
    sinks.write_table(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"), F.col("p_name").alias("question"), image.alias("image")), path, "\t")
    rows = readers.question_table(spark, path)
    return rows.select("index", "question", F.when(F.length("image") > 40, F.left("image", F.lit(32))).otherwise(F.md5("image")).alias("image"))


@query(f"WITH {AF} SELECT ep AS episode_index, f AS frame_index, round(lx::FLOAT::DOUBLE, 6) AS x, round(rg::FLOAT::DOUBLE, 6) AS grip FROM am")
def state_files(spark, sf_dir):
    """States of 16 numbers as checked Parquet and back, in single precision."""
    path = scratch(spark, "states")
    rows = arm_frames(spark, sf_dir).select(F.col("ep").alias("episode_index"), F.col("f").alias("frame_index"), "state")
    sinks.write_frames(rows, path)
    back = readers.states(spark, path, "state")
    return back.select("episode_index", "frame_index", F.round(F.col("state")[0], 6).alias("x"), F.round(F.col("state")[15], 6).alias("grip"))


@query("SELECT DISTINCT o_orderpriority AS repo, o_custkey AS episode_index FROM orders WHERE o_orderstatus = 'P'")
def excluded_episodes(spark, sf_dir):
    """Episodes to leave out as JSON lines, with repeats, and back."""
    path = scratch(spark, "excluded") + ".jsonl"
    sinks.write_lines(read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("repo"), F.col("o_custkey").alias("episode_index")), path)
    return readers.excluded(spark, path)


@query("SELECT o_orderkey AS k, o_totalprice AS score FROM orders")
def prediction_files(spark, sf_dir):
    """Predictions as an object with rows and back."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("score"))
    path = scratch(spark, "predictions")
    sinks.write_document(rows, ["k"], path, {"model": "none"}, "rows")
    return readers.document_rows(spark, path, "k long, score double")


@query("SELECT user_id, count(*) AS n, min(t) AS first, max(t) + 1500 AS last FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 2000 AS t FROM events WHERE event_type = 'view') GROUP BY user_id")
def subtitles(spark, sf_dir):
    """Views as subtitle files, one a user, and back: their number and times."""
    rows = trajectory_views(spark, sf_dir)
    clock = lambda ms: F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("int"), F.floor(ms / 60_000 % 60).cast("int"), F.floor(ms / 1000 % 60).cast("int"), (ms % 1000).cast("int"))
    block = F.concat_ws("\n", F.col("k").cast("string"), F.concat(clock(F.col("t")), F.lit(" --> "), clock(F.col("t") + 1500)), F.concat(F.lit("seen\\N"), F.col("k").cast("string")))
    whole = rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("value"))
    path = scratch(spark, "subtitles")
    sinks.write_texts(whole, "user_id", "value", path)
    found = readers.cues(spark, path)
    user = F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("long")
    return found.groupBy(user.alias("user_id")).agg(F.count("*").alias("n"), F.min("begin_ms").alias("first"), F.max("end_ms").alias("last"))


def trajectory_views(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").filter("event_type = 'view'").select("user_id", F.row_number().over(order).alias("k")).withColumn("t", F.col("k") * 2000)


@query("SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN '%' || n_nationkey ELSE '' END AS asked, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 100.0 ELSE 1.0 END AS rate, n_regionkey AS entry FROM nation")
def sampling_rates(spark, sf_dir):
    """Names of data sets with and without a rate, and their entries."""
    rows = read(spark, sf_dir, "nation")
    asked = F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("%"), F.col("n_nationkey").cast("string"))).otherwise(""))
    return readers.sampling(rows.select(asked.alias("name")), rows.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("entry")))


@query("SELECT page_id, octet_length(encode(html)) AS n FROM pages")
def image_dump(spark, sf_dir):
    """Each page in base64, written as files from the tasks, and read back."""
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("index"), F.base64(F.encode("html", "UTF-8")).alias("image"))
    folder = scratch(spark, "images")
    sinks.write_images(sinks.image_files(rows, folder)).write.format("noop").mode("overwrite").save()
    back = spark.read.format("binaryFile").load(folder)
    return back.select(F.regexp_extract("path", r"/(\d+)\.jpg$", 1).cast("long").alias("page_id"), F.col("length").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def unwritten_rows(spark, sf_dir):
    """The rows whose output is not there yet."""
    from quernel.sources.sinks import unwritten

    return unwritten(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").filter("toxic = 1"), ["doc_id"])


# ---- Answers


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN 0 ELSE 1 END AS n_boxes, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE l_quantity END AS x, 2 AS n_points, 'point_2' AS second, l_linenumber % 4 = 3 AS error FROM lineitem""")
def json_answers(spark, sf_dir):
    """Boxes, points and documents that answers hold, fenced or bare; some answers are cut."""
    q = F.col("l_quantity").cast("string")
    body = F.concat(F.lit('[{"bbox_2d": ['), q, F.lit(', 2, 3, 4], "label": "a"}, {"bbox_2d": [1, 2], "label": "b"}]'))
    kind = F.col("l_linenumber") % 4
    text = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("```\n"), body)).otherwise(F.concat(F.lit("I see {"), q))
    points = F.concat(F.lit('so: [{"point_2d": ['), q, F.lit(', 1], "label": "z"}, {"point_2d": [3, 4]}, {"point_2d": [5]}]'))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", jsonx.boxes(text).alias("b"), jsonx.points(points).alias("p"), jsonx.document(F.when(kind == 2, body).otherwise(text)).alias("d"))
    return rows.select("l_orderkey", "l_linenumber", F.size("b").alias("n_boxes"), F.get(F.get("b", F.lit(0))["bbox_2d"], F.lit(0)).alias("x"), F.size("p").alias("n_points"), F.get("p", F.lit(1))["label"].alias("second"), F.col("d.error").alias("error"))


@query("""SELECT p_partkey, p_size AS n, '{"a":' || p_size || ',"b":"' || p_brand || '"}' AS canonical, CASE WHEN p_size % 2 = 0 THEN 'click' END AS action FROM part""")
def json_texts(spark, sf_dir):
    """Tool calls, canonical JSON and checked calls."""
    size = F.col("p_size").cast("string")
    loose = F.concat(F.lit(' { "b" : "'), "p_brand", F.lit('", "a": '), size, F.lit(" } "))
    called = F.concat(F.lit("well <tool_call>\n{\"n\": "), size, F.lit("}\n</tool_call>"))
    tool = F.when(F.col("p_size") % 2 == 0, F.lit('{"action": "click", "coordinate": [1, 2]}')).otherwise(F.lit('{"action": "click"}'))
    return read(spark, sf_dir, "part").select("p_partkey", jsonx.tool_call(called, "n int")["n"].alias("n"), jsonx.canonical(loose).alias("canonical"), B.tool_call(tool, B.PHONE)["action"].alias("action"))


@query("""SELECT vec_id, list_sort(list_distinct(list_filter(list_transform(embedding, lambda x: floor(x * 40)::INT), lambda f: f >= 0 AND f < 10))) AS frames, len(list_filter(embedding, lambda x: x > 0)) % 2 + len(list_filter(embedding, lambda x: x > 0)) AS even FROM embeddings""".replace("AS frames", "::VARCHAR AS frames"))
def frame_lists(spark, sf_dir):
    """Frames inside a video, each once and in order, and lists made even."""
    clipped = arrays.clipped_frames(arrays.scaled_down(F.col("embedding"), 40), F.lit(10))
    even = arrays.even_fill(F.filter(F.col("embedding"), lambda x: x > 0))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(clipped, ", "), F.lit("]")).alias("frames"), F.size(even).alias("even"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: floor(v * 20)::INT) AS ids FROM embeddings), y AS (SELECT *, coalesce(list_max(list_filter(range(1, len(ids) + 1), lambda i: ids[i] = 0)), 0) - 1 AS pl FROM x)
SELECT vec_id, pl::INT AS place, (len(ids) + (pl >= 0)::INT)::INT AS n, list_sum(CASE WHEN pl < 0 THEN ids ELSE list_concat(ids[:pl], [100, 200], ids[pl + 2:]) END)::BIGINT AS total FROM y""")
def vote_tokens(spark, sf_dir):
    """The last place of a token, and the token there replaced by two."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", arrays.scaled_down(F.col("embedding"), 20).alias("ids"))
    out = arrays.expanded(F.col("ids"), 0, [100, 200])
    return rows.select("vec_id", arrays.last_place(F.col("ids"), 0).alias("place"), F.size(out).alias("n"), F.aggregate(out, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""WITH {FR}, p AS (SELECT ep, f, v / 10 AS x, v % 5 AS w, v % 3 AS q, v / 100 AS g FROM fr)
SELECT ep, f, round(CASE WHEN sqrt(w * w + q * q) > 1e-12 THEN w / sqrt(w * w + q * q) ELSE 1 END, 9) AS w, round(g, 9) AS left_grip, 1.0 AS right_grip, round(x, 9) AS left_z, round(x, 9) AS right_z FROM p""")
def observations(spark, sf_dir):
    """States from two poses and two grippers, and what a prompt tells of them."""
    from quernel.plans.queries import trajectories

    v, zero = F.col("v"), F.lit(0.0)
    pose = F.array(zero, zero, v / 10, (v % 5).cast("double"), (v % 3).cast("double"), zero, zero)
    state = arrays.observation(pose, v / 100, pose, F.lit(1.0))
    told = arrays.prompt_values(state)
    out = trajectories(spark, sf_dir).select("ep", "f", F.round(state[3], 9).alias("w"), told.alias("t"))
    return out.select("ep", "f", "w", *(F.round(F.col(f"t.{c}"), 9).alias(c) for c in ("left_grip", "right_grip", "left_z", "right_z")))


@query(r"""SELECT p_partkey, 'Question: ' || p_name || chr(10) || 'Options:' || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'Please select the correct answer from the options above.' AS prompt, ascii(chr(65 + p_size % 5)) - 65 AS number, 2 AS n_choices FROM part""")
def question_prompts(spark, sf_dir):
    """Prompts of multiple-choice questions, their choices and answers as numbers."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_brand").alias("A"), F.col("p_type").alias("B"), F.lit(None).cast("string").alias("C"), "p_size")
    choices = prompts.choices(rows.columns)
    return rows.select("p_partkey", prompts.question_prompt(F.col("p_name"), choices).alias("prompt"), prompts.answer_number(F.char(F.col("p_size") % 5 + 65)).cast("int").alias("number"), F.size(choices).alias("n_choices"))


@query("SELECT p_partkey, round_even(p_size * 16 / (2 * tan(radians(60) / 2)), 2) AS fx, round_even(p_size * 9 / (2 * tan(radians(60) / 2)), 2) AS fy, round_even(p_size * 8.0, 2) AS cx, round_even(p_size * 4.5, 2) AS cy FROM part")
def cameras(spark, sf_dir):
    """Camera parameters from an image's size and a field of view."""
    return read(spark, sf_dir, "part").select("p_partkey", G.camera(F.col("p_size") * 16, F.col("p_size") * 9, 60.0).alias("c")).select("p_partkey", *(F.col(f"c.{x}").cast("double").alias(x) for x in ("fx", "fy", "cx", "cy")))


# ---- Groups of events and segments


@query("""WITH RECURSIVE """ + FR + """, e AS (SELECT ep, CASE WHEN v > 10 THEN 'left' ELSE 'right' END AS arm, CASE WHEN kind = 'purchase' THEN 'open' ELSE 'close' END AS kind, f FROM fr WHERE kind IN ('purchase', 'view')),
n AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY f, arm, kind) - 1 AS i, count(*) OVER (PARTITION BY ep) AS total FROM e),
l AS (SELECT ep, max(total) AS total, list(struct_pack(i := i, f := f, arm := arm, kind := kind) ORDER BY i) AS es FROM n GROUP BY ep),
w(ep, i, used, lead, mates) AS (SELECT ep, -1::BIGINT, []::BIGINT[], false, []::BIGINT[] FROM l UNION ALL
SELECT w.ep, w.i + 1, CASE WHEN list_contains(w.used, w.i + 1) THEN w.used ELSE list_concat(w.used, [w.i + 1], list_transform(list_filter(l.es, lambda x: x.i > w.i + 1 AND NOT list_contains(w.used, x.i) AND x.kind = l.es[w.i + 2].kind AND x.arm <> l.es[w.i + 2].arm AND abs(x.f - l.es[w.i + 2].f) <= 3), lambda x: x.i)) END,
NOT list_contains(w.used, w.i + 1), CASE WHEN list_contains(w.used, w.i + 1) THEN []::BIGINT[] ELSE list_transform(list_filter(l.es, lambda x: x.i > w.i + 1 AND NOT list_contains(w.used, x.i) AND x.kind = l.es[w.i + 2].kind AND x.arm <> l.es[w.i + 2].arm AND abs(x.f - l.es[w.i + 2].f) <= 3), lambda x: x.i) END
FROM w JOIN l ON w.ep = l.ep WHERE w.i + 1 < l.total)
SELECT w.ep, l.es[w.i + 1].f AS start, list_max(list_concat([l.es[w.i + 1].f], list_transform(w.mates, lambda m: l.es[m + 1].f))) AS "end", l.es[w.i + 1].kind AS kind, l.es[w.i + 1].arm = 'left' OR len(w.mates) > 0 AS "left", l.es[w.i + 1].arm = 'right' OR len(w.mates) > 0 AS "right" FROM w JOIN l ON w.ep = l.ep WHERE w.lead""")
def gripper_groups(spark, sf_dir):
    """Gripper events of both arms that go together."""
    *_, events = annotated(spark, sf_dir)
    return trajectory.gripper_groups(events.select("ep", "arm", "frame", "kind", F.lit(None).cast("long").alias("start_frame"), F.lit(None).cast("long").alias("end_frame"))).drop("frame")


@query(f"""WITH {FR}, x AS (SELECT ep, f, v, f % 2 = 0 AS plan, (f % 3)::INT AS idx, ['open', 'take', 'put'] AS gs, CASE WHEN f % 2 = 0 THEN least(f % 3 + 1, 2)::INT ELSE (f % 3)::INT END AS pl FROM fr),
y AS (SELECT *, list_transform(range(0, 3), lambda k: '{{"subtask_index":' || k || ',"subtask_goal":"' || gs[k + 1] || '"}}') AS js FROM x)
SELECT ep, f, 'Global task: Do it.' || chr(10) || 'Completed subtasks: [' || array_to_string(js[1:pl], ',') || ']' || chr(10) || CASE WHEN plan THEN '' ELSE 'Current subtask: ' || gs[pl + 1] || chr(10) ||
CASE WHEN f % 5 = 1 THEN '' ELSE printf('Robot state: the gripper values of left and right arms are currently %.3f and %.3f, while the z values of left and right arms are %.3f and %.3f, respectively.', (f % 4)::DOUBLE / 4, 1.0::DOUBLE, (f % 8)::DOUBLE / 8, 0.5::DOUBLE) || chr(10) END END ||
CASE WHEN f > 0 THEN 'Historical image observations (oldest to newest):' || chr(10) || '<time 1 frame ' || (f - 1) || '>' || chr(10) || '<main> main@' || (f - 1) || chr(10) || '<left wrist> left_wrist@' || (f - 1) || chr(10) || '<time 2 frame ' || f || '>' || chr(10) ELSE 'Image observations:' || chr(10) END ||
'<main> main@' || f || chr(10) || '<left wrist> left_wrist@' || f || chr(10) || CASE WHEN plan THEN '' ELSE '<q>' END AS content, CASE WHEN plan THEN '[' || array_to_string(js[pl + 1:], ',') || ']' END AS answer, CASE WHEN plan THEN 'planner' ELSE 'estimator' END AS told FROM y""")
def robot_prompts(spark, sf_dir):
    """What a planner and a status estimator are asked about each frame, with the parts of the content joined."""
    from quernel.plans.queries import trajectories

    f = F.col("f")
    state = F.when(f % 5 != 1, F.struct(((f % 4) / 4).alias("left_grip"), F.lit(1.0).alias("right_grip"), ((f % 8) / 8).alias("left_z"), F.lit(0.5).alias("right_z")))
    rows = trajectories(spark, sf_dir).select(
        "ep", "f", F.when(f % 2 == 0, "plan").otherwise("frame").alias("kind"), F.lit("Do it.").alias("goal"), F.array(*map(F.lit, ("open", "take", "put"))).alias("goals"), (f % 3).cast("int").alias("idx"), F.least(f % 3 + 1, F.lit(2)).alias("plan_start"),
        F.when(f > 0, F.array(f - 1, f)).otherwise(F.array(f)).alias("frames"), state.alias("state"),
    )
    out = prompts.robot_prompt(rows, ["main", "left_wrist"], ["<q>"])
    return out.select("ep", "f", F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("content"), "answer", F.regexp_extract("system", "(planner|estimator)", 1).alias("told"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity / 640 * 1920, 6) AS x, round(l_quantity * 2 / 480 * 1080, 6) AS y, round(l_quantity / 1000 * 1920, 6) AS x_rel FROM lineitem""")
def predicted_boxes(spark, sf_dir):
    """Predicted boxes in pixels, from the seen size and from thousandths."""
    q, n = F.col("l_quantity"), F.lit
    box = F.array(q, q * 2, q + 1, q * 2 + 1)
    seen = G.box_in_pixels(box, n(1920), n(1080), n(640), n(480))
    rel = G.box_in_pixels(box, n(1920), n(1080), n(640), n(480), relative=True)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(seen[0], 6).alias("x"), F.round(seen[1], 6).alias("y"), F.round(rel[0], 6).alias("x_rel"))


@query("""WITH x AS (SELECT source, lang, doc_id, CASE WHEN quality < 0.5 AND n_chars > 1500 THEN 'fp' WHEN quality >= 0.5 AND n_chars <= 1500 THEN 'fn' END AS kind, n_chars % 97 / 97.0 AS p FROM documents JOIN labels USING (doc_id)),
s AS (SELECT source, lang, doc_id, kind, round(CASE WHEN kind = 'fp' THEN p ELSE 1 - p END, 9) AS score FROM x WHERE kind IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY score DESC, doc_id) AS k FROM s),
r AS (SELECT source, lang, doc_id, kind, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM b WHERE k = 1) SELECT * FROM r WHERE rank <= 3""")
def worst_episodes(spark, sf_dir):
    """The three worst episodes of each group by their worst errors; an episode is a source and language here."""
    from quernel.operators import sampling
    from quernel.plans.queries import judged

    kind = sampling.error_type(F.col("quality"), F.col("pred"), 0.5)
    rows = judged(spark, sf_dir).select("source", "lang", "doc_id", kind.alias("kind"), F.round(sampling.error_score(kind, F.col("n_chars") % 97 / 97), 9).alias("score"))
    return sampling.episode_errors(rows, ["source", "lang"], "worst", 0, "doc_id", each="lang", limit=3)
