"""Registered queries over annotations, evaluations, names and media: each calls one function of the library on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions import arrays
from quernel.functions import goals as G
from quernel.functions import jsonx
from quernel.functions import media as M
from quernel.functions import names as N
from quernel.functions import text as T
from quernel.operators import evaluation as E
from quernel.operators import batching, prep, quality, sampling, samples, spans, trajectory
from quernel.operators import series as W
from quernel.plans.queries import FI, FR, JU, PR, WC, arm_frames, arm_spans, bleu_sql, edits_sql, judged, query, read, token_lengths, trajectories
from quernel.plans.queries import spans as filled_spans

# ---- Goals

GOALS = [
    "Move to the pad.", "Open the gripper.", "Lift it with the left arm.", "Place both objects.", "Move the left arm while moving the right arm.", "Release it with the RIGHT arm.",
    "Use the other arm.", "Place it to the left of the cup.", "Pass it from the first arm.", "drop the can", "Wait while returning the left arm to its default pose.",
]
GOALS_SQL = ", ".join(f"'{g}'" for g in GOALS)
SOURCES = ["before_gripper_left_open", "episode_end_after_before_gripper_right_close", "before_eef_left_motion", "episode_end"]
SOURCES_SQL = ", ".join(f"'{s}'" for s in SOURCES)
GO = f"""go AS (SELECT p_partkey, [{GOALS_SQL}][p_partkey % {len(GOALS)} + 1] AS t, [{SOURCES_SQL}][p_size % {len(SOURCES)} + 1] AS s, CASE p_size % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS a FROM part),
cx AS (SELECT *, CASE WHEN regexp_matches(t, '\\b(?:both arms|dual arms|both objects|both grippers|grippers of both arms|corresponding arms)\\b', 'i') OR (regexp_matches(t, '\\bleft arm\\b', 'i') AND regexp_matches(t, '\\bright arm\\b', 'i')) THEN 'both'
WHEN regexp_matches(t, '\\bleft arm\\b', 'i') THEN 'left' WHEN regexp_matches(t, '\\bright arm\\b', 'i') THEN 'right' END AS context FROM go)"""


def goal_rows(spark, sf_dir) -> DataFrame:
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    arm = F.when(F.col("p_size") % 3 == 0, "left").when(F.col("p_size") % 3 == 1, "right")
    return read(spark, sf_dir, "part").select("p_partkey", pick(GOALS, F.col("p_partkey")).alias("t"), pick(SOURCES, F.col("p_size")).alias("s"), arm.alias("a"))


@query(rf"""WITH {GO} SELECT p_partkey, context, regexp_matches(t, 'both arms|dual arms|corresponding arms|both objects|both grippers|grippers of both arms', 'i') OR regexp_matches(t, '\bleft arm\b.+\bwhile moving the right arm\b|\bright arm\b.+\bwhile moving the left arm\b', 'i') AS uses_both,
regexp_matches(t, '\bwhile returning\b.+\b(?:neutral|default) pose\b', 'i') AS returns, nullif(lower(regexp_extract(t, '\b(?:open|release)\b.*\b(left|right) arm\b', 1, 'i')), '') AS release, nullif(regexp_extract(s, '_(left|right)_', 1), '') AS boundary,
nullif(regexp_extract(s, '^(?:episode_end_after_)?before_gripper_(left|right)_(open|close)$', 1), '') AS event_arm, nullif(regexp_extract(s, '^(?:episode_end_after_)?before_gripper_(left|right)_(open|close)$', 2), '') AS event_kind,
CASE WHEN context = 'both' OR context IS NULL THEN 'left,right' ELSE context END AS acting FROM cx""")
def goal_arms(spark, sf_dir):
    """Which arms goals and boundaries name."""
    t, s = F.col("t"), F.col("s")
    event = G.expected_event(s)
    return goal_rows(spark, sf_dir).select(
        "p_partkey", G.arm_context(t).alias("context"), G.uses_both(t).alias("uses_both"), G.returns_meanwhile(t).alias("returns"), G.release_arm(t).alias("release"), G.boundary_arm(s).alias("boundary"),
        event["arm"].alias("event_arm"), event["kind"].alias("event_kind"), F.array_join(G.acting_arms(F.lit(None).cast("string"), t), ",").alias("acting"),
    )


@query(rf"""WITH {GO}, na AS (SELECT *, CASE WHEN a IS NULL OR context IS NOT NULL THEN t WHEN t = 'Open the gripper.' THEN 'Open the gripper of the ' || a || ' arm.' WHEN regexp_matches(t, '^move to .+', 'i') THEN 'Move the ' || a || ' arm to ' || regexp_extract(rtrim(t, '.'), '^Move to (.+)$', 1, 'i') || '.'
WHEN ends_with(t, '.') THEN left(t, length(t) - 1) || ' with the ' || a || ' arm.' ELSE t || ' with the ' || a || ' arm' END AS named FROM cx)
SELECT p_partkey, named, replace(replace(replace(s, '_left_', '_' || chr(1) || '_'), '_right_', '_left_'), chr(1), 'right') AS source, replace(t, 'to the left of', 'to the right of') AS placed, 'Go while ' || lower(left(rtrim(t, '.'), 1)) || substr(rtrim(t, '.'), 2) || '.' AS joined,
CASE WHEN t LIKE 'Move %' THEN 'moving ' || substr(rtrim(t, '.'), 6) WHEN t LIKE 'Use %' THEN 'using ' || substr(rtrim(t, '.'), 5) WHEN t LIKE 'Place %' THEN 'placing ' || substr(rtrim(t, '.'), 7) WHEN t LIKE 'drop %' THEN 'dropping ' || substr(rtrim(t, '.'), 6) ELSE lower(left(rtrim(t, '.'), 1)) || substr(rtrim(t, '.'), 2) END AS clause FROM na""")
def goal_rewrites(spark, sf_dir):
    """Goals with an arm named, places and boundaries mirrored, and sentences put together."""
    t = F.col("t")
    return goal_rows(spark, sf_dir).select("p_partkey", G.with_arm(t, F.col("a")).alias("named"), G.flip_boundary(F.col("s")).alias("source"), G.flip_places(t).alias("placed"), G.joined_while(F.lit("Go."), t).alias("joined"), G.concurrent(t).alias("clause"))


# ---- Names and media


@query(r"""WITH x AS (SELECT p_partkey, p_size, replace(p_name, ' ', CASE p_size % 3 WHEN 0 THEN '-aloha-agilex_' WHEN 1 THEN '-aloha-' ELSE '-' END) || CASE WHEN p_size % 5 = 0 THEN '-aloha-agilex_clean_50' WHEN p_size % 5 = 1 THEN '-aloha-agilex_randomized_500' ELSE '' END AS r FROM part)
SELECT p_partkey, CASE WHEN contains(r, '-aloha-agilex_') THEN string_split(r, '-aloha-agilex_')[1] ELSE string_split(r, '-')[1] END AS annotated, CASE WHEN contains(r, '-aloha-') THEN string_split(r, '-aloha-')[1] ELSE string_split(r, '-')[1] END AS evaluated,
string_split(r, '-aloha-')[1] AS exported, CASE WHEN p_size % 5 = 0 THEN 'demo_clean' WHEN p_size % 5 = 1 THEN 'demo_randomized' WHEN contains(r, '-') THEN substr(r, instr(r, '-') + 1) ELSE r END AS raw,
printf('%s/data/chunk-%03d/episode_%06d.parquet', r, p_partkey // 7, p_partkey) AS path, regexp_replace(r, '[^a-zA-Z0-9._-]', '_', 'g') AS safe FROM x""")
def repository_names(spark, sf_dir):
    """Slugs, folders and paths from the names of repositories."""
    size = F.col("p_size")
    mark = F.when(size % 3 == 0, "-aloha-agilex_").when(size % 3 == 1, "-aloha-").otherwise("-")
    tail = F.when(size % 5 == 0, "-aloha-agilex_clean_50").when(size % 5 == 1, "-aloha-agilex_randomized_500").otherwise("")
    r = F.col("r")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), mark), tail).alias("r"))
    return rows.select(
        "p_partkey", N.slug_of_annotation(r).alias("annotated"), N.slug_of_evaluation(r).alias("evaluated"), N.slug_of_export(r).alias("exported"), N.raw_folder(r).alias("raw"),
        N.episode_path(r, F.col("p_partkey"), F.lit(7)).alias("path"), N.safe_name(r).alias("safe"),
    )


@query(r"""SELECT l_orderkey, l_linenumber, round(l_quantity / greatest(l_partkey, 1e-6) * 30, 9) AS fps, greatest(least(round_even(l_extendedprice / 1000, 0) * 2, 62), 4)::INT AS frames, list_distinct(list_transform(range(0, c), lambda k: floor(k * (l_partkey % 90 + 9) / (c - 1)))::INT[]) AS packed, ((l_partkey % 30 * 32) * 640) // 1024 AS tokens
FROM (SELECT *, least(greatest(round_even(l_quantity / 4, 0), 4), 8)::BIGINT AS c FROM lineitem)""".replace("list_distinct(list_transform(range(0, c), lambda k: floor(k * (l_partkey % 90 + 9) / (c - 1)))::INT[]) AS packed", "list_sum(list_distinct(list_transform(range(0, c), lambda k: floor(k * (l_partkey % 90 + 9) / (c - 1))::BIGINT)))::BIGINT AS packed"))
def media_counts(spark, sf_dir):
    """Rates, numbers of frames and of tokens. (The frames that a packer takes are told by their sum.)"""
    c = F.col
    rows = read(spark, sf_dir, "lineitem")
    packed = M.packed_frames(c("l_quantity"), c("l_partkey") % 90 + 10)
    return rows.select(
        "l_orderkey", "l_linenumber", F.round(M.sample_fps(c("l_quantity"), c("l_partkey"), F.lit(30)), 9).alias("fps"), M.frames_of_duration(c("l_extendedprice") / 1000, F.lit(2), 4, 63).alias("frames"),
        F.aggregate(packed, F.lit(0).cast("long"), lambda a, x: a + x).alias("packed"), M.tokens_of_grid(c("l_partkey") % 30 * 32, F.lit(640)).alias("tokens"),
    )


@query("""WITH x AS (SELECT label, embedding[1]::DOUBLE * 4 AS z, CASE WHEN vec_id % 3 = 0 THEN -100.0 ELSE (embedding[2] > 0)::INT END AS y FROM embeddings)
SELECT label, count(*) FILTER (y > -50) AS n, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) FILTER (y > -50), 9) AS entropy, round(avg((1 / (1 + exp(-z)) - y) ** 2) FILTER (y > -50), 9) AS square FROM x GROUP BY label""")
def masked_losses(spark, sf_dir):
    """Mean losses of predictions whose labels are known."""
    z, y = F.col("embedding")[0].cast("double") * 4, F.when(F.col("vec_id") % 3 == 0, -100.0).otherwise((F.col("embedding")[1] > 0).cast("double"))
    entropy, square = M.masked_losses(z, y)
    return read(spark, sf_dir, "embeddings").select("label", entropy.alias("e"), square.alias("s")).groupBy("label").agg(F.count("e").alias("n"), F.round(F.avg("e"), 9).alias("entropy"), F.round(F.avg("s"), 9).alias("square"))


# ---- Evaluations


@query(f"WITH {JU} SELECT lang, count(*) FILTER (quality < 0.5 AND pred = 1) AS fp, count(*) FILTER (quality >= 0.5 AND pred = 0) AS fn FROM ju GROUP BY lang")
def row_errors(spark, sf_dir):
    """False positives and negatives by language."""
    return E.error_counts(judged(spark, sf_dir), "quality", "pred", group=["lang"])


SHORT_TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[ \t\n\r\f\v]+'), lambda w: w <> '')[1:12]"


@query(f"""WITH p AS (SELECT conv_id, {SHORT_TOKENS.format('min_by(text, turn)')} AS a0, {SHORT_TOKENS.format('max_by(text, turn)')} AS b0 FROM conversations GROUP BY conv_id),
q AS (SELECT conv_id, w AS win, a0[1:w] AS a, b0[1:w] AS b FROM p, (SELECT unnest([1, 3, 12]) AS w)), s AS (SELECT win, {bleu_sql('a', 'b')} AS bleu, {edits_sql('a', 'b')} AS edits, len(a) AS n, a = b AS same FROM q)
SELECT win AS "window", count(*) AS n, round(avg(bleu), 6) AS bleu, round(avg(edits), 6) AS edits, round(avg(edits / greatest(1, n)), 6) AS share, round(avg(same::INT), 6) AS exact FROM s GROUP BY win""")
def bleu_windows(spark, sf_dir):
    """Scores of the first 1, 3 and 12 goals; a goal is a word here, the first turn of a conversation is gold and its last one is said."""
    words = lambda c: F.slice(T.tokens(F.lower(c)), 1, 12)
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b")).select(words(F.col("a")).alias("a"), words(F.col("b")).alias("b"))
    out = E.window_summary(rows, "a", "b", [1, 3, 12])
    return out.select("window", "n", *(F.round(c, 6).alias(c) for c in ("bleu", "edits", "share", "exact")))


@query(r"""WITH c AS (SELECT conv_id, role, array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> ''), ' ') AS t FROM conversations)
SELECT count(*) AS n, count(DISTINCT role) AS tasks, round(count(*) FILTER (t = trim(t) AND length(t) % 2 = 0) / count(*), 6) AS exact FROM c""")
def exact_match_rate(spark, sf_dir):
    """The share of texts that are the wanted ones when normalised; texts of an odd length are wanted to be longer."""
    text = jsonx.canonical(F.col("text"))
    wanted = F.when(F.length(text) % 2 == 0, F.concat(F.lit("  "), F.col("text"))).otherwise(F.concat("text", F.lit(" more")))
    rows = read(spark, sf_dir, "conversations").withColumn("wanted", wanted)
    return E.exact_rate(rows, "text", "wanted", "role").withColumn("exact", F.round("exact", 6))


@query("""SELECT 25 AS num_all_tasks, count(*) FILTER (n_nationkey % 4 > 0) AS num_train_tasks, count(*) FILTER (n_nationkey % 4 = 0) AS num_test_tasks, string_agg(n_name, ',' ORDER BY n_name) AS all_tasks,
string_agg(n_name, ',' ORDER BY n_name) FILTER (n_nationkey % 4 > 0) AS train_tasks, string_agg(n_name, ',' ORDER BY n_name) FILTER (n_nationkey % 4 = 0) AS test_tasks FROM nation""")
def split_manifest(spark, sf_dir):
    """Names and numbers of the groups of a split; lists are joined by commas."""
    out = E.split_manifest(read(spark, sf_dir, "nation").withColumn("test", F.col("n_nationkey") % 4 == 0), "n_name", "test")
    return out.select(*(F.array_join(c, ",").alias(c) if not c.startswith("num_") else F.col(c) for c in out.columns))


@query("""SELECT 'rule' AS "of", event_type AS name, count(*) AS n FROM events GROUP BY event_type UNION ALL (SELECT 'repo', user_id::VARCHAR, count(*) FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id::VARCHAR LIMIT 50)""")
def issue_report(spark, sf_dir):
    """Counts by rule, and the 50 repositories with most issues."""
    return E.issue_report(read(spark, sf_dir, "events").select(F.col("event_type").alias("rule"), F.col("user_id").cast("string").alias("repo")))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: greatest(-2, least(1, floor(v * 8 + 0.5)))::INT) AS c FROM embeddings)
SELECT vec_id, len(c) AS total, len(list_filter(c, lambda v: v = 1)) AS passed, len(list_filter(c, lambda v: v = 0)) AS failed, len(list_filter(c, lambda v: v = -1)) AS errors, len(list_filter(c, lambda v: v = -2)) AS timeouts,
len(list_filter(c, lambda v: v = 1)) / len(c) AS accuracy, len(list_filter(c, lambda v: v = 1)) = len(c) AS all_passed FROM x""")
def tested_programs(spark, sf_dir):
    """Tallies of tests by their codes."""
    codes = F.transform(arrays.scaled_down(F.col("embedding"), 8, 0.5), lambda c: F.greatest(F.lit(-2), F.least(F.lit(1), c)))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", codes.alias("codes"))
    return E.tested(rows)


@query("""SELECT o_orderpriority AS repo, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice <= 150000) AS converted, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 150000) AS skipped, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1""")
def conversion_report(spark, sf_dir):
    """Converted, skipped and failed episodes of each repository."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("repo"), (F.col("o_totalprice") > 150000).alias("there"), F.when(F.col("o_orderstatus") == "F", "broken").alias("error"))
    return E.conversion_report(rows)


@query("""WITH b AS (SELECT l_orderkey AS image_id, ['r', 'a', 'n'] AS cs, l_partkey::DOUBLE AS x, l_quantity AS y, l_returnflag AS label FROM lineitem)
SELECT image_id, x AS left_, y AS top, 7.5 AS width, 2.5 AS height, 1.0 AS score, [90, 91, 92][list_position(cs, lower(label))] AS category_id FROM b WHERE list_contains(cs, lower(label))""")
def detection_results(spark, sf_dir):
    """Boxes by class and image, then a result's row for each box: x, y, width, height."""
    x, y = F.col("l_partkey").cast("double"), F.col("l_quantity")
    boxes = read(spark, sf_dir, "lineitem").select(F.lit("odd").alias("dataset"), F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("label"), F.array(x, y, x + 7.5, y + 2.5).alias("box"), F.lit(None).cast("double").alias("score"))
    rows = E.detection_rows(E.boxes_of_images(E.class_index(boxes, ["R", "A", "N"])), [90, 91, 92])
    return rows.select("image_id", *(F.col("bbox")[k].alias(n) for k, n in enumerate(("left_", "top", "width", "height"))), "score", "category_id")


@query(f"""WITH {PR}, b AS (SELECT ep, max(f) FILTER (progress + 1e-9 < 0.9) AS bad, max(f) AS last FROM pr GROUP BY ep), r AS (SELECT last - coalesce(bad, -1) AS n FROM b)
SELECT k AS least, round(avg((n >= k)::INT), 6) AS share FROM r, (SELECT unnest([1, 2, 3, 4, 5, 10, 20, 50]) AS k) GROUP BY k""")
def done_survival(spark, sf_dir):
    """How many of all done runs last so many frames."""
    runs = W.trailing_run(W.running_progress(trajectories(spark, sf_dir), 5.0), F.col("progress") + 1e-9, 0.9)
    return E.survival(runs).withColumn("share", F.round("share", 6))


@query(f"""WITH {FR}, v AS (SELECT ep, kind, count(*) AS n FROM fr GROUP BY ep, kind), s AS (SELECT ep, min(n) AS seen, count(*) AS kinds FROM v GROUP BY ep), h AS (SELECT ep, count(*) AS had FROM fr WHERE ep % 3 > 0 GROUP BY ep)
SELECT s.ep, least(seen, kinds + 1, coalesce(had, kinds + 1)) AS n FROM s LEFT JOIN h USING (ep)""")
def available_frames(spark, sf_dir):
    """The fewest frames over views, annotation and states."""
    rows = trajectories(spark, sf_dir)
    views = rows.groupBy("ep", "kind").agg(F.count("*").alias("n"))
    return E.available_frames(views, views.groupBy("ep").agg((F.count("*") + 1).alias("num_frames")), rows.filter("ep % 3 > 0"))


@query("""WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders) SELECT o_orderpriority, o_orderkey FROM r WHERE rn <= 7""")
def first_of_groups(spark, sf_dir):
    """The first seven of each group."""
    return E.seeded(read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 7, 0, first=True)


@query(f"""WITH {FI}, m AS (SELECT ep, max("end") AS last FROM fi GROUP BY ep), x AS (SELECT ep, idx, start + unnest([-2, -1, 0, 1, 2]) AS f FROM fi WHERE idx > 0) SELECT x.ep, x.idx, x.f FROM x JOIN m USING (ep) WHERE f BETWEEN 0 AND last""")
def boundary_frames(spark, sf_dir):
    """The frames around the boundaries of spans."""
    return E.boundary_frames(filled_spans(spark, sf_dir), 2)


# ---- Spans

STEPS = [
    ("Move to the grasp pose of the cup.", "move", "left"), ("Close the gripper.", "close", "left"), ("Lift the cup with both arms.", "move", None), ("Move the right arm to the place pose.", "move", "right"),
    ("Open the gripper.", "open", "right"), ("Return the right arm to a neutral pose.", "move", "right"),
]


def made_steps(frames: DataFrame) -> DataFrame:
    step = lambda k, s: F.struct(F.lit(k).alias("pos"), F.lit(s[0]).alias("text"), F.lit(s[1]).alias("kind"), F.lit(s[2]).cast("string").alias("arm"), F.array().cast("array<string>").alias("ends"))
    return frames.select("ep").distinct().select("ep", F.explode(F.array(*(step(k, s) for k, s in enumerate(STEPS)))).alias("s")).select("ep", "s.*")


@query()
def span_state_machine(spark, sf_dir):
    """Fine spans of all episodes from steps, gripper events and motion."""
    rows = arm_frames(spark, sf_dir)
    return spans.assign(rows, trajectory.gripper_events(rows), made_steps(rows))


@query()
def coarse_spans(spark, sf_dir):
    """Coarse spans of all episodes from segments of motion and gripper groups."""
    rows = arm_frames(spark, sf_dir)
    return spans.assign_coarse(rows, trajectory.gripper_events(rows), made_steps(rows))


@query(f"""WITH {FR}, p AS (SELECT ep, f FROM fr WHERE kind = 'view'), e AS (SELECT ep, f AS ef, CASE WHEN v > 10 THEN 'left' ELSE 'right' END AS arm FROM fr WHERE kind = 'purchase'),
m AS (SELECT p.ep, p.f, arg_min(e.ef, e.ef) AS ef, arg_min(e.arm, e.ef) AS arm FROM p LEFT JOIN e ON p.ep = e.ep AND e.ef > p.f GROUP BY p.ep, p.f)
SELECT ep, f, f + 2 AS start, greatest(f + 2, ef - 1) - CASE WHEN ef IS NULL THEN NULL ELSE 1 END AS frame, 'before_gripper_' || arm || '_open' AS source, CASE WHEN arm IS NULL THEN NULL ELSE 'gripper_open' END AS rule FROM m""")
def upcoming_grips(spark, sf_dir):
    """Before which gripper event each frame's step would end."""
    rows = trajectories(spark, sf_dir)
    points = rows.filter("kind = 'view'").select("ep", "f", (F.col("f") + 2).alias("start"))
    arm = F.when(F.col("v") > 10, "left").otherwise("right")
    events = rows.filter("kind = 'purchase'").select("ep", F.col("f").alias("frame"), arm.alias("arm"), F.lit("open").alias("kind"), (F.col("f") - 1).alias("start_frame"))
    return spans.upcoming(points, events, kinds=["open"])


# ---- Training items


@query(r"""WITH c AS (SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> ''), lambda w: length(w)) AS ids FROM conversations),
b AS (SELECT *, list_filter(range(1, len(ids) + 1), lambda i: ids[i] = 3) AS starts, list_filter(range(1, len(ids) + 1), lambda i: ids[i] = 2) AS stops FROM c),
s AS (SELECT conv_id, turn, ids, list_transform(starts, lambda i: struct_pack(a := i + 2, b := list_min(list_filter(stops, lambda j: j >= i + 2)) + 1)) AS sp FROM b)
SELECT conv_id, turn, len(ids) AS n, len(list_filter(range(1, len(ids) + 1), lambda k: len(list_filter(sp, lambda x: x.b IS NOT NULL AND k >= x.a AND k <= x.b)) > 0)) AS n_labelled FROM s""")
def answer_labels(spark, sf_dir):
    """How many ids of each turn are labels. A word's length is its id; 3 begins an answer and 2 ends it."""
    ids = F.transform(T.tokens(F.col("text")), lambda w: F.length(w))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("ids"))
    labels = prep.answer_labels(F.col("ids"), 3, 2)
    return rows.select("conv_id", "turn", F.size("ids").alias("n"), F.size(F.filter(labels, lambda x: x != prep.IGNORED)).alias("n_labelled"))


@query(f"""WITH w AS (SELECT conv_id, 21 + sum({WC})::BIGINT AS n_tokens FROM conversations GROUP BY conv_id) SELECT conv_id, n_tokens, true AS fits, true AS near_the_bound FROM w""")
def pack_patterns(spark, sf_dir):
    """All conversations in bins of 2048 tokens, by patterns of lengths: each once, no bin too full, and at most 1 % more bins than the sum of tokens needs (and one)."""
    lengths = token_lengths(spark, sf_dir).select("conv_id", "n_tokens")
    bins = batching.packed_by_patterns(lengths, "conv_id", "n_tokens", 2048)
    filled = bins.groupBy("bin").agg(F.sum("n_tokens").alias("filled"), F.count("*").alias("n"))
    least, made = filled.agg(F.ceil(F.sum(F.least(F.col("filled"), F.lit(2048))) / 2048), F.count("*")).first()
    return bins.join(filled, "bin").select("conv_id", "n_tokens", ((F.col("filled") <= 2048) | (F.col("n") == 1)).alias("fits"), F.lit(made <= (least or 0) * 1.01 + 1).alias("near_the_bound"))


@query(r"""WITH c AS (SELECT conv_id, list_transform(list_filter(regexp_split_to_array(string_agg(text, ' ' ORDER BY turn), '[ \t\n\r\f\v]+'), lambda w: w <> ''), lambda w: length(w)) AS ids FROM conversations GROUP BY conv_id),
n AS (SELECT conv_id, ids[1:300] AS ids, CAST(greatest(floor(pow(2.0, ceil(log2(greatest(len(ids[1:300]), 1)) * 4 - 1e-9) / 4) + 1e-9), 1) AS BIGINT) AS top FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY top ORDER BY conv_id) - 1 AS rank FROM n), b AS (SELECT *, rank // greatest(1, 4096 // top) AS batch_at FROM r)
SELECT top AS batch_top, batch_at, CAST(max(len(ids)) AS INT) AS width, CAST(count(*) AS INT) AS n_rows, array_to_string(list(conv_id ORDER BY conv_id), ',') AS members, CAST(sum(len(ids)) AS BIGINT) AS n_real,
CAST(sum(list_sum(ids)) AS BIGINT) AS id_sum, array_to_string(list(coalesce(len(ids) - nullif(list_position(list_reverse(ids), 3), 0), -1) ORDER BY conv_id), ',') AS places FROM b GROUP BY top, batch_at""")
def collated_batches(spark, sf_dir):
    """Conversations as batches of at most 4096 tokens with filling; a word's length is its id, 0 fills, and 3 is a query."""
    told = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("told"))
    ids = F.transform(T.tokens(F.array_join("told", " ")), lambda w: F.length(w))
    count = F.when(F.size("ids") > 0, F.sequence(F.lit(0), F.size("ids") - 1)).otherwise(F.array().cast("array<int>"))
    rows = told.select("conv_id", ids.alias("ids")).select("conv_id", "ids", F.col("ids").alias("labels"), F.array(count, count, count).alias("positions"))
    batches = batching.collated(rows, "conv_id", 4096, 0, 300, {"answer": 3})
    total = lambda column: F.aggregate(F.flatten(column), F.lit(0).cast("long"), lambda a, x: a + x)
    real = F.size(F.filter(F.flatten("attention_mask"), lambda x: x)).cast("long")
    return batches.select("batch_top", "batch_at", "width", F.size("keys").alias("n_rows"), F.array_join("keys", ",").alias("members"), real.alias("n_real"), total("input_ids").alias("id_sum"), F.array_join("answer_place", ",").alias("places"))


ITEMS = """it AS (SELECT conv_id, replace(replace(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), 'la', '<image>'), 'der', '<video>') AS asked, replace(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), 'und', '<image>') AS answered, count(*) AS n FROM conversations GROUP BY conv_id),
ct AS (SELECT conv_id, (length(coalesce(asked, '')) - length(replace(coalesce(asked, ''), '<image>', ''))) // 7 AS im, (length(coalesce(asked, '')) - length(replace(coalesce(asked, ''), '<video>', ''))) // 7 AS vm, n % 4 AS ni, n % 2 AS nv, contains(coalesce(answered, ''), '<image>') OR contains(coalesce(answered, ''), '<video>') AS stray FROM it)"""


def items(spark, sf_dir) -> DataFrame:
    """Conversations as items: some words of questions and answers become marks, and the number of turns tells how many media there are."""
    human, value = F.col("role") == "user", F.col("text")
    marked = F.when(human, F.replace(F.replace(value, F.lit("la"), F.lit("<image>")), F.lit("der"), F.lit("<video>"))).otherwise(F.replace(value, F.lit("und"), F.lit("<image>")))
    speaker = F.when(human, "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", speaker.alias("from"), marked.alias("value"))
    told = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "from", "value"))), lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"), F.count("*").cast("int").alias("n"))
    named = lambda kind, n: F.transform(F.slice(F.sequence(F.lit(0), F.lit(9)), F.lit(1), n), lambda k: F.concat(F.lit(kind), k.cast("string")))
    return told.select("conv_id", "conversations", named("i", F.col("n") % 4).alias("image"), named("v", F.col("n") % 2).alias("video"))


@query(f"""WITH {ITEMS} SELECT conv_id, im AS n_image_marks, ni AS n_image, vm AS n_video_marks, nv AS n_video, (im <> ni)::INT + (vm <> nv)::INT + stray::INT AS n_problems FROM ct""")
def checked_items(spark, sf_dir):
    """Marks, media and problems of each item."""
    out = prep.check_items(items(spark, sf_dir))
    return out.select("conv_id", "n_image_marks", "n_image", "n_video_marks", "n_video", F.size("problems").alias("n_problems"))


@query("""WITH x AS (SELECT doc_id, lang, CASE WHEN quality < 0.5 AND n_chars > 1500 THEN 'fp' WHEN quality >= 0.5 AND n_chars <= 1500 THEN 'fn' END AS kind, n_chars FROM documents JOIN labels USING (doc_id)),
r AS (SELECT doc_id, kind, n_chars, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'fp' THEN -n_chars ELSE n_chars END, doc_id) AS rank FROM x WHERE kind IS NOT NULL) SELECT doc_id, kind, n_chars, rank FROM r WHERE rank <= 25""")
def worst_errors(spark, sf_dir):
    """The 25 worst false positives and false negatives."""
    rows = judged(spark, sf_dir).select("doc_id", sampling.error_type(F.col("quality"), F.col("pred"), 0.5).alias("kind"), "n_chars")
    return sampling.worst(rows, "kind", "n_chars", 25, "doc_id")


@query("""WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) SELECT source, doc_id, n_chars FROM r WHERE rn = 1""")
def best_of_groups(spark, sf_dir):
    """The longest document of each source."""
    return sampling.best_of(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], "n_chars", "doc_id")


@query(f"""WITH {FI}, m AS (SELECT ep, count(*) AS many FROM fi GROUP BY ep), s AS (SELECT ep, idx, start, "end", greatest(start, "end" - 2) AS done_start, many, unnest(range(start, "end" + 1)) AS f FROM fi JOIN m USING (ep) WHERE start <= "end")
SELECT ep, idx, f, CASE WHEN f >= done_start THEN least(idx + 1, many - 1) ELSE idx END AS plan_start FROM s""")
def plan_starts(spark, sf_dir):
    """Where the plan begins at each frame of each span; the last three frames of a span are done."""
    made = filled_spans(spark, sf_dir)
    sizes = made.groupBy("ep").agg(F.count("*").alias("n_spans"))
    rows = W.inside(made.withColumn("done_start", F.greatest(F.col("start"), F.col("end") - 2)), "idx", "done_start").join(sizes, "ep")
    return samples.plan_start(rows).select("ep", "idx", "f", "plan_start")


@query()
def training_samples(spark, sf_dir):
    """Plan rows and frames that are undone, just done or done for the span before, of all episodes."""
    rows = arm_frames(spark, sf_dir)
    return samples.build(rows, arm_spans(rows), stride=3)


# ---- Quality rules

RULED = ["Move the left arm up.", "Close the gripper of the right arm.", "Open the gripper of the left arm.", "Lift both objects.", "Wait.", "Move the left arm to the place pose.", "Press it with the right arm."]
RULED_SQL = ", ".join(f"'{g}'" for g in RULED)
KIND_SQL = r"""CASE WHEN regexp_matches(lower({0}), '\bopen the gripper|open the grippers|release\b') THEN 'open' WHEN regexp_matches(lower({0}), '\bclose the gripper|close the grippers|partially close\b') THEN 'close'
WHEN regexp_matches(lower({0}), '\b(move|lift|place|return|retract|pull|scan|rotate|shake|press|operate|click|hit|pour|open the .*door|open the .*lid)\b') THEN 'move' ELSE 'unknown' END"""
NAMES_SQL = r"(regexp_matches(lower({0}), '\b{1} arm\b') OR regexp_matches(lower({0}), '\b(?:both arms|dual arms|both grippers|grippers of both arms|both objects)\b'))"
GRIP_SQL, MOTION_SQL = "^(?:episode_end_after_)?before_gripper_(left|right)_(open|close)$", "^(?:episode_end_after_)?before_eef_(left|right)_motion$"


def annotated(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Annotations, spans, frames and events with something wrong in each of them now and then."""
    ep, pos = F.col("ep"), F.col("pos")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    rows = trajectories(spark, sf_dir)
    base = rows.groupBy("ep", F.floor(F.col("f") / 10).alias("pos")).agg(F.min("f").alias("s0"), F.max("f").alias("e0"))
    made = base.select(
        "ep", "pos", (pos + (pos % 11 == 10).cast("int")).alias("subtask_index"), pick(RULED, ep + pos).alias("goal"), F.when((ep + pos) % 4 == 0, "dual_move").when((ep + pos) % 4 == 1, "").alias("subtask_type"),
        (F.col("s0") + ((ep + pos) % 13 == 12).cast("int")).alias("start"), (F.col("e0") + ((ep + pos) % 17 == 16).cast("int")).alias("end"), pick(SOURCES, pos).alias("source"), F.lit("").alias("rule"),
    )
    slug = F.when(ep % 3 == 0, "handover_mic").when(ep % 3 == 1, "place_dual_shoes").otherwise("other")
    annos = rows.groupBy("ep").agg((F.count("*") + (F.first("ep") % 7 == 0).cast("int")).alias("num_frames")).select("ep", slug.alias("slug"), "num_frames")
    arm, kind = F.when(F.col("v") > 10, "left").otherwise("right"), F.when(F.col("kind") == "purchase", "open").otherwise("close")
    events = rows.filter("kind IN ('purchase', 'view')").select("ep", arm.alias("arm"), kind.alias("kind"), F.col("f").alias("frame"), F.col("f").alias("start_frame"))
    return annos, made, arm_frames(spark, sf_dir), events


QR = rf"""{FR}, am AS (SELECT ep, f, v / 100 AS lx, v % 7 / 70 AS ly, v % 10 / 10 AS lg, v % 3 / 30 AS rx, v / 300 AS rz, v % 4 / 4 AS rg FROM fr),
sp AS (SELECT ep, f // 10 AS pos, f // 10 + (f // 10 % 11 = 10)::INT AS subtask_index, [{RULED_SQL}][(ep + f // 10) % {len(RULED)} + 1] AS goal, CASE (ep + f // 10) % 4 WHEN 0 THEN 'dual_move' WHEN 1 THEN '' END AS subtask_type,
min(f) + ((ep + f // 10) % 13 = 12)::INT AS start, max(f) + ((ep + f // 10) % 17 = 16)::INT AS "end", [{SOURCES_SQL}][f // 10 % {len(SOURCES)} + 1] AS source FROM fr GROUP BY ep, f // 10),
an AS (SELECT ep, CASE ep % 3 WHEN 0 THEN 'handover_mic' WHEN 1 THEN 'place_dual_shoes' ELSE 'other' END AS slug, count(*) + (ep % 7 = 0)::INT AS num_frames, count(*) AS n FROM fr GROUP BY ep),
ev AS (SELECT DISTINCT ep, CASE WHEN v > 10 THEN 'left' ELSE 'right' END AS want_arm, CASE WHEN kind = 'purchase' THEN 'open' ELSE 'close' END AS want_kind, f AS next_start, true AS met FROM fr WHERE kind IN ('purchase', 'view')),
st AS (SELECT am.*, pos, start, coalesce(sqrt((lx - lag(lx) OVER w) ** 2 + (ly - lag(ly) OVER w) ** 2), 0) AS lp, coalesce(sqrt((rx - lag(rx) OVER w) ** 2 + (rz - lag(rz) OVER w) ** 2), 0) AS rp, coalesce(abs(lg - lag(lg) OVER w), 0) AS ls, coalesce(abs(rg - lag(rg) OVER w), 0) AS rs
FROM am JOIN sp ON sp.ep = am.ep AND f BETWEEN start AND "end" WINDOW w AS (PARTITION BY am.ep, pos ORDER BY f)),
lt AS (SELECT *, coalesce(max(f) FILTER (ls > 0.0001) OVER p, start) AS ll, coalesce(max(f) FILTER (rs > 0.0001) OVER p, start) AS rl FROM st WINDOW p AS (PARTITION BY ep, pos)),
mo AS (SELECT ep, pos, sum(lp) AS l_len, sum(rp) AS r_len, (max(lg) >= 0.5 AND min(lg) < 0.5) OR max(lg) - min(lg) >= 0.25 AS l_grip, (max(rg) >= 0.5 AND min(rg) < 0.5) OR max(rg) - min(rg) >= 0.25 AS r_grip,
sum(CASE WHEN f > ll THEN lp ELSE 0 END) AS l_after, sum(CASE WHEN f > rl THEN rp ELSE 0 END) AS r_after FROM lt GROUP BY ep, pos),
s1 AS (SELECT sp.*, slug, n, CASE WHEN trim(coalesce(subtask_type, '')) <> '' THEN trim(subtask_type) ELSE {KIND_SQL.format('goal')} END AS stype, coalesce(lag("end") OVER w, -1) AS pe, lead(start) OVER w AS next_start, lead(goal) OVER w AS next_goal,
regexp_extract(source, '{GRIP_SQL}', 1) AS want_arm, regexp_extract(source, '{GRIP_SQL}', 2) AS want_kind FROM sp JOIN an USING (ep) WINDOW w AS (PARTITION BY ep ORDER BY pos)),
s2 AS (SELECT s1.*, l_len, r_len, l_grip, r_grip, l_after, r_after, met, starts_with(stype, 'dual_') AS dual, CASE slug WHEN 'handover_mic' THEN 0.05 ELSE 0.015 END AS lim, next_start IS NULL AS last, start >= 0 AND "end" >= start AND "end" < n AS ok,
regexp_matches(trim(source), '^episode_end(_after_.*)?$') AS ended FROM s1 LEFT JOIN mo USING (ep, pos) LEFT JOIN ev USING (ep, want_arm, want_kind, next_start)),
s3 AS (SELECT *, {NAMES_SQL.format('goal', 'left')} OR dual AS nl, {NAMES_SQL.format('goal', 'right')} OR dual AS nr, CASE WHEN dual THEN regexp_replace(stype, '^dual_', '') ELSE {KIND_SQL.format('goal')} END AS kind, l_len >= 0.015 OR l_grip AS lc, r_len >= 0.015 OR r_grip AS rc,
l_len >= lim OR l_grip AS lcl, r_len >= lim OR r_grip AS rcl, want_kind <> '' AND NOT last AS bd, CASE WHEN want_arm = 'left' THEN {NAMES_SQL.format('next_goal', 'right')} AND NOT {NAMES_SQL.format('next_goal', 'left')} ELSE {NAMES_SQL.format('next_goal', 'left')} AND NOT {NAMES_SQL.format('next_goal', 'right')} END AS other_named FROM s2),
s4 AS (SELECT *, (nl AND NOT nr AND rcl AND r_len > l_len + 0.015) OR (nr AND NOT nl AND lcl AND l_len > r_len + 0.015) AS flipped, (nl AND NOT nr AND rcl AND NOT r_len > l_len + 0.015) OR (nr AND NOT nl AND lcl AND NOT l_len > r_len + 0.015) AS moved,
slug IN ('place_dual_shoes', 'place_cans_plasticbox') AND stype = 'dual_move' AND regexp_matches(goal, '^Move the (left|right) arm to the place pose') AND lc <> rc AS excused FROM s3),
iss AS (SELECT ep, pos::INT AS pos, unnest(range(1, 15)) AS k, unnest(['sequential_subtask_index', 'continuous_spans', 'valid_frame_range', 'min_frames', 'single_arm_label_maybe_flipped', 'single_arm_other_arm_static', 'dual_arm_both_changed', 'open_close_no_displacement', 'move_no_gripper_change', 'gripper_boundary_next_action', 'gripper_boundary_next_arm',
'gripper_boundary_matches_detected_event', 'eef_boundary_current_action', 'last_subtask_reaches_episode_end']) AS rule,
unnest([subtask_index <> pos, start <> pe + 1, NOT ok, ok AND "end" - start + 1 < 7 AND NOT (last AND "end" = n - 1 AND ended), ok AND flipped, ok AND moved, ok AND nl AND nr AND NOT (lc AND rc) AND NOT excused, ok AND kind IN ('open', 'close') AND (l_after >= 0.015 OR r_after >= 0.015), ok AND kind = 'move' AND (l_grip OR r_grip),
ok AND bd AND {KIND_SQL.format('next_goal')} <> want_kind, ok AND bd AND other_named AND NOT (lc AND rc), ok AND bd AND met IS NULL, ok AND regexp_matches(source, '{MOTION_SQL}') AND kind = 'unknown', last AND "end" <> n - 1]) AS bad FROM s4
UNION ALL SELECT ep, -1, -1, 'num_frames_matches_state', num_frames <> n FROM an),
bro AS (SELECT ep, pos, CASE WHEN k = 14 THEN 99 ELSE k END AS ord, rule FROM iss WHERE bad)"""


@query(f"WITH {QR} SELECT ep, pos, ord, rule FROM bro")
def quality_rules(spark, sf_dir):
    """All broken rules of annotated spans."""
    return quality.issues(*annotated(spark, sf_dir))


@query(f"WITH {QR} SELECT ep, arg_min(pos, CASE WHEN ord = 99 THEN 1000000 ELSE pos END * 1000 + ord) AS pos, arg_min(rule, CASE WHEN ord = 99 THEN 1000000 ELSE pos END * 1000 + ord) AS rule FROM bro GROUP BY ep")
def first_issue(spark, sf_dir):
    """The first issue of each annotation."""
    return quality.first_issue(quality.issues(*annotated(spark, sf_dir)))


@query(f"WITH {QR} SELECT rule, count(*) AS n FROM bro GROUP BY rule ORDER BY n DESC, rule LIMIT 50")
def issue_counts(spark, sf_dir):
    """How often each rule is broken."""
    return quality.issues(*annotated(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(50)


@query(f"""WITH {FI}, m AS (SELECT ep, idx, start, "end", max("end") OVER (PARTITION BY ep) AS last, lag(idx) OVER w AS bi, lag("end") OVER w AS be FROM fi WINDOW w AS (PARTITION BY ep ORDER BY idx)),
a AS (SELECT ep, idx, start, "end", unnest(range(start, "end" + 1)) AS f FROM m WHERE start <= "end"), n AS (SELECT ep, idx, bi, last, unnest(list_distinct([be - 1, be, start, start + 1, start + 2])) AS f FROM m WHERE bi IS NOT NULL)
SELECT ep, f, idx, (f >= "end" - 1)::INT::DOUBLE AS done, round(CASE WHEN f >= "end" - 1 THEN 1.0 ELSE (f - start) / greatest(1, "end" - start) END, 6) AS progress, 'active' AS grp FROM a
UNION ALL SELECT ep, f, bi, 1.0, 1.0, 'prev_done_probe' FROM n WHERE f BETWEEN 0 AND last UNION ALL SELECT ep, f, idx, 0.0, 0.0, 'current_not_done_probe' FROM n WHERE f BETWEEN 0 AND last""")
def timed_samples(spark, sf_dir):
    """Frames labelled by time alone, with probes around the boundaries."""
    rows = samples.timed_rows(filled_spans(spark, sf_dir), probes=True)
    return rows.withColumn("progress", F.round("progress", 6)).withColumnRenamed("group", "grp")


@query(f"""WITH {PR}, b AS (SELECT ep, 0 AS idx, max(f) FILTER (progress + 1e-9 < 0.995) AS bad, max(f) AS last, min(f) AS first, count(*) FILTER (progress + 1e-9 >= 0.995) AS total FROM pr GROUP BY ep)
SELECT ep, idx, last - coalesce(bad, first - 1) AS tail, total, least(3, last - first + 1) AS fixed FROM b""")
def done_frames_by_span(spark, sf_dir):
    """How many frames of each episode are done at its end and in all."""
    curve = W.running_progress(trajectories(spark, sf_dir), 5.0).select("ep", F.lit(0).alias("idx"), "f", "progress")
    return samples.done_runs(curve, 0.995)


@query()
def annotated_episodes(spark, sf_dir):
    """Annotations of all episodes: the task goes by the episode's number, the rest comes from frames."""
    from quernel.operators import annotate, tasks

    rows = arm_frames(spark, sf_dir)
    slug = F.element_at(F.array(*map(F.lit, tasks.TASKS)), (F.col("ep") % len(tasks.TASKS) + 1).cast("int"))
    episodes = rows.select("ep").distinct().select("ep", slug.alias("slug"), F.lit("Do the task, from left to right.").alias("goal"), F.create_map(F.lit("{a}"), F.lit("left")).alias("info"))
    return annotate.annotate(episodes, rows).select("ep", "task_slug", "num_frames", F.size("subtasks").alias("n_spans"), F.size("events").alias("n_events"))
