"""The registered queries over the driver's tables, each with its SQL for DuckDB.

A query is a thin plan over quernel.operators and quernel.functions. The tables stand in for the data the operators are
meant for: events are trajectories, conversations are training items, documents with labels are predictions with gold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions import geometry as G
from quernel.functions import mathx as M
from quernel.functions import text as T
from quernel.operators import prep
from quernel.operators import scoring as S
from quernel.operators import series as W
from quernel.operators.sampling import first_by_hash, values_at

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.frames(read(spark, sf_dir, "events"))


FR = "fr AS (SELECT user_id AS ep, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f, value AS v, event_type AS kind FROM events)"
ST = FR + ", st AS (SELECT *, v - lag(v) OVER (PARTITION BY ep ORDER BY f) AS d FROM fr)"
PR = ST + """, pa AS (SELECT *, sum(coalesce(abs(d), 0)) OVER (PARTITION BY ep ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM st),
pr AS (SELECT *, CASE WHEN max(path) OVER (PARTITION BY ep) >= 5 THEN least(1.0, path / max(path) OVER (PARTITION BY ep)) ELSE least(1.0, f / greatest(1, max(f) OVER (PARTITION BY ep))) END AS progress FROM pa)"""
SP = FR + """, fl AS (SELECT *, f - lag(f) OVER (PARTITION BY ep ORDER BY f) > 3 AS brk FROM fr WHERE v > 15),
isl AS (SELECT *, sum(coalesce(brk, false)::INT) OVER (PARTITION BY ep ORDER BY f) AS run FROM fl),
seg AS (SELECT ep, min(f) AS start, max(f) AS "end", count(*) AS n FROM isl GROUP BY ep, run)"""
FI = SP + """, la AS (SELECT ep, max(f) AS last FROM fr GROUP BY ep),
od AS (SELECT seg.*, last, row_number() OVER (PARTITION BY ep ORDER BY start) - 1 AS idx FROM seg JOIN la USING (ep)),
fi AS (SELECT ep, idx, CASE WHEN idx = 0 THEN 0 ELSE start END AS start, coalesce(lead(start) OVER (PARTITION BY ep ORDER BY start) - 1, last) AS "end", n FROM od)"""


# ---- SQL of text scores

NGRAMS = "list_transform(range(1, greatest(len({0}) - {1} + 2, 1)), lambda k: array_to_string({0}[k:k + {1} - 1], chr(1)))"


def bleu_sql(a: str, b: str) -> str:
    """Smoothed BLEU of the list b against the list a."""
    logs = []
    for n in range(1, 5):
        said, wanted = NGRAMS.format(b, n), NGRAMS.format(a, n)
        clipped = f"list_sum(list_transform(list_distinct({said}), lambda g: least(len(list_filter({said}, lambda x: x = g)), len(list_filter({wanted}, lambda x: x = g)))))"
        logs.append(f"ln((coalesce({clipped}, 0) + 1) / (len({said}) + 1))")
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CASE WHEN len({b}) > len({a}) THEN 1.0 ELSE exp(1 - len({a}) / len({b})) END * exp(({' + '.join(logs)}) / 4) END"


def edits_sql(a: str, b: str) -> str:
    """Edits between lists of tokens: each distinct token is one character for the distance of strings."""
    sign = lambda x: f"array_to_string(list_transform({x}, lambda t: chr(list_position(list_distinct(list_concat({a}, {b})), t)::INT)), '')"
    return f"levenshtein({sign(a)}, {sign(b)})"


# ---- Scoring


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with gold: the prediction calls long documents good."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    gold = read(spark, sf_dir, "labels")
    return docs.join(gold, "doc_id").withColumn("pred", (F.col("n_chars") > 1500).cast("int")).withColumn("hit", (F.col("pred") == F.col("quality")).cast("int"))


JU = "ju AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic, (n_chars > 1500)::INT AS pred, ((n_chars > 1500)::INT = quality)::INT AS hit FROM documents d JOIN labels USING (doc_id))"


@query(f"""WITH {JU}, g AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS grain,
CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source ELSE 'overall' END AS key, count(*) AS n, sum(hit)::BIGINT AS hits, avg(hit) AS a
FROM (SELECT coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, hit FROM ju) GROUP BY GROUPING SETS ((), (lang), (source)))
SELECT grain, key, n, hits, round(a, 6) AS accuracy FROM g""")
def accuracy_by_grain(spark, sf_dir):
    return S.accuracy(judged(spark, sf_dir), "hit", ["lang", "source"])


@query(f"""WITH {JU} SELECT coalesce(lang, 'Overall') AS subject, count(*) AS tot, count(*) FILTER (n_chars > 500) AS prefetch, count(*) FILTER (hit = 1) AS hit,
round(count(*) FILTER (n_chars > 500) / count(*) * 100, 4) AS prefetch_rate, round(count(*) FILTER (hit = 1) / count(*) * 100, 4) AS acc FROM ju GROUP BY ROLLUP (lang)""")
def category_score_table(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return S.category_table(rows.select("lang", (F.col("n_chars") > 500).alias("pre"), (F.col("hit") == 1).alias("hit")), "lang", "pre", "hit")


@query("""WITH x AS (SELECT label, (embedding[1]::DOUBLE + 1) / 2 AS y, (embedding[2]::DOUBLE + 1) / 2 AS p FROM embeddings)
SELECT CASE WHEN grouping(label) = 1 THEN 'all' ELSE label::VARCHAR END AS grp, count(*) FILTER (y >= 0.5 AND p >= 0.5) AS tp, count(*) FILTER (y < 0.5 AND p < 0.5) AS tn,
count(*) FILTER (y < 0.5 AND p >= 0.5) AS fp, count(*) FILTER (y >= 0.5 AND p < 0.5) AS fn, round(count(*) FILTER ((y >= 0.5) = (p >= 0.5)) / greatest(1, count(*)), 6) AS accuracy,
round(avg((p - y) * (p - y)), 6) AS mse, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(max(abs(p - y)), 6) AS max_abs FROM x GROUP BY ROLLUP (label)""")
def confusion_regression(spark, sf_dir):
    slot = lambda k: (F.col("embedding")[k].cast("double") + 1) / 2
    return S.confusion(read(spark, sf_dir, "embeddings"), "label", slot(0), slot(1), 0.5)


@query("""SELECT vec_id, len(list_filter(embedding[1:5], lambda x: x >= 0)) AS votes, round((embedding[1]::DOUBLE + embedding[2]::DOUBLE + embedding[3]::DOUBLE + embedding[4]::DOUBLE + embedding[5]::DOUBLE) / 5, 6) AS mean_prob,
len(list_filter(embedding[1:5], lambda x: x >= 0)) >= 3 AS pred, len(list_filter(embedding[1:5], lambda x: x >= 0)) || ':' || len(list_filter(embedding[1:5], lambda x: x < 0)) AS pattern FROM embeddings""")
def vote_aggregation(spark, sf_dir):
    heads = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", S.votes(heads, 0.0, 3).alias("v")).select("vec_id", "v.*")


@query(r"""WITH c AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(translate(text, '.()[],:;!*#{}', '              '), '\s+'), lambda w: w <> '') AS ws FROM conversations),
o AS (SELECT *, list_filter(['A','B','C','D','E'], lambda k: list_contains(ws, k)) AS found FROM c),
l AS (SELECT *, CASE WHEN contains(text, 'Cannot determine the answer') THEN 'Z' WHEN len(found) = 1 AND NOT (list_contains(ws, 'A') AND len(ws) > 3) THEN found[1] WHEN len(found) = 0 AND list_contains(ws, 'Z') THEN 'Z' END AS letter,
list_filter([['A','del'],['B','nicht'],['C','pour'],['D','which'],['E','para']], lambda x: contains(lower(text), x[2])) AS held FROM o)
SELECT conv_id, turn, letter, CASE WHEN len(held) = 1 THEN held[1][1] END AS by_text, coalesce(letter, CASE WHEN len(held) = 1 THEN held[1][1] END) AS picked FROM l""")
def option_extract(spark, sf_dir):
    options = F.create_map(*(F.lit(x) for pair in zip("ABCDE", ("del", "nicht", "pour", "which", "para")) for x in pair))
    text = F.col("text")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.option_letter(text, options).alias("letter"), T.option_text(text, options).alias("by_text"))
    return rows.withColumn("picked", F.coalesce("letter", "by_text"))


@query(r"""WITH x AS (SELECT doc_id, n_chars, regexp_extract(source, '([0-9]+)$', 1) AS digits, substr(source, 1, 3 + doc_id % 4) AS said FROM documents)
SELECT doc_id, try_cast(digits AS DOUBLE) AS number, coalesce(abs(try_cast(digits AS DOUBLE) - n_chars % 20) < 0.000001, false) OR lower(replace(digits, ' ', '')) = lower(replace((n_chars % 20)::VARCHAR, ' ', '')) AS same,
coalesce(try_cast(said AS DOUBLE) IS NOT NULL, false) AS numeric FROM x""")
def numeric_answer_equal(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.regexp_extract("source", "([0-9]+)$", 1).alias("digits"), F.expr("substr(source, 1, 3 + doc_id % 4)").alias("said"))
    number, gold = F.expr("try_cast(digits AS double)"), F.col("n_chars") % 20
    squeezed = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    same = F.coalesce(F.abs(number - gold) < 1e-6, F.lit(False)) | (squeezed(F.col("digits")) == squeezed(gold.cast("string")))
    return docs.select("doc_id", number.alias("number"), same.alias("same"), F.expr("try_cast(said AS double) IS NOT NULL").alias("numeric"))


# Pairs of formulas that are the same where d is 0: products, quotients, roots and fractions.
FORMULAS = [
    (r"concat(a, '(x+', b, ')')", r"concat(a, 'x+', a * b + d)"),
    (r"concat('\\frac{x^2-', b * b, '}{x-', b, '}')", r"concat('x+', b + d)"),
    (r"concat('\\sqrt{', a * a * b, '}y')", r"concat(a + d, '\\sqrt{', b, '}y')"),
    (r"concat('\\dfrac{', a, '}{', b, '}')", r"concat(a + d, '/', b)"),
    (r"concat('(x+', a, ')^2')", r"concat('x^2+', 2 * a, 'x+', a * a + d)"),
    (r"concat('z\\sqrt[3]{', a * a * a * b, '}')", r"concat(a + d, '\\sqrt[3]{', b, '} z')"),
    (r"concat('\\frac{', a, 'w}{\\sqrt{', b, '}}')", r"concat('\\frac{', a + d, '\\sqrt{', b, '}}{', b, '}w')"),
    (r"concat('2^{', 60 + a, '}+', 1 + d)", r"concat('1+2^{', 60 + a, '}')"),
]
PAIRED = " ".join(f"WHEN {k} THEN {{{k}}}" for k in range(len(FORMULAS)))


@query(f"""WITH n AS (SELECT p_partkey, p_partkey % {len(FORMULAS)} AS kind, CAST(p_size AS BIGINT) AS a, p_partkey % 7 + 2 AS b, (p_partkey // {len(FORMULAS)}) % 2 AS d FROM part)
SELECT p_partkey, CASE kind {PAIRED.format(*(x.replace(chr(92) * 2, chr(92)) for x, _ in FORMULAS))} END AS said, CASE kind {PAIRED.format(*(y.replace(chr(92) * 2, chr(92)) for _, y in FORMULAS))} END AS gold, d = 0 AS same FROM n""")
def same_formulas(spark, sf_dir):
    """Answers that are formulas of symbols, roots and large numbers, compared exactly."""
    numbers = read(spark, sf_dir, "part").selectExpr("p_partkey", f"p_partkey % {len(FORMULAS)} AS kind", "CAST(p_size AS LONG) AS a", "p_partkey % 7 + 2 AS b", f"(p_partkey div {len(FORMULAS)}) % 2 AS d")
    pairs = numbers.selectExpr("p_partkey", *(f"CASE kind {PAIRED.format(*(pair[k] for pair in FORMULAS))} END AS {name}" for k, name in enumerate(("said", "gold"))))
    return M.with_same(pairs, "said", "gold", "same")


@query(r"""SELECT page_id, trim(list_extract(string_split(html, '</p>'), -1)) AS answer, length(replace(replace(html, '```json', ''), '```', '')) AS n_plain,
trim(list_extract(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), -1)) AS last_item, left(coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'item'), 40) AS file FROM pages""")
def strip_reasoning_fences(spark, sf_dir):
    html = F.col("html")
    return read(spark, sf_dir, "pages").select(
        "page_id", T.after_last(html, "</p>").alias("answer"), F.length(T.without_fences(html)).cast("long").alias("n_plain"), T.last_block(html, "<li>", "</li>").alias("last_item"), T.file_name(F.col("url")).alias("file")
    )


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k, coalesce(json_valid(props), false) AS parsed FROM events""")
def json_props_parse(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", T.json_or_null(F.col("props"), "k int")["k"].alias("k"), F.expr("try_parse_json(props) IS NOT NULL").alias("parsed"))


# ---- Geometry


def resize_sql(factor: int, least: int, most: int, floor_side: bool) -> str:
    top = (lambda x: f"greatest({factor}.0, {x})") if floor_side else (lambda x: x)
    near = lambda s: top(f"round_even({s} / {factor}, 0) * {factor}")
    side = lambda s: f"CASE WHEN hr * wr > {most} THEN {top(f'floor({s} / sqrt(h * w / {most}) / {factor}) * {factor}')} WHEN hr * wr < {least} THEN ceil({s} * sqrt({least} / (h * w)) / {factor}) * {factor} ELSE {s}r END"
    return f"""x AS (SELECT p_partkey, (p_size * 37)::DOUBLE AS h, floor(p_retailprice)::DOUBLE AS w FROM part),
y AS (SELECT *, {near('h')} AS hr, {near('w')} AS wr FROM x),
z AS (SELECT p_partkey, CASE WHEN greatest(h, w) / least(h, w) <= 200 THEN ({side('h')})::BIGINT END AS height, CASE WHEN greatest(h, w) / least(h, w) <= 200 THEN ({side('w')})::BIGINT END AS width FROM y)"""


@query(f"""SELECT a.p_partkey, a.height, a.width, b.height AS loose_height, b.width AS loose_width FROM (WITH {resize_sql(28, 3136, 401408, True)} SELECT * FROM z) a
JOIN (WITH {resize_sql(32, 65536, 1048576, False)} SELECT * FROM z) b USING (p_partkey)""")
def smart_resize_grid(spark, sf_dir):
    h, w = F.col("p_size") * 37, F.floor("p_retailprice")
    a, b = G.resized(h, w, 28, 3136, 401408), G.resized(h, w, 32, 65536, 1048576, floor_side=False)
    out = read(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    return out.select("p_partkey", "a.height", "a.width", F.col("b.height").alias("loose_height"), F.col("b.width").alias("loose_width"))


@query("""WITH x AS (SELECT DISTINCT l_quantity::BIGINT * 10 AS total, (l_linenumber + 5)::DOUBLE AS fps, l_discount * 100 AS s, l_tax * 200 + l_discount * 100 AS e FROM lineitem),
y AS (SELECT *, least(least(greatest(total / fps * 2.0, 4.0), floor(least(768, total) / 2) * 2), total) AS want, ceil(greatest(0.0, least(s, total / fps)) * fps) AS a, least(floor(greatest(0.0, least(e, total / fps)) * fps), total - 1) AS b FROM x),
n AS (SELECT *, floor(want / 2) * 2 AS k FROM y)
SELECT total, fps, s AS from_s, e AS to_s, CASE WHEN k >= 2 AND k <= total THEN k::BIGINT END AS n_frames, CASE WHEN a < b THEN a::BIGINT END AS first, CASE WHEN a < b THEN b::BIGINT END AS last,
greatest(least(602112.0, 90316800.0 / greatest(k, 2) * 2), 105369.0)::BIGINT AS max_pixels FROM n""")
def frame_budget(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity").cast("long") * 10).alias("total"), (F.col("l_linenumber") + 5).cast("double").alias("fps"), (F.col("l_discount") * 100).alias("from_s"), (F.col("l_tax") * 200 + F.col("l_discount") * 100).alias("to_s")
    ).distinct()
    n = G.frame_count(F.col("total"), F.col("fps"), 2.0, 4, 768)
    span = G.frame_range(F.col("from_s"), F.col("to_s"), F.col("total"), F.col("fps"))
    budget = F.greatest(F.least(F.lit(602112.0), F.lit(90316800.0) / F.greatest(F.coalesce(n, F.lit(2)), F.lit(2)) * 2), F.lit(105369.0)).cast("long")
    return rows.select("total", "fps", "from_s", "to_s", n.alias("n_frames"), span["first"].alias("first"), span["last"].alias("last"), budget.alias("max_pixels"))


@query("""SELECT p_partkey, list_transform(range(0, p_size % 7 + 1), lambda k: round_even(p_size + k * ((p_size * 3 - p_size) / greatest(1, p_size % 7)), 0)::BIGINT)::VARCHAR AS frames,
len(list_distinct(list_transform(range(0, p_size % 7 + 1), lambda k: round_even(p_size + k * ((p_size * 3 - p_size) / greatest(1, p_size % 7)), 0)::BIGINT))) AS n_distinct FROM part""")
def linspace_frames(spark, sf_dir):
    size = F.col("p_size")
    found = G.even_frames(size, size * 3, size % 7 + 1)
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(F.transform(found, lambda x: x.cast("string")), ", "), F.lit("]")).alias("frames"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct"))


@query("""WITH x AS (SELECT DISTINCT l_quantity AS x1, l_linenumber * 7.5 AS y1, l_quantity * 2 + 3.25 AS x2, l_linenumber * 20.0 + l_quantity AS y2 FROM lineitem)
SELECT x1, y1, x2, y2, greatest(0, least(1000, round_even(x1 / 101 * 1000, 0)::INT)) AS tx1, greatest(0, least(1000, round_even(y1 / 97 * 1000, 0)::INT)) AS ty1, greatest(0, least(1000, round_even(x2 / 101 * 1000, 0)::INT)) AS tx2, greatest(0, least(1000, round_even(y2 / 97 * 1000, 0)::INT)) AS ty2,
greatest(0, least(55, round_even(x2 * (56 / 101), 0)::INT)) AS rx2, greatest(0, least(83, round_even(y2 * (84 / 97), 0)::INT)) AS ry2, round(x2 - x1, 4) AS w, round(y2 - y1, 4) AS h FROM x""")
def bbox_convert(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    rows = read(spark, sf_dir, "lineitem").select(q.alias("x1"), (n * 7.5).alias("y1"), (q * 2 + 3.25).alias("x2"), (n * 20.0 + q).alias("y2")).distinct()
    box = F.array("x1", "y1", "x2", "y2")
    t = G.box_to_thousandths(box, F.lit(97.0), F.lit(101.0))
    r = G.box_to_resized(box, F.lit(97.0), F.lit(101.0), F.lit(84.0), F.lit(56.0))
    s = G.corners_to_sides(box)
    return rows.select("x1", "y1", "x2", "y2", t[0].alias("tx1"), t[1].alias("ty1"), t[2].alias("tx2"), t[3].alias("ty2"), r[2].alias("rx2"), r[3].alias("ry2"), F.round(s[2], 4).alias("w"), F.round(s[3], 4).alias("h"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT *, sqrt(v[1]*v[1]+v[2]*v[2]+v[3]*v[3]+v[4]*v[4]) AS a, sqrt(v[5]*v[5]+v[6]*v[6]+v[7]*v[7]+v[8]*v[8]) AS b FROM e)
SELECT vec_id, round(2 * acos(least(1.0, abs(v[1]/a*v[5]/b + v[2]/a*v[6]/b + v[3]/a*v[7]/b + v[4]/a*v[8]/b))), 6) AS angle, round(sqrt((v[1]-v[5])*(v[1]-v[5])+(v[2]-v[6])*(v[2]-v[6])+(v[3]-v[7])*(v[3]-v[7])), 6) AS moved FROM n""")
def quaternion_geodesic(spark, sf_dir):
    slots = [F.col("embedding")[k].cast("double") for k in range(8)]
    p, q = G.unit_quaternion(slots[:4], False), G.unit_quaternion(slots[4:], True)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(G.turn(p, q), 6).alias("angle"), F.round(G.distance(slots[:3], slots[4:7]), 6).alias("moved"))


@query("""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE + 1 AS z, abs(embedding[4]::DOUBLE) AS sx, abs(embedding[5]::DOUBLE) AS sy, abs(embedding[6]::DOUBLE) AS sz, radians(embedding[7]::DOUBLE * 90) AS p, radians(embedding[8]::DOUBLE * 90) AS w, radians(embedding[9]::DOUBLE * 90) AS r FROM embeddings),
c AS (SELECT e.*, i.i, j.i AS j, k.i AS k FROM e, (VALUES (-0.5), (0.5)) i(i), (VALUES (-0.5), (0.5)) j(i), (VALUES (-0.5), (0.5)) k(i)),
t1 AS (SELECT *, sx * i AS a0, sy * j * cos(p) - sz * k * sin(p) AS b1, sy * j * sin(p) + sz * k * cos(p) AS c1 FROM c),
t2 AS (SELECT *, a0 * cos(w) + c1 * sin(w) AS a2, c1 * cos(w) - a0 * sin(w) AS c2 FROM t1),
t3 AS (SELECT vec_id, x + a2 * cos(r) - b1 * sin(r) AS px, y + a2 * sin(r) + b1 * cos(r) AS py, z + c2 AS pz FROM t2)
SELECT vec_id, count(*) FILTER (pz > 0) AS n_seen, round(min(px / pz * 500 + 320) FILTER (pz > 0), 3) AS u_min, round(max(py / pz * 500 + 240) FILTER (pz > 0), 3) AS v_max FROM t3 GROUP BY vec_id""")
def project_3d(spark, sf_dir):
    s = [F.col("embedding")[k].cast("double") for k in range(9)]
    corners = G.box_corners(s[0], s[1], s[2] + 1, F.abs(s[3]), F.abs(s[4]), F.abs(s[5]), s[6] * 90, s[7] * 90, s[8] * 90)
    seen = F.filter(F.array(*(G.pinhole(c, 500, 500, 320, 240) for c in corners)), lambda p: p.isNotNull())
    out = read(spark, sf_dir, "embeddings").select("vec_id", seen.alias("seen"))
    return out.select("vec_id", F.size("seen").cast("long").alias("n_seen"), F.round(F.array_min(F.transform("seen", lambda p: p["u"])), 3).alias("u_min"), F.round(F.array_max(F.transform("seen", lambda p: p["v"])), 3).alias("v_max"))


# ---- Joins


@query("""SELECT d.doc_id, CASE WHEN d.n_chars <= 200 AND t.doc_id IS NOT NULL THEN t.doc_id ELSE d.doc_id END AS resolved, CASE WHEN d.n_chars <= 200 AND t.doc_id IS NOT NULL THEN t.n_chars ELSE d.n_chars END AS n_chars
FROM documents d LEFT JOIN documents t ON d.n_chars <= 200 AND t.doc_id = d.n_chars AND t.n_chars > 200""")
def self_ref_resolve(spark, sf_dir):
    """A short row points to another, whose number is its length; a pointer is followed once, to a long row."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    targets = docs.filter("n_chars > 200").select(F.col("doc_id").alias("t_id"), F.col("n_chars").alias("t_chars"))
    pointer = F.when(F.col("n_chars") <= 200, F.col("n_chars"))
    out = docs.withColumn("pointer", pointer).join(targets, F.col("pointer") == F.col("t_id"), "left")
    return out.select("doc_id", F.coalesce("t_id", "doc_id").alias("resolved"), F.coalesce("t_chars", "n_chars").alias("n_chars"))


@query(f"""WITH {FR.replace('fr AS', 'base AS')}, fr AS (SELECT * FROM base), s AS (SELECT ep, f // 5 AS idx, min(f) AS start, max(f) - 1 AS "end" FROM fr GROUP BY ep, f // 5)
SELECT fr.ep, fr.f, min(s.idx) FILTER (fr.f BETWEEN s.start AND s."end") AS idx, coalesce(arg_max(s.idx, s."end") FILTER (s."end" < fr.f), 0) AS before FROM fr LEFT JOIN s USING (ep) GROUP BY fr.ep, fr.f""")
def interval_frame_lookup(spark, sf_dir):
    rows = trajectories(spark, sf_dir)
    spans = rows.groupBy("ep", F.floor(F.col("f") / 5).alias("idx")).agg(F.min("f").alias("start"), (F.max("f") - 1).alias("end"))
    return W.span_at(rows.select("ep", "f"), spans)


@query("""WITH c AS (SELECT user_id, event_id, ts AS a, ts + INTERVAL 6 HOUR AS b FROM events WHERE event_type = 'purchase'),
k AS (SELECT * FROM c WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.user_id AND e.event_type = 'view' AND e.ts > c.a AND e.ts < c.b))
SELECT user_id, count(*) AS n_cues, string_agg(event_id::VARCHAR, ' ' ORDER BY a, event_id) AS cues FROM k GROUP BY user_id""")
def subtitle_range_semi(spark, sf_dir):
    """Cues with some frame strictly inside, put together in order of time.

    A cue as long as a cell of time reaches from its cell into the next one, so the first and last frame of each cell tell enough.
    """
    events = read(spark, sf_dir, "events").withColumn("cell", F.datediff("ts", F.lit("1970-01-01")) * 4 + F.floor(F.hour("ts") / 6))
    cues = events.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("b"), "cell")
    cells = events.filter("event_type = 'view'").groupBy("user_id", "cell").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    parts = cues.withColumn("at", F.col("cell")).withColumn("cell", F.explode(F.array("cell", F.col("cell") + 1)))
    met = parts.join(cells, ["user_id", "cell"]).filter(F.when(F.col("cell") == F.col("at"), F.col("high") > F.col("a")).otherwise(F.col("low") < F.col("b")))
    kept = met.select("user_id", "event_id", "a").distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("a", "event_id"))), lambda c: c["event_id"].cast("string"))
    return kept.groupBy("user_id").agg(F.count("*").alias("n_cues"), F.array_join(ordered, " ").alias("cues"))


@query("""SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, g.quality AS gold, p.pred AS pred, CASE WHEN g.doc_id IS NULL THEN 'pred' WHEN p.doc_id IS NULL THEN 'gold' ELSE 'both' END AS side
FROM labels g FULL OUTER JOIN (SELECT doc_id, n_chars % 2 AS pred FROM documents) p ON g.doc_id = p.doc_id""")
def full_outer_merge(spark, sf_dir):
    gold = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("gold"), F.lit(True).alias("g"))
    pred = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).alias("pred"), F.lit(True).alias("p"))
    side = F.when(F.col("g").isNull(), "pred").when(F.col("p").isNull(), "gold").otherwise("both")
    return gold.join(pred, "doc_id", "full_outer").select("doc_id", "gold", "pred", side.alias("side"))


@query("SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.toxic = 1)")
def anti_exclude(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def semi_exists(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query(f"WITH {FR} SELECT a.ep, a.f AS f_a, b.f AS f_b, a.kind AS kind_a, b.kind AS kind_b FROM fr a JOIN fr b ON a.ep = b.ep AND a.kind < b.kind AND abs(a.f - b.f) <= 3")
def band_pairs(spark, sf_dir):
    """Events of different kinds at most 3 frames apart: frames meet by cells of 4, each in its own and the neighbouring cells."""
    rows = trajectories(spark, sf_dir).select("ep", "f", "kind", F.floor(F.col("f") / 4).alias("cell"))
    a = rows.select("ep", F.col("f").alias("f_a"), F.col("kind").alias("kind_a"), "cell")
    b = rows.select("ep", F.col("f").alias("f_b"), F.col("kind").alias("kind_b"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    near = a.join(b, ["ep", "cell"]).filter((F.col("kind_a") < F.col("kind_b")) & (F.abs(F.col("f_a") - F.col("f_b")) <= 3))
    return near.select("ep", "f_a", "f_b", "kind_a", "kind_b")


@query(f"WITH {FR} SELECT a.ep, a.f, min(b.f) AS next_f, arg_min(b.v, b.f) AS next_v FROM fr a LEFT JOIN fr b ON a.ep = b.ep AND b.kind = 'purchase' AND b.f > a.f GROUP BY a.ep, a.f")
def asof_next_event(spark, sf_dir):
    return W.next_of(trajectories(spark, sf_dir), "purchase")


@query("""WITH l AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM conversations),
r AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations WHERE turn > 0)
SELECT l.conv_id, l.role, l.turn, r.turn AS match, r.turn IS NULL AS missing FROM l LEFT JOIN r USING (conv_id, role, rn)""")
def manifest_bag_match(spark, sf_dir):
    """Bags of rows matched one to one: the k-th of a key on one side with the k-th on the other."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "role", "turn")
    key = Window.partitionBy("conv_id", "role")
    left = rows.withColumn("rn", F.row_number().over(key.orderBy("turn")))
    right = rows.filter("turn > 0").withColumn("rn", F.row_number().over(key.orderBy(F.desc("turn")))).withColumnRenamed("turn", "match")
    return left.join(right, ["conv_id", "role", "rn"], "left").select("conv_id", "role", "turn", "match", F.col("match").isNull().alias("missing"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '<(a|p|li)[ >]', 1) AS tags FROM pages), t AS (SELECT page_id, unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS pos FROM p)
SELECT page_id, pos, tag, row_number() OVER (PARTITION BY page_id, tag ORDER BY pos) AS nth FROM t""")
def placeholder_binding(spark, sf_dir):
    """Each mark of a text with its number among marks of its kind: the key by which it takes its medium."""
    tags = F.regexp_extract_all("html", F.lit("<(a|p|li)[ >]"), F.lit(1))
    marks = read(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("pos", "tag"))
    nth = F.row_number().over(Window.partitionBy("page_id", "tag").orderBy("pos"))
    return marks.select("page_id", (F.col("pos") + 1).alias("pos"), "tag", nth.alias("nth"))


# ---- Sequences


@query(f"WITH {ST} SELECT ep, f, round(d, 6) AS d, round(abs(d), 6) AS moved, coalesce(abs(d) > 5, false) AS moving FROM st")
def step_motion(spark, sf_dir):
    rows = W.steps(trajectories(spark, sf_dir))
    return rows.select("ep", "f", F.round("d", 6).alias("d"), F.round(F.abs("d"), 6).alias("moved"), F.coalesce(F.abs("d") > 5, F.lit(False)).alias("moving"))


@query(f"WITH {PR} SELECT ep, f, round(path, 4) AS path, round(progress, 6) AS progress FROM pr")
def cumulative_progress(spark, sf_dir):
    return W.running_progress(trajectories(spark, sf_dir), 5.0).select("ep", "f", F.round("path", 4).alias("path"), F.round("progress", 6).alias("progress"))


@query(f"WITH {FR} SELECT ep, f, v, coalesce(lead(v) OVER (PARTITION BY ep ORDER BY f), v) AS action FROM fr")
def lead_action(spark, sf_dir):
    return trajectories(spark, sf_dir).select("ep", "f", "v", F.coalesce(F.lead("v").over(W.frame_order()), "v").alias("action"))


@query(f"""WITH {PR}, b AS (SELECT ep, max(f) FILTER (progress + 1e-9 < 0.9) AS bad, max(f) AS last FROM pr GROUP BY ep)
SELECT ep, CASE WHEN last - coalesce(bad, -1) > 0 THEN coalesce(bad, -1) + 1 ELSE last END AS first, last - coalesce(bad, -1) AS n FROM b""")
def trailing_done_run(spark, sf_dir):
    return W.trailing_run(W.running_progress(trajectories(spark, sf_dir), 5.0), F.col("progress") + 1e-9, 0.9)


GE = ST + """, sg AS (SELECT *, CASE WHEN d IS NULL OR abs(d) <= 0.5 THEN 0 WHEN d > 0 THEN 1 ELSE -1 END AS sgn FROM st),
nw AS (SELECT *, (sgn <> coalesce(lag(sgn) OVER (PARTITION BY ep ORDER BY f), 9))::INT AS new FROM sg), rn AS (SELECT *, sum(new) OVER (PARTITION BY ep ORDER BY f) AS run FROM nw)"""


MR = GE + """, ev AS (SELECT ep, min(f) - 1 AS start, max(f) AS "end", floor((min(f) - 1 + max(f)) / 2)::BIGINT AS mid, round(sum(d), 4) AS change, CASE WHEN sgn > 0 THEN 'open' ELSE 'close' END AS kind
FROM rn WHERE sgn <> 0 GROUP BY ep, run, sgn HAVING abs(sum(d)) >= 10)"""


@query(f"WITH {MR} SELECT * FROM ev")
def gripper_events(spark, sf_dir):
    return W.monotone_runs(trajectories(spark, sf_dir), 0.5, 10.0)


@query(f"""WITH RECURSIVE {MR}, nb AS (SELECT ev.*, row_number() OVER (PARTITION BY ep ORDER BY mid, start) AS rn FROM ev),
wk(ep, rn, kept, last) AS (SELECT ep, rn, true, mid FROM nb WHERE rn = 1 UNION ALL SELECT nb.ep, nb.rn, nb.mid - wk.last >= 3, CASE WHEN nb.mid - wk.last >= 3 THEN nb.mid ELSE wk.last END FROM wk JOIN nb ON nb.ep = wk.ep AND nb.rn = wk.rn + 1)
SELECT ep, start, "end", mid, change, kind FROM nb JOIN wk USING (ep, rn) WHERE kept""")
def gripper_events_min_gap(spark, sf_dir):
    return W.spaced(W.monotone_runs(trajectories(spark, sf_dir), 0.5, 10.0), 3)


@query(f"""WITH {ST}, m AS (SELECT *, coalesce(abs(d) > 5, false)::INT AS m FROM st), w AS (SELECT *, min(m) OVER q AS lo, count(*) OVER q AS c FROM m WINDOW q AS (PARTITION BY ep ORDER BY f ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT ep, min(f) FILTER (lo = 1 AND c = 3) AS start FROM w GROUP BY ep""")
def sustained_motion_start(spark, sf_dir):
    return W.first_sustained(trajectories(spark, sf_dir), F.abs("d") > 5, 3)


@query(f'WITH {SP} SELECT ep, start, "end", n FROM seg')
def motion_segments(spark, sf_dir):
    return W.islands(trajectories(spark, sf_dir), F.col("v") > 15, 2)


def spans(spark, sf_dir):
    rows = trajectories(spark, sf_dir)
    return W.filled(W.islands(rows, F.col("v") > 15, 2), rows.groupBy("ep").agg(F.max("f").alias("last")))


@query(f'WITH {FI} SELECT ep, idx, start, "end" FROM fi')
def gap_fill_spans(spark, sf_dir):
    return spans(spark, sf_dir)


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations")
def carry_forward_context(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(order).alias("context"))


@query(f"WITH {FR}, m AS (SELECT ep, f, unnest(range(4)) AS k FROM fr), j AS (SELECT m.ep, m.f, k, x.v FROM m JOIN fr x ON x.ep = m.ep AND x.f = greatest(0, m.f - (3 - k) * 2)) SELECT ep, f, round(sum(v), 4) AS total, count(*) AS n FROM j GROUP BY ep, f")
def memory_frames(spark, sf_dir):
    rows = trajectories(spark, sf_dir)
    wanted = rows.select("ep", "f", F.explode(W.memory_frames(4, 2)).alias("m"))
    held = rows.select("ep", F.col("f").alias("m"), "v")
    return wanted.join(held, ["ep", "m"]).groupBy("ep", "f").agg(F.round(F.sum("v"), 4).alias("total"), F.count("*").alias("n"))


@query(f"""WITH {PR}, b AS (SELECT ep, f, progress, least(9, floor(progress / 0.1))::INT AS bucket FROM pr WHERE progress < 1),
r AS (SELECT *, row_number() OVER (PARTITION BY ep, bucket ORDER BY round(abs(progress - (bucket + 0.5::DOUBLE) * 0.1::DOUBLE), 9), f DESC) AS rn FROM b) SELECT ep, bucket, f FROM r WHERE rn = 1""")
def progress_bucket_pick(spark, sf_dir):
    return W.bucket_pick(W.running_progress(trajectories(spark, sf_dir), 5.0), 0.1)


@query("""WITH l AS (SELECT conv_id, list(role ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn, array_to_string(roles[:least(c.turn + (length(c.text) > 300)::INT, n - 1)], ',') AS done, array_to_string(roles[least(c.turn + (length(c.text) > 300)::INT, n - 1) + 1:], ',') AS ahead FROM conversations c JOIN l USING (conv_id)""")
def plan_start_prefix_suffix(spark, sf_dir):
    """What is done and what lies ahead from each step on; a step that is done already starts the plan one later."""
    rows = read(spark, sf_dir, "conversations")
    whole = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"]).alias("roles"))
    start = F.least(F.col("turn") + (F.length("text") > 300).cast("int"), F.size("roles") - 1).cast("int")
    out = rows.select("conv_id", "turn", "text").join(whole, "conv_id").withColumn("at", start)
    return out.select("conv_id", "turn", F.array_join(F.slice("roles", 1, F.col("at")), ",").alias("done"), F.array_join(F.slice("roles", F.col("at") + 1, F.size("roles")), ",").alias("ahead"))


# ---- Quality rules and choices

@query("""WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem)
SELECT l_returnflag, rn, l_orderkey, l_linenumber, l_extendedprice FROM r WHERE rn <= 20""")
def topk_errors_per_group(spark, sf_dir):
    """The best 20 of each group; the rank limit runs before the exchange too."""
    order = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.withColumn("rn", F.row_number().over(order)).filter("rn <= 20")


@query("""WITH r AS (SELECT p_brand, p_name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY NOT contains(p_name, 'red'), p_name, p_partkey) AS rn FROM part) SELECT p_brand, p_name, p_partkey FROM r WHERE rn = 1""")
def one_per_group_prefer(spark, sf_dir):
    best = F.min(F.struct((~F.contains("p_name", F.lit("red"))).alias("other"), "p_name", "p_partkey"))
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(best.alias("b")).select("p_brand", "b.p_name", "b.p_partkey")


@query("""WITH g AS (SELECT c_nationkey, min(md5(c_nationkey::VARCHAR)) AS h FROM customer GROUP BY c_nationkey), r AS (SELECT c_nationkey, row_number() OVER (ORDER BY h) AS rn, count(*) OVER () AS n FROM g)
SELECT c_custkey, CASE WHEN rn <= least(greatest(round_even(n * 0.2, 0), 1), n - 1) THEN 'test' ELSE 'train' END AS split FROM customer JOIN r USING (c_nationkey)""")
def group_split(spark, sf_dir):
    """Whole groups go to test or train: the first fifth of the groups in order of a hash, one at least."""
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    groups = customers.select("c_nationkey").distinct()
    tests = first_by_hash(groups, [], F.md5(F.col("c_nationkey").cast("string")), "c_nationkey", lambda n: F.least(F.greatest(F.bround(n * 0.2), F.lit(1)), n - 1))
    parts = customers.join(tests.withColumn("test", F.lit(True)), "c_nationkey", "left")
    return parts.select("c_custkey", F.when(F.col("test"), "test").otherwise("train").alias("split"))


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang FROM r WHERE rn <= floor(n * 0.25)""")
def exact_fraction(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return first_by_hash(rows, ["lang"], F.md5(F.col("doc_id").cast("string")), "doc_id", lambda n: F.floor(n * 0.25))


# ---- Preparing training items

WC = r"len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> ''))"


@query(f"SELECT conv_id, 21 + sum({WC})::BIGINT AS n_tokens, count(*) FILTER (role = 'assistant') AS n_answers, CASE WHEN bool_or(contains(text, '.')) THEN 1 ELSE -1 END * sum({WC})::BIGINT AS signed_length FROM conversations GROUP BY conv_id")
def token_lengths(spark, sf_dir):
    words = F.size(T.tokens(F.col("text")))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "role", words.alias("n"), F.contains("text", F.lit(".")).alias("dot"))
    return rows.groupBy("conv_id").agg((F.sum("n") + 21).alias("n_tokens"), F.count_if(F.col("role") == "assistant").alias("n_answers"), (F.when(F.bool_or("dot"), 1).otherwise(-1) * F.sum("n")).alias("signed_length"))


@query(f"SELECT conv_id, turn, coalesce(sum({WC}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, sum({WC}) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS last FROM conversations")
def cu_seqlens(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.tokens(F.col("text"))).cast("long").alias("n"))
    return rows.select("conv_id", "turn", (F.sum("n").over(order) - F.col("n")).alias("first"), F.sum("n").over(order).alias("last"))


@query(rf"""WITH c AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '') AS ws FROM conversations)
SELECT conv_id, sum(len(ws))::BIGINT AS n, coalesce(sum(len(ws)) FILTER (role = 'assistant'), 0)::BIGINT AS n_labelled, md5(string_agg(CASE WHEN role = 'assistant' THEN array_to_string(ws, ' ') ELSE array_to_string(list_transform(ws, lambda w: '-100'), ' ') END, ' ' ORDER BY turn)) AS labels_md5 FROM c GROUP BY conv_id""")
def label_mask(spark, sf_dir):
    """Labels of a conversation: the words of answers, and -100 for all others."""
    words = T.tokens(F.col("text"))
    label = F.when(F.col("role") == "assistant", words).otherwise(F.transform(words, lambda w: F.lit("-100")))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.size(words).cast("long").alias("n"), F.array_join(label, " ").alias("labels"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "labels"))), lambda x: x["labels"]), " ")
    return rows.groupBy("conv_id").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.col("n"))), F.lit(0)).cast("long").alias("n_labelled"), F.md5(line).alias("labels_md5"))


@query()
def pack_bins(spark, sf_dir):
    """First-fit packing of conversations into bins of at most 4096 tokens, within shards of 4096 items; a longer item is a bin of its own."""
    lengths = token_lengths(spark, sf_dir).select("conv_id", "n_tokens", F.floor(F.col("conv_id") / 4096).alias("shard"))
    return prep.packed(lengths, "conv_id", "n_tokens", "shard", 4096)


# ---- Text


@query(r"""SELECT p_partkey, CASE WHEN contains(x, '-robot-') THEN string_split(x, '-robot-')[1] ELSE string_split(x, '-')[1] END AS slug FROM (SELECT p_partkey, replace(p_name, ' ', CASE WHEN p_size % 2 = 0 THEN '-robot-' ELSE '-' END) AS x FROM part)""")
def task_slug_variants(spark, sf_dir):
    name = F.replace("p_name", F.lit(" "), F.when(F.col("p_size") % 2 == 0, F.lit("-robot-")).otherwise(F.lit("-")))
    return read(spark, sf_dir, "part").select("p_partkey", name.alias("x")).select("p_partkey", T.task_slug(F.col("x")).alias("slug"))


CASES = ["Move the left arm up", "Close the gripper of the right arm", "open the grippers of both arms", "nothing here", "release it", "Lift both objects with the left arm", "partially close it"]
CASES_SQL = ", ".join(f"'{c}'" for c in CASES)


@query(rf"""WITH x AS (SELECT p_partkey, [{CASES_SQL}][p_size % 7 + 1] AS t FROM part), y AS (SELECT *, regexp_matches(lower(t), '\b(?:both arms|dual arms|both grippers|grippers of both arms|both objects)\b') AS b FROM x)
SELECT p_partkey, regexp_matches(lower(t), '\bleft arm\b') OR b AS l, regexp_matches(lower(t), '\bright arm\b') OR b AS r, CASE WHEN regexp_matches(lower(t), '\bopen the gripper|open the grippers|release\b') THEN 'open' WHEN regexp_matches(lower(t), '\bclose the gripper|close the grippers|partially close\b') THEN 'close'
WHEN regexp_matches(lower(t), '\b(move|lift|place|return|retract|pull|scan|rotate|shake|press|operate|click|hit|pour|open the .*door|open the .*lid)\b') THEN 'move' ELSE 'unknown' END AS kind, replace(replace(replace(t, 'left', chr(1)), 'right', 'left'), chr(1), 'right') AS swapped FROM y""")
def arm_text_flags(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, CASES)), F.col("p_size") % 7 + 1)
    rows = read(spark, sf_dir, "part").select("p_partkey", said.alias("t"))
    left, right = T.arm_flags(F.col("t"))
    return rows.select("p_partkey", left.alias("l"), right.alias("r"), T.action_kind(F.col("t")).alias("kind"), T.swap_sides(F.col("t")).alias("swapped"))


@query(rf"""WITH x AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+'), lambda w: w <> '') AS ws FROM benchmark), y AS (SELECT p.item_id, p.ws AS a, q.ws AS b FROM x p JOIN x q ON q.item_id = p.item_id + 1),
z AS (SELECT item_id, a, b, {edits_sql('a', 'b')} AS edits, {bleu_sql('a', 'b')} AS bleu FROM y) SELECT item_id, edits, round(edits / greatest(1, len(a)), 6) AS share, round(bleu, 6) AS bleu, a = b AS same FROM z""")
def edit_distance_tokens(spark, sf_dir):
    """Each benchmark text against the next one: token edit distance, its share, BLEU and equality."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.lower("text")).alias("a"))
    both = rows.join(rows.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    far = T.token_distance(F.col("a"), F.col("b"))
    return both.select("item_id", far.alias("edits"), F.round(far / F.greatest(F.lit(1), F.size("a")), 6).alias("share"), F.round(T.bleu(F.col("a"), F.col("b")), 6).alias("bleu"), (F.col("a") == F.col("b")).alias("same"))


# ---- Sets, summaries, detection


@query("""SELECT 'missing' AS side, doc_id AS key FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels WHERE toxic = 0) UNION ALL SELECT 'extra', page_id FROM (SELECT DISTINCT page_id FROM pages EXCEPT SELECT conv_id FROM conversations)""")
def registry_diff(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id")
    missing = docs.exceptAll(labels).select(F.lit("missing").alias("side"), F.col("doc_id").alias("key"))
    extra = read(spark, sf_dir, "pages").select("page_id").subtract(read(spark, sf_dir, "conversations").select("conv_id")).select(F.lit("extra").alias("side"), F.col("page_id").alias("key"))
    return missing.unionByName(extra)


@query("""SELECT 'signup' AS grp, user_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY user_id UNION ALL SELECT 'error', user_id, count(*) FROM events WHERE event_type = 'error' AND value > 10 GROUP BY user_id""")
def union_groups(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    part = lambda name, rows: rows.groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("grp"), "user_id", "n")
    return part("signup", events.filter("event_type = 'signup'")).unionByName(part("error", events.filter("event_type = 'error' AND value > 10")))


@query("""WITH o AS (SELECT event_type, list_sort(list(value)) AS vs FROM events GROUP BY event_type)
SELECT event_type, len(vs) AS n, round(list_avg(vs), 4) AS mean, round(list_median(vs), 4) AS median, vs[1] AS lowest, vs[-1] AS highest, vs[least(len(vs) - 1, floor(0.9 * len(vs))::BIGINT) + 1] AS p90, round(len(list_filter(vs, lambda x: x >= 20)) / len(vs), 6) AS reached_20 FROM o""")
def latency_summary(spark, sf_dir):
    """Mean, median, extremes, the value at place int(0.9 n) and a survival share.

    Values at places are found by histograms, so no task holds or sorts a group.
    """
    events = read(spark, sf_dir, "events").select("event_type", "value")
    sums = events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.round(F.avg((F.col("value") >= 20).cast("int")), 6).alias("reached_20")
    )
    n = F.col("n")
    at = values_at(events, "event_type", "value", {"below": F.floor((n - 1) / 2), "above": F.floor(n / 2), "p90": F.least(n - 1, F.floor(n * 0.9))})
    return sums.join(at, "event_type").withColumn("median", F.round((F.col("below") + F.col("above")) / 2, 4)).drop("below", "above")


@query()
def detection_ap(spark, sf_dir):
    """Boxes made from order lines: gold is one line's box, detections are shifted copies. AP by area and threshold, with its means."""
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("image"), (F.col("l_linenumber") % 3).cast("long").alias("category"), "l_quantity", "l_partkey", "l_discount", "l_tax")
    x, y = F.col("l_partkey") % 300, F.col("l_quantity") * 5
    box = lambda shift: F.array(*(c.cast("double") for c in (x + shift, y, x + shift + 40, y + 40)))
    truths = rows.select("image", "category", box(F.lit(0.0)).alias("box"))
    found = rows.select("image", "category", box(F.col("l_discount") * 200).alias("box"), F.lit(1.0).alias("score"))
    return S.mean_precision(S.average_precision(found, truths))


# ---- Two-armed trajectories, made from the events' values


def arm_frames(spark, sf_dir) -> DataFrame:
    """State vectors whose slots are simple functions of the signal."""
    v = F.col("v")
    turned = lambda angle: (F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(0.0))
    slots = [v / 100, v % 7 / 70, F.lit(0.0), *turned(v / 200), v % 10 / 10, v % 3 / 30, F.lit(0.0), v / 300, *turned(v % 5 / 20), v % 4 / 4]
    return trajectories(spark, sf_dir).select("ep", "f", F.array(*(s.cast("double") for s in slots)).alias("state"))


AF = FR + """, am AS (SELECT ep, f, v / 100 AS lx, v % 7 / 70 AS ly, v / 200 AS la, v % 10 / 10 AS lg, v % 3 / 30 AS rx, v / 300 AS rz, v % 5 / 20 AS ra, v % 4 / 4 AS rg FROM fr),
sp AS (SELECT ep, f // 10 AS idx, f // 10 * 10 AS start, least(f // 10 * 10 + 9, max(f) OVER (PARTITION BY ep)) AS "end", f FROM am),
ab AS (SELECT am.*, idx, start, "end" FROM am JOIN sp USING (ep, f)),
dl AS (SELECT ep, idx, start, "end", f, lg, rg, coalesce(sqrt((lx - lag(lx) OVER w) ** 2 + (ly - lag(ly) OVER w) ** 2), 0) AS lp, coalesce(sqrt((rx - lag(rx) OVER w) ** 2 + (rz - lag(rz) OVER w) ** 2), 0) AS rp,
coalesce(2 * acos(least(1.0, abs(cos(la - lag(la) OVER w)))), 0) AS lt, coalesce(2 * acos(least(1.0, abs(cos(ra - lag(ra) OVER w)))), 0) AS rt, coalesce(abs(lg - lag(lg) OVER w), 0) AS lgs, coalesce(abs(rg - lag(rg) OVER w), 0) AS rgs FROM ab WINDOW w AS (PARTITION BY ep, idx ORDER BY f))"""


def arm_spans(rows: DataFrame) -> DataFrame:
    """Spans of ten frames; the left arm acts in even ones, both in odd ones."""
    idx = F.floor(F.col("f") / 10)
    out = rows.groupBy("ep", idx.alias("idx")).agg(F.min("f").alias("start"), F.max("f").alias("end"))
    return out.select("ep", "idx", "start", "end", F.lit(True).alias("left"), (F.col("idx") % 2 == 1).alias("right"))


@query(f"""WITH {AF} SELECT ep, idx, round(sum(lp), 6) AS left_length, round(max(lp), 6) AS left_max_step, round(max(lg) - min(lg), 6) AS left_grip_range, round(arg_max(lg, f) - arg_min(lg, f), 6) AS left_grip_change, max(lg) >= 0.5 AND min(lg) < 0.5 AS left_crossed,
round(sum(rp), 6) AS right_length, round(max(rp), 6) AS right_max_step, round(max(rg) - min(rg), 6) AS right_grip_range, round(arg_max(rg, f) - arg_min(rg, f), 6) AS right_grip_change, max(rg) >= 0.5 AND min(rg) < 0.5 AS right_crossed FROM dl GROUP BY ep, idx""")
def arm_motion(spark, sf_dir):
    from quernel.operators import trajectory

    rows = arm_frames(spark, sf_dir)
    out = trajectory.arm_motion(rows, arm_spans(rows))
    return out.select("ep", "idx", *(F.round(c, 6).alias(c) if not c.endswith("crossed") else F.col(c) for c in out.columns[2:]))


@query(f"""WITH {AF}, ac AS (SELECT *, lp + CASE WHEN idx % 2 = 1 THEN rp ELSE 0 END AS p, lt + CASE WHEN idx % 2 = 1 THEN rt ELSE 0 END AS t, lgs + CASE WHEN idx % 2 = 1 THEN rgs ELSE 0 END AS g FROM dl),
cu AS (SELECT *, sum(p) OVER w AS cp, sum(t) OVER w AS ct, sum(g) OVER w AS cg, sum(p) OVER a AS tp, sum(t) OVER a AS tt, sum(g) OVER a AS tg FROM ac WINDOW w AS (PARTITION BY ep, idx ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY ep, idx)),
sh AS (SELECT *, list_filter([CASE WHEN tp >= 0.01 THEN least(1.0, cp / tp) END, CASE WHEN tt >= radians(2) THEN least(1.0, ct / tt) END, CASE WHEN tg >= 0.05 THEN least(1.0, cg / tg) END], lambda x: x IS NOT NULL) AS s FROM cu)
SELECT ep, idx, f, round(CASE WHEN f <= start THEN 0.0 WHEN f >= "end" THEN 1.0 WHEN len(s) > 0 THEN list_sum(s) / len(s) ELSE (f - start) / greatest(1, "end" - start) END, 5) AS progress FROM sh""")
def arm_progress(spark, sf_dir):
    from quernel.operators import trajectory

    rows = arm_frames(spark, sf_dir)
    return trajectory.progress(rows, arm_spans(rows)).select("ep", "idx", "f", F.round("progress", 5).alias("progress"))


@query(f"""WITH RECURSIVE {AF}, gs AS (SELECT ep, f, unnest(['left', 'right']) AS arm, unnest([lg - lag(lg) OVER w, rg - lag(rg) OVER w]) AS d FROM am WINDOW w AS (PARTITION BY ep ORDER BY f)),
gg AS (SELECT *, CASE WHEN abs(coalesce(d, 0)) <= 0.0001 THEN 0 WHEN d > 0 THEN 1 ELSE -1 END AS sgn FROM gs), gn AS (SELECT *, (sgn <> coalesce(lag(sgn) OVER (PARTITION BY ep, arm ORDER BY f), 9))::INT AS new FROM gg),
gr AS (SELECT *, sum(new) OVER (PARTITION BY ep, arm ORDER BY f) AS run FROM gn),
ge AS (SELECT ep, arm, min(f) - 1 AS start_frame, max(f) AS end_frame, floor((min(f) - 1 + max(f)) / 2)::BIGINT AS frame, CASE WHEN sgn > 0 THEN 'open' ELSE 'close' END AS kind FROM gr WHERE sgn <> 0 GROUP BY ep, arm, run, sgn HAVING abs(sum(d)) >= 0.25),
gb AS (SELECT ge.*, row_number() OVER (PARTITION BY ep, arm ORDER BY frame, start_frame) AS rn FROM ge),
wk(ep, arm, rn, kept, last) AS (SELECT ep, arm, rn, true, frame FROM gb WHERE rn = 1 UNION ALL SELECT gb.ep, gb.arm, gb.rn, gb.frame - wk.last >= 3, CASE WHEN gb.frame - wk.last >= 3 THEN gb.frame ELSE wk.last END FROM wk JOIN gb ON gb.ep = wk.ep AND gb.arm = wk.arm AND gb.rn = wk.rn + 1)
SELECT ep, arm, frame, kind, start_frame, end_frame FROM gb JOIN wk USING (ep, arm, rn) WHERE kept""")
def arm_events(spark, sf_dir):
    from quernel.operators import trajectory

    return trajectory.gripper_events(arm_frames(spark, sf_dir))


@query()
def arm_segments(spark, sf_dir):
    from quernel.operators import trajectory

    return trajectory.motion_segments(arm_frames(spark, sf_dir))


@query("""WITH u AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'data:image/png;base64,' || left(md5(url), 8) WHEN page_id % 5 = 1 THEN 'file://' || url WHEN page_id % 5 = 2 THEN regexp_extract(url, '[^/]*$') ELSE url END AS u FROM pages)
SELECT CASE WHEN regexp_matches(u, '^https?://') THEN 'web' WHEN starts_with(u, 'file://') THEN 'file' WHEN starts_with(u, 'data:image') THEN 'inline' ELSE 'path' END AS kind, count(*) AS n FROM u GROUP BY 1""")
def media_uri_kinds(spark, sf_dir):
    from quernel.sources import readers

    k = F.col("page_id") % 5
    uri = F.when(k == 0, F.concat(F.lit("data:image/png;base64,"), F.left(F.md5("url"), F.lit(8)))).when(k == 1, F.concat(F.lit("file://"), "url")).when(k == 2, F.regexp_extract("url", "[^/]*$", 0)).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").groupBy(readers.media_kind(uri).alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user' AND contains(text, 'la')) AS marks, count(*) FILTER (role = 'assistant') AS media, bool_or(role = 'assistant' AND contains(text, 'und')) AS stray FROM conversations GROUP BY conv_id)
SELECT count(*) AS n, count(*) FILTER (marks = media AND NOT stray) AS valid, count(*) FILTER (marks > media) AS missing, count(*) FILTER (marks < media) AS unused, count(*) FILTER (stray) AS strays FROM c""")
def validation_stats(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    held = lambda w: F.contains("text", F.lit(w))
    one = rows.groupBy("conv_id").agg(F.count_if((F.col("role") == "user") & held("la")).alias("marks"), F.count_if(F.col("role") == "assistant").alias("media"), F.bool_or((F.col("role") == "assistant") & held("und")).alias("stray"))
    return one.agg(
        F.count("*").alias("n"), F.count_if((F.col("marks") == F.col("media")) & ~F.col("stray")).alias("valid"), F.count_if(F.col("marks") > F.col("media")).alias("missing"),
        F.count_if(F.col("marks") < F.col("media")).alias("unused"), F.count_if("stray").alias("strays"),
    )


@query("""WITH j AS (SELECT n_regionkey, c_mktsegment, avg(c_acctbal) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT n_regionkey::VARCHAR AS region, c_mktsegment AS segment, round(a, 4) AS mean FROM j UNION ALL SELECT 'Average', c_mktsegment, round(avg(a), 4) FROM j GROUP BY c_mktsegment""")
def macro_average(spark, sf_dir):
    """Means by data set, and the mean of these means appended as a row."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    means = read(spark, sf_dir, "customer").join(nation, "c_nationkey").groupBy("n_regionkey", F.col("c_mktsegment").alias("segment")).agg(F.avg("c_acctbal").alias("a"))
    one = means.select(F.col("n_regionkey").cast("string").alias("region"), "segment", F.round("a", 4).alias("mean"))
    return one.unionByName(means.groupBy("segment").agg(F.round(F.avg("a"), 4).alias("mean")).select(F.lit("Average").alias("region"), "segment", "mean"))
