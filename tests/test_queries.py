"""All registered queries of the plans against DuckDB, and the operators that SQL cannot express against brute force."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernel.functions import geometry as G
from quernel.functions import text as T
from quernel.operators import scoring, series
from quernel.plans import annotation_queries, io_queries  # noqa: F401
from quernel.plans import queries as plans

SF = "/root/testdata/sf0.001"


def as_rows(df, columns):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return str(float(v)) if isinstance(v, (bool, int, float, np.number, np.bool_)) else str(v)

    return sorted(tuple(map(plain, row)) for row in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.sql(plans.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert as_rows(got, columns) == as_rows(want, columns)


def test_spaced_events(spark):
    rows = [(1, m, m + 1, m, 1.0, "open") for m in (0, 2, 3, 5, 6, 9)] + [(2, 4, 5, 4, 1.0, "close")]
    got = series.spaced(spark.createDataFrame(rows, "ep long, start long, end long, mid long, change double, kind string"), 3)
    assert sorted((r.ep, r.mid) for r in got.collect()) == [(1, 0), (1, 3), (1, 6), (1, 9), (2, 4)]


def test_packing_fills_no_bin_beyond_its_room(spark):
    rows = plans.pack_bins(spark, SF).collect()
    lengths = {r.conv_id: r.n_tokens for r in plans.token_lengths(spark, SF).collect()}
    assert sorted(r.conv_id for r in rows) == sorted(lengths)
    sums = Counter()
    for r in rows:
        sums[(r.shard, r.bin)] += r.n_tokens
    count = Counter((r.shard, r.bin) for r in rows)
    assert all(n <= 4096 or count[k] == 1 for k, n in sums.items())


def brute_bleu(a, b):
    if not a or not b:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        x, y = (Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1)) for t in (a, b))
        logs += math.log((sum((x & y).values()) + 1) / (sum(y.values()) + 1))
    return (1.0 if len(b) > len(a) else math.exp(1 - len(a) / max(1, len(b)))) * math.exp(logs / 4)


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_token_metrics(spark):
    rng = np.random.default_rng(1)
    rows = [([f"w{k}" for k in rng.integers(0, 6, rng.integers(0, 12))], [f"w{k}" for k in rng.integers(0, 6, rng.integers(0, 12))]) for _ in range(60)]
    df = spark.createDataFrame([(list(a), list(b)) for a, b in rows], "a array<string>, b array<string>")
    for r in df.select("a", "b", T.token_distance(F.col("a"), F.col("b")).alias("d"), T.bleu(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.d == brute_distance(r.a, r.b) and r.s == pytest.approx(brute_bleu(r.a, r.b))


def test_distance_of_many_tokens(spark):
    a = [f"w{k}" for k in range(400)]
    # the 257th token on once shared the characters of the first ones
    cases = [(a, a[:10] + a[256:266] + a[20:]), (a[:300], a[100:]), ([a[0]] * 3 + a, [a[256]] * 3 + a)]
    df = spark.createDataFrame(cases, "a array<string>, b array<string>")
    for r in df.select("a", "b", T.token_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == brute_distance(r.a, r.b)


def test_option_letters(spark):
    cases = [("B.", "B"), ("A cat is it", None), ("A", "A"), ("It is (C)", "C"), ("B or C", None), ("Z", "Z"), ("Cannot determine the answer", "Z"), ("Failed to obtain answer via API B", None), ("the red one", "A")]
    options = F.create_map(*(F.lit(x) for x in ("A", "red", "B", "green", "C", "blue")))
    df = spark.createDataFrame(cases, "t string, want string")
    for r in df.select("t", "want", T.infer_option(F.col("t"), options).alias("got")).collect():
        assert r.got == r.want, r.t


def test_geometry(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    assert tuple(pick(G.resized(F.lit(1080), F.lit(1920), 28, 56 * 56, 28 * 28 * 1280))) == (728, 1316)
    assert pick(G.resized(F.lit(1), F.lit(300), 28, 3136, 401408)) is None
    assert pick(G.even_frames(F.lit(0), F.lit(9), F.lit(4))) == [0, 3, 6, 9]
    assert pick(G.even_frames(F.lit(7), F.lit(9), F.lit(1))) == [7]
    assert pick(G.frame_count(F.lit(300), F.lit(30.0), 2.0, 4, 768)) == 20
    assert tuple(pick(G.frame_range(F.lit(1.0), F.lit(2.0), F.lit(100), F.lit(10.0)))) == (10, 20)
    assert pick(G.frame_range(F.lit(2.0), F.lit(2.0), F.lit(100), F.lit(10.0))) is None
    assert pick(G.turn([F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)], [F.lit(-1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)])) == pytest.approx(0)


def test_average_precision(spark):
    box = lambda x: [float(x), 0.0, x + 10.0, 10.0]
    truths = spark.createDataFrame([(1, 0, box(0)), (1, 0, box(50)), (2, 0, box(0))], "image long, category long, box array<double>")
    found = spark.createDataFrame([(1, 0, box(0), 0.9), (1, 0, box(100), 0.8), (1, 0, box(50), 0.7)], "image long, category long, box array<double>, score double")
    got = scoring.average_precision(found, truths, (0.5,)).first()
    # recall 1/3 at precision 1, then 2/3 at 2/3: 34 points of 1 and 33 of 2/3
    assert got.ap == pytest.approx((34 + 33 * 2 / 3) / 101, abs=1e-6)
    assert scoring.average_precision(truths.withColumn("score", F.lit(1.0)), truths, (0.5, 0.75)).filter("ap < 1").count() == 0


def test_average_precision_by_area(spark):
    box = lambda x, side: [float(x), 0.0, float(x + side), float(side)]
    # a small, a medium and a large truth; the medium one is found at an IoU of 0.9, and a small box is found where nothing is
    truths = spark.createDataFrame([(1, 0, box(0, 10)), (1, 0, box(100, 50)), (2, 0, box(0, 200))], "image long, category long, box array<double>")
    rows = [(1, 0, box(0, 10), 0.9), (1, 0, [100.0, 0.0, 150.0, 45.0], 0.8), (2, 0, box(0, 200), 0.7), (2, 0, box(900, 10), 0.95)]
    found = spark.createDataFrame(rows, "image long, category long, box array<double>, score double")
    whole = scoring.mean_precision(scoring.average_precision(found, truths)).collect()
    got = {(r.area, r.threshold): r.ap for r in whole if r.category == 0}
    assert {t for _, t in got} == {None, *scoring.THRESHOLDS} and len(got) == 44
    # the stray small box spoils the small range (and all), not the others
    assert got["small", 0.5] == pytest.approx(0.5) and got["large", 0.95] == 1 and got["medium", 0.9] == 1 and got["medium", 0.95] == 0
    assert got["medium", None] == pytest.approx(0.9) and got["large", None] == 1 and got["small", None] == pytest.approx(0.5)
    # all: precisions 1/2, 2/3, 3/4 at recalls 1/3, 2/3, 1
    assert got["all", 0.5] == pytest.approx(0.75)
    assert {r.threshold: r.ap for r in whole if r.category is None and r.area == "medium"}[None] == pytest.approx(0.9)


def test_detection_ap_scores_all_lines(spark, monkeypatch):
    from conftest import DATA

    from quernel.plans import queries

    given = {}
    whole = scoring.average_precision
    monkeypatch.setattr(queries.S, "average_precision", lambda found, truths: given.update(found=found, truths=truths) or whole(found, truths))
    queries.detection_ap(spark, str(DATA))
    lines = queries.read(spark, str(DATA), "lineitem").count()
    assert given["found"].count() == given["truths"].count() == lines


def test_average_precision_of_a_category_in_many_parts(spark):
    rng = np.random.default_rng(5)
    boxes = [[float(x), float(y), float(x + w), float(y + h)] for x, y, w, h in rng.integers(1, 60, (400, 4))]
    truths = spark.createDataFrame([(k % 50, 1, b) for k, b in enumerate(boxes[:200])], "image long, category long, box array<double>")
    # most scores are equal
    found = spark.createDataFrame([(k % 50, 1, [x + k % 3 for x in b], 1.0 if k % 4 else k / 400) for k, b in enumerate(boxes)], "image long, category long, box array<double>, score double")
    results = []
    for parts in ("1", "9"):
        kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        marked = scoring.average_precision(found, truths)
        results.append(sorted((r.area, r.threshold, r.ap) for r in marked.collect()))
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert results[0] == results[1] and any(ap > 0 for *_, ap in results[0])


def test_average_precision_of_crowded_images(spark):
    """Counted runs and near boxes give what one loop over all pairs gives; a crowd of 6,000 boxes on 6,000 is no square."""
    import time

    rng = np.random.default_rng(11)
    made = lambda n: [[float(x), float(y), float(x + w), float(y + h)] for x, y, w, h in zip(*rng.integers(0, 40, (2, n)), *rng.integers(20, 60, (2, n)))]
    truths, found = made(150) * 2, [(b, float(s)) for b, s in zip(made(200) * 3, rng.integers(0, 4, 600) / 4)]
    areas = {"all": (0.0, 1e10), "small": (0.0, 1200.0), "large": (1200.0, 1e10), "none": (1e9, 1e10)}
    iou = lambda a, b: (i := max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))) / (sum((c[2] - c[0]) * (c[3] - c[1]) for c in (a, b)) - i)
    inside = lambda b, ends: ends[0] <= (b[2] - b[0]) * (b[3] - b[1]) <= ends[1]
    want = {}
    for area, ends in areas.items():
        for t in (0.5, 0.8):
            left, order, marks = sorted(truths), sorted(found, key=lambda f: (-f[1], f[0])), []
            for box, _ in order:
                fit = [(not inside(b, ends), -iou(box, b), k) for k, b in enumerate(left) if iou(box, b) >= t]
                if fit:
                    outside, _, k = min(fit)
                    left.pop(k)
                    marks += [] if outside else [True]
                elif inside(box, ends):
                    marks.append(False)
            n, tp, best = sum(inside(b, ends) for b in truths), 0, [0.0] * 101
            for rank, mark in enumerate(marks, 1):
                tp += mark
                if mark:
                    top = int(tp / n * 100 + 1e-9)
                    best[: top + 1] = [max(b, tp / rank) for b in best[: top + 1]]
            if n:
                want[area, t] = round(sum(best) / 101, 6)
    rows = spark.createDataFrame([(3, 1, b) for b in truths], "image long, category long, box array<double>")
    boxes = spark.createDataFrame([(3, 1, b, s) for b, s in found], "image long, category long, box array<double>, score double")
    got = {(r.area, r.threshold): r.ap for r in scoring.average_precision(boxes, rows, (0.5, 0.8), areas).collect()}
    assert got == pytest.approx(want, abs=2e-6) and len(set(want.values())) > 4
    crowd = spark.range(6000).selectExpr("1L AS image", "1L AS category", "array(id % 100 * 7D, id div 100 * 7D, id % 100 * 7D + 9, id div 100 * 7D + 9) AS box")
    began = time.monotonic()
    assert scoring.average_precision(crowd.selectExpr("*", "1D AS score"), crowd).filter("area = 'all' AND ap < 1").count() == 0
    assert time.monotonic() - began < 20


def test_average_precision_keeps_rows_small(spark, monkeypatch):
    """Runs of a category are many short rows between the steps, and their curve is that of one loop over all of them."""
    from quernel import session

    paths, whole = [], session.scratch
    monkeypatch.setattr(session, "scratch", lambda spark, name: paths.append(whole(spark, name)) or paths[-1])
    rng = np.random.default_rng(12)
    made = lambda n, most: [[float(x), float(y), float(x + 30), float(y + 30)] for x, y in rng.integers(0, most, (n, 2))]
    truths = [(k % 3, k % 2, b) for k, b in enumerate(made(240, 90))] + [(1, 1, [0.0, 0.0, 30.0, 30.0])] * 290
    # more than RUNS boxes of one score, single scores, and counts that pass a byte
    found = [(k % 3, k % 2, b, 0.5 if k % 4 else k / 6000) for k, b in enumerate(made(6000, 90))] + [(1, 1, [1.0, 0.0, 31.0, 30.0], 0.9)] * 300
    areas = {"all": (0.0, 1e10), "none": (1e9, 1e10)}
    iou = lambda a, b: (i := max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))) / (1800 - i)
    want = {}
    for category in (0, 1):
        for t in (0.5, 0.8):
            left = {k: sorted(b for i, c, b in truths if (i, c) == (k, category)) for k in range(3)}
            n, tp, best = sum(map(len, left.values())), 0, [0.0] * 101
            for rank, (_, image, box) in enumerate(sorted((-s, i, b) for i, c, b, s in found if c == category), 1):
                fit = [(-iou(box, b), k) for k, b in enumerate(left[image]) if abs(b[0] - box[0]) < 15 and iou(box, b) >= t]
                if fit:
                    left[image].pop(min(fit)[1])
                    tp += 1
                    top = int(tp / n * 100 + 1e-9)
                    best[: top + 1] = [max(b, tp / rank) for b in best[: top + 1]]
            want[category, t] = round(sum(best) / 101, 6)
    rows = spark.createDataFrame([*truths, (1, None, truths[0][2])], "image long, category long, box array<double>").filter("category IS NOT NULL")
    boxes = spark.createDataFrame([*found, (1, None, found[0][2], 1.0)], "image long, category long, box array<double>, score double")
    got = {(r.category, r.threshold): r.ap for r in scoring.average_precision(boxes, rows, (0.5, 0.8), areas).collect()}
    assert got == pytest.approx(want, abs=2e-6) and len(set(want.values())) == 4
    # with the ten thresholds and four areas, the kinds that make a run's row longest
    scoring.average_precision(boxes, rows).collect()
    longest = 0
    for path in paths:
        table = spark.read.parquet(path)
        for name, kind in table.dtypes:
            if kind == "binary":
                longest = max(longest, table.agg(F.max(F.length(name)).alias("n")).first().n)
    assert 0 < longest < 1 << 17


@pytest.mark.parametrize("name", ["vote_tokens", "frame_lists", "tested_programs"])
def test_numbers_of_single_precision_at_borders(spark, tmp_path, name):
    """Numbers just below and above a border fall where the SQL, in single precision, puts them."""
    import duckdb

    from quernel.plans import annotation_queries, io_queries, queries  # noqa: F401

    exact = np.array([k / n for n in (20, 40, 8) for k in range(-n, n)] + [(k - 0.5) / 8 for k in range(-8, 9)], np.float32)
    rows = np.concatenate([exact, *(np.nextafter(exact, np.float32(x)) for x in (9, -9))])
    rows = [np.random.default_rng(k).permutation(rows)[:9].tolist() for k in range(300)]
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duckdb.sql(queries.SQL[name].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    assert sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(map(str, want))
