"""Benchmark scoring: accuracy at several grains, category tables, confusion and error figures, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, hit: str, grains: list[str]) -> DataFrame:
    """n, hits and accuracy over all rows and by each grain, in one pass: (grain, key, n, hits, accuracy)."""
    keyed = rows.select(F.col(hit).cast("long").alias("hit"), *(F.coalesce(F.col(g), F.lit("unknown")).alias(g) for g in grains))
    sets = [[], *([g] for g in grains)]
    out = keyed.groupingSets([[F.col(c) for c in s] for s in sets], *grains).agg(
        F.count("*").alias("n"), F.sum("hit").alias("hits"), F.avg("hit").alias("accuracy"), *(F.grouping(g).alias(f"g_{g}") for g in grains)
    )
    grain, key = F.lit("overall"), F.lit("overall")
    for g in grains:
        grain, key = F.when(F.col(f"g_{g}") == 0, F.lit(g)).otherwise(grain), F.when(F.col(f"g_{g}") == 0, F.col(g)).otherwise(key)
    return out.select(grain.alias("grain"), key.alias("key"), "n", "hits", F.round("accuracy", 6).alias("accuracy"))


def category_table(rows: DataFrame, category: str, prefetched: str, hit: str) -> DataFrame:
    """For each category and Overall: tot, prefetch, hit and their rates in percent, in order of the subject."""
    out = rows.rollup(category).agg(F.count("*").alias("tot"), F.count_if(prefetched).alias("prefetch"), F.count_if(hit).alias("hit"))
    rate = lambda c: F.round(F.col(c) / F.col("tot") * 100, 4)
    return out.select(F.coalesce(category, F.lit("Overall")).alias("subject"), "tot", "prefetch", "hit", rate("prefetch").alias("prefetch_rate"), rate("hit").alias("acc")).orderBy("subject")


def confusion(rows: DataFrame, group: str, label: Column, prob: Column, threshold: float) -> DataFrame:
    """TP, TN, FP, FN, accuracy and error figures overall and by group."""
    marked = rows.select(F.col(group).alias("grp"), (label >= threshold).alias("y"), (prob >= threshold).alias("p"), (prob - label).alias("e"))
    out = marked.rollup("grp").agg(
        F.grouping("grp").alias("g"), F.count_if(F.col("y") & F.col("p")).alias("tp"), F.count_if(~F.col("y") & ~F.col("p")).alias("tn"), F.count_if(~F.col("y") & F.col("p")).alias("fp"),
        F.count_if(F.col("y") & ~F.col("p")).alias("fn"), F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg(F.abs("e")).alias("mae"), F.max(F.abs("e")).alias("max_abs"), F.count("*").alias("n"),
    )
    six = lambda c: F.round(c, 6)
    return out.select(
        F.when(F.col("g") == 1, "all").otherwise(F.col("grp").cast("string")).alias("grp"), "tp", "tn", "fp", "fn",
        six((F.col("tp") + F.col("tn")) / F.greatest(F.lit(1), F.col("n"))).alias("accuracy"), six("mse").alias("mse"), six(F.sqrt("mse")).alias("rmse"), six("mae").alias("mae"), six("max_abs").alias("max_abs"),
    )


def votes(probs: Column, threshold: float, needed: int) -> Column:
    """Yes votes, mean probability, the verdict and the pattern yes:no of an array of probabilities."""
    yes, n = F.size(F.filter(probs, lambda p: p >= threshold)), F.size(probs)
    mean = F.aggregate(probs, F.lit(0.0), lambda a, p: a + p) / n
    return F.struct(yes.alias("votes"), F.round(mean, 6).alias("mean_prob"), (yes >= needed).alias("pred"), F.concat_ws(":", yes.cast("string"), (n - yes).cast("string")).alias("pattern"))


#: The ten IoU thresholds, and the areas in square pixels, both ends included.
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
SIDES = ("x1", "y1", "x2", "y2")
AREAS = {"all": (0.0, 1e10), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, 1e10)}


def average_precision(detections: DataFrame, truths: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, areas: dict[str, tuple[float, float]] = AREAS) -> DataFrame:
    """AP by category, area and IoU threshold, with 101 recall points.

    ``detections``: image, category, box, score; ``truths``: image, category, box. Boxes are matched greedily in order of the
    score (then the box) within each image and category, which fit in a task; of truths that fit equally well the first by its box is taken. Equal
    detections are one run with a count, equal truths one box with a count, and a run meets only the truths that overlap it enough, so a task grows with its
    rows and not with their square. The curve of a category is built from running sums
    by score, in two phases: runs are ranged over parts in that order, each part counts, and what the parts before it count is added. So
    a category of any size, even one whose scores are all equal, is as many tasks as it needs. Runs travel packed, at most ``RUNS`` in a row. Equal scores are taken in the order of image and box. A truth outside an area is not looked for there: a
    detection takes it only if no other truth will do, and then counts neither way, nor does an unmatched detection of
    another area. A category without truths in an area has no AP there. All detections of an image are scored.
    """
    from quernel.session import scratch

    kinds = [(name, t) for name in areas for t in thresholds]
    sides = lambda: [F.col("box")[k].alias(c) for k, c in enumerate(SIDES)]
    found = detections.select("image", "category", F.col("score").cast("double").alias("score"), *sides()).groupBy("image", "category")
    wanted = truths.select("image", "category", *sides()).groupBy("image", "category")
    schema = "image long, category long, score double, place int, n int, runs binary"
    marked = found.cogroup(wanted).applyInArrow(lambda key, some, all: _matched(key, some, all, thresholds, list(areas.values())), schema)
    chunks, before = _in_chunks(marked, len(kinds))
    size = _area(F.col("box"))
    numbers = scratch(truths.sparkSession, "truths")  # read twice below
    truths.groupBy("category").agg(F.array(*(F.count_if(size.between(*ends)) for ends in areas.values())).alias("n")).write.parquet(numbers)
    totals = truths.sparkSession.read.parquet(numbers)
    wide = totals.select("category", F.array(*(F.col("n")[k] for k in range(len(areas)) for _ in thresholds)).alias("truths"))
    points = chunks.join(before, ["part", "category"]).join(wide, "category").select("category", "sums", "earlier", "truths", "n", "runs").mapInArrow(_points, "category long, k int, top int, precision double")
    named = F.element_at(F.array(*(F.struct(F.lit(name).alias("area"), F.lit(t).alias("threshold")) for name, t in kinds)), F.col("k") + 1)
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.lit(100)), lambda k: k / 100)).alias("step")
    # the best precision at a recall of at least each step, as a running maximum over at most 101 steps
    reached = points.select("category", named.alias("kind"), "top", "precision").select("category", "kind.*", "top", "precision").groupBy("category", "area", "threshold", "top").agg(F.max("precision").alias("precision"))
    own = totals.select("category", F.explode(F.arrays_zip(F.array(*map(F.lit, areas)).alias("area"), "n")).alias("own")).select("category", "own.area", "own.n").filter("n > 0")
    grid = own.select("category", "area", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).select("category", "area", "threshold", steps)
    best = grid.join(reached, ["category", "area", "threshold"], "left")
    best = best.withColumn("precision", F.when(F.col("top") >= F.round(F.col("step") * 100), F.col("precision")).otherwise(0.0))
    at = best.groupBy("category", "area", "threshold", "step").agg(F.max("precision").alias("precision"))
    return at.groupBy("category", "area", "threshold").agg(F.round(F.sum("precision") / 101, 6).alias("ap"))


def _in_chunks(marked: DataFrame, kinds: int) -> tuple[DataFrame, DataFrame]:
    """Runs in order as chunks of one category, (part, category, sums, n, runs) with the sums of the chunks before in the same part, and what the parts before hold: (part, category, earlier), hits and then counts of each kind."""
    from pyspark.sql import Window

    from quernel.session import scratch

    spark = marked.sparkSession
    path, once = scratch(spark, "detections"), scratch(spark, "matched")
    marked.filter("category IS NOT NULL").write.parquet(once)  # ranging reads its rows twice
    order = [F.col("category"), F.desc("score"), F.col("image"), F.col("place")]
    ranged = spark.read.parquet(once).repartitionByRange(*order).sortWithinPartitions(*order).select("category", "n", "runs")
    ranged.mapInArrow(lambda batches: _chunked(batches, kinds), "part long, category long, sums array<long>, n int, runs binary").write.parquet(path)
    chunks = spark.read.parquet(path)
    sums = chunks.filter("runs IS NULL").select("part", "category", F.posexplode("sums").alias("k", "s"))
    earlier = Window.partitionBy("category", "k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", "category", "k", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s"))
    before = sums.groupBy("part", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("earlier"))
    return chunks.filter("runs IS NOT NULL"), before


#: Most runs in a row of the tables between. A run is up to 320 bytes with the usual kinds, and readers and writers hold thousands of rows.
RUNS = 256
#: Points that a task collects before it hands on the best of them.
POINTS = 1 << 18


def _packed(numbers) -> bytes:
    """A matrix of whole numbers, a row for each run, in few bytes."""
    import zlib

    import numpy as np

    return zlib.compress(numbers.astype(np.uint8 if numbers.max(initial=0) < 256 else np.int32).tobytes(), 1)


def _unpacked(runs: bytes, n: int, kinds: int):
    """The matrix of some runs: hits of each kind, then counts of each kind."""
    import zlib

    import numpy as np

    raw = zlib.decompress(runs)
    return np.frombuffer(raw, np.uint8 if len(raw) == n * kinds * 2 else np.int32).reshape(n, kinds * 2)


def _chunked(batches, kinds: int):
    """Ordered runs in chunks of a category; after the last one of a category a row without runs has its sums in this part."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema([("part", pa.int64()), ("category", pa.int64()), ("sums", pa.list_(pa.int64())), ("n", pa.int32()), ("runs", pa.binary())])
    now, sums, held, count, rows = None, np.zeros(kinds * 2, np.int64), [], 0, []

    def flush():
        nonlocal sums, held, count
        if held:
            numbers = np.concatenate(held)
            rows.append((part, now, sums.tolist(), count, _packed(numbers)))
            sums, held, count = sums + numbers.sum(axis=0, dtype=np.int64), [], 0

    def close():
        nonlocal sums
        flush()
        if now is not None:
            rows.append((part, now, sums.tolist(), 0, None))
        sums = np.zeros(kinds * 2, np.int64)

    def table():
        columns = list(zip(*rows)) or [()] * len(schema)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(columns, schema)], schema=schema)

    for batch in batches:
        for category, n, runs in zip(*(c.to_pylist() for c in batch.columns)):
            if category != now:
                close()
                now = category
            elif count + n > RUNS:
                flush()
            held.append(_unpacked(runs, n, kinds))
            count += n
            if len(rows) >= 1000:
                yield table()
    close()
    yield table()


def _points(batches):
    """The best precision at each hundredth of recall that some chunks reach: (category, kind, top, precision)."""
    import numpy as np
    import pyarrow as pa

    names = ["category", "k", "top", "precision"]

    def best(parts):
        arrays = [pa.array(np.concatenate(x)) for x in zip(*parts)]
        found = pa.table(arrays, names=names).group_by(names[:3], use_threads=False).aggregate([("precision", "max")])
        return found.select([*names[:3], "precision_max"]).rename_columns(names).to_batches()

    parts, size = [], 0
    for batch in batches:
        for category, sums, earlier, truths, n, runs in zip(*(c.to_pylist() for c in batch.columns)):
            kinds, start = len(truths), np.array(sums) + np.array(earlier)
            numbers = _unpacked(runs, n, kinds).astype(np.int64)
            hits, counted, tp, rank = numbers[:, :kinds], numbers[:, kinds:], start[:kinds], start[kinds:]
            hit, kind = (hits > 0).T.nonzero()[::-1]
            if not len(hit):
                continue
            # hits of a run come before its others, so its last hit is its best point
            found = (hits.cumsum(axis=0) + tp)[hit, kind]
            precision = found / (counted.cumsum(axis=0) - (counted - hits) + rank)[hit, kind]
            top = np.floor(found / np.array(truths)[kind] * 100 + 1e-9).astype(np.int32)
            cuts = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (top[1:] != top[:-1])])
            parts.append((np.full(len(cuts), category, np.int64), kind[cuts].astype(np.int32), top[cuts], np.maximum.reduceat(precision, cuts)))
            size += len(cuts)
            if size >= POINTS:
                yield from best(parts)
                parts, size = [], 0
    if parts:
        yield from best(parts)


def mean_precision(rows: DataFrame) -> DataFrame:
    """AP with its means by area: a null threshold is the mean over thresholds, a null category over categories."""
    sets = [["area", "category", "threshold"], ["area", "category"], ["area", "threshold"], ["area"]]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], "area", "category", "threshold").agg(F.round(F.avg("ap"), 6).alias("ap"))
    return out.select("category", "area", "threshold", "ap")


def _area(box: Column) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def _overlaps(boxes, wanted, least: float):
    """For some boxes the wanted ones with an IoU of at least ``least`` (above zero): (box, wanted, IoU) in order of the box. Wanted ones lie in columns, and in each column in order of their top."""
    import numpy as np

    share = max(least, 0.0)
    wide, high = np.maximum(wanted[:, 2] - wanted[:, 0], 0), np.maximum(wanted[:, 3] - wanted[:, 1], 0)
    cell = max(float(wide.max()) / 16, float(np.ptp(wanted[:, 0])) / (1 << 30), 1e-9)
    left = float(wanted[:, 0].min())
    column = np.floor((wanted[:, 0] - left) / cell).astype(np.int64)
    tops, rank = np.unique(wanted[:, 1], return_inverse=True)
    key = column * (len(tops) + 1) + rank
    order = np.argsort(key, kind="stable")
    key = key[order]

    def bounds(low, most):
        # overlaps are at least the share of either side, up to rounding
        side = boxes[:, low + 2] - boxes[:, low]
        slack = 1e-9 * (np.abs(boxes[:, low]) + np.abs(boxes[:, low + 2]) + most)
        return boxes[:, low] + share * side - most - slack, boxes[:, low + 2] - share * side + slack

    first, last = bounds(0, float(wide.max()))
    above, below = bounds(1, float(high.max()))
    first, last = (np.floor(np.clip((x - left) / cell, -1, float(column.max()) + 1)).astype(np.int64) for x in (first, last))
    above, below = np.searchsorted(tops, above, "left"), np.searchsorted(tops, below, "right")
    some = np.maximum(np.minimum(last, column.max()) - np.maximum(first, 0) + 1, 0)

    def spread(starts, counts):
        # all whole numbers of several ranges in a row, and whose each is
        whose = np.repeat(np.arange(len(counts)), counts)
        return whose, np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)

    box, at = spread(np.maximum(first, 0), some)
    starts = np.searchsorted(key, at * (len(tops) + 1) + above[box], "left")
    stops = np.searchsorted(key, at * (len(tops) + 1) + below[box], "left")
    whose, place = spread(starts, np.maximum(stops - starts, 0))
    box, other = box[whose], order[place]
    a, b = boxes[box], wanted[other]
    inter = np.maximum(np.minimum(b[:, 2], a[:, 2]) - np.maximum(b[:, 0], a[:, 0]), 0) * np.maximum(np.minimum(b[:, 3], a[:, 3]) - np.maximum(b[:, 1], a[:, 1]), 0)
    union = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) + (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1]) - inter
    iou = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
    near = (iou >= least) & (iou > 0)
    return box[near], other[near], iou[near]


def _matched(key, found, truth, thresholds, areas):
    """Runs of equal detections of an image and category, in order, packed by score: by area and threshold how many are hits, and how many count."""
    import numpy as np
    import pyarrow as pa

    columns = lambda table, names: np.column_stack([table.column(c).to_numpy() for c in names]).astype(float) + 0.0
    image, category = (k.as_py() for k in key)
    runs, sizes = np.unique(columns(found, ["score", *SIDES]) * [-1, 1, 1, 1, 1], axis=0, return_counts=True)
    wanted, copies = np.unique(columns(truth, SIDES), axis=0, return_counts=True)
    if image is None or category is None:
        wanted, copies = wanted[:0], copies[:0]
    boxes, least = runs[:, 1:], np.array(thresholds)
    if min(thresholds) <= 0:
        raise ValueError("thresholds are above zero")
    inside = lambda x, ends: ((size := (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])) >= ends[0]) & (size <= ends[1])
    hits, counted = (np.zeros((len(runs), len(areas), len(least)), np.int32) for _ in range(2))
    # areas that prefer the same truths are matched once
    looked = {}
    for k, ends in enumerate(areas):
        prefers = inside(wanted, ends)
        looked.setdefault(b"" if prefers.all() or not prefers.any() else prefers.tobytes(), []).append((k, prefers))
    for same in looked.values():
        prefers = same[0][1]
        good, other = _greedy(boxes, sizes, wanted, copies, least, prefers)
        for k, own in same:
            if not own.any():
                hit, passed = np.zeros_like(good), good + other
            else:
                hit, passed = (good, other) if prefers.any() else (other, good)
            hits[:, k] = hit
            counted[:, k] = hit + (sizes[:, None] - hit - passed) * inside(boxes, areas[k])[:, None]
    numbers = np.concatenate([x.reshape(len(runs), len(areas) * len(least)) for x in (hits, counted)], axis=1)
    scores, at = -runs[:, 0] + 0.0, np.arange(len(runs))
    firsts = np.maximum.accumulate(np.where(np.r_[True, scores[1:] != scores[:-1]][: len(runs)], at, 0))
    cuts = np.flatnonzero((at - firsts) % RUNS == 0)
    parts = np.split(numbers, cuts[1:]) if len(cuts) else []
    keys = [pa.array([k] * len(cuts), pa.int64()) for k in (image, category)]
    packed = [pa.array(range(len(cuts)), pa.int32()), pa.array([len(x) for x in parts], pa.int32()), pa.array([_packed(x) for x in parts], pa.binary())]
    return pa.table([*keys, pa.array(scores[cuts]), *packed], names=["image", "category", "score", "place", "n", "runs"])


def _greedy(boxes, sizes, wanted, copies, least, prefers, block: int = 1000):
    """How many of each run take a preferred truth, and another one, by threshold."""
    import numpy as np

    good, other = (np.zeros((len(boxes), len(least)), np.int32) for _ in range(2))
    if not len(wanted):
        return good, other
    free = np.repeat(copies.astype(np.int32)[:, None], len(least), axis=1)
    for begin in range(0, len(boxes), block):
        box, place, iou = _overlaps(boxes[begin : begin + block], wanted, least.min())
        order = np.lexsort((place, -iou, ~prefers[place], box))
        box, place, iou = box[order], place[order], iou[order]
        fits, ends = iou[:, None] >= least, np.searchsorted(box, np.arange(len(boxes[begin : begin + block]) + 1)).tolist()
        for k, (start, stop) in enumerate(zip(ends, ends[1:])):
            if start == stop:
                continue
            at = place[start:stop]
            left = free[at] * fits[start:stop]
            upto = np.minimum(left.cumsum(axis=0), sizes[begin + k])
            taken = upto.copy()
            taken[1:] -= upto[:-1]
            free[at] -= taken
            n = np.count_nonzero(prefers[at])  # they come first
            if n:
                good[begin + k] = upto[n - 1]
            other[begin + k] = upto[-1] - good[begin + k]
    return good, other
