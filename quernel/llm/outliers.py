"""Quality rules by robust multivariate outliers, with SQL functions only.

Each text gives statistics (words, their characters, symbols, repeated lines, words in repeated three-word windows). Texts that fail the base rules are out.
The others become vectors on an integer grid of 1/1000: logarithm of words, characters a word, logarithm of symbols in percent of characters,
share of repeated lines, share of repeated words. Each language and source has a centre and a scatter by the minimum covariance determinant:
starting from medians and their deviations, the ``SHARE`` of its documents that are nearest give mean and covariance, these give new Mahalanobis
distances, and so on for ``STEPS`` steps, none of which makes the determinant larger. A text is rejected if its squared distance exceeds the
``LEVEL`` quantile of chi-square with five degrees.

The scatter is the covariance times the factor that makes it right for normal data, plus the squares of ``FLOORS``: most texts have no symbol at all, so the plain
covariance would be singular, and any text with one an outlier. In the last distance a text with *fewer* symbols or repetitions than its
group counts as at the centre.

Groups of fewer than ``LEAST`` eligible documents are pooled by language, and languages whose pool is smaller still all together.

For scale: texts are read once; then each step reads the written vectors, adds up numbers and moments by group and bin of distance (``BINS`` a group at
most, so one group with a third of the rows is 4096 rows behind the map side) and cuts the bins at the share. Moments are exact
integer sums, so reruns agree bit by bit. Centres and scatters are broadcast up to ``BROADCAST_GROUPS`` groups, else joined by shuffle.

Defined cases: a null text has no words and fails the base rules; null languages and sources are groups of their own; a group of equal vectors
keeps them all; rows that repeat each have a result; an empty table gives no rows; values beyond ``LIMIT`` count as ``LIMIT``.
Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm._shared import small_side, words_of, written

SHARE = (3, 4)
STEPS = 3
LEVEL = 0.999
LEAST = 50
BINS = 4096
LIMIT = 100_000
BROADCAST_GROUPS = 200_000
#: Least standard deviations, in 1/1000: log words, characters a word, log symbols, repeated lines, repeated words.
FLOORS = (2000, 400, 300, 150, 120)
#: Dimensions in which only more than the centre is far.
UPPER = (3, 4, 5)
SIZE = len(FLOORS)
DIMENSIONS = range(1, SIZE + 1)
CELL = ["cell_lang", "cell_source"]

#: Vectors from statistics, in terms that Spark and other SQL engines share; all operands of / are made doubles.
VECTOR = {
    "x1": "floor(1000 * ln(CAST(n_words AS DOUBLE)))",
    "x2": "floor(1000 * CAST(word_chars AS DOUBLE) / CAST(n_words AS DOUBLE))",
    "x3": "floor(1000 * ln(1 + 100 * CAST(n_symbols AS DOUBLE) / CAST(word_chars AS DOUBLE)))",
    "x4": "floor(1000 * CAST(n_dup_lines AS DOUBLE) / CAST(n_lines AS DOUBLE))",
    "x5": "floor(1000 * CAST(n_repeat_words AS DOUBLE) / CAST(n_words AS DOUBLE))",
}
FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def chi_square(x: float, degrees: int) -> float:
    """The distribution function, by the series of the incomplete gamma function."""
    half, x = degrees / 2, x / 2
    term = total = 1 / half
    k = half
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(half * math.log(x) - x - math.lgamma(half)) if x > 0 else 0.0


def quantile(level: float, degrees: int) -> float:
    low, high = 0.0, 10_000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < level else (low, middle)
    return high


def consistency(share: tuple[int, int], degrees: int) -> float:
    """What the covariance of the nearest share of normal data is multiplied by."""
    level = share[0] / share[1]
    return level / chi_square(quantile(level, degrees), degrees + 2)


def moments() -> dict[str, str]:
    """The sums of a group that its mean and covariance are made of."""
    sums = {f"s{i}": f"x{i}" for i in DIMENSIONS} | {f"s{i}{j}": f"x{i} * x{j}" for i in DIMENSIONS for j in DIMENSIONS if j <= i}
    return {k: f"sum(CAST({v} AS DECIMAL(20, 0)))" for k, v in sums.items()}


def centre() -> dict[str, str]:
    """Means m, and the lower triangle l of the scatter's Cholesky factor, each from columns before it."""
    factor = repr(consistency(SHARE, SIZE))
    out = {f"m{i}": f"CAST(s{i} AS DOUBLE) / CAST(n AS DOUBLE)" for i in DIMENSIONS}
    for j in DIMENSIONS:
        for i in range(j, SIZE + 1):
            cell = f"{factor} * (CAST(s{i}{j} AS DOUBLE) / CAST(n AS DOUBLE) - m{i} * m{j})" + (f" + {FLOORS[i - 1] ** 2}.0e0" if i == j else "")
            cell += "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
            out[f"l{i}{j}"] = f"sqrt({cell})" if i == j else f"({cell}) / l{j}{j}"
    return out


def distance(upper: tuple[int, ...] = ()) -> dict[str, str]:
    """Squared Mahalanobis distance d2 from a centre, by forward substitution."""
    out = {}
    for i in DIMENSIONS:
        x = f"greatest(CAST(x{i} AS DOUBLE), m{i})" if i in upper else f"CAST(x{i} AS DOUBLE)"
        out[f"z{i}"] = f"({x} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(1, i)) + f") / l{i}{i}"
    return out | {"d2": " + ".join(f"z{i} * z{i}" for i in DIMENSIONS)}


def start() -> dict[str, str]:
    """A diagonal scatter of medians (m) and median absolute deviations (a) in the form of ``centre``."""
    return {f"l{i}{j}": f"greatest(1.4826e0 * a{i}, {FLOORS[i - 1]}.0e0)" if i == j else "0.0e0" for i in DIMENSIONS for j in DIMENSIONS if j <= i}


BIN = f"CAST(least(floor(256 * ln(1 + d2)), {BINS - 1}) AS INTEGER)"


def named(columns: dict[str, str]) -> list[str]:
    return [f"{v} AS {k}" for k, v in columns.items()]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the statistics of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed."""
    named_cols = [F.col(c).alias(n) for c, n in ((id_col, "doc_id"), (lang_col, "lang"), (source_col, "source"))]
    texts = docs.select(*named_cols, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = texts.select("doc_id", "lang", "source", words_of(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"), F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    counted = split.selectExpr(
        "doc_id", "lang", "source", "w", "n_symbols", "CAST(size(w) AS LONG) AS n_words", "CAST(length(array_join(w, '')) AS LONG) AS word_chars", "CAST(size(lines) AS LONG) AS n_lines",
        "CAST(size(lines) - size(array_distinct(lines)) AS LONG) AS n_dup_lines",
        "CASE WHEN size(w) >= 4 THEN transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) ELSE array() END AS hashes",
    )
    # Hashes only tell that all windows differ; windows that may be equal are sorted and compared as text.
    sorted_windows = counted.selectExpr(
        "doc_id", "lang", "source", "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines",
        "CASE WHEN size(array_distinct(hashes)) < size(hashes) THEN array_sort(transform(sequence(0, size(w) - 3), i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS v, i AS i))) END AS s",
    )
    repeated = sorted_windows.selectExpr("*", "transform(filter(s, (x, k) -> (k > 0 AND s[greatest(k - 1, 0)].v = x.v) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].v = x.v)), x -> x.i) AS places").drop("s")
    covered = "aggregate(array_sort(places), named_struct('n', 0, 'last', -3), (a, x) -> named_struct('n', a.n + least(3, x - a.last), 'last', x), a -> a.n)"
    return repeated.selectExpr("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", f"CAST(coalesce({covered}, 0) AS LONG) AS n_repeat_words", "n_lines").withColumn("base_failed", F.expr(FAILED))


def with_cells(rows: DataFrame, least: int) -> DataFrame:
    """Rows with the cell of their language and source: their own, their language's pool of small ones ('*'), or the pool of small pools."""
    groups = rows.groupBy("lang_key", "source_key").agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n"))
    small = F.col("n") < least
    pool = F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("lang_key"))
    groups = groups.select(
        "lang_key", "source_key",
        F.when(small & (pool < least), "*").otherwise(F.col("lang_key")).alias("cell_lang"), F.when(small, "*").otherwise(F.col("source_key")).alias("cell_source"),
    )
    return rows.join(small_side(written(groups, "cells"), BROADCAST_GROUPS), ["lang_key", "source_key"]).drop("lang_key", "source_key")


def concentrated(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """Centres of the share of each cell's documents that are nearest to the centres so far; documents of equal bins of distance go together."""
    far = vectors.join(small_side(centres, BROADCAST_GROUPS), CELL).selectExpr(*CELL, *(f"x{i}" for i in DIMENSIONS), *named(distance())).withColumn("bin", F.expr(BIN))
    sums = moments()
    bins = far.groupBy(*CELL, "bin").agg(F.count(F.lit(1)).alias("n"), *(F.expr(v).alias(k) for k, v in sums.items()))
    cell = Window.partitionBy(*CELL)
    inside = F.sum("n").over(cell.orderBy("bin")) - F.col("n") < F.expr(f"{SHARE[0]} * total div {SHARE[1]}") + 1
    near = bins.withColumn("total", F.sum("n").over(cell)).withColumn("inside", inside).filter("inside")
    summed = near.groupBy(*CELL).agg(F.sum("n").alias("n"), *(F.expr(f"sum(CAST({k} AS DECIMAL(28, 0)))").alias(k) for k in sums))
    return written(summed.selectExpr(*CELL, *named(centre())), "centres")


def centres_of(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """Centre and scatter of each cell of a written table of vectors."""
    medians = written(vectors.groupBy(*CELL).agg(*(F.median(f"x{i}").alias(f"m{i}") for i in DIMENSIONS)), "medians")
    apart = vectors.join(small_side(medians, BROADCAST_GROUPS), CELL)
    deviations = apart.groupBy(*CELL).agg(*(F.median(F.abs(F.col(f"x{i}") - F.col(f"m{i}"))).alias(f"a{i}") for i in DIMENSIONS))
    centres = written(medians.join(deviations, CELL).selectExpr(*CELL, *(f"m{i}" for i in DIMENSIONS), *named(start())), "centres")
    for _ in range(steps):
        centres = concentrated(vectors, centres)
    return centres


def outliers(docs: DataFrame, least: int = LEAST, steps: int = STEPS, level: float = LEVEL, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, statistics, base_failed, distance2 (squared, null for those that fail the base rules) and kept."""
    found = statistics(docs, id_col, text_col, lang_col, source_col)
    keys = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(k) for c, k in (("lang", "lang_key"), ("source", "source_key"))]
    vector = [F.expr(f"CASE WHEN NOT base_failed THEN CAST(least({v}, {LIMIT}) AS LONG) END").alias(k) for k, v in VECTOR.items()]
    rows = written(found.select("doc_id", *keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *vector), "statistics")
    rows = written(with_cells(rows, least), "vectors")
    centres = centres_of(rows.filter("NOT base_failed").select(*CELL, *VECTOR), steps)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    far = rows.join(small_side(centres, BROADCAST_GROUPS), CELL, "left").selectExpr(*columns, *named(distance(UPPER)))
    return far.select(*columns, F.col("d2").alias("distance2"), F.expr(f"NOT base_failed AND d2 <= {quantile(level, SIZE)!r}").alias("kept"))


def oracle(stats: str) -> str:
    """The rules in SQL of DuckDB over a query of doc_id, lang, source and the statistics."""
    cell = ", ".join(CELL)
    xs = ", ".join(VECTOR)
    ctes = [
        f"stats AS ({stats})",
        f"rated AS (SELECT *, {FAILED} AS base_failed, coalesce('=' || lang, '') AS lang_key, coalesce('=' || source, '') AS source_key FROM stats)",
        "grp AS (SELECT lang_key, source_key, count(*) FILTER (NOT base_failed) AS n FROM rated GROUP BY lang_key, source_key)",
        f"pool AS (SELECT *, n < {LEAST} AS small, sum(CASE WHEN n < {LEAST} THEN n ELSE 0 END) OVER (PARTITION BY lang_key) AS pooled FROM grp)",
        f"cells AS (SELECT lang_key, source_key, CASE WHEN small AND pooled < {LEAST} THEN '*' ELSE lang_key END AS cell_lang, CASE WHEN small THEN '*' ELSE source_key END AS cell_source FROM pool)",
        f"placed AS (SELECT *, {', '.join(f'CASE WHEN NOT base_failed THEN CAST(least({v}, {LIMIT}) AS BIGINT) END AS {k}' for k, v in VECTOR.items())} FROM rated JOIN cells USING (lang_key, source_key))",
        f"vec AS (SELECT {cell}, {xs} FROM placed WHERE NOT base_failed)",
        f"med AS (SELECT {cell}, {', '.join(f'median(x{i}) AS m{i}' for i in DIMENSIONS)} FROM vec GROUP BY {cell})",
        f"dev AS (SELECT {cell}, {', '.join(f'median(abs(x{i} - m{i})) AS a{i}' for i in DIMENSIONS)} FROM vec JOIN med USING ({cell}) GROUP BY {cell})",
        f"c0 AS (SELECT {cell}, {', '.join(f'm{i}' for i in DIMENSIONS)}, {', '.join(named(start()))} FROM med JOIN dev USING ({cell}))",
    ]
    for k in range(STEPS):
        ctes += [
            f"f{k} AS (SELECT {cell}, {xs}, {', '.join(named(distance()))} FROM vec JOIN c{k} USING ({cell}))",
            f"b{k} AS (SELECT *, {BIN} AS bin FROM f{k})",
            f"h{k} AS (SELECT {cell}, bin, count(*) AS n FROM b{k} GROUP BY {cell}, bin)",
            f"u{k} AS (SELECT {cell}, bin, sum(n) OVER (PARTITION BY {cell} ORDER BY bin) - n AS before, sum(n) OVER (PARTITION BY {cell}) AS total FROM h{k})",
            f"n{k} AS (SELECT {cell}, count(*) AS n, {', '.join(named(moments()))} FROM b{k} JOIN u{k} USING ({cell}, bin) WHERE before < {SHARE[0]} * total // {SHARE[1]} + 1 GROUP BY {cell})",
            f"c{k + 1} AS (SELECT {cell}, {', '.join(named(centre()))} FROM n{k})",
        ]
    return f"""
WITH {(',' + chr(10)).join(ctes)},
far AS (SELECT placed.*, {', '.join(named(distance(UPPER)))} FROM placed LEFT JOIN c{STEPS} USING ({cell}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {quantile(LEVEL, SIZE)!r}, false) AS kept FROM far
"""
