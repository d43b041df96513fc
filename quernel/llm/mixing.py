"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed hash. A source with target ``t`` and size ``s`` takes ``t // s`` whole copies of
every document, and one copy more of the documents whose hash lies under a threshold. The threshold is
found without sorting: sizes are summed by source and hash bucket, the bucket in which the running sum
passes the budget is the boundary, and only the boundary bucket's documents are summed again, by the next
bits of the hash, until the hash is used up. So budgets nest: a larger target keeps all that a smaller one took.

Defined cases: a null text has size 0; the null source is a source of its own, after all others; documents
of size 0 and sources of size 0 take nothing; rows that repeat a document have one hash and are
taken or left together; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm._shared import files_for, words_of, written

BITS = 60
STEP = 12
WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows of a file of sizes.
FILE_ROWS = 1_000_000


def unit(column: Column) -> Column:
    """A hash of 60 bits that other engines can compute too: the first 15 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to a table of (source, source_size), one row a source.

    Sources in order of code points, null last, weigh ``weights`` in turn and share the sum of all sizes; a target
    stops at ``most`` times its source's size and the excess is shared again by weight. In order of
    ``size / weight``, the capped sources are a prefix: a source is capped if its share of what the sources
    before it leave would be more than its cap.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    left = total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    shared = weighed.withColumn("left", left).withColumn("rest", F.sum("weight").over(after)).withColumn("place", F.row_number().over(order))
    # a source is above its cap if weight * left / rest > most * size
    free = shared.withColumn("free", F.col("weight") * F.col("left") <= most * F.col("source_size") * F.col("rest"))
    first = F.min(F.when(F.col("free"), F.struct("place", "left", "rest"))).over(Window.partitionBy())
    level = free.withColumn("first", first)
    share = (F.col("weight") * F.col("first.left")).cast("double") / F.col("first.rest")
    capped = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    return level.select("source", "source_size", F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame, bits: int = BITS, step: int = STEP) -> DataFrame:
    """For each source, the largest threshold such that its documents of smaller hash sum to its budget at most.

    ``docs``: source, size, unit; ``budgets``: source, budget. Each round sums the boundary buckets' documents by
    the next ``step`` bits. A bucket's sums meet in one row, so a window sees a row for each bucket at most.
    """
    edge = budgets.select("source", "budget", F.lit(0).cast("long").alias("low"))
    shift = bits
    while shift:
        shift -= min(step, shift)
        width = F.lit(1 << (shift + step)).cast("long")
        inside = docs.join(edge.withColumnsRenamed({"source": "s"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") >= F.col("low")) & (F.col("unit") < F.col("low") + width))
        sums = inside.groupBy("source", F.shiftright("unit", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        upto = Window.partitionBy("source").orderBy("bucket")
        run = sums.withColumn("upto", F.sum("size").over(upto)).withColumnsRenamed({"source": "s"})
        joined = edge.join(run, F.col("source").eqNullSafe(F.col("s")), "left")
        over = F.col("upto") > F.col("budget")
        found = joined.groupBy("source", "budget", "low").agg(
            F.min(F.when(over, F.struct("bucket", "upto", "size", "rows"))).alias("at"),
        )
        nothing = F.col("at").isNull()
        # where no bucket passes the budget, all of the range is taken and the range after it is empty
        end = F.col("low") + width
        edge = found.select(
            "source",
            F.when(nothing, F.lit(0)).otherwise(F.col("budget") - F.col("at.upto") + F.col("at.size")).cast("long").alias("budget"),
            F.when(nothing, end).otherwise(F.shiftleft(F.col("at.bucket"), shift)).alias("low"),
            F.coalesce(F.col("at.rows"), F.lit(0)).alias("rows"),
        )
        edge = written(edge, "mix-edge")
        if shift and not edge.filter("rows > 1").limit(1).count():
            break
        edge = edge.drop("rows")
    return edge.select("source", F.col("low").alias("threshold"))


def planned(docs: DataFrame, weights: tuple[int, ...], most: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents' (doc_id, source, size, unit), and for each source s its source_size, target, copies and threshold."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"), unit(F.col(id_col)).alias("unit")
    )
    spark = docs.sparkSession
    sized = written(sized.coalesce(files_for(spark, docs.select(id_col).count(), FILE_ROWS)), "mix-sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = written(targets(sums, weights, most), "mix-targets")
    copies = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("copies", copies).withColumn("budget", F.floor(F.col("target")).cast("long") - F.col("copies") * F.col("source_size"))
    cut = thresholds(sized.select("source", "size", "unit"), goal.select("source", "budget"))
    plan = goal.join(cut.withColumnsRenamed({"source": "s"}), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return sized, written(plan.withColumnRenamed("source", "s"), "mix-plan")


def times(most: int) -> Column:
    """How often a document is taken, from the plan's columns and its unit."""
    return F.least(F.col("copies") + (F.col("unit") < F.col("threshold")).cast("long"), F.lit(most))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document.

    Spark broadcasts the table of sources if its size allows, and else joins by sorting with hot sources split.
    Documents of one source are never gathered, only their sums by bucket are.
    """
    sized, plan = planned(docs, weights, most, id_col, text_col, source_col)
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times(most)).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken. Texts of size 0 are never taken."""
    _, plan = planned(docs, weights, most, id_col, text_col, source_col)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source_col).alias("source"), unit(F.col(id_col)).alias("unit"), (F.size(words_of(F.col(text_col))) > 0).alias("some"))
    taken = row.join(plan, F.col("source").eqNullSafe(F.col("s"))).filter("some")
    copies = taken.select("row", F.explode(F.array_repeat(F.lit(1), times(most).cast("int"))))
    return copies.select("row.*")
