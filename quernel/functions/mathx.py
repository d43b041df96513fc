"""Whether two answers are the same number, formula or text."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions import algebra

#: Fixed value: numbers that differ by less are the same.
NEAR = 1e-6


def value_of(text: str) -> float | None:
    """The number that a text stands for, None if it is no arithmetic."""
    tree = algebra.tree_of(text)
    if tree is None or algebra.symbols(tree):
        return None
    try:
        value = complex(algebra.number(tree, {}))
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError):
        return None
    return value.real if abs(value.imag) < 1e-12 and math.isfinite(value.real) else None


def same_of(said: str | None, gold: str | None) -> bool:
    """Answers are compared in small letters, so symbols are."""
    a, b = str(said).lower().strip(), str(gold).lower().strip()
    return a == b or algebra.same_formulas(a, b)


def same(said: Column, gold: Column) -> Column:
    """Whether two answers are equal as texts, numbers or formulas. Equal texts and plain numbers are decided in the JVM; only the other pairs are read, each distinct text once a worker."""
    strip = lambda c: F.lower(F.trim(c))

    @F.pandas_udf("boolean")
    def read(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else same_of(x, y) for x, y in zip(a, b)], dtype=object)

    plain = F.abs(said.try_cast("double") - gold.try_cast("double")) < NEAR
    decided = F.when(strip(said) == strip(gold), F.lit(True)).when(plain.isNotNull(), plain)
    # decided pairs go to the function as nulls, which it does not read
    asked = [F.when(decided.isNull(), c) for c in (said, gold)]
    return F.coalesce(decided, read(*asked), F.lit(False))


def with_same(rows: DataFrame, said: str, gold: str, name: str) -> DataFrame:
    """Rows with whether two answers are equal. Each distinct pair is read once, spread over all tasks however few files or rows hold it."""
    pairs = rows.select(said, gold).distinct()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    read = pairs.repartition(parts).select(F.col(said).alias("_said"), F.col(gold).alias("_gold"), same(F.col(said), F.col(gold)).alias(name))
    return rows.join(read, F.col(said).eqNullSafe(F.col("_said")) & F.col(gold).eqNullSafe(F.col("_gold"))).drop("_said", "_gold")


def checked(prediction: Column, answer: Column, options: Column, prefetch: bool = False) -> Column:
    """The check of an answer. With options the rules pick a letter (which ``prefetch`` gives as it is); an open answer is compared whole.

    ``prefetch`` gives the picked answer, null where there is none; else whether it is right.
    """
    from quernel.functions import text as T

    picked = F.when(F.size(options) > 0, T.infer_option(prediction, options)).otherwise(prediction)
    right = F.coalesce(same(picked, answer), F.lit(False))
    return F.when(F.size(options) > 0, picked).when(right, picked) if prefetch else right
