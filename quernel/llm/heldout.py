"""Figures of the trained operators on rows that they have not seen: ``python -m quernel.llm.heldout DIR...``

Resampling is fitted on half of the labels (by a hash of the id) and measured on the other half: the shares kept of clean documents, of good
ones that are toxic, and of bad ones. Language ID is measured on its held-out documents. Near-duplicates are compared with all pairs of sets.
"""

from __future__ import annotations

import json
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quernel.llm import bottomk, langcrf, resample
from quernel.llm._shared import utf8
from quernel.llm.entries import table


def resampling(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    labels = table(spark, sf_dir, "labels")
    seen = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)) == 0
    kept = resample.resample(table(spark, sf_dir, "documents"), labels.filter(seen)).select("doc_id", "kept")
    kind = F.when(F.col("quality") == 0, "bad").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    rows = labels.filter(~seen).join(kept, "doc_id").groupBy(kind.alias("kind")).agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    return {r.kind: round(r.share, 3) for r in rows}


def languages(spark: SparkSession, sf_dir: str) -> float:
    docs = table(spark, sf_dir, "documents")
    found = langcrf.identify(docs, langcrf.train(docs)).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred != 'und'")
    return round(found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0], 4)


def all_links(texts: list[str | None], words: int, percent: int) -> list[tuple[int, int]]:
    """All pairs of distinct sets that are similar, by the places of a text of each: each set against all sets of fitting sizes.

    Bitmaps pass over most pairs (the bits that differ are never more than the values), full sets decide. For tables that fit in memory.
    """
    sets = [bottomk.shingle_sets(*utf8(pa.array([t], pa.string())), words)[0] for t in texts]
    first = {digest: k for k in range(len(sets) - 1, -1, -1) if (digest := bottomk.digest_of(sets[k])) is not None}
    order = sorted(first.values(), key=lambda k: len(sets[k]))
    sizes = np.array([len(sets[k]) for k in order])
    bits = np.stack([bottomk.bitmap(sets[k]) for k in order]) if order else np.zeros((0, 16), np.int64)
    out = []
    for i in range(len(order)):
        end = int(np.searchsorted(sizes, sizes[i] * 100 / percent, side="right"))
        apart = np.bitwise_count(bits[i] ^ bits[i + 1 : end]).sum(1)
        least = np.ceil((sizes[i] + sizes[i + 1 : end]) * percent / (100 + percent) - 1e-9)
        for j in (np.flatnonzero(apart <= sizes[i] + sizes[i + 1 : end] - 2 * least) + i + 1).tolist():
            both = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                out.append((order[i], order[j]))
    return out


def recall(spark: SparkSession, sf_dir: str, words: int = 3, similarity: float = 0.85) -> tuple[int, float]:
    """How many similar pairs of distinct sets there are, and the share of them that are in one component."""
    docs = table(spark, sf_dir, "documents")
    component = {r.doc_id: r.component_id for r in bottomk.near_duplicates(docs, words, similarity).select("doc_id", "component_id").collect()}
    rows = docs.select("doc_id", "text").collect()
    links = all_links([r.text for r in rows], words, round(100 * similarity))
    met = sum(component[rows[a].doc_id] == component[rows[b].doc_id] for a, b in links)
    return len(links), met / max(1, len(links))


if __name__ == "__main__":
    from quernel.session import session, ship

    spark = ship(session())
    for sf_dir in sys.argv[1:]:
        print(json.dumps({"dir": sf_dir, "resampling_kept": resampling(spark, sf_dir), "language_accuracy": languages(spark, sf_dir), "near_duplicate_links_and_recall": recall(spark, sf_dir)}), flush=True)
