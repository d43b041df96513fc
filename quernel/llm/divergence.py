"""Audit of how far the sources of a language differ in their vocabulary.

Terms are runs of letters (ASCII letters, A-Z made small, and everything outside ASCII). A language keeps the V terms that stand
in at least ``least`` of its documents. A group (language and source, or a language as a whole) with N occurrences of kept terms gives
a term that it holds n times the share ``p = 1 + floor(10^9 (n + 2) / (N + 2 V))``, and two shares differ by
``f = floor((p - q)^2 / (p + q))``. All of this is integer arithmetic.

Two sources are compared over all kept terms, but most terms stand in few sources. So a pair of sources starts at V times f of
their shares of an absent term, and the inverted index (a term's postings: the sources that hold it) brings corrections only:

* a posting (A, n) changes f against each source B by ``f(p, q0) - f(p0, q0)`` as if B lacked the term. This depends on n alone, so the
  postings of A are counted by their share first, and each count meets B's absent share once;
* two postings of a term add what is left, ``f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)``. Postings lie in blocks of ``BLOCK``
  sources, so no list grows with the number of sources; corrections of zero are dropped and the others are summed before they are shuffled.

The result has a row for each ordered pair of sources of a language (that is its size: the number of sources squared) and the
``top`` terms of each source that it holds more often than its language does.

Defined cases: null text, language and source are ''; a text without terms makes its group occur all the same; a language without kept
terms has pairs of value 0 and no terms; rows that repeat count each; equal values rank by item in order of its UTF-8 bytes; an empty table
gives no rows. Other columns are not read. A text above ``SLICE`` bytes is counted piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm._shared import batches_of, holds, small_side, task, utf8, written

LEAST = 10
TOP = 10
#: Bytes of text that are cut into terms at once.
SLICE = 4_000_000
#: Sources whose postings of a term form one list.
BLOCK = 64
#: Rows of (language, source) up to which their sizes are broadcast; beyond that the join shuffles.
BROADCAST_GROUPS = 200_000

LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
SMALL = np.frombuffer(bytes(range(256)).lower(), np.uint8)
COUNTED = "lang string, source string, term string, n long, n_docs long"
COUNTED_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])


def terms_of(raw: np.ndarray, cuts: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of a buffer that holds several texts, and the number of each term's text."""
    letter = LETTER[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = letter[:-1]
    before[cuts[:-1][cuts[:-1] < len(raw)]] = False
    starts = np.flatnonzero(letter & ~before)
    held = np.cumsum(letter)
    offsets = np.append(held[starts] - 1, held[-1] if len(held) else 0).astype(np.int64)
    data = SMALL[raw[letter]]
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    return terms.dictionary_encode(), np.searchsorted(cuts, starts, side="right") - 1


def pieces(raw: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Parts of a long text, cut behind a byte that is no letter."""
    at = 0
    while at < len(raw):
        end = min(at + limit, len(raw))
        while end < len(raw) and LETTER[raw[end - 1]]:
            gap = np.flatnonzero(~LETTER[raw[end : end + limit]])
            end = min(end + (int(gap[0]) + 1 if len(gap) else limit), len(raw))
        yield raw[at:end]
        at = end


def counted(raw: np.ndarray, cuts: np.ndarray, limit: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts (one, if it is long): the distinct terms, and for each text and term of it their numbers and the occurrences."""
    if len(cuts) == 2 and len(raw) > limit:
        found = [terms_of(part, np.array([0, len(part)]))[0].value_counts() for part in pieces(raw, limit)]
        table = pa.table({"term": pa.chunked_array([x.field(0).dictionary_decode() for x in found], pa.large_string()), "n": pa.chunked_array([x.field(1) for x in found], pa.int64())})
        table = table.group_by("term").aggregate([("n", "sum")])
        return table.column("term").combine_chunks(), np.zeros(len(table), np.int64), np.arange(len(table)), table.column("n_sum").to_numpy()
    terms, text = terms_of(raw, cuts)
    size = max(1, len(terms.dictionary))
    pairs, times = np.unique(text * size + terms.indices.to_numpy(), return_counts=True)
    return terms.dictionary, pairs // size, pairs % size, times


def count_batches(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each language, source and term, summed over a slice."""
    holds("divergence")
    for batch in (part for whole in batches for part in batches_of(whole, "text", limit)):
        langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        groups = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
        terms, text, term, times = counted(*utf8(batch.column("text")), limit)
        if not len(terms):
            continue
        keys, place = np.unique(groups[text] * len(terms) + term, return_inverse=True)
        own, term = keys // len(terms), pa.array(keys % len(terms))
        lang, source = (pa.array(x) for x in np.divmod(own, max(1, len(sources.dictionary))))
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, place, times)
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(lang), sources.dictionary.take(source), pc.cast(terms.take(term), pa.string()), pa.array(sums), pa.array(np.bincount(place, minlength=len(keys)))], schema=COUNTED_ARROW
        )


def share(count: str, size: str, kept: str) -> Column:
    """p of a group; decimals, as ten digits more than a count would leave a long."""
    return F.expr(f"1L + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(19, 0))) div CAST(greatest({size} + 2 * {kept}, 1L) AS DECIMAL(20, 0))")


def differ(p: str, q: str) -> str:
    """f of two shares: shares are below 2^31, so their squares fit in a long."""
    return f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))"


def index(docs: DataFrame, least: int, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source, place in the language, sources of it, V, share of an absent term) and the postings of kept terms."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    groups = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_rows"))
    counts = written(rows.mapInArrow(task(count_batches), COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs")).filter(F.col("n_docs") >= least)
    postings = written(counts.drop("n_docs").join(kept.drop("n_docs"), ["lang", "term"]), "postings")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_size"))
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    of_lang = Window.partitionBy("lang")
    groups = (
        groups.join(sizes, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .fillna(0, ["size", "kept", "lang_size"])
        .select(
            "lang", "source", "size", "kept", "lang_size", share("0L", "size", "kept").alias("p0"),
            (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"), F.count(F.lit(1)).over(of_lang).alias("n_sources"),
        )
    )
    return written(groups, "groups"), postings


def corrections(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """What ordered pairs of places of a language add to V times f of absent terms: lang, a, b, value; a pair has several rows."""
    side = groups.select("lang", F.col("place").alias("b"), F.col("p0").alias("q0"))
    by_share = postings.groupBy("lang", "place", "p0", "p").agg(F.count(F.lit(1)).alias("terms"))
    one = (
        by_share.withColumnRenamed("place", "a")
        .join(side, "lang")
        .filter("a != b")
        .select("lang", "a", "b", F.expr(f"terms * ({differ('p', 'q0')} - {differ('p0', 'q0')})").alias("value"))
        .filter("value != 0")
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )
    lists = postings.groupBy("lang", "n_sources", "term", F.expr(f"place div {BLOCK}").alias("block")).agg(F.collect_list(F.struct("place", "p", "p0")).alias("held"))
    inside = lists.select("lang", F.explode("held").alias("x"), "held").select("lang", "x", F.explode("held").alias("y")).filter("x.place < y.place")
    wide = lists.filter(F.col("n_sources") > BLOCK).drop("n_sources")
    across = wide.join(wide.select("lang", "term", F.col("block").alias("later"), F.col("held").alias("others")), ["lang", "term"]).filter("block < later")
    across = across.select("lang", F.explode("held").alias("x"), "others").select("lang", "x", F.explode("others").alias("y"))
    both = (
        inside.unionByName(across)
        .select(
            "lang", F.col("x.place").alias("a"), F.col("y.place").alias("b"),
            F.expr(f"{differ('x.p', 'y.p')} - {differ('x.p', 'y.p0')} - {differ('x.p0', 'y.p')} + {differ('x.p0', 'y.p0')}").alias("value"),
        )
        .filter("value != 0")
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )
    half = one.unionByName(both)
    return half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank of all pairs of sources and of the ``top`` terms of each source."""
    groups, postings = index(docs, least, text_col, lang_col, source_col)
    shared = written(
        postings.join(small_side(groups, BROADCAST_GROUPS), ["lang", "source"])
        .withColumn("p", share("n", "size", "kept"))
        .select("lang", "source", "term", "place", "n_sources", "p", "p0", share("lang_n", "lang_size", "kept").alias("q")),
        "shares",
    )
    left = groups.select("lang", F.col("place").alias("a"), F.col("source").alias("source"), "p0", "kept")
    right = groups.select("lang", F.col("place").alias("b"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    start = left.join(right, "lang").filter("a != b").select("lang", "a", "b", "source", "item", F.expr(f"kept * ({differ('p0', 'q0')})").alias("value"))
    changes = corrections(groups, shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("change"))
    pairs = start.join(changes, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + F.coalesce("change", F.lit(0))).alias("value"))
    terms = shared.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(differ("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
