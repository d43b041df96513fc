"""Quality classifier by importance resampling.

Target text (labelled good and not toxic) and raw text (all documents) each get a generative model: a multinomial over hashed
n-grams (a run of letters and digits or of signs, or a pair of neighbours), from the counts of the n-grams, with ``ALPHA`` added to
each bucket of the raw model and the same share of its total to each of the target's. A document's log weight is the log of
the ratio of its likelihoods, ``sum(count * log(target share / raw share))`` over all its n-grams. A text of the target is taken off
the target's model before it is scored: that model would else favour the texts that it was made from. The raw model is that of all texts.

Adding Gumbel noise to the log weights and taking the ``k`` largest keys draws ``k`` documents without replacement, with chances in the
ratio of the weights; by default ``k`` is the target's share of the labelled documents, times all documents.

Counts cover all documents: each split sends a row for each n-gram bucket that it met, and the buckets are summed.
The k-th key is found by histograms: keys are counted by bins, and only the bin that holds the k-th is counted
again, by finer bins.

Defined cases: a text that is null or has no n-gram has log weight null and comes last; ties of the key are
broken by a hash of the text; rows that repeat a document have the same key and are kept in any order among them; without a
labelled target all weights are 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm._shared import BLANKS, batches_of, holds, scratch, task, utf8, written

BITS = 18
ALPHA = 20.0
SEED = 17
BATCH = 500_000
BROADCAST_ROWS = 2_000_000
BINS = 4096

FOLD = np.frombuffer(bytes(range(256)).lower(), np.uint8)
KIND = np.array([0 if b in BLANKS else 1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
ODD = np.random.default_rng(3).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each text's n-grams (first the single ones, then the pairs, in tables of their own), and their bounds.

    The bounds hold, for each text, where its buckets begin and end.
    """
    raw = FOLD[raw]
    kind = KIND[raw]
    begins = kind > 0
    begins[1:] &= kind[1:] != kind[:-1]
    edges = ends[(ends > 0) & (ends < len(raw))]
    begins[edges] = kind[edges] > 0
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    spans = np.diff(np.append(first, len(raw)))
    places = np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans, spans)
    powers = np.cumprod(np.full(int(spans.max()), STEP, np.uint64))
    body = raw[first[0] :]
    values = np.where(kind[first[0] :] > 0, ODD[body] * powers[places], np.uint64(0))
    hashes = np.add.reduceat(values, first - first[0])
    hashes = (hashes ^ (hashes >> np.uint64(29))) * STEP
    cuts = np.searchsorted(first, ends)
    single = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    pairs = hashes * ODD[0]
    pairs[:-1] += hashes[1:]
    pairs = ((pairs ^ (pairs >> np.uint64(31))) * STEP >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)
    alone = np.zeros(len(single), bool)
    alone[cuts[1:][cuts[1:] > cuts[:-1]] - 1] = True
    both = np.stack([single, np.where(alone, -1, pairs)], 1)
    return both.ravel(), 2 * cuts


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a whole split holds each bucket: (bucket, raw, target)."""
    raw_counts, target = np.zeros(2 << BITS, np.int64), np.zeros(2 << BITS, np.int64)
    for batch in (part for whole in batches for part in batches_of(whole, "text", BATCH)):
        wanted = batch.column("wanted").to_numpy(zero_copy_only=False).astype(bool)
        buckets, cuts = grams(*utf8(batch.column("text")))
        there = buckets >= 0
        raw_counts += np.bincount(buckets[there], minlength=2 << BITS)
        target += np.bincount(buckets[there & np.repeat(wanted, np.diff(cuts))], minlength=2 << BITS)
    met = np.flatnonzero(raw_counts)
    yield pa.RecordBatch.from_pydict({"bucket": met, "raw": raw_counts[met], "target": target[met]})


class Models:
    """The counts of each n-gram bucket in all texts and in the target's."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        self.raw, self.target = raw, target
        self.sizes = raw.sum(), target.sum()

    def log_weights(self, buckets: np.ndarray, cuts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The log weight of each text, NaN without n-grams."""
        size = len(cuts) - 1
        rows = np.repeat(np.arange(size), np.diff(cuts))
        pairs, counts = np.unique((rows << (BITS + 1) | buckets)[buckets >= 0], return_counts=True)
        rows, found = pairs >> (BITS + 1), pairs & ((2 << BITS) - 1)
        lengths = np.bincount(rows, counts, size)
        # the target's model without the text itself
        share = (self.sizes[1] - lengths * wanted) / max(1.0, self.sizes[0])
        per_row = ALPHA * share[rows]
        own = counts * wanted[rows]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratios = np.log((self.target[found] - own + per_row) / (self.raw[found] + ALPHA) / share[rows])
        sums = np.bincount(rows, np.where(share[rows] > 0, counts * ratios, 0.0), size)
        return np.where(lengths > 0, sums, np.nan)


_COUNTS: dict[str, Models] = {}


def counts_at(path: str) -> Models:
    if path not in _COUNTS:
        store, base = pafs.FileSystem.from_uri(path)
        with store.open_input_stream(base) as file:
            values = np.frombuffer(file.read(), np.float64)
        _COUNTS.clear()
        _COUNTS[path] = Models(values[: 2 << BITS], values[2 << BITS :])
    return _COUNTS[path]


def score_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    holds("resample", _COUNTS)
    counts = counts_at(path)
    for batch in (part for whole in batches for part in batches_of(whole, "text", BATCH)):
        buckets, cuts = grams(*utf8(batch.column("text")))
        weights = counts.log_weights(buckets, cuts, batch.column("wanted").to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("noise"), batch.column("tie"), pa.array(weights, pa.float64(), from_pandas=True)], ["doc_id", "noise", "tie", "log_weight"])


def kth(rows: DataFrame, column: str, k: int, floating: bool) -> tuple:
    """The k-th largest value of a column without nulls, and how many rows are above it."""
    value, above = F.col(column), 0
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        inside = rows.filter(value.between(F.lit(low), F.lit(high)))
        if floating:
            number = F.least(F.floor((value / BINS - F.lit(low / BINS)) / F.lit((high / BINS - low / BINS) / BINS)), F.lit(BINS - 1))
        else:
            width = -(-(high - low + 1) // BINS)
            number = F.floor((value.cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)"))
        bins = inside.groupBy(number.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).orderBy(F.desc("bin")).collect()
        for found in bins:
            if above + found.n >= k:
                break
            above += found.n
        if (found.low, found.high) == (low, high):
            # neighbouring numbers that no bin can part
            parts = inside.groupBy(column).count().orderBy(F.desc(column)).collect()
            for value_, n in parts:
                if above + n >= k:
                    return value_, above
                above += n
        low, high = found.low, found.high
    return low, above


def largest(keyed: DataFrame, k: int) -> DataFrame:
    """Add ``kept``: whether a row is among the k largest by key, then by tie. Null keys come last."""
    whole = keyed.withColumn("order", F.coalesce("key", F.lit(-1e300)))
    if k <= 0 or whole.isEmpty():
        return keyed.withColumn("kept", F.lit(False))
    edge, above = kth(whole, "order", k, True)
    edge_tie, _ = kth(whole.filter(F.col("order") == edge), "tie", k - above, False)
    kept = (F.col("order") > edge) | ((F.col("order") == edge) & (F.col("tie") >= edge_tie))
    return whole.withColumn("kept", kept).drop("order")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, key and kept. ``labels``: doc_id, quality and toxic; ``share`` of all rows is kept."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(good.cast("int")).alias("good"))
    n_marks, n_good = marks.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    wanted = marks.filter("good = 1").select("doc_id", F.lit(True).alias("wanted"))
    if n_good <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    marked = source.join(wanted, "doc_id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    counts = marked.select("text", "wanted").mapInArrow(task(count_batches), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    # 2**(BITS + 1) rows at most, whatever the corpus holds
    found = counts.toPandas()
    raw, target = np.zeros(2 << BITS), np.zeros(2 << BITS)
    raw[found.bucket], target[found.bucket] = found.raw, found.target
    path = scratch(spark, "ngram-counts")
    store, base = pafs.FileSystem.from_uri(path)
    store.create_dir(base.rpartition("/")[0], recursive=True)
    with store.open_output_stream(base) as file:
        file.write(np.concatenate([raw, target]).tobytes())
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    noise = -F.log(-F.log(unit))
    kind = source.schema["doc_id"].dataType.simpleString()
    prepared = marked.select("doc_id", "text", "wanted", noise.alias("noise"), F.xxhash64("text").alias("tie"))
    scored = prepared.mapInArrow(task(score_batches, path), f"doc_id {kind}, noise double, tie long, log_weight double")
    keyed = written(scored.select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("key"), "tie"), "resample-keys")
    rows = keyed.count()
    if share is None:
        share = n_good / n_marks if n_marks else 1.0
    return largest(keyed, round(share * rows)).select("doc_id", "log_weight", "key", "kept")
