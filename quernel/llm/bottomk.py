"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the distinct ``words``-word shingles of its words (ASCII letters small), as 64-bit hashes; its sketch
is the ``k`` smallest of them. All work is on distinct sets: documents with equal sets are one class.

1. Screen. Inverted lists of retained values find the sets that can have a partner at all. Two sets with Jaccard similarity of at
   least ``similarity`` share at least ``o`` retained values, for sets no larger than ``k`` surely, and for larger ones but for a chance
   below ``LOSS`` a pair. So, with each sketch in one common order, rare values first, both have a shared value
   among their first ``size - o + 1`` (a prefix filter): only these enter lists, and a passage that a third
   of all documents share stays out of the lists of documents that have enough else.
2. Lists. Sets that pass retain all their values. Of a pair, the smaller set of n values has the first shared value among its first
   ``n - overlap(n, n) + 1``, the larger one among its first ``n - ceil(similarity * n) + 1``: a list counts only if a member of the first kind is
   in it. Values that no other set has come first in the order, so members of a group that all lie just under the threshold, each with
   some words of its own, meet in no list: their prefixes are used up. (With sketches of 512 values, whose bounds must allow for chance, every pair
   of such a group was a candidate.) At the first value that two sets share, neither may be so far down
   its order that too few values are left (a positional filter).
3. Stars. A list never gives all its pairs. First each list links its members to its first one; then, where members
   of a list are still in different components, to another one drawn for each list. Components are joined after each round.
4. The rest. Members of a list that are still in different components are candidates if one of them is of the first kind, and their sizes, their places in the
   list and the bitmaps of their sets allow the similarity: the bits that differ between two parity
   bitmaps are never more than the values that differ between the sets. Lists of more than ``SPLIT`` members are split by
   salts, so none is one task's. No link between components is lost.

Candidates are kept if the sketch of their union (its ``k`` smallest values, and how many of these both have) allows the
similarity; then the full sets decide: ``100 * intersection >= percent * union``.

Components spread the smallest doc_id over links by repeated joins, each round written to the shared folder.
No step gathers links, components or sketches on the driver. Tables that the result does not read are removed.

Defined cases: a document without words, or with a null or empty text, has an empty set and is linked with nothing;
one with fewer words than a shingle has one shingle of all its words; rows that repeat a doc_id are one document, which has
the links of all its texts, and share a component; a row whose doc_id is null is linked with nothing; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm._shared import BLANKS, batches_of, files_for, holds, remove, task, utf8, written

K = 64
#: A table of ids is broadcast up to so many rows (16 bytes each); beyond it, the join shuffles.
BROADCAST_ROWS = 2_000_000
#: The chance that a pair of the least similarity is not seen in the lists.
LOSS = 1e-12
#: Members of a list that meet in one part of it.
SPLIT = 512
#: Documents that a file of any table stands for. Small tables in many partitions are put together to few files.
FILE_DOCUMENTS = 100_000
#: Bits of the bitmap of a whole set.
BITMAP = 1024
#: Bytes of texts that are hashed at a time; a longer text is hashed in pieces cut at blanks.
BATCH = 400_000
DIGESTS = "doc_id long, n_shingles long, digest binary, sketch array<long>"
WHOLE_SETS = f"{DIGESTS}, bits array<long>"

FOLD = np.frombuffer(bytes(range(256)).lower(), np.uint8)
SOLID = ~np.isin(np.arange(256), BLANKS)
ODD = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
TURNS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(TURNS[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(TURNS[1])
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of some texts, and where each text's words begin and end among them."""
    raw = FOLD[raw]
    solid = SOLID[raw]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    edges = ends[(ends > 0) & (ends < len(raw))]
    begins[edges] = solid[edges]
    stops[edges - 1] = solid[edges - 1]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    sizes = np.flatnonzero(stops) + 1 - first
    kept = raw[solid]
    at = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.full(int(sizes.max()), STEP, np.uint64))
    sums = np.add.reduceat(ODD[kept] * powers[np.arange(len(kept)) - np.repeat(at, sizes)], at)
    return mixed(sums ^ (sizes.astype(np.uint64) * STEP)), np.searchsorted(first, ends)


def pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """One long text in pieces of about BATCH bytes, cut at blanks."""
    begin = 0
    while begin < len(raw):
        end = begin + BATCH
        while end < len(raw) and SOLID[raw[end]]:
            ahead = np.flatnonzero(~SOLID[raw[end : end + BATCH]])
            end += int(ahead[0]) if len(ahead) else BATCH
        yield raw[begin : min(end, len(raw))]
        begin = end


def shingle_sets(raw: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    if len(ends) == 2 and len(raw) > BATCH:
        hashes = np.concatenate([word_hashes(p, np.array([0, len(p)]))[0] for p in pieces(raw)])
        cuts = np.array([0, len(hashes)])
    else:
        hashes, cuts = word_hashes(raw, ends)
    runs = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        runs = mixed(runs * STEP + hashes[k : k + len(runs)] + np.uint64(k + 1))
    out = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            few = np.uint64(b - a)
            whole = np.zeros(1, np.uint64)
            for h in hashes[a:b]:
                whole = mixed(whole * STEP + h + few)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_shared(k: int, similarity: float) -> int:
    """How many of a union's k smallest values both sets of a pair of this similarity have, but for a chance of LOSS."""
    chance, o = 0.0, 0
    for i in range(k + 1):
        chance += math.comb(k, i) * similarity**i * (1 - similarity) ** (k - i)
        if chance > LOSS:
            break
        o = i + 1
    return max(1, o)


def digest_of(values: np.ndarray) -> bytes | None:
    """What tells a set from others; None for the empty set."""
    return xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None


def bitmap(values: np.ndarray) -> np.ndarray:
    """For each remainder modulo BITMAP, whether an odd number of values have it."""
    counts = np.bincount((values % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def sketch_batches(batches: Iterator[pa.RecordBatch], words: int, k: int | None, bits: bool = False) -> Iterator[pa.RecordBatch]:
    holds("bottomk")
    for batch in (part for whole in batches for part in batches_of(whole, "text", BATCH)):
        sets = shingle_sets(*utf8(batch.column("text")), words)
        columns = {
            "doc_id": batch.column("doc_id"),
            "n_shingles": pa.array(map(len, sets), pa.int64()),
            "digest": pa.array(map(digest_of, sets), pa.binary()),
            # signed numbers in the order of the unsigned ones
            "sketch": pa.array([(s[:k] ^ np.uint64(2**63)).view(np.int64) for s in sets], pa.list_(pa.int64())),
        }
        if bits:
            columns["bits"] = pa.array(map(bitmap, sets), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_pydict(columns)


def digest_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows with the digests of their texts' sets added."""
    for batch in (part for whole in batches for part in batches_of(whole, "text", BATCH)):
        digests = map(digest_of, shingle_sets(*utf8(batch.column("text")), words))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, "digest"])


class NearDuplicates:
    """One run over a table of documents.

    A class has a number: its smallest doc_id, or, where rows repeat a doc_id, a number of its digest.
    """

    def __init__(self, docs: DataFrame, words: int, similarity: float, k: int, id_col: str, text_col: str):
        self.words, self.similarity, self.k = words, similarity, k
        self.percent = round(100 * similarity)
        #: Tables that are removed before the result is given.
        self.paths: list[str] = []
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.files = files_for(docs.sparkSession, self.docs.select("doc_id").count(), FILE_DOCUMENTS)
        self.digests = written(self.docs.mapInArrow(task(sketch_batches, words, k), DIGESTS).coalesce(self.files), "sketches")
        known = self.digests.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
        # equal sets have equal sketches and sizes
        classes = known.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        self.repeats = known.count() > known.select("doc_id").distinct().count()
        self.classes = written(classes.withColumn("rep", self.number(classes)).coalesce(self.files), "classes")

    def number(self, classes: DataFrame) -> F.Column:
        """The number of a class. No two have the same: a seed under which digests collide is passed over."""
        if not self.repeats:
            return F.col("least")
        seed, total = 0, classes.count()
        while classes.select(F.xxhash64(F.lit(seed), "digest")).distinct().count() < total:
            seed += 1
        return F.xxhash64(F.lit(seed), "digest")

    def write(self, rows: DataFrame, name: str) -> DataFrame:
        """A table for this run alone."""
        return written(rows.coalesce(self.files), name, self.paths)

    def prefixes(self, classes: DataFrame, size: F.Column, longest: F.Column, shorter: F.Column) -> DataFrame:
        """(value, rep, n, place, first): each class under the rarest values of its sketch that a similar one may share first.

        ``longest`` is how many there are beside any partner, ``shorter`` how many beside larger ones (``first`` tells which these are).
        """
        values = classes.select("rep", "n", F.explode("sketch").alias("value"))
        shared = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
        listed = values.join(shared, "value").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
        # the values that no other class has come first in the common order
        alone = size - F.size("values")
        cut = F.slice("values", 1, F.greatest(F.lit(0), longest - alone).cast("int"))
        prefix = listed.select("rep", "n", alone.alias("alone"), shorter.alias("shorter"), F.posexplode(cut).alias("at", "v"))
        place = F.col("alone") + F.col("at")
        prefix = self.write(prefix.select(F.col("v.value").alias("value"), "rep", "n", place.alias("place"), (place < F.col("shorter")).alias("first")), "postings")
        busy = prefix.groupBy("value").agg(F.count("*").alias("members"), F.max("first").alias("some")).filter("members > 1 AND some").select("value")
        return self.write(prefix.join(busy, "value", "left_semi"), "lists")

    def screen(self) -> DataFrame:
        """The classes that their sketches leave with a possible partner."""
        size = F.least(F.col("n"), F.lit(self.k))
        least = F.greatest(F.lit(1), F.least(F.lit(least_shared(self.k, self.similarity)), F.ceil(F.col("n") * self.percent / 100 - 1e-9)))
        length = size - least + 1
        return self.write(self.prefixes(self.classes, size, length, length).select("rep").distinct(), "survivors")

    def lists(self, sets: DataFrame) -> DataFrame:
        """The inverted lists of whole sets."""
        n = F.col("n")
        return self.prefixes(sets, n, n - F.ceil(n * self.percent / 100 - 1e-9) + 1, n - self.overlap(n, n) + 1)

    def texts(self, reps: DataFrame) -> DataFrame:
        """(rep, text): a text of each of some classes."""
        short = F.broadcast if reps.count() <= BROADCAST_ROWS else lambda ids: ids
        members = self.classes.select("rep", "least", "digest").join(short(reps), "rep", "left_semi")
        if not self.repeats:
            return self.docs.join(short(members.select("rep", F.col("least").alias("doc_id"))), "doc_id").select("rep", "text")
        # of a document's texts, those of the class
        met = self.docs.join(short(members.select(F.col("least").alias("doc_id")).distinct()), "doc_id", "left_semi")
        marked = met.mapInArrow(task(digest_batches, self.words), "doc_id long, text string, digest binary")
        return marked.join(members.withColumnRenamed("least", "doc_id"), ["doc_id", "digest"]).dropDuplicates(["rep"]).select("rep", "text")

    def sets(self) -> DataFrame:
        """The classes that pass the screen, with all their values (in the order of sketches) and bitmaps."""
        texts = self.texts(self.screen()).withColumnRenamed("rep", "doc_id")
        again = texts.mapInArrow(task(sketch_batches, self.words, None, True), WHOLE_SETS)
        return self.write(again.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sketch", "bits"), "sets")

    def possible(self, n_a: str, place_a: str, n_b: str, place_b: str):
        """Whether two sets whose first shared value has these places can be similar enough."""
        a, b = F.col(n_a), F.col(n_b)
        return self.sized(n_a, n_b) & (F.least(a - F.col(place_a), b - F.col(place_b)) >= self.overlap(a, b))

    def overlap(self, a: F.Column, b: F.Column) -> F.Column:
        """How many values similar sets of two sizes share at least."""
        return F.ceil((a + b) * self.percent / (100 + self.percent) - 1e-9)

    def sized(self, a: str, b: str):
        """Whether two sizes allow the similarity."""
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b), those that the sketches of their unions and then the full sets confirm."""
        sketches = sets.select("rep", F.slice("sketch", 1, self.k).alias("sketch"))
        with_a = pairs.join(sketches.withColumnsRenamed({"rep": "a", "sketch": "s_a"}), "a")
        both = with_a.join(sketches.withColumnsRenamed({"rep": "b", "sketch": "s_b"}), "b")
        union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, self.k)
        shared = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
        least = F.least(F.lit(least_shared(self.k, self.similarity)), F.ceil(F.size(union) * self.percent / 100 - 1e-9))
        likely = self.write(both.filter(shared >= least).select("a", "b"), "likely")
        whole = sets.select("rep", "sketch")
        full = likely.join(whole.withColumnsRenamed({"rep": "a", "sketch": "s_a"}), "a").join(whole.withColumnsRenamed({"rep": "b", "sketch": "s_b"}), "b")
        full = full.select("a", "b", F.size("s_a").alias("n_a"), F.size("s_b").alias("n_b"), F.size(F.array_intersect("s_a", "s_b")).alias("both"))
        return self.write(full.filter((F.col("both") > 0) & (100 * F.col("both") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("both")))).select("a", "b"), "links")

    def open_lists(self, lists: DataFrame, labels: DataFrame) -> DataFrame:
        """The lists whose members are in more than one component, with the members' components."""
        marked = lists.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed_lists = marked.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("value")
        return self.write(marked.join(mixed_lists, "value", "left_semi"), "open")

    def star(self, lists: DataFrame, drawn: bool) -> DataFrame:
        """Pairs of each list's centre with its other members. ``drawn``: the centre differs from list to list."""
        order = F.xxhash64("value", "rep") if drawn else F.lit(0).cast("long")
        centres = lists.groupBy("value").agg(F.min(F.struct(order.alias("order"), F.col("rep").alias("rep"), F.col("n").alias("n"), F.col("place").alias("place"), F.col("component").alias("component"))).alias("c"))
        joined = lists.join(centres, "value").filter((F.col("c.rep") != F.col("rep")) & (F.col("c.component") != F.col("component")) & self.possible("c.n", "c.place", "n", "place"))
        return joined.select(F.least("c.rep", "rep").alias("a"), F.greatest("c.rep", "rep").alias("b")).distinct()

    def rest(self, lists: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs of members of a list that are in different components and may be similar enough."""
        parts = lists.groupBy("value").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"))
        whole = self.write(lists.join(parts, "value").join(sets.select("rep", "bits"), "rep"), "rest")
        width = math.log(100 / self.percent) * (1 + 1e-9)
        step = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
        named = lambda x: {"rep": f"{x}", "n": f"n_{x}", "component": f"c_{x}", "place": f"p_{x}", "bits": f"bits_{x}"}
        # the smaller set is in one part of a list, the larger one in all
        left = whole.filter("first").drop("first").withColumn("step", step).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts").withColumnsRenamed(named("a"))
        # the larger of two similar sets is in the same step or the next one
        right = whole.withColumn("step", F.explode(F.array(step - 1, step))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "first").withColumnsRenamed(named("b"))
        differ = sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(BITMAP // 64)), F.lit(0))
        fit = differ <= F.col("n_a") + F.col("n_b") - 2 * self.overlap(F.col("n_a"), F.col("n_b"))
        once = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
        met = left.join(right, ["value", "step", "part"]).filter(once & (F.col("c_a") != F.col("c_b")) & self.possible("n_a", "p_a", "n_b", "p_b") & fit)
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def components(self) -> DataFrame:
        """(rep, component) of the classes that have links; a component is its smallest class number."""
        spark = self.docs.sparkSession
        labels = spark.createDataFrame([], "rep long, component long")
        sets = self.sets()
        lists = self.lists(sets)
        links = self.shared_ids() if self.repeats else None
        if links is not None:
            labels = connected(links, self.files)
        for round_ in range(3):
            open_ = self.open_lists(lists, labels)
            if open_.isEmpty():
                break
            pairs = self.rest(open_, sets) if round_ == 2 else self.star(open_, drawn=round_ == 1)
            found = self.links(pairs, sets)
            links = found if links is None else links.union(found)
            labels = connected(links, self.files)
            lists = open_.drop("component")
        remove(spark, self.paths)
        return labels

    def shared_ids(self) -> DataFrame:
        """Links (a, b) between the classes of the texts of one document."""
        known = self.digests.filter(F.col("doc_id").isNotNull()).select("doc_id", "digest").distinct().join(self.classes.select("digest", "rep"), "digest")
        first = known.groupBy("doc_id").agg(F.min("rep").alias("a"))
        return self.write(known.join(first, "doc_id").filter(F.col("a") < F.col("rep")).select("a", F.col("rep").alias("b")).distinct(), "shared-ids")

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id and kept of every row."""
        labels = self.components()
        classes = self.classes.select("digest", "rep", "least").join(labels, "rep", "left").select("digest", "least", F.coalesce("component", "rep").alias("component"))
        if self.repeats:
            least = classes.groupBy("component").agg(F.min("least").alias("smallest"))
            classes = classes.join(least, "component").select("digest", F.col("smallest").alias("component"))
        out = self.digests.drop("sketch").join(classes.select("digest", "component"), "digest", "left")
        if self.repeats:
            # a row without words goes with the document's other rows
            by_id = out.filter(F.col("doc_id").isNotNull() & F.col("component").isNotNull()).groupBy("doc_id").agg(F.min("component").alias("other"))
            out = out.join(by_id, "doc_id", "left").withColumn("component", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "other")))
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def connected(links: DataFrame, files: int = 1) -> DataFrame:
    """(rep, component): the smallest number reachable over links (a, b).

    Each round every node's parent becomes the least label among it and its neighbours, then parents are followed;
    rounds go on until no label changes. Labels meet in sums of parts, so a node with very many links is no hot spot. A round
    writes one table, in so many ``files`` at most.
    """
    spark = links.sparkSession
    paths: list[str] = []
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    ends = written(both.coalesce(files), "ends", paths)
    labels = written(ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "rep").coalesce(files), "labels", last := [])
    while True:
        own: list[str] = []
        near = ends.join(labels.withColumnsRenamed({"rep": "b", "component": "other"}), "b").groupBy("a").agg(F.min("other").alias("least"))
        # a node's old parent may have learnt of a smaller one by another of its children
        hooked = labels.join(near.withColumnRenamed("a", "rep"), "rep").select("rep", F.col("component").alias("old"), F.least("component", "least").alias("new"))
        parents = hooked.groupBy("old").agg(F.min("new").alias("up")).withColumnRenamed("old", "new")
        jumped = hooked.join(parents, "new", "left").select("rep", "old", F.least("new", F.coalesce("up", "new")).alias("component"))
        jumped = written(jumped.coalesce(files), "jumped", own)
        labels = jumped.select("rep", "component")
        remove(spark, last)
        last = own
        if jumped.filter("component < old").isEmpty():
            remove(spark, paths)
            return labels


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included) and kept."""
    return NearDuplicates(docs, words, similarity, k, id_col, text_col).result()
