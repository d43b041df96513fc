"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and which ids stand for which.

A is a byte-level BPE of the tokenizers library over a blank and the text; B is a sentencepiece model with byte fallback, which adds that blank
itself. Both sequences of tokens are laid over the bytes of blank and text. Offsets where tokens of both end cut them into groups; an A and a B token whose byte
ranges end together are a link. A pair's count is the number of its links in the corpus.

Texts are cut in front of each blank that follows no white space. A's rules never join what stands before such a blank to it, and B has no piece with a blank behind
another sign (both are checked or tested), so each distinct segment of a slice is encoded once; a text's tokens are those of its segments. Ends are cumulated
sums of token lengths, common cuts their ``intersect1d``, groups come from ``searchsorted``, and links from a ``repeat`` of each cut by its A and B tokens.

Documents carry their distinct pairs with the number of links to a written table. Pairs are summed in two stages, the first salted by row, so a pair that
nearly all documents hold is no hot key. The counts are broadcast up to ``BROADCAST_PAIRS`` pairs, else the join shuffles.

Defined cases: texts that are null or empty, or whose A or B bytes differ from blank and text (those with U+2581, which B takes for a blank), have no
tokens: zeros and ''. Special tokens' strings are plain text. Rows that repeat are rows of their own and all count. Other columns are not read. A text above ``SLICE`` bytes is
worked on piece by piece. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernel.llm._shared import batches_of, holds, small_side, task, utf8, written

#: Bytes of text whose segments are encoded and aligned together.
SLICE = 6_000_000
#: Rows of a result's batch at most.
ROWS = 2_000
#: Parts of a pair's first sum.
SALTS = 16
#: Pairs of ids whose counts are broadcast (some 60 bytes each).
BROADCAST_PAIRS = 1_000_000
#: A link's code is A's id times this and B's id.
B_IDS = 1 << 32


class Side:
    """One tokenizer's ids as bytes, strings and lengths."""

    def __init__(self, pieces: list[bytes]):
        self.lengths = np.array([len(x) for x in pieces], np.int64)
        if not self.lengths.all():
            raise ValueError("an id stands for no byte")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.names = [b"%d" % k for k in range(len(pieces))]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, joined."""
        sizes = self.lengths[ids]
        return self.data[expand(self.starts[ids], sizes)]


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Tokenizers:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        signs = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        entries = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        self.a_side = Side([bytes(signs[c] for c in x) if all(c in signs for c in x) else x.encode() for x in entries])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(k) for k in range(len(self.b))]
        if any("▁" in x.lstrip("▁") for x in pieces):
            raise ValueError("a piece of B holds a blank behind another sign, so texts can't be cut at blanks")
        self.b_side = Side([bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(pieces)])

    def encode(self, segments: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For A and B: all ids, and each segment's number of ids. Every segment begins with a blank, and none is a blank alone."""
        found = [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)], self.b.encode([x[1:] for x in segments], num_threads=1)
        return tuple((np.fromiter((i for x in own for i in x), np.int64), np.fromiter(map(len, own), np.int64, len(own))) for own in found)


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _LOADED:
        _LOADED.clear()
        _LOADED[a_path, b_path] = Tokenizers(a_path, b_path)
    return _LOADED[a_path, b_path]


def cut_places(raw: np.ndarray) -> np.ndarray:
    """Where a segment may begin: at a blank behind a sign that is surely no white space, unless nothing but the text's end follows."""
    at = np.flatnonzero(raw[:-1] == 0x20)
    at = at[at > 0]
    one, two, three = (raw[np.maximum(at - k, 0)] for k in (1, 2, 3))
    ascii_sign = (one > 0x20) & (one < 0x7F)
    odd = (two == 0xC2) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE3) & (two == 0x80))
    return at[ascii_sign | ((one >= 0x80) & ~odd)]


class Aligned:
    """Texts (each with its blank in front) of one buffer, aligned; ``cuts`` has where each begins, and the end."""

    def __init__(self, both: Tokenizers, raw: np.ndarray, cuts: np.ndarray):
        places = cut_places(raw)
        edge = np.zeros(len(raw) + 1, bool)
        edge[cuts] = True
        starts = np.sort(np.concatenate([places[~edge[places + 1] & ~edge[places]], cuts[:-1]]))  # a blank that ends a text stays with what is before
        segments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        self.segment = segments.indices.to_numpy().astype(np.int64)
        self.first = np.searchsorted(starts, cuts)
        distinct = segments.dictionary
        (a_ids, n_a), (b_ids, n_b) = both.encode([x.decode() for x in distinct.to_pylist()])
        data, ends = utf8(distinct)
        sizes = np.diff(ends)
        right = np.ones(len(distinct), bool)
        for side, ids, counts in ((both.a_side, a_ids, n_a), (both.b_side, b_ids, n_b)):
            own = np.repeat(np.arange(len(distinct)), counts)
            right &= np.bincount(own, side.lengths[ids], minlength=len(distinct)).astype(np.int64) == sizes
            kept = right[own]
            same = side.bytes_of(ids[kept]) == data[expand(ends[:-1][right], sizes[right])]
            right[np.repeat(np.flatnonzero(right), sizes[right])[~same]] = False
        a_ids, b_ids = a_ids[np.repeat(right, n_a)], b_ids[np.repeat(right, n_b)]
        n_a, n_b = n_a * right, n_b * right
        a_ends, b_ends = np.cumsum(both.a_side.lengths[a_ids]), np.cumsum(both.b_side.lengths[b_ids])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)  # no token is empty
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        own = np.searchsorted(np.cumsum(sizes * right), common)  # the segment of each group
        a_from, b_from = np.searchsorted(a_ends, common), np.searchsorted(b_ends, common)
        a_there, b_there = np.searchsorted(a_ends, common, side="right") - a_from, np.searchsorted(b_ends, common, side="right") - b_from
        links = a_there * b_there
        cut = np.repeat(np.arange(len(common)), links)
        within = np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links, links)
        self.codes, self.code = np.unique(a_ids[a_from[cut] + within // b_there[cut]] * B_IDS + b_ids[b_from[cut] + within % b_there[cut]], return_inverse=True)
        self.right, self.n_a, self.n_b = right, n_a, n_b
        self.n_groups = np.bincount(own, minlength=len(distinct))
        self.n_links = np.bincount(own[cut], minlength=len(distinct))
        self.texts = self._texts(both, a_ids, b_ids, a_group, b_group)

    def _texts(self, both: Tokenizers, a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> list[bytes]:
        """Each distinct segment's groups as text."""
        a_names, b_names, n = both.a_side.names, both.b_side.names, int(self.n_groups.sum())
        a, b = [a_names[k] for k in a_ids.tolist()], [b_names[k] for k in b_ids.tolist()]
        a_at, b_at = np.searchsorted(a_group, np.arange(n + 1)).tolist(), np.searchsorted(b_group, np.arange(n + 1)).tolist()
        groups = iter([b"%b|%b" % (b",".join(a[a_at[k] : a_at[k + 1]]), b",".join(b[b_at[k] : b_at[k + 1]])) for k in range(n)])
        return [b";".join(islice(groups, k)) for k in self.n_groups.tolist()]

    def sums(self) -> tuple[np.ndarray, ...]:
        """For each text: whether its bytes are right, and its A tokens, B tokens, groups and links."""
        return tuple(
            np.diff(np.concatenate([[0], np.cumsum(x[self.segment])])[self.first]) for x in (~self.right, self.n_a, self.n_b, self.n_groups, self.n_links)
        )

    def text(self, k: int) -> bytes:
        """The groups of a text."""
        return b";".join(map(self.texts.__getitem__, self.segment[self.first[k] : self.first[k + 1]].tolist()))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text and pair of ids that it links: the text, the pair's code and the links."""
        sizes = self.n_links[self.segment]
        starts = np.concatenate([[0], np.cumsum(self.n_links)])[self.segment]
        text = np.repeat(np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)), sizes)
        width = max(1, len(self.codes))
        keys, times = np.unique(text * width + self.code[expand(starts, sizes)], return_counts=True)
        return keys // width, self.codes[keys % width], times


def with_blanks(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of a buffer, each with a blank in front."""
    out = np.full(len(raw) + len(cuts) - 1, 0x20, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(1, len(cuts)), np.diff(cuts))] = raw
    return out, cuts + np.arange(len(cuts))


def long_text(both: Tokenizers, raw: np.ndarray, limit: int, with_groups: bool) -> tuple:
    """One long text (with its blank), piece by piece: wrong pieces, sums, digest, pairs, and the groups if they are wanted."""
    places = cut_places(raw)
    sums, digest, codes, times, texts, at = np.zeros(5, np.int64), hashlib.sha256(), [], [], [], 0
    while at < len(raw):
        k = int(np.searchsorted(places, at + limit))
        end = int(places[k]) if k < len(places) else len(raw)
        part = Aligned(both, raw[at:end], np.array([0, end - at]))
        sums += np.array([x[0] for x in part.sums()])
        text = (b";" if at else b"") + part.text(0)
        digest.update(text)
        texts += [text] * with_groups
        _, code, n = part.pairs()
        code, place = np.unique(np.concatenate([*codes, code]), return_inverse=True)
        codes, times = [code], [np.bincount(place, np.concatenate([*times, n]), len(code)).astype(np.int64)]
        at = end
    return sums, digest.hexdigest(), codes[0], times[0], b"".join(texts)


def align_batches(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, with_groups: bool, schema: pa.Schema, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Rows with their sums, the digest of their groups, and their pairs of ids with the number of links."""
    holds("alignment", _LOADED)
    both = tokenizers(a_path, b_path)
    for batch in (part for whole in batches for part in batches_of(whole, "text", limit)):
        raw, cuts = utf8(batch.column("text"))
        full = np.flatnonzero(np.diff(cuts))
        sums, digests, groups = np.zeros((4, len(batch)), np.int64), [""] * len(batch), [""] * len(batch)
        codes, times, held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(batch), np.int64)
        if len(full):
            raw, cuts = with_blanks(raw, np.append(cuts[full], cuts[-1]))
            if len(full) == 1 and len(raw) > limit:
                found, digest, codes, times, text = long_text(both, raw, limit, with_groups)
                wrong, found, text_of, digest_of = found[:1], found[1:, None], lambda k: text, lambda k: digest
                owner = np.zeros(len(codes), np.int64)
            else:
                part = Aligned(both, raw, cuts)
                wrong, *found = part.sums()
                owner, codes, times = part.pairs()
                text_of, digest_of = part.text, lambda k: hashlib.sha256(part.text(k)).hexdigest()
            good = np.asarray(wrong) == 0
            for k in np.flatnonzero(good).tolist():
                digests[full[k]] = digest_of(k)
                groups[full[k]] = text_of(k).decode() if with_groups else ""
            sums[:, full[good]] = np.array(found)[:, good]
            kept = good[owner]
            codes, times = codes[kept], times[kept]
            held[full] = np.bincount(owner[kept], minlength=len(full))
        offsets = np.concatenate([[0], np.cumsum(held)])
        for at in range(0, len(batch), ROWS):
            end = min(at + ROWS, len(batch))
            own = slice(int(offsets[at]), int(offsets[end]))
            lists = pa.array((offsets[at : end + 1] - offsets[at]).astype(np.int32))
            columns = [batch.column("row").slice(at, end - at), batch.column("doc_id").slice(at, end - at), *(pa.array(x[at:end]) for x in sums), pa.array(digests[at:end])]
            columns += [pa.array(groups[at:end])] * with_groups
            columns += [pa.ListArray.from_arrays(lists, pa.array(x[own], kind)) for x, kind in ((codes, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """A written table: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, (groups,) and the row's distinct pairs (codes) with their links (times)."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType(source.schema.fields[:2] + [T.StructField(n, T.LongType()) for n in names] + [T.StructField("groups_sha256", T.StringType())])
    schema = T.StructType(schema.fields + [T.StructField("groups", T.StringType())] * with_groups + [T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))])
    return written(source.mapInArrow(task(align_batches, a_path, b_path, with_groups, to_arrow_schema(schema)), schema), "alignments")


def links_of(aligned: DataFrame) -> DataFrame:
    """row, code and times of all pairs of all rows."""
    return aligned.select("row", "times", F.posexplode("codes").alias("at", "code")).select("row", "code", F.col("times")[F.col("at")].cast("long").alias("times"))


def pair_table(aligned: DataFrame) -> DataFrame:
    """A written table of all pairs: code, a, b, n (links in the corpus) and best (no other A id has more links with this B id)."""
    salted = links_of(aligned).groupBy("code", F.pmod("row", F.lit(SALTS)).alias("salt")).agg(F.sum("times").alias("n"))
    pairs = written(salted.groupBy("code").agg(F.sum("n").alias("n")).select("code", F.expr(f"code div {B_IDS}").alias("a"), F.expr(f"code % {B_IDS}").alias("b"), "n"), "pairs")
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return written(pairs.join(most, "b").select("code", "a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "best-pairs")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its B id's best), count_sum (their pairs' counts), groups_sha256 (and groups)."""
    aligned = alignments(docs, a_path, b_path, id_col, text_col, with_groups)
    pairs = small_side(pair_table(aligned).select("code", "n", "best"), BROADCAST_PAIRS)
    scores = links_of(aligned).join(pairs, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = aligned.drop("codes", "times").join(scores, "row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups)
