"""Language ID by a linear-chain conditional random field over words.

Each word of a text gets a language. A word's scores sum learned weights of its affixes (the first and last 1 to 3 bytes,
marked by the word's edge), of its inner n-grams of 2 to 4 bytes (both hashed), and of its entry in a lexicon of words
seen in training. Learned transitions join neighbours, so a short or unknown word follows its surroundings and
a text may switch between languages. Forward-backward gives each word's probabilities; a document's language
has the largest sum of them, and its score is their mean.

Training: texts with a language, at most ``PER_LANGUAGE`` documents or so for each language. The bounds on what the driver
holds are ``SAMPLED`` documents and ``SAMPLED_BYTES`` bytes; languages share both, and each has one document at least, so none is
left out (documents are drawn by a hash of the id). Of a text of more than ``PASSAGE`` characters a passage of that length is
drawn, at a hashed place. Sequences of up to ``LENGTH`` words are cut from
the texts, so that every word of them is in one, and half of them are put together from stretches in different
languages, so that switches have been seen. Texts of a few words (or of one) are
short sequences; a table of nothing else is trained on as any other. The weights climb the likelihood by adaptive gradient steps, which touch the weights of
what a step has seen alone.

More than ``FANOUT`` languages are a tree: a chain over groups of languages (neighbours by name) decides for a group, and the group's own chain, with tables that
are the smaller the more languages there are, for the language. So memory and time are bounded, however many values the column has, and each of them can be predicted.

Prediction works on whole texts of any length and reads nothing but the text. Words run in blocks of ``BLOCK`` side by side: the
product of a block's steps carries messages over it. A text longer than a slice is scored slice by slice, with the messages carried from
slice to slice, so a task's memory depends on the slice alone, which is the smaller the more languages there are. A run of letters
of more than ``WORD_BYTES`` bytes, as where a language writes no blanks, is cut into words of about that length.

Defined cases: a text that is null or
has no letter is ``und`` with score 0; with no usable training rows, all are; a null doc_id counts as an
empty id; an empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm._shared import batches_of, holds, scratch, task, utf8

PER_LANGUAGE = 400
SAMPLED = 64 * PER_LANGUAGE
SAMPLED_BYTES = 8_000_000
PASSAGE = 16_384
LENGTH = 32
WORD_BYTES = 64
#: Words of a block; more where there are many languages, as the product of a block's steps costs their cube.
BLOCK = 128
FEW = 16
SLOTS = 1 << 16
#: Languages of a chain; more are a tree of so many groups a node (a chain costs the square of its labels). Slots of a chain below the root, at least.
FANOUT = 64
WAYS = 24
FEWEST_SLOTS = 1 << 10
SIZES = (2, 3, 4)
LEAST_SEEN = 3
EPOCHS = 4
RATE = 0.3
#: Bytes of a slice, and of a slice times its languages.
BATCH = 400_000
SCORED = 4_000_000
UNKNOWN = "und"

EDGE = 0x20
FOLD = np.frombuffer(bytes(range(256)).lower(), np.uint8)
IN_WORD = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
STEP = np.uint64(0x9E3779B97F4A7C15)
ODD = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)


def small(raw: np.ndarray) -> np.ndarray:
    """Small letters, without moving any byte: ASCII and the Latin-1 letters."""
    out = FOLD[raw]
    capital = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)
    out[1:][capital] += 0x20
    return out


def parted(raw: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs with those of more than WORD_BYTES bytes cut into words, between characters."""
    counts = -(-(stops - begins) // WORD_BYTES)
    if not len(counts) or counts.max() == 1:
        return begins, stops
    number = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(begins, counts) + WORD_BYTES * number
    for _ in range(3):
        starts -= (number > 0) & ((raw[starts] & 0xC0) == 0x80)
    ends = np.append(starts[1:], stops[-1])
    last = np.cumsum(counts) - 1
    ends[last] = stops
    return starts, ends


class Words:
    """The words of some texts: runs of letters (and of whatever is not ASCII)."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        raw = small(raw)
        solid = IN_WORD[raw]
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        edges = ends[(ends > 0) & (ends < len(raw))]
        begins[edges] = solid[edges]
        stops[edges - 1] = solid[edges - 1]
        self.begins, self.stops = parted(raw, np.flatnonzero(begins), np.flatnonzero(stops) + 1)
        self.cuts = np.searchsorted(self.begins, ends)
        sizes = self.stops - self.begins
        # each word with an edge before it, and one edge at the end of all
        self.heads = np.cumsum(sizes + 1) - sizes - 1
        self.line = np.full(int(sizes.sum()) + len(sizes) + 8, EDGE, np.uint8)
        if len(sizes):
            at = np.ones(int(sizes.sum()) + len(sizes), bool)
            at[self.heads] = False
            # words come in order and hold all letters
            self.line[: len(at)][at] = raw[solid]
        self.sizes = sizes

    def __len__(self) -> int:
        return len(self.sizes)

    def grams(self, room: int = SLOTS) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each n: the hashed n-gram that begins at each place, and whether it lies within one word and its edges."""
        count = int(self.heads[-1] + self.sizes[-1] + 1) if len(self) else 0
        codes = ODD[self.line]
        inner = self.line != EDGE
        slots, valid = [], []
        for n in SIZES:
            h = np.zeros(count, np.uint64)
            ok = np.ones(count, bool)
            for k in range(n):
                h *= STEP
                h += codes[k : k + count]
                if 0 < k < n - 1:
                    ok &= inner[k : k + count]
            if n == 2:
                ok = inner[:count] | inner[1 : count + 1]
            h >>= np.uint64(40)
            slots.append(h.astype(np.int32) & np.int32(room - 1))
            valid.append(ok)
        return slots, valid

    def keys(self) -> np.ndarray:
        """A hash of each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        count = int(self.heads[-1] + self.sizes[-1] + 1)
        places = np.arange(count) - np.repeat(self.heads, self.sizes + 1)
        powers = np.cumprod(np.full(int(self.sizes.max()) + 1, STEP, np.uint64))
        sums = np.add.reduceat(ODD[self.line[:count]] * powers[places], self.heads)
        return (sums ^ (sums >> np.uint64(29))) * STEP


class Model:
    """The weights: n-grams (one table for each n, a row a slot), lexicon, starts and transitions. In a tree, ``children`` has the models of labels that are groups."""

    def __init__(self, labels: list[str], grams: np.ndarray, lexicon: np.ndarray, entries: np.ndarray, moves: np.ndarray, children: dict[int, Model] | None = None):
        self.labels, self.grams, self.lexicon, self.entries, self.moves, self.children = labels, grams, lexicon, entries, moves, children or {}
        self.room = grams.shape[1] - 1

    def entry(self, keys: np.ndarray) -> np.ndarray:
        """The place of each word in the lexicon; the last place is for words that are not there."""
        at = np.minimum(np.searchsorted(self.lexicon, keys), max(0, len(self.lexicon) - 1))
        return np.where(self.lexicon[at] == keys, at, len(self.lexicon)) if len(self.lexicon) else np.zeros(len(keys), np.int64)

    def scores(self, words: Words) -> np.ndarray:
        """Each word's score for each label."""
        if not len(words):
            return np.zeros((0, len(self.labels)), np.float32)
        slots, valid = words.grams(self.room)
        total = self.entries[self.entry(words.keys())]
        for table, slot, ok in zip(self.grams, slots, valid):
            total += np.add.reduceat(table[np.where(ok, slot, self.room)], words.heads, axis=0)
        return total

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, labels=np.array(self.labels), grams=self.grams, lexicon=self.lexicon, entries=self.entries, moves=self.moves, **{f"child{k}": np.frombuffer(m.dump(), np.uint8) for k, m in self.children.items()})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as x:
            children = {int(name[5:]): cls.load(x[name].tobytes()) for name in x.files if name.startswith("child")}
            return cls(x["labels"].tolist(), x["grams"], x["lexicon"], x["entries"], x["moves"], children)


def shifted(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(scores - scores.max(-1, keepdims=True), -60.0))


class Chain:
    """Forward-backward over the words of some texts, in blocks that run side by side, longest first, a word at a step."""

    def __init__(self, scores: np.ndarray, cuts: np.ndarray, moves: np.ndarray):
        self.emitted = shifted(scores).astype(np.float32)
        self.step = np.exp(moves - moves.max()).astype(np.float32)
        self.labels = scores.shape[1]
        block = BLOCK if self.labels <= FEW else 8 * BLOCK
        counts = -(-np.diff(cuts) // block)
        #: Blocks by their number within the text: texts that have one, and where it is among all blocks.
        self.firsts = np.cumsum(counts) - counts
        self.counts = counts
        self.text = np.repeat(np.arange(len(counts)), counts)
        number = np.arange(int(counts.sum())) - np.repeat(self.firsts, counts)
        self.opens = number == 0
        self.begins = np.repeat(cuts[:-1], counts) + block * number
        self.sizes = np.minimum(np.repeat(cuts[1:], counts) - self.begins, block)

    def steps(self, blocks: np.ndarray):
        """The given blocks, longest first, and for each step how many have a word there."""
        order = blocks[np.argsort(-self.sizes[blocks], kind="stable")]
        sizes = self.sizes[order]
        longest = int(sizes[0]) if len(sizes) else 0
        return order, np.searchsorted(-sizes, -np.arange(longest), side="left")

    def products(self, blocks: np.ndarray) -> np.ndarray:
        """For each block the product of its steps: row i tells what follows from label i before the block.

        A block that opens a text begins with no step; its rows stand for its first label.
        """
        order, live = self.steps(blocks)
        out = np.empty((len(blocks), self.labels, self.labels), np.float32)
        for t, n in enumerate(live):
            now = np.where(self.opens[order[:n], None, None], np.eye(self.labels, dtype=np.float32), self.step) if t == 0 else out[:n] @ self.step
            now *= self.emitted[self.begins[order[:n]] + t][:, None, :]
            out[:n] = now / now.sum((1, 2), keepdims=True)
        placed = np.empty_like(out)
        placed[np.argsort(-self.sizes[blocks], kind="stable")] = out
        return placed

    def carried(self, before: np.ndarray | None, after: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The messages into each block from its left and right, and those that leave the first text at both ends.

        ``before`` and ``after`` come from the slices around the one text that the chain then holds.
        """
        total = len(self.begins)
        left = np.ones((total, self.labels), np.float32)
        right = np.ones((total, self.labels), np.float32)
        if before is not None:
            self.opens[:1] = False
        many = np.flatnonzero((self.counts > 1) | (before is not None) | (after is not None))
        where = np.full(total, -1)
        blocks = np.flatnonzero(np.isin(self.text, many))
        where[blocks] = np.arange(len(blocks))
        products = self.products(blocks)
        # what comes into a block is the last label before it, or nothing where it opens a text
        state = np.ones((len(many), self.labels), np.float32)
        if before is not None and len(many):
            state[0] = before
        for j in range(int(self.counts[many].max()) if len(many) else 0):
            on = np.flatnonzero(self.counts[many] > j)
            block = self.firsts[many[on]] + j
            left[block] = state[on]
            now = (state[on][:, None, :] @ products[where[block]])[:, 0]
            state[on] = now / now.sum(1, keepdims=True)
        back = np.ones((len(many), self.labels), np.float32)
        if after is not None and len(many):
            back[0] = after
        for j in range(int(self.counts[many].max()) if len(many) else 0):
            on = np.flatnonzero(self.counts[many] > j)
            block = self.firsts[many[on]] + self.counts[many[on]] - 1 - j
            right[block] = back[on]
            now = (products[where[block]] @ back[on][:, :, None])[:, :, 0]
            back[on] = now / now.sum(1, keepdims=True)
        return left, right, state[0] if len(many) else before, back[0] if len(many) else after

    def marginals(self, before: np.ndarray | None = None, after: np.ndarray | None = None, each: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The sums of the words' probabilities for each text (or each word's), and the message that leaves to the left."""
        left, right, _, out_left = self.carried(before, after)
        order, live = self.steps(np.arange(len(self.begins)))
        begins, opens = self.begins[order], self.opens[order]
        ahead = np.empty_like(self.emitted)
        now = None
        for t, n in enumerate(live):
            at = begins[:n] + t
            came = np.where(opens[:, None], 1, left[order] @ self.step) if t == 0 else now[:n] @ self.step
            now = came * self.emitted[at]
            now /= now.sum(1, keepdims=True)
            ahead[at] = now
        out = np.zeros_like(self.emitted) if each else np.zeros((len(self.begins), self.labels), np.float64)
        behind = np.ones((0, self.labels), np.float32)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            # blocks that end here begin with what comes from their right
            behind = np.concatenate([behind, right[order[len(behind) : n]]])
            at = begins[:n] + t
            both = ahead[at] * behind
            both /= both.sum(1, keepdims=True)
            if each:
                out[at] = both
            else:
                out[order[:n]] += both
            behind = (self.emitted[at] * behind) @ self.step.T
            behind /= behind.sum(1, keepdims=True)
        if each:
            return out, out_left
        sums = np.zeros((len(self.counts), self.labels))
        np.add.at(sums, self.text, out)
        return sums, out_left


def sums_of_marginals(scores: np.ndarray, cuts: np.ndarray, moves: np.ndarray, each: bool = False) -> np.ndarray:
    """For each text the sums of its words' probabilities, or each word's."""
    return Chain(scores, cuts, moves).marginals(each=each)[0]


# ---- Training


def sequences(labels: np.ndarray, cuts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows of LENGTH word numbers, -1 after the last: plain runs that cover each text, and as many rows mixed from stretches of two of them."""
    counts = -(-np.diff(cuts) // LENGTH)
    starts = np.repeat(cuts[:-1], counts) + LENGTH * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    sizes = np.minimum(np.repeat(cuts[1:], counts) - starts, LENGTH)[:, None]
    starts, at = starts[:, None], np.arange(LENGTH)
    plain = np.where(at < sizes, starts + at, -1)
    if not len(plain):
        return plain
    turn = np.minimum(rng.integers(3, LENGTH - 2, (len(plain), 1)), sizes)
    order = rng.permutation(len(plain))
    # the other stretch goes on at the place of the turn, or begins anew where it is not that long
    place = at - np.where(sizes[order] > turn, 0, turn)
    other = np.where(place < sizes[order], starts[order] + place, -1)
    switched = np.where(at < turn, plain, other)
    return np.concatenate([plain, switched])[rng.permutation(2 * len(plain))]


def chain_gradient(scores: np.ndarray, gold: np.ndarray, live: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the likelihood of rows of words gains with each word's scores and with the transitions.

    ``live`` marks the words; what follows them in a row is padding and gains nothing.
    """
    rows, length, count = scores.shape
    emitted, step = shifted(scores), np.exp(moves - moves.max())
    ahead, behind = np.empty_like(emitted), np.ones_like(emitted)
    for t in range(length):
        a = emitted[:, t] if t == 0 else (ahead[:, t - 1] @ step) * emitted[:, t]
        ahead[:, t] = a / a.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (emitted[:, t + 1] * behind[:, t + 1]) @ step.T
        behind[:, t] = np.where(live[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
    both = ahead * behind
    both /= both.sum(2, keepdims=True)
    right = np.eye(count)[gold]
    expected, seen = np.zeros_like(moves), np.zeros_like(moves)
    for t in range(length - 1):
        on = live[:, t + 1]
        # the sum over rows of each row's pairs, which add up to 1, without a table of pairs for each row
        here, there = ahead[on, t], emitted[on, t + 1] * behind[on, t + 1]
        expected += step * ((here / ((here @ step) * there).sum(1, keepdims=True)).T @ there)
        np.add.at(seen, (gold[on, t], gold[on, t + 1]), 1)
    return np.where(live[..., None], right - both, 0.0), seen - expected


def climb(weights: np.ndarray, square: np.ndarray, step: np.ndarray) -> None:
    """An adaptive gradient step, in place."""
    square += (step * step).astype(square.dtype)
    weights += (RATE * step / np.sqrt(square)).astype(weights.dtype)


class Touched:
    """The rows of a table of weights that a step has seen: the others gain nothing."""

    def __init__(self, table: np.ndarray, square: np.ndarray, slot: np.ndarray):
        self.table, self.square = table, square
        there = np.bincount(slot, minlength=len(table)) > 0
        self.rows = np.flatnonzero(there)
        self.place = (np.cumsum(there) - 1)[slot]
        self.weights, self.squares = np.asfortranarray(table[self.rows]), np.asfortranarray(square[self.rows])

    def climb(self, label: int, gains: np.ndarray) -> None:
        """A step of one label's weights by the gains of all occurrences."""
        climb(self.weights[:, label], self.squares[:, label], np.bincount(self.place, weights=gains, minlength=len(self.rows)))

    def back(self) -> None:
        self.table[self.rows], self.square[self.rows] = self.weights, self.squares


def fit(texts: list[str], langs: list[str], seed: int = 1, room: int | None = None) -> Model:
    """Learn a model from texts, each in one language."""
    labels = sorted(set(langs))
    if len(labels) <= FANOUT:
        return fit_chain(texts, langs, seed, room or SLOTS)
    top = room or SLOTS
    room = room or max(FEWEST_SLOTS, 1 << (SLOTS * FANOUT // len(labels)).bit_length() - 1)
    groups = [list(x) for x in np.array_split(np.array(labels, dtype=object), WAYS)]
    of = {lang: k for k, group in enumerate(groups) for lang in group}
    names = [f"{group[0]}\0{k:06d}" for k, group in enumerate(groups)]  # in the order of the groups
    root = fit_chain(texts, [names[of[x]] for x in langs], seed, top)
    for k in range(len(groups)):
        own = [j for j, x in enumerate(langs) if of[x] == k]
        root.children[k] = fit([texts[j] for j in own], [langs[j] for j in own], seed, room)
    return root


def fit_chain(texts: list[str], langs: list[str], seed: int, room: int) -> Model:
    """Learn one chain."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    number = {x: k for k, x in enumerate(labels)}
    raw, ends = utf8(pa.array(texts, pa.string()))
    words = Words(raw, ends)
    of_text = np.array([number[x] for x in langs], np.int64)
    gold = np.repeat(of_text, np.diff(words.cuts))
    keys = words.keys()
    seen, counts = np.unique(keys, return_counts=True)
    lexicon = seen[counts >= LEAST_SEEN]
    model = Model(labels, np.zeros((len(SIZES), room + 1, len(labels)), np.float32), lexicon, np.zeros((len(lexicon) + 1, len(labels)), np.float32), np.zeros((len(labels), len(labels))))
    if not len(words):
        return model
    entry = model.entry(keys)
    slots, valid = words.grams(room)
    slots = [np.where(ok, s, np.int32(room)) for s, ok in zip(slots, valid)]
    spans = np.append(words.heads, len(slots[0]))
    squares = [np.full_like(model.grams, 1e-2), np.full_like(model.entries, 1e-2), np.full_like(model.moves, 1.0)]
    for _ in range(EPOCHS):
        rows = sequences(gold, words.cuts, rng)
        for part in np.array_split(rows, max(1, len(rows) // 500)):
            live = part >= 0
            flat = part[live]
            sizes = spans[flat + 1] - spans[flat]
            places = np.repeat(spans[flat] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            own = [s[places] for s in slots]
            heads = np.cumsum(sizes) - sizes
            scores = np.add.reduceat(sum(t[s] for t, s in zip(model.grams, own)), heads, axis=0) + model.entries[entry[flat]]
            padded = np.zeros((*part.shape, len(labels)))
            padded[live] = scores
            gain, move = chain_gradient(padded, gold[part], live, model.moves)
            gain = gain[live]
            tables = [Touched(table, square, slot) for table, square, slot in zip(model.grams, squares[0], own)]
            words_seen = Touched(model.entries, squares[1], entry[flat])
            # label by label: what is held besides the model does not grow with the labels
            for k in range(len(labels)):
                spread = np.repeat(gain[:, k], sizes)
                for touched in tables:
                    touched.climb(k, spread)
                words_seen.climb(k, gain[:, k])
            for touched in (*tables, words_seen):
                touched.back()
            climb(model.moves, squares[2], move)
            model.grams[:, room] = 0
    model.entries[-1] = 0
    return model


def bucket(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3


def sample(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> list:
    """Labelled documents for training, within the bounds that the module tells."""
    place = F.pmod(F.xxhash64(F.lit(77), F.col(id_col)), F.lit(1 << 30))
    begin = F.pmod(F.xxhash64(F.lit(78), F.col(id_col)), F.greatest(F.length(text_col) - PASSAGE, F.lit(0)) + 1)
    known = docs.filter((bucket(id_col) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place"), F.xxhash64(id_col, text_col).alias("o"), begin.alias("begin"))
    bytes_ = F.least(F.octet_length("text"), F.lit(4 * PASSAGE)).cast("long")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(bytes_).alias("bytes"), F.min("place").alias("least")).collect()
    if not sizes:
        return []
    documents, size = min(per_language, SAMPLED / len(sizes)), SAMPLED_BYTES / len(sizes)
    # languages of no more than that are taken whole; the document with the smallest hash always
    edges = {r.lang: max(r.least, int((1 << 30) * min(1.0, documents / r.n, size / max(1, r.bytes)))) for r in sizes}
    edge = F.element_at(F.create_map(*(F.lit(x) for pair in edges.items() for x in pair)), F.col("lang"))
    drawn = known.filter(F.col("place") <= edge)
    text = F.when(F.length("text") > PASSAGE, F.substring("text", F.col("begin") + 1, F.lit(PASSAGE))).otherwise(F.col("text"))
    return drawn.select(text.alias("text"), "lang", "o").collect()


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> str:
    """Fit on a bounded sample of the labelled rows that are not held out; write the model and give its path."""
    rows = sorted(sample(docs, per_language, id_col, text_col, lang_col), key=lambda r: (r.lang, r.o, r.text))
    model = fit([r.text for r in rows], [r.lang for r in rows])
    path = scratch(docs.sparkSession, "language-model")
    store, base = pafs.FileSystem.from_uri(path)
    store.create_dir(base.rpartition("/")[0], recursive=True)
    with store.open_output_stream(base) as file:
        file.write(model.dump())
    return path


# ---- Prediction

_MODEL: dict[str, Model] = {}


def model_at(path: str) -> Model:
    if path not in _MODEL:
        store, base = pafs.FileSystem.from_uri(path)
        with store.open_input_stream(base) as file:
            _MODEL.clear()
            _MODEL[path] = Model.load(file.read())
    return _MODEL[path]


def slice_bytes(model: Model) -> int:
    """How many bytes are scored at a time."""
    return max(4 * WORD_BYTES, min(BATCH, SCORED // max(1, len(model.labels))))


def slices(raw: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A long text cut where no word is, or within a run of letters that is as long as a slice."""
    out, begin = [], 0
    while len(raw) - begin > limit:
        gaps = np.flatnonzero(~IN_WORD[raw[begin + limit // 2 : begin + limit]])
        end = begin + limit // 2 + int(gaps[-1]) if len(gaps) else begin + limit
        while not len(gaps) and end > begin + 1 and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append((begin, end))
        begin = end
    return [*out, (begin, len(raw))]


def sums_of_long(model: Model, raw: np.ndarray, limit: int) -> tuple[np.ndarray, int]:
    """The sums of the words' probabilities of one text, and the number of its words, slice by slice.

    The first way through keeps what each slice gives to the next; the way back scores the slices again.
    """

    def chain(begin: int, end: int) -> Chain:
        words = Words(raw[begin:end], np.array([0, end - begin]))
        return Chain(model.scores(words), words.cuts, model.moves)

    parts = slices(raw, limit)
    came: list[np.ndarray | None] = [None]
    for begin, end in parts[:-1]:
        link = chain(begin, end)
        came.append(link.carried(came[-1], np.ones(link.labels, np.float32))[2] if len(link.begins) else came[-1])
    sums, words, after = np.zeros(len(model.labels)), 0, np.ones(len(model.labels), np.float32)
    for (begin, end), before in zip(parts[::-1], came[::-1]):
        link = chain(begin, end)
        if len(link.begins):
            own, after = link.marginals(before, after)
            sums, words = sums + own[0], words + int(link.sizes.sum())
    return sums, words


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    raw, ends = utf8(column)
    limit = slice_bytes(model)
    if not model.labels:
        return [UNKNOWN] * len(column), np.zeros(len(column))
    if len(column) == 1 and len(raw) > limit:
        some = np.array([any((IN_WORD[part] & (part < 0x80)).any() for k in range(0, len(raw), limit) if len(part := raw[k : k + limit]))])
        sums, count = sums_of_long(model, raw, limit)
        sums, counts = sums[None], np.array([count])
    else:
        ascii_letter = np.append(0, np.cumsum(IN_WORD[raw] & (raw < 0x80)))
        some = ascii_letter[ends[1:]] > ascii_letter[ends[:-1]]
        words = Words(raw, ends)
        sums, counts = sums_of_marginals(model.scores(words), words.cuts, model.moves), np.diff(words.cuts)
    for k in np.flatnonzero(~some & (counts > 0)).tolist():
        some[k] = any(map(str.isalpha, column[k].as_py()))
    best = sums.argmax(1)
    scores = np.where(some, np.clip(sums[np.arange(len(best)), best] / np.maximum(counts, 1), 0, 1), 0.0)
    names = [model.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist())]
    for child in np.unique(best[some]).tolist() if model.children else []:
        rows = np.flatnonzero(some & (best == child))
        found, shares = predict(model.children[child], column.take(pa.array(rows)))
        scores[rows] *= shares
        for k, name in zip(rows.tolist(), found):
            names[k] = name
    return names, scores


def predict_batches(batches: Iterator[pa.RecordBatch], path: str, text_col: str) -> Iterator[pa.RecordBatch]:
    """The rows with ``lang_pred`` and ``score`` added."""
    holds("langcrf", _MODEL)
    model = model_at(path)
    for batch in (part for whole in batches for part in batches_of(whole, text_col, slice_bytes(model))):
        langs, scores = predict(model, batch.column(text_col))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])


def identify(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row. Only the text enters the prediction."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(task(predict_batches, path, "text"), f"doc_id {kind}, text string, lang_pred string, score double")
    return out.select("doc_id", (bucket("doc_id") == 1).alias("held_out"), "lang_pred", "score")


def label_words(model: Model, text: str) -> list[tuple[int, int, str, float]]:
    """The words of one text: begin and end (code points), language and probability of each."""
    raw, ends = utf8(pa.array([text], pa.string()))
    words = Words(raw, ends)
    marginals = sums_of_marginals(model.scores(words), words.cuts, model.moves, each=True)
    points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    best = marginals.argmax(1)
    if model.children:
        # each word is labelled by the chain of its group, which runs over the whole text
        below = {k: label_words(model.children[k], text) for k in np.unique(best).tolist()}
        return [(*below[k][at][:3], below[k][at][3] * float(m[k])) for at, (k, m) in enumerate(zip(best.tolist(), marginals))]
    return [(int(points[a]), int(points[b]), model.labels[k], float(m[k])) for a, b, k, m in zip(words.begins, words.stops, best, marginals)]


def run_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = model_at(path)
    for batch in batches:
        out = []
        for text in batch.column("text"):
            runs: list[dict] = []
            for begin, end, lang, _ in label_words(model, text.as_py() or "") if model.labels else []:
                if runs and runs[-1]["lang"] == lang:
                    runs[-1] |= {"end": end, "words": runs[-1]["words"] + 1}
                else:
                    runs.append({"begin": begin, "end": end, "lang": lang, "words": 1})
            out.append(runs)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, ARROW_RUNS)], ["doc_id", "runs"])


RUNS = "array<struct<begin:int,end:int,lang:string,words:int>>"
ARROW_RUNS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("words", pa.int32())]))


def tag(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the runs of words in one language, with their places in the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task(run_batches, path), f"doc_id {kind}, runs {RUNS}")


def keep_identified(docs: DataFrame, path: str, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose language is known with a score above ``least``."""
    schema = docs.schema
    numbered = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)))
    text = f"c{docs.columns.index(text_col)}"
    fields = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(schema))
    out = numbered.mapInArrow(task(predict_batches, path, text), fields + ", lang_pred string, score double")
    kept = out.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") > least))
    return kept.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
