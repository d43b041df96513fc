"""Alignment of two tokenizers against whole-text encodings and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = [
    None, "", " ", "  ", "\n", " \n ", "a", "a ", "a  b", " a", "  a  ", "a\n b", "a\t b \n\n c", "don't 'tis we're x's", "<|endoftext|> a <s> </s> <unk> <0x41>", "x▁y", "▁",
    "Straße—. „ja“ 12a3!!", "\x1cab\x1d c\x85 d\xa0 e　 f  g  h", "İI ΣΑΣ. σας", "ﬁx Ǆ ½ 我們. 日本語!! 😀😀.", "é é ́ x", "\x00a\x00 b", "'s 'll'd ''", "wo" * 3000 + " rd", "a​ b﻿ c", " \U0010ffff",
    "the cat sat  on the   mat. " * 40,
]


def plain(texts):
    """Whole texts, encoded as they are; loops in place of arrays."""
    both = alignment.Tokenizers(A, B)
    a_bytes = [both.a_side.data[s : s + n].tobytes() for s, n in zip(both.a_side.starts, both.a_side.lengths)]
    b_bytes = [both.b_side.data[s : s + n].tobytes() for s, n in zip(both.b_side.starts, both.b_side.lengths)]
    links, rows = [], []
    for text in texts:
        full = (" " + (text or "")).encode()
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        if b"".join(a_bytes[k] for k in a) != full or b"".join(b_bytes[k] for k in b) != full:
            rows.append(dict(n_a=0, n_b=0, n_groups=0, n_links=0, groups=""))
            links.append([])
            continue
        a_at, b_at = defaultdict(list), defaultdict(list)
        for ids, sizes, at in ((a, a_bytes, a_at), (b, b_bytes, b_at)):
            end = 0
            for k in ids:
                end += len(sizes[k])
                at[end].append(k)
        groups, own, own_a, own_b = [], [], [], []
        for end in range(1, len(full) + 1):
            own_a += a_at.get(end, [])
            own_b += b_at.get(end, [])
            if end in a_at and end in b_at:
                own += [(x, y) for x in a_at[end] for y in b_at[end]]
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                own_a, own_b = [], []
        rows.append(dict(n_a=len(a), n_b=len(b), n_groups=len(groups), n_links=len(own), groups=";".join(groups)))
        links.append(own)
    counts = Counter(x for own in links for x in own)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    for row, own in zip(rows, links):
        row["n_best"] = sum(counts[x] == most[x[1]] for x in own)
        row["count_sum"] = sum(counts[x] for x in own)
        row["groups_sha256"] = hashlib.sha256(row["groups"].encode()).hexdigest() if row["groups"] else ""
    return rows


def compared(spark, texts, **options):
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row int, codes string").repartition(3)
    found = sorted((r.asDict() for r in alignment.align(frame, A, B, with_groups=True, **options).collect()), key=lambda r: r["doc_id"])
    assert [r.pop("doc_id") for r in found] == list(range(len(texts)))
    want = plain(texts)
    for text, x, y in zip(texts, found, want):
        assert x == y, text


def test_odd_texts_and_copies(spark):
    compared(spark, [*ODD_TEXTS, *ODD_TEXTS[:9], "the cat sat on the mat"])


def test_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    compared(spark, texts)


def test_the_query_on_a_whole_table(spark):
    from quernel.llm import entries

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = {r.doc_id: r for r in entries.op12_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()}
    for row, want in zip(rows, plain([r.text for r in rows])):
        assert {k: v for k, v in found[row.doc_id].asDict().items() if k != "doc_id"} == {k: v for k, v in want.items() if k != "groups"}


def test_shuffled_join_and_hot_pair(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 1)
    compared(spark, ["the the the the", None, "the mat"] * 40)


def test_long_texts_go_piece_by_piece(spark):
    rng = random.Random(5)
    text = " ".join(rng.choice(["alpha", "beta's", "γάμμα", "x\n", "  ", "12", "é"]) for _ in range(4000))
    both = alignment.Tokenizers(A, B)
    raw, cuts = alignment.with_blanks(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    whole = alignment.Aligned(both, raw, cuts)
    sums, digest, codes, times, groups = alignment.long_text(both, raw, 500, True)
    assert sums.tolist() == [int(x[0]) for x in whole.sums()] and groups == whole.text(0)
    assert digest == hashlib.sha256(groups).hexdigest()
    _, want, n = whole.pairs()
    assert codes.tolist() == want.tolist() and times.tolist() == n.tolist()
    assert groups.decode() == plain([text])[0]["groups"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'sl .,1 \n\t\xa0é▁<>|日 ́\x00")), max_size=25), min_size=1, max_size=6))
def test_any_texts(texts):
    both = alignment.tokenizers(A, B)
    raw, cuts = alignment.utf8(pa.array(texts, pa.string()))
    full = np.flatnonzero(np.diff(cuts))
    want = plain(texts)
    if not len(full):
        return
    part = alignment.Aligned(both, *alignment.with_blanks(raw, np.append(cuts[full], cuts[-1])))
    wrong = part.sums()[0]
    for k, at in enumerate(full.tolist()):
        assert ("" if wrong[k] else part.text(k).decode()) == want[at]["groups"], texts[at]


def test_empty_table_and_other_id_types(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, A, B).collect() == []
    named = spark.createDataFrame([("x", "a b"), (None, "a b"), ("x", "a b")], "doc_id string, text string")
    found = alignment.align(named, A, B).collect()
    assert len(found) == 3 and {r.count_sum for r in found} == {6} and {r.n_best for r in found} == {2}


def test_pieces_with_inner_blanks_are_refused(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda self, k: "a▁b")
    with pytest.raises(ValueError):
        alignment.Tokenizers(A, B)
