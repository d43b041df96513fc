"""The divergence audit against loops over all pairs of sources and all kept terms."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from quernel.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def share(n, size, kept):
    return 1 + 1_000_000_000 * (n + 2) // (size + 2 * kept)


def apart(p, q):
    return (p - q) ** 2 // (p + q)


def plain(rows, least, top):
    held, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        held[lang or ""].update(set(terms(text)))
        groups[lang or "", source or ""].update(terms(text))
    out = set()
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in held.items()}
    of = {}
    for (lang, source), counts in groups.items():
        size = sum(counts[t] for t in kept[lang])
        of[lang, source] = [share(counts[t], size, len(kept[lang])) for t in kept[lang]]
    for lang, names in kept.items():
        sources = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in sources:
            whole.update(groups[lang, s])
        size = sum(whole[t] for t in names)
        found = defaultdict(list)
        for a, b in permutations(sources, 2):
            found[a, "pair"].append((sum(map(apart, of[lang, a], of[lang, b])), b))
        for s in sources:
            for t, p in zip(names, of[lang, s]):
                if groups[lang, s][t] and p > share(whole[t], size, len(names)):
                    found[s, "term"].append((apart(p, share(whole[t], size, len(names))), t))
        for (s, part), items in found.items():
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items) if part == "pair" or k < top}
    return out


def rows_of(seed, n=300, sources=9):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "über", "a", "日本", "x", "don't", "é-é", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for _ in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice([None, "", *(f"s{k}" for k in range(sources))])
        own = vocabulary if source != "s1" else vocabulary[:9]
        rows.append((" ".join(rng.choices(own, k=rng.randrange(25))), rng.choice(["en", "en", "de", None]), source))
    rows += [(None, "en", "silent"), ("", "xx", "one"), ("12 34", "xx", "two"), ("rare words here", "xx", "three"), ("solo", "yy", "alone")] * 2
    return rows


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 7, "x", 1.0) for r in rows], "text string, lang string, source string, n int, term string, p double").repartition(4)
    got = [tuple(r) for r in divergence.divergence(frame, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("least,block", [(3, 64), (10, 3), (1, 1)])
def test_all_pairs_and_terms(spark, monkeypatch, least, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = rows_of(least)
    assert found(spark, rows, least=least, top=5) == plain(rows, least, 5)


def test_joins_that_shuffle(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    rows = rows_of(8, 120)
    assert found(spark, rows, least=2, top=10) == plain(rows, 2, 10)


def test_no_kept_term_and_no_row(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), (None, None, None)]
    assert found(spark, rows, least=10) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}
    assert found(spark, [], least=1) == set()


def test_long_texts_are_counted_in_pieces():
    text = ("Ab cD éé " * 300 + "x" * 700 + " ab").encode()
    names, _, term, times = divergence.counted(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 64)
    assert dict(zip(names.to_pylist(), times.tolist())) == Counter(terms(text.decode())) and term.tolist() == list(range(len(names)))


def test_large_counts_stay_exact(spark):
    frame = spark.createDataFrame([(8_000_000_000_000, 30_000_000_000_001, 5_000_000)], "n long, size long, v long")
    assert frame.select(divergence.share("n", "size", "v")).first()[0] == share(8_000_000_000_000, 30_000_000_000_001, 5_000_000)
