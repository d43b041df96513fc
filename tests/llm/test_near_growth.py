"""How many candidates near-duplicate detection makes where many texts are nearly similar enough, and recall on planted pairs."""

import random

import pytest

from quernel.llm import bottomk


def template_texts(n, words=1500, own=0.1, seed=1):
    """Texts that share 90 % of their words: similarity 0.82, below 0.85."""
    rng = random.Random(seed)
    shared = [f"s{k}" for k in range(words)]
    out = []
    for k in range(n):
        text = list(shared)
        at = rng.randrange(int(words * (1 - own)))
        text[at : at + int(words * own)] = [f"o{k}-{j}" for j in range(int(words * own))]
        out.append(" ".join(text))
    return out


def counted(spark, monkeypatch, texts, **options):
    """The result, and the candidates of each round."""
    seen = []
    own = bottomk.NearDuplicates.links

    def links(self, pairs, sets):
        pairs = self.write(pairs, "counted")
        seen.append(pairs.count())
        return own(self, pairs, sets)

    monkeypatch.setattr(bottomk.NearDuplicates, "links", links)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = bottomk.near_duplicates(frame, **options).collect()
    return {r.doc_id: r.component_id for r in rows}, seen


def test_candidates_below_the_threshold_grow_no_faster_than_texts(spark, monkeypatch):
    for n in (100, 200, 400):
        found, seen = counted(spark, monkeypatch, template_texts(n), words=3, similarity=0.85)
        assert len(set(found.values())) == n
        assert sum(seen) <= n


def test_stock_phrases_make_no_pairs_of_all_their_texts(spark, monkeypatch):
    rng = random.Random(3)
    phrases = [" ".join(f"p{k}w{j}" for j in range(20)) for k in range(20)]
    texts = [f"{phrases[k]} {phrases[j]}" for k in range(20) for j in range(20)]
    texts += [f"{t} {rng.choice('xyz')}" for t in texts[:40]]  # near copies of some
    found, seen = counted(spark, monkeypatch, texts, words=3, similarity=0.85)
    assert all(found[400 + k] == found[k] or found[400 + k] < k for k in range(40))
    assert sum(seen) <= 8 * len(texts)  # each list holds some 40 of them, so all pairs would be 8,000


def test_a_list_is_split_by_salts_without_loss(spark, monkeypatch):
    texts = template_texts(60, 400, 0.04) + template_texts(20, 400, 0.02, seed=9)
    want, _ = counted(spark, monkeypatch, texts, words=3, similarity=0.85)
    monkeypatch.setattr(bottomk, "SPLIT", 3)
    assert counted(spark, monkeypatch, texts, words=3, similarity=0.85)[0] == want


@pytest.mark.parametrize("words,similarity", [(3, 0.85), (5, 0.8)])
def test_planted_pairs_are_found(spark, monkeypatch, words, similarity):
    """1,500 pairs a little above the threshold, and as many a little below, by brute force over each pair's sets."""
    rng = random.Random(5)
    texts, pairs = [], []
    for k in range(1500):
        n = rng.randint(40, 400)
        base = [f"v{rng.randrange(3000)}" for _ in range(n)]
        other, cut = list(base), max(1, round(n * rng.uniform(0.02, 0.12)))
        at = rng.randrange(n - cut)
        other[at : at + cut] = [f"v{rng.randrange(3000)}" for _ in range(cut)]
        texts += [" ".join(base), " ".join(other)]
        sets = [{tuple(t[j : j + words]) for j in range(len(t) - words + 1)} for t in (base, other)]
        both = len(sets[0] & sets[1])
        pairs.append(100 * both >= round(100 * similarity) * (len(sets[0] | sets[1])))
    assert 400 < sum(pairs) < 1200
    found, _ = counted(spark, monkeypatch, texts, words=words, similarity=similarity)
    assert [found[2 * k] == found[2 * k + 1] for k in range(1500)] == pairs
