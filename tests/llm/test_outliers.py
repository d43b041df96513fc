"""Quality rules against loops and a minimum covariance determinant in NumPy."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quernel.llm import entries, outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", " \n\t", "a", "a b c", "a b c a b c", "a a a a", "x\nx\n x\n\nx", "$ # 10% <b> | &", "é\x1cé \x85 \xa0 日本", "q " * 49, "q " * 60, "w" * 9000]


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {p for k, w in enumerate(windows) if times[w] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(lines)


def plain_kept(rows, least):
    """rows of (lang, source, statistics); whether each is kept."""
    vectors, cells = {}, {}
    for k, (lang, source, (n, chars, symbols, dup, repeat, lines)) in enumerate(rows):
        if n >= 50 and 100 * repeat <= 50 * n:
            vectors[k] = np.floor([1000 * np.log(n), 1000 * chars / n, 1000 * np.log(1 + 100 * symbols / chars), 1000 * dup / lines, 1000 * repeat / n])
    groups = Counter((rows[k][0], rows[k][1]) for k in vectors)
    pools = Counter(rows[k][0] for k in vectors if groups[rows[k][:2]] < least)
    members = defaultdict(list)
    for k in vectors:
        lang, source = rows[k][:2]
        cell = (lang, source) if groups[lang, source] >= least else (lang, "*") if pools[lang] >= least else ("*", "*")
        members[cell].append(k)
    kept = dict.fromkeys(range(len(rows)), False)
    floors, factor = np.array(outliers.FLOORS, float), outliers.consistency(outliers.SHARE, 5)
    for own in members.values():
        x = np.array([vectors[k] for k in own])
        middle = np.median(x, axis=0)
        spread = np.maximum(1.4826 * np.median(np.abs(x - middle), axis=0), floors)
        inverse = np.diag(1 / spread**2)
        for _ in range(outliers.STEPS):
            apart = np.einsum("ij,jk,ik->i", x - middle, inverse, x - middle)
            bins = np.minimum(np.floor(256 * np.log1p(apart)), outliers.BINS - 1)
            order = np.sort(bins)
            near = x[bins <= order[min(len(x), len(x) * 3 // 4 + 1) - 1]]
            middle = near.mean(axis=0)
            inverse = np.linalg.inv(factor * np.cov(near.T, bias=True).reshape(5, 5) + np.diag(floors**2))
        far = x - middle
        far[:, 2:] = np.maximum(far[:, 2:], 0)
        for k, d in zip(own, np.einsum("ij,jk,ik->i", far, inverse, far)):
            kept[k] = bool(d <= outliers.quantile(outliers.LEVEL, 5))
    return [kept[k] for k in range(len(rows))]


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(40, 300))]
        kind = "plain"
        if k % 17 == 0:
            words, kind = [w + "#$%" for w in words], "symbols"
        if k % 23 == 0:
            words, kind = [w * 12 for w in words], "wide"
        if k % 29 == 0:
            words[20:40], kind = words[:20], "repeats"
        text = " ".join(words)
        if k % 31 == 0:
            text, kind = text + "\nthe same line" * 30, "lines"
        rows.append((k, text, "en" if k % 5 else None, rng.choice(["hot", "hot", "hot", "a", "b", None]), kind if len(words) >= 50 else "short"))
    return rows


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r[:4], 1, 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_words int, x1 double").repartition(3)
    return [r.asDict() for r in outliers.outliers(frame, **options).collect()]


def test_statistics_of_odd_texts(spark):
    texts = ODD_TEXTS + [r[1] for r in made(60, 3)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("*", "'en' AS lang", "'s' AS source").repartition(3)
    for r in outliers.statistics(frame).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == plain_statistics(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


@pytest.mark.parametrize("least", [1, 50, 10_000])
def test_verdicts_as_numpy_gives_them(spark, least):
    rows = made(700, 1) + [(1000 + k, t, None, None, "odd") for k, t in enumerate(ODD_TEXTS)] + [(2000, "x", "en", "hot", "short")] * 2
    want = Counter(zip((r[0] for r in rows), plain_kept([(r[2], r[3], plain_statistics(r[1])) for r in rows], least)))
    got = found(spark, rows, least=least)
    assert Counter((r["doc_id"], r["kept"]) for r in got) == want
    if least == 50:
        kinds = {r[0]: r[4] for r in rows}
        kept = defaultdict(list)
        for r in got:
            kept[kinds[r["doc_id"]]].append(r["kept"])
        assert all(kept["plain"]) and not any(kept["symbols"] + kept["wide"] + kept["lines"] + kept["short"])


def test_joins_that_shuffle_agree(spark, monkeypatch):
    rows = made(200, 2)
    want = sorted((r["doc_id"], r["kept"], r["distance2"]) for r in found(spark, rows) if r["distance2"] is not None)
    monkeypatch.setattr(outliers, "BROADCAST_GROUPS", 0)
    assert sorted((r["doc_id"], r["kept"], r["distance2"]) for r in found(spark, rows[::-1]) if r["distance2"] is not None) == want


def test_steps_never_widen_the_scatter(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(5000, 900, (400, 5)), rng.normal(30_000, 90, (100, 5))]).astype(int)
    frame = spark.createDataFrame([("c", "s", *map(int, v)) for v in x], "cell_lang string, cell_source string, x1 long, x2 long, x3 long, x4 long, x5 long")
    sizes = []
    for steps in (1, 2, 3, 4):
        row = outliers.centres_of(frame, steps).first()
        sizes.append(np.prod([row[f"l{i}{i}"] for i in outliers.DIMENSIONS]))
        assert all(4000 < row[f"m{i}"] < 6000 for i in outliers.DIMENSIONS)
    assert all(b <= a * 1.02 for a, b in zip(sizes, sizes[1:]))  # a bin of distances goes in whole, so by a little it may


def test_fewer_symbols_than_the_group_is_no_fault(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(("#" if rng.random() < 0.5 else "a") + "word" + chr(97 + rng.randrange(26)) for _ in range(200)), "en", "code") for k in range(80)]
    rows.append((99, " ".join("aword" + chr(97 + rng.randrange(26)) for _ in range(200)), "en", "code"))
    assert {r["doc_id"]: r["kept"] for r in found(spark, rows)}[99]


def test_equal_texts_and_an_empty_table(spark):
    same = " ".join(f"w{k}" for k in range(80))
    assert all(r["kept"] for r in found(spark, [(1, same, "en", "s")] * 70))
    assert found(spark, []) == []


def test_no_python_in_the_plan(spark):
    plan = entries.op13_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_quantiles():
    assert outliers.quantile(0.999, 5) == pytest.approx(20.515, abs=1e-3) and outliers.quantile(0.75, 5) == pytest.approx(6.6257, abs=1e-3)
