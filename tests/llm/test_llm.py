"""The operators of quernel.llm against brute force, round trips and held-out accuracy, and their defined cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quernel.llm import bottomk, compaction, decontam, entries, isomedia, langcrf, linededup, mixing, records, resample, warc
from quernel.llm._shared import scratch

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards boil green quartz near my vexing jukebox".split()
ODD_TEXTS = [
    None, "", " ", "\n\n", "\t a \x0b b", "don't 'tis we're x's", "<|endoftext|> a<|startoftext|>b", "Straße—. „ja“ 12a3 a1b2!!", "\x1cab\x1d c\x85d  e　f",
    "İI ΣΑΣ. σας", "a̸≮>", "ﬁx Ǆ ½ 我們. 日本語!! 😀😀.", "\x00a\x00 b", "'s'll'd''", "a'té x́.ý e.́a", "wo" * 5000 + " rd",
]


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, a hot text, near copies, nulls everywhere, repeated rows, and columns with clashing names."""
    rows = [(k, t, "en", "s0") for k, t in enumerate(ODD_TEXTS)]
    base = words(200, 1)
    rows += [(100 + k, " ".join(base), "en", "s0") for k in range(30)]
    for k in range(20):
        own = list(base)
        own[k * 7 % 200] = f"changed{k}"
        rows.append((200 + k, " ".join(own), "en", "hot"))
    shared = "A line that many of the documents hold, of more than forty characters."
    rows += [(300 + k, "\n".join([" ".join(words(12, k)), f"  {shared.upper() if k % 2 else shared}\t", "short"]), None, None) for k in range(8)]
    rows += [(400, "repeated row", "en", "s1"), (400, "repeated row", "en", "s1"), (None, "no id here at all", "en", "s1"), (None, None, None, None)]
    return spark.createDataFrame([(a, b, c, d, 1, "x") for a, b, c, d in rows], "doc_id long, text string, lang string, source string, n long, id string").repartition(3)


def collect(df):
    return [r.asDict() for r in df.collect()]


def empty(docs):
    return docs.filter("false")


# ---- 1


def test_crc32c_of_many():
    def slow(data):
        crc = 0xFFFFFFFF
        for x in data:
            crc ^= x
            for _ in range(8):
                crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    rng = random.Random(3)
    data = [b"123456789", *(rng.randbytes(rng.randint(4, 1700)) for _ in range(40))]
    assert records.crc32c(data).tolist() == [slow(x) for x in data]
    assert records.crc32c(data)[0] == 0xE3069283


def test_pieces_give_the_ids_of_whole_texts():
    encoder = records.encoder(entries.tokenizer_path())
    assert encoder.splits
    column = pa.array([t for t in ODD_TEXTS], pa.string())
    ids, cuts = encoder.texts(column)
    for k, text in enumerate(ODD_TEXTS):
        whole = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids[cuts[k] : cuts[k + 1]].tolist() == whole, text
        assert np.frombuffer(encoder.text(text), "<u4").tolist() == whole, text


def test_records_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(entries.tokenizer_path())
    manifest = records.write_records(docs, entries.tokenizer_path())
    got = collect(records.read_records(manifest, with_ids=True))
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([r.doc_id for r in docs.collect()], key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 1
        assert r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    by_id = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert r["ids"][:-1] == tokenizer.encode(by_id[r["doc_id"]] or "", add_special_tokens=False).ids
    shard = max(manifest.collect(), key=lambda r: r.n_records)
    plain = [records.parse(p) for _, ps in records.read_shard(shard.path, 3) for p in ps]
    order = list(reversed(range(len(plain))))
    for k, (doc_id, ids) in zip(order, records.read_at(shard.path, order)):
        assert doc_id == plain[k][0] and (ids == plain[k][1]).all()
    assert records.read_records(records.write_records(empty(docs), entries.tokenizer_path())).count() == 0


def test_a_changed_byte_is_found():
    data, sizes = records.frames([b"abcdefghij0123456789"])
    assert records.unframe(data, [0]) == [b"abcdefghij0123456789"]
    for k in range(len(data)):
        broken = data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :]
        with pytest.raises(ValueError):
            records.unframe(broken, [0])


def test_width_of_ids(spark, monkeypatch):
    path = entries.tokenizer_path()
    assert records.id_width(path, 1) == 2 and records.id_width(path, 70_000) == 4
    docs = spark.createDataFrame([(1, "some words"), (2, "more of them")], "doc_id long, text string")
    wide = records.read_records(records.write_records(docs, path, end_id=70_000), with_ids=True).collect()
    assert all(r.ids[-1] == 70_000 for r in wide)
    monkeypatch.setattr(records, "id_width", lambda *_: 1)
    with pytest.raises(Exception, match="does not fit"):
        records.read_records(records.write_records(docs, path)).collect()


def test_pieces_of_one_hash(monkeypatch):
    encoder = records.Encoder(entries.tokenizer_path())
    column = pa.array(["one two three, three two", "four"], pa.string())
    want, cuts = encoder.texts(column)
    monkeypatch.setattr(records.Encoder, "ODD", np.zeros(256, np.uint64))
    got, again = encoder.texts(column)
    assert got.tolist() == want.tolist() and again.tolist() == cuts.tolist()


# ---- 2


def brute_lines(rows, least, shortest):
    strip = " \t\n\x0b\x0c\r"
    fold = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    lines = [(d, (t or "").split("\n")) for d, t in rows]
    holders = {}
    for n, (d, ls) in enumerate(lines):
        for key in {x.strip(strip).translate(fold) for x in ls}:
            if len(key) >= shortest:
                holders.setdefault(key, []).append(d)
    out = []
    for d, ls in lines:
        kept = []
        for x in ls:
            who = holders.get(x.strip(strip).translate(fold), [])
            keeper = max((h for h in who if h is not None), default=None)
            if len(who) < least or d == keeper:
                kept.append(x)
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_keys", [500_000, 1])
def test_line_dedup(docs, shard_keys):
    for least, shortest in ((5, 40), (2, 5)):
        got = linededup.dedup_lines(docs, least, shortest, shard_keys)
        rows = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in collect(got)), key=str)
        assert rows == brute_lines([(r.doc_id, r.text) for r in docs.collect()], least, shortest)
    assert linededup.dedup_lines(empty(docs)).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    table = linededup.PerfectHash.build(np.unique(keys))
    assert sorted(table.slots(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))
    h1 = np.array([5, 5, 9], np.uint64)
    shard = linededup.Shard.load(linededup.Shard.build(h1, np.array([1, 2, 3], np.uint64), np.array([7, 8, 9]), np.array([70, 80, 90])).dump())
    there, counts, keepers = shard.probe(np.array([5, 5, 9, 9, 4], np.uint64), np.array([1, 2, 3, 4, 1], np.uint64))
    assert there.tolist() == [True, True, True, False, False]
    assert counts[:3].tolist() == [7, 8, 9] and keepers[:3].tolist() == [70, 80, 90]


# ---- 3


def brute_components(rows, n, percent):
    fold = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if d is not None)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("n,similarity,k", [(3, 0.85, 64), (5, 0.8, 64), (3, 0.85, 8)])
def test_near_duplicates(spark, docs, n, similarity, k):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    rng = random.Random(5)
    base = words(120, 9)
    for j in range(60):
        own = list(base)
        for _ in range(rng.randrange(1, 12)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(1000)}"
        rows.append((1000 + j, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in collect(bottomk.near_duplicates(table, n, similarity, k))}
    for d, (size, component) in brute_components(rows, n, round(100 * similarity)).items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (size, component, component == d)


def test_near_duplicates_with_repeated_ids(spark):
    a, b = words(60, 21), words(60, 22)
    near = lambda w, k: " ".join([*w[:k], "other", *w[k + 1 :]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 30)), (3, near(b, 30)), (4, " ".join(words(60, 23))), (4, None), (4, ""), (None, " ".join(a)), (5, "")]
    table = spark.createDataFrame([(*r, 0, "x", [1]) for r in rows], "doc_id long, text string, n int, rep string, sketch array<int>").repartition(3)
    got = {(r["doc_id"], r["n_shingles"] > 0): (r["component_id"], r["kept"]) for r in collect(bottomk.near_duplicates(table, 5, 0.8))}
    assert got == {(1, True): (1, True), (2, True): (1, False), (3, True): (1, False), (4, True): (4, True), (4, False): (4, True), (None, True): (None, True), (5, False): (5, True)}


def test_near_copies_around_the_threshold(spark, monkeypatch):
    # one list holds all, most pairs are just below or above the threshold, and the stars leave many components
    rng, base, rows = random.Random(8), words(150, 31), []
    for j in range(150):
        own = list(base)
        for _ in range(rng.randrange(3, 16)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10_000)}"
        rows.append((j, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows, 3, 85)
    assert len({c for _, c in want.values()}) > 5
    for short in (2, 32, 1000):
        monkeypatch.setattr(bottomk, "SHORT", short)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collect(bottomk.near_duplicates(table, 3, 0.85))}
        assert got == want


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 5000, rng.integers(1, 3000)).astype(np.uint64)) for _ in range(2))
        apart = sum(int(x).bit_count() for x in (bottomk.bitmap(a) ^ bottomk.bitmap(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def test_shingles_of_long_texts(monkeypatch):
    text = " ".join(words(3000, 40)) + " " + "x" * 3000 + "\n" + " ".join(words(50, 41)) + "  "
    raw = np.frombuffer(text.encode(), np.uint8)
    want = bottomk.shingle_sets(raw, np.array([0, len(raw)]), 3)[0]
    monkeypatch.setattr(bottomk, "BATCH", 100)
    assert (bottomk.shingle_sets(raw, np.array([0, len(raw)]), 3)[0] == want).all()


def test_near_duplicates_of_nothing(docs):
    assert bottomk.near_duplicates(empty(docs)).count() == 0
    assert bottomk.near_duplicates(docs.filter("doc_id is null")).count() == 2


def test_connected(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (200, 201)]
    got = {r.rep: r.component for r in bottomk.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


# ---- 4


def test_compaction(spark, docs):
    store = compaction.ShardStore(spark, scratch(spark, "store"), fan_in=3, base_bytes=500, target_bytes=100_000)
    assert store.read().count() == 0
    for k in range(10):
        store.append(docs.filter(f"pmod(coalesce(doc_id, 0), 10) = {k}"))
    store.append(empty(docs))
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    tiers = [t for t, _, _ in store.layout()]
    assert all(tiers.count(t) < 3 for t in tiers) and max(tiers) > 0
    before = store.manifest()
    store.commit(before)
    with pytest.raises(RuntimeError):
        store.commit(before)
    every = compaction.ShardStore(spark, scratch(spark, "store"), fan_in=3, base_bytes=500)
    every.append_all(docs, mixing.unit(docs.doc_id) % 7)
    assert sorted(map(str, every.read().collect())) == sorted(map(str, docs.collect()))


def test_compaction_keeps_readers_and_columns(spark):
    store = compaction.ShardStore(spark, scratch(spark, "store"), fan_in=2, base_bytes=500)
    rows = spark.range(40).selectExpr("id", "10 * id as __arrival", "cast(null as string) as arrival")
    store.append(rows.filter("id < 10"))
    version = store.manifest()["version"]
    reader = store.read(version)
    store.append(rows.filter("id between 10 and 19"))
    store.append_all(rows.filter("id >= 20"), mixing.unit(rows.id) % 3)
    assert store.manifest()["version"] > version + 1
    assert reader.count() == 10 and store.read(version).selectExpr("sum(__arrival)").first()[0] == 450
    assert store.read().selectExpr("sum(__arrival)").first()[0] == 7800
    store.vacuum(keep=1, age=3600)
    assert store.read(version).count() == 10
    store.vacuum(keep=1, age=-60)
    assert store.versions() == [store.manifest()["version"]] and store.read().count() == 40
    store.append_all(rows, rows.arrival.cast("long"))
    assert store.read().count() == 80


def test_compaction_by_two_writers(spark):
    store = compaction.ShardStore(spark, scratch(spark, "store"), fan_in=4, base_bytes=500)
    other = compaction.ShardStore(spark, store.folder, fan_in=4, base_bytes=500)
    commit, late = store.commit, [spark.range(3).toDF("id")]

    def beaten(manifest):
        if late:
            other.append(late.pop())
        return commit(manifest)

    store.commit = beaten
    store.append(spark.range(3, 7).toDF("id"))
    assert sorted(r.id for r in store.read().collect()) == list(range(7))


def test_plan_of_merges(spark):
    store = compaction.ShardStore(spark, scratch(spark, "store"), fan_in=4, base_bytes=100)
    runs = [{"name": str(k), "tier": 0, "bytes": 60, "files": []} for k in range(16)]
    (whole,) = store.plan(runs)
    assert len(whole["parts"]) == 16 and whole["bytes"] == 960 and whole["tier"] == 2
    assert [len(m["parts"]) for m in store.plan(runs[:11])] == [4, 4] and store.plan(runs[:3]) == []


def test_compaction_of_changing_columns(spark):
    store = compaction.ShardStore(spark, scratch(spark, "store"), fan_in=2, base_bytes=500)
    store.append(spark.createDataFrame([(1, "a")], "id int, t string"))
    store.append(spark.createDataFrame([(2, "b", 7)], "id int, t string, extra int"))
    store.append(spark.createDataFrame([(3, 8)], "id int, extra int"))
    store.append(spark.createDataFrame([(4, "d")], "id int, t string"))
    assert sorted(tuple(r) for r in store.read().select("id", "t", "extra").collect()) == [(1, "a", None), (2, "b", 7), (3, None, 8), (4, "d", None)]
    for wrong in "id long", "ID int":
        with pytest.raises(ValueError, match="does not fit"):
            store.append(spark.createDataFrame([(5,)], wrong))
    assert store.read().count() == 4


# ---- 5


def test_resampling_keeps_good_text(spark):
    good = [(k, " ".join(words(80, k)), 1, 0) for k in range(300)]
    # words of their own: a near copy of a target's text would be target-like, whatever is added to it
    bad = [(1000 + k, " ".join(w.upper() + "!!" for w in words(80, 1000 + k)), 0, 0) for k in range(60)]
    toxic = [(2000 + k, " ".join(words(76, 2000 + k) + ["scum", "idiot"] * 3), 1, 1) for k in range(40)]
    odd = [(3000, None, None, None), (3001, "", None, None), (None, "the fox", None, None)]
    rows = good + bad + toxic + odd
    docs = spark.createDataFrame([(d, t) for d, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q, t) for d, _, q, t in rows if q is not None and d % 2 == 0], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in collect(resample.resample(docs, labels))}
    assert np.mean([got[d]["kept"] for d, *_ in good]) > 0.95
    assert np.mean([got[d]["kept"] for d, *_ in bad]) < 0.05
    assert np.mean([got[d]["kept"] for d, *_ in toxic]) < 0.2
    assert got[3000]["log_weight"] is None and not got[3000]["kept"]
    assert sum(r["kept"] for r in got.values()) == round(len(got) * 150 / 200)
    assert resample.resample(docs.filter("false"), labels).count() == 0
    assert resample.resample(docs, labels.filter("false")).filter("kept").count() == len(rows)


def test_log_weights_are_ratios_of_likelihoods(spark):
    # few enough n-grams that no two share a bucket
    texts = [" ".join(words(10, k % 9)) + (" bad!! bad!!" if k % 3 == 0 else "") for k in range(12)] + ["One, one, ONE one", None, " ", "one"]
    marks = {k: (int(k % 3 > 0), int(k % 7 == 0)) for k in range(0, 12, 2)}
    docs = spark.createDataFrame([(k, t, 0.0, True) for k, t in enumerate(texts)], "doc_id long, text string, key double, kept boolean").repartition(3)
    labels = spark.createDataFrame([(k, *m) for k, m in marks.items()], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in collect(resample.resample(docs, labels))}
    bags = []
    for text in texts:
        units = re.findall(r"[a-z0-9]+|[^a-z0-9\s]+", (text or "").lower())
        bags.append([(u,) for u in units] + list(zip(units, units[1:])))
    target = [k for k, (q, t) in marks.items() if q and not t]
    for k, bag in enumerate(bags):
        if not bag:
            assert got[k]["log_weight"] is None
            continue
        raw = [g for b in bags for g in b]
        like = [g for j in target if j != k for g in bags[j]]
        share = len(like) / len(raw)
        alpha = resample.ALPHA
        want = sum(np.log((like.count(g) + alpha * share) / len(like) / ((raw.count(g) + alpha) / len(raw))) for g in bag)
        assert got[k]["log_weight"] == pytest.approx(want), texts[k]
    noise = [r["key"] - r["log_weight"] for r in got.values() if r["log_weight"] is not None]
    assert -3 < min(noise) and 0 < np.mean(noise) < 1.2
    order = sorted((r for r in got.values() if r["key"] is not None), key=lambda r: -r["key"])
    kept = round(len(texts) * len(target) / len(marks))
    assert {r["doc_id"] for r in got.values() if r["kept"]} == {r["doc_id"] for r in order[:kept]}
    repeated = collect(resample.resample(docs.union(docs), labels))
    assert len(repeated) == 2 * len(texts)


def test_noise_is_gumbel(spark):
    # equal texts have equal weights, so each third of them is drawn as often as any other
    docs = spark.range(6000).selectExpr("id as doc_id", "'the same words' as text")
    labels = spark.range(100).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    rows = resample.resample(docs, labels, share=0.5).selectExpr("doc_id", "key - log_weight as noise", "kept").collect()
    noise = np.sort([r.noise for r in rows])
    assert np.abs(np.exp(-np.exp(-noise)) - (np.arange(6000) + 0.5) / 6000).max() < 0.03
    assert sum(r.kept for r in rows) == 3000


def test_largest(spark):
    rows = [(float(k % 7), k) for k in range(50)] + [(None, 99)]
    keyed = spark.createDataFrame(rows, "key double, tie long")
    order = sorted(rows, key=lambda r: (-1e300 if r[0] is None else r[0], r[1]), reverse=True)
    for k in (0, 1, 5, 30, 50, 51):
        kept = {r.tie for r in resample.largest(keyed, k).filter("kept").collect()}
        assert kept == {t for _, t in order[:k]}


# ---- 6


def test_media(spark, docs):
    rows = {r["doc_id"]: r for r in collect(isomedia.digests(isomedia.store(docs.filter("doc_id is not null"))))}
    for r in docs.filter("doc_id is not null").collect():
        data = (r.text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        got = rows[r.doc_id]
        assert got["n_bytes"] == len(data) and got["payload_bytes"] == len(payload)
        assert got["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got["tail_crc32"] == zlib.crc32(payload[-32:])
        media = isomedia.mux(data)
        assert isomedia.demux(media) == payload and hashlib.sha256(media).hexdigest() == got["media_sha256"] and len(media) == got["media_bytes"]
    assert isomedia.store(empty(docs)).count() == 0


def test_probe(spark):
    media = isomedia.mux(bytes(range(256)) * 40)
    table = spark.createDataFrame([(1, bytearray(media)), (2, bytearray(media[:300])), (3, None), (4, bytearray(b"junk"))], "k int, media binary")
    got = {r.id: r for r in isomedia.probe(table, "k", "media").collect()}
    track = got[1].tracks[0]
    assert (track.codec, track.handler, track.timescale, track.duration, track.n_samples, track.n_bytes) == ("raw ", "vide", 25, 18, 18, 18 * 576)
    assert [k.time for k in track.keyframes] == [0, 12]
    assert all(media[k.offset : k.offset + k.size] == isomedia.padded(bytes(range(256)) * 40)[k.time * 576 : (k.time + 1) * 576] for k in track.keyframes)
    assert all(got[k].error and not got[k].tracks for k in (2, 3, 4))


# ---- 7


def test_warc(spark):
    rng = random.Random(2)
    rows = [(k, f"http://{'hot' if k % 3 else 'cold'}.example.org/{rng.randrange(9)}?x y", "<p>" + "same text " * 20 if k % 2 else f"<p>page {k} " + "z" * 200) for k in range(90)]
    rows += [(500, None, None), (501, "https://User@Example.COM:8443", "tiny"), (502, "no url\r\nX: 1", "tiny"), (None, "http://a.b/", "q" * 150), (600, "http://a.b/", "q" * 150), (500, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    folder, manifest = warc.write_archives(pages, archive_bytes=2000)
    assert manifest.count() > 7
    captures = warc.merge_index(spark, folder, manifest, fan_in=4, open_runs=4, range_captures=10)
    found = captures.collect()
    keys = [(r.urlkey.encode(), r.captured, warc.LAST_ID if r.page_id is None else r.page_id) for r in found]
    assert len(found) == len(rows) and keys == sorted(keys)
    got = warc.read_archives(folder, captures).collect()
    firsts = {}
    for d, _, h in rows:
        if d is not None and len(h or "") >= 100:
            firsts[h] = min(d, firsts.get(h, d))
    want = []
    for d, _, h in rows:
        data = (h or "").encode()
        to = firsts.get(h) if firsts.get(h) != d else None
        want.append((d, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    folder, manifest = warc.write_archives(pages.filter("false"))
    assert warc.read_archives(folder, warc.merge_index(spark, folder, manifest)).count() == 0


def test_loser_tree():
    rng = random.Random(4)
    for k in range(0, 9):
        streams = [sorted(rng.randrange(30) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(streams, lambda x: x)) == sorted(x for s in streams for x in s)


def test_sparse_index_is_searched(tmp_path):
    captures = [[f"k{k:05}", "2024", k, "response", "d", 1, None, "a", k, 1] for k in range(3000)]
    path = f"file://{tmp_path}/run"
    assert warc.write_run(path, iter(captures))[0] == 3000
    for low, high in ((None, None), (0, 10), (255, 258), (256, 256), (777, 2999), (2999, None), (1000, 1001)):
        got = list(warc.read_run(path, None if low is None else captures[low], None if high is None else captures[high]))
        assert got == captures[low or 0 : high]
    assert warc.first_place(path, captures[600]) > warc.first_place(path, captures[400]) > 0 == warc.first_place(path, captures[0])
    assert list(warc.read_run(path, ["zz", "", 0, "", "", 0, None, "", 0, 0], None)) == []
    assert warc.write_run(path, iter([]))[0] == 0 and list(warc.read_run(path, captures[0], None)) == []


# ---- 8


def brute_hits(text, items, width=10):
    fold = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    words_, hit, named = find(text), set(), set()
    for item, t in items:
        w = find(t)
        for k in range(max(1, len(w) - width + 1)) if w else []:
            win = w[k : k + width]
            for p in range(len(words_) - len(win) + 1):
                if words_[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    named.update([] if item is None else [str(item)])
    return len(words_), len(hit), sorted(named)


@pytest.mark.parametrize("block", [50_000, 2])
def test_decontamination(spark, block):
    items = [(1, " ".join(words(25, 50))), (2, "Öl ist, TEUER!"), (10, "fox"), (None, " ".join(words(11, 51))), (3, ""), (4, None), (2, "zwei"), (5, " ".join(words(25, 50)[5:]))]
    texts = [*ODD_TEXTS, "x " + " -- ".join(w.upper() for w in words(25, 50)[3:14]) + " y", "Das öl ist teuer? ÖL IST TEUER", "öl ist teuer", "A FOX!", " ".join(words(11, 51)), " ".join(words(25, 50)[:9]), "zwei zwei"]
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, items string").repartition(2)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in collect(decontam.scan(docs, benchmark, block_windows=block))}
    for k, text in enumerate(texts):
        n, hits, named = brute_hits(text, items)
        assert (got[k]["n_words"], got[k]["n_hit"], got[k]["items"]) == (n, hits, named), text
        spans = " ".join(text[s["begin"] : s["end"]] for s in got[k]["spans"]) if text else ""
        assert len(decontam.normalised(spans)) == hits
    clean = {r.doc_id for r in decontam.clean(docs, benchmark, block_windows=block).collect()}
    assert clean == {k for k in got if not got[k]["n_hit"]}
    assert decontam.scan(docs, benchmark.filter("false")).filter("n_hit > 0").count() == 0
    assert decontam.scan(docs.filter("false"), benchmark).count() == 0


# ---- 9


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: weight[s] * left / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {s: float(v) for s, v in (capped | share).items()}
        capped |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 30)) if k % 11 else None, rng.choice(["a", "b", "b", "c", "d", "d", "d", "d", "e", None])) for k in range(600)]
    rows += [(700, "only", "f"), (701, None, "g"), (None, "x y", "a"), (702, "p q", "b"), (702, "p q", "b")]
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, source string, size int, s int").repartition(4)
    got = collect(mixing.mix(docs))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = brute_targets(sizes)
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert r["taken"] in {r["size"] * k for k in range(4)}
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert goal[s] - 31 <= taken[s] <= goal[s] + 1e-9
    assert sorted(map(str, collect(mixing.mix(docs.repartition(2))))) == sorted(map(str, got))
    copies = mixing.repeated(docs)
    assert copies.columns == docs.columns
    assert copies.selectExpr("sum(size(filter(split(text, ' '), x -> x != '')))").first()[0] == sum(taken.values())
    assert mixing.mix(docs.filter("false")).count() == 0


# ---- 10

SPEECH = {"en": "the of and to in that was is for with on this from they have", "de": "der die und das nicht ein zu ist von mit auf für den sich dem", "fr": "le la les des une que est dans pour qui sur pas au avec ce"}


def speech(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(SPEECH[lang].split()) for _ in range(n))


def test_language_id(spark):
    langs = list(SPEECH)
    rows = [(k, speech(langs[k % 3], 40, k), langs[k % 3]) for k in range(300)]
    rows += [(1000 + k, t, None) for k, t in enumerate(ODD_TEXTS)] + [(2000, "12 345 !!", "en"), (None, speech("de", 30, 1), None)]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string").repartition(3)
    path = langcrf.train(docs)
    got = {r["doc_id"]: r for r in collect(langcrf.identify(docs, path))}
    for d, text, lang in rows:
        r = got[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1 if d is not None else False)
        assert 0 <= r["score"] <= 1
        if not any(map(str.isalpha, text or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        else:
            assert r["lang_pred"] in langs
    held = [(got[d]["lang_pred"], lang) for d, _, lang in rows if d is not None and d < 1000 and got[d]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97
    changed = docs.selectExpr("doc_id + 7 as doc_id", "text", "'zz' as lang")
    assert sorted((r["lang_pred"], r["score"]) for r in collect(langcrf.identify(changed, path)) if r["doc_id"] is not None) == sorted((r["lang_pred"], r["score"]) for r in got.values() if r["doc_id"] is not None)
    kept = langcrf.keep_identified(docs, path)
    assert kept.columns == docs.columns and kept.count() == sum(r["lang_pred"] != "und" for r in got.values())
    mixed = speech("en", 12, 3) + " " + speech("de", 12, 4)
    labels = [lang for *_, lang, _ in langcrf.label_words(langcrf.model_at(path), mixed)]
    assert np.mean([a == b for a, b in zip(labels, ["en"] * 12 + ["de"] * 12)]) > 0.8
    runs = langcrf.tag(spark.createDataFrame([(1, mixed), (2, None)], "doc_id int, text string"), path).collect()
    assert {r.lang for r in next(x for x in runs if x.doc_id == 1).runs} >= {"en", "de"}
    nothing = langcrf.train(docs.filter("false"))
    assert {r["lang_pred"] for r in collect(langcrf.identify(docs, nothing))} == {"und"}
    assert langcrf.identify(docs.filter("false"), path).count() == 0


def test_marginals_of_a_chain():
    rng = np.random.default_rng(2)
    cuts, moves = np.array([0, 3, 3, 4, 8]), rng.normal(size=(3, 3))
    scores = rng.normal(size=(8, 3)).astype(np.float32)
    got = langcrf.sums_of_marginals(scores, cuts, moves, each=True)
    import itertools

    for a, b in zip(cuts[:-1], cuts[1:]):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            weight = np.exp(sum(scores[a + t, s] for t, s in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
            for t, s in enumerate(path):
                want[t, s] += weight
        if b > a:
            assert np.allclose(got[a:b], want / want.sum(1, keepdims=True), atol=1e-4)
    sums = langcrf.sums_of_marginals(scores, cuts, moves)
    assert np.allclose(sums[0], got[:3].sum(0), atol=1e-4) and np.allclose(sums[1], 0)


def test_long_texts_in_slices(monkeypatch):
    rng = random.Random(6)
    langs = list(SPEECH)
    model = langcrf.fit([speech(langs[k % 3], 50, k) for k in range(150)], [langs[k % 3] for k in range(150)])
    text = " ".join(speech(langs[k % 3], rng.randrange(1, 60), k) for k in range(400)) + " 123 " + "\u65e5\u672c" * 3000 + "."
    raw = np.frombuffer(text.encode(), np.uint8)
    words_ = langcrf.Words(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(langcrf, "BLOCK", 10**6)
    want = langcrf.sums_of_marginals(model.scores(words_), words_.cuts, model.moves)[0]
    for block, limit in ((512, 10**9), (7, 10**9), (64, 400), (512, 5000)):
        monkeypatch.setattr(langcrf, "BLOCK", block)
        sums, count = langcrf.sums_of_long(model, raw, limit)
        # a cut inside of a run without blanks may move its words by a character
        assert abs(count - len(words_)) < 0.01 * len(words_) and np.allclose(sums, want, rtol=0.01)
        assert langcrf.slices(raw, limit)[0][0] == 0 and langcrf.slices(raw, limit)[-1][1] == len(raw)
    part = langcrf.slices(np.frombuffer(text[:20_000].encode(), np.uint8), 3000)
    assert all(b == c for (_, b), (c, _) in zip(part, part[1:])) and max(b - a for a, b in part) <= 3000


def test_memory_of_prediction_is_bounded():
    import tracemalloc

    text = " ".join(speech(list(SPEECH)[k % 3], 2000, k) for k in range(200))
    for count in (3, 60):
        labels = [f"l{k}" for k in range(count)]
        model = langcrf.Model(labels, np.zeros((len(langcrf.SIZES), langcrf.SLOTS + 1, count), np.float32), np.zeros(0, np.uint64), np.zeros((1, count), np.float32), np.zeros((count, count)))
        column = pa.array([text], pa.string())
        tracemalloc.start()
        langcrf.predict(model, column)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60_000_000 + 12 * len(text), (count, peak)


def short_texts(rng, lang, low, high):
    """A text of a few words; without blanks where the language writes none."""
    if lang in ("zh", "ja"):
        begin = {"zh": 0x4E00, "ja": 0x3042}[lang]
        return "".join(chr(begin + rng.randrange(60)) for _ in range(rng.randrange(6, 60)))
    letters = {"aa": "abcdefg", "bb": "nopqrst"}[lang]
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(rng.randrange(low, high)))


def test_language_of_short_texts():
    import pyarrow as pa

    rng = random.Random(4)
    # one language with long texts, the others with 1 to 31 words or without a blank; then short texts alone
    for kinds in (("aa", 90), ("bb", 32), ("zh", 0), ("ja", 0)), (("aa", 32), ("bb", 8), ("zh", 0)), (("aa", 2), ("bb", 2)):
        texts = [(short_texts(rng, lang, 33 if most == 90 else 1, most), lang) for lang, most in kinds for _ in range(120)]
        model = langcrf.fit([t for t, _ in texts[::2]], [x for _, x in texts[::2]])
        got, _ = langcrf.predict(model, pa.array([t for t, _ in texts[1::2]]))
        for lang in model.labels:
            assert np.mean([g == lang for g, (_, x) in zip(got, texts[1::2]) if x == lang]) > 0.95, lang
    assert langcrf.fit(["12 34", ""], ["aa", "bb"]).labels == ["aa", "bb"]


def test_all_languages_are_trained(spark, monkeypatch):
    rows = [(k, " ".join(chr(97 + k % 70 // 26) + chr(97 + k % 70 % 26) + x for x in "abcd"), f"l{k % 70:02}") for k in range(4200)]
    docs = spark.createDataFrame([*rows, (5001, "rare words", "l99")], "doc_id long, text string, lang string")
    found = [r.lang for r in langcrf.sample(docs, langcrf.PER_LANGUAGE, "doc_id", "text", "lang")]
    assert set(found) == {lang for *_, lang in rows} | {"l99"}
    monkeypatch.setattr(langcrf, "SAMPLED", 70)
    few = [r.lang for r in langcrf.sample(docs, langcrf.PER_LANGUAGE, "doc_id", "text", "lang")]
    assert set(few) == set(found) and len(few) < 0.75 * len(found)
    path = langcrf.train(docs)
    got = {r.doc_id: r.lang_pred for r in langcrf.identify(docs, path).collect()}
    assert np.mean([got[d] == lang for d, _, lang in rows]) > 0.95


def test_sequences_hold_all_words():
    cuts = np.array([0, 1, 1, 32, 64, 161, 163])
    rows = langcrf.sequences(np.zeros(163, int), cuts, np.random.default_rng(3))
    live = rows >= 0
    assert set(rows[live].tolist()) == set(range(163)) and (live[:, :-1] >= live[:, 1:]).all() and live[:, 0].all()
    # padding changes nothing: a row's gradient is that of the row alone
    rng = np.random.default_rng(5)
    scores, gold, moves = rng.normal(size=(2, 6, 3)), rng.integers(0, 3, (2, 6)), rng.normal(size=(3, 3))
    live = np.arange(6) < np.array([[6], [2]])
    gain, move = langcrf.chain_gradient(scores, gold, live, moves)
    parts = [langcrf.chain_gradient(scores[k : k + 1, :n], gold[k : k + 1, :n], np.ones((1, n), bool), moves) for k, n in ((0, 6), (1, 2))]
    assert np.allclose(gain[0], parts[0][0][0]) and np.allclose(gain[1, :2], parts[1][0][0]) and not gain[1, 2:].any()
    assert np.allclose(move, parts[0][1] + parts[1][1])


# ---- All


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from quernel.llm import _shared

    nothing = SimpleNamespace(get=lambda *_: None)
    for master, fails in (("yarn", True), ("spark://h:1", True), ("local-cluster[2,1,1024]", True), ("local[8]", False), ("local", False)):
        session = SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: nothing), conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None))
        if fails:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                _shared.shared_dir(session)
        else:
            assert _shared.shared_dir(session).startswith("file:/")


@pytest.fixture(scope="module")
def long(spark):
    """Texts of 300 kB with and without blanks, and clashing columns."""
    line = "A line that is repeated in all of these documents, of more than forty characters."
    body = "\n".join(" ".join(words(40, k)) for k in range(900))
    rows = [(k, f"{line}\n{body}\n{line}\n{'x' * 300_000}" if k < 2 else line, "en") for k in range(6)]
    return spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, lang string, n_lines int, digest string").repartition(2)


def test_long_texts(spark, long):
    rows = {r.doc_id: r.text for r in long.collect()}
    tokenizer = records.encoder(entries.tokenizer_path())
    encoded = records.read_records(records.write_records(long, entries.tokenizer_path()), with_ids=True).collect()
    assert all(r.ids == [*np.frombuffer(tokenizer.text(rows[r.doc_id]), "<u4").tolist(), 1] for r in encoded)
    dropped = {r["doc_id"]: r for r in collect(linededup.dedup_lines(long))}
    assert [dropped[k]["n_dropped"] for k in range(6)] == [2, 2, 1, 1, 1, 0] and dropped[0]["n_lines"] == 903
    near = {r["doc_id"]: r for r in collect(bottomk.near_duplicates(long))}
    assert near[1]["component_id"] == 0 and near[5]["component_id"] == 2 and near[0]["n_shingles"] == brute_components([(0, rows[0])], 5, 80)[0][0]
    benchmark = spark.createDataFrame([(7, " ".join(words(40, 899)[-12:]))], "item_id long, text string")
    hits = {r["doc_id"]: r for r in collect(decontam.scan(long, benchmark))}
    assert hits[0]["n_hit"] == 12 and hits[0]["items"] == ["7"] and hits[5]["n_hit"] == 0
    assert rows[0][hits[0]["spans"][0]["begin"] : hits[0]["spans"][0]["end"]] == " ".join(words(40, 899)[-12:])
    media = {r["doc_id"]: r for r in collect(isomedia.digests(isomedia.store(long)))}
    assert all(media[k]["n_bytes"] == len(rows[k].encode()) for k in rows)
    scores = collect(resample.resample(long, spark.createDataFrame([(0, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")))
    assert len(scores) == 6 and all(r["log_weight"] is not None for r in scores)
    assert mixing.mix(long.withColumn("source", long.lang)).count() == 6


def test_null_ids_of_media_and_pages(spark, docs):
    rows = collect(isomedia.digests(isomedia.store(docs)))
    assert len(rows) == docs.count() and sum(r["doc_id"] is None for r in rows) == 2
    pages = docs.selectExpr("doc_id as page_id", "lang as url", "text as html", "n as offset", "id as archive", "source as digest")
    folder, manifest = warc.write_archives(pages)
    got = collect(warc.read_archives(folder, warc.merge_index(spark, folder, manifest)))
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r.page_id) for r in pages.collect())


def test_stages_take_any_table(spark, docs):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    shape = entries.table(spark, sf_dir, "documents")
    odd = docs.select("doc_id", "text", "lang", "source", docs.n.alias("n_chars"))
    for table in (shape.filter("false"), odd, odd.filter("doc_id is null"), odd.withColumn("text", docs.text.substr(0, 0)), odd.withColumnRenamed("n_chars", "c0")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf_dir)
            assert name == "token_records" or out.columns == table.columns
            assert out.count() <= 3 * table.count()


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = entries.table(spark, sf_dir, "documents")
    counts = [docs.count()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = stage(spark, docs, sf_dir)
        if number < 4:
            assert docs.columns == columns
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name == "near_duplicates":
            ids = {r.doc_id: r.text for r in docs.collect()}
            assert all(size == 0 or component == d for d, (size, component) in brute_components(list(ids.items()), 5, 80).items())
        if name == "decontaminate":
            assert decontam.scan(docs, entries.table(spark, sf_dir, "benchmark")).filter("n_hit > 0").count() == 0
    assert counts[0] >= counts[1] > counts[2] > counts[3] and counts[5] == counts[4]


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_against_sql(spark, duck, name):
    got = entries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    want = duck.sql(entries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_rows = lambda df: sorted(tuple("null" if v is None or v is pd.NA or v != v else str(float(v)) if isinstance(v, (int, float, np.number)) else str(v) for v in row) for row in df[columns].itertuples(index=False))
    assert as_rows(got) == as_rows(want)


def letters_of(label, words, seed):
    """A text of a language that has six letters of its own."""
    own = random.Random(label).sample("abcdefghijklmnopqrstuvwxyz", 6)
    rng = random.Random(f"{label}-{seed}")
    return " ".join("".join(rng.choices(own, k=rng.randint(3, 8))) for _ in range(words))


def test_many_languages_are_a_tree(monkeypatch):
    labels = [f"l{k:03d}" for k in range(100)]
    texts = [letters_of(x, 60, j) for x in labels for j in range(2)]
    model = langcrf.fit(texts, [x for x in labels for _ in range(2)])
    assert len(model.labels) == langcrf.WAYS and sum(len(m.labels) for m in model.children.values()) == 100
    again = langcrf.Model.load(model.dump())
    held = pa.array([letters_of(x, 60, 9) for x in labels] + ["12 34", None])
    found, scores = langcrf.predict(again, held)
    assert np.mean([a == b for a, b in zip(found, labels)]) > 0.9 and found[-2:] == ["und", "und"] and ((scores >= 0) & (scores <= 1)).all()
    assert all(name in labels for _, _, name, _ in langcrf.label_words(again, letters_of("l007", 30, 3)))
    # deeper trees of the same labels
    monkeypatch.setattr(langcrf, "FANOUT", 8)
    monkeypatch.setattr(langcrf, "WAYS", 4)
    deep = langcrf.fit(texts, [x for x in labels for _ in range(2)])
    assert any(m.children for m in deep.children.values())
    found, _ = langcrf.predict(deep, held)
    assert np.mean([a == b for a, b in zip(found, labels)]) > 0.8


def test_a_step_changes_what_it_has_seen_as_a_whole_step_would():
    rng = np.random.default_rng(2)
    table, square = rng.normal(size=(50, 3)).astype(np.float32), np.full((50, 3), 1e-2, np.float32)
    whole, squares = table.copy(), square.copy()
    slot, gains = rng.integers(0, 30, 200), rng.normal(size=(200, 3))
    touched = langcrf.Touched(table, square, slot)
    for k in range(3):
        touched.climb(k, gains[:, k])
        langcrf.climb(whole[:, k], squares[:, k], np.bincount(slot, weights=gains[:, k], minlength=50))
    touched.back()
    assert (table == whole).all() and (square == squares).all()


def test_a_column_of_junk_languages_trains_in_bounds():
    import tracemalloc

    labels = [f"junk{k}" for k in range(600)]
    texts = [letters_of(x, 12, 0) for x in labels]
    tracemalloc.start()
    model = langcrf.fit(texts, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400_000_000 and len(model.dump()) < 150_000_000
    assert set(langcrf.predict(model, pa.array(texts))[0]) <= set(labels)
