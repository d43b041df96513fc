"""Coarse spans of many and of long episodes: results as by brute force, and work in proportion to the frames."""

import random

import pytest

from quernel.operators import series, spans as S, trajectory


@pytest.fixture
def small_batches(spark):
    """Batches of a few rows, so that episodes go on from one to the next."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, was)


def random_events(seed):
    rng = random.Random(seed)
    return [(f"e{ep}", arm, f, rng.choice(["open", "close"]), f - rng.randrange(3) if rng.random() < 0.8 else None, f + rng.randrange(3)) for ep in range(6) for arm in ("left", "right") for f in sorted(rng.sample(range(120), 30 * (ep % 3)))]


EVENTS = "ep string, arm string, frame long, kind string, start_frame long, end_frame long"


def test_spaced_by_brute_force(spark, small_batches):
    rows = [(ep, arm, f, kind, f) for ep, arm, f, kind, *_ in random_events(1)]
    table = spark.createDataFrame(rows, "ep string, arm string, mid long, kind string, start long").repartition(3)
    want = []
    for key in sorted({r[:2] for r in rows}):
        last = None
        for row in sorted(r for r in rows if r[:2] == key):
            if last is None or row[2] - last >= 4:
                want.append(row)
                last = row[2]
    kept = series.spaced(table, 4, ("ep", "arm"))
    assert sorted(map(tuple, kept.collect())) == sorted(want) and len(want) < len(rows)
    assert kept.schema == table.schema and series.spaced(table.filter("false"), 4).count() == 0


def grouped(events, gap):
    """Each event, in order, takes all free partners."""
    out = []
    for ep in sorted({e[0] for e in events}):
        free = sorted(e for e in ((ep, f, arm, kind, f if a is None else a, b) for at, arm, f, kind, a, b in events if at == ep))
        while free:
            lead = free.pop(0)
            mates = [e for e in free if e[3] == lead[3] and e[2] != lead[2] and e[1] - lead[1] <= gap]
            free = [e for e in free if e not in mates]
            every = [lead, *mates]
            arms = {e[2] for e in every}
            out.append((ep, min(e[4] for e in every), max(e[5] for e in every), lead[1], lead[3], "left" in arms, "right" in arms))
    return sorted(out)


def test_groups_by_brute_force(spark, small_batches):
    events = random_events(2)
    got = trajectory.gripper_groups(spark.createDataFrame(events, EVENTS).repartition(3))
    want = grouped(events, 3)
    assert sorted(map(tuple, got.collect())) == want and any(g[5] and g[6] for g in want)


def test_segments_by_brute_force(spark):
    rng, segments = random.Random(3), []
    for ep in range(4):
        at = rng.randrange(3)
        while at < 400:
            end = at + rng.randrange(1, 60)
            segments.append((f"e{ep}", at, end, *rng.choice([(True, False), (False, True), (True, True)])))
            at = end + rng.choice([0, 1, 2, 5, 40])
    groups = [g for g in grouped(random_events(4), 3) if g[0] != "e3"]
    joined, parts = [], []
    for s in segments:
        was = joined[-1] if joined else None
        if was and was[0] == s[0] and was[3:] == s[3:] and not any(g[0] == s[0] and was[2] < g[1] < s[1] for g in groups):
            joined[-1] = (*was[:2], s[2], *s[3:])
        else:
            joined.append(s)
    for ep, start, end, left, right in joined:
        cuts = sorted({g[2] for g in groups if g[0] == ep and start <= g[2] < end and g[1] <= end and (left and g[5] or right and g[6])})
        parts += [(ep, a, b, left, right) for a, b in zip([start, *(c + 1 for c in cuts)], [*cuts, end]) if a <= b]
    s = spark.createDataFrame(segments, "ep string, start long, end long, left boolean, right boolean").repartition(3)
    g = spark.createDataFrame(groups, "ep string, start long, end long, frame long, kind string, left boolean, right boolean")
    got = trajectory.joined_segments(s, g)
    assert sorted((r.ep, r.start, r.end, r.left, r.right) for r in got.collect()) == sorted(joined) and len(joined) < len(segments)
    assert sorted((r.ep, r.start, r.end, r.left, r.right) for r in trajectory.split_segments(got, g).collect()) == sorted(parts) and len(parts) > len(joined)


def test_no_call_for_each_episode(spark):
    """Episodes share the Python calls of a task, and no join pairs all segments of an episode with all its groups."""
    frames = spark.createDataFrame([(0, 0, [0.0] * 16)], "ep long, f long, state array<double>")
    steps = spark.createDataFrame([], "ep long, pos int, text string, kind string, arm string, ends array<string>")
    plan = S.assign_coarse(frames, trajectory.gripper_events(frames), steps)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    lines = [line for line in plan.splitlines() if "Join" in line]
    assert lines and all("part#" in line for line in lines if any(word in line for word in (" < ", " > ", " <= ", " >= ")))


def test_looks_of_a_long_episode():
    """A walk looks at the groups around each segment, not at all that are left."""
    looks = 0

    class Counted(S.Piece):
        def __getattribute__(self, name):
            nonlocal looks
            looks += name in ("start", "end")
            return super().__getattribute__(name)

    def walked(n):
        nonlocal looks
        looks = 0
        left, right = frozenset(["left"]), frozenset(["right"])
        segments = [S.Piece(10 * k, 10 * k + 6, left) for k in range(n)]
        groups = [Counted(10 * k + 3, 10 * k + 4, right if k % 2 else left, "close" if k % 4 else "open", 10 * k + 3) for k in range(n)]
        assert S.coarse_spans([], segments, groups, 10 * n, None)[-1]["end"] == 10 * n - 1
        return looks

    assert walked(400) <= 4.4 * walked(100) and walked(400) < 400 * 20
