"""Training samples of one hand-made episode."""

import numpy as np
import pytest

from quernel.operators import samples


def test_samples(spark):
    out = np.zeros((30, 16))
    out[:, [3, 11]] = 1
    out[:, 0] = np.interp(np.arange(30), [0, 10, 12, 20], [0, 1, 1, 2])
    frames = spark.createDataFrame([(0, f, [float(x) for x in s]) for f, s in enumerate(out)], "ep long, f long, state array<double>")
    spans = spark.createDataFrame([(0, 0, 0, 12, True, False), (0, 1, 13, 29, True, False)], "ep long, idx long, start long, end long, left boolean, right boolean")
    rows = samples.build(frames, spans, stride=4).collect()
    pick = lambda group: sorted((r.idx, r.f) for r in rows if r.group == group)
    assert [r.idx for r in rows if r.kind == "plan"] == [0, 1]
    assert pick("current_done") == [(0, 10), (0, 11), (0, 12), *((1, f) for f in range(20, 30))]
    assert pick("undone") == [(0, 0), (0, 4), (0, 8), (1, 13), (1, 17)]
    assert pick("prev_done") == [(0, f) for f in range(13, 21)]
    assert {r.done for r in rows if r.group == "undone"} == {0}
    fewer = [r for r in samples.build(frames, spans, bucket=0.25).collect() if r.group == "undone"]
    assert sorted((r.idx, r.f) for r in fewer if r.idx == 0) == [(0, 1), (0, 4), (0, 6), (0, 9)]
    every = samples.rows_of(frames, spans).collect()
    assert len(every) == 30 and [r.f for r in every if r.done][:3] == [10, 11, 12]
    assert every[5].progress == pytest.approx(0.5)
    plans = spark.createDataFrame([(0, 5, 10, 2), (0, 10, 10, 2), (1, 29, 20, 2)], "idx long, f long, done_start long, n_spans long")
    assert [r.plan_start for r in samples.plan_start(plans).orderBy("f").collect()] == [0, 1, 1]
