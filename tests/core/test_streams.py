"""What a followed series holds: late rows, gaps, bounds; and the stream with them."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.kernels import arma
from seriesloom.streaming.forecasts import follow, joined


def test_rows_before_the_first_place_are_joined():
    first, ys, waiting = joined(0, [], {5: 5.0, 6: 6.0, 8: 8.0}, 100, 10)
    assert (first, ys, waiting) == (5, [5.0, 6.0], {8: 8.0})
    first, ys, waiting = joined(first, ys, {**waiting, 4: 4.0, 2: 2.0, 7: 7.0}, 100, 10)
    assert (first, ys, waiting) == (4, [4.0, 5.0, 6.0, 7.0, 8.0], {2: 2.0})
    assert joined(first, ys, {**waiting, 3: 3.0}, 100, 10) == (2, [float(t) for t in range(2, 9)], {})
    assert joined(first, ys, waiting, 100, 10, give_up=True) == (2, [float(t) for t in range(2, 9)], {})


def test_gaps_end_and_late_rows_overwrite_what_filled_them():
    assert joined(0, [0.0], {3: 3.0}, 100, 10) == (0, [0.0], {3: 3.0})
    assert joined(0, [0.0], {3: 3.0}, 100, 2) == (0, [0.0, 1.0, 2.0, 3.0], {})
    assert joined(0, [0.0, 1.0, 2.0, 3.0], {1: 9.0}, 100, 2) == (0, [0.0, 9.0, 2.0, 3.0], {})
    assert joined(0, [0.0] * 5, {10**9: 1.0}, 100, 10) == (10**9, [1.0], {})
    assert joined(50, [0.0] * 100, {49: 1.0, 20: 1.0}, 100, 10) == (50, [0.0] * 100, {})
    assert joined(0, [], {}, 100, 10) == (0, [], {})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=12), max_size=8), st.integers(1, 20), st.integers(0, 15))
def test_state_is_bounded_and_holds_the_latest_values(batches, keep, patience):
    first, ys, waiting, seen = 0, [], {}, {}
    for n, batch in enumerate(batches):
        seen.update(dict.fromkeys(batch, 100.0 + n))
        first, ys, waiting = joined(first, ys, waiting | dict.fromkeys(batch, 100.0 + n), keep, patience)
        assert len(ys) <= keep and len(waiting) <= keep + patience
        assert not any(first <= t < first + len(ys) for t in waiting)
        assert all(ys[t - first] == y for t, y in seen.items() if first <= t < first + len(ys) and t in batch)


def test_whole_series_in_any_order_of_batches():
    y, rng = np.arange(80) ** 1.5, np.random.default_rng(0)
    first, ys, waiting = 0, [], {}
    for part in np.array_split(rng.permutation(80), 9):
        first, ys, waiting = joined(first, ys, waiting | {int(t): float(y[t]) for t in part}, 200, 200)
    assert (first, ys, waiting) == (0, y.tolist(), {})


def test_stream_takes_earlier_rows(spark, tmp_path):
    y = np.cumsum(np.random.default_rng(3).normal(size=60))
    for i, (lo, hi) in enumerate(((30, 60), (0, 30))):
        rows = [("a", int(t), float(y[t])) for t in range(lo, hi)]
        spark.createDataFrame(rows, "series_id string, t int, y double").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("series_id string, t int, y double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = follow(stream, (0, 1, 1), h=1).writeStream.outputMode("update").format("memory").queryName("earlier").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = [r["forecast"] for r in spark.table("earlier").filter(F.col("t") == 59).collect()]
    assert any(v == pytest.approx(arma.Fitted(y[None], (0, 1, 1)).forecast(1)[0][0, 0], rel=1e-3) for v in rows)


def test_an_open_gap_ends_by_the_clock(spark, tmp_path):
    y = np.cumsum(np.random.default_rng(4).normal(size=30))
    spark.createDataFrame([("a", t, float(y[t])) for t in range(30) if t != 20], "series_id string, t int, y double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, t int, y double").parquet(str(tmp_path / "in"))
    query = follow(stream, (0, 1, 1), h=1, wait=0.2).writeStream.outputMode("update").format("memory").queryName("gap").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("gap").count() < 2:
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(r["t"] for r in spark.table("gap").collect()) == [19, 29]
