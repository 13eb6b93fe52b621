"""Worked examples of the series kernels."""

import tracemalloc

import numpy as np
import pytest

from tickforge.functions import kernels as K

# Inputs and results of worked examples.
NAN = float("nan")
TIMES = np.array([1, 3, 4, 6, 10, 13, 14, 16, 18, 19, 22, 24, 26, 31, 33])
VALUES = np.array([12.34, 34.54, 1.43, 14.03, 12.30, 11.54, 112.20, 14.44, 134.02, 116.34, 1234.45, 10.36, 124.21, 6.34, NAN])
GRID = np.array([0, 10, 19, 30, 40, 50, 61, 71, 81, 91]) * 10**9
FILL_T = np.array([2, 3, 4, 6, 8, 10, 14, 15, 16, 18, 20, 22, 26, 28, 30])
FILL_V = np.array([NAN, 101, 102, 104, 126, 108, NAN, 113, 114, 116, NAN, NAN, 124, 126, 128])


def test_quality():
    assert K.quality(TIMES, VALUES) == pytest.approx({"completeness": 0.8235294117647058, "consistency": 0.8666666666666667, "timeliness": 0.9333333333333333, "validity": 0.8})


@pytest.mark.parametrize("values", [[12.34], [12.34, NAN, NAN]])
def test_quality_needs_two_values(values):
    with pytest.raises(K.SeriesError, match="At least two"):
        K.quality(np.arange(len(values)), np.array(values))


def test_quality_holds_few_copies():
    r = np.random.default_rng(3)
    times, values = np.sort(r.integers(0, 10**12, 300_000)), r.normal(size=300_000)
    tracemalloc.start()
    K.quality(times, values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * times.nbytes


@pytest.mark.parametrize("how", [{}, {"method": "mode"}, {"method": "cluster"}, {"interval": 10 * 10**9}])
def test_repair_times(how):
    t, v = K.repair_times(GRID, np.arange(1.0, 11.0), **how)
    assert (t // 10**9).tolist() == list(range(0, 101, 10))
    assert v[:-1].tolist() == list(range(1, 11)) and np.isnan(v[-1])


def test_repair_times_linear_start():
    assert K.repair_times(GRID, np.arange(1.0, 11.0), start_mode="linear")[0][0] == 300_000_000


def test_repair_times_short_and_bad():
    assert K.repair_times(GRID[:2], np.array([1.0, 2.0]))[0].tolist() == GRID[:2].tolist()
    with pytest.raises(K.SeriesError):
        K.repair_times(GRID, np.arange(10.0), method="nothing")
    with pytest.raises(K.SeriesError, match="positive"):
        K.repair_times(GRID, np.arange(10.0), interval=-1)


@pytest.mark.parametrize(
    ("method", "wanted"),
    [("mean", [114.72727272727273] * 4), ("previous", [NAN, 108, 116, 116]), ("linear", [101, 110.5, 118.66666666666667, 121.33333333333333]), ("AR", [114.72727272727273, 110.81413693465396, 117.33359859078759, 118.42039170045177]), ("MA", [102.33333333333333, 108.2, 110.5, 110.5])],
)
def test_fill(method, wanted):
    assert K.fill_values(FILL_V, method)[[0, 6, 10, 11]] == pytest.approx(wanted, nan_ok=True)


def test_repair_values():
    wanted = [100, 101, 102, 104, 106, 108, 112, 113, 114, 116, 118, 120, 124, 126, 128]
    assert K.repair_screen(FILL_T, FILL_V) == pytest.approx(wanted)
    assert K.repair_greedy(FILL_T, FILL_V) == pytest.approx(wanted)
    assert K.repair_greedy(FILL_T, FILL_V, 0.0, 0.0) == pytest.approx(wanted)
