"""Numeric kernels over one time-sorted series, as numpy arrays.

``times`` are integer ticks in ascending order, ``values`` doubles.  The kernels
know nothing of Spark; :mod:`tickforge.functions.series_ops` applies them per series.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np

# The MAD consistency factor, the detector's window, the cost of an inserted or removed point (100 s) in nanoseconds.
MAD_FACTOR = 1.4826
TIME_WINDOW = 10
EDIT_COST = 100_000_000_000
#: Times turned into other numbers at once.
_PART = 1 << 14
TOO_FEW = "At least two non-NaN values are needed"


class SeriesError(ValueError):
    """A series on which a function is not defined."""


def mad(x: np.ndarray) -> float:
    return MAD_FACTOR * float(np.median(np.abs(x - np.median(x))))


def interpolate(times: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Replace non-finite values on the line through their neighbours; beyond the ends, on the line of the two nearest."""
    good = np.flatnonzero(np.isfinite(values))
    if len(good) < 2:
        raise SeriesError(TOO_FEW)
    t = times.astype(float)
    right = np.clip(np.searchsorted(good, np.arange(len(values))), 1, len(good) - 1)
    a, b = good[right - 1], good[right]
    line = values[a] + (values[b] - values[a]) * ((t - t[a]) / (t[b] - t[a]))
    return np.where(np.isfinite(values), values, line)


def _nearest(x: float) -> int:
    """Round half away from zero."""
    return int(np.floor(abs(x) + 0.5) * np.sign(x))


def time_faults(times: np.ndarray) -> tuple[int, int, int]:
    """``(missing, late, redundant)`` points by the ratio of each interval to the median interval.

    The rule sees ``TIME_WINDOW`` points from the one it stands on.  If the next point lies at most
    half a usual interval ahead, that point is redundant.  If it lies two to nine ahead,
    points are owed; close points seen after it, up to the next gap, pay for them (they came late), the rest
    is missing.  Points so accounted for are passed over, and as many further ones come into sight.
    """
    if len(times) < 2:
        return 0, 0, 0
    base = float(np.median(np.diff(times), overwrite_input=True))
    coming = (int(t) for k in range(0, len(times), _PART) for t in times[k : k + _PART].tolist())
    missing = late = redundant = 0
    here, ahead = next(coming), list(islice(coming, TIME_WINDOW - 1))
    while ahead:
        first, used = _ratio(ahead[0] - here, base), 0
        if first <= 0.5:
            del ahead[0]
            used = 1
            redundant += 1
        elif 2.0 <= first <= 9.0:
            owed = _nearest(first - 1)
            paid = _latecomers(ahead, base, owed)
            used = len(paid)
            if paid:
                ahead = [t for i, t in enumerate(ahead) if i not in paid]
            missing += owed - used
            late += used
        ahead += islice(coming, 1 + used)
        if not ahead:
            break
        here = ahead.pop(0)
    return missing, late, redundant


def _ratio(gap: int, base: float) -> float:
    return gap / base if base else float("inf") if gap else float("nan")


def _latecomers(ahead: list[int], base: float, most: int) -> list[int]:
    """Places of the points ahead that lie at most half a usual interval after the last regular one, up to the next gap."""
    regular, late = ahead[0], []
    for i in range(1, len(ahead)):
        step = _ratio(ahead[i] - regular, base)
        if step >= 2.0 or len(late) == most:
            break
        if step <= 0.5:
            late.append(i)
        else:
            regular = ahead[i]
    return late


def _outliers(x: np.ndarray) -> int:
    if not len(x):
        return 0
    away = x.copy()
    np.abs(np.subtract(x, np.median(away, overwrite_input=True), out=away), out=away)
    spread = MAD_FACTOR * float(np.median(away, overwrite_input=True))  # this changes only their order
    return int(np.count_nonzero(away > 3.0 * spread))


def quality(times: np.ndarray, values: np.ndarray) -> dict[str, float]:
    """The four data-quality scores of a series."""
    n = len(times)
    special = n - int(np.count_nonzero(np.isfinite(values)))
    v = interpolate(times, values) if special or n < 2 else values
    missing, late, redundant = time_faults(times)
    # one array at a time, as a series may be long
    with np.errstate(divide="ignore", invalid="ignore"):
        bad = _outliers(v)
        step = np.diff(v)
        bad += _outliers(step)
        for k in range(0, n - 1, _PART):
            step[k : k + _PART] /= np.diff(times[k : k + _PART + 1].astype(float))
        bad += _outliers(step) + _outliers(np.diff(step))
    return {"completeness": 1.0 - (missing + special) / (n + missing), "consistency": 1.0 - redundant / n, "timeliness": 1.0 - late / n, "validity": 1.0 - 0.25 * bad / n}


def middle_interval(times: np.ndarray) -> int:
    """The middle interval by the index rule that counts points, not intervals (from three points on)."""
    n, gaps = len(times), np.sort(np.diff(times))
    if n < 3:
        raise SeriesError("at least three points are needed")
    return int(gaps[n // 2]) if n % 2 else int((int(gaps[n // 2 - 1]) + int(gaps[min(n // 2, n - 2)])) / 2)


def usual_interval(times: np.ndarray) -> int:
    """The most frequent interval, the smallest of equals."""
    gaps, count = np.unique(np.diff(times), return_counts=True)
    return int(gaps[count.argmax()])


def cluster_interval(times: np.ndarray, k: int = 3) -> int:
    """The mean interval of the largest of three clusters (k-means from evenly spaced means, integer means)."""
    gaps = np.diff(times).astype(np.int64)
    low, high = int(gaps.min()), int(gaps.max())
    means = np.array([low + (i + 1) * (high - low) // (k + 1) for i in range(k)], dtype=np.int64)
    label = np.zeros(len(gaps), dtype=int)
    while True:
        new = np.abs(gaps[:, None] - means[None, :]).argmin(axis=1)
        sums, counts = np.bincount(new, weights=gaps, minlength=k), np.bincount(new, minlength=k)
        means = np.where(counts > 0, (sums / np.maximum(counts, 1)).astype(np.int64), means)
        if (new == label).all():
            break
        label = new
    largest = k - 1 - int(counts[::-1].argmax())
    mine = gaps[label == largest]
    return int(mine.sum() // len(mine))


def start_by_mode(times: np.ndarray, step: int) -> int:
    """The grid's start from the most frequent residue (the smallest of equals), at or before the first point."""
    residue = np.fmod(times, step)
    kinds, count = np.unique(residue, return_counts=True)
    anchor = int(times[np.flatnonzero(residue == kinds[count.argmax()])[-1]])
    first = int(times[0])
    return anchor - max(0, -(-(anchor - first) // step)) * step


def start_by_line(times: np.ndarray, step: int) -> int:
    """The mean of the starts that each point would give."""
    total = sum(times.tolist()) - step * (len(times) * (len(times) - 1) // 2)
    return int(abs(total) // len(times)) * (1 if total >= 0 else -1)


def repair_times(times: np.ndarray, values: np.ndarray, method: str = "median", interval: int | None = None, start_mode: str = "mode", cost: int = EDIT_COST) -> tuple[np.ndarray, np.ndarray]:
    """Move the points onto a regular grid at the least cost; inserted points have no value (NaN).

    An edit distance between points and grid: inserting or removing costs
    ``cost`` ticks, moving costs the distance in ticks.  The table is filled along
    its anti-diagonals, each in one vector step.
    """
    values = np.where(np.isfinite(values), values, np.nan)
    if interval is not None:
        if interval < 0:
            raise SeriesError("interval must be positive")
        step = interval
    else:
        rules = {"median": middle_interval, "mode": usual_interval, "cluster": cluster_interval}
        if method not in rules:
            raise SeriesError(f"Invalid method: {method}")
        if len(times) <= 2:
            return times, values
        step = rules[method](times)
    starts = {"mode": start_by_mode, "linear": start_by_line}
    if start_mode not in starts:
        raise SeriesError(f"Invalid start_mode: {start_mode}")
    if len(times) <= 2 or step <= 0:
        return times, values
    start = starts[start_mode](times, step)
    n, m = int(np.ceil((int(times[-1]) - start) / step + 1.0)), len(times)
    grid = start + step * np.arange(n, dtype=np.int64)
    move, insert, remove = 0, 1, 2
    steps = np.zeros((n + 1, m + 1), dtype=np.int8)
    steps[:, 0], steps[0, :] = insert, remove
    older, old = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)  # cost on the last two diagonals, by row
    old[:2] = cost
    if n < 1:
        return times[:0], values[:0]
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        distance = np.abs(times[j - 1] - grid[i - 1])
        up, left, corner = old[i - 1], old[i], older[i - 1]
        edit = np.minimum(up, left) + cost
        kind = np.where(up < left, insert, remove)
        better = (corner + distance < edit) | (distance == 0)
        new = np.zeros(n + 1, np.int64)
        new[i] = np.where(better, corner + distance, edit)
        steps[i, j] = np.where(better, move, kind)
        if d <= n:
            new[d] = cost * d
        if d <= m:
            new[0] = cost * d
        older, old = old, new
    out = np.full(n, np.nan)
    i, j = n, m
    while i >= 1 and j >= 1:
        if steps[i, j] == move:
            out[i - 1] = values[j - 1]
            i, j = i - 1, j - 1
        elif steps[i, j] == insert:
            i -= 1
        else:
            j -= 1
    return grid, out


def fill_values(values: np.ndarray, method: str = "linear") -> np.ndarray:
    """Fill gaps (NaN) by place in the series: ``mean``, ``previous``, ``linear``, ``ar`` or ``ma``."""
    method, n = method.lower(), len(values)
    gap, good = ~np.isfinite(values), np.flatnonzero(np.isfinite(values))
    if method not in ("mean", "previous", "linear", "ar", "ma"):
        raise SeriesError(f"Invalid fill method: {method}")
    if n == 0 or not gap.any():
        return values.copy()
    mean = values[good].mean() if len(good) else np.nan
    if method == "mean":
        return np.where(gap, mean, values)
    if method == "previous":
        held = np.maximum.accumulate(np.where(gap, -1, np.arange(n)))
        return np.where(held >= 0, values[held], np.nan)
    if method == "linear":  # the nearest value beyond either end
        return np.interp(np.arange(n), good, values[good]) if len(good) else values.copy()
    if method == "ar":  # x[i] = theta x[i-1] + mean residual; gaps count as 0 in the fit, not in the residual
        x = np.where(gap, 0.0, values)
        power = float((x[:-1] ** 2).sum())
        pairs = ~gap[:-1] & ~gap[1:]
        if power == 0.0 or not pairs.any():
            raise SeriesError("Cannot fit AR(1) model. Please try another method.")
        theta = float((x[:-1] * x[1:]).sum()) / power
        rest = float((values[1:] - theta * values[:-1])[pairs].mean())
        out = values.copy()
        for i in np.flatnonzero(gap):
            out[i] = theta * out[i - 1] + rest if i else mean
        return out
    # the mean of all values up to a place that grows with the series, from the first four on
    width, i = 5, np.arange(n)
    half = (width - 1) // 2
    steps = np.clip(i - half - 1, 0, max(0, n - 2 * half - 2))
    end = np.minimum(width - 1 + steps, n)
    total, count = np.append(0, np.cumsum(np.where(gap, 0.0, values))), np.append(0, np.cumsum(~gap))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(gap, total[end] / count[end], values)


def repair_screen(times: np.ndarray, values: np.ndarray, min_speed: float | None = None, max_speed: float | None = None) -> np.ndarray:
    """Speed-constraint repair: each value becomes the median of what later points within the window allow, within reach of the value before."""
    v, t = interpolate(times, values), times.astype(float)
    width = 5 * middle_interval(times)
    speed = np.diff(v) / np.diff(t)
    spread, centre = mad(speed), float(np.median(speed))
    low = centre - 3.0 * spread if min_speed is None else min_speed
    high = centre + 3.0 * spread if max_speed is None else max_speed
    out, n = v.copy(), len(v)
    for i in range(n):
        end = int(np.searchsorted(times, times[i] + width, side="right"))
        back = t[i] - t[i + 1 : end]
        allowed = np.sort(np.concatenate([out[i : i + 1], out[i + 1 : end] + low * back, out[i + 1 : end] + high * back]))
        best = allowed[len(back)]
        if i:
            reach = t[i] - t[i - 1]
            best = max(out[i - 1] + low * reach, min(out[i - 1] + high * reach, best))
        out[i] = best
    return out


def repair_greedy(times: np.ndarray, values: np.ndarray, center: float = 0.0, sigma: float | None = None) -> np.ndarray:
    """Repair the largest change of speed first, until all lie within three sigma (a heap with lazy deletion)."""
    v, t = interpolate(times, values).copy(), times.astype(float)
    n = len(v)
    if n < 3:
        return v
    spread = mad(np.diff(np.diff(v) / np.diff(t))) if sigma is None else sigma
    limit, tiny = 3.0 * spread, 1e-12
    change = lambda i: (v[i + 1] - v[i]) / (t[i + 1] - t[i]) - (v[i] - v[i - 1]) / (t[i] - t[i - 1])
    age, heap = [0] * n, []

    def offer(i: int) -> None:
        age[i] += 1
        u = change(i)
        if abs(u - center) > limit:
            heapq.heappush(heap, (-abs(u - center), i, age[i], u))

    for i in range(1, n - 1):
        offer(i)
    for _ in range(1000 * n):
        while heap and heap[0][2] != age[heap[0][1]]:
            heapq.heappop(heap)
        if not heap or -heap[0][0] < max(tiny, limit):
            break
        _, i, _, u = heap[0]
        size = abs(u - center) if spread < tiny else max(spread, abs((u - center) / 3.0))
        size *= (t[i + 1] - t[i]) * (t[i] - t[i - 1]) / (t[i + 1] - t[i - 1])
        v[i] += size if u > center else -size
        for k in range(max(1, i - 1), min(n - 2, i + 1) + 1):
            offer(k)
    return v
