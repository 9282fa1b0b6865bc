"""Trend windows against brute force over pairs of scans."""

import datetime as dt
import random

import numpy as np
import pytest
from threatloom.operators import snapshots as sn


def test_windows_over_uneven_scan_times(spark):
    rng = random.Random(4)
    start = dt.datetime(2023, 12, 1)
    times = [start + dt.timedelta(seconds=rng.randrange(200 * 86400)) for _ in range(120)]
    times += [start + dt.timedelta(days=n) for n in (0, 7, 7, 14, 30, 60, 90, 150)]  # borders of windows, and equal times
    rows = [(repo, at, rng.choice([0.1, 0.4, 0.9])) for at in times for repo in ("a", "b") if rng.random() < 0.8]
    rows += [("one", start, 0.5), ("tie", start, 0.5), ("tie", start, 0.7)]
    scans = spark.createDataFrame([*rows, ("a", None, 0.5), ("a", start, None), ("nothing", None, None)], "repo_id string, scan_ts timestamp, max_risk double")
    want = []
    for repo, at, _ in rows:
        for days in (7, 30, 90):
            near = [(t, r) for other, t, r in rows if other == repo and dt.timedelta(0) <= at - t <= dt.timedelta(days=days)]
            x = np.array([(t - at).total_seconds() / 86400 for t, _ in near])
            y = np.array([r for _, r in near])
            spread = ((x - x.mean()) ** 2).sum()
            slope = ((x - x.mean()) * (y - y.mean())).sum() / spread if len({t for t, _ in near}) > 1 else None
            want.append((repo, at, days, len(near), float(y.mean()), float(y.max()), slope))
    key = lambda r: (r[0], r[1], r[2])
    got = sorted([tuple(r)[:7] for r in sn.trend_windows(scans).collect()], key=key)
    want.sort(key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[4:6] == pytest.approx(b[4:6]) and (a[6] is None) == (b[6] is None) and (b[6] is None or a[6] == pytest.approx(b[6], abs=1e-9))
    assert sn.trend_windows(scans.limit(0)).count() == 0
