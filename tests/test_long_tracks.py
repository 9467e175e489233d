"""Long tracks over many ranges, held against one walk."""

import random

import pytest

from cairngrid.operators import tracks

DDL = "track_id long, seq long, x double, y double, t long"


def recorded(r, track, n):
    """A recorded track: slow and fast stretches, jumps, points out of order, rests."""
    rows, x, y, t, speed = [], 0.0, 0.0, 0, 1.0
    for s in range(n):
        if r.random() < 0.03:
            speed = r.choice([0.0, 0.05, 1.0, 2.0, 3.6, 3.9])
        dt = r.choice([5, 10, 10, 20])
        t += dt * 1000
        x, y = x + speed * dt * r.choice([1, -1, 1]), y + r.uniform(-1, 1)
        far = r.random()
        rows.append((track, s, x + (900 if far < 0.04 else 0), y, t - (60_000 if far > 0.97 else 0)))
    return rows


def cleaned(rows, max_speed):
    out, last = [], None
    for row in rows:
        _, _, x, y, t = row
        dt = last and (t - last[2]) / 1000
        if last is None or dt > 0 and ((x - last[0]) ** 2 + (y - last[1]) ** 2) ** 0.5 / dt <= max_speed:
            out.append(row)
            last = (x, y, t)
    return out


def segments(rows, min_run_s=60.0, half=30_000):
    def kind(i):
        near = [(p[4], p[1], p) for p in rows if abs(p[4] - rows[i][4]) <= half]
        a, b = min(near)[2], max(near)[2]
        v = ((b[2] - a[2]) ** 2 + (b[3] - a[3]) ** 2) ** 0.5 / ((b[4] - a[4]) / 1000) if b[4] > a[4] else 0.0
        return "stationary" if v < 0.15 else "vehicle" if v > 3.0 else "foot"

    def merge(runs):
        out = []
        for r in runs:
            if out and out[-1][0] == r[0]:
                out[-1][2] = r[2]
            else:
                out.append(list(r))
        return out

    last = len(rows) - 1
    length = lambda r: (rows[min(r[2] + 1, last)][4] - rows[r[1]][4]) / 1000
    runs = merge([(kind(i), i, i) for i in range(len(rows))])
    for r in runs:
        if r[0] != "foot" and length(r) < min_run_s:
            r[0] = "foot"
    runs = merge(runs)
    for i in range(1, len(runs) - 1):
        if runs[i][0] == "foot" and length(runs[i]) < min_run_s and runs[i - 1][0] != "foot" and runs[i + 1][0] != "foot":
            runs[i][0] = runs[i - 1][0]
    return [(k, r[0], rows[r[1]][1], rows[r[2]][1], r[2] - r[1] + 1, length(r)) for k, r in enumerate(x for x in merge(runs) if x[2] > x[1])]


@pytest.fixture
def small_ranges(spark):
    """Ranges stay as small as they are dealt, so that tracks go across many."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


@pytest.mark.parametrize("seed", range(3))
def test_clean_tracks_over_ranges(spark, small_ranges, seed):
    r = random.Random(seed)
    sizes = {0: [700], 1: [3, 400, 1, 250, 2], 2: [20] * 12}[seed]
    rows = {k: recorded(r, k, n) for k, n in enumerate(sizes)}
    if seed == 0:  # a first point that is never reached again: all later ranges keep nothing
        rows[7] = [(7, 0, 0.0, 0.0, 10**12), *[(7, s, 1.0, 1.0, s) for s in range(1, 300)]]
    mixed = [x for v in rows.values() for x in v]
    r.shuffle(mixed)
    got = sorted(tuple(x) for x in tracks.clean_tracks(spark.createDataFrame(mixed, DDL), 4.0).collect())
    assert got == sorted(x for v in rows.values() for x in cleaned(v, 4.0))


def test_segments_over_ranges(spark, small_ranges):
    r = random.Random(11)
    rows = {k: cleaned(recorded(r, k, n), 9.0) for k, n in enumerate([500, 300, 40, 2, 1])}
    df = spark.createDataFrame([x for v in rows.values() for x in v], DDL)
    got = {}
    for x in tracks.segment_tracks(df).orderBy("track_id", "segment").collect():
        got.setdefault(x.track_id, []).append((x.segment, x.kind, x.from_seq, x.to_seq, x.n, x.seconds))
    assert got == {k: s for k, v in rows.items() if (s := segments(v))} and len({s[1] for v in got.values() for s in v}) == 3


def test_track_reports(spark):
    r = random.Random(2)
    rows = recorded(r, 1, 200) + [(2, 0, 0.0, 0.0, 0)]
    got = {x.track_id: x for x in tracks.track_reports(spark.createDataFrame(rows, DDL)).collect()}
    assert got[1].n == 200 and got[1].quality == "suspect" and [tuple(x) for x in got[1].segments] == segments(cleaned(rows[:-1], 4.0))
    assert got[2].segments == [] and got[2].median_speed == 0 and not got[2].aircraft
