"""Folds and geometry without SQL, against loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voxelloom.functions import folds
from voxelloom.operators import consensus, ingest
from voxelloom.params import EMPTY


def add(state, c, inc, alpha=0.01):
    other, cls, cnt = state
    if c == EMPTY:
        other += inc
    elif c in cls:
        cnt[cls.index(c)] += inc
    elif EMPTY in cls:
        k = cls.index(EMPTY)
        cls[k], cnt[k] = c, alpha + inc
    else:
        k = cnt.index(min(cnt))
        held = max(0, cnt[k] - alpha)
        if inc > held:
            other, cls[k], cnt[k] = other + held, c, alpha + inc
        else:
            other += inc
    return other, cls, cnt


def test_saturated_fold(spark):
    rng = random.Random(8)
    events = [(f, 1, i, rng.choice([1, 2, 3, 4, EMPTY]), rng.random(), 0.0) for f in range(20) for i in range(rng.randint(0, 4))] + [(f, 2, 0, EMPTY, 0.0, rng.random()) for f in range(20)]
    cap, occ, free, d = 4.0, 1.0, 1.0, (0.12, [EMPTY, EMPTY], [0.01, 0.01])
    for _, phase, _, c, q, w in sorted(events):
        occ, free = occ + (q if phase == 1 else 0), free + (0 if phase == 1 else w)
        k = cap / (occ + free) if occ + free > cap else 1.0
        occ, free = occ * k, free * k
        p = occ / (occ + free)
        if phase == 1 and p >= 0.5 and p * q > 0:
            d = add(d, c, p * q)
        other, cls, cnt = d
        mass = other + sum(cnt)
        k = cap / mass if mass > cap else 1.0
        d = other * k, cls, [max(x * k, 0.01) if c != EMPTY else x * k for x, c in zip(cnt, cls)]
    rng.shuffle(events)
    df = spark.createDataFrame(events, "frame_id int, phase int, seq int, cls int, q double, w double")
    s = df.agg(folds.fold_cell(F.collect_list(F.struct(*df.columns)), 1.0, 1.0, cap, 0.5, 0.12).alias("s")).first().s
    assert (s.a_occ, s.a_free, s.d.other, s.d.cnt0, s.d.cnt1) == pytest.approx((occ, free, d[0], *d[2])) and [s.d.cls0, s.d.cls1] == d[1]


def test_refold_of_classes(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for cell in range(60):
        merged = None
        for source in range(4):
            c0, c1 = rng.sample(range(1, 6), 2)
            x = (round(0.12 + rng.random(), 3), [c0, c1], [round(0.01 + rng.random() * 5, 3), round(0.01 + rng.random() * 5, 3)])
            rows.append((source, cell, 0, 0, x[0], c0, x[2][0], c1, x[2][1]))
            if merged is None:
                merged = x
                continue
            other, slots = max(0.12, merged[0] + x[0] - 0.12), dict(zip(merged[1], merged[2]))
            for c, n in zip(x[1], x[2]):
                slots[c] = slots[c] + n - 0.01 if c in slots else n
            ranked = sorted(slots.items(), key=lambda s: (-s[1], s[0]))
            merged = other + sum(max(0, n - 0.01) for _, n in ranked[2:]), [c for c, _ in ranked[:2]], [n for _, n in ranked[:2]]
        want[cell] = merged
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source int, ix int, iy int, iz int, other double, cls0 int, cnt0 double, cls1 int, cnt1 double")
    for r in consensus.refold_dir(df, 0.12).collect():
        other, cls, cnt = want[r.ix]
        assert [r.cls0, r.cls1] == cls and (r.other, r.cnt0, r.cnt1) == pytest.approx((other, *cnt))


def test_deskew_turns_with_the_gyro(spark):
    rate = 0.5
    imu = spark.createDataFrame([(k / 100, 0.0, 0.0, rate) for k in range(300)], "t double, wx double, wy double, wz double")
    scans = spark.createDataFrame([(0, 1.0), (1, 100.0)], "scan int, t0 double")
    knots = ingest.rotation_knots(ingest.gyro_window(scans, imu, 0.1), 0.1)
    pts = spark.createDataFrame([(s, k / 50, 1.0, 0.0, 2.0) for s in (0, 1) for k in range(6)], "scan int, dt double, x double, y double, z double")
    for r in ingest.deskew(pts, knots).collect():
        a = rate * r.dt if r.scan == 0 else 0.0
        assert (r.x, r.y, r.z) == pytest.approx((math.cos(a), math.sin(a), 2.0), abs=1e-9)


def windows_of_scans():
    """Scans and samples with shared times, gaps, values at the windows' ends and before zero."""
    rng = random.Random(3)
    times = [-3.0, -2.5, *sorted(rng.choice(range(0, 400)) / 16 for _ in range(120)), 60.0, 60.0, 75.0]
    imu = [(t, rng.randint(-900, 900) / 1000, 0.25, rng.randint(0, 9) / 8) for t in times]
    scans = [(i, t) for i, t in enumerate([-4.0, -2.5, *(k / 16 for k in range(0, 480, 3)), 58.0, 59.0, 60.0, 60.5, 61.0, 62.5, 73.5, 74.0, 500.0])]
    return imu, scans


def window_of(imu, t0, window):
    got = sorted(s for s in imu if t0 - window <= s[0] <= t0 + window)
    first = max((s[0] for s in got if s[0] <= t0), default=t0)
    return [s for s in got if s[0] >= first]


def test_gyro_totals(spark):
    imu, scans = windows_of_scans()
    odd = [(30.0, math.inf, None, 1.0), (31.5, -math.inf, 2.0, math.nan), (None, 1.0, 1.0, 1.0)]
    s, i = spark.createDataFrame([*scans, (999, None)], "scan int, t0 double"), spark.createDataFrame(imu + odd, "t double, wx double, wy double, wz double")
    got = {r.scan: r for r in ingest.gyro_totals(s, i, 1.5, ["wx", "wy", "wz"]).collect()}
    assert len(got) == len(scans) + 1 and got[999].n == 0
    for scan, t0 in scans:
        rows, r = window_of([x for x in imu + odd if x[0] is not None], t0, 1.5), got[scan]
        assert r.n == len(rows)
        for k, v in ((1, r.wx), (2, r.wy), (3, r.wz)):
            has = [x[k] for x in rows if x[k] is not None]
            assert v == pytest.approx(sum(has), abs=1e-9, nan_ok=True) if has else v is None


def test_windows_of_many_samples_are_not_listed(spark):
    """4,000 scans of 4,000 samples each: rows in the plan stay as many as come in."""
    imu = spark.range(4000).select((F.col("id") / 4000).alias("t"), F.lit(0.5).alias("wx"), F.lit(0.0).alias("wy"), F.lit(0.0).alias("wz"))
    scans = spark.range(4000).select(F.col("id").alias("scan"), (F.col("id") / -4000).alias("t0"))
    g = ingest.gyro_totals(scans, imu, 10.0, ["wx"])
    assert "Join" not in g._jdf.queryExecution().optimizedPlan().toString()
    assert g.agg(F.sum("n"), F.sum("wx")).first()[:] == (4000 * 4000, 2000.0 * 4000)


def test_points_turn_as_by_listed_windows(spark):
    imu, scans = windows_of_scans()
    imu += [(200 + k / 300, 0.3 * math.sin(k), -0.2, k % 7 / 5) for k in range(1500)] + [(None, 1.0, 1.0, 1.0)]
    scans += [(900 + k, 200 + k * 0.37) for k in range(14)]
    s, i = spark.createDataFrame([*scans, (999, None)], "scan int, t0 double"), spark.createDataFrame(imu, "t double, wx double, wy double, wz double")
    dts = [-0.5, 0.0, 0.01, 0.3, 0.75, 1.2, 1.5, 9.0, None]
    pts = spark.createDataFrame([(n, k, d, 1.0, 0.5, -2.0) for n in [*(x for x, _ in scans), 999, 1000] for k, d in enumerate(dts)], "scan int, k int, dt double, x double, y double, z double")
    want = {(r.scan, r.k): r for r in ingest.deskew(pts, ingest.rotation_knots(ingest.gyro_window(s, i, 1.5), 1.5)).collect()}
    got = ingest.turn_points(pts, s, i, 1.5)
    assert got.columns == pts.columns
    rows = got.collect()
    assert len(rows) == len(want) == pts.count()
    for r in rows:
        e = want[r.scan, r.k]
        assert r.dt == e.dt and (r.x, r.y, r.z) == pytest.approx((e.x, e.y, e.z), abs=1e-11), (r, e)
    assert any(abs(r.x - 1) > 0.1 for r in rows)


def test_grazing_of_a_plane(spark):
    rows = [(0, u, v, (u - 2) * 0.1, (v - 2) * 0.1, 2.0) for u in range(5) for v in range(5)]
    g = ingest.grazing(spark.createDataFrame(rows, "frame_id int, u int, v int, px double, py double, pz double"), 1, 0.3)
    by = {(r.u, r.v): r.cos_angle for r in g.collect()}
    assert by[2, 2] == pytest.approx(1.0) and by[0, 2] is None and by[3, 2] == pytest.approx(2 / math.hypot(2, 0.1))


def test_grazing_of_a_pixel_without_depth(spark):
    rows = [(0, u, v, z * u / 10, z * v / 10, z) for u in range(5) for v in range(5) for z in [0.0 if u == v == 2 else 2.0 + u]]
    g = ingest.grazing(spark.createDataFrame(rows, "frame_id int, u int, v int, px double, py double, pz double"), 1, 0.3)
    by = {(r.u, r.v): r for r in g.collect()}
    assert math.isnan(by[2, 2].cos_angle) and by[2, 2].weight == 1.0
    assert by[3, 2].cos_angle is None and by[1, 1].cos_angle > 0


def test_decay_fold(spark):
    df = spark.createDataFrame([(0, 2.0), (3, 1.0), (4, 0.5)], "frame_id int, inc double")
    x = df.agg(folds.fold_decay(F.collect_list(F.struct("frame_id", "inc")), 0.8, F.lit(5)).alias("x")).first().x
    assert x == pytest.approx(2.695360, abs=1e-6)
    assert df.agg(folds.fold_decay(F.collect_list(F.struct("frame_id", "inc")), 0.8, F.lit(60)).alias("x")).first().x is None
