import random

import pytest
from pyspark.sql import functions as F

from voxelloom.functions import folds
from voxelloom.operators import consensus, geometry, maps, rays as ry
from voxelloom.params import EMPTY, MapParams
from voxelloom.sources import wire
from voxelloom.streaming import gates, incremental

P = MapParams(resolution=0.05)


def make(spark, rows):
    """rows: (seq, frame, origin, end, cls, quality, dynamic, kind)"""
    flat = [(s, f, *map(float, o), *map(float, e), c, float(q), d, k) for s, f, o, e, c, q, d, k in rows]
    return spark.createDataFrame(flat, "seq long, frame_id int, ox double, oy double, oz double, ex double, ey double, ez double, cls int, quality double, is_dynamic boolean, kind string")


def line(a, b):
    """The cells of a line with an accumulated error, the last one left out."""
    d = [y - x for x, y in zip(a, b)]
    m = max(map(abs, d))
    err, at, out = [m] * 3, list(a), []
    for _ in range(m):
        out.append(tuple(at))
        for k in range(3):
            err[k] += 2 * abs(d[k])
            if err[k] >= 2 * m:
                err[k] -= 2 * m
                at[k] += 1 if d[k] >= 0 else -1
    return out


def test_walk_equals_loop(spark):
    rng = random.Random(1)
    rows = [(i, *[rng.randint(-20, 20) for _ in range(6)]) for i in range(200)]
    df = spark.createDataFrame(rows, "seq int, k0x int, k0y int, k0z int, k1x int, k1y int, k1z int")
    got = {}
    for r in ry.walk_cells(df).orderBy("seq", "step").collect():
        got.setdefault(r.seq, []).append((r.ix, r.iy, r.iz))
    for i, *k in rows:
        assert got.get(i, []) == line(k[:3], k[3:])


def test_hit_ray_carves_and_hits_one_cell(spark):
    r = make(spark, [(0, 0, (0, 0, 0), (1, 0, 0), 4, 1, False, "hit")])
    occ = ry.occupancy(r, P)
    assert occ.count() > 2 and occ.where("a_occ > 1").count() == 1


def test_batched_carve_counts_once_a_frame(spark):
    r = make(spark, [(i, 0, (0, 0, 0), (1, 0, 0), 4, 1, False, "hit") for i in range(5)])
    assert ry.occupancy(r, P).where("ix = 10 AND iy = 0").first().a_free == 1.5


def test_hits_win_over_carving(spark):
    r = make(spark, [(0, 0, (0, 0, 0), (0.5, 0, 0), 1, 1, False, "hit"), (1, 0, (0, 0, 0), (1, 0, 0), 1, 1, False, "hit")])
    assert ry.occupancy(r, P).where("ix = 10 AND iy = 0").first().a_free == 1


def test_miss_carves_its_end(spark):
    r = make(spark, [(0, 0, (0, 0, 0), (1, 0, 0), None, 1, False, "miss")])
    o = ry.occupancy(r, P)
    assert o.where("ix = 20").count() == 1 and o.where("a_occ > 1").count() == 0


def slots(spark, events):
    df = spark.createDataFrame([(i, c, float(x)) for i, (c, x) in enumerate(events)], "seq int, cls int, inc double")
    return df.agg(folds.fold_slots(F.collect_list(F.struct("seq", "cls", "inc")), 0.12).alias("d")).first().d


def test_eviction_keeps_the_frequent_and_the_mass(spark):
    events = [(EMPTY, 1)] + [(1, 1)] * 5 + [(2, 1)] * 3 + [(7, 1)]
    d = slots(spark, events)
    assert {d.cls0, d.cls1} == {1, 2} and d.other > 0.12
    assert d.other + d.cnt0 + d.cnt1 == pytest.approx(0.12 + 0.02 + len(events))


def test_fold_equals_loop(spark):
    rng = random.Random(3)
    events = [(rng.choice([1, 2, 3, 4, 5, EMPTY]), rng.random()) for _ in range(300)]
    other, cls, cnt = 0.12, [EMPTY, EMPTY], [0.01, 0.01]
    for c, inc in events:
        if c == EMPTY:
            other += inc
        elif c in cls:
            cnt[cls.index(c)] += inc
        elif EMPTY in cls:
            k = cls.index(EMPTY)
            cls[k], cnt[k] = c, 0.01 + inc
        else:
            k = cnt.index(min(cnt))
            held = max(0, cnt[k] - 0.01)
            if inc > held:
                other, cls[k], cnt[k] = other + held, c, 0.01 + inc
            else:
                other += inc
    d = slots(spark, events)
    assert (d.cls0, d.cls1) == tuple(cls) and (d.other, d.cnt0, d.cnt1) == pytest.approx((other, *cnt))


def test_saturation_caps_sums(spark):
    df = spark.range(100).select(F.lit(0).alias("frame_id"), F.lit(1).alias("phase"), F.col("id").alias("seq"), F.lit(3).alias("cls"), F.lit(1.0).alias("q"), F.lit(0.0).alias("w"))
    s = df.agg(folds.fold_cell(F.collect_list(F.struct("frame_id", "phase", "seq", "cls", "q", "w")), 1.0, 1.0, 5.0, 0.5, 0.12).alias("s")).first().s
    assert s.a_occ + s.a_free <= 5.001 and s.d.other + s.d.cnt0 + s.d.cnt1 <= 5.02


def beta_rows(spark, rows, source=False):
    return spark.createDataFrame(rows, "source int, ix int, iy int, iz int, a_occ double, a_free double" if source else "ix int, iy int, iz int, a_occ double, a_free double")


def test_merge_beta(spark):
    a, b = beta_rows(spark, [(0, 0, 0, 3.0, 1.0)]), beta_rows(spark, [(0, 0, 0, 1.0, 4.0)])
    r = consensus.merge_beta(a, b).first()
    assert (r.a_occ, r.a_free) == (3.0, 4.0)


def dir_rows(spark, *rows):
    return spark.createDataFrame([(s, 0, 0, 0, *r) for s, r in enumerate(rows)], "source int, ix int, iy int, iz int, other double, cls0 int, cnt0 double, cls1 int, cnt1 double")


def test_merge_dir(spark):
    d = dir_rows(spark, (0.12, 5, 1.01, EMPTY, 0.01), (0.12, 5, 2.01, EMPTY, 0.01))
    r = consensus.refold_dir(d, 0.12).first()
    assert r.cls0 == 5 and r.cnt0 == pytest.approx(3.01)
    r = consensus.refold_dir(dir_rows(spark, (0.12, 1, 5.01, 2, 4.01), (0.12, 3, 3.01, 4, 2.01)), 0.12).first()
    assert (r.cls0, r.cls1) == (1, 2) and r.other == pytest.approx(0.12 + 5)


def test_frames_that_cannot_merge():
    f = {"resolution": 0.1, "num_classes": 14, "alpha": 0.01}
    consensus.check_frames(f, f)
    for bad in ({"num_classes": 13}, {"alpha": 0.02}, {"resolution": 0.2}, {"alpha": float("nan")}):
        with pytest.raises(ValueError):
            consensus.check_frames(f, f | bad)


def test_one_corner_gives_one_triangle(spark):
    cells = [(x, y, z, -0.5 if (x, y, z) == (0, 0, 0) else 0.5, 1.0) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    t = spark.createDataFrame(cells, "ix int, iy int, iz int, tsdf_d double, tsdf_w double")
    m = geometry.mesh(t, 0.5, 1.0).collect()
    assert len(m) == 1 and all(0.5 <= m[0][c] <= 1.5 for c in m[0].asDict() if c[-1] in "012")
    assert geometry.mesh(t, 2.0, 1.0).count() == 0


def test_triangles_close_every_case():
    for case in range(256):
        edges = {}
        for t in geometry.triangles(case):
            for a, b in zip(t, t[1:] + t[:1]):
                edges[a, b] = edges.get((a, b), 0) + 1
        assert all(n == 1 for n in edges.values())
        crossed = {k for k, (a, b) in enumerate(geometry.EDGES) if (case >> a & 1) != (case >> b & 1)}
        assert {x for t in geometry.triangles(case) for x in t} == crossed


def test_wire_sizes_and_errors():
    pair = {"ix": 1, "iy": 2, "iz": 3, "a": 1.0, "b": 2.0}
    d = {"ix": 1, "iy": 2, "iz": 3, "other": 0.5, "cls": [1, 2], "cnt": [1.0, 2.0]}
    full = wire.encode_frame(0.1, 14, 0.01, [pair] * 2, [pair] * 2, [d] * 2)
    assert len(full) == 164 and len(wire.encode_frame(0.1, 14, 0.01, [pair] * 2, [pair] * 2, [d] * 2, share_tsdf=False)) == 124
    assert wire.decode_frame(full)["beta"] == [pair] * 2 and wire.decompress(wire.compress(full)) == full
    for bad in (full[:10], b"\0" + full[1:], full[:4] + b"\4" + full[5:], full[:-1], full[:16] + b"\xff\xff\xff\x7f" + full[20:]):
        with pytest.raises(ValueError):
            wire.decode_frame(bad)


def test_topk_files(spark):
    raw = bytes([2, 0, 0, 0, 4]) + bytes([0, 255, 0, 0, 0, 0, 128, 0])
    df = spark.createDataFrame([(0, bytearray(raw)), (1, bytearray(raw[:9]))], "frame_id int, content binary")
    rows = wire.decode_topk(df, False, 10).orderBy("row").collect()
    assert [r.frame_id for r in rows] == [0, 0] and rows[0].probs[1] == 1 and rows[1].probs[2] == pytest.approx(128 / 255)


def test_grid_is_dense(spark):
    g = maps.occupancy_grid(beta_rows(spark, [(0, 0, 0, 9.0, 1.0), (2, 1, 0, 1.0, 9.0)]), 0, 1, MapParams(resolution=1.0))
    assert {(r.gx, r.gy): r.value for r in g.collect()} == {(0, 0): 90, (1, 0): -1, (2, 0): -1, (0, 1): -1, (1, 1): -1, (2, 1): 0}
    empty = maps.occupancy_grid(beta_rows(spark, []), 0, 1, MapParams(resolution=1.0))
    assert empty.count() == 0


def test_pose_gate(spark):
    rows = [(0, float(t), 0.0 if t < 6 else 5.0, 0.0, 0.0) for t in range(10)]
    g = gates.pose_gate(spark.createDataFrame(rows, "u int, t double, tx double, ty double, tz double"), ["u"])
    assert [r.stable for r in g.orderBy("t").collect()] == [False, False, True, True, True, True, False, False, True, True]


def test_change_gate(spark):
    rows = [(0, 0, 0, 0, 2.0, 1.0), (0, 0, 0, 1, 2.0, 1.01), (0, 0, 0, 2, 4.0, 1.0)]
    g = gates.change_gate(spark.createDataFrame(rows, "ix int, iy int, iz int, frame_id int, a_occ double, a_free double"), ["ix", "iy", "iz"], "frame_id")
    assert [r.emit for r in g.orderBy("frame_id").collect()] == [True, False, True]


def test_fused_view_is_idempotent(spark, tmp_path):
    view = incremental.FusedView(spark, str(tmp_path))
    schema = "source int, msg_seq long, pos int, ix int, iy int, iz int, a_occ double, a_free double"
    first = spark.createDataFrame([(0, 1, 0, 0, 0, 0, 3.0, 1.0), (1, 1, 0, 0, 0, 0, 1.0, 4.0)], schema)
    view(first, 0)
    view(first, 1)
    r = view.fused.read().collect()
    assert [(x.a_occ, x.a_free) for x in r] == [(3.0, 4.0)]
    view(spark.createDataFrame([(1, 2, 0, 0, 0, 0, 2.0, 2.0)], schema), 2)
    assert [(x.a_occ, x.a_free) for x in view.fused.read().collect()] == [(4.0, 2.0)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f, i % 3, 0, 0, 0.5, 0.25) for f in range(4) for i in range(5)]
    schema = "frame int, ix int, iy int, iz int, quality double, free double"
    for f in range(4):
        spark.createDataFrame([r for r in rows if r[0] == f], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = incremental.OccupancyStream(spark, str(tmp_path / "state"), MapParams())
    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(state).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.ix: (r.a_occ, r.a_free) for r in state.beta.read().collect()}
    n = {k: sum(1 for r in rows if r[1] == k) for k in range(3)}
    assert got == {k: (1 + 0.5 * v, 1 + 0.25 * v) for k, v in n.items()}


def test_published_deltas_equal_the_gate(spark, tmp_path):
    rng = random.Random(6)
    state, rows, out = {}, [], incremental.DeltaPublisher(spark, str(tmp_path), P)
    schema = "ix int, iy int, iz int, a_occ double, a_free double"
    sent = {}
    for f in range(6):
        touched = rng.sample(range(5), 3)
        for k in touched:
            o, fr = state.get(k, (1.0, 1.0))
            state[k] = (o + rng.random() * 0.3, fr + 0.05)
            rows.append((k, 0, 0, f, *state[k]))
        batch = spark.createDataFrame([(k, 0, 0, *state[k]) for k in touched], schema)
        out(batch, f)
        out(batch, f)  # delivered again
        sent[f] = {r.ix for r in out.deltas.read().collect()}
    g = gates.change_gate(spark.createDataFrame(rows, "ix int, iy int, iz int, frame_id int, a_occ double, a_free double"), ["ix", "iy", "iz"], "frame_id").where("emit").collect()
    assert {(f, k) for f, ks in sent.items() for k in ks} == {(r.frame_id, r.ix) for r in g}
    out(batch, 6, consumer=False)
    assert out.deltas.read().count() == len(sent[5])
    out(batch, 7, snapshot=True)
    assert out.deltas.read().count() == 3


def test_moving_things_fade(spark, tmp_path):
    t = incremental.TransientStream(spark, str(tmp_path), MapParams(decay=0.8))
    schema = "ix int, iy int, iz int, quality double"
    for f, q in enumerate((2.0, None, None, 1.0, 0.5, None)):
        t(spark.createDataFrame([(0, 0, 0, q)] if q else [], schema), f)
    assert t.beta.read().first().a_occ == pytest.approx(2.695360, abs=1e-6)
    fast = incremental.TransientStream(spark, str(tmp_path / "fast"), MapParams(decay=0.001))
    fast(spark.createDataFrame([(0, 0, 0, 0.5)], schema), 0)
    fast(spark.createDataFrame([], schema), 1)
    assert fast.beta.read().count() == 0
