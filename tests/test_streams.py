"""Policies of streams, on files that arrive."""

import datetime as dt

from pyspark.sql import functions as F

from voxelloom.streaming import gates
from voxelloom.operators import consensus
from voxelloom.params import MapParams
from voxelloom.sources import wire
from voxelloom.streaming.incremental import DeltaPublisher, Latched, Table, bounded, coalesced_sink, joined_in_time, published


def test_latched(spark, tmp_path):
    one, two = (spark.createDataFrame([(x,)], "a int") for x in (1, 2))
    t = Latched(spark, str(tmp_path), "a int")
    assert t.read().count() == 0 and not t.publish(one, 0)
    t.changed()
    assert not t.publish(one, 1, listeners=0) and t.publish(one, 2) and not t.publish(two, 3)
    t.changed()
    assert t.publish(two, 4) and [r.a for r in t.read().collect()] == [2]


def test_old_versions_go(spark, tmp_path):
    t = Table(spark, str(tmp_path), "a int")
    for v in range(8):
        t.write(spark.createDataFrame([(v,)], "a int"), v)
    assert t._versions() == [4, 5, 6, 7] and [r.a for r in t.read(below=7).collect()] == [6]


def test_few_files_a_batch(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i,)], "a int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    q = coalesced_sink(bounded(spark, str(tmp_path / "in"), "a int"), lambda b, n: seen.append((n, sorted(r.a for r in b.collect()))), 0, str(tmp_path / "c"))
    q.awaitTermination(60)
    assert len(seen) == 3 and sorted(x for _, a in seen for x in a) == [0, 1, 2]


def test_late_poses_are_dropped(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    scans, poses = str(tmp_path / "scans"), str(tmp_path / "poses")
    put = lambda path, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    put(scans, [(at(0), 0), (at(1), 1), (at(2), 2)], "ts timestamp, scan int")
    put(poses, [(at(0), 10), (at(2), 12)], "ts timestamp, pose int")
    joined = joined_in_time(bounded(spark, scans, "ts timestamp, scan int"), bounded(spark, poses, "ts timestamp, pose int"), "5 seconds")
    out, conf = [], dict(spark.sparkContext.getConf().getAll())
    run = lambda: joined.writeStream.foreachBatch(lambda b, n: out.extend((r.scan, r.pose) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    put(scans, [(at(60), 60)], "ts timestamp, scan int")
    put(poses, [(at(60), 70)], "ts timestamp, pose int")
    run()
    put(scans, [(at(0), 99)], "ts timestamp, scan int")  # a minute late
    put(poses, [(at(1), 11), (at(0), 13)], "ts timestamp, pose int")
    run()
    assert conf and sorted(out, key=str) == sorted([(0, 10), (1, None), (2, 12), (60, 70)], key=str)


def test_rates_and_queues(spark):
    ticks = spark.createDataFrame([("a", float(t)) for t in (0, 1, 2, 3, 3.5, 7)] + [("b", 5.0)], "g string, t double")
    assert sorted((r.g, r.t) for r in gates.rate_limited(ticks, ["g"], 2.0).collect()) == [("a", 0.0), ("a", 2.0), ("a", 7.0), ("b", 5.0)]
    assert sorted((r.g, r.t) for r in gates.keep_last(ticks, ["g"], ["t"], 2).collect()) == [("a", 3.5), ("a", 7.0), ("b", 5.0)]


def test_placed(spark):
    frames = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 20.0)], "f int, t double")
    poses = spark.createDataFrame([(0.0, 1.0, 100), (10.0, 50.0, 110)], "t double, arrival double, pose int")
    got = {r.f: (r.pose, r.stale) for r in gates.placed(frames, poses, 5.0, False, 7.0).collect()}
    assert got == {1: (100, False), 2: (100, True), 3: (100, True)}
    assert [r.f for r in gates.placed(frames, poses, 5.0, True, 7.0).collect()] == [1]
    assert frames.where(F.col("f") > 9).count() == 0


def test_deltas_reach_the_wire(spark, tmp_path):
    p = DeltaPublisher(spark, str(tmp_path), MapParams())
    p(spark.createDataFrame([(1, 2, 3, 2.0, 1.0), (4, 5, 6, 1.0, 1.0)], "ix int, iy int, iz int, a_occ double, a_free double"), 0)
    got = wire.decode_frames(published(p, "robot", 0)).collect()
    assert [(r.source, r.msg_seq, r.error, [tuple(c) for c in r.beta], r.dir) for r in got] == [("robot", 0, None, [(1, 2, 3, 2.0, 1.0)], [])]
    p(spark.createDataFrame([(1, 2, 3, 2.01, 1.0)], "ix int, iy int, iz int, a_occ double, a_free double"), 1)
    assert published(p, "robot", 1).count() == 0


def test_frames_are_checked_before_they_merge(spark):
    b = spark.createDataFrame([(0, 0, 0, 2.0, 1.0)], "ix int, iy int, iz int, a_occ double, a_free double")
    a = {"resolution": 0.1, "num_classes": 14, "alpha": 0.01, "beta": b}
    assert consensus.merge_frames(a, a | {"resolution": 0.0}, 0.12)["beta"].first().a_occ == 3.0
    for wrong in ({"num_classes": 13}, {"alpha": 0.02}, {"resolution": 0.2}, {"alpha": float("inf")}):
        try:
            consensus.merge_frames(a, a | wrong, 0.12)
        except ValueError:
            continue
        raise AssertionError(wrong)
