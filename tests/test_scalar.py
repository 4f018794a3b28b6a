import math

import pytest
from pyspark.sql import functions as F

from voxelloom.functions import scalar as sc


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_occupancy_after_hits(spark):
    r = one(spark, sc.p_occ(F.lit(2.0), F.lit(1.0)), sc.p_occ(F.lit(6.0), F.lit(1.0)), sc.p_occ(F.lit(0.0), F.lit(0.0)))
    assert r[0] == pytest.approx(0.667, abs=1e-3) and r[1] == pytest.approx(0.857, abs=1e-3) and r[2] == 0.5


def test_uncertainty(spark):
    b = lambda *x: [F.lit(float(v)) for v in x]
    r = one(spark, sc.beta_variance(*b(1, 1)), sc.beta_entropy(*b(1, 1)), *[sc.information_gain(*b(*x)) for x in ((1, 1), (3, 1), (8, 2))], sc.beta_kl(*b(3, 1, 3, 1)))
    assert r[0] == pytest.approx(1 / 12) and r[1] == pytest.approx(0, abs=1e-7)
    assert [round(x, 6) for x in r[2:5]] == [0.193147, 0.104002, 0.045720] and r[5] == pytest.approx(0, abs=1e-9)


def test_digamma_and_lgamma(spark):
    euler = 0.5772156649015329
    r = one(spark, sc.digamma(F.lit(1.0)), sc.digamma(F.lit(2.0)), sc.digamma(F.lit(0.0)), *[sc.lgamma(F.lit(x)) for x in (0.01, 0.5, 3.3, 150.0)])
    assert r[0] == pytest.approx(-euler, abs=1e-7) and r[1] == pytest.approx(1 - euler, abs=1e-7) and r[2] == -math.inf
    for got, x in zip(r[3:], (0.01, 0.5, 3.3, 150.0)):
        assert got == pytest.approx(math.lgamma(x), abs=1e-9)


def test_escape_mass_and_confidence(spark):
    r = one(spark, *[sc.escape_mass(F.lit(float(m)), F.lit(float(n))) for m, n in ((1, 10), (2, 3), (1, 0.05))], sc.confidence(F.lit(0.0), F.array(F.lit(10.0))), sc.confidence(F.lit(0.0), F.array(F.lit(0.0))))
    assert [round(x, 6) for x in r[:3]] == [0.208516, 1.442695, 0.05] and r[3] == pytest.approx(0.901010, abs=1e-6) and r[4] == 0


def test_signed_distance(spark):
    o, e = [F.lit(0.0)] * 3, [F.lit(0.10), F.lit(0.0), F.lit(0.0)]
    v = [F.lit(0.075), F.lit(0.025), F.lit(0.025)]
    assert one(spark, sc.euclidean_sdf(o, e, v))[0] == pytest.approx(0.0433, abs=1e-4)
    e2 = [F.lit(0.075), F.lit(0.0), F.lit(0.0)]
    assert abs(one(spark, sc.euclidean_sdf(o, e2, [F.lit(0.0750001), F.lit(0.025), F.lit(0.025)]))[0]) == pytest.approx(0.0354, abs=1e-4)


def test_dominant(spark):
    d = lambda other, c0, n0, c1, n1: sc.dominant(F.lit(other), [F.lit(c0), F.lit(c1)], [F.lit(n0), F.lit(n1)], 0.12)
    r = one(spark, d(0.12, 5, 1.0, 3, 1.0), d(9.0, 5, 1.0, 3, 1.0), d(0.12, 65535, 0.01, 65535, 0.01), d(0.12, 5, 1.0, 3, 1.5))
    assert list(r) == [5, 65535, 65535, 3]


def test_names(spark):
    r = one(spark, *[sc.collapse_name(F.lit(x)) for x in ("Street_Light", "streetlight", "palm tree", "skyscraper", "guard_rail", "Ground Animal", "nothing")])
    assert list(r) == [6, 6, 5, 4, 12, 0, 0]


def test_labels_and_depth(spark):
    r = one(spark, sc.label_or_none(F.lit(0), 10), sc.label_or_none(F.lit(9), 10), sc.label_or_none(F.lit(10), 10), sc.depth_metres(F.lit(1500), "16UC1"), sc.depth_metres(F.lit(float("nan")), "32FC1"))
    assert list(r) == [None, 9, None, 1.5, 0.0]
