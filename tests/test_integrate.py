"""Integration against loops: probability vectors, gates, modes, carving, saturation."""

import random

import pytest
from pyspark.sql import functions as F

from voxelloom.operators import integrate as ig
from voxelloom.params import EMPTY, MapParams

SCHEMA = "frame_id int, seq long, ox double, oy double, oz double, ex double, ey double, ez double, kind string, quality double, is_dynamic boolean, probs array<double>"


def made_rays(n=160, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        probs = rng.choice([None, [], [0.0] * 5, [rng.choice([0, 0, 0.1, 0.4, 0.7, -0.2]) for _ in range(5)], [rng.random() for _ in range(5)]])
        end = [rng.choice([0.5, 1.5, 2.5]), rng.choice([0.5, 1.5]), 0.5]
        out.append((i // 16, i, 0.5, 0.5, 0.5, *end, "miss" if rng.random() < 0.15 else "hit", rng.choice([0.0, 0.3, 0.8, 1.0]), rng.random() < 0.1, None if probs is None else [float(p) for p in probs]))
    return out


def cells_of(r, res):
    k0, k1 = [[int(v // res) for v in r[a : a + 3]] for a in (2, 5)]
    m = max(abs(b - a) for a, b in zip(k0, k1))
    return [tuple(a + (1 if b >= a else -1) * ((2 * i * abs(b - a) + m) // (2 * m) if m else 0) for a, b in zip(k0, k1)) for i in range(m + 1)]


class Cell:
    def __init__(self, p):
        self.p, self.occ, self.free, self.other, self.slots, self.seen = p, 1.0, 1.0, p.prior_other, [[EMPTY, p.alpha], [EMPTY, p.alpha]], False

    def add(self, cls, inc):
        s = self.slots
        if cls == EMPTY:
            self.other += inc
            return
        for x in s:
            if x[0] == cls:
                x[1] += inc
                return
        for x in s:
            if x[0] == EMPTY:
                x[:] = [cls, self.p.alpha + inc]
                return
        weak = min(s, key=lambda x: x[1])
        if inc > max(0.0, weak[1] - self.p.alpha):
            self.other += max(0.0, weak[1] - self.p.alpha)
            weak[:] = [cls, self.p.alpha + inc]
        else:
            self.other += inc

    def cap(self):
        c = self.p.saturation
        if c > 0 and self.occ + self.free > c:
            k = c / (self.occ + self.free)
            self.occ, self.free = self.occ * k, self.free * k

    def cap_classes(self):
        c, mass = self.p.saturation, self.other + sum(n for _, n in self.slots)
        if c > 0 and mass > c:
            self.other *= c / mass
            for x in self.slots:
                x[1] = max(x[1] * c / mass, self.p.alpha) if x[0] != EMPTY else x[1] * c / mass

    def hit(self, q, probs):
        self.occ += self.p.w_occ * q
        self.cap()
        pr = self.occ / (self.occ + self.free)
        if self.p.mode == "dirichlet":
            share = self.p.kappa * pr * q
            if pr < self.p.min_p_occ or share <= 0:
                return
            total = sum(x for x in probs or [] if x > 0)
            norm = 1 / total if total > 1 else 1.0
            for k, x in enumerate(probs or []):
                if x > 0:
                    self.add(k, share * x * norm)
            self.add(EMPTY, share * (1 - total * norm))
        else:
            if pr <= 0.5 or not probs or max(probs) <= 0:
                return
            label = probs.index(max(probs))
            if self.p.mode == "majority":
                self.add(label, 1.0)
            else:
                for x in self.slots:
                    if x[0] != EMPTY:
                        self.other += x[1] - self.p.alpha
                self.slots = [[label, self.p.alpha + 1], [EMPTY, self.p.alpha]]
        self.seen = True
        self.cap_classes()


def by_loop(rows, p):
    cells = {}
    for frame in sorted({r[0] for r in rows}):
        staged, hits = {}, set()
        for r in (r for r in rows if r[0] == frame):
            path = cells_of(r, p.resolution)
            w = p.w_free * r[9]
            if r[8] == "hit" and not r[10]:
                hits.add(path[-1])
                cells.setdefault(path[-1], Cell(p)).hit(r[9], r[11])
            for c in path[:-1] if r[8] == "hit" else path:
                if w > 0:
                    staged[c] = max(staged.get(c, 0), w)
        for c, w in staged.items():
            if c not in hits:
                x = cells.setdefault(c, Cell(p))
                x.free += w
                x.cap()
    return cells


@pytest.mark.parametrize("mode, cap", [("dirichlet", 0.0), ("majority", 0.0), ("naive", 0.0), ("dirichlet", 6.0)])
def test_integrate(spark, mode, cap):
    p = MapParams(resolution=1.0, num_classes=5, mode=mode, saturation=cap, min_p_occ=0.47)
    rows = made_rays()
    beta, classes = ig.integrate(spark.createDataFrame(rows, SCHEMA), p)
    want = by_loop(rows, p)
    got = {(r.ix, r.iy, r.iz): r for r in beta.collect()}
    assert set(got) == set(want)
    for k, c in want.items():
        assert (got[k].a_occ, got[k].a_free) == pytest.approx((c.occ, c.free))
    labels = {(r.ix, r.iy, r.iz): r for r in classes.collect()}
    assert set(labels) == {k for k, c in want.items() if c.seen}
    for k, r in labels.items():
        assert (r.other, r.cls0, r.cnt0, r.cls1, r.cnt1) == pytest.approx((want[k].other, *want[k].slots[0], *want[k].slots[1]))


def test_fused_walk_leaves_no_surface_where_it_is_off(spark):
    rows = [(0, 0, 0.05, 0.05, 0.05, 2.05, 0.05, 0.05, "hit", 1.0, False, None), (0, 1, 0.05, 0.05, 0.05, 0.05, 2.05, 0.05, "hit", 1.0, True, None), (0, 2, 0.05, 0.05, 0.05, 0.05, 0.05, 2.05, "hit", 1.0, False, None)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("geometry_off", F.col("seq") == 2)
    beta, _, tsdf = ig.integrate_fused(d, MapParams(carving=True))
    assert {tuple(r) for r in tsdf.select(F.col("iy") < 4, F.col("iz") < 4).distinct().collect()} == {(True, True)}
    hits = {(r.ix, r.iy, r.iz) for r in beta.where("a_occ > 1").collect()}
    assert hits == {(20, 0, 0), (0, 0, 20)} and beta.where("a_free > 1").count() > 30


def test_distribution(spark):
    d = spark.createDataFrame([(1, [0.5, 0.0, 0.25]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [-1.0, 0.0])], "k int, probs array<double>")
    got = {r.k: [(x.cls, x.share) for x in r.d] for r in d.select("k", ig.distribution(F.col("probs")).alias("d")).collect()}
    assert got == {1: [(0, 0.5), (2, 0.25), (EMPTY, 0.25)], 2: [(0, 0.5), (1, 0.5), (EMPTY, 0.0)], 3: [(EMPTY, 1.0)], 4: [(EMPTY, 1.0)], 5: [(EMPTY, 1.0)]}
