"""Scalar functions of the map, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import ALPHA, EMPTY

lit = F.lit


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# Lattice


def cell(x, res: float) -> Column:
    """The lattice index of a coordinate: its floor in cells."""
    return F.floor(_c(x) / lit(res)).cast("int")


def corner(i, res: float) -> Column:
    return _c(i) * lit(res)


def centre(i, res: float) -> Column:
    return (_c(i) + lit(0.5)) * lit(res)


# Rigid motion


def rotation(w, x, y, z) -> list[list[Column]]:
    """The rotation matrix of a unit quaternion."""
    w, x, y, z = map(_c, (w, x, y, z))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def transform(p: list, t: list, q: list) -> list[Column]:
    """A point moved by a quaternion (w, x, y, z) and a translation."""
    p, t = [_c(v) for v in p], [_c(v) for v in t]
    return [r[0] * p[0] + r[1] * p[1] + r[2] * p[2] + t[i] for i, r in enumerate(rotation(*q))]


def quat_mul(a: list, b: list) -> list[Column]:
    (aw, ax, ay, az), (bw, bx, by, bz) = [_c(v) for v in a], [_c(v) for v in b]
    return [aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw]


def quat_exp(v: list) -> list[Column]:
    """The rotation by a rotation vector."""
    v = [_c(x) for x in v]
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    s = F.when(n < 1e-9, lit(0.5)).otherwise(F.sin(n / 2) / n)
    return [F.cos(n / 2), *(x * s for x in v)]


def quat_normalise(q: list) -> list[Column]:
    q = [_c(x) for x in q]
    n = F.sqrt(sum((x * x for x in q[1:]), q[0] * q[0]))
    return [x / n for x in q]


def slerp_shares(d, t) -> list[Column]:
    """The shares of two unit quaternions, whose product is d, in the one between them."""
    d, t = _c(d), _c(t)
    sign, d = F.when(d < 0, -1.0).otherwise(1.0), F.least(F.abs(d), lit(1.0))
    angle = F.acos(d)
    near = d > 1 - 1e-9
    u = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    v = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle))
    return [u, v * sign]


def slerp(a: list, b: list, t) -> list[Column]:
    """Between two unit quaternions, along the shorter arc."""
    a, b = [_c(x) for x in a], [_c(x) for x in b]
    u, v = slerp_shares(sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0]), t)
    return [u * x + v * y for x, y in zip(a, b)]


# Images and points


def depth_metres(raw, encoding: str) -> Column:
    """Metres of a raw depth: millimetres of 16UC1 or metres of 32FC1; what isn't finite is 0."""
    z = _c(raw).cast("double") * (0.001 if encoding == "16UC1" else 1.0)
    return F.when(F.isnan(z) | (F.abs(z) == lit(math.inf)) | z.isNull(), 0.0).otherwise(z)


def back_project(u, v, z, fx: float, fy: float, cx: float, cy: float) -> list[Column]:
    u, v, z = map(_c, (u, v, z))
    return [(u - cx) * z / fx, (v - cy) * z / fy, z]


def optical_to_body(p: list) -> list[Column]:
    """x forward, y left, z up, from x right, y down, z forward."""
    x, y, z = map(_c, p)
    return [z, -x, -y]


def pack_rgb(r, g, b) -> Column:
    return F.shiftleft(_c(r).cast("int"), 16).bitwiseOR(F.shiftleft(_c(g).cast("int"), 8)).bitwiseOR(_c(b).cast("int"))


def label_or_none(raw, max_classes: int) -> Column:
    """A label clamped to 16 bits; null unless between 1 and max_classes - 1."""
    c = F.least(_c(raw).cast("long"), lit(65535)).cast("int")
    return F.when((c > 0) & (c < max_classes), c)


def one_hot(label, n: int) -> Column:
    return F.transform(F.sequence(lit(0), lit(n - 1)), lambda i: (i == _c(label)).cast("double"))


def point_time(raw, kind: str, scan_start=None) -> Column:
    """Seconds after the scan's start: of nanoseconds (u32), seconds (f32), or seconds
    that may be absolute (f64)."""
    raw = _c(raw).cast("double")
    if kind == "u32":
        return raw * 1e-9
    return F.when(F.abs(raw) > 1e6, raw - _c(scan_start)).otherwise(raw) if kind == "f64" else raw


def range_weight(r, length: float) -> Column:
    return F.exp(-_c(r) / length) if length > 0 else lit(1.0)


def grazing_weight(cos_angle, threshold: float) -> Column:
    c = _c(cos_angle)
    return F.when(c < threshold, c / threshold).otherwise(1.0) if threshold > 0 else lit(1.0)


def carve_origin(o: list, e: list, band: float) -> list[Column]:
    """The origin moved to at most band before the end."""
    o, e = [_c(x) for x in o], [_c(x) for x in e]
    if band < 0:
        return o
    d = F.sqrt(sum(((b - a) * (b - a) for a, b in zip(o[1:], e[1:])), (e[0] - o[0]) * (e[0] - o[0])))
    return [F.when(d > band, b - (b - a) / d * band).otherwise(a) for a, b in zip(o, e)]


def argmax_class(probs) -> Column:
    """The first index with the highest probability."""
    return (F.array_position(_c(probs), F.array_max(_c(probs))) - 1).cast("int")


def is_dynamic(probs, classes: list[int]) -> Column:
    return argmax_class(probs).isin(classes) if classes else lit(False)


# Occupancy


def p_occ(a_occ="a_occ", a_free="a_free") -> Column:
    s = _c(a_occ) + _c(a_free)
    return F.when(s > 0, _c(a_occ) / s).otherwise(0.5)


def is_prior_beta(a_occ="a_occ", a_free="a_free", slop: float = 1e-4) -> Column:
    return (_c(a_occ) <= 1 + slop) & (_c(a_free) <= 1 + slop)


def is_prior_dir(other, cls: list, prior_other: float, slop: float = 1e-4) -> Column:
    empty = _c(cls[0]) == EMPTY
    for c in cls[1:]:
        empty = empty & (_c(c) == EMPTY)
    return empty & (_c(other) <= prior_other + slop)


def bernoulli_entropy(p) -> Column:
    p = _c(p)
    return F.when((p > 1e-7) & (p < 1 - 1e-7), -p * F.ln(p) - (1 - p) * F.ln(1 - p)).otherwise(0.0)


def beta_variance(a, b) -> Column:
    a, b = _c(a), _c(b)
    return a * b / ((a + b) * (a + b) * (a + b + 1))


def digamma(x) -> Column:
    """By recurrence to 6 or more and an asymptotic series; minus infinity up to 0."""
    x = _c(x)
    n = F.greatest(lit(0.0), F.ceil(6 - x))
    y = x + n
    low = lit(0.0)
    for k in range(6):
        low = low - F.when(n > k, 1 / (x + k)).otherwise(0.0)
    i = 1 / (y * y)
    tail = i * (lit(1 / 12) - i * (lit(1 / 120) - i * lit(1 / 252)))
    return F.when(x <= 0, lit(-math.inf)).otherwise(low + F.ln(y) - 0.5 / y - tail)


def lgamma(x) -> Column:
    """Shifted to 7 or more, then Stirling's series with four terms; for x > 0."""
    x = _c(x)
    n = F.greatest(lit(0.0), F.ceil(7 - x))
    y, low = x + n, lit(0.0)
    for k in range(7):
        low = low + F.when(n > k, F.ln(x + k)).otherwise(0.0)
    i = 1 / (y * y)
    series = (lit(1 / 12) - i * (lit(1 / 360) - i * (lit(1 / 1260) - i * lit(1 / 1680)))) / y
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - low


def lbeta(a, b) -> Column:
    return lgamma(_c(a)) + lgamma(_c(b)) - lgamma(_c(a) + _c(b))


def beta_entropy(a, b) -> Column:
    """Differential, without lower bound."""
    a, b = _c(a), _c(b)
    return lbeta(a, b) - (a - 1) * digamma(a) - (b - 1) * digamma(b) + (a + b - 2) * digamma(a + b)


def information_gain(a, b) -> Column:
    """Expected from one more observation of the cell."""
    a, b = _c(a), _c(b)
    p, s = a / (a + b), a + b
    after = digamma(s + 1) - p * digamma(a + 1) - (1 - p) * digamma(b + 1)
    return F.greatest(lit(0.0), bernoulli_entropy(p) - after)


def beta_kl(a, b, c, d) -> Column:
    """KL(Beta(a, b) || Beta(c, d)), not below 0."""
    a, b, c, d = map(_c, (a, b, c, d))
    kl = lbeta(c, d) - lbeta(a, b) + (a - c) * digamma(a) + (b - d) * digamma(b) + (c - a + d - b) * digamma(a + b)
    return F.greatest(lit(0.0), kl)


def bernoulli_kl(p, q) -> Column:
    p, q = (F.least(F.greatest(_c(v), lit(1e-7)), lit(1 - 1e-7)) for v in (p, q))
    return F.greatest(lit(0.0), p * F.ln(p / q) + (1 - p) * F.ln((1 - p) / (1 - q)))


def surprise(a, b, occupied: bool) -> Column:
    """KL of the occupancy after one more hit or miss from the one before."""
    a, b = _c(a), _c(b)
    after = (a + 1) / (a + b + 1) if occupied else a / (a + b + 1)
    return bernoulli_kl(after, a / (a + b))


# Classes


def dominant(other, cls: list, cnt: list, prior_other: float, alpha: float = ALPHA) -> Column:
    """The slot with most evidence (the first of equals), unless OTHER has more; else EMPTY."""
    best, who = lit(0.0), lit(EMPTY)
    for c, n in zip(cls, cnt):
        e = F.when(_c(c) != EMPTY, _c(n) - alpha).otherwise(-1.0)
        who, best = F.when(e > best, _c(c)).otherwise(who), F.greatest(best, e)
    return F.when(_c(other) - prior_other > best, EMPTY).otherwise(who).cast("int")


def raw_evidence(cnt, cls, alpha: float = ALPHA) -> Column:
    return F.when(_c(cls) != EMPTY, F.greatest(lit(0.0), _c(cnt) - alpha)).otherwise(0.0)


def escape_mass(m, n) -> Column:
    """Hutter's estimate of the mass of unseen classes, for m classes seen in n observations."""
    m, n = _c(m), _c(n)
    r = (n + 1) / m
    return F.when(n <= 0, 0.0).when(r <= 1, n).otherwise(F.least(m / (2 * F.ln(r)), n))


def residual(a_unk, counts) -> Column:
    """Mass outside the slots (array of raw counts): what is known of, or the escape mass."""
    k = F.size(F.filter(_c(counts), lambda x: x > 0))
    m = F.greatest(lit(1), k + (_c(a_unk) > 0).cast("int"))
    total = F.aggregate(_c(counts), lit(0.0), lambda a, x: a + x) + _c(a_unk)
    return F.greatest(_c(a_unk), escape_mass(m, total))


def confidence(a_unk, counts) -> Column:
    """(best + 1) / (sum + slots + residual + 1) over slots with evidence; 0 without any."""
    live = F.filter(_c(counts), lambda x: x > 0)
    total = F.aggregate(live, lit(0.0), lambda a, x: a + x)
    p = (F.array_max(live) + 1) / (total + F.size(live) + residual(a_unk, counts) + 1)
    return F.when(F.size(live) == 0, 0.0).otherwise(p)


def class_entropy(a_unk, counts) -> Column:
    """Shannon entropy over the live slots and the residual, one added to each."""
    live = F.filter(_c(counts), lambda x: x > 0)
    parts = F.concat(F.transform(live, lambda x: x + 1), F.array(residual(a_unk, counts) + 1))
    total = F.aggregate(parts, lit(0.0), lambda a, x: a + x)
    return F.when(F.size(live) == 0, 0.0).otherwise(F.aggregate(F.transform(parts, lambda x: -(x / total) * F.ln(x / total)), lit(0.0), lambda a, x: a + x))


def class_variance(a_unk, counts, k) -> Column:
    """Variance of the share of slot k under the Dirichlet of class_entropy(); 0 without evidence."""
    live = F.filter(_c(counts), lambda x: x > 0)
    total = F.aggregate(live, lit(0.0), lambda a, x: a + x) + F.size(live) + residual(a_unk, counts) + 1
    a = F.get(_c(counts), _c(k))
    return F.when(F.coalesce(a, lit(0.0)) <= 0, 0.0).otherwise((a + 1) * (total - a - 1) / (total * total * (total + 1)))


def saturate(values: list, cap: float) -> list[Column]:
    """Counters scaled so that their sum is at most cap; a cap of 0 is none."""
    values = [_c(v) for v in values]
    if cap <= 0:
        return values
    s = sum(values[1:], values[0])
    return [F.when(s > cap, v * cap / s).otherwise(v) for v in values]


def saturate_dir(other, cls: list, cnt: list, cap: float, alpha: float = ALPHA) -> list[Column]:
    """As saturate(), then filled slots are at least alpha."""
    out = saturate([other, *cnt], cap)
    return [out[0], *(F.when(_c(c) != EMPTY, F.greatest(v, lit(alpha))).otherwise(v) for c, v in zip(cls, out[1:]))]


def top_classes(slots, k) -> Column:
    """struct(kept, dropped_mass) of an array of struct(cls, cnt): the k largest, stable."""
    k = max(0, k)
    by = F.array_sort(F.transform(_c(slots), lambda s, i: F.struct((-s["cnt"]).alias("o"), i.alias("i"), s["cls"].alias("cls"), s["cnt"].alias("cnt"))))
    rest = F.aggregate(F.slice(by, k + 1, 1 << 20), lit(0.0), lambda a, s: a + s["cnt"])
    kept = F.transform(F.slice(by, 1, k), lambda s: F.struct(s["cls"].alias("cls"), s["cnt"].alias("cnt"))) if k else F.slice(_c(slots), 1, 0)
    return F.struct(kept.alias("kept"), rest.alias("dropped_mass"))


# Surface


def tsdf_weight(sdf, trunc: float, kind: str = "constant", sigma: float = 1.0) -> Column:
    d = F.abs(_c(sdf))
    if kind == "linear":
        return F.greatest(lit(0.0), 1 - d / trunc)
    if kind == "gaussian":
        return F.exp(-(d * d) / (2 * sigma * sigma))
    return F.exp(-_c(sdf) / sigma) if kind == "range" else lit(1.0)


def euclidean_sdf(o: list, e: list, v: list) -> Column:
    """Distance from v to the end, positive before it; null where v is abreast of it."""
    o, e, v = ([_c(x) for x in p] for p in (o, e, v))
    proj = sum(((v[i] - o[i]) * (e[i] - v[i]) for i in (1, 2)), (v[0] - o[0]) * (e[0] - v[0]))
    dist = F.sqrt(sum(((e[i] - v[i]) * (e[i] - v[i]) for i in (1, 2)), (e[0] - v[0]) * (e[0] - v[0])))
    return F.when(F.abs(proj) >= 1e-12, F.signum(proj) * dist)


def projective_sdf(o: list, e: list, c: list) -> Column:
    """Depth of the end less the cell corner's depth along the ray."""
    o, e, c = ([_c(x) for x in p] for p in (o, e, c))
    depth = F.sqrt(sum(((e[i] - o[i]) * (e[i] - o[i]) for i in (1, 2)), (e[0] - o[0]) * (e[0] - o[0])))
    along = sum(((c[i] - o[i]) * (e[i] - o[i]) for i in (1, 2)), (c[0] - o[0]) * (e[0] - o[0])) / depth
    return depth - along


def kernel(d, length: float) -> Column:
    """A compact kernel: 1 at 0, 0 from length on."""
    t = _c(d) / length
    k = (2 + F.cos(2 * math.pi * t)) * (1 - t) / 3 + F.sin(2 * math.pi * t) / (2 * math.pi)
    return F.when(t < 1, k).otherwise(0.0)


# Totals and keys


def class_mass(other, counts: list) -> Column:
    """All class evidence of a cell, its priors with it."""
    return sum((_c(c) for c in counts), _c(other))


def packed_key(ix, iy, iz) -> Column:
    """Three cell numbers in one, 21 bits each; neighbours of the origin on either side stay apart."""
    part = lambda c: _c(c).cast("long").bitwiseAND(lit(0x1FFFFF))
    return part(ix).bitwiseOR(F.shiftleft(part(iy), 21)).bitwiseOR(F.shiftleft(part(iz), 42))


# Colours and names

#: Red, green and blue of the first classes.
PALETTE = ((0.5, 0.5, 0.5), (0, 1, 0), (0.5, 0.3, 0.1), (0.3, 0.3, 0.3), (0.1, 0.5, 0.1), (1, 0, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1))


def colour(cls) -> Column:
    """A packed colour of a class: the fixed ones, then full hues by the golden angle; 0 from 256 on."""
    c = _c(cls)
    byte = lambda v: int(v * 255 + 1e-9)
    fixed = F.get(F.array(*[lit((byte(r) << 16) | (byte(g) << 8) | byte(b)) for r, g, b in PALETTE]), F.least(F.greatest(c, lit(0)), lit(len(PALETTE) - 1)))
    h = F.pmod(c * 137.508, lit(360.0)) / 60
    x = 1 - F.abs(F.pmod(h, lit(2.0)) - 1)
    one, zero = lit(1.0), lit(0.0)
    sector = F.floor(h).cast("int")
    pick = lambda ks: F.element_at(F.array(*ks), sector + 1)
    rgb = [pick([one, x, zero, zero, x, one]), pick([x, one, one, x, zero, zero]), pick([zero, zero, x, one, one, x])]
    r, g, b = (F.floor(k * 255).cast("int") for k in rgb)
    return F.when((c < 0) | (c > 255), 0).when(c < len(PALETTE), fixed).otherwise(pack_rgb(r, g, b))


#: Groups of class names and the words that tell them; the first group with a word decides.
NAME_GROUPS = (
    (8, ("person",)),
    (9, ("rider", "bicyclist", "motorcyclist")),
    (7, ("traffic-sign", "traffic sign", "traffic-light", "traffic light", "sign-frame", "signboard")),
    (2, ("sidewalk", "curb", "pedestrian")),
    (1, ("road", "lane", "crosswalk", "bike-lane", "bike lane", "parking", "service-lane", "service lane", "rail-track", "rail track", "path", "runway")),
    (4, ("building", "bridge", "tunnel", "house", "skyscraper")),
    (6, ("pole", "street-light", "street light", "streetlight", "banner", "billboard")),
    (5, ("vegetation", "tree", "plant", "palm", "flower")),
    (12, ("fence", "guard-rail", "guard rail", "railing")),
    (13, ("wall", "barrier")),
    (10, ("car", "truck", "bus", "caravan", "trailer", "van", "on-rails", "on rails", "motorcycle", "bicycle", "boat", "vehicle", "wheeled-slow", "minibike")),
    (11, ("sky",)),
    (3, ("terrain", "sand", "snow", "mountain", "grass", "earth", "field", "hill", "land", "dirt", "rock")),
)


def collapse_name(name, groups=NAME_GROUPS) -> Column:
    """The group of the first keyword that a lower-cased name (`_` as `-`) holds, else 0."""
    n = F.translate(F.lower(_c(name)), "_", "-")
    out = lit(0)
    for group, words in reversed(groups):
        hit = lit(False)
        for w in words:
            hit = hit | F.contains(n, lit(w))
        out = F.when(hit, group).otherwise(out)
    return out
