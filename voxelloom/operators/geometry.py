"""Surfaces of a distance field: marching cubes, zero crossings, points."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import centre, lit
from .rays import KEY

#: Corners of a cube, and its edges as pairs of corners.
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
EDGES = ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7))
_FACES = ((0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7))  # counter-clockwise from outside


@cache
def triangles(case: int) -> tuple[tuple[int, int, int], ...]:
    """The triangles (edge numbers) of a cube whose corner i is inside if bit i is set.

    On each face, walked around, a segment runs from where the walk enters the
    inside to where it next leaves it, so inside corners across an ambiguous face
    stay apart. Segments join to rings, and a ring is cut to a fan."""
    inside = [bool(case >> i & 1) for i in range(8)]
    edge = {frozenset(e): k for k, e in enumerate(EDGES)}
    follow: dict[int, int] = {}
    for face in _FACES:
        ring = [(face[i], face[(i + 1) % 4]) for i in range(4)]
        for i, (a, b) in enumerate(ring):
            if not inside[a] and inside[b]:
                j = next(j % 4 for j in range(i + 1, i + 5) if inside[ring[j % 4][0]] and not inside[ring[j % 4][1]])
                follow[edge[frozenset(ring[j])]] = edge[frozenset((a, b))]
    out, left = [], set(follow)
    while left:
        start = at = min(left)
        loop = []
        while at in left:
            left.remove(at)
            loop.append(at)
            at = follow[at]
        assert at == start
        out += [(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)]
    return tuple(out)


def cubes(tsdf: DataFrame, min_weight: float) -> DataFrame:
    """(ix, iy, iz, f0 .. f7, case) of every cube of eight observed cells. Each cell
    goes to the eight cubes that it is a corner of; one aggregation, no join."""
    seen = tsdf.where(F.col("tsdf_w") >= min_weight)
    at = F.explode(F.array(*[F.struct(lit(k).alias("k"), *[(F.col(f"i{a}") - d).alias(f"i{a}") for a, d in zip("xyz", c)]) for k, c in enumerate(CORNERS)])).alias("c")
    own = seen.select("tsdf_d", at).select("tsdf_d", "c.*")
    f = [F.max(F.when(F.col("k") == k, F.col("tsdf_d"))).alias(f"f{k}") for k in range(8)]
    c = own.groupBy(*KEY).agg(F.count("*").alias("n"), *f).where("n = 8").drop("n")
    case = sum((F.when(F.col(f"f{k}") < 0, 1 << k).otherwise(0) for k in range(1, 8)), F.when(F.col("f0") < 0, 1).otherwise(0))
    return c.withColumn("case", case).where("case > 0 AND case < 255")


def _vertex(e: Column, res: float) -> list[Column]:
    """The point where edge number e of a cube crosses zero."""
    pick = lambda values: F.get(F.array(*values), e)
    f0, f1 = pick([F.col(f"f{a}") for a, _ in EDGES]), pick([F.col(f"f{b}") for _, b in EDGES])
    total = F.abs(f0) + F.abs(f1)
    t = F.when(total > 1e-10, F.abs(f0) / total).otherwise(0.5)
    side = lambda k, end: pick([lit(CORNERS[x[end]][k]) for x in EDGES])
    return [centre(F.col(f"i{a}") + side(k, 0) + t * (side(k, 1) - side(k, 0)), res) for k, a in enumerate("xyz")]


def mesh(tsdf: DataFrame, min_weight: float, res: float) -> DataFrame:
    """(ix, iy, iz, tri, x0, y0, z0, .. z2): triangles of the surface, cube by cube."""
    rows = [(c, t, *e) for c in range(256) for t, e in enumerate(triangles(c))]
    cases = F.broadcast(tsdf.sparkSession.createDataFrame(rows, "case int, tri int, e0 int, e2 int, e1 int"))  # at most five for each of 256
    m = cubes(tsdf, min_weight).join(cases, "case")
    points = {f"{a}{i}": v for i in range(3) for a, v in zip("xyz", _vertex(F.col(f"e{i}"), res))}
    return m.select(*KEY, "tri", *[v.alias(n) for n, v in points.items()])


def mesh_vertices(tsdf: DataFrame, min_weight: float, res: float) -> DataFrame:
    """(vx, vy, vz, axis, x, y, z): each crossed edge once, by its lower cell and axis."""
    c = cubes(tsdf, min_weight)
    c = c.withColumn("e", F.explode(F.array(*[F.when((F.col(f"f{a}") < 0) != (F.col(f"f{b}") < 0), lit(k)) for k, (a, b) in enumerate(EDGES)]))).where("e IS NOT NULL")
    low = [F.get(F.array(*[lit(min(CORNERS[a][k], CORNERS[b][k])) for a, b in EDGES]), F.col("e")) for k in range(3)]
    axis = F.get(F.array(*[lit(next(k for k in range(3) if CORNERS[a][k] != CORNERS[b][k])) for a, b in EDGES]), F.col("e"))
    v = c.select(*[(F.col(f"i{a}") + s).alias(f"v{a}") for a, s in zip("xyz", low)], axis.alias("axis"), *[p.alias(a) for a, p in zip("xyz", _vertex(F.col("e"), res))])
    return v.groupBy("vx", "vy", "vz", "axis").agg(*[F.min(a).alias(a) for a in "xyz"])


def zero_crossings(tsdf: DataFrame, min_weight: float, res: float) -> DataFrame:
    """(ix, iy, iz, axis, x, y, z): where the field changes sign towards the next cell of an axis."""
    seen = tsdf.where(F.col("tsdf_w") >= min_weight).select(*KEY, F.col("tsdf_d").alias("f"))
    steps = F.explode(F.array(*[F.struct(lit(k).alias("axis"), *[(F.col(f"i{a}") - (1 if j == k else 0)).alias(f"i{a}") for j, a in enumerate("xyz")]) for k in range(3)])).alias("s")
    behind = seen.select(F.col("f").alias("g"), steps).select("g", "s.*")
    m = seen.join(behind, KEY).where((F.col("f") > 0) != (F.col("g") > 0))
    total = F.abs("f") + F.abs("g")
    t = F.when(total > 1e-10, F.abs("f") / total).otherwise(0.5)
    return m.select(*KEY, "axis", *[centre(F.col(f"i{a}") + F.when(F.col("axis") == k, t).otherwise(0.0), res).alias(a) for k, a in enumerate("xyz")])


def surface_points(tsdf: DataFrame, min_weight: float, res: float) -> DataFrame:
    """Centres of observed cells with their distance and weight."""
    return tsdf.where(F.col("tsdf_w") >= min_weight).select(*KEY, *[centre(f"i{a}", res).alias(a) for a in "xyz"], "tsdf_d", "tsdf_w")
