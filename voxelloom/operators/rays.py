"""Rays on the lattice: walks, carving, hits, and surface bands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cell, centre, corner, euclidean_sdf, kernel, lit, p_occ, projective_sdf, tsdf_weight
from ..params import MapParams

KEY = ["ix", "iy", "iz"]


def with_keys(rays: DataFrame, res: float) -> DataFrame:
    """Adds the cells of origin (k0x..) and end (k1x..)."""
    return rays.withColumns({f"k{n}{a}": cell(f"{p}{a}", res) for n, p in ((0, "o"), (1, "e")) for a in "xyz"})


def walk_cells(rays: DataFrame, inclusive: bool = False, a: str = "k0", b: str = "k1", only_end: Column | None = None) -> DataFrame:
    """One row for each cell on the line between two cells (columns a*, b*): step, the
    last step m, and ix, iy, iz. The last cell is left out unless inclusive; two equal
    cells give nothing, or that cell if inclusive. Of rays with only_end an inclusive
    walk has the last cell alone. Step i of a line whose longest side has m
    cells lies at the rounded i / m of each side, so no loop is needed."""
    d = {x: F.col(f"{b}{x}") - F.col(f"{a}{x}") for x in "xyz"}
    m = F.greatest(*[F.abs(v) for v in d.values()])
    begin = lit(0) if only_end is None else F.when(only_end, F.col("m")).otherwise(0)
    steps = F.sequence(begin, F.col("m")) if inclusive else F.when(F.col("m") > 0, F.sequence(lit(0), F.col("m") - 1))
    out = rays.withColumn("m", m).withColumn("step", F.explode(steps))

    def at(x: str) -> Column:
        side = F.when(F.col("m") > 0, F.floor((2 * F.col("step") * F.abs(d[x]) + F.col("m")) / (2 * F.col("m")))).otherwise(0)
        return (F.col(f"{a}{x}") + F.when(d[x] < 0, -1).otherwise(1) * side).cast("int")

    return out.withColumns({f"i{x}": at(x) for x in "xyz"})


def carve_steps(rays: DataFrame, params: MapParams) -> DataFrame:
    """Cells that the rays pass: hits up to the cell before their end, misses with
    it. Rays without weight are dropped before they are walked."""
    r = with_keys(rays.withColumn("w", lit(params.w_free) * F.col("quality")).where("w > 0"), params.resolution)
    hits = walk_cells(r.where("kind = 'hit'"))
    return hits.unionByName(walk_cells(r.where("kind = 'miss'"), inclusive=True))


def hit_cells(rays: DataFrame, params: MapParams) -> DataFrame:
    """The end cell of each hit as ix, iy, iz."""
    h = rays.where("kind = 'hit'")
    return h.withColumns({f"i{a}": cell(f"e{a}", params.resolution) for a in "xyz"})


def weights(rays: DataFrame, params: MapParams) -> DataFrame:
    """Adds w_occ, w_free, kappa and min_p_occ of the map where the rays have none of their own."""
    value = {"w_occ": params.w_occ, "w_free": params.w_free, "kappa": params.kappa, "min_p_occ": params.min_p_occ}
    return rays.withColumns({k: lit(float(v)) for k, v in value.items() if k not in rays.columns})


def frame_cells(rays: DataFrame, params: MapParams) -> DataFrame:
    """(frame_id, ix, iy, iz, occ, free, w) of each frame and cell: what persistent hits add, the
    largest weight w with which the cell is passed, and what of it is carved: nothing
    where a persistent hit of the frame lies. Every ray is walked once, its end with
    it; a ray that carves nothing is its end alone."""
    r = with_keys(weights(rays, params), params.resolution).withColumn("w", F.col("w_free") * F.col("quality"))
    cells = walk_cells(r, inclusive=True, only_end=F.col("w") <= 0)
    hit = (F.col("kind") == "hit") & (F.col("step") == F.col("m"))
    lands = hit & ~F.col("is_dynamic")
    w = F.when(~hit & (F.col("w") > 0), F.col("w"))
    g = cells.groupBy("frame_id", *KEY).agg(F.sum(F.when(lands, F.col("w_occ") * F.col("quality"))).alias("occ"), F.max(w).alias("w"), F.max(lands).alias("lands"))
    g = g.where("lands OR w IS NOT NULL")
    return g.select("frame_id", *KEY, F.coalesce("occ", lit(0.0)).alias("occ"), F.when(F.col("lands"), 0.0).otherwise(F.coalesce("w", lit(0.0))).alias("free"), "w")


def batched_carve(rays: DataFrame, params: MapParams) -> DataFrame:
    """(ix, iy, iz, inc): of each frame the largest weight with which a cell is
    passed, unless a persistent hit of the frame lies there; summed over frames."""
    return frame_cells(rays, params).where("free > 0").groupBy(*KEY).agg(F.sum("free").alias("inc"))


def immediate_carve(rays: DataFrame, params: MapParams) -> DataFrame:
    """(ix, iy, iz, inc): every pass counts."""
    return carve_steps(rays, params).groupBy(*KEY).agg(F.sum("w").alias("inc"))


def guarded_carve(rays: DataFrame, beta: DataFrame, params: MapParams, threshold: float) -> DataFrame:
    """As immediate_carve(), but a ray ends at the first cell that the given map
    holds for occupied. The map is the one before the scan: within a scan, passes
    do not see each other."""
    walls = beta.where(p_occ() > threshold).select(*KEY)
    steps = carve_steps(rays, params)
    first = steps.join(walls, KEY, "left_semi").groupBy("seq").agg(F.min("step").alias("wall"))
    kept = steps.join(first, "seq", "left").where(F.col("wall").isNull() | (F.col("step") < F.col("wall")))
    return kept.groupBy(*KEY).agg(F.sum("w").alias("inc"))


def occupancy(rays: DataFrame, params: MapParams, batched: bool = True) -> DataFrame:
    """(ix, iy, iz, a_occ, a_free) from all rays, without saturation."""
    if batched:
        return frame_cells(rays, params).groupBy(*KEY).agg((lit(1.0) + F.sum("occ")).alias("a_occ"), (lit(1.0) + F.sum("free")).alias("a_free"))
    hit = hit_cells(rays.where("NOT is_dynamic"), params).select(*KEY, (lit(params.w_occ) * F.col("quality")).alias("occ"), lit(0.0).alias("free"))
    free = immediate_carve(rays, params).select(*KEY, lit(0.0).alias("occ"), F.col("inc").alias("free"))
    return hit.unionByName(free).groupBy(*KEY).agg((lit(1.0) + F.sum("occ")).alias("a_occ"), (lit(1.0) + F.sum("free")).alias("a_free"))


def _direction(rays: DataFrame) -> DataFrame:
    d = [F.col(f"e{a}") - F.col(f"o{a}") for a in "xyz"]
    out = rays.withColumn("depth", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where("depth >= 1e-4")
    return out.withColumns({f"u{a}": (F.col(f"e{a}") - F.col(f"o{a}")) / F.col("depth") for a in "xyz"})


def band_cells(rays: DataFrame, params: MapParams, fused: bool = False) -> DataFrame:
    """The cells of each ray's surface band with their signed distance sdf, which is
    null where a cell lies abreast of the end: from the truncation before the end
    (or the origin, when carving) to the truncation behind it, with the end's cell
    in any case. A fused walk begins at the origin or before. Rays of no length
    are dropped."""
    p = params.sanitised()
    r = _direction(rays)
    back = F.col("depth") if p.carving else F.greatest(F.col("depth"), lit(p.trunc)) if fused else lit(p.trunc)
    res = p.resolution
    cols = {f"a{a}": cell(F.col(f"e{a}") - back * F.col(f"u{a}"), res) for a in "xyz"} | {f"b{a}": cell(F.col(f"e{a}") + lit(p.trunc) * F.col(f"u{a}"), res) for a in "xyz"} | {f"h{a}": cell(f"e{a}", res) for a in "xyz"}
    r = r.withColumns(cols)
    far = walk_cells(r, inclusive=True, a="a", b="b").drop("step", "m")
    end = r.withColumns({f"i{a}": F.col(f"h{a}") for a in "xyz"})
    cells = far.unionByName(end).dropDuplicates(["seq", *KEY])
    sdf = euclidean_sdf(["ox", "oy", "oz"], ["ex", "ey", "ez"], [centre(f"i{a}", res) for a in "xyz"])
    at_end = (F.col("ix") == F.col("hx")) & (F.col("iy") == F.col("hy")) & (F.col("iz") == F.col("hz"))
    return cells.withColumn("sdf", sdf).withColumn("at_end", at_end)


def integrate_tsdf(rays: DataFrame, params: MapParams, weight: str = "constant", sigma: float = 1.0) -> DataFrame:
    """(ix, iy, iz, tsdf_d, tsdf_w): weighted means of truncated distances over all rays."""
    p = params.sanitised()
    c = band_cells(rays, p).where(F.col("sdf").isNotNull() & (F.col("sdf") > -p.trunc))
    d, w = F.least(F.col("sdf"), lit(p.trunc)), tsdf_weight("sdf", p.trunc, weight, sigma)
    c = c.select(*KEY, d.alias("d"), w.alias("w")).where("w > 0")
    return c.groupBy(*KEY).agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("tsdf_d"), F.sum("w").alias("tsdf_w"))


def fused_visits(rays: DataFrame, params: MapParams) -> DataFrame:
    """Each cell of a fused walk with what happens there: hit, carve, surface."""
    p = params.sanitised()
    c = band_cells(rays, p, fused=True)
    sdf = F.col("sdf")
    carve = ~F.col("at_end") & sdf.isNotNull() & (sdf > 0) & (sdf <= F.col("depth"))
    near = lit(True) if p.carving else sdf <= p.trunc + p.resolution / 2
    surface = ~F.col("is_dynamic") & sdf.isNotNull() & near & (sdf > -p.trunc)
    return c.select("frame_id", "seq", *KEY, "sdf", F.col("at_end").alias("hit"), F.coalesce(carve, lit(False)).alias("carve"), F.coalesce(surface, lit(False)).alias("surface"))


def endpoint_sdf(rays: DataFrame, params: MapParams) -> DataFrame:
    """Projective distances of the corners in each ray's band: the older map's surface."""
    p = params.sanitised()
    cells = band_cells(rays, p)
    sdf = projective_sdf(["ox", "oy", "oz"], ["ex", "ey", "ez"], [corner(f"i{a}", p.resolution) for a in "xyz"])
    return cells.select("frame_id", "seq", *KEY, sdf.alias("sdf")).where(F.abs("sdf") <= p.trunc)


def with_offsets(df: DataFrame, length: float, res: float) -> DataFrame:
    """Each row with each offset (dx, dy, dz) of cells within a length, and its distance d."""
    r = max(1, math.floor(length / res))
    side = F.explode(F.sequence(lit(-r), lit(r)))
    b = df.withColumn("dz", side).withColumn("dy", side).withColumn("dx", side)
    d = lit(res) * F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).cast("double"))
    return b.withColumn("d", d).where(F.col("d") < length)


def ball(spark, length: float, res: float) -> DataFrame:
    """(dx, dy, dz, d): the offsets of cells within a length."""
    return with_offsets(spark.range(1), length, res).select("dx", "dy", "dz", "d")


def spread_labels(hits: DataFrame, beta: DataFrame, params: MapParams, length: float) -> DataFrame:
    """(ix, iy, iz, cls, w, seq): the evidence that a label gives to the occupied
    cells around it, by the kernel of their distance. hits have cells, a class and
    a quality; cells of the map below the gate get none."""
    near = with_offsets(hits.where("cls IS NOT NULL"), length, params.resolution).select("seq", "cls", "quality", "d", "dz", "dy", "dx", *[(F.col(f"i{a}") + F.col(f"d{a}")).alias(f"i{a}") for a in "xyz"])
    occ = beta.select(*KEY, p_occ().alias("p")).where(F.col("p") >= params.min_p_occ)
    w = lit(params.kappa) * F.col("p") * F.col("quality") * kernel("d", length)
    return near.join(occ, KEY).select(*KEY, "cls", w.alias("w"), "seq", "dz", "dy", "dx").where("w > 0")


def with_profiles(rays: DataFrame, profiles: list, params: MapParams) -> DataFrame:
    """Adds the weights of each ray's sensor (column `sensor`); unknown sensors and
    missing weights take the map's. profiles is a short list of SensorProfile."""
    value = {"w_occ": params.w_occ, "w_free": params.w_free, "kappa": params.kappa, "min_p_occ": params.min_p_occ}
    rows = [(p.name, *(getattr(p, k) for k in value)) for p in profiles]
    table = F.broadcast(rays.sparkSession.createDataFrame(rows, "sensor string, " + ", ".join(f"{k} double" for k in value)))
    out = rays.join(table, "sensor", "left")
    return out.withColumns({k: F.coalesce(k, lit(float(v))) for k, v in value.items()})
