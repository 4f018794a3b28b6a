"""Questions to a map: regions, grids, clouds, look-ups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import beta_variance, cell, colour, confidence, corner, dominant, information_gain, is_prior_beta, lit, p_occ, raw_evidence, top_classes
from ..params import EMPTY, K_TOP, MapParams
from .rays import KEY

CLS, CNT = [f"cls{k}" for k in range(K_TOP)], [f"cnt{k}" for k in range(K_TOP)]


def with_classes(beta: DataFrame, classes: DataFrame, params: MapParams) -> DataFrame:
    """Occupancy with class state; a cell without classes has the prior."""
    d = beta.join(classes.select(*KEY, "other", *CLS, *CNT), KEY, "left")
    fill = {"other": lit(params.prior_other)} | {c: lit(EMPTY) for c in CLS} | {c: lit(params.alpha) for c in CNT}
    return d.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


def project(cells: DataFrame, params: MapParams, a_unk: str = "merger", *more: Column) -> DataFrame:
    """Raw evidence of joined cells: a_unk and slots (array of struct(cls, cnt)). The
    mapper's a_unk keeps the prior of OTHER, the merger's leaves it out. more: further columns."""
    unk = F.col("other") if a_unk == "mapper" else F.greatest(lit(0.0), F.col("other") - params.prior_other)
    slots = F.filter(F.array(*[F.struct(F.col(c).alias("cls"), raw_evidence(n, c, params.alpha).alias("cnt")) for c, n in zip(CLS, CNT)]), lambda s: s["cnt"] > 0)
    return cells.select(*KEY, "a_occ", "a_free", unk.alias("a_unk"), slots.alias("slots"), *more)


def in_box(lo: tuple, hi: tuple, res: float) -> Column:
    """Cells between those of two corners, both included."""
    out = lit(True)
    for a, x, y in zip("xyz", lo, hi):
        out = out & F.col(f"i{a}").between(math.floor(x / res), math.floor(y / res))
    return out


def region(beta: DataFrame, classes: DataFrame, lo: tuple, hi: tuple, params: MapParams, top_k: int = K_TOP) -> DataFrame:
    """Evidence of the known cells of a box; classes beyond top_k go to a_unk. The box
    is a filter on key columns, which reaches the scans of both tables."""
    box = in_box(lo, hi, params.resolution)
    v = project(with_classes(beta.where(box & ~is_prior_beta()), classes.where(box), params), params)
    v = v.withColumn("t", top_classes("slots", top_k))
    r = params.resolution
    return v.select(*[corner(f"i{a}", r).alias(a) for a in "xyz"], "a_occ", "a_free", (F.col("a_unk") + F.col("t.dropped_mass")).alias("a_unk"), F.col("t.kept").alias("semantic_evidence"))


def occupancy_grid(beta: DataFrame, z_min: float, z_max: float, params: MapParams, res: float | None = None, occupied: float = 0.5) -> DataFrame:
    """(gx, gy, value) of every square of the known extent: the highest occupancy of
    its column in percent, 0 below the threshold, -1 where nothing is known."""
    r2, z = res or params.resolution, corner("iz", params.resolution)
    k = beta.where(~is_prior_beta() & (z >= z_min) & (z <= z_max))
    at = lambda a: F.floor(corner(f"i{a}", params.resolution) / r2).cast("int").alias(f"g{a}")
    top = k.select(at("x"), at("y"), p_occ().alias("p")).groupBy("gx", "gy").agg(F.max("p").alias("p"))
    return densify(top.select("gx", "gy", F.when(F.col("p") >= occupied, F.least(lit(100.0), 100 * F.col("p")).cast("int")).otherwise(0).alias("value")))


def densify(grid: DataFrame, fill: int = -1) -> DataFrame:
    """Every square between the extremes of (gx, gy, value); those without a row get
    `fill`. Columns of the rectangle are dealt out before their squares are made."""
    box = grid.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("gx", "gy") for f in (F.min, F.max)]).where("min_gx IS NOT NULL")
    full = box.select(F.explode(F.sequence("min_gx", "max_gx")).alias("gx"), "min_gy", "max_gy").repartition("gx").select("gx", F.explode(F.sequence("min_gy", "max_gy")).alias("gy"))
    return full.join(grid, ["gx", "gy"], "left").select("gx", "gy", F.coalesce("value", lit(fill)).alias("value"))


def planning_band(beta: DataFrame, z_min: float, z_max: float, params: MapParams, res: float, occupied: float = 0.5) -> DataFrame:
    """(gx, gy, value): 100 where any cell of a height band is occupied, else 0."""
    z = corner("iz", params.resolution)
    k = beta.where(~is_prior_beta() & (z >= z_min) & (z <= z_max))
    at = lambda a: F.floor(corner(f"i{a}", params.resolution) / res).cast("int").alias(f"g{a}")
    return k.select(at("x"), at("y"), (p_occ() >= occupied).cast("int").alias("o")).groupBy("gx", "gy").agg((F.max("o") * 100).alias("value"))


def inflate(grid: DataFrame, radius: float, res: float) -> DataFrame:
    """Every blocked square blocks the disc around it, within the grid."""
    n = math.ceil(radius / res)
    side = F.sequence(lit(-n), lit(n))
    disc = grid.where("value = 100").select("gx", "gy", F.explode(side).alias("dx")).select("*", F.explode(side).alias("dy")).where(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= n * n)
    painted = disc.select((F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy")).distinct().withColumn("hit", lit(True))
    return grid.join(painted, ["gx", "gy"], "left").select("gx", "gy", F.when(F.col("hit"), 100).otherwise(F.col("value")).alias("value"))


def rolling_window(x: float, y: float, size: float, res: float) -> tuple[int, int, int]:
    """(first gx, first gy, squares a side) of a window around a position, snapped to the grid."""
    return math.floor((x - size / 2) / res), math.floor((y - size / 2) / res), max(1, round(size / res))


def planning_terrain(beta: DataFrame, params: MapParams, res: float, rel_min: float, rel_max: float, stack_cap: float, occupied: float = 0.5) -> DataFrame:
    """(gx, gy, value): of each lattice column the ground is the lowest occupied stack
    (gaps up to 1.5 cells, up to a height); 100 where an occupied cell lies between
    two heights above the ground's top, else 0."""
    r = params.resolution
    occ = beta.where(~is_prior_beta() & (p_occ() >= occupied)).select(*KEY, corner("iz", r).alias("z"))
    col = Window.partitionBy("ix", "iy")
    up = col.orderBy("iz")
    s = occ.withColumn("ground", F.min("z").over(col)).withColumn("gap", F.col("z") - F.lag("z").over(up))
    broken = (F.coalesce(F.col("gap"), lit(0.0)) > 1.5 * r + 1e-9) | (F.col("z") - F.col("ground") > stack_cap + 1e-9)
    s = s.withColumn("out", F.max(broken.cast("int")).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    s = s.withColumn("top", F.max(F.when(F.col("out") == 0, F.col("z"))).over(col) + r)
    rel = F.col("z") - F.col("top")
    s = s.withColumn("b", ((rel >= rel_min - 1e-9) & (rel <= rel_max + 1e-9)).cast("int"))
    at = lambda a: F.floor(corner(f"i{a}", r) / res).cast("int").alias(f"g{a}")
    return s.groupBy(at("x"), at("y")).agg((F.max("b") * 100).alias("value"))


def overlay(persistent: DataFrame, transient: DataFrame, gate: float) -> DataFrame:
    """Transient cells that pass the gate take the place of persistent ones."""
    t = transient.where(~is_prior_beta() & (p_occ() >= gate))
    return persistent.join(t.select(*KEY), KEY, "left_anti").unionByName(t.select(*persistent.columns))


def union_cell(persistent: DataFrame, transient: DataFrame) -> DataFrame:
    """Of each cell the persistent state if occupied, else the transient if occupied, else what there is."""
    p, t = (x.select(*KEY, F.struct("a_occ", "a_free").alias(n)) for x, n in ((persistent, "p"), (transient, "t")))
    m = p.join(t, KEY, "full_outer")
    occ = lambda s: F.coalesce(p_occ(F.col(f"{s}.a_occ"), F.col(f"{s}.a_free")) > 0.5, lit(False))
    pick = F.when(occ("p"), F.col("p")).when(occ("t"), F.col("t")).otherwise(F.coalesce("p", "t"))
    return m.select(*KEY, pick.alias("v")).select(*KEY, "v.*")


def occupied_cloud(beta: DataFrame, classes: DataFrame, params: MapParams, visible: float = 0.7) -> DataFrame:
    """Occupied cells as points with colour, class, confidence, variance and expected gain."""
    cells = with_classes(beta.where(~is_prior_beta(slop=1e-3) & (p_occ() >= visible)), classes, params)
    named = dominant("other", CLS, CNT, params.prior_other, params.alpha).alias("class_id")
    out = project(cells, params, "mapper", named).withColumn("counts", F.transform("slots", lambda s: s["cnt"]))
    r = params.resolution
    return out.select(*KEY, *[corner(f"i{a}", r).alias(a) for a in "xyz"], colour("class_id").alias("rgb"), p_occ().alias("p_occ"), "class_id", confidence("a_unk", "counts").alias("confidence"), beta_variance("a_occ", "a_free").alias("variance"), information_gain("a_occ", "a_free").alias("eig"), "a_occ", "a_free", "a_unk")


def lookup(points: DataFrame, table: DataFrame, res: float, values: list[str]) -> DataFrame:
    """The values of each point's cell; null where the table has none."""
    p = points.withColumns({f"i{a}": cell(a, res) for a in "xyz"})
    return p.join(table.select(*KEY, *values), KEY, "left")


def labels_at(points: DataFrame, classes: DataFrame, params: MapParams) -> DataFrame:
    """label: the dominant class of each point's cell, EMPTY where there is none."""
    d = classes.select(*KEY, dominant("other", CLS, CNT, params.prior_other, params.alpha).alias("label"))
    return lookup(points, d, params.resolution, ["label"]).withColumn("label", F.coalesce("label", lit(EMPTY)))


def statistics(beta: DataFrame, classes: DataFrame, tsdf: DataFrame) -> DataFrame:
    """Cells and bytes of each table."""
    rows = [t.agg(F.count("*").alias("cells")).select(lit(n).alias("grid"), "cells", (F.col("cells") * size).alias("bytes")) for t, n, size in ((beta, "beta", 8), (classes, "dir", 16), (tsdf, "tsdf", 8))]
    return rows[0].union(rows[1]).union(rows[2])


def eviction_log(branches: DataFrame) -> DataFrame:
    """(frame, match, empty, evict, drop): a line for each frame, from what became of its evidence in each cell."""
    total = {"match": "n_match", "empty": "n_empty", "evict": "n_evict", "drop": "n_drop"}
    return branches.groupBy(F.col("frame_id").alias("frame")).agg(*[F.sum(F.col(c).cast("long")).alias(n) for n, c in total.items()])
