"""Integration of rays into a map: occupancy, classes and surface in one go.

Rays have frame_id, seq, origin o*, end e*, kind (hit or miss), quality, is_dynamic,
and probs, an array of class probabilities (null or empty: no label). Columns w_occ,
w_free, kappa and min_p_occ, where they are, take the place of the map's weights
(rays.with_profiles() adds them for each sensor).

A frame's hits come first, in the order of seq, then what its rays carve. A hit's
classes weigh as much as the cell is occupied after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.scalar import lit, tsdf_weight
from ..params import EMPTY, K_TOP, MapParams
from .rays import KEY, frame_cells, fused_visits, hit_cells, weights

SLOTS = ["other", *[f"{f}{k}" for k in range(K_TOP) for f in ("cls", "cnt")]]


def distribution(probs: Column) -> Column:
    """(cls, share) of each class of a probability vector, in its order, and last the
    share that no class covers, for OTHER (class EMPTY). Probabilities that sum to
    more than 1 are normalised; values that aren't positive count nothing."""
    positive = lambda p: F.when(p > 0, p.cast("double")).otherwise(0.0)
    total = F.aggregate(F.coalesce(probs, F.array().cast("array<double>")), lit(0.0), lambda a, p: a + positive(p))

    def parts(t: Column) -> Column:
        norm = F.when(t > 1, 1 / t).otherwise(1.0)
        known = F.filter(F.transform(F.coalesce(probs, F.array().cast("array<double>")), lambda p, i: F.struct(i.alias("cls"), (positive(p) * norm).alias("share"))), lambda x: x["share"] > 0)
        return F.concat(known, F.array(F.struct(lit(EMPTY).alias("cls"), (1 - t * norm).alias("share"))))

    return folds.let(total, parts)


def argmax(probs: Column) -> Column:
    """The first class of the highest probability; null without a positive one."""
    top = F.array_max(probs)
    return F.when(top > 0, (F.array_position(probs, top) - 1).cast("int"))


def events(rays: DataFrame, params: MapParams) -> DataFrame:
    """(cell, frame_id, phase, seq, occ, free, q, ..): persistent hits (phase 1), then what
    each frame carves of a cell (phase 2)."""
    r = weights(rays, params)
    hits = hit_cells(r.where("NOT is_dynamic"), params).select(*KEY, "frame_id", lit(1).alias("phase"), "seq", (F.col("w_occ") * F.col("quality")).alias("occ"), lit(0.0).alias("free"), F.col("quality").alias("q"), "kappa", "min_p_occ", "probs")
    none = [lit(None).cast(hits.schema[c].dataType).alias(c) for c in ("q", "kappa", "min_p_occ", "probs")]
    carved = frame_cells(r, params).where("free > 0").select(*KEY, "frame_id", lit(2).alias("phase"), lit(0).cast("long").alias("seq"), lit(0.0).alias("occ"), "free", *none)
    return hits.unionByName(carved)


def running(rays: DataFrame, params: MapParams) -> DataFrame:
    """Hits with p: the cell's occupancy after each of them, without saturation."""
    w = Window.partitionBy(*KEY).orderBy("frame_id", "phase", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda c: F.sum(F.col(c).cast("decimal(28,12)")).over(w).cast("double")  # noqa: E731  exact, so no order of additions shows
    e = events(rays, params).withColumn("o", lit(1.0) + total("occ")).withColumn("p", F.col("o") / (F.col("o") + (lit(1.0) + total("free")))).drop("o")
    return e.where("phase = 1").drop("phase", "free")


def classes(rays: DataFrame, params: MapParams) -> DataFrame:
    """(cell, other, cls0, cnt0, ..): the class evidence of each cell that got any, by the
    mode of the map: `dirichlet` spreads kappa * p * q over the probabilities where p
    reaches the gate, `majority` counts the likeliest class, `naive` keeps the last one
    (both where p > 0.5). Without saturation."""
    hits = running(rays, params)
    if params.mode == "naive":  # the last label; each one before it leaves its vote to OTHER
        votes = hits.where("p > 0.5").select(*KEY, "frame_id", "seq", argmax(F.col("probs")).alias("cls")).where("cls IS NOT NULL")
        g = votes.groupBy(*KEY).agg(F.count("*").alias("n"), F.max_by("cls", F.struct("frame_id", "seq")).alias("last"))
        rest = [v for k in range(1, K_TOP) for v in (lit(EMPTY).alias(f"cls{k}"), lit(params.alpha).alias(f"cnt{k}"))]
        return g.select(*KEY, (lit(params.prior_other) + F.col("n") - 1).alias("other"), F.col("last").alias("cls0"), lit(params.alpha + 1.0).alias("cnt0"), *rest)
    if params.mode == "majority":
        each = hits.where("p > 0.5").select(*KEY, "frame_id", "seq", lit(0).alias("i"), argmax(F.col("probs")).alias("cls"), lit(1.0).alias("inc")).where("cls IS NOT NULL")
    else:
        share = F.col("kappa") * F.col("p") * F.col("q")
        each = hits.where((F.col("p") >= F.col("min_p_occ")) & (share > 0)).select(*KEY, "frame_id", "seq", share.alias("s"), F.posexplode(distribution(F.col("probs"))).alias("i", "x"))
        each = each.select(*KEY, "frame_id", "seq", "i", F.col("x.cls").alias("cls"), (F.col("s") * F.col("x.share")).alias("inc")).where((F.col("cls") == EMPTY) | (F.col("inc") > 0))
    d = each.groupBy(*KEY).agg(folds.fold_slots(F.collect_list(F.struct("frame_id", "seq", "i", "cls", "inc")), params.prior_other, params.alpha).alias("d"))
    return d.select(*KEY, *[F.col(f"d.{c}").alias(c) for c in SLOTS])


def saturated(rays: DataFrame, params: MapParams) -> DataFrame:
    """(cell, a_occ, a_free, other, cls0, ..): occupancy and classes under the map's
    saturation, whose caps after each step make the update of a cell a single fold."""
    e = events(rays, params).withColumn("parts", F.when(F.col("phase") == 1, distribution(F.col("probs"))))
    one = F.struct("frame_id", "phase", "seq", F.coalesce("q", lit(0.0)).alias("q"), F.col("occ").alias("o"), F.col("free").alias("w"), "parts", F.coalesce("kappa", lit(0.0)).alias("kappa"), F.coalesce("min_p_occ", lit(1.0)).alias("min_p"))
    g = e.groupBy(*KEY).agg(folds.fold_parts(F.collect_list(one), params.saturation, params.prior_other, params.alpha).alias("s"))
    return g.select(*KEY, "s.a_occ", "s.a_free", *[F.col(f"s.d.{c}").alias(c) for c in SLOTS])


def integrate(rays: DataFrame, params: MapParams) -> tuple[DataFrame, DataFrame]:
    """(occupancy, classes) of a map made of the rays."""
    if params.saturation > 0:
        s = saturated(rays, params)
        untouched = (F.col("cls0") == EMPTY) & (F.col("other") <= params.prior_other)
        return s.select(*KEY, "a_occ", "a_free"), s.where(~untouched).select(*KEY, *SLOTS)
    cells = frame_cells(weights(rays, params), params).groupBy(*KEY).agg((lit(1.0) + F.sum("occ")).alias("a_occ"), (lit(1.0) + F.sum("free")).alias("a_free"))
    return cells, classes(rays, params)


def integrate_fused(rays: DataFrame, params: MapParams, weight: str = "constant", sigma: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occupancy, classes, surface) from one walk of each hit through its band and, when
    the map carves, from its origin on. Rays with geometry_off and moving things leave no surface."""
    r = weights(rays.where("kind = 'hit'"), params)
    v = fused_visits(r, params)
    own = r.select("frame_id", "seq", F.col("quality").alias("_q"), "w_occ", "w_free", F.col("is_dynamic").alias("_moves"), *(["geometry_off"] if "geometry_off" in r.columns else []))
    v = v.join(own, ["frame_id", "seq"])
    persistent = F.col("hit") & ~F.col("_moves")
    cells = v.groupBy("frame_id", *KEY).agg(F.sum(F.when(persistent, F.col("w_occ") * F.col("_q")).otherwise(0.0)).alias("occ"), F.max(F.when(F.col("carve"), F.col("w_free") * F.col("_q"))).alias("w"), F.max(persistent).alias("taken"))
    free = F.when(F.col("taken"), 0.0).otherwise(F.coalesce("w", lit(0.0)))
    cells = cells.where("taken OR w > 0").groupBy(*KEY).agg((lit(1.0) + F.sum("occ")).alias("a_occ"), (lit(1.0) + F.sum(free)).alias("a_free"))
    p = params.sanitised()
    surface = v.where(F.col("surface") & (~F.col("geometry_off") if "geometry_off" in v.columns else lit(True)))
    surface = surface.select(*KEY, F.least(F.col("sdf"), lit(p.trunc)).alias("d"), tsdf_weight("sdf", p.trunc, weight, sigma).alias("w")).where("w > 0")
    tsdf = surface.groupBy(*KEY).agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("tsdf_d"), F.sum("w").alias("tsdf_w"))
    return cells, classes(rays, params), tsdf


