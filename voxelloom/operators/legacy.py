"""The older map, whose cells hold occupancy, surface and classes together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import empty_slots, fold_slots, let, slot_add
from ..functions.scalar import lit
from ..params import K_TOP, MapParams
from .rays import KEY, endpoint_sdf, hit_cells, occupancy


def saturate_max(a_occ: Column, a_free: Column, cap: float) -> list[Column]:
    """Both counters scaled so that the larger one is at most cap, and at least 1 each."""
    top = F.greatest(a_occ, a_free)
    k = F.when(top > cap, cap / top).otherwise(1.0) if cap > 0 else lit(1.0)
    return [F.greatest(lit(1.0), x * k) for x in (a_occ, a_free)]


def endpoint_only(rays: DataFrame, params: MapParams) -> DataFrame:
    """(ix, iy, iz, a_occ): hits alone, nothing is carved."""
    return hit_cells(rays, params).groupBy(*KEY).agg((lit(1.0) + F.sum(lit(params.w_occ) * F.col("quality"))).alias("a_occ"))


def fused_cells(rays: DataFrame, params: MapParams) -> DataFrame:
    """Occupancy by immediate carving, and the mean projective distance in the band, of each cell that has either."""
    occ = occupancy(rays, params, batched=False)
    sdf = endpoint_sdf(rays.where("kind = 'hit' AND NOT is_dynamic"), params).groupBy(*KEY).agg(F.avg("sdf").alias("tsdf_d"), F.count("*").cast("double").alias("tsdf_w"))
    m = occ.join(sdf, KEY, "full_outer")
    return m.select(*KEY, *[F.coalesce(c, lit(1.0)).alias(c) for c in ("a_occ", "a_free")], F.coalesce("tsdf_d", lit(0.0)).alias("tsdf_d"), F.coalesce("tsdf_w", lit(0.0)).alias("tsdf_w"))


def legacy_slots(events: Column) -> Column:
    """Classes without priors: an empty slot holds nothing, what doesn't fit is a_unk."""
    return fold_slots(events, 0.0, 0.0)


def merge(dst: DataFrame, src: DataFrame) -> DataFrame:
    """Cells (a_occ, a_free, other, cls0, cnt0, ..) of two maps in one: counters add up less
    one prior, each slot of src is added to those of dst as new evidence, which may
    put the weakest one out, and what src doesn't know adds to OTHER. A cell that
    only one map has is merged with an empty one."""
    slots = ["other", *[f"{f}{k}" for k in range(K_TOP) for f in ("cls", "cnt")]]
    x, y = (t.select(*KEY, F.struct("a_occ", "a_free").alias(f"b{n}"), F.struct(*slots, *[lit(0).alias(c) for c in ("n_match", "n_empty", "n_evict", "n_drop")]).alias(f"d{n}")) for t, n in ((dst, 0), (src, 1)))
    none = F.struct(lit(1.0).alias("a_occ"), lit(1.0).alias("a_free"))
    m = x.join(y, KEY, "full_outer").withColumns({"b0": F.coalesce("b0", none), "b1": F.coalesce("b1", none), "d0": F.coalesce("d0", empty_slots(0.0, 0.0)), "d1": F.coalesce("d1", empty_slots(0.0, 0.0))})
    given = F.filter(F.array(*[F.struct(F.col(f"d1.cls{k}").alias("cls"), F.col(f"d1.cnt{k}").alias("inc")) for k in range(K_TOP)]), lambda e: e["inc"] > 0)
    merged = let(F.aggregate(given, F.col("d0"), lambda s, e: slot_add(s, e["cls"], e["inc"], 0.0)), lambda d: F.struct((d["other"] + F.col("d1.other")).alias("other"), *[d[c].alias(c) for c in slots[1:]]))
    return m.select(*KEY, *[(F.col(f"b0.{c}") + F.col(f"b1.{c}") - 1).alias(c) for c in ("a_occ", "a_free")], merged.alias("d")).select(*KEY, "a_occ", "a_free", "d.*")
