"""Maps of several sources in one: merging and refolding of cells, re-projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import merge_slots
from ..functions.scalar import cell, centre, is_prior_beta, is_prior_dir, lit, transform
from ..params import ALPHA, EMPTY, K_TOP
from .rays import KEY

SLOTS = ["other", *[f"{f}{k}" for k in range(K_TOP) for f in ("cls", "cnt")]]


def merge_beta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer merge of two occupancy tables: counters add up less one prior, not below it."""
    one = lambda c: F.coalesce(F.col(c), lit(1.0))
    x, y = (t.select(*KEY, F.col("a_occ").alias(f"o{n}"), F.col("a_free").alias(f"f{n}")) for t, n in ((a, 0), (b, 1)))
    m = x.join(y, KEY, "full_outer")
    return m.select(*KEY, *[F.greatest(lit(1.0), one(f"{s}0") + one(f"{s}1") - 1).alias(n) for s, n in (("o", "a_occ"), ("f", "a_free"))])


def refold_beta(sources: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """The consensus of all sources' occupancy, at the given cells or everywhere.

    Sources at the prior are left out; a cell with one other source has its values
    as they are, more add up less one prior each. It is a sum: no order, no list."""
    s = sources.where(~is_prior_beta())
    if cells is not None:
        s = s.join(cells.select(*KEY).distinct(), KEY, "left_semi")
    g = s.groupBy(*KEY).agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("a_occ", "a_free") for f in (F.sum, F.max)])
    value = lambda c: F.when(F.col("n") == 1, F.col(f"max_{c}")).otherwise(F.greatest(lit(1.0), F.col(f"sum_{c}") - (F.col("n") - 1)))
    return g.select(*KEY, value("a_occ").alias("a_occ"), value("a_free").alias("a_free"), F.col("n").alias("n_sources"))


def refold_dir(sources: DataFrame, prior_other: float, cells: DataFrame | None = None, alpha: float = ALPHA) -> DataFrame:
    """The consensus of all sources' classes, folded in ascending order of the
    sources (there are few of them at a cell), as merging cuts to K slots each time."""
    s = sources.where(~is_prior_dir("other", [f"cls{k}" for k in range(K_TOP)], prior_other))
    if cells is not None:
        s = s.join(cells.select(*KEY).distinct(), KEY, "left_semi")
    listed = s.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("source", *SLOTS))).alias("l"))
    first = F.get("l", lit(0))
    init = F.struct(*[first[c].alias(c) for c in SLOTS])
    fold = F.aggregate(F.slice("l", 2, 1 << 20), init, lambda acc, e: merge_slots(acc, e, prior_other, alpha))
    return listed.select(*KEY, fold.alias("d")).select(*KEY, *[F.col(f"d.{c}").alias(c) for c in SLOTS])


def merge_dir(a: DataFrame, b: DataFrame, prior_other: float, alpha: float = ALPHA) -> DataFrame:
    """Full outer merge of two class tables; a missing cell is the prior."""
    x, y = (t.select(*KEY, F.struct(*SLOTS).alias(f"d{n}")) for t, n in ((a, 0), (b, 1)))
    empty = F.struct(lit(float(prior_other)).alias("other"), *[v for k in range(K_TOP) for v in (lit(EMPTY).alias(f"cls{k}"), lit(float(alpha)).alias(f"cnt{k}"))])
    m = x.join(y, KEY, "full_outer").withColumn("m", merge_slots(F.coalesce("d0", empty), F.coalesce("d1", empty), prior_other, alpha))
    return m.select(*KEY, *[F.col(f"m.{c}").alias(c) for c in SLOTS])


def merge_tsdf(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select(*KEY, "tsdf_d", "tsdf_w").unionByName(b.select(*KEY, "tsdf_d", "tsdf_w")).where("tsdf_w > 0")
    return both.groupBy(*KEY).agg((F.sum(F.col("tsdf_d") * F.col("tsdf_w")) / F.sum("tsdf_w")).alias("tsdf_d"), F.sum("tsdf_w").alias("tsdf_w"))


def check_frames(a: dict, b: dict) -> None:
    """Raises ValueError unless two frames (resolution, num_classes, alpha) can be merged."""
    if a["num_classes"] != b["num_classes"]:
        raise ValueError("class counts differ")
    if a["num_classes"] < K_TOP:
        raise ValueError("fewer classes than slots")
    for f in (a, b):
        if not 0 < f["alpha"] < float("inf"):
            raise ValueError("alpha is not a positive number")
    if abs(a["alpha"] - b["alpha"]) > 1e-7:
        raise ValueError("alphas differ")
    if a["resolution"] and b["resolution"] and abs(a["resolution"] - b["resolution"]) > 1e-6:
        raise ValueError("resolutions differ")


def merge_frames(a: dict, b: dict, prior_other: float) -> dict:
    """Two frames in one: dictionaries of resolution, num_classes and alpha, and the tables
    beta, dir and tsdf (any may be missing). They are checked first, and the
    resolution is the one that is given. A table that one of them lacks is the other's."""
    check_frames(a, b)
    merge = {"beta": merge_beta, "dir": lambda x, y: merge_dir(x, y, prior_other, a["alpha"]), "tsdf": merge_tsdf}
    out = {"resolution": a["resolution"] or b["resolution"], "num_classes": a["num_classes"], "alpha": a["alpha"]}
    for name, f in merge.items():
        x, y = a.get(name), b.get(name)
        out[name] = f(x, y) if x is not None and y is not None else x if y is None else y
    return out


def reproject(deltas: DataFrame, res: float, t: list[float], q: list[float], order: list[str]) -> DataFrame:
    """Cells of a source moved by a pose into the map's lattice, centre to centre; of
    several in one target cell the last by `order` stays."""
    moved = transform([centre(f"i{a}", res) for a in "xyz"], t, q)
    d = deltas.withColumns({f"t{a}": cell(m, res) for a, m in zip("xyz", moved)})
    rest = [c for c in deltas.columns if c not in KEY]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("l")
    return d.groupBy(*[F.col(f"t{a}").alias(f"i{a}") for a in "xyz"]).agg(last).select(*KEY, "l.*")


def latest(deltas: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The last row of each source and cell: what a snapshot-replacing stream leaves."""
    by = by or ["source", *KEY]
    rest = [c for c in deltas.columns if c not in by]
    return deltas.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("l")).select(*by, "l.*")


def first_pose(deltas: DataFrame, pose: list[str], order: str) -> DataFrame:
    """The pose of each source's first message."""
    return deltas.groupBy("source").agg(F.min_by(F.struct(*pose), order).alias("p")).select("source", "p.*")


def pinned_prior(frames: DataFrame) -> DataFrame:
    """frames (source, msg_seq, num_classes, alpha) with accepted: those of the first
    frame's class count and alpha (to 1e-6). The first frame has the smallest msg_seq, then source."""
    first = frames.agg(F.min_by(F.struct("num_classes", "alpha"), F.struct("msg_seq", "source")).alias("p")).first()["p"]
    if first is None:
        return frames.withColumn("accepted", lit(True))
    return frames.withColumn("accepted", (F.col("num_classes") == first["num_classes"]) & (F.abs(F.col("alpha") - first["alpha"]) <= 1e-6))
