"""Point clouds, diagnostics and made rays as DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import lit

#: Names under which a cloud may hold a field.
FIELDS = {"x": ("x",), "y": ("y",), "z": ("z",), "label": ("semantic_label", "label"), "t": ("t", "time", "time_stamp", "timestamp")}


def cloud_columns(df: DataFrame) -> DataFrame:
    """x, y, z and, where the cloud has them, label and t; x, y and z must be there."""
    names, out = {c.lower(): c for c in df.columns}, []
    for field, known in FIELDS.items():
        found = next((names[k] for k in known if k in names), None)
        if found is None and field in "xyz":
            raise ValueError(f"the cloud has no {field}")
        out.append((F.col(found) if found else lit(None)).alias(field))
    return df.select(*[c for c in df.columns if c in ("frame_id", "source", "seq")], *out)


def valid_clouds(df: DataFrame) -> DataFrame:
    """Messages (width, height, point_step, field_end, data) whose buffer holds what they say."""
    return df.where((F.col("point_step") > 0) & (F.col("field_end") <= F.col("point_step")) & (F.length("data") >= F.col("width").cast("long") * F.col("height") * F.col("point_step")))


def finite_in_range(points: DataFrame, lo: float, hi: float) -> DataFrame:
    """Points with finite coordinates between two distances, both included; squares are compared."""
    ok = lit(True)
    for a in "xyz":
        ok = ok & ~F.isnan(a) & (F.abs(a) < math.inf)
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    return points.where(ok & (r2 >= lo * lo) & (r2 <= hi * hi))


def diagnostics(status: DataFrame) -> DataFrame:
    """(source, ts, gap, rejected) of status rows with an array of struct(key, value);
    values that are no numbers are null."""
    value = lambda k: F.get(F.transform(F.filter("values", lambda v: v["key"] == k), lambda v: v["value"]), lit(0))
    return status.select("source", "ts", value("accepted_gap_sec").try_cast("double").alias("gap"), value("consecutive_rejected_updates").try_cast("int").alias("rejected"))


def ray_fan(spark: SparkSession, n: int, length: float = 5.0, miss: float = 0.05, seed: int = 42) -> DataFrame:
    """Made rays from the origin over a half sphere; some return nothing."""
    r = spark.range(n).select(F.col("id").alias("seq"), F.rand(seed).alias("a"), F.rand(seed + 1).alias("b"), F.rand(seed + 2).alias("c"))
    az, el = F.col("a") * 2 * math.pi, F.asin(F.col("b"))
    end = {"ex": F.cos(el) * F.cos(az), "ey": F.cos(el) * F.sin(az), "ez": F.sin(el)}
    kind = F.when(F.col("c") < miss, "miss").otherwise("hit")
    return r.select("seq", (F.col("seq") / 1000).cast("int").alias("frame_id"), *[lit(0.0).alias(f"o{a}") for a in "xyz"], *[(v * length).alias(k) for k, v in end.items()], lit(1.0).alias("quality"), lit(False).alias("is_dynamic"), kind.alias("kind"), (F.col("seq") % 10).cast("int").alias("cls"))


def delta_topics(topics: list[str], first: str = "/robot1/map_delta", second: str = "/robot2/map_delta") -> list[str]:
    """The topics that deltas come from, each once, in order, without empty names; if none is given, the pair."""
    out = list(dict.fromkeys(t for t in (topics or [first, second]) if t))
    if not out:
        raise ValueError("no topics of deltas")
    return out


def deltas(sources: dict[str, DataFrame], topics: list[str]) -> DataFrame:
    """The rows of all topics, with their topic as `source`."""
    out = None
    for t in delta_topics(topics):
        one = sources[t].withColumn("source", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out
