"""Order-sensitive gates over frames: change gate, pose gate, status gate, rates and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import lit
from ..operators.ingest import as_of

P_STEP, GROWTH = 0.02, 0.10


def beta_changed(last_occ, last_free, occ, free) -> Column:
    """Has the occupancy moved by more than P_STEP, or the evidence grown by more than a tenth?"""
    s0, s1 = last_occ + last_free, occ + free
    return (F.abs(occ / s1 - last_occ / s0) > P_STEP) | (s1 - s0 > GROWTH * s0)


def dir_changed(last_cls: list[Column], cls: list[Column], last_mass: Column, mass: Column) -> Column:
    """Does any slot hold another class, or has the evidence grown by more than a tenth?"""
    differs = lit(False)
    for a, b in zip(last_cls, cls):
        differs = differs | (a != b)
    return differs | (mass - last_mass > GROWTH * last_mass)


#: Rows of a part of what a fold gives out.
PART = 256


def grown(s: Column, row: Column) -> list[Column]:
    """The fields part and parts of a fold's state with one more row. Parts are of PART rows, so a
    step copies that many at most, and not all rows given out before."""
    full = F.size(s["part"]) >= PART
    return [F.when(full, F.array(row)).otherwise(F.concat(s["part"], F.array(row))).alias("part"), F.when(full, F.concat(s["parts"], F.array(s["part"]))).otherwise(s["parts"]).alias("parts")]


def nothing(row: str) -> list[Column]:
    """The fields part and parts at the start of a fold that gives out rows of a type."""
    return [F.array().cast(f"array<{row}>").alias("part"), F.array().cast(f"array<array<{row}>>").alias("parts")]


def given(s: Column) -> Column:
    """All rows that a fold has given out."""
    return F.concat(F.flatten(s["parts"]), s["part"])


def change_gate(states: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, order, a_occ, a_free, emit): successive states of each cell; the first is
    emitted, later ones when they differ enough from the last emitted one."""
    events = F.array_sort(F.collect_list(F.struct(order, "a_occ", "a_free")))
    kind = f"struct<{order}:{states.schema[order].dataType.simpleString()},a_occ:double,a_free:double,emit:boolean>"
    init = F.struct(lit(False).alias("any"), lit(1.0).alias("occ"), lit(1.0).alias("free"), *nothing(kind))

    def step(s, e):
        emit = ~s["any"] | beta_changed(s["occ"], s["free"], e["a_occ"], e["a_free"])
        row = F.struct(e[order].alias(order), e["a_occ"].alias("a_occ"), e["a_free"].alias("a_free"), emit.alias("emit"))
        keep = lambda new, old: F.when(emit, e[new]).otherwise(s[old])
        return F.struct(lit(True).alias("any"), keep("a_occ", "occ").alias("occ"), keep("a_free", "free").alias("free"), *grown(s, row))

    g = states.groupBy(*by).agg(events.alias("ev")).select(*by, F.aggregate("ev", init, step, given).alias("out"))
    return g.select(*by, F.explode("out").alias("o")).select(*by, "o.*")


def pose_gate(poses: DataFrame, by: list[str], startup: float = 0.5, runtime: float = 1.0, hold: float = 2.0) -> DataFrame:
    """(by, t, jump, stable): frames pass once the pose has stayed for `hold` seconds
    without a jump above the threshold (the startup one until first stable, then the
    runtime one), and until a jump above the runtime threshold."""
    w = Window.partitionBy(*by).orderBy("t")
    d2 = sum(((F.col(f"t{a}") - F.lag(f"t{a}").over(w)) * (F.col(f"t{a}") - F.lag(f"t{a}").over(w)) for a in "yz"), (F.col("tx") - F.lag("tx").over(w)) * (F.col("tx") - F.lag("tx").over(w)))
    j = poses.select(*by, "t", F.sqrt(d2).alias("jump"))
    init = F.struct(lit(False).alias("stable"), lit(False).alias("initial"), lit(0.0).alias("since"), *nothing("struct<t:double,jump:double,stable:boolean>"))

    def step(s, e):
        lost = s["stable"] & F.coalesce(e["jump"] > runtime, lit(False))
        stable, since = s["stable"] & ~lost, F.when(lost, e["t"]).otherwise(s["since"])
        limit = F.when(s["initial"], runtime).otherwise(startup)
        again = ~stable & (e["jump"].isNull() | (e["jump"] > limit))
        since = F.when(again, e["t"]).otherwise(since)
        now = stable | (~again & (e["t"] - since >= hold))
        row = F.struct(e["t"].alias("t"), e["jump"].alias("jump"), now.alias("stable"))
        return F.struct(now.alias("stable"), (s["initial"] | now).alias("initial"), since.alias("since"), *grown(s, row))

    g = j.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", "jump"))).alias("ev"))
    return g.select(*by, F.explode(F.aggregate("ev", init, step, given)).alias("o")).select(*by, "o.*")


def rejects(gap: Column, rejected: Column, max_gap: float = 0.5, max_rejected: int = 3) -> Column:
    """Does the localiser's last status forbid frames? Unknown values allow."""
    return F.coalesce((~F.isnan(gap)) & (gap >= max_gap), lit(False)) | F.coalesce(rejected >= max_rejected, lit(False))


def admitted(poses: DataFrame, by: list[str], status: DataFrame, bucket: float, **gate) -> DataFrame:
    """(by, t, stable, rejected, admitted): frames that the pose gate lets pass and that the
    localiser's last status before them (t, gap, rejected) doesn't forbid."""
    frames = pose_gate(poses, by, **gate).select(*by, "t", "stable")
    known = as_of(frames, status.select("t", "gap", F.col("rejected").alias("n_rejected")), "t", [], ["gap", "n_rejected"], bucket=bucket)
    out = known.withColumn("rejected", rejects(F.col("gap"), F.col("n_rejected")))
    return out.select(*by, "t", "stable", "rejected", (F.col("stable") & ~F.col("rejected")).alias("admitted"))


def rate_limited(ticks: DataFrame, by: list[str], interval: float) -> DataFrame:
    """(by, t): of each group's ticks those that are sent: the first, and each one at least
    `interval` after the last sent. Frames that come while one is worked on for that
    long are dropped in the same way."""
    init = F.struct(lit(None).cast("double").alias("last"), *nothing("double"))

    def step(s, t):
        send = s["last"].isNull() | (t - s["last"] >= interval)
        part, parts = grown(s, t)
        return F.struct(F.when(send, t).otherwise(s["last"]).alias("last"), F.when(send, part).otherwise(s["part"]).alias("part"), F.when(send, parts).otherwise(s["parts"]).alias("parts"))

    g = ticks.groupBy(*by).agg(F.array_sort(F.collect_list(F.col("t").cast("double"))).alias("all"))
    return g.select(*by, F.explode(F.aggregate("all", init, step, given)).alias("t"))


def coalesced(states: DataFrame, by: list[str], order: str, every: int) -> DataFrame:
    """(tick, by, ..): what a timer sends that fires each `every` frames: the last state of
    each cell that was touched since. Nothing is lost, as states are absolute."""
    rest = [c for c in states.columns if c not in by]
    tick = F.floor(F.col(order) / every).alias("tick")
    return states.groupBy(tick, *by).agg(F.max_by(F.struct(*rest), order).alias("l")).select("tick", *by, "l.*")


def keep_last(rows: DataFrame, by: list[str], order: list[str], depth: int) -> DataFrame:
    """What a queue of a depth holds at the end: the last rows of each group."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= depth).drop("_n")


def placed(frames: DataFrame, poses: DataFrame, timeout: float, exact: bool, bucket: float) -> DataFrame:
    """Frames (t) with the pose of their time, if it arrives (column arrival) at most
    `timeout` after; else, unless exact, with the last pose before them that had
    arrived by then (stale); else they are dropped."""
    own = frames.join(poses.where(F.col("arrival") <= F.col("t") + timeout).select("t", F.col("pose").alias("own")), "t", "left")
    if exact:
        return own.where("own IS NOT NULL").select(*frames.columns, F.col("own").alias("pose"), lit(False).alias("stale"))
    # A pose is known from its arrival on; the one of the latest time among those is the last.
    known = poses.select(F.greatest("arrival", F.col("t") + timeout).alias("t"), F.struct(F.col("t").alias("at"), "pose").alias("p"))
    known = known.groupBy("t").agg(F.max("p").alias("p"))
    asked = own.withColumn("_t", F.col("t")).withColumn("t", F.col("t") + timeout)
    out = as_of(asked, known, "t", [], ["p"], bucket=bucket).withColumn("t", F.col("_t"))
    pose = F.coalesce("own", "p.pose")
    return out.select(*frames.columns, pose.alias("pose"), F.col("own").isNull().alias("stale")).where("pose IS NOT NULL")
