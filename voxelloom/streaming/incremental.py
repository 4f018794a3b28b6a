"""Maps kept up to date by micro-batches.

State lives in Parquet tables, one folder for each batch number, so a batch that
is run again after a failure writes the same folder again. Large state is kept as
what each batch changed and, now and then, a snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import centre, is_prior_beta
from ..operators.consensus import latest, refold_beta
from ..operators.rays import KEY
from ..params import EMPTY, K_TOP, MapParams
from ..sources import wire
from .gates import beta_changed


class Table:
    """A state table of versions. A reader takes the newest version below its batch.
    Writing a version deletes those that no batch can ask for again: all but the
    newest `kept` of them."""

    kept = 3

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _versions(self, kind: str = "v=") -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[2:]) for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith(kind) and fs.exists(mark(s.getPath(), "_SUCCESS")))

    def read(self, below: int | None = None) -> DataFrame:
        v = [x for x in self._versions() if below is None or x < below]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={v[-1]}") if v else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch}")
        for v in [x for x in self._versions() if x < batch][: -self.kept]:
            self._delete(f"v={v}")

    def _delete(self, folder: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


class Keyed(Table):
    """A state table of which a batch writes the rows that it changed alone. A reader takes
    of each key the last row below its batch, from the last snapshot on; rows whose
    column `alive` is null are gone. A snapshot is taken after so many batches, and what
    is older than the one before it is deleted."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], alive: str, every: int = 8):
        super().__init__(spark, path, schema)
        self.key, self.alive, self.every = key, alive, every

    def read(self, below: int | None = None) -> DataFrame:
        old = lambda kind: [x for x in self._versions(kind) if below is None or x < below]
        base = max(old("s="), default=-1)
        deltas = [x for x in old("v=") if x > base]
        folders = [(f"s={base}", -1)] * (base >= 0) + [(f"v={x}", x) for x in deltas]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{f}").withColumn("_v", F.lit(x)) for f, x in folders]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        names = [c for c in out.columns if c != "_v"]
        if deltas:
            out = out.groupBy(*self.key).agg(F.max_by(F.struct(*[c for c in names if c not in self.key]), "_v").alias("_r")).select(*self.key, "_r.*")
        return out.where(F.col(self.alive).isNotNull()).select(*names)

    def put(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch}")
        base = max((x for x in self._versions("s=") if x < batch), default=-1)
        if len([x for x in self._versions() if base < x <= batch]) > self.every:
            self.read(below=batch + 1).write.mode("overwrite").parquet(f"{self.path}/s={batch}")
            for kind in ("v=", "s="):
                for x in self._versions(kind):
                    if x < base or (kind == "v=" and x == base):
                        self._delete(f"{kind}{x}")


class OccupancyStream:
    """Adds the hits of each micro-batch to a map, and lists the cells it touched."""

    def __init__(self, spark: SparkSession, path: str, params: MapParams):
        self.params = params
        self.beta = Keyed(spark, f"{path}/beta", "ix int, iy int, iz int, a_occ double, a_free double", KEY, "a_occ")
        self.touched = Table(spark, f"{path}/touched", "ix int, iy int, iz int")

    def __call__(self, batch: DataFrame, number: int) -> None:
        new = batch.groupBy(*KEY).agg(F.sum(F.lit(self.params.w_occ) * F.col("quality")).alias("occ"), F.sum("free").alias("free"))
        self.touched.write(new.select(*KEY), number)
        m = new.join(self.beta.read(below=number), KEY, "left")
        value = lambda c, n: (F.coalesce(F.col(c), F.lit(1.0)) + F.coalesce(F.col(n), F.lit(0.0))).alias(c)
        self.beta.put(m.select(*KEY, value("a_occ", "occ"), value("a_free", "free")), number)


class FusedView:
    """Consensus of several sources: of each micro-batch of deltas (source, msg_seq,
    pos, cell, a_occ, a_free) the last value replaces the source's, and only touched
    cells are folded again. Delivering a batch twice changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        row = "ix int, iy int, iz int, a_occ double, a_free double"
        self.sources = Keyed(spark, f"{path}/sources", f"source int, {row}", ["source", *KEY], "a_occ")
        self.fused = Keyed(spark, f"{path}/fused", f"{row}, n_sources long", KEY, "a_occ")

    def __call__(self, batch: DataFrame, number: int) -> None:
        new = latest(batch, ["msg_seq", "pos"]).select("source", *KEY, "a_occ", "a_free")
        self.sources.put(new, number)
        cells = new.select(*KEY).distinct()
        again = refold_beta(self.sources.read(below=number + 1), cells)
        self.fused.put(cells.join(again, KEY, "left"), number)  # cells without evidence are gone


class DeltaPublisher:
    """Sends the touched cells of a map on: cells at the prior or outside a height
    band are left out, and so are those that differ little from what was sent last.
    A snapshot sends all and counts as sent; without a consumer nothing is sent, and
    what was touched meanwhile comes with the next snapshot."""

    def __init__(self, spark: SparkSession, path: str, params: MapParams, band: tuple[float, float] | None = None):
        row = "ix int, iy int, iz int, a_occ double, a_free double"
        self.params, self.band = params, band if band and band[0] < band[1] else None
        self.sent, self.deltas = Keyed(spark, f"{path}/sent", row, KEY, "a_occ"), Table(spark, f"{path}/deltas", row)

    def __call__(self, states: DataFrame, number: int, snapshot: bool = False, consumer: bool = True) -> None:
        if not consumer:
            return
        now = states.select(*KEY, "a_occ", "a_free").where(~is_prior_beta())
        if self.band:
            now = now.where(centre("iz", self.params.resolution).between(*self.band))
        last = self.sent.read(below=number)
        before = last.select(*KEY, F.col("a_occ").alias("o"), F.col("a_free").alias("f"))
        changed = F.col("o").isNull() | beta_changed(F.col("o"), F.col("f"), F.col("a_occ"), F.col("a_free")) | F.lit(snapshot)
        self.deltas.write(now.join(before, KEY, "left").where(changed).select(*KEY, "a_occ", "a_free"), number)
        self.sent.put(self.deltas.read(below=number + 1), number)


def published(publisher: DeltaPublisher, source: str, number: int) -> DataFrame:
    """(source, msg_seq, data): the message of what a publisher sent in a batch; none if it sent nothing."""
    p = publisher.params
    sent = publisher.deltas.spark.read.schema(publisher.deltas.schema).parquet(f"{publisher.deltas.path}/v={number}").withColumn("source", F.lit(source))
    none = sent.where("false").select("source", *KEY, F.lit(0.0).alias("other"), *[v for k in range(K_TOP) for v in (F.lit(EMPTY).alias(f"cls{k}"), F.lit(0.0).alias(f"cnt{k}"))])
    return wire.encode_frames(wire.frames_of(sent, none, ["source"], F.lit(number).cast("long"), p.resolution, p.num_classes, p.alpha))


class TransientStream:
    """Cells of things that move: each batch is a frame; what is there fades towards the
    prior first and is forgotten close to it, then the frame's hits are added."""

    def __init__(self, spark: SparkSession, path: str, params: MapParams, eps: float = 1e-3):
        self.params, self.eps = params, eps
        self.beta = Table(spark, f"{path}/transient", "ix int, iy int, iz int, a_occ double, a_free double")

    def __call__(self, hits: DataFrame, number: int) -> None:
        fade = lambda c: (1 + (F.col(c) - 1) * self.params.decay).alias(c)
        old = self.beta.read(below=number).select(*KEY, fade("a_occ"), fade("a_free"))
        old = old.where((F.abs(F.col("a_occ") - 1) >= self.eps) | (F.abs(F.col("a_free") - 1) >= self.eps))
        new = hits.groupBy(*KEY).agg(F.sum(F.lit(self.params.w_occ) * F.col("quality")).alias("occ"))
        m = old.join(new, KEY, "full_outer")
        self.beta.write(m.select(*KEY, (F.coalesce("a_occ", F.lit(1.0)) + F.coalesce("occ", F.lit(0.0))).alias("a_occ"), F.coalesce("a_free", F.lit(1.0)).alias("a_free")), number)


class Latched:
    """The last snapshot that was published, for whoever comes later. A snapshot is taken
    only if the map has changed since the last one and someone listens; until then it
    stays due."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.table, self.dirty = Table(spark, path, schema), False
        self.table.kept = 1

    def changed(self) -> None:
        self.dirty = True

    def publish(self, snapshot: DataFrame, number: int, listeners: int = 1) -> bool:
        if not listeners or not self.dirty:
            return False
        self.table.write(snapshot, number)
        self.dirty = False
        return True

    def read(self) -> DataFrame:
        return self.table.read()


def bounded(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of the folder's files that takes so many at most for each batch: what comes
    faster waits in the folder, and not in memory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def coalesced_sink(stream: DataFrame, sink, rate_hz: float, checkpoint: str):
    """Starts sink(batch, number) at most `rate_hz` times a second with what has come since
    (at once for all that is there if the rate is 0)."""
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{round(1000 / rate_hz)} milliseconds") if rate_hz > 0 else w.trigger(availableNow=True)).start()


def joined_in_time(scans: DataFrame, poses: DataFrame, wait: str) -> DataFrame:
    """A stream of scans (ts, ..) with the pose of their time (streams with timestamps
    ts): a scan waits for its pose; one that has not come within the delay `wait`
    leaves it null, and rows that are later than that are dropped."""
    s = scans.withWatermark("ts", wait)
    p = poses.withColumnRenamed("ts", "pose_ts").withWatermark("pose_ts", wait)
    return s.join(p, (F.col("ts") == F.col("pose_ts")), "left_outer")
