"""Binary delta frames and soft-label files.

A payload is a big-endian length and a raw LZ4 block. The frame inside is
little-endian: magic, version, resolution, classes, slots, alpha (16 bytes), then
three counted arrays of records: surface and occupancy (3 ints, 2 floats) and
classes (3 ints, OTHER, K counts, K class numbers).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import K_TOP

#: Fixed values of the format.
MAGIC, VERSION, ENVELOPE, MAX_BYTES = 0x53435658, 5, 5, 256 << 20
HEADER = np.dtype([("magic", "<u4"), ("version", "u1"), ("res", "<f4"), ("classes", "<u2"), ("slots", "u1"), ("alpha", "<f4")])
PAIR = np.dtype([("k", "<i4", 3), ("v", "<f4", 2)])
DIR = np.dtype([("k", "<i4", 3), ("other", "<f4"), ("cnt", "<f4", K_TOP), ("cls", "<u2", K_TOP)])

_PAIRS = "array<struct<ix:int,iy:int,iz:int,a:float,b:float>>"
_DIRS = "array<struct<ix:int,iy:int,iz:int,other:float,cls:array<int>,cnt:array<float>>>"
FRAME = f"resolution float, num_classes int, alpha float, tsdf {_PAIRS}, beta {_PAIRS}, dir {_DIRS}"


def encode_frame(res: float, classes: int, alpha: float, tsdf: list, beta: list, dirs: list, share_tsdf: bool = True) -> bytes:
    head = np.array([(MAGIC, VERSION, res, classes, K_TOP, alpha)], HEADER)
    out = [head.tobytes()]
    for rows in (tsdf if share_tsdf else [], beta):
        a = np.zeros(len(rows), PAIR)
        if rows:
            a["k"] = [(r["ix"], r["iy"], r["iz"]) for r in rows]
            a["v"] = [(r["a"], r["b"]) for r in rows]
        out += [np.uint32(len(rows)).tobytes(), a.tobytes()]
    d = np.zeros(len(dirs), DIR)
    if dirs:
        d["k"] = [(r["ix"], r["iy"], r["iz"]) for r in dirs]
        d["other"], d["cnt"], d["cls"] = [r["other"] for r in dirs], [r["cnt"] for r in dirs], [r["cls"] for r in dirs]
    return b"".join([*out, np.uint32(len(dirs)).tobytes(), d.tobytes()])


def decode_frame(raw: bytes) -> dict:
    """The frame of some bytes; ValueError tells what is wrong with them."""
    if len(raw) < HEADER.itemsize:
        raise ValueError("truncated header")
    h = np.frombuffer(raw, HEADER, 1)[0]
    if h["magic"] != MAGIC:
        raise ValueError("wrong magic")
    if h["version"] != VERSION:
        raise ValueError("wrong version")
    if h["slots"] != K_TOP:
        raise ValueError("wrong number of slots")
    if not K_TOP <= h["classes"] <= 4096:
        raise ValueError("class count out of range")
    if not (np.isfinite(h["alpha"]) and h["alpha"] > 0 and np.isfinite(h["res"]) and h["res"] > 0):
        raise ValueError("alpha or resolution not positive")
    at, parts = HEADER.itemsize, []
    for kind in (PAIR, PAIR, DIR):
        if len(raw) < at + 4:
            raise ValueError("truncated count")
        n = int(np.frombuffer(raw, "<u4", 1, at)[0])
        at += 4
        if n * kind.itemsize > len(raw) - at:
            raise ValueError("count exceeds the bytes left")
        parts.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    pairs = lambda a: [{"ix": int(k[0]), "iy": int(k[1]), "iz": int(k[2]), "a": float(v[0]), "b": float(v[1])} for k, v in a]
    dirs = [{"ix": int(r["k"][0]), "iy": int(r["k"][1]), "iz": int(r["k"][2]), "other": float(r["other"]), "cls": r["cls"].astype(int).tolist(), "cnt": r["cnt"].astype(float).tolist()} for r in parts[2]]
    return {"resolution": float(h["res"]), "num_classes": int(h["classes"]), "alpha": float(h["alpha"]), "tsdf": pairs(parts[0]), "beta": pairs(parts[1]), "dir": dirs}


def compress(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "big") + pa.compress(raw, codec="lz4_raw", asbytes=True)


def decompress(data: bytes) -> bytes:
    if len(data) < 4:
        raise ValueError("no length")
    n = int.from_bytes(data[:4], "big")
    if not 0 < n <= MAX_BYTES:
        raise ValueError("length out of range")
    try:
        return pa.decompress(data[4:], decompressed_size=n, codec="lz4_raw", asbytes=True)
    except (pa.ArrowException, OSError) as e:
        raise ValueError("not an LZ4 block") from e


def frames_of(beta: DataFrame, classes: DataFrame, by: list[str], msg_seq: Column, resolution: float, num_classes: int, alpha: float) -> DataFrame:
    """One frame for each group `by` of tables with cells: its occupancy and class states,
    in order of the cells; a group without classes has none."""
    key = ["ix", "iy", "iz"]
    pair = F.struct(*key, F.col("a_occ").cast("float").alias("a"), F.col("a_free").cast("float").alias("b"))
    b = beta.groupBy(*by).agg(F.array_sort(F.collect_list(pair)).alias("beta"))
    d = F.struct(*key, F.col("other").cast("float").alias("other"), F.array(*[f"cls{k}" for k in range(K_TOP)]).alias("cls"), F.array(*[F.col(f"cnt{k}").cast("float") for k in range(K_TOP)]).alias("cnt"))
    c = classes.groupBy(*by).agg(F.array_sort(F.collect_list(d)).alias("dir"))
    none = lambda kind: F.array().cast(kind)
    fixed = [F.lit(resolution).cast("float").alias("resolution"), F.lit(num_classes).alias("num_classes"), F.lit(alpha).cast("float").alias("alpha"), none(_PAIRS).alias("tsdf")]
    return b.join(c, by, "left").select(*by, msg_seq.alias("msg_seq"), *fixed, "beta", F.coalesce("dir", none(_DIRS)).alias("dir"))


def encode_frames(frames: DataFrame, share_tsdf: bool = True) -> DataFrame:
    """(source, msg_seq, data) of frames (source, msg_seq and the columns of FRAME)."""

    def work(it):
        for batch in it:
            rows = batch.to_pylist()
            data = [compress(encode_frame(r["resolution"], r["num_classes"], r["alpha"], r["tsdf"] or [], r["beta"] or [], r["dir"] or [], share_tsdf)) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("msg_seq"), pa.array(data, pa.binary())], ["source", "msg_seq", "data"])

    f = frames.select("source", "msg_seq", "resolution", "num_classes", "alpha", "tsdf", "beta", "dir")
    kinds = {n: f.schema[n].dataType.simpleString() for n in ("source", "msg_seq")}
    return f.mapInArrow(work, f"source {kinds['source']}, msg_seq {kinds['msg_seq']}, data binary")


def decode_frames(messages: DataFrame) -> DataFrame:
    """Frames of messages (source, msg_seq, data), with the reason in `error` where one can't be read."""
    kinds = {n: messages.schema[n].dataType.simpleString() for n in ("source", "msg_seq")}
    empty = spark_schema = f"source {kinds['source']}, msg_seq {kinds['msg_seq']}, error string, {FRAME}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(empty))

    def work(it):
        for batch in it:
            rows = []
            for r in batch.to_pylist():
                try:
                    got = decode_frame(decompress(r["data"] or b"")) | {"error": None}
                except ValueError as e:
                    got = {"error": str(e), "resolution": None, "num_classes": None, "alpha": None, "tsdf": None, "beta": None, "dir": None}
                rows.append({"source": r["source"], "msg_seq": r["msg_seq"]} | got)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return messages.select("source", "msg_seq", "data").mapInArrow(work, spark_schema)


def accepted(envelopes: DataFrame) -> DataFrame:
    """Envelopes (version, little_endian, data, num_classes) that can be decoded."""
    return envelopes.where((F.col("version") == ENVELOPE) & F.col("little_endian") & (F.length("data") > 0) & (F.col("num_classes") != 0))


def decode_topk(files: DataFrame, image: bool, max_classes: int, cap: int = 1 << 30) -> DataFrame:
    """(frame_id, row, probs) of soft-label files (frame_id, content): points are a
    count, the classes and a byte for each; images have height and width. Class 0 is
    no class, and rows without mass are no observation; files that are too short or
    too large give nothing."""

    def work(it):
        for batch in it:
            out: tuple[list, ...] = ([], [], [])
            for frame, raw in zip(batch.column("frame_id").to_pylist(), batch.column("content").to_pylist()):
                raw, head = raw or b"", 5
                if len(raw) < head:
                    continue
                n = int.from_bytes(raw[:2], "little") * int.from_bytes(raw[2:4], "little") if image else int.from_bytes(raw[:4], "little")
                c = raw[4]
                if not c or n * c > cap or len(raw) < head + n * c:
                    continue
                q = np.frombuffer(raw, np.uint8, n * c, head).reshape(n, c)[:, : min(c, max_classes)] / 255.0
                q[:, 0] = 0
                for row in np.flatnonzero(q.any(1)):
                    out[0].append(frame)
                    out[1].append(int(row))
                    out[2].append(q[row].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("frame_id").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.float64()))], ["frame_id", "row", "probs"])

    return files.select("frame_id", "content").mapInArrow(work, f"frame_id {files.schema['frame_id'].dataType.simpleString()}, row long, probs array<double>")


def ply_lines(triangles: DataFrame) -> DataFrame:
    """(part, n, line): an ASCII PLY of triangles (x0 .. z2), each with vertices of its own."""
    spark = triangles.sparkSession
    n = triangles.count()
    head = ["ply", "format ascii 1.0", f"element vertex {3 * n}", "property float x", "property float y", "property float z", f"element face {n}", "property list uchar int vertex_indices", "end_header"]
    h = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)], "part int, n long, line string")
    t = _numbered(triangles).select("r", *[c for c in triangles.columns if c[-1] in "012"])
    v = t.select(F.col("r"), F.posexplode(F.array(*[F.concat_ws(" ", *[F.round(f"{a}{i}", 6).cast("string") for a in "xyz"]) for i in range(3)]))).select(F.lit(1).alias("part"), (F.col("r") * 3 + F.col("pos")).alias("n"), F.col("col").alias("line"))
    f = t.select(F.lit(2).alias("part"), F.col("r").alias("n"), F.concat_ws(" ", F.lit("3"), *[((F.col("r") - 1) * 3 + i).cast("string") for i in range(3)]).alias("line"))
    return h.union(v).union(f)


def _numbered(t: DataFrame) -> DataFrame:
    """Triangles with r, their number from 1 in the order of ix, iy, iz and tri: counted
    by ix first, so that a single task sees a row for each ix alone."""
    from pyspark.sql import Window

    before = Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    slabs = t.groupBy("ix").count().select("ix", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("ix").orderBy("iy", "iz", "tri"))
    return t.withColumn("own", own).join(slabs, "ix").withColumn("r", (F.col("first") + F.col("own")).cast("long")).drop("own", "first")
