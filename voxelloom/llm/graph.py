"""Connected components, and a fixed-size row filter, on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node of its component.

    Each node hooks to its smallest smaller neighbour, pointers double until
    they are flat, edges are rewritten to roots, and so on until none is left.
    Every step is a join or an aggregation; tables are written between steps.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    labels = materialize(e.select(F.col("u").alias("node")).union(e.select("v")).distinct().select("node", F.col("node").alias("root")), "labels")
    while e.limit(1).count():
        p = materialize(e.groupBy("u").agg(F.min("v").alias("p")), "parents")
        while True:
            q = p.select(F.col("u").alias("p"), F.col("p").alias("up"))
            jumped = materialize(p.join(q, "p", "left").select("u", F.coalesce("up", "p").alias("p"), F.col("up").isNotNull().alias("moved")), "parents")
            discard(p)
            p = jumped.select("u", "p")
            p._voxelloom_path = jumped._voxelloom_path
            if not jumped.where("moved").limit(1).count():
                break
        new = materialize(labels.join(p.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        discard(labels)
        labels = new
        pu, pv = p.select("u", F.col("p").alias("ru")), p.select(F.col("u").alias("v"), F.col("p").alias("rv"))
        f = e.join(pu, "u", "left").join(pv, "v", "left").select(F.coalesce("ru", "u").alias("a"), F.coalesce("rv", "v").alias("b")).where("a <> b")
        f = materialize(f.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        discard(e)
        discard(p)
        e = f
    return labels


FILTER_BITS = 26


def row_filter(wanted: DataFrame, column: str) -> np.ndarray:
    """A bitmap with the hash of every wanted value set, 64 bits for each set one but
    at most 2**FILTER_BITS (8 MB); it only spares a shuffle, a join decides."""
    h = f"(xxhash64({column}) & {(1 << FILTER_BITS) - 1})"
    w = wanted.selectExpr(f"CAST({h} >> 5 AS INT) AS w", f"shiftleft(1L, CAST({h} & 31 AS INT)) AS b")
    rows = w.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    words, bits = rows["w"].to_numpy(np.int64), rows["b"].to_numpy().astype(np.uint32)
    need = max(16, int(64 * np.bitwise_count(bits).sum()).bit_length())
    out = np.zeros(1 << (min(FILTER_BITS, need) - 5), np.uint32)
    np.bitwise_or.at(out, words & (len(out) - 1), bits)
    return out


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which xxhash64 values may be wanted."""
    h = hashes & (len(bitmap) * 32 - 1)
    return (bitmap[h >> 5] >> (h & 31).astype(np.uint32) & 1).astype(bool)


def unused(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with underscores before it until no column has it (upper case or not)."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id isn't in ids (one column). Rows that the bitmap
    clears stay where they are; only the others are joined. Null ids stay. Other
    columns may have any names."""
    import pyarrow as pa

    names = docs.columns
    gone, hid = unused(names, "gone_id", "hash_id")
    ids = ids.select(F.col(ids.columns[0]).alias(gone))
    bitmap = docs.sparkSession.sparkContext.broadcast(row_filter(ids, gone))
    keyed = docs.withColumn(hid, F.xxhash64(id_col))

    def split(wanted: bool):
        def work(it):
            for batch in it:
                keep = passes(bitmap.value, batch.column(hid).to_numpy())
                yield batch.filter(pa.array(keep if wanted else ~keep)).select(names)

        return keyed.mapInArrow(work, docs.schema)

    return split(False).union(split(True).join(ids, F.col(id_col) == F.col(gone), "left_anti"))
