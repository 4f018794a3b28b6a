"""Sharding by a k-d tree over metadata, with weighted medians.

Every item has a coordinate in each metadata dimension and a weight in bytes. A
node that is to hold k leaves is cut across its widest dimension where the
items below weigh k // 2 of k parts. The cut is found by distributed histograms
of the digits of the items' keys (coordinate, then a hash), so one value or source
may hold any share of the rows and still be cut. The tree is a table with a row for
each open node, joined with the items level by level, and so may have any number of
leaves. Strings have their ranks as coordinates.

Rows of one text are one item, so copies share a shard, unless they weigh more than
a 32nd of one: then each row is an item, as shards could not be equal otherwise.
Texts are read once; what the tree works on has a few numbers an item.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, release, scratch, settled, table

COORD_BITS, TIE_BITS = 24, 32
#: Bits of the key's digits, from the highest.
DIGITS = (16, 20, 20)
SLOT_ROWS = 50_000
#: Copies stay together up to this share of a shard.
WHOLE, SALTS = 1 / 32, 64


def numeric(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0)).cast("double"))


def ranks(values: DataFrame, column: str) -> DataFrame:
    """(column, rank) of each distinct value that isn't null, from 0 without gaps, in byte order. No task sees all of them."""
    d = values.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    d = materialize(d.select(column, F.monotonically_increasing_id().alias("at")), "values")
    part, nth = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    d = d.select(column, part.alias("part"), nth.alias("nth"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    return d.join(parts, "part").select(column, (F.col("first") + F.col("nth")).alias("rank"))


def _items(docs: DataFrame, leaves: int | None, target_bytes: int | None, id_col: str, text_col: str, strings: tuple[str, ...]) -> tuple[DataFrame, DataFrame, int]:
    """(rows, items, leaves): rows (rid, id, size, text_crc32, i1, i2) and the items (i1, i2, w, k0..) they belong to."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"),
        *(F.col(c).alias(f"s{i}") for i, c in enumerate(strings)),
    )
    rows = materialize(base, "rows")
    names = [f"s{i}" for i in range(len(strings))]
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("w"), F.max("size").alias("size"), *(F.min(c).alias(c) for c in names))
    groups = materialize(groups, "groups")
    total = groups.agg(F.sum("w")).first()[0] or 0
    leaves = leaves or max(1, math.ceil(total / target_bytes))
    limit = total / leaves * WHOLE
    heavy = groups.where((F.col("w") > limit) & (F.col("w") > F.col("size"))).select("g1", "g2", *names)
    salts = heavy.select("g1", "g2", F.lit(True).alias("apart"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int"))
    apart = salted.join(salts, ["g1", "g2", "salt"], "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    rows = materialize(apart.select("rid", "id", "size", "text_crc32", F.when(F.col("apart"), F.col("rid")).otherwise(F.col("g1")).alias("i1"), F.when(~F.col("apart"), F.col("g2")).alias("i2"), *names), "rows")
    one = groups.join(heavy.select("g1", "g2"), ["g1", "g2"], "left_anti").select(F.col("g1").alias("i1"), F.col("g2").alias("i2"), "w", "size", *names)
    items = one.union(rows.where("i2 IS NULL").select("i1", "i2", F.col("size").alias("w"), "size", *names))
    items = items.withColumn("c0", numeric(F.col("size")))
    for i, c in enumerate(names):
        place = F.coalesce(F.col("rank") + 1, F.lit(0)).cast("double").alias(f"c{i + 1}")  # null comes first
        known = materialize(ranks(groups, c), "ranks")
        items = items.join(known, c, "left").select("*", place).drop("rank")
    items = materialize(items.drop(*names, "size"), "items")
    dims = range(len(strings) + 1)
    s = items.agg(*(f(f"c{i}").alias(f"{f.__name__}{i}") for i in dims for f in (F.min, F.max))).first()
    keys = []
    for i in dims:
        low, wide = s[f"min{i}"] or 0.0, (s[f"max{i}"] or 0.0) - (s[f"min{i}"] or 0.0)
        coord = F.floor((F.col(f"c{i}") - F.lit(low)) / F.lit(wide) * ((1 << COORD_BITS) - 1)).cast("long") if wide else F.lit(0).cast("long")
        keys.append((F.shiftleft(coord, TIE_BITS) + F.shiftrightunsigned(F.xxhash64("i1", "i2"), 64 - TIE_BITS)).alias(f"k{i}"))
    return rows, items.select("i1", "i2", "w", *keys), leaves


def _cut(items: DataFrame, dims: int) -> DataFrame:
    """(node, leaves, dim, known) of each open node: keys of dimension dim up to known go left."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"k{i}").alias("key")) for i in range(dims)])).alias("p")
    left = sum(DIGITS) - DIGITS[0]
    open_items = items.where("leaves > 1")
    first = open_items.select("node", "leaves", "w", at).groupBy("node", "leaves", "p.dim", F.shiftright("p.key", left).alias("digit")).agg(F.sum("w").alias("w"))
    first = materialize(first, "bins")
    box = first.groupBy("node", "leaves", "dim").agg((F.max("digit") - F.min("digit")).alias("width"), F.sum("w").alias("all"))
    nodes = box.groupBy("node", "leaves").agg(F.max(F.struct("width", (-F.col("dim")).alias("dim"))).alias("top"), F.max("all").alias("all"))
    goal = F.col("all") * F.floor(F.col("leaves") / 2) / F.col("leaves")
    nodes = nodes.select("node", "leaves", (-F.col("top.dim")).alias("dim"), goal.alias("goal"), F.lit(0).cast("long").alias("known"))
    bins = first.join(nodes, ["node", "leaves", "dim"])
    for step, size in enumerate(DIGITS):
        if step:
            left -= size
            key = F.coalesce(*[F.when(F.col("dim") == i, F.col(f"k{i}")) for i in range(dims)])
            rows = open_items.join(nodes.drop("leaves"), "node").withColumn("key", key).where(F.shiftright("key", left + size) == F.col("known"))
            bins = rows.groupBy("node", "leaves", "dim", "goal", "known", F.shiftright("key", left).bitwiseAND(F.lit((1 << size) - 1)).alias("digit")).agg(F.sum("w").alias("w"))
        by = Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = bins.withColumn("upto", F.sum("w").over(by))
        # The digit whose items reach the goal; at the last one, the nearer side of it.
        found = upto.where(F.col("upto") >= F.col("goal")).groupBy("node", "leaves", "dim", "goal", "known").agg(F.min(F.struct("digit", "w", "upto")).alias("x"))
        below = F.col("goal") - (F.col("x.upto") - F.col("x.w"))  # what is still to come before the goal, within the digit
        short = F.lit(0) if left else F.when(below < F.col("x.upto") - F.col("goal"), 1).otherwise(0)
        nodes = found.select("node", "leaves", "dim", below.alias("goal"), (F.shiftleft("known", size) + F.col("x.digit") - short).alias("known"))
        nodes = materialize(nodes, "nodes")
    return nodes


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", strings: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot): size is the text's bytes and one more;
    shards weigh nearly the same; slots of a shard run from 0 without gaps.

    Give the number of shards, or the bytes of one. A null text has no bytes; null
    metadata come first in their dimension. Ties in a dimension are broken by a hash
    of the text. Rows of one text stay together, under the smallest of their metadata,
    unless they weigh more than a 32nd of a shard. Repeated rows have a slot each; an
    empty table gives no rows; other columns are ignored.
    """
    dims = len(strings) + 1
    with scratch() as own:
        rows, items, leaves = _items(docs, n_shards, target_bytes, id_col, text_col, strings)
        items = items.select("*", F.lit(0).cast("long").alias("node"), F.lit(leaves).alias("leaves"))
        for _ in range(math.ceil(math.log2(leaves))):
            items = materialize(items, "level")
            nodes = _cut(items, dims)
            key = F.coalesce(*[F.when(F.col("dim") == i, F.col(f"k{i}")) for i in range(dims)])
            half = F.floor(F.col("leaves") / 2).cast("int")
            right = key > F.col("known")
            items = items.join(nodes.select("node", "dim", "known"), "node", "left").select(
                "i1", "i2", "w", *(f"k{i}" for i in range(dims)), (F.col("node") + F.when(right, half).otherwise(0)).alias("node"), F.when(F.col("leaves") == 1, 1).when(right, F.col("leaves") - half).otherwise(half).cast("int").alias("leaves")
            )
        placed = materialize(items.select("i1", "i2", F.col("node").cast("int").alias("shard")), "placed")
        same = (F.col("i1") == F.col("p1")) & F.col("i2").eqNullSafe(F.col("p2"))
        rows = rows.join(placed.select(F.col("i1").alias("p1"), F.col("i2").alias("p2"), "shard"), same).select("rid", "id", "size", "text_crc32", "shard")
        rows = own.keep(materialize(rows.withColumn("tie", F.xxhash64("rid")), "shards"))
    release(docs.sparkSession)
    # Slots: shards are cut by ranges of a hash, so that no task orders a whole shard.
    n = rows.count()
    cuts = max(3, math.ceil(math.log2(max(1, n / (leaves * SLOT_ROWS))))) if n else 3
    rows = rows.withColumn("part", F.shiftrightunsigned("tie", 64 - cuts))
    counts = rows.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("tie", "rid"))
    out = rows.withColumn("rank", rank).join(offsets, ["shard", "part"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"))


def op8_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        out = kd_shards(table(spark, sf_dir, "documents"), n_shards=16)
        return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

    return settled(build, "shards")
