"""N-gram Jaccard join by parity sketches.

A set of shingles is hashed into a wide bit sketch: a shingle flips one bit, so
the Hamming distance of two sketches never exceeds the size of the symmetric
difference of the sets. At a similarity of at least J that difference is at most
t = (1 - J) / (1 + J) times the sum of the sizes, so of t + 1 segments of the
sketches one is equal. Sets are joined on equal segments within bands of sizes; a
segment that no shingle reaches is joined together with the next one, with one bit
left out where needed. A segment is kept as the XOR of the codes of its set bits.

No pairs are written. A set that shares a bucket takes the smallest member of its
buckets as a label, and the sets of one label meet in a cell. Afterwards each bucket
that still holds several components puts its members into the cell of its smallest
component, a set once for each such component and not for each bucket. In a cell,
sets of different components are compared by their sketches; those with a partner
that may be alike meet again with their texts, are compared by wider sketches and
then by their shingles, and only links that join two components leave the cell, at
most one a set. A cell with too many members or shingles is dealt out in parts, and
every two parts meet, but for parts of one component. So no link between two
components is lost.

Identical sets are one node of the graph. Nodes are named by 64 bits, and told
apart by 64 more; links compare shingles by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, release, scratch, table
from .graph import components, passes, row_filter
from .words import Words, batches, gram_hashes, mix

#: Bits of the narrowest sketches.
FOLD = 512
#: Members of a cell, and shingles of all of them.
CHUNK, CELL_SHINGLES = 8192, 1 << 21


class Bands:
    """Size bands for a similarity of num / den. A set's partners of its size or
    more are in its own band or the next."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.hi = [1]

    def _reach(self, n: int) -> None:
        while self.hi[-1] < n:
            h = self.hi[-1]
            self.hi.append(max(h + 1, h * self.den // self.num, h * 138 // 100))

    def of(self, n: int) -> list[tuple[int, int]]:
        """(band, number of segments) of each band in which a set of n shingles is entered."""
        self._reach(n * self.den // self.num + 1)
        k = int(np.searchsorted(self.hi, n))
        out = [(k, self.segments(k))]
        if n * self.den // self.num > self.hi[k]:
            self._reach(self.hi[k] + 1)
            out.append((k + 1, self.segments(k + 1)))
        return out

    def segments(self, k: int) -> int:
        while len(self.hi) <= k:
            self._reach(self.hi[-1] + 1)
        return 1 + 2 * self.hi[k] * (self.den - self.num) // (self.den + self.num)


#: A bucket key holds a hash, the band and the segment.
BAND_BITS, PART_BITS = 7, 17


def segment_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Bucket keys of a sorted array of distinct shingle hashes."""
    out, code = [], mix(s ^ np.uint64(0x5851F42D4C957F2D))
    for band, m in bands.of(len(s)):
        part = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        first = np.searchsorted(part, np.arange(m + 1))
        size = np.diff(first)
        sig = np.zeros(m, np.uint64)
        full = np.flatnonzero(size)
        sig[full] = np.bitwise_xor.reduceat(code, first[full])
        name = mix(mix(np.uint64(band) * np.uint64(1 << 32) + np.arange(m, dtype=np.uint64)) ^ sig) + size.astype(np.uint64)
        place = np.uint64(band << PART_BITS) | (np.arange(m, dtype=np.uint64) & np.uint64((1 << PART_BITS) - 1))

        def key(h, at):
            return (mix(h) << np.uint64(BAND_BITS + PART_BITS)) | at  # noqa: B023

        few = size == 0 if m > 1 else np.zeros(m, bool)
        out.append(key(name[~few], place[~few]))
        i = np.flatnonzero(few)
        j = (i + 1) % m
        out.append(key(name[i] ^ mix(sig[j] + size[j].astype(np.uint64) + np.uint64(1)), place[i]))
        rep = np.repeat(np.arange(len(i)), size[j])
        if len(rep):
            at = np.concatenate([np.arange(first[x], first[x + 1]) for x in j])
            out.append(key(name[i[rep]] ^ mix((sig[j[rep]] ^ code[at]) + size[j[rep]].astype(np.uint64)), place[i[rep]]))
    return np.unique(np.concatenate(out))


def shingle_sets(column, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the sorted distinct hashes of its k-word shingles, and their
    hashes in the other lane; a shorter text is one shingle."""
    w = Words(column, "space_lower")
    h = [w.hashes(lane) for lane in (0, 1)]
    g = [gram_hashes(x, k) for x in h]
    none = np.zeros(0, np.uint64)
    out = []
    for a, z in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist()):
        if z - a >= k:
            s, at = np.unique(g[0][a : z - k + 1], return_index=True)
            out.append((s, g[1][a + at]))
        else:
            out.append((gram_hashes(h[0][a:z], z - a), gram_hashes(h[1][a:z], z - a)) if z > a else (none, none))
    return out


def set_name(s: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    raw = hashlib.blake2b(s[0].tobytes() + s[1].tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def alike(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], num: int, den: int) -> bool:
    """den * intersection >= num * union, of two sets that aren't empty."""
    at = np.minimum(np.searchsorted(x[0], y[0]), len(x[0]) - 1)
    both = int(((x[0][at] == y[0]) & (x[1][at] == y[1])).sum())
    return both * den >= num * (len(x[0]) + len(y[0]) - both)


def sketch_bits(n: int) -> int:
    """Bits of the sketch of a set of n shingles: at least 2 n, a power of two."""
    return max(FOLD, 1 << max(0, 2 * n - 1).bit_length())


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    """The sketch: the parity of the hashes in each of so many equal ranges (a power of two), as bytes."""
    at = (s >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little")


def halved(sketches: np.ndarray) -> np.ndarray:
    """Sketches (rows of bytes) of half the bits."""
    b = np.unpackbits(sketches, axis=1, bitorder="little").reshape(len(sketches), -1, 2)
    return np.packbits(b[:, :, 0] ^ b[:, :, 1], axis=1, bitorder="little")


class Sketches:
    """Sketches of sets in ascending order of their sizes, at each of their widths."""

    def __init__(self, raw: list[bytes]):
        self.width = np.array([len(x) for x in raw], np.int64)
        self.at: dict[int, tuple[int, np.ndarray]] = {}
        wider = np.zeros((0, 0), np.uint8)
        first = len(raw)
        for w in sorted(set(self.width.tolist()), reverse=True):
            while len(wider) and wider.shape[1] > w:
                wider = halved(wider)
            begin = int(np.searchsorted(self.width, w))
            own = np.frombuffer(b"".join(raw[begin:first]), np.uint8).reshape(-1, w)
            wider = np.concatenate([own, wider.reshape(-1, w)])
            self.at[w] = (begin, np.ascontiguousarray(wider).view(np.uint64))
            first = begin

    def distance(self, i: int, j: np.ndarray) -> np.ndarray:
        """Hamming distances of set i and sets j > i, at the width of i."""
        begin, m = self.at[int(self.width[i])]
        return np.bitwise_count(m[i - begin] ^ m[j - begin]).sum(1, dtype=np.int64)


class Cell:
    """Sets in ascending order of their sizes, and which of them may be compared:
    those of different roots, and not of the same side unless it is 0."""

    def __init__(self, n: np.ndarray, label: np.ndarray, side: np.ndarray, num: int, den: int):
        self.n, self.label, self.side, self.num, self.den = n, label, side, num, den
        self.upto = np.searchsorted(n, n * den // num, side="right")

    def partners(self, i: int, sketches: Sketches) -> np.ndarray:
        """Sets j > i that sketches do not rule out."""
        j = np.arange(i + 1, self.upto[i])
        j = j[(self.label[j] != self.label[i]) & ((self.side[j] == 0) | (self.side[j] != self.side[i]))]
        return self.close(i, j, sketches) if len(j) else j

    def close(self, i: int, j: np.ndarray, sketches: Sketches) -> np.ndarray:
        return j[sketches.distance(i, j) * (self.den + self.num) <= (self.n[i] + self.n[j]) * (self.den - self.num)]


def in_question(n: np.ndarray, root: np.ndarray, side: np.ndarray, sketches: list[bytes], num: int, den: int) -> np.ndarray:
    """Which sets of a cell have a partner that sketches do not rule out."""
    order = np.argsort(n, kind="stable")
    cell = Cell(n[order], root[order], side[order], num, den)
    by_width = Sketches([sketches[i] for i in order])
    out = np.zeros(len(n), bool)
    for i in range(len(n) - 1):
        j = cell.partners(i, by_width)
        if len(j):
            out[order[i]] = out[order[j]] = True
    return out


def linked(column, root: np.ndarray, side: np.ndarray, k: int, num: int, den: int) -> list[tuple[int, int]]:
    """(root, smaller root) of components that links within a cell join. Rows of one
    root are not compared, nor rows of one side other than 0."""
    sets = shingle_sets(column, k)
    n = np.array([len(s) for s, _ in sets], np.int64)
    order = np.argsort(n, kind="stable")
    sets = [sets[i] for i in order]
    names, label = np.unique(root[order], return_inverse=True)
    cell = Cell(n[order], label, side[order], num, den)
    # At this width few shingles share a bit, so few pairs that are not alike are left.
    most = max(FOLD, (64 << 23) // max(1, len(sets)))  # 64 MB in all
    wide = Sketches([parity(s, min(8 * sketch_bits(len(s)), 1 << most.bit_length() - 1)).tobytes() for s, _ in sets])
    before = label.copy()
    for i in range(len(sets) - 1):
        for x in cell.partners(i, wide).tolist():
            if label[x] != label[i] and alike(sets[i], sets[x], num, den):
                old, new = sorted((label[x], label[i]), reverse=True)
                label[label == old] = new
    pairs = np.unique(np.stack([before, label], 1), axis=0)
    return [(int(names[a]), int(names[b])) for a, b in pairs.tolist() if a != b]


def _sketch(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, sid, name, check, sketch) of each document; sid is null without shingles."""

    def work(it):
        for batch in batches(it):
            sets = shingle_sets(batch.column("text"), k)
            names = [set_name(s) if len(s[0]) else (0, 0) for s in sets]
            name, n = np.array([x for x, _ in names], np.int64), np.array([len(s) for s, _ in sets], np.int64)
            raw = [parity(s, sketch_bits(len(s))).tobytes() for s, _ in sets]
            cols = [batch.column("id"), pa.array(n), pa.array(name, mask=n == 0), pa.array(name), pa.array([c for _, c in names], pa.int64()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "sid", "name", "check", "sketch"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(work, f"id {kind}, n long, sid long, name long, check long, sketch binary")


def _nodes(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketches, nodes): a node (sid, name, check, rep, n, sketch) for each different set.
    sid is its name, but for sets whose names clash."""
    while True:
        nodes = sketches.where("sid IS NOT NULL").groupBy("sid").agg(F.min("id").alias("rep"), F.max("name").alias("name"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.min("check").alias("lo"), F.max("check").alias("hi"))
        nodes = materialize(nodes, "nodes")
        clash = nodes.where("lo <> hi").select("sid", "lo")
        if not clash.limit(1).count():
            return sketches, nodes.drop("hi").withColumnRenamed("lo", "check")
        other = F.when(F.col("check") > F.col("lo"), F.xxhash64("sid", "check")).otherwise(F.col("sid"))
        sketches = materialize(sketches.join(clash, "sid", "left").withColumn("sid", other).drop("lo"), "sketches")


def _entries(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, sid, center): the buckets that the sets of the documents enter, by name. Of the
    sets of a slice of documents in one bucket the smallest enters it, without a
    center; if there are others, all of them are members already, with that center."""

    def work(it):
        bands = Bands(num, den)
        for batch in batches(it):
            sets = {set_name(s): s[0] for s in shingle_sets(batch.column("text"), k) if len(s[0])}
            if not sets:
                continue
            sid = np.array([x for x, _ in sets], np.int64)
            keys = [segment_keys(s, bands) for s in sets.values()]
            flat, owner = np.concatenate(keys), np.repeat(sid, [len(x) for x in keys])
            order = np.lexsort((owner, flat))
            flat, owner = flat[order], owner[order]
            new = np.ones(len(flat), bool)
            new[1:] = flat[1:] != flat[:-1]
            center = owner[np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))]
            multi = ~new
            multi[:-1] |= ~new[1:]
            some = np.concatenate([np.flatnonzero(new), np.flatnonzero(multi)])
            first = np.arange(len(some)) < new.sum()
            yield pa.RecordBatch.from_arrays([pa.array(flat[some].view(np.int64)), pa.array(owner[some]), pa.array(center[some], mask=first)], ["key", "sid", "center"])

    return docs.select("text").mapInArrow(work, "key long, sid long, center long")


def _members(entries: DataFrame) -> DataFrame:
    """(key, sid, center) of every set in a bucket of two sets or more; center is a small
    one of them. Of a bucket a task gets at most one row from each slice, and of rows
    that have their center already a share, so a frequent key is no large group."""

    def runs(it):
        key = center = None
        for batch in it:
            done = batch.filter(pc.is_valid(batch.column("center")))
            if done.num_rows:
                yield done
            batch = batch.filter(pc.is_null(batch.column("center")))
            k, s = (batch.column(c).to_numpy() for c in ("key", "sid"))
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            c = s[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
            if key == k[0]:
                end = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(k)
                c = c.copy()
                c[:end] = center
            other = s != c
            key, center = k[-1], c[-1]
            both, at = np.unique(k[other], return_index=True)
            out = [np.concatenate([k[other], both]), np.concatenate([s[other], c[other][at]]), np.concatenate([c[other], c[other][at]])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["key", "sid", "center"])

    salt = F.when(F.col("center").isNull(), 0).otherwise(F.pmod(F.xxhash64("sid"), F.lit(64)))
    return entries.repartition("key", salt).sortWithinPartitions("key", "sid").mapInArrow(runs, "key long, sid long, center long")


def _parts(c: Column, size: Column) -> Column:
    return F.greatest(F.ceil(c / CHUNK), F.ceil(size / CELL_SHINGLES), F.lit(1)).cast("int")


def _own(n: Column | str) -> Column:
    return F.pmod(F.xxhash64("sid"), F.col(n) if isinstance(n, str) else n).cast("int")


_CELL = ("sid", "root", "label", "lo", "hi", "side")


def _by_label(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cells of the sets that share the smallest of the members of their buckets."""
    label = members.groupBy("sid").agg(F.least(F.min("center"), F.col("sid")).alias("label"))
    rows = label.join(nodes.select("sid", "n"), "sid")
    counts = rows.groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("b")).where("c > 1").select("label", _parts(F.col("c"), F.col("b")).alias("p"))
    rows = rows.join(counts, "label").withColumn("lo", _own("p"))
    return rows.select("sid", F.col("sid").alias("root"), "label", "lo", F.col("lo").alias("hi"), F.lit(0).alias("side"))


def _by_component(members: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Cells of the sets in buckets that hold several components, by the smallest of them."""
    placed = members.select("key", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", F.coalesce("root", "sid").alias("root"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("label"), F.max("root").alias("last")).where("label <> last").select("key", "label")
    rows = placed.join(mixed, "key").select("sid", "root", "label").distinct().join(nodes.select("sid", "n"), "sid")
    rows = materialize(rows, "rows")
    discard(placed)
    each = rows.groupBy("label", "root").agg(F.count("*").alias("c"), F.sum("n").alias("b"))
    plan = each.groupBy("label").agg(F.max(F.struct("c", "b", "root")).alias("top"), F.sum("c").alias("c"), F.sum("b").alias("b"))
    # p: parts of the largest component, q: of all others; 0 and 1 where one cell holds all.
    whole = _parts(F.col("c"), F.col("b")) == 1
    p = F.when(whole, 0).otherwise(_parts(F.col("top.c"), F.col("top.b")))
    q = F.when(whole, 1).otherwise(_parts(F.col("c") - F.col("top.c"), F.col("b") - F.col("top.b")))
    plan = plan.select("label", F.col("top.root").alias("main"), p.alias("p"), q.alias("q"))
    rows = rows.join(plan, "label")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = ["sid", "root", "label"]
    one = rows.where("p = 0").select(*at, F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side"))
    main = rows.where("p > 0 AND root = main").select(*at, (-1 - _own("p")).alias("lo"), every("q").alias("hi"), F.lit(1).alias("side"))
    rest = rows.where("p > 0 AND root <> main")
    facing = rest.select(*at, _own("q").alias("hi"), every("p").alias("i")).select(*at, (-1 - F.col("i")).alias("lo"), "hi", F.lit(2).alias("side"))
    half = rest.select(*at, _own("q").alias("i"), every("q").alias("j"))
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2)
    half = half.select(*at, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), side.alias("side"))
    return one.union(main).union(facing).union(half)


def _by_cell(work, keys: tuple[str, ...]):
    """For mapInArrow over rows sorted by the keys: work(table of a cell) gives a table."""

    def run(it):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in it:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in keys], 1)
            cut = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            for a, z in zip(cut, cut[1:]):
                if held and last != tuple(at[a]):
                    yield from work(pa.Table.from_batches(held).combine_chunks()).to_batches()
                    held = []
                held.append(batch.slice(a, z - a))
                last = tuple(at[a])
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return run


def _texts(wanted: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(name, check, text) of nodes whose rep is in wanted; others may come along."""
    bitmap = docs.sparkSession.sparkContext.broadcast(row_filter(wanted, "rep"))

    def work(it):
        for batch in it:
            b = batch.filter(pa.array(passes(bitmap.value, batch.column("h").to_numpy())))
            for part in batches([b]) if b.num_rows else ():
                names: dict[tuple[int, int], int] = {}
                for i, s in enumerate(shingle_sets(part.column("text"), k)):
                    if len(s[0]):
                        names.setdefault(set_name(s), i)
                name, check = zip(*names) if names else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(check, pa.int64()), part.column("text").take(pa.array(list(names.values()), pa.int64()))], ["name", "check", "text"])

    return docs.select(F.xxhash64("id").alias("h"), "text").mapInArrow(work, "name long, check long, text string")


def _links(cells: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): components that links within the cells join, b the smallest of its cell."""
    at = ("label", "lo", "hi")

    def question(cell: pa.Table) -> pa.Table:
        n, root, side = (cell.column(c).to_numpy() for c in ("n", "root", "side"))
        keep = in_question(n, root, side, cell.column("sketch").to_pylist(), num, den)
        return cell.select(list(_CELL)).filter(pa.array(keep))

    rows = cells.select(*_CELL).join(nodes.select("sid", "n", "sketch"), "sid").repartition(*at).sortWithinPartitions(*at)
    rows = rows.select(*_CELL, "n", "sketch").mapInArrow(_by_cell(question, at), "sid long, root long, label long, lo int, hi int, side int")
    rows = materialize(rows, "cells")
    release(cells.sparkSession)
    found = materialize(rows.select("sid").distinct().join(nodes.select("sid", "name", "check", "rep"), "sid"), "found")

    def links(cell: pa.Table) -> pa.Table:
        # A text may come twice, from two rows of its id.
        out = linked(cell.column("text"), *(cell.column(c).to_numpy() for c in ("root", "side")), k, num, den)
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    texts = found.join(_texts(found, docs, k), ["name", "check"]).select("sid", "text")
    rows = rows.join(texts, "sid").select(*at, "root", "side", "text").repartition(*at).sortWithinPartitions(*at)
    out = materialize(rows.mapInArrow(_by_cell(links, at), "a long, b long").distinct(), "links")
    release(cells.sparkSession)
    return out


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id) for each document: words split at ASCII
    white space, A-Z as a-z, sets of k-word shingles (a text of fewer words is one
    shingle), a link where den * intersection >= num * union. component_id is the
    smallest id that links lead to.

    A null or empty text, or one without words, has no shingles and is alone.
    Rows that share an id keep a row each. Other columns are ignored.
    """
    d = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    spark = docs.sparkSession
    with scratch() as own:
        sketches, nodes = _nodes(materialize(_sketch(d, k), "sketches"))
        members = materialize(_members(_entries(d, k, num, den)), "members")
        if nodes.where("sid <> name").limit(1).count():  # sets that share a name share its buckets
            members = materialize(members.withColumnRenamed("sid", "name").join(nodes.select("name", "sid"), "name").select("key", "sid", "center"), "members")
        slim = materialize(sketches.select("id", "n", "sid"), "documents")
        discard(sketches)
        release(spark)
        roots = components(_links(_by_label(members, nodes), nodes, d, k, num, den))
        more = _links(_by_component(members, nodes, roots), nodes, d, k, num, den)
        discard(members)
        if more.limit(1).count():
            top = components(more).withColumnRenamed("node", "root").withColumnRenamed("root", "top") if False else components(more).toDF("root", "top")
            all_roots = nodes.select("sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"))
            roots = all_roots.join(top, "root", "left").select(F.col("sid").alias("node"), F.coalesce("top", "root").alias("root"))
        named = nodes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "rep", F.coalesce("root", "sid").alias("root"))
        named = materialize(named, "named")
        least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = named.join(least, "root").select("sid", "component_id")
        out = slim.join(named, "sid", "left")
        out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
        out = materialize(out, "components")
        own.keep(out)
    release(spark)
    return out


def op3_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.root)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""
