"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents: each segment covers the texts of a few
megabytes and holds, for each of its terms, the increasing positions of the
term among the segment's words. A phrase is looked up in a segment by the
postings of its rarest term there, moved by the term's offset, and intersected
with the postings of the other terms, likewise moved. Segments are independent,
so building, storing and searching need no shuffle, and a lost one is rebuilt
from its own documents. Terms are 128-bit hashes of words. Test items come in
blocks of a bounded size; each is sent out, searched in all segments, and taken back
before the next one.

Besides exact occurrences, places are found where a window's words stand near each
other: its first word at the place, and every other word at most `slop` words from
where it would stand in an exact occurrence there, in the same document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, settled, table
from .words import Words, batches

SEGMENT_BYTES, BLOCK_BYTES, WINDOW, SLOP = 4 << 20, 4 << 20, 10, 2


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Segments: their numbers, ids of the documents, ends (words up to the end of each),
    terms (sorted 64-bit hashes) and checks (64 more bits of each), counts of their
    postings, and postings (positions of each term one after another, as differences
    within a term). Words are runs of digits, letters and non-ASCII characters, A-Z as
    a-z. A null text has none. Write the rows before use, as numbers hold for one run.
    """

    def work(it):
        segment = TaskContext.get().partitionId() << 32
        for batch in batches(it, segment_bytes):
            w = Words(batch.column("text"), "alnum_lower")
            h, check = w.hashes(0), w.hashes(1)
            order = np.argsort(h, kind="stable")
            h, sure = h[order], check[order]
            if ((h[1:] == h[:-1]) & (sure[1:] != sure[:-1])).any():  # words that only the check tells apart
                again = np.lexsort((order, sure, h))
                order, h, sure = order[again], h[again], sure[again]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (sure[1:] != sure[:-1])
            first = np.flatnonzero(new)
            raw = [w.ptr[1:].astype("<u4"), h[first], sure[first], np.diff(first, append=len(h)).astype("<u4")]
            del h, check, sure, new
            gaps = np.diff(order, prepend=0)
            gaps[first] = order[first]
            raw.append(gaps.astype("<u4"))
            del order, gaps
            ids = pa.array([batch.column("id").to_pylist()], pa.list_(batch.schema.field("id").type))
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), ids, *(pa.array([x.tobytes()], pa.binary()) for x in raw)], ["segment", "ids", *PARTS])
            segment += 1

    d = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return d.mapInArrow(work, f"segment long, ids array<{d.schema['id'].dataType.simpleString()}>, " + ", ".join(f"{x} binary" for x in PARTS))


PARTS = ("ends", "terms", "checks", "counts", "postings")


def item_windows(texts: list[str | None], window: int) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The windows of some texts: distinct terms and their checks, and by length the
    windows as rows of numbers of terms, each with its text. A text of fewer words than
    a window is one window; one without words has none."""
    w = Words(pa.array(texts, pa.string()), "alnum_lower")
    h, check = w.hashes(0), w.hashes(1)
    order = np.lexsort((check, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    found: dict[int, list] = {}
    for i, (a, z) in enumerate(zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist())):
        if z > a:
            rows = np.lib.stride_tricks.sliding_window_view(number[a:z], min(window, z - a))
            found.setdefault(rows.shape[1], []).append((rows, np.full(len(rows), i)))
    return h[order][new], check[order][new], {size: (np.concatenate([r for r, _ in x]), np.concatenate([i for _, i in x])) for size, x in found.items()}


class IndexSegment:
    def __init__(self, ends: bytes, terms: bytes, checks: bytes, counts: bytes, postings: bytes):
        self.ends = np.frombuffer(ends, "<u4").astype(np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.terms, self.checks = np.frombuffer(terms, np.uint64), np.frombuffer(checks, np.uint64)
        self.counts = np.frombuffer(counts, "<u4").astype(np.int64)
        gaps = np.frombuffer(postings, "<u4").astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.positions = np.cumsum(gaps)
        if len(gaps):  # sums begin anew with each term
            before = np.concatenate([[0], self.positions])[self.first[:-1]]
            self.positions = self.positions - np.repeat(before, self.counts)
        #: Term and position in one increasing number.
        self.where = np.repeat(np.arange(len(self.terms)), self.counts) << 40 | self.positions
        self.n = len(gaps)

    def doc(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, side="right")

    def ranks(self, terms: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The place of each term among the segment's, or -1."""
        out = np.full(len(terms), -1)
        k, new = np.searchsorted(self.terms, terms), np.append(True, self.terms[1:] != self.terms[:-1])
        for shift in range(int(np.diff(np.flatnonzero(new), append=len(self.terms)).max(initial=0))):  # terms that share a hash
            at = np.minimum(k + shift, len(self.terms) - 1)
            out[(self.terms[at] == terms) & (self.checks[at] == checks)] = 0
            at = at[out == 0]
            out[out == 0] = at + 1
        return np.where(out > 0, out - 1, -1)

    def _candidates(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, order, position): the postings of the rarest term of each phrase; order: terms from rare to common."""
        order = np.argsort(self.counts[rank], axis=1, kind="stable")
        rare = rank[np.arange(len(rank)), order[:, 0]]
        many = self.counts[rare]
        which = np.repeat(np.arange(len(rank)), many)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        return which, order, self.positions[np.repeat(self.first[rare], many) + nth]

    def _stands(self, rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Does the term stand anywhere from lo to hi?"""
        at = np.minimum(np.searchsorted(self.where, (rank << 40) + lo), self.n - 1)
        found = self.where[at]
        return (found >= (rank << 40) + lo) & (found <= (rank << 40) + hi)

    def find(self, phrases: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact matches (phrase, position) of phrases, a matrix of numbers of terms, which have the given ranks."""
        alive = np.flatnonzero((ranks[phrases] >= 0).all(1)) if self.n else np.zeros(0, np.int64)
        if not len(alive):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank, size = ranks[phrases[alive]], phrases.shape[1]
        which, order, start = self._candidates(rank)
        start = start - order[which, 0]
        ok = (start >= 0) & (start + size <= self.n)
        which, start = which[ok], start[ok]
        for j in range(1, size):
            o = order[which, j]
            ok = self._stands(rank[which, o], start + o, start + o)
            which, start = which[ok], start[ok]
        same = self.doc(start) == self.doc(start + size - 1)
        return alive[which[same]], start[same]

    def find_near(self, phrases: np.ndarray, ranks: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Matches (phrase, position of its first term) within the slop, the exact ones among them."""
        alive = np.flatnonzero((ranks[phrases] >= 0).all(1)) if self.n else np.zeros(0, np.int64)
        if not len(alive):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank, size = ranks[phrases[alive]], phrases.shape[1]
        which, order, anchor = self._candidates(rank)
        found_which, found_start = [], []
        for d in range(-slop, slop + 1):
            start = anchor - order[which, 0] + d
            ok = (start >= 0) & (start < self.n) & ((order[which, 0] > 0) | (d == 0))
            w, start = which[ok], start[ok]
            ok = self._stands(rank[w, 0], start, start)
            found_which.append(w[ok])
            found_start.append(start[ok])
        both = np.unique(np.stack([np.concatenate(found_which), np.concatenate(found_start)], 1), axis=0)
        which, start = both[:, 0], both[:, 1]
        doc = self.doc(start)
        begin, end = self.begins[doc], self.ends[doc]
        for j in range(size):
            o = order[which, j]
            ok = self._stands(rank[which, o], np.maximum(begin, start + o - slop * (o > 0)), np.minimum(end - 1, start + o + slop * (o > 0)))
            which, start, begin, end = which[ok], start[ok], begin[ok], end[ok]
        return alive[which], start


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> tuple[int, Iterator[list[tuple]]]:
    """The number of blocks, and lists of (id, text), of about block_bytes of text each, one after another."""
    t = items.selectExpr(f"`{item_id}` AS item_id", f"`{item_text}` AS text")
    total = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    return n, ([tuple(r) for r in t.where(F.pmod(F.hash("item_id", "text"), F.lit(n)) == k).toLocalIterator()] for k in range(n))


def contamination(index: DataFrame, items: DataFrame, window: int = WINDOW, item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, slop: int = 0) -> DataFrame:
    """Rows (id, n_words, hits, near, items) for each document of the index: hits are
    the positions of words inside an occurrence of a window, near the places where a
    window stands within the slop, but not exactly (none without a slop), items the
    items with exact occurrences (distinct, in no order). A document without any has
    empty lists; items that share an id count once; an item without an id counts but
    has no name. Repeated documents have a row each. The index is a written table.
    """
    sc = index.sparkSession.sparkContext
    kind = index.schema["ids"].dataType.elementType.simpleString()
    item_kind, item_type = items.schema[item_id].dataType.simpleString(), to_arrow_type(items.schema[item_id].dataType)
    schema = f"segment long, k long, id {kind}, n_words long, hits array<long>, near array<long>, items array<{item_kind}>"

    def search(sent, sparse: bool):
        def work(it):
            ids, terms, checks, by_size = sent.value
            for batch in it:
                for r in range(batch.num_rows):
                    seg = IndexSegment(*(batch.column(c)[r].as_py() for c in PARTS))
                    ranks = seg.ranks(terms, checks)
                    cover, near, pairs = np.zeros(seg.n + 1, np.int32), [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
                    for size, (phrases, owner) in by_size.items():
                        which, at = seg.find(phrases, ranks)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + size, -1)
                        pairs.append(np.stack([seg.doc(at), owner[which]], 1))
                        if slop:
                            n_which, n_at = seg.find_near(phrases, ranks, slop)
                            near.append(n_at[~np.isin(n_which << 40 | n_at, which << 40 | at)])
                    n = len(seg.ends)

                    def lists(docs, values, arrow):
                        ptr = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))]).astype(np.int32)  # noqa: B023
                        return pa.ListArray.from_arrays(pa.array(ptr), pa.array(values, arrow))

                    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                    close = np.unique(np.concatenate(near))
                    d, c = seg.doc(hit), seg.doc(close)
                    p = np.unique(np.concatenate(pairs).astype(np.int64), axis=0)
                    cols = [pa.array(np.full(n, batch.column("segment")[r].as_py())), pa.array(np.arange(n), pa.int64()), batch.column("ids")[r].values, pa.array(seg.ends - seg.begins)]
                    cols += [lists(d, hit - seg.begins[d], pa.int64()), lists(c, close - seg.begins[c], pa.int64()), lists(p[:, 0], [ids[i] for i in p[:, 1]], item_type)]
                    out = pa.RecordBatch.from_arrays(cols, ["segment", "k", "id", "n_words", "hits", "near", "items"])
                    yield out.filter(pa.array(np.isin(np.arange(n), np.concatenate([d, c])))) if sparse else out

        return index.mapInArrow(work, schema)

    n, blocks = item_blocks(items, item_id, item_text, block_bytes)
    send = lambda block: sc.broadcast(([i for i, _ in block], *item_windows([t for _, t in block], window)))
    merged = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    if n == 1:
        return search(send(next(blocks)), False).select("id", "n_words", "hits", "near", F.array_distinct("items").alias("items"))
    found = None
    for block in blocks:
        sent = send(block)
        part = search(sent, True).drop("id", "n_words")
        if found is None:
            found = materialize(part, "found")
        else:
            part.write.mode("append").parquet(found._voxelloom_path)
        sent.destroy()
    found = index.sparkSession.read.schema(found.schema).parquet(found._voxelloom_path).groupBy("segment", "k").agg(merged("hits"), merged("near"), merged("items"))
    whole = search(send([]), False).select("segment", "k", "id", "n_words")
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    return whole.join(found, ["segment", "k"], "left").select("id", "n_words", none("hits"), none("near"), none("items"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, **options) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_near, n_items, items_sha256, contaminated) for each document."""
    index = materialize(build_index(docs), "index", compression="zstd")
    rows = contamination(index, items, window, slop=slop, **options)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("near").cast("long").alias("n_near"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")
    )


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "contamination")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT r, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT r, count(DISTINCT i + j)::BIGINT AS n_hit FROM (SELECT r, i, unnest(range(k)) AS j FROM m) GROUP BY r),
bl AS (SELECT DISTINCT w[i:i + least(10, len(w)) - 1] AS l FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, i, w, w[i] AS first FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
q AS (SELECT r, count(DISTINCT i)::BIGINT AS n_near FROM p JOIN bl ON l[1] = first
  WHERE NEAR AND array_to_string(w[i:i + len(l) - 1], ' ') <> array_to_string(l, ' ') GROUP BY r),
t AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN q USING (r) LEFT JOIN t USING (r)""".replace("NEAR", " AND ".join(f"(len(l) < {j} OR list_contains(w[greatest(1, i + {j - 1 - SLOP}):i + {j - 1 + SLOP}], l[{j}]))" for j in range(2, WINDOW + 1)))
