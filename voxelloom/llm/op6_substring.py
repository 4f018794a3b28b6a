"""Substring dedup with repeated-phrase automata.

Every window of 50 words has an anchor, the smallest hash of its 10-word runs,
which depends on nothing outside the window; documents that share a window
share its anchor. Anchors of two different texts or more point to documents
that may repeat each other; their windows around such anchors are hashed,
confirmed where they occur in two documents or more, and given to the document
with the smallest id. Runs of confirmed windows there are the recurring
passages. Passages are cut into tiles of 25 words; any 50 words of a passage
hold one whole tile. An Aho-Corasick automaton for each block of documents is
compiled from the tiles of the passages of those documents that own a window of
the block, and the block's documents stream through it, one symbol a word. The
windows around each hit are looked up among those of the passages. Automata thus
grow with their block and not with the corpus, a phrase in any number of
passages costs no more than one, and each document is read by one automaton.

Texts with the same words are one node: but for the smallest id, their rows are
repeats from end to end. Texts and windows are compared by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, materialize, release, scratch, settled, table
from .graph import passes, row_filter, unused
from .words import Words, batches, gram_hashes, sequence_name

WINDOW, ANCHOR, TILE, BLOCK_BYTES = 50, 10, 25, 8 << 20


def window_minima(g: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each run of span values, by doubling."""
    m, have = g, 1
    while have * 2 <= span:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < span:
        m = np.minimum(m[: len(g) - span + 1], m[span - have : len(g) - have + 1])
    return m


class Scanned:
    """Word hashes of a slice of texts, and of each text its name (128 bits of all
    words, as two numbers) and window anchors."""

    def __init__(self, column):
        self.words = w = Words(column, "space")
        self.h = w.hashes(0), w.hashes(1)
        g = gram_hashes(self.h[0], ANCHOR)
        self.minima = window_minima(g, WINDOW - ANCHOR + 1) if len(w) >= WINDOW else np.zeros(0, np.uint64)
        self.range = list(zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist()))

    def name(self, i: int) -> tuple[int, int]:
        return sequence_name(self.h, *self.range[i])

    def names(self) -> list[pa.Array]:
        all_names = [self.name(i) for i in range(len(self.range))]
        return [pa.array([x[k] for x in all_names], pa.int64()) for k in (0, 1)]

    def anchors(self, i: int) -> np.ndarray:
        """The anchor of each window of text i."""
        a, z = self.range[i]
        return self.minima[a : max(a, z - WINDOW + 1)]

    def windows(self, i: int, lane: int = 0) -> np.ndarray:
        """The hash of each window of text i."""
        a, z = self.range[i]
        return gram_hashes(self.h[lane][a:z], WINDOW)


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of true values."""
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _scan(docs: DataFrame) -> DataFrame:
    def work(it):
        for batch in batches(it):
            s = Scanned(batch.column("text"))
            n = [z - a for a, z in s.range]
            anchors = [np.unique(s.anchors(i)).view(np.int64) for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), *s.names(), pa.array(anchors, pa.list_(pa.int64()))], ["id", "n_words", "name", "check", "anchors"])

    return docs.mapInArrow(work, f"id {docs.schema['id'].dataType.simpleString()}, n_words long, name long, check long, anchors array<long>")


def _with_names(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, name, check, text) of documents whose id may be in wanted."""
    bitmap = docs.sparkSession.sparkContext.broadcast(row_filter(wanted, "id"))

    def work(it):
        for batch in it:
            b = batch.filter(pa.array(passes(bitmap.value, batch.column("hid").to_numpy())))
            for part in batches([b]) if b.num_rows else ():
                yield pa.RecordBatch.from_arrays([part.column("id"), *Scanned(part.column("text")).names(), part.column("text")], ["id", "name", "check", "text"])

    return docs.select("id", F.xxhash64("id").alias("hid"), "text").mapInArrow(work, f"id {docs.schema['id'].dataType.simpleString()}, name long, check long, text string")


def _windows(candidates: DataFrame) -> DataFrame:
    """(window, sure, block, lo, hi): hashes, in both lanes, of the windows whose anchor
    recurs, with the smallest and largest id of the block's documents that hold them. A
    slice of documents gives a window once for a block."""

    def work(it):
        for batch in batches(it):
            batch = batch.take(pc.sort_indices(batch.column("id")))
            s = Scanned(batch.column("text"))
            found = [], []
            for i, fps in enumerate(batch.column("anchors")):
                keep = np.isin(s.anchors(i), fps.values.to_numpy().view(np.uint64))
                for lane in (0, 1):
                    found[lane].append(s.windows(i, lane)[keep] if keep.any() else np.zeros(0, np.uint64))
            flat, sure, row = np.concatenate(found[0]), np.concatenate(found[1]), np.repeat(np.arange(len(found[0])), [len(x) for x in found[0]])
            block = batch.column("block").to_numpy()[row]
            order = np.lexsort((row, block, sure, flat))
            flat, sure, row, block = flat[order], sure[order], row[order], block[order]
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (sure[1:] != sure[:-1]) | (block[1:] != block[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(flat)) - 1 if len(first) else first
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays([pa.array(flat[first].view(np.int64)), pa.array(sure[first].view(np.int64)), pa.array(block[first]), ids.take(pa.array(row[first])), ids.take(pa.array(row[last]))], ["window", "sure", "block", "lo", "hi"])

    kind = candidates.schema["id"].dataType.simpleString()
    return candidates.select("id", "block", "text", "anchors").mapInArrow(work, f"window long, sure long, block int, lo {kind}, hi {kind}")


def _passages(owned: DataFrame) -> DataFrame:
    """(owner, words) from rows (id, text, windows): the longest runs of windows that
    the document owns. words are hashes, those of one lane after those of the other."""

    def work(it):
        for batch in batches(it):
            s = Scanned(batch.column("text"))
            owner, words = [], []
            for i, mine in enumerate(batch.column("windows")):
                a, z = s.range[i]
                if z - a < WINDOW:
                    continue
                keep = np.isin(s.windows(i), mine.values.to_numpy().view(np.uint64))
                for x, y in runs(keep):
                    owner.append(i)
                    words.append(b"".join(h[a + x : a + y + WINDOW - 1].tobytes() for h in s.h))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner, pa.int64())), pa.array(words, pa.binary())], ["owner", "words"])

    return owned.select("id", "text", "windows").mapInArrow(work, f"owner {owned.schema['id'].dataType.simpleString()}, words binary")


class PhraseAutomaton:
    """The tiles of passages (arrays of word hashes in two lanes, each with its owner's
    rank) in one Aho-Corasick automaton. A word is one character; characters may
    clash, as windows around hits are compared by 128 bits."""

    def __init__(self, passages: list[np.ndarray], owners: np.ndarray):
        import ahocorasick

        self.known = np.unique(np.concatenate([p[0] for p in passages])) if passages else np.zeros(0, np.uint64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        windows, sure, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for words, who in zip(passages, owners):
            text = self.symbols(words[0])
            for o in range(0, len(text) - TILE + 1, TILE):
                self.automaton.add_word(text[o : o + TILE])
            windows.append(gram_hashes(words[0], WINDOW))
            sure.append(gram_hashes(words[1], WINDOW))
            owner.append(np.full(len(windows[-1]), who))
        if passages:
            self.automaton.make_automaton()
        flat, check, who = np.concatenate(windows), np.concatenate(sure), np.concatenate(owner)
        order = np.lexsort((who, check, flat))
        flat, check, who = flat[order], check[order], who[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (check[1:] != check[:-1])
        self.windows, self.sure, self.owner = flat[new], check[new], who[new]
        #: Windows that share a hash in the first lane, at most.
        self.most = int(np.unique(self.windows, return_counts=True)[1].max(initial=0))

    def symbols(self, h: np.ndarray) -> str:
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        code = np.where(self.known[at] == h, at % 1_000_000 + 0x10000, 1) if len(self.known) else np.ones(len(h))
        return code.astype("<u4").tobytes().decode("utf-32-le")

    def cover(self, h: tuple[np.ndarray, np.ndarray], rank: int) -> np.ndarray:
        """Which words of a text lie in a window that an owner below the rank has."""
        n = len(h[0])
        if not len(self.windows) or n < WINDOW:
            return np.zeros(n, bool)
        last = np.array([at for at, _ in self.automaton.iter(self.symbols(h[0]))], np.int64)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.maximum(last + 1 - WINDOW, 0), 1)  # windows that hold the tile begin here
        np.add.at(edge, last - TILE + 2, -1)
        begin = np.flatnonzero(np.cumsum(edge[: n - WINDOW + 1]) > 0)
        if not len(begin):
            return np.zeros(n, bool)
        w, sure = (gram_hashes(x, WINDOW)[begin] for x in h)
        at, earlier = np.searchsorted(self.windows, w), np.zeros(len(w), bool)
        for shift in range(self.most):
            k = np.minimum(at + shift, len(self.windows) - 1)
            earlier |= (self.windows[k] == w) & (self.sure[k] == sure) & (self.owner[k] < rank)
        begin = begin[earlier]
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + WINDOW, -1)
        return np.cumsum(edge[:n]) > 0


def _streamed(candidates: DataFrame, passages: DataFrame, routes: DataFrame) -> DataFrame:
    """(id, name, check, removed): begins and ends of word ranges covered by passages of
    smaller ids. routes (block, owner) say whose passages a block needs."""
    kind = candidates.schema["id"].dataType
    arrow = to_arrow_type(kind)
    routed = routes.join(passages, "owner").select(F.col("block").alias("to"), "owner", "words")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, owners = left.column("id").to_pylist(), right.column("owner").to_pylist()
        rank = {x: i for i, x in enumerate(sorted({*ids, *owners}))}
        auto = PhraseAutomaton([np.frombuffer(x, np.uint64).reshape(2, -1) for x in right.column("words").to_pylist()], np.array([rank[x] for x in owners], np.int64))
        rows: tuple[list, ...] = ([], [], [], [])
        for batch in batches(left.select(["id", "name", "check", "text"]).to_batches()):
            s = Scanned(batch.column("text"))
            for i, me in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "name", "check")))):
                a, z = s.range[i]
                cover = auto.cover((s.h[0][a:z], s.h[1][a:z]), rank[me[0]])
                if cover.any():
                    for col, x in zip(rows, (*me, [x for pair in runs(cover) for x in pair])):
                        col.append(x)
        return pa.table([pa.array(rows[0], arrow), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.list_(pa.int64()))], ["id", "name", "check", "removed"])

    return candidates.select("block", "id", "name", "check", "text").groupBy("block").cogroup(routed.groupBy("to")).applyInArrow(work, f"id {kind.simpleString()}, name long, check long, removed array<long>")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (id, name, check, removed) for each document with repeats; name and check are
    128 bits of its words, removed has the begins and ends (word numbers, ends excluded) of the
    words covered by a window of 50 words that also starts in a document with a
    smaller id. Words are split at ASCII white space and compared as they stand.

    A null text has no words. A null id is neither smaller nor larger than any:
    such rows keep all and take nothing from others. Rows that share an id are
    documents of that id each, and take nothing from each other. Other columns
    are ignored.
    """
    d = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    real = d.where("id IS NOT NULL")
    both = ["name", "check"]
    with scratch() as own:
        scanned = materialize(_scan(real), "scanned")
        long_ones = scanned.where(F.col("n_words") >= WINDOW)
        first = long_ones.groupBy(*both).agg(F.min("id").alias("rep"))
        entered = materialize(long_ones.join(first, both).select("id", "rep", *both, "n_words", F.when(F.col("id") == F.col("rep"), F.col("anchors")).alias("anchors")), "entered")
        discard(scanned)
        copies = entered.where("id <> rep").select("id", *both, F.array(F.lit(0).cast("long"), F.col("n_words")).alias("removed"))
        anchors = entered.where("id = rep").select("id", *both, F.explode("anchors").alias("anchor"))
        recurring = anchors.groupBy("anchor").count().where("count > 1").select("anchor")
        suspect = materialize(anchors.join(recurring, "anchor").groupBy("id", *both).agg(F.collect_set("anchor").alias("anchors")), "suspect")
        size = real.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        candidates = _with_names(real, suspect).join(suspect, ["id", *both])
        block = F.pmod(F.xxhash64("id", "name"), F.lit(1 + size // block_bytes)).cast("int")
        candidates = candidates.withColumn("block", block).repartition("block").sortWithinPartitions("block")
        candidates = materialize(candidates, "candidates", compression="zstd")
        discard(suspect)
        release(docs.sparkSession)
        windows = materialize(_windows(candidates), "windows")
        shared = windows.groupBy("window", "sure").agg(F.min("lo").alias("owner"), F.max("hi").alias("last")).where("owner < last").select("window", "sure", "owner")
        shared = materialize(shared, "shared")
        owned = shared.groupBy("owner").agg(F.collect_list("window").alias("windows")).withColumnRenamed("owner", "id")
        passages = materialize(_passages(candidates.select("id", "text").join(owned, "id")), "passages", compression="zstd")
        routes = materialize(windows.join(shared, ["window", "sure"]).where("owner < hi").select("block", "owner").distinct(), "routes")
        for used in (windows, shared):
            discard(used)
        release(docs.sparkSession)
        removed = own.keep(materialize(copies.union(_streamed(candidates, passages, routes)).distinct(), "removed"))
    release(docs.sparkSession)
    return removed


def apply_spans(docs: DataFrame, removed: DataFrame, finish, schema: T.StructType, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """finish(record batch, removed lists) for all rows of docs, with the spans of repeated_spans().

    Rows without any are told by a bitmap and stay where they are; only the others
    are joined with their spans. finish gets the columns of docs in small batches
    and returns a record batch of the schema.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(row_filter(removed, "id"))
    names = docs.columns
    hid, name, check, of, of_name, of_check, spans = unused(names, "hash_id", "name", "check", "of_id", "of_name", "of_check", "removed")
    keyed = docs.withColumn(hid, F.xxhash64(id_col))

    def untouched(it):
        for batch in it:
            b = batch.filter(pa.array(~passes(bitmap.value, batch.column(hid).to_numpy()))).select(names)
            for part in batches([b], 1 << 20, text_col) if b.num_rows else ():
                yield finish(part, [[]] * part.num_rows)

    def named(it):
        for batch in it:
            b = batch.filter(pa.array(passes(bitmap.value, batch.column(hid).to_numpy()))).select(names)
            for part in batches([b], 1 << 20, text_col) if b.num_rows else ():
                yield pa.RecordBatch.from_arrays([*part.columns, *Scanned(part.column(text_col)).names()], [*names, name, check])

    def touched(it):
        for batch in it:
            for part in batches([batch], 1 << 20, text_col) if batch.num_rows else ():
                yield finish(part.select(names), [x or [] for x in part.column(spans).to_pylist()])

    plain = keyed.mapInArrow(untouched, schema)
    cut = removed.select(F.col("id").alias(of), F.col("name").alias(of_name), F.col("check").alias(of_check), F.col("removed").alias(spans)).hint("merge")
    rest = keyed.mapInArrow(named, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType()), T.StructField(check, T.LongType())]))
    rest = rest.join(cut, (F.col(id_col) == F.col(of)) & (F.col(name) == F.col(of_name)) & (F.col(check) == F.col(of_check)), "left").select(*names, spans)
    return plain.union(rest.mapInArrow(touched, schema))


def kept_words(text: str | None, removed: list[int]) -> list[bytes]:
    words = (text or "").encode().split()
    out, at = [], 0
    for a, z in zip(removed[::2], removed[1::2]):
        out += words[at:a]
        at = z
    return out + words[at:]


def cut_text(text: str | None, removed: list[int]) -> str | None:
    """The text without the removed words; white space before each goes with it."""
    if not removed or text is None:
        return text
    raw = text.encode()
    w = Words(pa.array([text]), "space")
    out, at = [], 0
    for a, z in zip(removed[::2], removed[1::2]):
        out.append(raw[at : (w.end[a - 1] if a else 0)])
        at = w.end[z - 1]
    return b"".join([*out, raw[at:]]).decode().lstrip(" \t\n\x0b\x0c\r")


def dedup_digests(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256) for each document."""
    d = docs.select("doc_id", "text")

    def finish(batch, removed):
        n, gone, sha = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), removed):
            kept = kept_words(text, spans)
            gone.append(sum(spans[1::2]) - sum(spans[::2]))
            n.append(len(kept) + gone[-1])
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = T.StructType([d.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return apply_spans(d, repeated_spans(d), finish, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs (with doc_id, text, n_chars) with the repeated words cut from the texts."""
    names = docs.columns

    def finish(batch, removed):
        texts = [cut_text(t, x) for t, x in zip(batch.column("text").to_pylist(), removed)]
        new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
        return pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names)

    return apply_spans(docs, repeated_spans(docs), finish, docs.schema)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: dedup_digests(table(spark, sf_dir, "documents")), "digests")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
own AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
hit AS (SELECT DISTINCT r, i + j AS i FROM (SELECT win.r, i, unnest(range(50)) AS j FROM win JOIN own USING (g) WHERE first < win.doc_id)),
gone AS (SELECT r, count(*) AS n, list(i) AS at FROM hit GROUP BY r),
words AS (SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS s FROM words ANTI JOIN hit USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)"""
