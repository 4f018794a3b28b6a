"""Token ids in directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of
every id and a bitmap: does a second one follow? Level 1 holds the second
chunks of those ids, and so on. A directory of bit counts, one entry for each
512 bits, gives the rank of a set bit and with it the place of the next chunk,
so any token is read by a few lookups, without decoding its neighbours.

Segments (about a million tokens of whole documents, in ascending document
order) are rows of a Parquet table, so any Hadoop file system and its commit
protocol serve: part, seq (their order), segment (both in one number), n_tokens,
doc_ids, payload. Each is a row group of its own, so that a reader which asks for
some of them skips the others by their statistics.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, settled, table, worker_cache
from .op7_bpe import SPACE
from .words import Words, batches, span_hashes, utf8

MAGIC, BLOCK = b"VDAC1", 512
SEGMENT_TOKENS = 1 << 20
#: Segments that tokens_at() asks Parquet for by number; more of them are found by a join.
ASKED = 200
#: Options of the written table: a row group for each segment.
FORMAT = {"compression": "none", "parquet.block.row.count.limit": "1", "parquet.block.size": "1048576", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1"}
MEMO = 1_200_000  # stretches to remember in a process, about 150 bytes each


def encode_segment(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The payload of a segment: ids (unsigned 32-bit), and where each document ends among them."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest >> np.uint32(8)
        follows = more > 0
        chunk = (rest & np.uint32(255)).astype(np.uint8)
        if not follows.any():
            levels.append((chunk, b"", b""))
            break
        bits = np.packbits(follows, bitorder="little")
        padded = np.zeros(-(-len(follows) // BLOCK) * BLOCK, bool)
        padded[: len(follows)] = follows
        counts = padded.reshape(-1, BLOCK).sum(1)
        levels.append((chunk, bits.tobytes(), np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4").tobytes()))
        rest = more[follows]
    out = [MAGIC, struct.pack("<BIQ", len(levels), len(ends), len(ids)), ends.astype("<u8").tobytes()]
    for chunk, bits, ranks in levels:
        out += [struct.pack("<QQQ", len(chunk), len(bits), len(ranks)), chunk.tobytes(), bits, ranks]
    return b"".join(out)


class Segment:
    """Reads a payload: segment[i] is token i, segment.doc(k) the tokens of document k."""

    def __init__(self, payload: bytes):
        if payload[:5] != MAGIC:
            raise ValueError("not a segment")
        n_levels, n_docs, self.n_tokens = struct.unpack_from("<BIQ", payload, 5)
        at = 5 + struct.calcsize("<BIQ")
        self.ends = np.frombuffer(payload, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self.levels = []
        for _ in range(n_levels):
            a, b, c = struct.unpack_from("<QQQ", payload, at)
            at += 24
            self.levels.append((np.frombuffer(payload, np.uint8, a, at), np.frombuffer(payload, np.uint8, b, at + a), np.frombuffer(payload, "<u4", c // 4, at + a + b)))
            at += a + b + c

    def __len__(self) -> int:
        return self.n_tokens

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            out |= int(chunk[i]) << (8 * k)
            if not len(bits) or not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK * BLOCK
            before = int.from_bytes(bits[first >> 3 : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - first)) - 1)
            i = int(ranks[i // BLOCK]) + before.bit_count()
        return out

    def all(self) -> np.ndarray:
        """All tokens: each level scattered to the ids that reach it."""
        out = np.zeros(self.n_tokens, np.uint32)
        where = np.arange(self.n_tokens)
        for k, (chunk, bits, _) in enumerate(self.levels):
            out[where] |= chunk.astype(np.uint32) << np.uint32(8 * k)
            if len(bits):
                where = where[np.unpackbits(bits, count=len(where), bitorder="little").astype(bool)]
        return out

    def doc(self, k: int) -> list[int]:
        return [self[i] for i in range(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))]


class ChunkEncoder:
    """Encodes texts with the tokenizers library.

    Texts are cut where ASCII white space begins, which byte-level patterns never
    match across. Each distinct stretch goes to the library once while it is
    remembered (by 128 bits of its bytes); new ones go there in long rows, and
    the tokens' byte lengths tell where each one ends. Texts with other white
    space or the string of an added token, where such a cut could matter, go to the
    library whole. Such strings become their tokens, as in the library's own call;
    with `literal` they are ordinary text.
    """

    def __init__(self, file: str, literal: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = literal
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.first_bytes = np.array(sorted({0xC2, 0xE1, 0xE2, 0xE3} | {t.encode()[0] for t in added}), np.uint8)
        self.other_space = re.compile("[" + SPACE.replace("\\t-\\r ", "") + "]").search
        # A byte-level vocabulary writes each byte as one character.
        self.length = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.length[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[int, int] = {}
        self.count, self.offset, self.pool, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0
        self.check = np.zeros(0, np.uint64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: list[int], checks: np.ndarray, stretches: list[bytes]) -> np.ndarray:
        white = b" \t\n\x0b\x0c\r"
        inner = [i for i, c in enumerate(stretches) if c[0] in white and c[-1] not in white]
        held, found, counts = set(inner), [], []
        for lo in range(0, len(inner), 5_000):
            some = [stretches[i] for i in inner[lo : lo + 5_000]]
            found += self._library([b"".join(some).decode()])
            at = np.searchsorted(np.cumsum(self.length[found[-1]]), np.cumsum(list(map(len, some)))) + 1
            counts.append(np.diff(at, prepend=0))
        rest = [i for i in range(len(stretches)) if i not in held]
        single = self._library([stretches[i].decode() for i in rest])
        count = np.concatenate([*counts, np.array([len(x) for x in single], np.int64)])
        number = np.empty(len(hashes), np.int64)
        number[inner + rest] = np.arange(len(hashes)) + len(self.count)
        self.number.update(zip(hashes, number.tolist()))
        self.count = np.concatenate([self.count, count])
        self.check = np.concatenate([self.check, checks[np.array(inner + rest, np.int64)]])
        self.offset = np.concatenate([self.offset, self.used + np.cumsum(count) - count])
        new = int(count.sum())
        if self.used + new > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * new + (1 << 16), np.uint32)])
        self.pool[self.used : self.used + new] = np.concatenate(found + single)
        self.used += new
        return number

    def _cut(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, where each text ends among them) of texts without other white space."""
        w = Words(column, "space")
        n = len(w.n)
        # A stretch ends with each word, and one of white space alone ends a text.
        tail = np.where(w.n > 0, w.end[np.maximum(w.ptr[1:] - 1, 0)] if len(w) else 0, w.at[:-1]) < w.at[1:]
        ends = np.insert(w.end, w.ptr[1:][tail], w.at[1:][tail])
        ptr = w.ptr + np.concatenate([[0], np.cumsum(tail)])
        begins = np.concatenate([[0], ends[:-1]])[: len(ends)]
        h, check = (span_hashes(w.data, begins, ends, lane) for lane in (0, 1))
        if len(self.number) > MEMO:
            self._forget()
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        if (check[first][back] != check).any():  # different stretches of one hash
            parts = self._library([t or "" for t in column.to_pylist()])
            return np.concatenate(parts), np.cumsum([len(x) for x in parts])
        known = lambda: np.fromiter(map(self.number.get, distinct.tolist(), itertools.repeat(-1)), np.int64, len(distinct))
        number = known()
        old = number >= 0
        if (self.check[number[old]] != check[first[old]]).any():
            self._forget()
            number = known()
        new = np.flatnonzero(number < 0)
        if len(new):
            at = first[new]
            number[new] = self._learn(distinct[new].tolist(), check[at], [w.data[a:z].tobytes() for a, z in zip(begins[at].tolist(), ends[at].tolist())])
        which = number[back]
        count = self.count[which]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(self.offset[which] - upto[:-1], count) + np.arange(upto[-1])]
        return ids, upto[ptr[1:]] if n else np.zeros(0, np.int64)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts of an Arrow column, where each text ends among them); nulls are empty."""
        data, _ = utf8(column)
        odd: dict[int, np.ndarray] = {}
        if np.isin(data, self.first_bytes).any():
            for i, text in enumerate(column.to_pylist()):
                if text and (self.other_space(text) or (self.added and self.added.search(text))):
                    odd[i] = self._library([text])[0]
        if not odd:
            return self._cut(column)
        plain = np.array([i not in odd for i in range(len(column))])
        ids, ends = self._cut(column.filter(pa.array(plain)))
        parts = iter(np.split(ids, ends[:-1]) if len(ends) else ())
        out = [odd[i] if i in odd else next(parts) for i in range(len(column))]
        return np.concatenate(out), np.cumsum([len(x) for x in out])


def chunk_encoder(file: str, literal: bool = False) -> ChunkEncoder:
    key = ("tokenizers", file, literal)
    if key not in worker_cache():
        worker_cache()[key] = ChunkEncoder(file, literal)
    return worker_cache()[key]


def dac_segments(docs: DataFrame, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS, literal: bool = False) -> DataFrame:
    """Segments of all documents in ascending order of their ids; write them with
    the options of FORMAT. A null text is empty and has the end id alone; null
    ids come first; rows that share an id are ordered by the text's checksum.
    """

    def work(it):
        part, seq, held = TaskContext.get().partitionId(), 0, []
        size, encoder = 0, chunk_encoder(tokenizer_file, literal)

        def flush():
            ends = np.cumsum(np.concatenate([n for _, n, _ in held]))
            payload = encode_segment(np.concatenate([x for x, _, _ in held]), ends)
            ids = pa.concat_arrays([i for _, _, i in held])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([part << 32 | seq], pa.int64()), pa.array([int(ends[-1])], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([payload], pa.binary())], ["part", "seq", "segment", "n_tokens", "doc_ids", "payload"])

        for batch in batches(it, 4 << 20):
            ids, ends = encoder.encode(batch.column("text"))
            held.append((np.insert(ids, ends, np.uint32(end_id)), np.diff(ends, prepend=0) + 1, batch.column("id")))
            size += len(ids)
            if size >= segment_tokens:
                yield flush()
                seq, held, size = seq + 1, [], 0
        if held:
            yield flush()

    d = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text", f"crc32(coalesce(`{text_col}`, '')) AS crc")
    kind = d.schema["id"].dataType.simpleString()
    d = d.repartitionByRange("id", "crc").sortWithinPartitions("id", "crc").select("id", "text")
    return d.mapInArrow(work, f"part int, seq int, segment long, n_tokens long, doc_ids array<{kind}>, payload binary")


def segment_starts(segments: DataFrame) -> DataFrame:
    """(part, seq, base): tokens before each segment. Parts add up theirs, so that a
    single task orders a row for each part alone."""
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = segments.select("part", "seq", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("base"))
    return within.join(parts, "part").select("part", "seq", (F.col("base") + F.col("first")).alias("base"))


def read_back(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of a table of segments, and ids on demand."""
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def work(it):
        for batch in it:
            cols = [batch.column(c) for c in ("part", "seq", "doc_ids", "payload")]
            for k in range(batch.num_rows):
                s = Segment(cols[3][k].as_py())
                ids, ends = s.all().astype("<u4"), s.ends
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends.tolist())]
                n = len(ends)
                out = [pa.array(np.full(n, cols[0][k].as_py(), np.int32)), pa.array(np.full(n, cols[1][k].as_py(), np.int32)), cols[2][k].values, pa.array(begins), pa.array(ends - begins), pa.array(crc, pa.int64())]
                names = ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([begins, ends[-1:]]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    rows = segments.select("part", "seq", "doc_ids", "payload").mapInArrow(work, f"part int, seq int, doc_id {kind}, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    out = rows.join(segment_starts(segments), ["part", "seq"])
    return out.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def write_dac(docs: DataFrame, tokenizer_file: str, path: str, **options) -> None:
    dac_segments(docs, tokenizer_file, **options).write.options(**FORMAT).parquet(path)


def tokens_at(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Random access: for rows (doc_id, offset) of wanted, the token there; null past the document's end.

    The ids of all segments are read to find those that hold a wanted document. Up to
    ASKED of them, Parquet is asked for these by number and skips the other row
    groups; more are picked by a join. Of a payload only the bytes of the wanted
    tokens are looked at. Unknown documents give no row; a document that several
    rows share an id with gives a row for each.
    """
    kind = wanted.schema["doc_id"].dataType.simpleString()
    where = segments.select("segment", F.posexplode("doc_ids").alias("k", "doc_id"))
    hits = wanted.select("doc_id", "offset").join(where, "doc_id").groupBy("segment").agg(F.collect_list(F.struct("doc_id", "k", "offset")).alias("asked"))
    few = [r[0] for r in hits.select("segment").limit(ASKED + 1).collect()]
    payloads = segments.select("segment", "payload")
    if len(few) <= ASKED:
        payloads = payloads.where(" OR ".join(f"segment = {x}" for x in few) or "segment < 0")

    def work(it):
        for batch in it:
            rows = []
            for payload, asked in zip(batch.column("payload"), batch.column("asked").to_pylist()):
                s = Segment(payload.as_py())
                for a in asked:
                    begin = int(s.ends[a["k"] - 1]) if a["k"] else 0
                    at = begin + a["offset"]
                    rows.append((a["doc_id"], a["offset"], s[at] if 0 <= a["offset"] and at < s.ends[a["k"]] else None))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column("asked").type.value_type.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["doc_id", "offset", "token"])

    return payloads.join(hits, "segment").select("payload", "asked").mapInArrow(work, f"doc_id {kind}, offset long, token long")


def op2_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    segments = dac_segments(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"))
    return settled(lambda: read_back(materialize(segments, "dac", **FORMAT)), "digests")
