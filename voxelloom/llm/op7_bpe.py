"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, worker_cache
from .words import batches

#: Unicode white space, as a character class.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Longest stretch that goes to the library at once, in characters.
PIECE = 1 << 16


def safe_pieces(text: str, size: int = PIECE):
    """Cuts a text before a white-space character that follows a character that
    isn't white space. No match of the usual byte-level patterns spans such a
    place, and none looks past it, so pieces encode on their own. A stretch
    without such a place is never cut."""
    if len(text) <= size:
        if text:
            yield text
        return
    edge, at = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])"), 0
    while len(text) - at > size:
        m = edge.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def load_encoding(rank_file: str, pattern: str):
    """The encoding of a rank file (base64 token and rank on each line), once a process."""
    import tiktoken

    key = ("tiktoken", rank_file, pattern)
    if key not in worker_cache():
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        worker_cache()[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return worker_cache()[key]


def encode(encoding, text: str | None) -> list[int]:
    ids: list[int] = []
    for piece in safe_pieces(text or ""):
        ids += encoding.encode_ordinary(piece)
    return ids


def bpe_round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>, decoded binary): each text's tokens, and the bytes
    that they stand for.

    A null or empty text has no ids. Repeated rows are encoded each by itself;
    other columns are ignored. rank_file must be readable on every executor.
    """

    def work(it):
        enc = load_encoding(rank_file, pattern)
        for batch in it:
            ids = [encode(enc, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode_bytes(x) for x in ids], pa.binary())], ["id", "ids", "decoded"])

    d = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    out = d.mapInArrow(work, f"id {d.schema['id'].dataType.simpleString()}, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", id_col)


def bpe_tokens(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, ids_sha256, decoded_sha256), see bpe_digests()."""
    return _digests(docs, rank_file, pattern, True)


def bpe_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """As bpe_round_trip(), with digests in place of ids and bytes: doc_id,
    n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256."""
    return _digests(docs, rank_file, pattern, False)


def _digests(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool) -> DataFrame:

    def work(it):
        enc = load_encoding(rank_file, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches(it, 1 << 20):
            n, a, b, all_ids = [], [], [], []
            for t in batch.column("text").to_pylist():
                ids = encode(enc, t)
                n.append(len(ids))
                if with_ids:
                    all_ids.append(np.array(ids, np.int32))
                a.append(sha(np.array(ids, "<u4").tobytes()))
                b.append(sha(enc.decode_bytes(ids)))
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(all_ids, pa.list_(pa.int32()))] * with_ids], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(work, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return bpe_digests(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
