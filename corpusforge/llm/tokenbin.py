"""Token ids in compressed binary shards with a shared zstandard dictionary.

Every document's ids are compressed on their own, with a dictionary trained on a
bounded sample of documents. A shard is one binary value of about 4 MB: a header
with the hash of its dictionary and the width of an id, an index with the id,
offset, size and number of ids of each document, then the frames. A shard table
holds them in order (bucket, seq), with the ids before each within its bucket;
short documents are read by their index entry alone.

Defined results: null and empty texts are documents with the end id alone;
documents of one id follow one another by size and frame; null ids come first;
an empty table gives no shards and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm import common, tokens

BYTE_50K = "byte_bpe_50k.json"
MAGIC = b"CFIDS\x01"
END_ID = 0
SHARD_BYTES = 4 << 20
#: The dictionary is trained on about this many documents, this many bytes of each.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1000, 8192, 64 << 10
LEVEL = 1

_HEAD = struct.Struct("<6s32sBI")
_ENTRY = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_ids", "<u4")])


def _ids(encoder, texts: list[bytes], width: int) -> list[np.ndarray]:
    end = np.asarray([END_ID], "<u4")
    return [np.concatenate([np.frombuffer(raw, "<u4"), end]).astype(f"<u{width}") for raw in encoder.encode(texts)]


def train_dictionary(df: DataFrame, path: str, width: int, key: str = "doc_id", text: str = "text") -> bytes:
    """A dictionary from a bounded sample, picked by hash; empty where there is too little.

    The share of hashes that is taken follows from the number of rows, so no sort
    or single task sees more than the sample; the limit holds where ids repeat.
    """
    share = min(1.0, SAMPLE_DOCS / max(1, df.count()))
    below = int(share * 2**64) - 2**63
    hashed = F.xxhash64(F.col(key))
    sample = df.filter(hashed <= F.lit(min(below, 2**63 - 1))).limit(2 * SAMPLE_DOCS).select(common.text_or_empty(text).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.slices(batch.column(0)):
                ids = _ids(tokens.json_encoder(path), batch.column(0).slice(a, b - a).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([pa.array([i.tobytes()[:SAMPLE_BYTES] for i in ids], pa.binary())], names=["ids"])

    samples = [bytes(r["ids"]) for r in common.map_arrow(sample, run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack_shard(entries: list[tuple[int | None, int, bytes]], dictionary: bytes, width: int) -> bytes:
    index = np.zeros(len(entries), _ENTRY)
    at = 0
    for row, (doc_id, n_ids, frame) in zip(index, entries, strict=True):
        row["doc_id"], row["known"], row["offset"], row["size"], row["n_ids"] = doc_id or 0, doc_id is not None, at, len(frame), n_ids
        at += len(frame)
    return b"".join([_HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), width, len(entries)), index.tobytes(), *(f for _, _, f in entries)])


class Shard:
    """Reads a shard's index, and each document's ids by it."""

    def __init__(self, blob, dictionary: bytes):
        self.blob = memoryview(blob)
        magic, digest, self.width, n = _HEAD.unpack_from(self.blob)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard of ids, or another dictionary's")
        self.index = np.frombuffer(self.blob, _ENTRY, n, _HEAD.size)
        self.frames = _HEAD.size + self.index.nbytes
        self.open = _decompressor(dictionary)

    def ids(self, i: int) -> np.ndarray:
        e = self.index[i]
        start = self.frames + int(e["offset"])
        raw = self.open.decompress(self.blob[start : start + int(e["size"])])
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i, e in enumerate(self.index):
            ids = self.ids(i)
            if len(ids) != e["n_ids"]:
                raise ValueError("the index and the frame disagree")
            yield int(e["doc_id"]) if e["known"] else None, ids


@lru_cache(maxsize=2)
def _compressor(dictionary: bytes):
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


@lru_cache(maxsize=2)
def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


_SHARDS = "bucket int, seq int, first_doc long, last_doc long, n_docs long, n_ids long, before long, blob binary"


def write_ids(df: DataFrame, out: str, path: str, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Write ``out``/shards and ``out``/dictionary, in ascending order of the key."""
    spark = df.sparkSession
    width = 2 if tokens.load_json(path).get_vocab_size() <= 1 << 16 else 4
    dictionary = train_dictionary(df, path, width, key, text)
    spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{out}/dictionary")
    ranges = common.Ranges(df, key, common.partitions(spark))
    rows = df.select(common.text_or_empty(text).cast("binary").alias("t"), F.col(key).cast("long").alias("k"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = _compressor(dictionary).compress
        for batch in batches:
            for a, b in common.slices(batch.column(0)):
                ids = _ids(tokens.json_encoder(path), batch.column(0).slice(a, b - a).to_pylist(), width)
                keys = batch.column(1).slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ranges.bucket(keys)), keys, pa.array([len(i) for i in ids], pa.int64()), pa.array([compress(i.tobytes()) for i in ids], pa.binary())],
                    names=["b", "k", "n", "frame"],
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bucket, seq, before = [], 0, None, 0, 0

        def shard():
            known = [k for k, _, _ in held if k is not None]
            n = sum(n for _, n, _ in held)
            values = (bucket, seq, min(known, default=None), max(known, default=None), len(held), n, before, pack_shard(held, dictionary, width))
            kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary())
            return n, pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[f.split()[0] for f in _SHARDS.split(", ")])

        for batch in batches:
            for b, k, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (b != bucket or size + len(frame) > shard_bytes):
                    total, done = shard()
                    yield done
                    held, size, seq, before = [], 0, seq + 1, before + total
                if b != bucket:
                    bucket, seq, before = b, 0, 0
                held.append((k, n, frame))
                size += len(frame)
        if held:
            yield shard()[1]

    frames = common.map_arrow(rows, encode, "b int, k long, n long, frame binary")
    ordered = common.by_bucket(frames, "b", ranges.count).sortWithinPartitions("b", F.asc_nulls_first("k"), "n", "frame")
    common.map_arrow(ordered, pack, _SHARDS).write.option("compression", "none").parquet(f"{out}/shards")


def _dictionary(spark, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])


def read_ids(spark, path: str, fn, schema: str) -> DataFrame:
    """``fn(doc_id, start, ids)`` for each document, in the files' order within a shard.

    ``start`` counts the ids of all documents before. Sums by bucket are as many
    as there were partitions, so their running total is broadcast.
    """
    dictionary = _dictionary(spark, path)
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/shards")
    sums = shards.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    bases = sums.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = shards.join(F.broadcast(bases), "bucket").select((F.col("base") + F.col("before")).alias("start"), "blob")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                for doc_id, ids in Shard(blob.as_buffer(), dictionary).documents():
                    out.append(fn(doc_id, start, ids))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return common.map_arrow(placed, run, schema)


def read_document(spark, path: str, doc_id: int) -> list[list[int]]:
    """The ids of each document with this id: shards are pruned by their id ranges."""
    dictionary = _dictionary(spark, path)
    found = spark.read.schema(_SHARDS).parquet(f"{path}/shards").filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).orderBy("bucket", "seq")
    out = []
    for row in found.select("blob").toLocalIterator():
        shard = Shard(row["blob"], dictionary)
        out += [shard.ids(i).tolist() for i in np.flatnonzero((shard.index["doc_id"] == doc_id) & (shard.index["known"] == 1))]
    return out


def _digest(doc_id, start, ids):
    return doc_id, start, len(ids), zlib.crc32(ids.tobytes())


def op8_token_binary(spark, sf_dir: str) -> DataFrame:
    out = common.fresh_path(spark, "ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, public_tokenizers.path(BYTE_50K))
    return read_ids(spark, out, _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
