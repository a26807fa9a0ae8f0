"""Byte-level BPE: ids of whole texts, their offsets, and texts of ids.

Defined results: a null text counts as empty and has no ids; equal texts have
equal ids; texts of any length are encoded whole; repeated rows and clashing
column names pass through (added columns get underscores where a name is taken).
Ids that the vocabulary lacks raise ``KeyError``-like ``IndexError`` on decoding.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm import common, tokens

MULTI_50K = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: the byte table in reverse."""
    model = tokens.load_ranks(path, public_tokenizers.PATTERN)
    back = {c: b for b, c in enumerate(tokens.byte_characters())}
    table = [b""] * model.get_vocab_size()
    for written, i in model.get_vocab().items():
        table[i] = bytes(back[c] for c in written)
    return table


def char_begins(text: bytes) -> np.ndarray:
    """Whether a character begins at each byte position, and True for the end."""
    return np.append((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, True)


def offsets(ids: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """First and past-the-last character of each token, as pairs.

    A byte position is mapped to the number of characters that begin before it.
    Tokens that share a split character all cover it: one that begins inside of it
    starts at that character, and one that ends inside of it ends after it.
    """
    size = sizes[np.frombuffer(ids, "<u4")]
    ends = np.cumsum(size)
    starts = ends - size
    begins = char_begins(data)
    before = np.concatenate([[0], np.cumsum(begins[:-1])])
    return np.column_stack([before[starts] - ~begins[starts], before[ends]]).astype("<u4")


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, with_offsets: bool = False) -> DataFrame:
    """``keep`` (all columns by default) and ``ids``: little-endian unsigned 32-bit integers.

    ``with_offsets`` adds ``offsets``: such integers too, two for each token, its
    first and its past-the-last character.
    """
    more = [("ids", T.BinaryType())]
    if with_offsets:
        more.append(("offsets", T.BinaryType()))

    def make():
        encoder = tokens.ranks_encoder(path, public_tokenizers.PATTERN)
        sizes = np.asarray([len(t) for t in token_bytes(path)], np.int64) if with_offsets else None

        def run(texts: list[bytes]) -> list[list]:
            ids = encoder.encode(texts)
            if not with_offsets:
                return [ids]
            return [ids, [offsets(i, t, sizes).tobytes() for i, t in zip(ids, texts, strict=True)]]

        return run

    return common.map_text(df, text, keep, more, make)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns and ``decoded``: the bytes of the ids, joined before any reading as text.

    Characters split between tokens are whole again in the joined bytes.
    """

    def make():
        get = token_bytes(path).__getitem__
        return lambda each: [[b"".join(map(get, np.frombuffer(i, "<u4").tolist())) for i in each]]

    return common.map_text(df, ids, None, [("decoded", T.BinaryType())], make)


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document, of what they decode to, and of the tokens' places."""
    path = public_tokenizers.path(MULTI_50K)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    decoded = decode(encode(docs, path, keep=["doc_id"], with_offsets=True), path)
    return decoded.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2("offsets", 256).alias("offsets_sha256"),
    )
