"""Byte-level BPE by backtracking over longest token matches, and decoding by offsets.

Merging a pre-token gives the one sequence of tokens in which each two neighbours are
compatible: merging both together gives back the two. So the sequence is searched
instead of merged. One pass of an Aho-Corasick automaton finds the longest token that
begins at each character; from there on, tokens are tried from the longest down, along
a chain of their longest prefixes, and a place from which no compatible token leads
further is never tried again. Each place is left at most once for each token of a chain,
so time is in proportion to the text.

Two tokens are compatible if no merge crosses their seam. A merge of x and y crosses it
if x is the last part of the left token at some time of its making, y the first part of
the right one, and their merge comes before what makes either disappear. Of equal merges
the left one is made first. Answers are kept in a table of pairs.

The library's own pre-tokenizer cuts texts, after its added tokens; the ids of a unit of
text are remembered by its bytes (``corpusforge/llm/tokens.py``). Decoding gathers the
bytes of ids from one array by an offset table.

Defined results: a null or empty text has no ids and decodes to an empty text; strings of
added tokens in texts become those tokens, as the library has it by default; texts of any
length are encoded whole; repeated rows are encoded each; clashing column names get
underscores; an empty table gives an empty one. Bytes that are no UTF-8 decode to U+FFFD.
A model with dropout, prefixes, a normalizer or merges out of order is refused.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm import common, tokens

BYTE_50K = "byte_bpe_50k.json"
#: Answers that the table of pairs, and pre-tokens that the memo of ids, hold before they start anew.
PAIRS, KEPT = 1 << 18, 1 << 15


class PairModel:
    """Merges as what backtracking needs: an automaton, prefix chains and ends of lives."""

    def __init__(self, path: str):
        self.library = tokens.load_json(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges") or model.get("byte_fallback") or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} is no plain byte-level BPE")
        vocab = model["vocab"]
        self.rank, self.parts, self.size = {}, {}, {i: len(t) for t, i in vocab.items()}
        for n, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            if made in self.parts or any(x in self.parts and self.rank[self.parts[x]] >= n for x in (a, b)):
                raise ValueError(f"merge {n} of {path} is out of order")
            self.parts[made] = a, b
            self.rank[a, b] = n
        # what a token ends and begins with while it is made, each with the merge that ends it
        self.last = {i: self._lives(i, 1) for i in vocab.values()}
        self.first = {i: self._lives(i, 0) for i in vocab.values()}
        self.pairs: dict[int, bool] = {}
        self.ids_end = max(vocab.values()) + 1
        # a token that merging never gives is no candidate
        able = {t: i for t, i in vocab.items() if i not in self.parts or self._comes_about(i)}
        self.shorter = {i: next((able[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in able), None) for t, i in able.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in able.items():
            self.automaton.add_word(t, (len(t) - 1, i))
        self.automaton.make_automaton()
        self.ids: dict[str, array] = {}
        added = self.library.get_added_tokens_decoder()
        if tokens.depends_on_neighbours(self.library):
            raise ValueError(f"added tokens of {path} depend on their neighbours")
        self.added = {t.content: i for i, t in added.items()}
        # of strings that begin at one place the library takes the longest
        self.split = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None

    def _lives(self, token: int, side: int) -> list[tuple[int, float]]:
        end, out = float("inf"), []
        while True:
            out.append((token, end))
            if token not in self.parts:
                return out
            end = self.rank[self.parts[token]]
            token = self.parts[token][side]

    def _crossed(self, a: int, b: int, until: float) -> bool:
        """Whether a merge over the seam of two tokens comes before ``until``."""
        for x, x_end in self.last[a]:
            for y, y_end in self.first[b]:
                n = self.rank.get((x, y))
                if n is not None and n < until and n < x_end and n <= y_end:
                    return True
        return False

    def _comes_about(self, token: int) -> bool:
        a, b = self.parts[token]
        return not self._crossed(a, b, self.rank[a, b])

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[a * self.ids_end + b] = not self._crossed(a, b, float("inf"))
        return found

    def backtrack(self, piece: str) -> array:
        """The ids of one pre-token, written in byte characters."""
        n = len(piece)
        longest = [-1] * n
        for end, (back, i) in self.automaton.iter(piece):
            longest[end - back] = i  # ends grow, so the last is the longest
        size, shorter, pairs, ids_end = self.size, self.shorter, self.pairs, self.ids_end
        dead, out, at = bytearray(n + 1), array("I"), 0
        token, before = longest[0], -1
        while at < n:
            if token is None or token < 0:  # nothing leads on from here
                if before < 0:
                    raise ValueError("a text has a byte without a token")
                dead[at] = 1
                token = out.pop()
                before = out[-1] if out else -1
                at -= size[token]
                token = shorter[token]
                continue
            end = at + size[token]
            if dead[end]:
                token = shorter[token]
                continue
            if before >= 0:
                fit = pairs.get(before * ids_end + token)
                if not (self.compatible(before, token) if fit is None else fit):
                    token = shorter[token]
                    continue
            out.append(token)
            at, before = end, token
            if at < n:
                token = longest[at]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out, at = array("I"), 0
        for hit in self.split.finditer(text) if self.split else ():
            self._plain(text[at : hit.start()], out)
            out.append(self.added[hit.group()])
            at = hit.end()
        self._plain(text[at:], out)
        return out.tobytes()

    def _plain(self, text: str, out: array) -> None:
        if not text:
            return
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text):
            ids = self.ids.get(piece)
            if ids is None:
                ids = self.backtrack(piece)
                if len(self.ids) >= KEPT:
                    self.ids.clear()
                if len(piece) <= 64:
                    self.ids[piece] = ids
            out.extend(ids)


class PairEncoder(tokens.UnitEncoder):
    """Units of texts, each encoded by backtracking when it is first met."""

    def __init__(self, path: str, **more):
        self.pair_model = PairModel(path)
        super().__init__(self.pair_model.library, **more)

    def library(self, texts: list[bytes]) -> list[bytes]:
        return [self.pair_model.encode(t.decode()) for t in texts]

    def _learn(self, units: list[bytes]):
        return zip(units, self.library(units), strict=True)


@lru_cache(maxsize=2)
def encoder(path: str) -> PairEncoder:
    return PairEncoder(path)


@lru_cache(maxsize=2)
def offset_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens after one another, and where each id's begin and the last ends."""
    model = tokens.load_json(path)
    back = {c: b for b, c in enumerate(tokens.byte_characters())}
    written = {i: t for t, i in model.get_vocab().items()}
    parts = []
    for i in range(max(written) + 1):
        t = written.get(i, "")
        parts.append(bytes(back[c] for c in t) if all(c in back for c in t) else t.encode())
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def decode_ids(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bytes:
    data, starts = table
    sizes = starts[ids + 1] - starts[ids]
    ends = np.cumsum(sizes)
    if not len(ids):
        return b""
    return data[np.repeat(starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and ``ids``: an array of integers."""

    def make():
        run = encoder(path).encode
        return lambda texts: [[np.frombuffer(i, np.uint32).astype(np.int32) for i in run(texts)]]

    return common.map_text(df, text, keep, [("ids", T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns and ``decoded``: the text of the ids, special tokens included; null ids are none."""
    name = common.free_name(df, "decoded")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))

    def run(batches):
        table = offset_table(path)
        for batch in batches:
            row = batch.column(0)
            texts = []
            for some in row.field(ids):  # one row's ids at a time are numbers
                numbers = np.asarray(some.values) if some.is_valid else np.empty(0, np.int64)
                texts.append(decode_ids(numbers, table).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string())], names=["_row", name])

    return common.map_arrow(rows, run, T.StructType([rows.schema["_row"], T.StructField(name, T.StringType())])).select("_row.*", name)


def op12_pair_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    path = public_tokenizers.path(BYTE_50K)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    decoded = decode(encode(docs, path, keep=["doc_id"]), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
