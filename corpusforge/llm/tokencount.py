"""Token counts; huge documents are encoded in overlapping chunks and spliced.

Two neighbouring chunks overlap, and both are encoded with offsets. They are
spliced at a place of the overlap that is a stable boundary of both:

- a single space between two characters that are no white space, where a
  pre-token starts whatever surrounds it, if both start a token there; or
- any place between two such characters, with no apostrophe in the three before
  it, if both have the same token before it and the same after it. Whether a
  pre-token starts there depends on the two characters alone, so both chunks and
  the whole text agree on it. If none starts, the tokens at both sides are parts
  of one run of merges, and a sequence of tokens is what merging gives exactly if
  each two neighbours are: the first merge over a seam would be one of the pair.

No place is taken inside a string that the library takes for an added token. Left
of the place the first chunk counts, from it on the second. Where an overlap has no
such place it is widened, and where the whole chunk has none, what follows the last
place of the first kind is encoded anew and twice as far: a place of the second kind
holds for the tokens at both its sides, not for a text that begins there. As what is
encoded anew doubles each time, the work stays in proportion to the text.

Defined results: a null or empty text has no tokens; special strings in texts
count as the library counts them by default; repeated rows are counted each;
no text is cut. The model must be a byte-level BPE by the common pattern.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm import common, tokens

BYTE_50K = "byte_bpe_50k.json"
#: Characters of a chunk, and of the overlap of two; texts of more bytes are spliced.
CHUNK, OVERLAP = 16_384, 128
#: No white space to Python, but to some libraries.
_DOUBTFUL = {"\u180e", "\u200b", "\ufeff"}


class Chunk:
    """The tokens of a stretch of a text, placed in that text."""

    def __init__(self, model, text: str, start: int, stop: int):
        self.found = model.encode(text[start:stop], add_special_tokens=False)
        self.start, self.ids = start, self.found.ids

    def at(self, p: int) -> int | None:
        """The token that covers character ``p`` of the text."""
        return self.found.char_to_token(p - self.start)

    def span(self, i: int) -> tuple[int, int]:
        a, b = self.found.token_to_chars(i)
        return self.start + a, self.start + b

    def seam(self, p: int) -> int | None:
        """The token that begins at ``p`` where another ends at ``p``; no character is split there."""
        i = self.at(p)
        return i if i and self.span(i)[0] == p and self.span(i - 1)[1] == p and self.span(i - 1)[0] < p else None


def _solid(c: str) -> bool:
    return not c.isspace() and c not in _DOUBTFUL


def splice(text: str, left: Chunk, right: Chunk, first: int, stop: int, added: list[str]) -> tuple[int, int, int, bool] | None:
    """The first common stable place from ``first`` on and before ``stop``, where ``left`` ends.

    Gives the place, the tokens of both that begin there, and whether it is of the first kind.
    """
    for p in range(first, stop - 1):
        if not _solid(text[p - 1]):
            continue
        space = text[p] == " " and _solid(text[p + 1])
        if not space and (not _solid(text[p]) or "'" in text[max(0, p - 3) : p]):
            continue
        i, j = left.seam(p), right.seam(p)
        if i is None or j is None:
            continue
        if any(text.find(a, max(0, p - len(a) + 1), p + len(a) - 1) >= 0 for a in added):
            continue
        if space or (left.ids[i] == right.ids[j] and left.span(i) == right.span(j) and left.ids[i - 1] == right.ids[j - 1]):
            return p, i, j, space
    return None


def count_spliced(model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, added: list[str] | None = None) -> int:
    """The number of tokens of a text of any length, about a chunk in memory at a time.

    ``model`` must give untrimmed offsets.
    """
    if added is None:
        added = [t.decode() for t in tokens.added_tokens(model)]
    total, begin, end = 0, 0, min(chunk, len(text))
    sure, before = 0, 0  # the last start that holds for any text from there on, and the tokens before it
    left, skipped = Chunk(model, text, begin, end), 0
    while end < len(text):
        width, found = overlap, None
        stop = min(len(text), end + chunk)
        while found is None and width < end - begin:
            right = Chunk(model, text, end - width, stop)
            found = splice(text, left, right, end - width + 1, end, added)
            width *= 4
        if found is None:  # no stable place in the chunk
            begin, end, total, skipped = sure, min(len(text), end + max(chunk, end - sure)), before, 0
            left = Chunk(model, text, begin, end)
            continue
        place, i, j, certain = found
        total += i - skipped
        if certain:
            sure, before = place, total
        begin, end, left, skipped = place, stop, right, j
    return total + len(left.ids) - skipped


def untrimmed(path: str):
    """The tokenizer with offsets that count a token's leading space."""
    from tokenizers import Tokenizer, processors

    model = Tokenizer.from_str(tokens.load_json(path).to_str())
    model.post_processor = processors.ByteLevel(trim_offsets=False)
    return model


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` (all columns by default) and ``n_tokens``."""

    def make():
        encoder, offset_model = tokens.json_encoder(path), untrimmed(path)
        added = [t.decode() for t in encoder.added]
        most = float("inf") if tokens.depends_on_neighbours(encoder.model) else chunk

        def run(texts: list[bytes]) -> list[list]:
            huge = [len(t) > most for t in texts]
            short = iter(encoder.encode([t for t, h in zip(texts, huge, strict=True) if not h]))
            return [[count_spliced(offset_model, t.decode(), chunk, overlap, added) if h else len(next(short)) // 4 for t, h in zip(texts, huge, strict=True)]]

        return run

    return common.map_text(df, text, keep, [("n_tokens", T.LongType())], make)


def op10_token_counts(spark, sf_dir: str, limit: int = 512) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.octet_length(common.text_or_empty()).cast("long").alias("n_bytes"))
    counted = count_tokens(docs, public_tokenizers.path(BYTE_50K), keep=["doc_id", "n_bytes"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
