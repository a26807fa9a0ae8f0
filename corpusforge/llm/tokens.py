"""What the three tokenising operators share: vocabularies, long texts, units.

Two kinds of places always start a pre-token of the byte-level pattern, whatever
surrounds them: the first of a run of white space, as every alternative that holds
white space begins with it and none reaches it from the left; and an ASCII mark
after an ASCII letter, as no alternative goes on from a letter to a mark. A text cut
there gives the ids of the whole text. Texts are left whole if they hold white space
outside ASCII next to which that fails, or a string that the library takes for an
added token.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: White space outside ASCII, and separators that libraries take differently; and what all of it begins with.
_RARE_BEGINS = [bytes([b]) for b in range(0x1C, 0x20)] + [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe1\xa0", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80"]
_RARE = rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8f\xa8-\xaf]|\x81[\x9f\xa0])|\xe3\x80\x80"
#: From one certain start of a pre-token to the next.
_UNIT = re.compile(rb"\s*+[^A-Za-z\s]*+(?:[A-Za-z]++(?:[\x00-\x08\x0e-\x1f0-9\x7f-\xff][^A-Za-z\s]*+)?+)*+")
_CUT = re.compile(rb"(?<=[!-~])[ \n]")
#: Longer texts are encoded in pieces of about this size.
PIECE_BYTES = 1 << 19


@lru_cache(maxsize=4)
def load_json(path: str):
    """The tokenizer of a JSON file, on one thread, as Spark spreads the work."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_characters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte.

    Printable Latin-1 stands for itself; the rest is moved up from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def load_ranks(path: str, pattern: str):
    """A ``tokenizers`` model with the ids of a rank file.

    Ranks name merged tokens, not merges: each way to put a token together from
    two others becomes a merge, ordered by the rank of what it makes. A unit that
    is a token itself is taken at once, as rank files mean it.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    written = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                merges.append((max(ranks[left], ranks[right]), token, left, right))
    merges = [(written[a], written[b]) for _, _, a, b in sorted(merges, key=lambda m: (ranks[m[1]], m[0]))]
    model = Tokenizer(models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    model.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return model


def added_tokens(model) -> list[bytes]:
    """The strings that the library looks for before any pre-token."""
    return [token.content.encode() for token in model.get_added_tokens_decoder().values()]


def depends_on_neighbours(model) -> bool:
    """Whether some added token takes white space along or must be a word of its own."""
    return any(t.lstrip or t.rstrip or t.single_word for t in model.get_added_tokens_decoder().values())


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, by the library alone.

    A text of more than ``piece`` bytes is encoded in pieces, so that what the
    library holds for a text is bounded; see the module for where it is left whole.
    """

    def __init__(self, model, piece: int = PIECE_BYTES):
        self.model, self.piece = model, piece
        self.added = added_tokens(model)
        self.rare = re.compile(_RARE)

    def whole(self, text: bytes) -> bool:
        """Whether a text has no places to cut it at."""
        if any(a in text for a in self.added):
            return True
        return any(b in text for b in _RARE_BEGINS) and self.rare.search(text) is not None

    def pieces(self, text: bytes) -> Iterator[bytes]:
        at = 0
        while len(text) - at > self.piece and (cut := _CUT.search(text, at + self.piece)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def library(self, texts: list[bytes]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        short = iter(self.library([t for t in texts if len(t) <= self.piece]))
        return [next(short) if len(t) <= self.piece else self.encode_long(t) for t in texts]

    def encode_long(self, text: bytes) -> bytes:
        if self.whole(text):
            return self.library([text])[0]
        return b"".join([self.library([piece])[0] for piece in self.pieces(text)])


class UnitEncoder(PieceEncoder):
    """The same, with the ids of each unit remembered by its bytes.

    Corpora repeat words, so most units were met before. The memo holds about
    ``most`` bytes and then starts anew; units over ``LONG`` bytes aren't kept.
    """

    LONG, TOGETHER = 200, 2000

    def __init__(self, model, most: int = 150 << 20, piece: int = PIECE_BYTES):
        super().__init__(model, piece)
        self.most, self.size, self.ids = most, 0, {}
        back = {c: b for b, c in enumerate(byte_characters())}
        self.lengths = np.zeros(max(model.get_vocab().values()) + 1, np.int64)
        for written, i in model.get_vocab().items():
            self.lengths[i] = sum(c in back for c in written)
        self.spaced = any(re.search(rb"\s", a) for a in self.added)

    def _learn(self, units: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Units with their ids. Those that white space parts from others are encoded together.

        As the tokens of a text cover its bytes in order, their lengths tell whose they are.
        """
        apart = [self.spaced or u[:1] not in (b" ", b"\n") or u[-1:].isspace() for u in units]
        alone = [u for u, a in zip(units, apart, strict=True) if a]
        yield from zip(alone, self.library(alone), strict=True)
        rest = [u for u, a in zip(units, apart, strict=True) if not a]
        for at in range(0, len(rest), self.TOGETHER):
            some = rest[at : at + self.TOGETHER]
            ids = np.frombuffer(self.library([b"".join(some)])[0], np.uint32)
            done, wanted = np.cumsum(self.lengths[ids]), np.cumsum([len(u) for u in some])
            cuts = np.searchsorted(done, wanted)
            if not np.array_equal(done[cuts], wanted):
                raise ValueError("units and their tokens disagree")
            raw, begin = ids.tobytes(), 0
            for unit, end in zip(some, (4 * (cuts + 1)).tolist(), strict=True):
                yield unit, raw[begin:end]
                begin = end

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return [i for some in self._some(texts) for i in some]

    def _some(self, texts: list[bytes]) -> Iterator[list[bytes]]:
        """Texts in groups of at most about one piece."""
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > self.piece:
                yield self._group(group)
                group, size = [], 0
            if len(text) > self.piece:
                yield [self.encode_long(text) if self.whole(text) else b"".join(self._group(list(self.pieces(text))))]
            else:
                group.append(text)
                size += len(text)
        if group:
            yield self._group(group)

    def _group(self, texts: list[bytes]) -> list[bytes]:
        if self.size > self.most:
            self.size, self.ids = 0, {}
        units = [None if self.whole(t) else _UNIT.findall(t) for t in texts]
        new = list(set().union(*(u for u in units if u is not None)).difference(self.ids))
        once = {}
        for unit, ids in self._learn(new):
            if len(unit) > self.LONG:
                once[unit] = ids
            else:
                self.ids[unit] = ids
                self.size += len(unit) + len(ids) + 150
        if once:
            get = lambda u: self.ids[u] if u in self.ids else once[u]
        else:
            get = self.ids.__getitem__
        return [self.library([t])[0] if u is None else b"".join(map(get, u)) for t, u in zip(texts, units, strict=True)]


@lru_cache(maxsize=2)
def json_encoder(path: str) -> UnitEncoder:
    return UnitEncoder(load_json(path))


@lru_cache(maxsize=2)
def ranks_encoder(path: str, pattern: str) -> UnitEncoder:
    return UnitEncoder(load_ranks(path, pattern))
