"""Documents cut into chunks along their block tree, under a tokenizer's budget.

A markdown text is a tree of headings whose leaves are blocks: paragraphs, code between
fences, and tables. A table's rows are written out as triplets, ``row, column = value``, so
that each says by itself what it means, wherever a table is cut. A chunk never crosses a
heading and begins with its headings, a line each; where these alone would take more than
half of the budget, the outermost are left out of the text (not of ``headings``).

A block that fits is a chunk; with ``merge_peers`` blocks under the same headings are packed
as long as they fit. A block that doesn't fit is split at what it is made of: a table at
rows, a row at cells, a paragraph at lines, then sentences, then words; only a word over
the budget is cut by characters. Each level is entered for the part alone that needs it.

Tokens are counted by a callable from texts to numbers, made once in each task; pieces are
counted with the white space before them and added up, which is what a tokenizer gives
whose tokens never go on after a letter or mark into white space. ``word_counter`` stands in where no tokenizer is at hand.

Defined results: null and blank texts give no chunks; a heading without blocks gives none;
a table without a line of dashes under its first row has columns named by number; empty
cells give no triplet; cells beyond the header are named by number; blocks keep their order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from corpusforge.session import ship

Counter = Callable[[list[str]], list[int]]

_WORD = re.compile(r"\w+|[^\w\s]")
_HEADING = re.compile(r"(#{1,6})\s+(\S.*)")
_FENCE = re.compile(r"\s*(```|~~~)")
_DASHES = re.compile(r"\s*:?-+:?\s*")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+")


def word_counter() -> Counter:
    return lambda texts: [len(_WORD.findall(t)) for t in texts]


def json_counter(path: str) -> Callable[[], Counter]:
    """Counts of a ``tokenizers`` file, which all tasks reach by this path."""

    def make() -> Counter:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]

    return make


@dataclass
class Block:
    kind: str  # text, code or table
    lines: list[str]


@dataclass
class Section:
    """One heading's own blocks, with the headings above it and itself."""

    headings: list[str]
    blocks: list[Block] = field(default_factory=list)


def _cells(line: str) -> list[str]:
    inner = line.strip()[1:]
    inner = inner[:-1] if inner.endswith("|") and not inner.endswith("\\|") else inner
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", inner)]


def parse(text: str) -> list[Section]:
    """The sections of a text in order; those without blocks are left out."""
    path: list[tuple[int, str]] = []
    sections = [Section([])]
    held: Block | None = None
    fence = ""

    def add(kind: str, line: str) -> None:
        nonlocal held
        if held is None or held.kind != kind:
            held = Block(kind, [])
            sections[-1].blocks.append(held)
        held.lines.append(line)

    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence:
            add("code", line)
            if mark and mark[1] == fence:
                fence, held = "", None
        elif mark:
            fence, held = mark[1], None
            add("code", line)
        elif heading := _HEADING.fullmatch(line.rstrip()):
            level = len(heading[1])
            path = [(n, t) for n, t in path if n < level] + [(level, heading[2].strip())]
            sections.append(Section([t for _, t in path]))
            held = None
        elif not line.strip():
            held = None
        elif line.lstrip().startswith("|"):
            add("table", line)
        else:
            add("text", line.strip())
    return [s for s in sections if s.blocks]


def triplets(lines: list[str]) -> list[list[str]]:
    """The triplets of each row of a table."""
    rows = [_cells(x) for x in lines]
    named = len(rows) > 1 and all(_DASHES.fullmatch(c) for c in rows[1])
    header = rows[0] if named else []
    name = lambda j: header[j] if j < len(header) and header[j] else str(j + 1)
    out = []
    for row in rows[2:] if named else rows:
        label, rest = (row[0], range(1, len(row))) if len(row) > 1 else ("", range(1))
        found = [f"{label}, {name(j)} = {row[j]}" if label else f"{name(j)} = {row[j]}" for j in rest if row[j]]
        if not found and label:
            found = [f"{name(0)} = {label}"]
        out.append(found)
    return [r for r in out if r]


# --- cutting -------------------------------------------------------------------


@dataclass
class Piece:
    """Part of a block, and how it is joined to the part before it."""

    text: str
    glue: str
    kind: str


def _finer(piece: Piece) -> list[Piece] | None:
    """What a piece is made of, one level down; none where it is one word."""
    if piece.kind == "row":
        parts = piece.text.split("\x00")
        return [Piece(p, ". ", "line") for p in parts] if len(parts) > 1 else _finer(Piece(piece.text, piece.glue, "line"))
    for kind, cut, glue in (("block", lambda t: t.split("\n"), "\n"), ("line", _SENTENCE.split, " "), ("sentence", str.split, " ")):
        if piece.kind == kind:
            parts = [p for p in cut(piece.text) if p.strip()]
            below = {"block": "line", "line": "sentence", "sentence": "word"}[kind]
            return [Piece(p, glue, below) for p in parts] if len(parts) > 1 else _finer(Piece(piece.text, piece.glue, below))
    return None


def _shown(piece: Piece) -> str:
    return piece.text.replace("\x00", ". ") if piece.kind == "row" else piece.text


def _pack(pieces: list[Piece], room: int, count: Counter) -> Iterator[tuple[str, int]]:
    """Texts of at most ``room`` tokens, and their numbers of tokens; pieces in order, as many as fit."""
    held, size = "", 0
    alone = count([_shown(p) for p in pieces])
    joined = count([p.glue + _shown(p) for p in pieces])
    for piece, n, more in zip(pieces, alone, joined, strict=True):
        if held and not piece.glue[0].isspace():  # marks may join with what is before them
            more = count([held + piece.glue + _shown(piece)])[0] - size
        if held and size + more <= room:
            held, size = held + piece.glue + _shown(piece), size + more
            continue
        if held:
            yield held, size
            held, size = "", 0
        if n <= room:
            held, size = _shown(piece), n
        elif (parts := _finer(piece)) is not None:
            yield from _pack(parts, room, count)
        else:
            yield from _characters(piece.text, room, count)
    if held:
        yield held, size


def _characters(word: str, room: int, count: Counter) -> Iterator[tuple[str, int]]:
    """A word in as few parts of at most ``room`` tokens as halving finds; a character is never cut."""
    while word:
        low, high = 1, len(word)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if count([word[:mid]])[0] <= room else (low, mid - 1)
        yield word[:low], count([word[:low]])[0]
        word = word[low:]


def chunks_of(text: str, budget: int, count: Counter, merge_peers: bool = False) -> Iterator[tuple[list[str], str, str, int]]:
    """(headings, text, kind, tokens) of each chunk of a text."""
    for section in parse(text):
        shown = list(section.headings)
        while shown and 2 * count(["\n".join(shown) + "\n"])[0] > budget:
            shown.pop(0)
        head = "".join(f"{t}\n" for t in shown)
        used = count([head])[0] if head else 0
        groups: list[tuple[str, list[Piece]]] = []
        for block in section.blocks:
            if block.kind == "table":
                pieces = [Piece("\x00".join(r), "\n", "row") for r in triplets(block.lines)]
            else:
                pieces = [Piece("\n".join(block.lines), "\n\n", "block")]
            if pieces and merge_peers and groups:
                kind, before = groups[-1]
                pieces[0].glue = "\n\n"
                groups[-1] = (kind if kind == block.kind else "mixed", before + pieces)
            elif pieces:
                groups.append((block.kind, pieces))
        for kind, pieces in groups:
            for body, n in _pack(pieces, max(1, budget - used), count):
                yield section.headings, head + body, kind, used + n


def block_chunks(docs: DataFrame, key: str = "doc_id", column: str = "text", max_tokens: int = 512, counter: Callable[[], Counter] = word_counter, merge_peers: bool = False) -> DataFrame:
    """(file_id, chunk_index, headings, text, kind, tokens) of each document's chunks."""
    ship(docs.sparkSession)
    schema = f"file_id {dict(docs.dtypes)[key]}, chunk_index int, headings array<string>, text string, kind string, tokens int"

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter()
        for pdf in frames:
            out = [(ident, i, *c) for ident, value in zip(pdf[key], pdf[column], strict=True) for i, c in enumerate(chunks_of(value or "", max_tokens, count, merge_peers))]
            yield pd.DataFrame(out, columns=["file_id", "chunk_index", "headings", "text", "kind", "tokens"])

    return docs.select(key, column).mapInPandas(cut, schema)
