"""Chunks of block trees: structure, budgets, and nothing lost."""

import random
import re

import pytest

from corpusforge.sources import blocks

COUNT = blocks.word_counter()
DOC = """intro one
intro two

# A
first paragraph. It goes on; still.

| Name | Age | City |
|------|:---:|------|
| Ann | 30 | Rome |
| Bob | | Bari \\| Sud | extra |

## B
```
# no heading
| no | table |
```
last
### C
# D
| x | y |
| only |"""


def test_tree_and_triplets():
    got = [(h, t, k) for h, t, k, _ in blocks.chunks_of(DOC, 100, COUNT)]
    assert got == [
        ([], "intro one\nintro two", "text"),
        (["A"], "A\nfirst paragraph. It goes on; still.", "text"),
        (["A"], "A\nAnn, Age = 30. Ann, City = Rome\nBob, City = Bari | Sud. Bob, 4 = extra", "table"),
        (["A", "B"], "A\nB\n```\n# no heading\n| no | table |\n```", "code"),
        (["A", "B"], "A\nB\nlast", "text"),
        (["D"], "D\nx, 2 = y\n1 = only", "table"),
    ]
    merged = [(h, k) for h, _, k, _ in blocks.chunks_of(DOC, 100, COUNT, merge_peers=True)]
    assert merged == [([], "text"), (["A"], "mixed"), (["A", "B"], "mixed"), (["D"], "table")]


def test_what_does_not_fit_is_split_where_it_is_made_of_parts():
    rows = "| k | v | w |\n|-|-|-|\n" + "\n".join(f"| r{i} | a b c | {'x ' * (20 if i == 1 else 1)}|" for i in range(3))
    got = [t for _, t, _, _ in blocks.chunks_of(f"# T\n{rows}", 13, COUNT)]
    assert got[0] == "T\nr0, v = a b c" or got[0].startswith("T\nr0, v = a b c. r0, w = x")
    assert all(COUNT([t])[0] <= 13 for t in got) and sum("x" in t for t in got) > 2
    assert [t for _, t, _, _ in blocks.chunks_of("One two. Three four five. Six", 4, COUNT)] == ["One two.", "Three four five.", "Six"]
    by_letter = lambda texts: [len(t) for t in texts]
    assert [t for _, t, _, _ in blocks.chunks_of("abcdefg hi", 3, by_letter)] == ["abc", "def", "g", "hi"]
    deep = "# " + "long " * 30 + "\n## s\ntext here"
    assert [(len(h), t) for h, t, _, _ in blocks.chunks_of(deep, 10, COUNT)] == [(2, "s\ntext here")]


def random_text(r):
    lines = []
    for _ in range(r.randint(0, 14)):
        kind = r.random()
        words = lambda n: " ".join(r.choice(["alpha", "b.", "cc;", "ünï", "42", "x" * 30]) for _ in range(r.randint(1, n)))
        if kind < 0.25:
            lines.append("#" * r.randint(1, 4) + " " + words(2))
        elif kind < 0.5:
            lines += [f"| {words(2)} | {words(9)} | {words(3)} |" for _ in range(r.randint(1, 4))]
        else:
            lines += [words(12), r.choice(["", words(3)])]
        lines.append(r.choice(["", "", words(1)]))
    return "\n".join(lines)


@pytest.mark.parametrize("merge", [False, True])
def test_budgets_hold_and_no_word_is_lost(merge):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    real, model = blocks.json_counter(path)(), tokenizers.Tokenizer.from_file(path)
    r = random.Random(9)
    for _ in range(150):
        text, budget = random_text(r), r.choice([8, 20, 60])
        for count in (COUNT, real):
            found = list(blocks.chunks_of(text, budget, count, merge))
            if count is real:
                assert all(len(model.encode(t).ids) <= max(budget, n) for _, t, _, n in found)
            assert all(n <= budget or len(t.split()) <= 1 + len(h) * 2 for h, t, _, n in found), text
        # each section's words in order, heads taken off and tables read as their triplets
        want, got = [], []
        for s in blocks.parse(text):
            for b in s.blocks:
                body = "\n".join(". ".join(t) for t in blocks.triplets(b.lines)) if b.kind == "table" else "\n".join(b.lines)
                want.append((s.headings, re.sub(r"[\s.]+", "", body)))
        for h, t, _, _ in blocks.chunks_of(text, budget, COUNT, merge):
            shown = list(h)
            while not t.startswith("".join(f"{x}\n" for x in shown)):
                shown.pop(0)
            got.append((h, re.sub(r"[\s.]+", "", t[len("".join(f"{x}\n" for x in shown)) :])))
        joined = lambda rows: [(h, "".join(b for g, b in rows if g == h)) for h in dict.fromkeys(tuple(g) for g, _ in rows) for h in [list(h)]]
        assert joined(got) == joined([w for w in want if w[1]]), text


def test_packing_is_greedy():
    """With peers merged, the next block wouldn't have fitted, as counting it all again shows."""
    r = random.Random(2)
    for _ in range(60):
        paragraphs = [" ".join("w" for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 12))]
        found = [t for _, t, _, _ in blocks.chunks_of("\n\n".join(paragraphs), 10, COUNT, merge_peers=True)]
        assert [p for t in found for p in t.split("\n\n")] == paragraphs
        assert all(COUNT([a + "\n\n" + b.split("\n\n")[0]])[0] > 10 for a, b in zip(found, found[1:], strict=False))


def test_frame(spark):
    docs = spark.createDataFrame([(1, DOC), (2, None), (3, " \n "), (4, "# only a heading")], "doc_id long, text string")
    got = blocks.block_chunks(docs, max_tokens=100).orderBy("chunk_index").collect()
    assert [(r.file_id, r.chunk_index) for r in got] == [(1, i) for i in range(6)] and got[2].kind == "table"
    assert blocks.block_chunks(docs.limit(0)).count() == 0
