"""Backtracking against the library whose ids it must give."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from corpusforge.llm import pairbpe
from tests.llm import fixtures

PATH = public_tokenizers.path(pairbpe.BYTE_50K)
PIECES = ["a", "aa", " ", "\n", "  ", "b", "'s", "'S", " '", "ab", "é", "1", "\t", "　", "語", "🙂", "<|endoftext|>", "-", "<|", "\x1c", "\x85", "the", "ing", "tion", " of", "==", "0000", "ſ"]


def library():
    return Tokenizer.from_file(PATH)


def test_random_texts_equal_the_library():
    lib, own, r = library(), pairbpe.PairEncoder(PATH), random.Random(1)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 60))) for _ in range(5000)]
    texts += ["".join(r.choice(some) for _ in range(r.randint(1, 80))) for some in (["a", "h"], ["-", "="], ["e", "r", "s", "t"], ["语", "語"]) for _ in range(500)]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        wanted = lib.encode(text, add_special_tokens=False).ids
        assert memoryview(ids).cast("I").tolist() == wanted, text
        assert pairbpe.decode_ids(pairbpe.np.asarray(wanted, int), pairbpe.offset_table(PATH)).decode("utf-8", "replace") == lib.decode(wanted, skip_special_tokens=False)


def test_every_token_put_beside_others():
    """Texts made of tokens, where longest matches are often wrong."""
    lib, r = library(), random.Random(2)
    model = pairbpe.PairModel(PATH)
    words = [t for t in lib.get_vocab() if "<|" not in t]
    for _ in range(20_000):
        piece = "".join(r.sample(words, r.randint(1, 4)))
        assert list(model.backtrack(piece)) == [t.id for t in lib.model.tokenize(piece)], piece


def test_long_runs_take_time_in_proportion():
    model, lib = pairbpe.PairModel(PATH), library()
    for piece in ("a" * 40_000, "ab" * 20_000, "-=" * 20_000, "zq" * 20_000):
        assert list(model.backtrack(piece)) == [t.id for t in lib.model.tokenize(piece)]
    steps = []
    for n in (20_000, 200_000):
        looked = model.shorter
        count = [0]

        class Counting(dict):
            def __getitem__(self, k, count=count):
                count[0] += 1
                return dict.__getitem__(self, k)

        model.shorter = Counting(looked)
        model.backtrack("aab" * n)
        model.shorter = looked
        steps.append(count[0])
    assert steps[1] <= 11 * steps[0] + 100


def test_broken_characters_decode_as_in_the_library():
    lib, r = library(), random.Random(4)
    table = pairbpe.offset_table(PATH)
    for _ in range(3000):
        ids = [r.choice([r.randrange(256), r.randrange(50_257)]) for _ in range(r.randint(0, 12))]
        assert pairbpe.decode_ids(pairbpe.np.asarray(ids, int), table).decode("utf-8", "replace") == lib.decode(ids, skip_special_tokens=False), ids


def test_op12(spark, tmp_path):
    docs = fixtures.rows()
    path = fixtures.save(spark, tmp_path, documents=(docs, "doc_id long, text string"))
    lib, want = library(), []
    for i, t in docs:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted(map(tuple, pairbpe.op12_pair_bpe(spark, path).collect()), key=key) == sorted(want, key=key)


def test_columns_and_empty_tables(spark):
    found = pairbpe.decode(pairbpe.encode(fixtures.frame(spark), PATH), PATH, ids="ids_")
    assert found.columns[-2:] == ["ids_", "decoded"]
    assert all(r.decoded == (r.text or "") for r in found.collect())
    assert pairbpe.decode(pairbpe.encode(fixtures.frame(spark, []), PATH), PATH, ids="ids_").count() == 0
