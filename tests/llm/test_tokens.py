"""Tokenising operators against the libraries that define their ids."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import AddedToken, Tokenizer

from corpusforge.llm import bpe, common, tokenbin, tokencount, tokens
from tests.llm import fixtures
from tests.llm.test_scans import by_key

RANKS = public_tokenizers.path(bpe.MULTI_50K)
JSON = public_tokenizers.path(tokencount.BYTE_50K)
PIECES = ["a", "aa", " ", "\n", "  ", "b", "'s", "'S", " '", "ab", "é", "1", "\t", " ", "　", "語", "🙂", "<|endoftext|>", "-", "<|", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.read_ranks(RANKS), special_tokens={})


def texts(n, most, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, most))) for _ in range(n)]


def packed(ids):
    return np.asarray(ids, "<u4").tobytes()


def test_rank_file_ids(tik):
    encoder = tokens.UnitEncoder(tokens.load_ranks(RANKS, public_tokenizers.PATTERN), most=500)
    some = texts(2000, 60) + ["a" * n for n in range(100)] + [f"x{chr(c)} {chr(c)}y z" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(some), 300):
        part = some[at : at + 300]
        assert encoder.encode([t.encode() for t in part]) == [packed(tik.encode_ordinary(t)) for t in part]


SPECIAL = ["<|endoftext|>", "see <|endoftext|> here", "a<|endoftext|>b c", "<|endoftext|><|endoftext|> x-y", "x  <|endoftext|>\n's", "<|endoftext|", "é<|endoftext|>\u00a0z", "<|endof", "text|> q"]


def test_added_tokens_keep_their_ids():
    plain = Tokenizer.from_file(JSON)
    encoder = tokens.UnitEncoder(tokens.load_json(JSON), most=500)
    some = [*SPECIAL, *texts(2000, 60, seed=2), *SPECIAL]
    for at in range(0, len(some), 300):
        part = some[at : at + 300]
        assert encoder.encode([t.encode() for t in part]) == [packed(plain.encode(t, add_special_tokens=False).ids) for t in part]
    assert encoder.encode([b"see <|endoftext|> here"]) == [packed([3826, 220, 50256, 994])]


def test_added_tokens_that_depend_on_their_surroundings():
    model = Tokenizer.from_file(JSON)
    model.add_special_tokens([AddedToken("[SEP]", lstrip=True, rstrip=True), AddedToken("stop", single_word=True), AddedToken("two words")])
    encoder = tokens.UnitEncoder(model)
    some = ["a [SEP] b c", "x\n[SEP]y", "nonstop stop it-stop.", "say two words now", "say two", "more words", *SPECIAL]
    assert encoder.encode([t.encode() for t in some]) == [packed(model.encode(t, add_special_tokens=False).ids) for t in some]


def test_op8_and_op10_added_tokens(spark, tmp_path):
    data = [*enumerate(SPECIAL), (50, "long word " * 4000 + "see <|endoftext|> here " * 3), (51, "after")]
    path = fixtures.save(spark, tmp_path, documents=(data, "doc_id long, text string"))
    plain = Tokenizer.from_file(JSON)
    want, counts, start = [], [], 0
    for i, t in data:
        ids = plain.encode(t, add_special_tokens=False).ids
        counts.append((i, len(t.encode()), len(ids), len(ids) > 512))
        want.append((i, start, len(ids) + 1, zlib.crc32(packed([*ids, 0]))))
        start += len(ids) + 1
    assert sorted(map(tuple, tokencount.op10_token_counts(spark, path).collect())) == counts
    assert sorted(map(tuple, tokenbin.op8_token_binary(spark, path).collect())) == want


def plain_offsets(whole, text):
    """First and past-the-last character of tokens, from the bytes that each character has."""
    of = [i for i, c in enumerate(text) for _ in c.encode()]
    out, at = [], 0
    for raw in whole:
        out += [of[at], of[at + len(raw) - 1] + 1]
        at += len(raw)
    return out


def test_offsets_cover_split_characters(tik):
    table = bpe.token_bytes(RANKS)
    sizes = np.asarray([len(t) for t in table])
    for t in ["plain words", "é語🙂 naïve 𝒳𝒴", "", "🙂🙂", *texts(300, 40, seed=3)]:
        ids = packed(tik.encode_ordinary(t))
        whole = [table[i] for i in np.frombuffer(ids, "<u4")]
        assert bpe.offsets(ids, t.encode(), sizes).ravel().tolist() == plain_offsets(whole, t)
        assert b"".join(whole).decode() == t


# two words of 1024 letters that a polynomial modulo 2**64 can't tell apart
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


def test_words_that_weak_hashes_confuse(spark, tmp_path, tik):
    data = [(1, THUE), (2, MORSE), (3, f"x {MORSE} y"), (4, f"x {THUE} y")]
    path = fixtures.save(spark, tmp_path, documents=(data, "doc_id long, text string"))
    plain = Tokenizer.from_file(JSON)
    ids = {i: plain.encode(t, add_special_tokens=False).ids for i, t in data}
    for r in bpe.op1_byte_bpe(spark, path).collect():
        t = dict(data)[r.doc_id]
        assert (r.ids_sha256, r.decoded_sha256) == (hashlib.sha256(packed(tik.encode_ordinary(t))).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: r.ids_crc32 for r in tokenbin.op8_token_binary(spark, path).collect()} == {i: zlib.crc32(packed([*x, 0])) for i, x in ids.items()}
    assert {r.doc_id: r.n_tokens for r in tokencount.op10_token_counts(spark, path).collect()} == {i: len(x) for i, x in ids.items()}


def test_long_texts_in_pieces():
    plain = Tokenizer.from_file(JSON)
    for kind in (tokens.UnitEncoder, tokens.PieceEncoder):
        encoder = kind(tokens.load_json(JSON), piece=50)
        some = [*texts(1500, 150, seed=4), *SPECIAL, "x" * 3000, " " * 500, "word, " * 300]
        assert encoder.encode([t.encode() for t in some]) == [packed(plain.encode(t, add_special_tokens=False).ids) for t in some]


def test_op1_round_trip(spark, tmp_path, tik):
    path = fixtures.save(spark, tmp_path, documents=(fixtures.rows(), "doc_id long, text string"))
    got = by_key(bpe.op1_byte_bpe(spark, path).collect())
    for r, (_, t) in zip(got, sorted(fixtures.rows(), key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        ids = tik.encode_ordinary(t or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert r.offsets_sha256 == hashlib.sha256(packed(plain_offsets([tik.decode_single_token_bytes(i) for i in ids], t or ""))).hexdigest()


def test_encode_keeps_clashing_columns(spark):
    df = fixtures.frame(spark)
    got = bpe.decode(bpe.encode(df, RANKS, with_offsets=True), RANKS, "ids_")
    assert got.columns == [*df.columns, "ids_", "offsets", "decoded"]
    assert all((r.text or "").encode() == bytes(r.decoded) and r.ids == "x" for r in got.collect())
    assert bpe.encode(df.limit(0), RANKS).count() == 0


def test_spliced_counts():
    model, plain = tokencount.untrimmed(JSON), Tokenizer.from_file(JSON)
    unspaced = ["語", "言", "語言", "x", "y", "<|endoftext|>", "<|endo", "text|>", "'", "'re", "\u200b"]
    some = [*texts(1500, 200), "word " * 3000, "x" * 5000, " " * 3000, "a　b c" * 900, "'s's" * 400]
    some += ["".join(random.Random(i).choices(unspaced, k=200)) for i in range(300)]
    for t in some:
        for chunk, overlap in ((40, 8), (100, 16)):
            assert tokencount.count_spliced(model, t, chunk, overlap) == len(plain.encode(t, add_special_tokens=False).ids), t[:50]


def test_spliced_counts_where_a_chunk_doubles_inside_marks():
    model, plain = tokencount.untrimmed(JSON), Tokenizer.from_file(JSON)
    size = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    for t in (" " * 16320 + "~'d" + " " * 40_000, " " * 16320 + "~'d" + "\n" * 40_000 + "x", "'s's" * 20_000):
        assert tokencount.count_spliced(model, t) == size(t)
    r = random.Random(3)
    for _ in range(6000):
        some = r.sample(["'", "~", "'d", "'ll", "d", "1", " ", "\n", "é", "ab", " of"], r.randint(2, 6))
        t = "".join(r.choice(some) * r.choice([1, 1, 2, 9, 60]) for _ in range(r.randint(1, 40)))
        assert tokencount.count_spliced(model, t, r.choice([30, 60]), r.choice([4, 8, 16])) == size(t), t


def test_splicing_takes_time_in_proportion():
    model = tokencount.untrimmed(JSON)
    r = random.Random(6)
    text = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(300_000))
    seen = []

    class Counting:
        def get_added_tokens_decoder(self):
            return model.get_added_tokens_decoder()

        def encode(self, part, add_special_tokens):
            seen.append(len(part))
            return model.encode(part, add_special_tokens=add_special_tokens)

    assert tokencount.count_spliced(Counting(), text) == len(model.encode(text, add_special_tokens=False).ids)
    assert sum(seen) < 1.2 * len(text)
    seen.clear()
    assert tokencount.count_spliced(Counting(), " " * 300_000) > 0  # no place to splice at
    assert sum(seen) < 10 * 300_000


@pytest.mark.parametrize("size", [tokencount.CHUNK - 10, tokencount.CHUNK + 10])
def test_both_sides_of_a_chunk(spark, size):
    t = ("see <|endoftext|> here " * size)[:size]
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    assert tokencount.count_tokens(df, JSON).first()["n_tokens"] == len(Tokenizer.from_file(JSON).encode(t, add_special_tokens=False).ids)


def test_op10_counts(spark, tmp_path):
    path = fixtures.save(spark, tmp_path, documents=(fixtures.rows(), "doc_id long, text string"))
    plain = Tokenizer.from_file(JSON)
    got = by_key(tokencount.op10_token_counts(spark, path).collect())
    for r, (_, t) in zip(got, sorted(fixtures.rows(), key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        n = len(plain.encode(t or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 512)
    assert tokencount.count_tokens(fixtures.frame(spark), JSON).columns[-1] == "n_tokens_"


def test_op8_files(spark, tmp_path):
    path = fixtures.save(spark, tmp_path / "in", documents=(fixtures.rows(), "doc_id long, text string"))
    plain = Tokenizer.from_file(JSON)
    docs = sorted(fixtures.rows(), key=lambda x: (x[0] is not None, x[0] or 0))
    want, start = [], 0
    for i, t in docs:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    assert sorted(map(tuple, tokenbin.op8_token_binary(spark, path).collect()), key=lambda r: r[1]) == want
    out = common.fresh_path(spark, "ids-test")
    df = spark.read.parquet(f"{path}/documents.parquet")
    tokenbin.write_ids(df, out, JSON, shard_bytes=2000)
    assert spark.read.parquet(f"{out}/shards").count() > 3
    assert sorted(map(tuple, tokenbin.read_ids(spark, out, tokenbin._digest, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()), key=lambda r: r[1]) == want
    assert tokenbin.read_document(spark, out, 63) == [[*plain.encode("one").ids, 0]]
    assert tokenbin.read_document(spark, out, 10**9) == []
    with pytest.raises(ValueError):
        tokenbin.Shard(bytes(spark.read.parquet(f"{out}/shards").first()["blob"]), b"another dictionary")


def test_op8_empty(spark, tmp_path):
    path = fixtures.save(spark, tmp_path, documents=([], "doc_id long, text string"))
    assert tokenbin.op8_token_binary(spark, path).count() == 0
