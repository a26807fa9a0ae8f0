"""Near-duplicate groups against all pairs of full sets."""

import random

import numpy as np

from corpusforge.llm import neardup
from tests.llm import fixtures
from tests.llm.test_fingerprints import shingles


def plain(data):
    sets = [shingles(t or "") for _, t in data]
    up = list(range(len(data)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if find(j) == find(i) and data[j][0] is not None]
        component = (min(ids) if ids else None) if sets[i] else d
        out.append((d, len(sets[i]), component, d == component))
    return sorted(out, key=str)


def planted(seed=11):
    """A group of near copies at many distances, a chain, copies, and short texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 10**6)}"
    base = [word() for _ in range(300)]
    data = [(i, t) for i, t in fixtures.rows(30) if not t or len(t) < 10_000]
    n = 1000
    for edits in [0] * 3 + [1, 2, 3, 4, 5, 6, 8, 10] * 12:
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.2:
            w = w[: r.randint(240, 300)]
        data.append((n, " ".join(w)))
        n += r.randint(1, 3)
    chain = [word() for _ in range(200)]
    for k in range(8):
        chain = chain[:5 * k] + [word() for _ in range(5)] + chain[5 * k + 5 :]
        data.append((n + k, "\n".join(chain).upper() if k % 2 else " ".join(chain)))
    r.shuffle(data)
    return data


def test_groups(spark):
    data = planted()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in data], "doc_id long, text string, id int, class string")
    got = sorted(map(tuple, neardup.near_duplicates(df).collect()), key=str)
    assert got == plain(data)
    assert len({c for _, _, c, _ in got}) > 20


def test_groups_at_other_thresholds(spark):
    data = [(i, t) for i, t in planted(12) if i is not None and shingles(t or "")]
    sets = [shingles(t) for _, t in data]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for num in (80, 90):
        least = {i: i for i, _ in data}
        links = [(data[i][0], data[j][0]) for i in range(len(data)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
        for _ in data:
            for x, y in links:
                least[x] = least[y] = min(least[x], least[y])
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, threshold=(num, 100)).collect()}
        assert got == least


def test_settling():
    assert [round(a / b, 6) for a, b in map(neardup.settling, [(85, 100), (80, 100), (4, 5)])] == [0.7, 0.75, 0.75]


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_fill_and_estimate():
    r = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.85):
        errors = []
        for n in (1, 3, 40, 2000):
            both = max(1, round(2 * n * share / (1 + share)))
            a = r.integers(0, 2**63, n, dtype=np.uint64)
            b = np.concatenate([a[:both], r.integers(0, 2**63, n - min(both, n), dtype=np.uint64)])
            s = neardup.fast_sketch(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
            assert (s != neardup._NONE).all()
            errors.append(np.mean(s[0] == s[1]) - len(set(a) & set(b)) / len(set(a) | set(b)))
        assert max(map(abs, errors)) < 0.2
    assert (neardup.fast_sketch(np.empty(0, np.uint64), np.empty(0, np.int64), 1) == neardup._NONE).all()


def test_words_that_weak_hashes_confuse(spark):
    from tests.llm.test_tokens import MORSE, THUE

    df = spark.createDataFrame([(1, THUE), (2, MORSE), (3, f"a b c {THUE} d"), (4, f"a b c {MORSE} d")], "doc_id long, text string")
    assert all(r.kept for r in neardup.near_duplicates(df).collect())


def test_null_ids_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = text.replace("w50 ", "")
    data = [(None, text)] * 40 + [(None, near)] * 30 + [(None, f"n{i}") for i in range(30)] + [(7, "other words here for this id")] * 20 + [(7, near + " end")] * 5
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).groupBy("doc_id", "component_id").count().collect()
    assert {(r.doc_id, r.component_id, r["count"]) for r in got} == {(None, 7, 70), (None, None, 30), (7, 7, 25)}


def test_no_link_is_lost_in_large_buckets(spark, monkeypatch):
    """Many variants that share edits at random: hubs settle few of them, and nodes have many links."""
    monkeypatch.setattr(neardup, "SPREAD", 5)
    r = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    edits = [(r.randrange(150), f"e{k}") for k in range(12)]
    data = []
    for i in range(150):
        words = list(base)
        for at, w in r.sample(edits, r.choice([1, 2, 3, 4, 5])):
            words[at] = w
        data.append((i, " ".join(words)))
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()), key=str)
    assert got == plain(data)
