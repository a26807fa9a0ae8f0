"""Ranked search against plain counting, and its bounds."""

import math
import random
import re
from collections import Counter

import pytest

from corpusforge.llm import lexical
from tests.llm import fixtures

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    counted = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(words(t))
    out = []
    for item, some in terms.items():
        scores = []
        for i, c in counted:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in some if w in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def corpus(n, seed):
    """Texts of a few common and many rare words, with copies, ties and what can go wrong."""
    r = random.Random(seed)
    pick = lambda: r.choice(["the", "of", "and"]) if r.random() < 0.4 else f"w{int(r.paretovariate(0.6)) % 400}"
    docs = [(i, " ".join(pick() for _ in range(r.choice([1, 4, 30, 120])))) for i in range(n)]
    items = [(i, " ".join(pick() for _ in range(r.choice([1, 3, 12, 40])))) for i in range(25)]
    items += [(7, items[3][1]), (None, "the w1 w2"), (None, "w3"), (90, None), (91, ""), (92, "never seen"), (93, "The OF w1 Ünï")]
    docs += [(n + i, items[i][1] + " w5") for i in range(20)] + [(n + 50, docs[0][1]), (n + 50, docs[0][1]), (None, items[0][1]), (None, None), (n + 60, ""), (n + 61, "Ünï ünï ÜNÏ 語"), (n + 62, "w1 of " * 50_000)]
    return docs, items


def frames(spark, docs, items, parts):
    rows = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, n int, row string, score int").repartition(parts)
    return rows, spark.createDataFrame([(i, t, 0, 1) for i, t in items], "item_id long, text string, term int, rank int")


KEY = lambda r: (r[0] is None, r[0], r[1])


@pytest.mark.parametrize(("k", "parts", "pairs"), [(5, 7, 200_000), (50, 3, 60), (2, 1, 200_000)])
def test_equals_plain_counting(spark, monkeypatch, k, parts, pairs):
    docs, items = corpus(300, k)
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", pairs)
    got = lexical.ranked(*frames(spark, docs, items, parts), k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(plain(docs, items, k), key=KEY)


def scorer(docs, items, k, bound):
    import numpy as np
    import pyarrow as pa

    counted = [Counter(words(t)) for _, t in docs]
    df = Counter(w for c in counted for w in c)
    n_docs, total = len(docs), sum(sum(c.values()) for c in counted)
    h = lambda w: int(lexical.common.hash_words([w.encode()]).view(np.int64)[0])
    weigh = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for w, d in df.items()}
    part = lambda c, w: weigh[w] * int(lexical._impact(c[w], lexical._length(sum(c.values()), n_docs, total)))
    most = {w: max(part(c, w) for c in counted if w in c) for w in df}
    rows = [(i, h(w), weigh[w], most[w], bound.get(i, 0)) for i, t in items for w in set(words(t)) & df.keys()]
    table = pa.table(dict(zip(("item", "term", "w", "most", "bound"), map(list, zip(*rows, strict=True)), strict=True)))
    out = lexical.Scorer(lexical._block(table, {"n": n_docs, "total": total}, k))
    terms = [[h(w) for w in c] for c in counted]
    flat = lambda x: np.asarray([v for some in x for v in some], np.int64)
    out.show(np.asarray([i for i, _ in docs]), np.ones(len(docs), bool), np.asarray([sum(c.values()) for c in counted]), np.concatenate([[0], np.cumsum([len(t) for t in terms])]), flat(terms), flat([c.values() for c in counted]))
    return out


def test_bounds_spare_work_and_lose_nothing(spark):
    docs = [(i, " ".join(["the"] * (i % 5 + 1) + [f"r{i % 40}"])) for i in range(400)]
    items = [(0, "the r1 r2"), (1, "the r3"), (2, "the")]
    free, want = scorer(docs, items, 5, {}), plain(docs, items, 5)
    kth = {i: min(s for j, _, _, s in want if j == i) for i in range(3)}
    bound = scorer(docs, items, 5, kth)
    for found in (free, bound):
        item, score, ids, _ = found.found
        assert sorted(zip(item.tolist(), score.tolist(), ids.tolist(), strict=True)) == sorted((i, s, d) for i, _, d, s in want)
    bound._split()
    assert bound.leads.sum() < len(bound.leads)  # the common word makes no candidates of items with rare ones


def test_huge_weights_stay_whole():
    import numpy as np
    import pyarrow as pa

    table = pa.table({"item": [1, 1], "term": [10, 20], "w": [2**41 + 1, 1], "most": [2**61, 1], "bound": [0, 0]})
    s = lexical.Scorer(lexical._block(table, {"n": 1, "total": 2}, 3))
    s.show(np.asarray([5]), np.ones(1, bool), np.asarray([2]), np.asarray([0, 2]), np.asarray([10, 20]), np.asarray([1, 1]))
    q = int(lexical._impact(1, lexical._length(2, 1, 2)))
    assert s.found[1].tolist() == [(2**41 + 2) * q]


def test_empty_tables(spark, tmp_path):
    for name, docs, items in (("a", [], [(1, "x")]), ("b", [(1, "x")], []), ("c", [(1, None)], [(1, "x")])):
        path = fixtures.save(spark, tmp_path / name, documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
        got = lexical.op13_lexical_search(spark, path)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]
