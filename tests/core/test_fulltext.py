"""Full-text search for terms that most texts have, and strings within texts."""

import random

import pyarrow as pa
import pytest

from corpusforge.functions import substrings
from corpusforge.operators import fulltext


@pytest.mark.parametrize("letters", ["ab", "aé ", "abcdefgh 😀ß"])
def test_substrings_are_those_of_python(monkeypatch, letters):
    monkeypatch.setattr(substrings, "PLACES", 64)
    pick = random.Random(1)
    word = lambda most: "".join(pick.choice(letters) for _ in range(pick.randint(0, most)))
    strings = list(dict.fromkeys(word(pick.choice([3, 9, 20, 40])) for _ in range(80)))
    texts = ["", *(word(pick.choice([0, 5, 80])) for _ in range(40)), *(word(9) + pick.choice(strings) + word(9) for _ in range(40))]
    got = substrings.Substrings([s.encode() for s in strings]).held(pa.array(["left out", *texts]).slice(1))
    assert got.tolist() == [[s in t for t in texts] for s in strings]


def test_common_terms_pair_no_query_with_its_texts(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "TABLE_TERMS", 3)
    monkeypatch.setattr(fulltext, "BLOCK_TERMS", 12)
    monkeypatch.setattr(fulltext, "ROWS", 16)
    rows = [(i, f"the of {'Thematic ' * (i % 3)}{'red fox' if i % 7 == 0 else 'redfox'} {i % 5}x") for i in range(200)]
    asked = [(q, ["The", "of", "the of", "RED FOX", "ed fox", f"{q % 5}x", "absent", "!"][q % 3 :]) for q in range(9)] + [(99, ["ed fox", "absent"]), (98, ["  "])]
    texts = spark.createDataFrame(rows, "id long, text string")
    found = fulltext.search(fulltext.build(texts), texts, spark.createDataFrame(asked, "query_id long, terms array<string>"), 10)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()

    def best(terms):
        words = lambda t: {w for w in t.lower().split() if len(w) > 1 and w != "!"}
        hits = [(-sum(t.lower() in x.lower() for t in terms), i) for i, x in rows if any(words(t) and words(t) <= words(x) for t in terms)]
        return [(n, i, -o) for n, (o, i) in enumerate(sorted(hits)[:10], 1)]

    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.overlap))
    assert got == {q: best(t) for q, t in asked if best(t)}
