"""Toxicity on labelled fixtures, and the pipeline against plain versions of its stages."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from corpusforge.llm import bpe, secrets, tokens, toxicity
from tests.llm import fixtures
from tests.llm.test_neardup import plain
from tests.llm.test_scans import ITEMS, plain_hits

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=400, seed=3):
    """Documents with planted insults, copies, benchmark passages and secrets, and labels."""
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("th", "re", "on", "ti") for b in "aeiou" for c in ("nd", "st", "ly", "rm", "ck")]
    docs, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 120))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(max(3, len(text) // 15)):
                text.insert(r.randrange(len(text)), r.choice(["idiot", "scum", "grubbler", "grubblish"]))
        if r.random() < 0.15:
            text.insert(5, r.choice(fixtures.SECRETS))
        if r.random() < 0.05:
            text += ITEMS[0][1].split()
        docs.append((i, " ".join(text)))
        if r.random() < 0.9:
            labels.append((i, 1, int(toxic)))
    docs += [(n + k, docs[r.randrange(n)][1]) for k in range(40)]
    docs += [(n + 50, None), (n + 51, ""), (n + 52, docs[0][1].replace(" ", "  "))]
    return [(i, t, "en", "s", len(t or "")) for i, t in docs], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = corpus()
    bench = [x for x in ITEMS if x[0] in (1, 12)]
    return fixtures.save(spark, tmp_path_factory.mktemp("corpus"), documents=(docs, DOCS), labels=(labels, "doc_id long, quality int, toxic int"), benchmark=(bench, "item_id long, text string"))


def test_held_out_accuracy(spark, folder):
    docs, labels = corpus()
    got = {r.doc_id: r for r in toxicity.op3_toxicity(spark, folder).collect()}
    assert len(got) == len(docs)
    right = wrong = 0
    for i, _, toxic in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.3)
        if got[i].held_out:
            right, wrong = right + (got[i].predicted == toxic), wrong + (got[i].predicted != toxic)
    assert right / (right + wrong) > 0.95
    by_text = {}
    for i, t, *_ in docs:
        assert by_text.setdefault(t or "", got[i].score) == got[i].score


def test_labels_of_held_out_rows_are_not_learned(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 1 - toxic, toxic) AS toxic")
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert one.prefixes == two.prefixes and np.allclose(one.weights, two.weights)
    assert one.read("grubbling")[1] > 0 and one.read("idiot")[1] > 0 and not one.read("thand")[1]


def test_grammar_contexts():
    model = toxicity.Model({"idiot$": 4.0, "scum": 3.0})
    names = ["total", "per", "words", "count", "uses", "negated", "reported"]
    read = lambda t: dict(zip(names, [*model.features(t)[:5], *(round(x, 3) for x in model.features(t)[5:7])], strict=True))
    assert read("you idiot")["negated"] == 0 and read("he is not an idiot")["negated"] == 0.8
    assert read("not today. idiot")["negated"] == 0 and read("she said he is an idiot")["reported"] == 0.8
    assert model.features("you idiot")[7] > 0 and model.features("an idiot")[7] == 0
    assert model.features("idiots")[0] == 0 and model.features("scummy")[0] > 0
    threats = lambda t: round(np.expm1(model.features(t)[8]))
    assert threats("I will kill you") == 1 and threats("you will burn") == 1 and threats("kill you. hurt them") == 2
    assert threats("I will not kill you") == 0 and threats("he said kill you") == 0
    assert threats("kill time with one two three four you") == 0 and threats("kill. you") == 0


def plain_features(prefixes, text):
    """The features by rules over lists of words, without machines."""

    def insult(w):
        best = prefixes.get(w + "$")
        for n in range(len(w), 0, -1):
            best = prefixes.get(w[:n]) if best is None else best
        return best or 0.0

    kind = lambda w: next((k for k, ws in (("T", toxicity.TARGETS), ("S", toxicity.REPORTS), ("N", toxicity.NEGATIONS), ("K", toxicity.THREATS)) if w in ws), "")
    low = (text or "").lower()
    every = re.findall(r"[^\W\d_]+", low)
    direct = negated = told = targeted = count = threats = 0
    for clause in re.split(r"[.!?;\n]+", low):
        words = re.findall(r"[^\W\d_]+", clause)
        kinds = ["I" if insult(w) > 0 else kind(w) for w in words]
        here = 0
        waiting = None
        for i, (w, k) in enumerate(zip(words, kinds)):
            # targets don't use up the reach of a negation
            since = [j for j in range(i) if kinds[j] == "N"]
            covered = k == "N" or bool(since) and sum(x != "T" for x in kinds[since[-1] + 1 : i + 1]) < 3
            speech = "S" in kinds[:i]
            if k == "I":
                count += 1
                if covered:
                    negated += insult(w)
                elif speech:
                    told += insult(w)
                else:
                    here += insult(w)
            if k in ("K", "T"):
                if waiting and waiting[0] != k and i - waiting[1] <= 4:
                    threats += not covered and not speech
                    waiting = None
                else:
                    waiting = (k, i)
        direct += here
        if "T" in kinds:
            targeted += here
    total = direct + negated + told
    per = 100 / (len(every) + 20)
    log = np.log1p
    return [log(total), log(per * total), log(len({w for w in every if insult(w) > 0})), log(count), log(per * count), negated / (total + 1), told / (total + 1), targeted / (total + 1), log(threats)]


def test_scores_against_plain_rules(spark):
    r = random.Random(8)
    prefixes = {"idiot$": 4.0, "scum": 3.0, "scumbag": 5.0, "sc": 0.5, "not": 0.0, "you$": 0.0}
    words = ["idiot", "idiots", "scummy", "scumbags", "scare", "you", "du", "not", "nie", "said", "dit", "kill", "töten", "die", "plain", "word", "Ünder", ".", "!", ";", "\n", "x1"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(2000)] + ["", "long scum you kill " * 1_500]
    weights = [0.1, 0.5, -0.2, 0.3, 0.4, 0.1, -0.3, 0.2, 0.6, 0.7]
    model = toxicity.Model(prefixes, weights, [0.5] * 9, [2.0] * 9)
    want = []
    for t in texts:
        x = plain_features(prefixes, t)
        assert np.allclose(model.features(t), x), t
        want.append(1 / (1 + np.exp(-(weights[0] + sum(w * (v - 0.5) / 2.0 for w, v in zip(weights[1:], x))))))
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    got = [x.toxicity for x in toxicity.score_toxicity(docs, model, keep=["doc_id"]).orderBy("doc_id").collect()]
    assert np.allclose(got, [*want, want[texts.index("")]])
    huge = model.features("long scum you kill " * 50_000)  # far beyond what the plain rules take
    assert np.isfinite(huge).all() and huge[3] > model.features(texts[-1])[3]


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (1, None), (9, 1)], "doc_id long, toxic int")
    assert [r.toxicity for r in toxicity.score_toxicity(docs, toxicity.fit(docs, none)).collect()] == [0, 0]
    model = toxicity.Model({"idiot$": 4.0}, [0.0] + [1.0] * 9, [0.0] * 9, [1.0] * 9)
    clashing = docs.selectExpr("doc_id", "text", "1 AS toxicity", "2 AS _row")
    assert toxicity.score_toxicity(clashing, model).columns == ["doc_id", "text", "toxicity", "_row", "toxicity_"]
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs, _ = corpus()
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(i, t) for i, t, *_ in docs if model.score(t or "") < toxicity.THRESHOLD]
    kept = {d for d, _, _, stays in plain(rows) if stays}
    rows = [(i, t) for i, t in rows if i in kept]
    rows = [(i, t) for i, t in rows if not plain_hits(t, [x for x in ITEMS if x[0] in (1, 12)])[1]]
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.read_ranks(public_tokenizers.path(bpe.MULTI_50K)), special_tokens={})
    want = []
    for i, t in rows:
        text, at = "", 0
        for start, end in merged(secrets.find_spans((t or "").encode())):
            text, at = text + (t[at:start] + "[SECRET]"), end
        text = text + (t or "")[at:]
        ids = np.asarray(tik.encode_ordinary(text), "<u4").tobytes()
        want.append((i, None if t is None else len(text), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [(r.doc_id, r.n_chars, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got) == sorted(want) and 100 < len(got) < len(docs)


def test_near_copies_from_four_fifths_on_are_dropped(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(104)]  # 100 shingles
    edited = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    other = " ".join(f"v{i}" for i in range(104))
    # 90 of 110 shingles are shared: 0.82; then 85 of 115: 0.74
    for edits, kept in (((20, 60), [1, 3]), ((20, 50, 80), [1, 2, 3])):
        docs = spark.createDataFrame([(1, " ".join(words)), (2, edited(*edits)), (3, other)], "doc_id long, text string")
        assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == kept


def merged(spans):
    out = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
