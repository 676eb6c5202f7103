"""Toxicity and language identification worked out once more, term by term and byte by byte."""

import math

import numpy as np
import pytest
import text_helpers as H
from pyspark.sql import functions as F

from atticsweep.llm import language_id, toxicity

WORDS = ["idiot", "idiots", "idiotic", "stupid", "calm", "river", "old", "station", "ID10T", "stüpid", "ídiоt", "st​upid", "x"]


def amount(text, lexicon):
    """By the definition: each word's heaviest term, unless an exception phrase covers the word."""
    words = toxicity.fold(text).split()
    taken = {}
    for i, word in enumerate(words):
        own = [lexicon.weights[f" {word} "]] if f" {word} " in lexicon.weights else []
        own += [w for term, w in lexicon.weights.items() if term[-1] != " " and word.startswith(term[1:]) and len(word) > len(term) - 1]
        if own and max(own) > 0:
            taken[i] = max(own)
    for phrase in lexicon.exceptions:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                for j in range(i, i + len(parts)):
                    taken.pop(j, None)
    return sum(taken.values()) / (1 + math.log1p(toxicity.fold(text).count(" ")) / 8) if taken else 0.0


@pytest.fixture(scope="module")
def lexicon():
    return toxicity.Lexicon(
        {" idiot ": 3.0, " idio": 2.5, " idiotic ": 1.0, " stupid ": 2.0, " x ": 0.5}, [" old idiot ", " idiot station "], -4.0, 3.0
    )


def test_scores_word_by_word(spark, lexicon):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(WORDS, rng.integers(0, 30))) for _ in range(300)] + ["", None, "idiot " * 5000, "old idiot station idiot"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, lexicon).collect()}
    for i, text in enumerate(texts):
        p = 1 / (1 + math.exp(-(-4.0 + 3.0 * math.log1p(amount(text or "", lexicon)))))
        assert abs(got[i][0] - p) < 1e-9 and got[i][1] == int(p >= 0.3), text
    assert len({round(s, 6) for s, _ in got.values()}) > 50


def test_weights_counted_by_hand(spark):
    """Terms, weights and the two bounds on them, from labelled rows counted one by one; other rows teach nothing."""
    rng = np.random.default_rng(9)
    plain = [f"{a}{b}rest" for a in "bcdfg" for b in "aeiou"]
    rows, labels = [], []
    for i in range(240):
        bad = i % 5 == 0
        rows.append((i, " ".join([*rng.choice(plain, 12), *(["nastyword"] if bad else []), f"u{i}"])))
        labels.append((i, 1, int(bad)))
    labels += [(3, 1, None), (None, 1, 1), (9999, 1, 1), (5, 1, 1), (5, 1, 1)]  # null label, null id, no text, repeated
    rows += [(None, "nastyword without an id"), (7777, "nastyword without a label")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(c) for c in ("toxic", "label_id", "sha", "term", "score")})
    found = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    taught = [(i, text) for i, text in rows if i is not None and i < 240 and H.held(i, 4) != 2]
    bad = [set(toxicity.terms_of(toxicity.fold(t))) for i, t in taught if i % 5 == 0]
    good = [set(toxicity.terms_of(toxicity.fold(t))) for i, t in taught if i % 5]
    want = {}
    for term in set().union(*bad):
        b, g = sum(term in s for s in bad), sum(term in s for s in good)
        ratio = (b + 0.5) / (len(bad) + 1) / ((g + 0.5) / (len(good) + 1))
        if b >= 2 and ratio >= 8:
            want[term] = math.log(ratio)
    assert found.weights == pytest.approx(want) and " nastyword " in want


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "idiot"), (1, None), (2, ""), (2, ""), (3, "river"), (3, "calm")], "doc_id bigint, text string")
    docs = docs.withColumns({c: F.lit(c) for c in ("score", "predicted", "held_out", "toxic", "n")})
    got = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert sorted((str(r.doc_id), r.held_out, r.predicted) for r in got.collect()) == sorted(
        (str(i), H.held(i, 4) == 2, 0) for i in (None, 1, 2, 2, 3, 3)
    )


@pytest.mark.parametrize("batch", [1, 7, 64])
def test_fast_states_are_the_plain_ones(batch):
    """The pass that scores, in place and with other functions, against the pass that is trained."""
    rng = np.random.default_rng(batch)
    net = language_id.Network.fresh(["a", "b", "c"], 5, rng)
    net.bias += np.array([0.3, -0.2, 0.1], np.float32)
    x = rng.integers(0, 256, (20, batch))
    sizes = rng.integers(1, 21, batch)
    for mask in (None, (np.arange(20)[:, None] < sizes).astype(np.float32)):
        whole = np.ones((20, batch), np.float32) if mask is None else mask
        plain = [net.direction(d, x, whole) for d in (0, 1)]
        for d in (0, 1):
            assert np.allclose(net.states(d, x, mask), plain[d], atol=2e-5)
        scores = np.concatenate(plain, axis=2) @ net.output + net.bias
        p = np.exp(scores - scores.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        assert np.allclose(net.distributions(x, mask).transpose(1, 2, 0), p, atol=2e-5)


def test_documents_are_the_mean_of_their_bytes(spark):
    """Predictions byte by byte, window by window, one text at a time; long, repeated and odd rows among them."""
    rng = np.random.default_rng(3)
    net = language_id.Network.fresh(["aa", "bb", "cc"], 4, rng)
    texts = ["".join(rng.choice(list("abcdeé ñ"), n)) + "z" for n in (1, 30, 63, 64, 65, 200, 5000)] + [None, "", " 12 ", "日本"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (2, texts[2]), (2, "other z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(c) for c in ("lang", "score", "lang_pred", "window")})
    got = sorted((str(r.doc_id), r.lang_pred, round(r.score, 4)) for r in language_id.predict(docs, net).collect())
    want = []
    for doc_id, text in rows:
        if not text or not any(c.isalpha() for c in text):
            want.append((str(doc_id), "und", 0.0))
            continue
        data, found = text.encode(), []
        for at in range(0, len(data), language_id.SPAN):
            part = np.frombuffer(data[at : at + language_id.SPAN], np.uint8).astype(int)[:, None]
            both = np.concatenate([net.direction(d, part, np.ones(part.shape, np.float32)) for d in (0, 1)], axis=2)
            p = np.exp(both @ net.output + net.bias)
            found.append((p / p.sum(axis=2, keepdims=True))[:, 0])
        mean = np.concatenate(found).mean(axis=0)
        want.append((str(doc_id), net.languages[int(mean.argmax())], round(float(mean.max()), 4)))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-3
