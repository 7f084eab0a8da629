import math
import random

import numpy as np

from aislewise.llm import toxic_mil as X


def planted(n, seed):
    rng = random.Random(seed)
    words = ["the", "and", "river", "stone", "paper", "green", "walk", "seven", "house", "light"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(8))
    rows = []
    for i in range(n):
        parts = [sentence() for _ in range(rng.randrange(1, 12))]
        bad = i % 3 == 0
        if bad:
            parts.insert(rng.randrange(len(parts) + 1), f"you {rng.choice(['slimeball', 'dimwit', 'trollface'])} go")
        rows.append((i, ". ".join(parts), int(bad)))
    return rows


def test_learns_sentences_from_document_labels():
    train, test = planted(600, 1), planted(200, 2)
    scorer = X.Scorer(X.NoisyOr().fit([t for _, t, _ in train], [y for _, _, y in train]))
    for _, text, y in test:
        score, spans = scorer.score(text)
        assert (score >= 0.5) == y
        worst = [text[b:e].strip() for b, e, p in spans if p >= 0.5]
        assert len(worst) == y and all(w.startswith("you ") for w in worst)
        assert np.isclose(score, 1 - np.prod([1 - p for _, _, p in spans]))


def plain_sentences(text):
    """Sets of lower-case words of each sentence, by another way: split at the marks."""
    out = [set()]
    word = ""
    for c in text.lower() + "\n":
        if c.isalpha():
            word += c
            continue
        if word:
            out[-1].add(word)
            word = ""
        if c in ".!?\n|":
            out.append(set())
    return [s for s in out if s]


def plain_log_likelihood(weights, bias, texts, labels, stands_for):
    """Mean over documents of share * log P(label), both labels weighing the same."""
    total = 0.0
    for text, y, times in zip(texts, labels, stands_for, strict=True):
        clean = 1.0
        for words in plain_sentences(text):
            z = bias + sum(weights.get(f, 0.0) for w in words for f in X.features(w))
            clean *= (1 - 1 / (1 + math.exp(-z))) ** times
        share = 0.5 / sum(labels) if y else 0.5 / (len(labels) - sum(labels))
        total += share * math.log(1 - clean if y else clean)
    return total


def test_gradient_equals_differences():
    """Three rounds of training against Adagrad on a numeric gradient of the plain likelihood."""
    texts = ["you dimwit go. the river walks", "the green river. seven stones! walk", "a dimwit, a slimeball", "paper house | light and paper", "green green dimwit\nthe end", "seven"]
    labels, stands = [1, 0, 1, 0, 1, 0], [1.0, 1.0, 1.0, 2.5, 1.0, 1.0]
    used = sorted({f for t in texts for s in plain_sentences(t) for w in s for f in X.features(w)})
    for rounds in (1, 3):
        model = X.NoisyOr().fit(texts, labels, rounds=rounds, rate=0.5, decay=0.01, stands_for=stands)
        w, bias = dict.fromkeys(used, 0.0), X.NoisyOr().bias
        past, past_bias = dict.fromkeys(used, 1e-6), 1e-6
        for _ in range(rounds):
            eps = 1e-4
            slope = lambda moved, by: (plain_log_likelihood(moved(eps), bias + by * eps, texts, labels, stands) - plain_log_likelihood(moved(-eps), bias - by * eps, texts, labels, stands)) / (2 * eps)  # noqa: E731, B023
            grads = {f: slope(lambda e, f=f: w | {f: w[f] + e}, 0) - 0.01 * w[f] for f in used}  # noqa: B023
            pull = slope(lambda e: w, 1)  # noqa: B023
            for f, g in grads.items():
                past[f] += g * g
                w[f] += 0.5 * g / past[f] ** 0.5
            past_bias += pull**2
            bias += 0.5 * pull / past_bias**0.5
        assert np.allclose([model.weights[f] for f in used], [w[f] for f in used], rtol=1e-3, atol=1e-6)
        assert np.isclose(model.bias, bias, rtol=1e-4)


def test_sentence_scores_equal_plain_ones():
    model = X.NoisyOr()
    rng = np.random.default_rng(4)
    model.weights[:] = rng.normal(0, 1, len(model.weights))
    model.bias = -1.5
    scorer = X.Scorer(model)
    for text in ["", "One. Two words here! the the THE\n| last", "é Ünï 12 x_y. ... ?", "no end " * 50, "İstanbul. ß"]:
        score, spans = scorer.score(text)
        plain, clean = [], 1.0
        for words in plain_sentences(text.replace("İ", "i̇")):
            z = model.bias + sum(model.weights[f] for w in words for f in X.features(w))
            plain.append(1 / (1 + math.exp(-z)))
            clean *= 1 - plain[-1]
        with_words = [p for b, e, p in spans if any(c.isalpha() for c in text[b:e])]
        if "İ" not in text:
            assert np.allclose(with_words, plain)
            assert np.isclose(score, 1 - np.prod([1 - p for _, _, p in spans]))


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    rows = X.predict_toxicity(spark.read.parquet(f"{base}/documents.parquet"), labels, locate=True).collect()
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    pairs = [(y[r["id"]], r["predicted"]) for r in rows if r["id"] in y and not r["held_out"]]
    assert np.mean([a == b for a, b in pairs]) > 0.95
    held = [(y[r["id"]], r["predicted"]) for r in rows if r["id"] in y and r["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, "x"), (7, 0, "x"), (7, 1, "x"), (4, 0, "x"), (5, 0, "x"), (None, 1, "x"), (8, None, "x")], "doc_id long, toxic int, text string")
    rows = X.predict_toxicity(odd_documents, labels, max_chars=10**6).collect()
    assert len(rows) == 12
    assert {r["score"] for r in rows if r["id"] in (1, 2, 3)} == {0.0}
    none = X.predict_toxicity(odd_documents, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    assert X.predict_toxicity(no_documents, labels).count() == 0


def test_long_documents_are_learned(spark):
    """One label stands on documents of more than ``max_chars`` only."""
    rows = [(i, t if y else ". ".join([t] * 40), y) for i, t, y in planted(300, 3)]
    assert any(len(t) > 8000 for _, t, y in rows if not y)
    rows = [(i, t, y) for i, t, y in rows if y or len(t) > 8000]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["id"]: r["predicted"] for r in X.predict_toxicity(docs, labels).collect()}
    assert np.mean([got[i] == y for i, _, y in rows]) > 0.95


def test_spread_and_limit():
    text = ". ".join(f"s{i} word" for i in range(5000))
    part, times = X.spread(text, 1000)
    taken = X.sentences(part)
    assert len(part) <= 2100 and np.isclose(times * len(taken), 5000)
    places = [int(part[b:e].split()[0][1:]) for b, e in taken]
    assert places[0] < 100 and places[-1] > 4900 and places == sorted(places)
    assert X.spread(text, len(text)) == (text, 1.0)
    assert len(X.spread(" ".join("abcdefgh"[i % 8] * (1 + i % 99) for i in range(9000)), 500)[0]) <= 1100
    assert X._limit([5, 10, 100], 1000) == 100 and X._limit([5, 10, 100], 35) == 20
