import numpy as np

from aislewise.llm import byte_cnn as C


def test_gradients():
    """Analytic gradients against differences."""
    net = C.ByteCNN(["a", "b", "c"], embed=3, filters=4, seed=1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (5, C.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, g = net.step(x, y)
    for k in net.p:
        flat, grad = net.p[k].reshape(-1), g[k].reshape(-1)
        for i in np.argsort(-np.abs(grad))[:3]:
            old, eps = flat[i], 1e-5
            flat[i] = old + eps
            up, _ = net.step(x, y)
            flat[i] = old - eps
            down, _ = net.step(x, y)
            flat[i] = old
            assert abs((up - down) / (2 * eps) - grad[i]) < 1e-3 * max(1, abs(grad[i])), k


def test_tables_equal_the_network():
    net = C.ByteCNN(["a", "b"], seed=2)
    x = np.random.default_rng(1).integers(0, 256, (70, C.WINDOW)).astype(np.uint8)
    pooled = []
    e = net.p["E"][x]
    for w in C.WIDTHS:
        z = sum(e[:, j : C.WINDOW - w + 1 + j] @ net.p[f"W{w}"][j * net.embed : (j + 1) * net.embed] for j in range(w))
        pooled.append(z.max(axis=1) + net.p[f"b{w}"])
    s = np.maximum(np.concatenate(pooled, axis=1), 0) @ net.p["V"] + net.p["c"]
    s = np.exp(s - s.max(axis=1, keepdims=True))
    assert np.allclose(net.probabilities(x, net.tables()), s / s.sum(axis=1, keepdims=True), atol=1e-4)


def test_windows_cover_the_text():
    texts = [bytes(range(1, 256)) * 5, b"", b"abc", b"x" * C.WINDOW, b"y" * (C.WINDOW + 1)]
    x, owner = C.windows_of(texts, C.WINDOW - 3)
    for i, t in enumerate(texts):
        grams = {t[j : j + 4] for j in range(len(t) - 3)}
        rows = [r.tobytes() for r in x[owner == i]]
        assert rows and grams <= {r[j : j + 4] for r in rows for j in range(C.WINDOW - 3)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = C.predict_languages(docs, sample_rows=600).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and 150 < len(held) < 350
    assert np.mean([r["lang_pred"] == lang[r["id"]] for r in held if lang[r["id"]]]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(odd_documents, no_documents):
    """Without labels everything is unknown."""
    rows = C.predict_languages(odd_documents).collect()
    assert len(rows) == 12 and {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}
    net = C.train([(w, lang) for t, lang in [("the of and " * 20, "en"), ("der die das " * 20, "de")] for w in C.spread_windows(t.encode(), 4)], epochs=2)
    found = {r["id"]: r["lang_pred"] for r in C.identify(odd_documents, net).collect()}
    assert found[1] == found[2] == found[3] == "und" and found[7] in ("en", "de")
    assert C.identify(no_documents, net).count() == 0 and C.predict_languages(no_documents).count() == 0


def test_learns_from_the_whole_text(spark):
    """Every text opens with the same long header: only what follows tells the languages apart."""
    rows = [(i, "HEADER 000 " * 1500 + ("the river and the stone " if i % 2 else "der fluss und das haus ") * 2000, "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["id"]: r["lang_pred"] for r in C.predict_languages(docs).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    windows = C.spread_windows(bytes(range(256)) * 16, 4)
    assert len(windows) == 4 and all(len(w) == C.WINDOW for w in windows) and C.spread_windows(b"", 4) == [bytes(C.WINDOW)]
