"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded; filters of several widths slide over a window of fixed length; the maximum of
each filter over the window, after a ReLU, goes through one linear layer and a softmax. Training is
minibatch Adam on windows of a bounded sample of labelled rows (``sample_rows``, split evenly over
the languages, chosen by a hash of the id; a few windows of each, spread over its whole text). All windows of a whole text are applied, and a text's
probabilities are the windows' mean, weighted by their letters.

For application, what a filter adds for a pair of bytes is looked up in a table of 65,536 rows.

Defined cases: a null text or one without letters is ``und`` with score 0; a missing label or id is
not learned from; with no labelled row everything is ``und``; rows are judged one by one, so repeated
rows give equal results; of equal probabilities the first language by name counts; very long texts are applied
whole, some 64 windows at a time; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import chosen_by_hash, columns_of, held_out, map_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"


def windows_of(texts: list[bytes], step: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts as rows of bytes, zeros behind the end, and whose they are. They begin
    every ``step`` bytes."""
    rows, owner = [], []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - (WINDOW - step)), step):
            rows.append(t[at : at + WINDOW].ljust(WINDOW, b"\0"))
            owner.append(i)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW), np.array(owner, np.int64)


class ByteCNN:
    """The network: parameters by name, in 32 bits."""

    def __init__(self, classes: list[str], embed: int = 8, filters: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes, self.embed, self.filters = classes, embed, filters
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"E": normal(256, embed, scale=0.5)}
        for w in WIDTHS:
            self.p[f"W{w}"] = normal(w * embed, filters, scale=(2 / (w * embed)) ** 0.5)
            self.p[f"b{w}"] = np.zeros(filters, np.float32)
        self.p["V"] = normal(len(WIDTHS) * filters, len(classes), scale=0.2)
        self.p["c"] = np.zeros(len(classes), np.float32)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss of a batch of windows and its gradients."""
        p, n = self.p, len(x)
        e = p["E"][x]  # n, WINDOW, embed
        pooled, best = [], []
        for w in WIDTHS:
            patches = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, -1)
            z = patches @ p[f"W{w}"]
            k = z.argmax(axis=1)  # n, filters
            best.append((k, np.take_along_axis(patches, k[:, :, None], axis=1)))
            pooled.append(np.take_along_axis(z, k[:, None, :], axis=1)[:, 0] + p[f"b{w}"])
        h = np.concatenate(pooled, axis=1)
        a = np.maximum(h, 0)
        s = a @ p["V"] + p["c"]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        loss = -np.log(s[np.arange(n), y] + 1e-9).mean()
        s[np.arange(n), y] -= 1
        s /= n
        g = {"V": a.T @ s, "c": s.sum(axis=0), "E": np.zeros_like(p["E"])}
        da = (s @ p["V"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            d = da[:, i * self.filters : (i + 1) * self.filters]  # n, filters
            k, patch = best[i]
            g[f"b{w}"] = d.sum(axis=0)
            g[f"W{w}"] = np.einsum("nfe,nf->ef", patch, d)
            back = d[:, :, None] * p[f"W{w}"].T[None]  # n, filters, w * embed
            for j in range(w):
                bytes_at = np.take_along_axis(x, k + j, axis=1)
                np.add.at(g["E"], bytes_at, back[:, :, j * self.embed : (j + 1) * self.embed])
        return float(loss), g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                _, g = self.step(x[rows], y[rows])
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def tables(self) -> dict:
        """For each width, what a filter adds for each pair of bytes, or for a last single byte."""
        out = {}
        for w in WIDTHS:
            add = [self.p["E"] @ self.p[f"W{w}"][j * self.embed : (j + 1) * self.embed] for j in range(w)]  # 256, filters
            parts = []
            for j in range(0, w, 2):
                parts.append((j, (add[j][:, None] + add[j + 1][None]).reshape(65536, -1).astype(np.float32) if j + 1 < w else add[j].astype(np.float32)))
            out[w] = parts
        return out

    def probabilities(self, x: np.ndarray, tables: dict) -> np.ndarray:
        """Of each window (rows of bytes) and class."""
        pooled = np.empty((len(x), len(WIDTHS) * self.filters), np.float32)
        for at in range(0, len(x), 64):
            part = x[at : at + 64].astype(np.int32)
            pairs = part[:, :-1] << 8 | part[:, 1:]
            for i, w in enumerate(WIDTHS):
                length = WINDOW - w + 1
                z = None
                for j, table in tables[w]:
                    found = table[(pairs if len(table) > 256 else part)[:, j : j + length]]
                    z = found if z is None else z + found
                pooled[at : at + 64, i * self.filters : (i + 1) * self.filters] = z.max(axis=1) + self.p[f"b{w}"]
        s = np.maximum(pooled, 0) @ self.p["V"] + self.p["c"]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)


def spread_windows(text: bytes, n: int) -> list[bytes]:
    """Up to ``n`` different windows at places spread over a whole text."""
    count = max(1, -(-len(text) // WINDOW))
    places = sorted({count * i // n for i in range(n)})
    return [text[k * WINDOW : (k + 1) * WINDOW].ljust(WINDOW, b"\0") for k in places]


def training_sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column, sample_rows: int, windows_each: int = 4) -> list[tuple[bytes, str]]:
    """(window, language) of at most ``sample_rows`` texts, as many of each language as there are, chosen
    by a hash of the id, and ``windows_each`` windows of each, spread over the whole text. First ids are chosen,
    without texts; then those texts are read, and cut in tasks: only windows come to the driver."""
    rows = df.where(learn).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    n = rows.select("lang").distinct().count()
    if not n:
        return []
    chosen = chosen_by_hash(rows.select("id", "lang"), "lang", max(1, sample_rows // n)).orderBy("lang", "id").limit(sample_rows)
    ids = [r["id"] for r in chosen.select("id").collect()]
    found = rows.where(F.col("id").isin(ids)).select(F.struct("id", "lang").alias("key"), "text")

    def make():
        def work(keys, texts):
            parts = [spread_windows(t.encode(), windows_each) for t in texts]
            return {"key": [k for k, p in zip(keys, parts, strict=True) for _ in p], "place": [i for p in parts for i in range(len(p))], "part": [w for p in parts for w in p]}

        return work

    kind = found.schema["key"].dataType.simpleString()
    cut = map_texts(found, make, f"key {kind}, place int, part binary").orderBy("key", "place", "part").limit(2 * sample_rows * windows_each)
    return [(bytes(r["part"]), r["key"]["lang"]) for r in cut.collect()]


def train(sample: list[tuple[bytes, str]], epochs: int = 6) -> ByteCNN | None:
    """A network from (window, language) pairs."""
    classes = sorted({lang for _, lang in sample})
    if not classes:
        return None
    x = np.frombuffer(b"".join(w for w, _ in sample), np.uint8).reshape(-1, WINDOW)
    net = ByteCNN(classes)
    net.train(x, np.array([classes.index(lang) for _, lang in sample]), epochs)
    return net


def identify(df: DataFrame, net: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``lang_pred`` and ``score``. Narrow: no shuffle."""

    def make():
        tables = net.tables() if net else None

        def work(ids, texts):
            out = {"id": ids, "lang_pred": [UNKNOWN] * len(ids), "score": [0.0] * len(ids)}
            some = [i for i, t in enumerate(texts) if net and any(map(str.isalpha, t))]
            if some:
                x, owner = windows_of([texts[i].encode() for i in some], WINDOW - max(WIDTHS) + 1)
                letters = ((x >= 65) & (x <= 90) | (x >= 97) & (x <= 122) | (x >= 128)).sum(axis=1) + 1e-3
                p = net.probabilities(x, tables) * letters[:, None]
                total = np.add.reduceat(p, np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)
                total /= total.sum(axis=1, keepdims=True)
                best = total.argmax(axis=1)
                for i, k, row in zip(some, best.tolist(), total, strict=True):
                    out["lang_pred"][i], out["score"][i] = net.classes[k], min(1.0, float(row[k]))
            return out

        return work

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(columns_of(df, id_col, text_col), make, f"id {kind}, lang_pred string, score double", rows=64)


def predict_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, part: int = 2, sample_rows: int = 2000) -> DataFrame:
    """Train on rows outside a fold of the ids' crc32 and predict all rows: ``id``, ``held_out``,
    ``lang_pred``, ``score``."""
    fold = held_out(F.col(id_col), parts, part)
    net = train(training_sample(df, id_col, text_col, lang_col, ~fold, sample_rows))
    return identify(df, net, id_col, text_col).select("id", held_out(F.col("id"), parts, part).alias("held_out"), "lang_pred", "score")
