import random
from collections import Counter

import numpy as np
import pytest

from aislewise.llm import suffix_dups as S


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count, first = Counter(), {}
    for i, b in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0)):
        for k in range(len(b) - length + 1):
            count[b[k : k + length]] += 1
            first.setdefault(b[k : k + length], (i, k))
    out = {}
    for keep in ("none", "first"):
        out[keep] = []
        for i, b in data:
            gone = bytearray(len(b))
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                if count[w] > 1 and (keep == "none" or first[w] != (i, k)):
                    gone[k : k + length] = b"\1" * length
            spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
            out[keep].append((i or 0, len(b), sum(gone), spans, bytes(x for x, y in zip(b, gone, strict=True) if not y)))
        out[keep].sort()
    return out


def collected(df):
    return sorted((r["id"] or 0, r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in df.collect())


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [text(rng.randrange(20, 90)) for _ in range(12)]
    rows = [(i, "".join(rng.choice(shared) if rng.random() < 0.6 else text(rng.randrange(1, 40)) for _ in range(rng.randrange(12)))) for i in range(150)]
    return rows + [(150, None), (151, ""), (152, "a" * 300), (153, "ab" * 200), (154, "a" * 41), (155, rows[3][1]), (156, rows[3][1])]


@pytest.mark.parametrize("bucket_rows", [2000, 3, 0])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_equals_brute_force(spark, passages, keep, bucket_rows):
    """By factors in buckets, by digests, and by both."""
    df = spark.createDataFrame([(i, t, "x") for i, t in passages], "doc_id long, text string, cover string").repartition(5)
    got = collected(S.remove_repeats(df, length=40, keep=keep, gram=12, bucket_rows=bucket_rows))
    assert got == brute(passages, 40)[keep]


def test_longest_previous():
    rng = random.Random(3)
    for _ in range(200):
        s = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 25)))
        order = sorted(range(len(s)), key=lambda i: s[i:])

        def common(a, b, s=s):
            n = 0
            while a + n < len(s) and b + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            return n

        lcp = np.array([0] + [common(order[r - 1], order[r]) for r in range(1, len(s))])
        best, source = S.longest_previous(np.array(order), lcp)
        for r, i in enumerate(order):
            assert best[r] == max([common(j, i) for j in range(i)], default=0)
            assert best[r] == 0 or (source[r] < i and common(source[r], i) == best[r])


def test_odd_rows(odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert collected(S.remove_repeats(odd_documents, length=100)) == brute(rows, 100)["none"]
    assert S.remove_repeats(no_documents).count() == 0
    with pytest.raises(ValueError):
        S.repeats(odd_documents, keep="last")


def test_long_texts_in_stretches(spark, monkeypatch):
    """Texts cut into stretches lose the same bytes as whole ones."""
    from aislewise.llm import anchors, suffix_dups

    rng = random.Random(12)
    block = lambda n: "".join(rng.choice("abcd \n") for _ in range(n))
    shared = [block(300), block(90), block(41)]
    texts = [block(200) + shared[0] + block(150) + shared[1] + block(700), shared[0][50:] + block(500) + shared[2] + shared[1], block(900) + shared[2] + shared[2], "x" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r["id"]: (r["n_removed"], bytes(r["kept"])) for r in S.remove_repeats(df, length=40, keep="none").collect()}
    assert sum(n for n, _ in want.values()) > 1000
    plain = anchors.stretches
    for size in (64, 200):
        monkeypatch.setattr(suffix_dups, "stretches", lambda t, length, size=size: plain(t, length, size))
        assert {r["id"]: (r["n_removed"], bytes(r["kept"])) for r in S.remove_repeats(df, length=40, keep="none").collect()} == want


def test_a_text_of_32_mb(spark):
    """One very long text that repeats a passage of a short one."""
    passage = " ".join(f"passage{i}" for i in range(60))
    long = " ".join(f"n{i}" for i in range(2_000_000)) + passage + " ".join(f"m{i}" for i in range(2_000_000))
    assert len(long) > 32_000_000 - 4_000_000
    df = spark.createDataFrame([(1, long), (2, "before " + passage + " after"), (3, "short")], "doc_id long, text string")
    got = {r["id"]: r["n_removed"] for r in S.remove_repeats(df).select("id", "n_removed").collect()}
    assert got == {1: len(passage), 2: len(passage), 3: 0}
