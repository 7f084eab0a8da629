import random

import pytest

from aislewise.llm.common import default_tokenizer
from aislewise.llm.token_counts import PieceCounter, count_tokens

MODEL = default_tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(n, size):
    rng = random.Random(size)
    parts = ["a", "b", " ", "  ", "é", "中", "😀", "\n", "the", "▁", "\t", " x1", " $", "<s>", "ing", "straße "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(size))) for _ in range(n)] + ["", " ", "  ", "a ", " a", "a  ", "\n", "▁", "▁▁a", "x" * 300, "中" * 90]


@pytest.mark.parametrize("size,overlap", [(32, 2), (64, 8), (200, 16), (1 << 20, 256)])
def test_equals_the_library(library, size, overlap):
    """Chunks so short that boundaries must be searched for, and overlaps widened, everywhere."""
    counter = PieceCounter(MODEL, size, overlap)
    for part in (texts(200, 300), texts(50, 1500)):
        assert counter.count_all(part) == [len(library.encode(t)) for t in part]
        assert [counter.count_long(t.replace("▁", " ")) for t in part] == [len(library.encode(t)) for t in part]


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: len(library.encode(r["text"] or "")) for r in docs.collect()}
    got = count_tokens(docs, MODEL, limit=500, chunk_chars=1000, overlap=64).collect()
    assert {r["id"]: r["n_tokens"] for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 500) for r in got)


def test_odd_rows(odd_documents, no_documents, library):
    rows = count_tokens(odd_documents, MODEL).collect()
    texts_of = [(r["doc_id"], r["text"] or "") for r in odd_documents.collect()]
    assert sorted((r["id"] or 0, r["n_bytes"], r["n_tokens"]) for r in rows) == sorted((i or 0, len(t.encode()), len(library.encode(t))) for i, t in texts_of)
    assert count_tokens(no_documents, MODEL).count() == 0
