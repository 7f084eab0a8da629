import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from aislewise.llm.bpe_pairs import PairIndexBPE, encode_texts
from aislewise.llm.common import default_tokenizer

PATH = default_tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(2)
    parts = ["a", "b", " ", "é", "é", "中", "😀", "\n", "the", "Σ", "\t", "x1", " $", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "İ", "\xa0", "\x1c", "\x0b", "ΑΣ ", "aaa", "!!!!", "<|", "ﬁ", "\x00", "\x85", "É", "×", "ß", "µ", "ª"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(800)] + ["", " ", "\n", "aaaaaaa" * 30, "a<|endoftext|>b"]


def test_equals_the_library(spark, library):
    rows = list(enumerate(odd_texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    columns = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    for r in encode_texts(df, PATH, columns=columns, block_chars=2000).collect():
        want = library.encode(rows[r["id"]][1], add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"]) == (want, len(want))
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_decode(library):
    bpe = PairIndexBPE(PATH)
    for text in odd_texts()[:100]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in docs.collect()}
    assert {r["id"]: r["ids"] for r in encode_texts(docs, PATH, columns=("ids",)).collect()} == want


def test_odd_rows(odd_documents, no_documents, library):
    rows = encode_texts(odd_documents, PATH).collect()
    want = sorted(len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd_documents.collect())
    assert sorted(r["n_tokens"] for r in rows) == want
    assert encode_texts(no_documents, PATH).count() == 0


@pytest.mark.parametrize("part", [1_500_000, 60, 1])
def test_index_holds_every_word(library, monkeypatch, part):
    """Repeated words are indexed at each of their places, not looked up: in parts of a block too."""
    bpe, indexed = PairIndexBPE(PATH), []
    plain = bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda codes: indexed.append(len(codes)) or plain(codes))
    texts = ["the cat, the CAT's hat", "", "the cat the cat", " ", "İx <|endoftext|>the", "the " * 50, "aaaa aaaa"] * 3 + odd_texts()[:60]
    ids, ends = bpe.encode_block(pa.array(texts), part)
    parts = [x for t in texts for piece in re.split(r"[ \t\n\v\f\r]+", t) for x in bpe.special_in.split(piece) if x]
    assert sum(indexed) == sum(1 if x in bpe.special else sum(map(len, bpe._pretokens(x))) for x in parts)
    begin = 0
    for text, end, read in zip(texts, ends.tolist(), bpe.decode_lists(ids, ends).to_pylist(), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[begin:end].tolist() == want and read == library.decode(want, skip_special_tokens=False)
        begin = end
