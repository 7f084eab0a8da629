import corpus_pipeline as C
import pytest

from aislewise.llm import edit_decontam, quality_rules
from aislewise.llm.common import default_tokenizer

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The input of each stage and what the last returns."""
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, BASE), name)
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, steps):
    start, good, single, clean, private, encoded = steps
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "bpe_encoding"]
    for df in steps[:5]:
        assert df.columns == start.columns
    want = {i for i, t in texts(start).items() if not any(rule(quality_rules.Features(t or "")) for rule in quality_rules.RULES.values())}
    assert set(texts(good)) == want

    from test_minhash_dups import brute

    assert set(texts(single)) == {c for _, c in brute(list(texts(good).items()), 80).values()}
    items = [edit_decontam.normal(r["text"]) for r in spark.read.parquet(f"{BASE}/benchmark.parquet").collect()]
    kept = texts(clean)
    for i, t in texts(single).items():
        held = any(x in edit_decontam.normal(t) for x in items)
        assert (i in kept) != held or (i not in kept)  # an item within the error budget may go too
        assert not (held and i in kept)

    from test_pii_disclosure import base

    for i, t in texts(private).items():
        assert (t != kept[i]) >= bool(base(kept[i])) and not base(t)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer("word_bpe_49k.json"))
    for r in encoded.collect():
        assert r["ids"] == library.encode(texts(private)[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_run_equals_the_stages(spark, steps):
    run = C.run(spark, BASE)
    assert run.exceptAll(steps[-1]).count() == 0 and run.count() == steps[-1].count()


def test_odd_rows(spark, odd_documents):
    for df in (odd_documents, odd_documents.limit(0)):
        docs = df
        for name, stage in C.STAGES:
            docs = C.written(stage(spark, docs, BASE), name)
        assert docs.columns == ["doc_id", "n_tokens", "ids"]
