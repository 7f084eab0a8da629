import random
import re

from aislewise.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_features_match_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "é ", "\n", "# ", "<| ", "a b c ", "\t", "zz"]) for _ in range(rng.randrange(80)))
        d = Q.Features(text)
        assert (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words) == brute(text)


def test_verdict_does_not_depend_on_the_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = Q.apply_rules(docs, order=list(Q.RULES))
    b = Q.apply_rules(docs, order=list(Q.RULES)[::-1])
    assert a.exceptAll(b).count() == 0 and a.count() == docs.count()
    kept = {r["doc_id"] for r in Q.keep_good(docs).collect()}
    assert kept == {r["id"] for r in a.where("kept").collect()}


def test_order_prefers_rejections_per_cost(spark):
    slow = lambda d: [Q.Features(d.text).n_repeat_words for _ in range(20)] is None  # noqa: E731  dear, rejects nothing
    rules = {"slow": slow, "short": lambda d: len(d.text) < 1000}
    docs = spark.createDataFrame([("a b c " * 300,), ("a",)] * 40, "text string")
    assert Q.rule_order(docs, rules=rules) == ["short", "slow"]


def test_labels_agree(spark):
    """No document of good quality is rejected but as too short, and most bad ones are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in Q.apply_rules(docs).collect() if r["id"] in good]
    assert not [r["id"] for r in rows if good[r["id"]] and not r["kept"] and r["n_words"] >= 50]
    bad = [r["kept"] for r in rows if not good[r["id"]]]
    assert sum(bad) <= 0.1 * len(bad)


def test_odd_rows(odd_documents, no_documents):
    rows = Q.apply_rules(odd_documents).collect()
    assert len(rows) == 12
    for r in rows:
        if r["id"] in (1, 2, 3):
            assert (r["n_words"], r["base_failed"], r["kept"]) == (0, True, False)
    assert Q.keep_good(odd_documents).columns == odd_documents.columns
    assert Q.apply_rules(no_documents).count() == 0 and Q.keep_good(no_documents).count() == 0
