import random

from aislewise.llm import edit_decontam as D


def distance(item, text):
    """Least edit distance of ``item`` to a part of ``text``, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def whole(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_matches_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        item = D.normal("".join(rng.choice("abc de") for _ in range(rng.randrange(1, 60)))) or "a"
        s = list(item)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randrange(2)] = rng.choice(["", "a", "e", "x"])
        text = D.normal("".join(rng.choice("abc de") for _ in range(rng.randrange(80))) + "".join(s) + "".join(rng.choice("abc de") for _ in range(80)))
        found = D.Matcher([("k", item)], 0.1).find(text)
        least = distance(item, text)
        assert bool(found) == (least <= len(item) // 10)
        if found:
            _, begin, end, d = found[0]
            assert d == least == whole(item, text[begin:end])


def test_blocks_and_filter(spark):
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    items = [(i, line(20)) for i in range(6)] + [(6, None), (7, "  "), (8, None)]
    items[5] = (5, items[0][1].upper() + "\n")  # equal to item 0 but for case and blanks
    rows = [(i, line(30)) for i in range(20)] + [(20, line(5) + " " + items[1][1] + " " + line(5)), (21, items[2][1].replace("a", "z", 2)), (22, items[0][1].replace(" ", "\n  ")), (22, items[0][1]), (23, None), (24, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    for block in (1 << 20, 150):
        found = D.find_items(docs, bench, block_bytes=block)
        assert sorted((r["id"], r["item_id"], r["distance"]) for r in found.collect()) == [(20, 1, 0), (21, 2, min(2, items[2][1].count("a"))), (22, 0, 0), (22, 0, 0), (22, 5, 0), (22, 5, 0)]
        clean = D.keep_clean(docs, bench, block_bytes=block)
        assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [*range(20), 23, 24]
    assert D.find_items(docs, bench.limit(0)).count() == 0 and D.keep_clean(docs, bench.limit(0)).count() == len(rows)
    assert D.find_items(docs.limit(0), bench).count() == 0


def test_query_against_whole_items(spark):
    """Every item that stands whole in a document is found, and nothing in documents without one."""
    from aislewise.llm.registry import QUERIES

    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet").collect()
    items = spark.read.parquet(f"{base}/benchmark.parquet").collect()
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if D.normal(i["text"]) in D.normal(d["text"] or "")}
    got = QUERIES["op1_edit_decontamination"](spark, base).collect()
    assert want and {(r["doc_id"], r["item_id"]) for r in got if r["distance"] == 0} == want
    assert all(r["distance"] <= 0.08 * 400 for r in got)


def test_odd_rows(odd_documents, spark):
    bench = spark.createDataFrame([(1, "one two three four"), (2, "word5 and5 word6 and6 word7 and7")], "item_id long, text string")
    got = sorted((r["id"] or 0, r["item_id"]) for r in D.find_items(odd_documents, bench).collect())
    assert got == [(5, 1), (6, 1), (6, 1), (7, 2), (8, 2)]
