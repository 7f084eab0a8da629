import math
import random
import re
import string

from pyspark.sql import functions as F

from aislewise.llm import pii_disclosure as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and max(map(int, m[0].split("."))) <= 255, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def odd_texts():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "x@y.z", "1.2.3.4", "256.1.1.1", "...", ".", "+1 202 555 0", "+", "(", ")", "-", " ", "4111111111111111", "4111 1111 1111 1111", "0", "12", "é😀", "\n", "%", "_", "4111-1111-1111-1111 ", "+49 (30) 1234567", "1.2.3", "@b.co", "0" * 20, "\r\n", "\x85"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1500)] + [None, "", "a." * 20_000, "a@b" + ".c" * 10_000, "1." * 20_000, "1 " * 20_000, "+1" + "2 " * 20_000 + "(", "+1" * 10_000, " 1.2.3.4" * 1000]


def test_base_equals_brute_force(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in P.personal_spans(df).collect():
        assert r["base"] == base(texts[r["id"]]), texts[r["id"]][:100]
        assert r["n_ip"] == r["base"].count("ip:") and r["n_card"] == r["base"].count("card:")


def planted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(7))
    line = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, line(40)) for i in range(100)]
    docs += [(100 + i, f"{line(10)} zorblatt mail joe@corp.example.org about {line(10)}") for i in range(4)]  # four surroundings
    docs += [(110, f"{line(20)} Zorblatt again {word()}")]
    docs += [(120 + i, "quuxfoo mail ann@corp.example.org now") for i in range(5)]  # one surrounding and its copies
    return docs


def entities(text):
    return {f"{k}:{text[int(b) : int(e)].lower()}" for k, b, e in (s.split(":") for s in base(text).split(",") if s)}


WORD = re.compile(r"[^\W_]+")


def brute_terms(docs, min_different=2, min_share=0.5, min_bits=3.0):
    """The disclosing terms, by counting all texts: whole documents, terms of any length."""
    texts = [t or "" for _, t in docs]
    terms, held = [set(WORD.findall(t.lower())) for t in texts], [entities(t) for t in texts]
    out = set()
    for entity in set().union(*held):
        around = [i for i, h in enumerate(held) if entity in h]
        for term in set().union(*(terms[i] for i in around)):
            joint = [i for i in around if term in terms[i]]
            df = sum(term in t for t in terms)
            bits = math.log2(len(joint) * len(docs) / (df * len(around)))
            if len({texts[i] for i in joint}) >= min_different and len(joint) >= min_share * df and bits >= min_bits:
                out.add(term)
    return out


def brute_spans(text, terms):
    """All spans of a text, as the operator writes them."""
    spans = [(int(b), int(e)) for _, b, e in (s.split(":") for s in base(text).split(",") if s)]
    words = [m.span() for m in WORD.finditer(text or "") if m[0].lower() in terms]
    apart = [f"term:{b}:{e}" for b, e in words if not any(b < y and x < e for x, y in spans)]
    return ",".join([s for s in [base(text)] if s] + apart)


def test_spans_equal_brute_force_of_the_method(spark):
    """Random corpora: rare and common words, entities of all kinds near and far, copies, nulls."""
    rng = random.Random(17)
    people = ["joe@corp.example.org", "10.1.2.3", "+49 30 1234567", "4111 1111 1111 1111", "Ann.B@x.yz", "+1 (202) 555-0100"]
    docs = []
    for i in range(260):
        words = [f"w{rng.randrange(4000)}" if rng.random() < 0.5 else rng.choice("the of and a to in".split()) for _ in range(rng.randrange(3, 60))]
        if rng.random() < 0.2:
            k = rng.randrange(len(people))
            words.insert(rng.randrange(len(words)), f" {people[k]} ")
            words.insert(rng.randrange(len(words)), rng.choice([f"name{k}", f"NAME{k}", f"{k}z", "the"]))
        elif rng.random() < 0.1:
            words.append(f"name{rng.randrange(6)}")
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, docs[i][1]) for i in range(60)] + [(2000, None), (2001, "")]
    terms = brute_terms(docs)
    assert len(terms) > 5 and "the" not in terms
    got = {r["id"]: r["spans"] for r in P.personal_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: brute_spans(t, terms) for i, t in docs}


def test_long_texts_take_time_in_proportion(spark):
    """16 times the words and spans take far less than 16 * 16 times the time."""
    import time

    def seconds(n):
        text = " ".join(f"user{i}@mail.example.org w{i} +49 30 {1000000 + i}" for i in range(n))
        df = spark.createDataFrame([(1, text), (2, text[:200] + " end"), (3, "nothing here")], "doc_id long, text string").repartition(1)
        begin = time.perf_counter()
        row = P.personal_spans(df).where("id = 1").first()
        clean = P.sanitise(df).where("doc_id = 1").first()["text"]
        assert row["n_email"] == n and row["n_phone"] == n
        assert clean.count("[EMAIL]") == n and clean.count("[PHONE]") == n and "@" not in clean
        return time.perf_counter() - begin

    seconds(100)
    assert seconds(16_000) < 40 + 16 * seconds(1_000)


def test_disclosing_terms(spark):
    docs = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    terms = brute_terms(docs)
    assert "zorblatt" in terms and "quuxfoo" not in terms
    for r in P.personal_spans(df).collect():
        text = dict(docs)[r["id"]]
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert r["spans"].startswith(r["base"])
        got = {(int(b), int(e)) for k, b, e in spans if k == "term"}
        mails = [m.span() for m in re.finditer(PATTERNS["email"], text)]
        words = [m for m in WORD.finditer(text) if m[0].lower() in terms]
        assert got == {m.span() for m in words if not any(m.start() < e and b < m.end() for b, e in mails)}
    clean = {r["doc_id"]: r["text"] for r in P.sanitise(df).collect()}
    assert clean[110].count("[TERM]") == 1 and "orblatt" not in clean[110]
    assert "[EMAIL]" in clean[100] and "@" not in clean[100] and "quuxfoo" in clean[120]
    assert all(clean[i] == t for i, t in docs if i < 100)


def test_sanitise_replaces_every_span(spark):
    texts = [t for t in odd_texts() if t and len(t) < 2000]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, spans string, cuts string")
    out = P.sanitise(df, min_different=10**6)  # base spans only
    assert out.columns == df.columns
    for r in out.collect():
        text, want, end = texts[r["doc_id"]], [], 0
        spans = sorted((int(b), int(e), k) for k, b, e in (s.split(":") for s in base(text).split(",") if s))
        merged = []
        for b, e, k in spans:
            if merged and b < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([b, e, k])
        for b, e, k in merged:
            want.append(text[end:b] + f"[{k.upper()}]")
            end = e
        assert r["text"] == "".join(want) + text[end:]


def test_no_python_in_the_plan(spark):
    from aislewise.llm.registry import QUERIES

    df = QUERIES["op7_pii_disclosure"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(odd_documents, no_documents):
    rows = P.personal_spans(odd_documents).collect()
    assert len(rows) == 12 and all(r["spans"] == "" for r in rows)
    clean = P.sanitise(odd_documents)
    assert clean.columns == odd_documents.columns
    assert clean.exceptAll(odd_documents).count() == 0 and clean.count() == 12
    assert P.personal_spans(no_documents).count() == 0 and P.sanitise(no_documents).count() == 0
    assert clean.where(F.col("text").isNull()).count() == 2


def test_disclosure_in_whole_documents(spark):
    """Terms far from the entity count, and short ones; common short words are left out."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(6))
    far = lambda: " ".join(f"{word()} of" for _ in range(40))
    phone = "+49 30 12345678"
    docs = [(i, f"{far()} the end") for i in range(80)]
    docs += [(100 + i, f"Zorblatt {far() if i < 7 else ''} call {phone}") for i in range(10)]  # in 7 of 10 far apart
    docs += [(200 + i, f"By Kim {far()}\nfooter " + "x" * 90 + " kim99@corp.example.org") for i in range(4)]  # header and footer
    docs += [(300, "Later zorblatt and Kim met"), (301, "the end of it")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in P.sanitise(df).collect()}
    assert clean[300] == "Later [TERM] and [TERM] met"
    assert clean[301] == "the end of it" and all(clean[i] == t for i, t in docs if i < 100)
    assert clean[100].startswith("[TERM] ") and clean[200].startswith("[TERM] [TERM] ")
