import random
import re
from collections import Counter, defaultdict

import pytest

from aislewise.llm import minhash_dups as M
from aislewise.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, k=5):
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute(rows, percent=85):
    sets = sets_of(rows)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        seen = Counter(j for x in sets[i] for j in holders[x])
        for j, n in seen.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in sets[i]:
            holders[x].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def families():
    """Groups of near copies at all distances around the threshold, copies, short and empty texts."""
    rng = random.Random(9)
    rows, n = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(5, 160))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            copy = list(words)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(100)}"
            if rng.random() < 0.2:
                copy = copy[: len(copy) // 2] + ["Cut"] + copy[len(copy) // 2 :]
            rows.append((n, " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)))
            n += 1
    rows += [(n + i, t) for i, t in enumerate(["a b", "A  b", "a", None, "", " ", "a b c d e", "A B C D E", rows[0][1], rows[0][1]])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [{}, {"group_rows": 0}, {"group_items": 300}])
def test_equals_brute_force(spark, families, settings):
    """In groups, by rounds of pivots, and by both."""
    df = spark.createDataFrame(families, "doc_id long, text string").repartition(3)
    want = brute(families)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(df, **settings).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_keep_one(spark, families):
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in families], "doc_id long, text string, kept string, id string")
    kept = M.keep_one(df, percent=85)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in brute(families).values()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)] + [(7, 7), (5, 4), (4, 5)]
    parent = {x: x for e in edges for x in e}
    for _ in range(len(parent)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: c for x, c in parent.items() if x != c}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(odd_documents, no_documents):
    rows = [(r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in M.near_duplicates(odd_documents).collect()]
    assert (1, 0, 1, True) in rows and (2, 0, 2, True) in rows and (4, 1, 4, True) in rows
    assert rows.count((6, 1, 5, False)) == 2  # copies of 5
    assert [r[2] for r in rows if r[0] == 8] == [7]
    assert all(r[3] is False for r in rows if r[0] is None)
    assert M.near_duplicates(no_documents).count() == 0
    assert sorted(r["doc_id"] or 0 for r in M.keep_one(odd_documents).collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 9]


def test_keep_one_row_of_each_component(spark):
    """Repeated rows, null ids and an id that stands on two texts."""
    text = lambda a, n=40: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("a")), (1, text("a"))]  # repeated rows
    rows += [(None, text("b")), (None, text("b")), (None, text("b") + " end")]  # only null ids, one a near copy
    rows += [(3, text("c")), (5, text("c") + " end"), (5, text("d"))]  # 5 is a near copy and a unique text
    rows += [(None, text("e")), (9, text("e") + " end"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = [(1, text("a")), (3, text("c")), (5, text("d")), (9, text("e") + " end"), (None, None), (None, "")]
    got = [tuple(r) for r in M.keep_one(df).collect()]
    assert sorted(str(r) for r in got if not (r[1] or "").startswith("b0")) == sorted(map(str, want))
    assert sum((t or "").startswith("b0") for _, t in got) == 1
    for settings in ({"group_rows": 0}, {}):
        found = M.near_duplicates(df.where("text LIKE 'b0%' OR text LIKE 'e0%'"), **settings)
        assert sorted(r["component_id"] or 0 for r in found.collect()) == [0, 0, 0, 9, 9]


def test_chain_through_null_ids(spark):
    """1 and 2 link only through a text without an id."""
    w = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(w)), (None, " ".join(w + [f"x{i}" for i in range(24)])), (2, " ".join(w + [f"x{i}" for i in range(52)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in M.keep_one(df, percent=85).collect()] == [1]


def test_components_with_hubs(spark, monkeypatch):
    """Hubs by broadcast and other nodes by a join, in one graph: stars, chains and cycles, in mixed order."""
    import random

    from aislewise.llm import components

    monkeypatch.setattr(components, "HUBS", 20)
    rng = random.Random(6)
    edges = [(5, i) for i in range(1000, 1600)] + [(9000, i) for i in range(1500, 1700)] + [(i, i + 1) for i in range(2000, 2200)] + [(i, (i + 7) % 50 + 3000) for i in range(3000, 3050)]
    edges += [(rng.randrange(4000, 4400), rng.randrange(4000, 4400)) for _ in range(350)]
    edges = [rng.sample(e, 2) for e in edges]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(root) if find(x) != x}
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame([tuple(e) for e in edges], "u long, v long")).collect()}
    assert got == want


def test_long_texts_in_stretches(monkeypatch):
    """Stretches of any size give the hashes of the text as a whole, giant words included."""
    import random

    from aislewise.llm import shingles

    rng = random.Random(8)
    texts = [" ".join("x" * rng.choice([1, 3, 700, 40]) + str(rng.randrange(50)) for _ in range(300)) for _ in range(5)]
    texts += ["y" * 5000, " " + "z" * 3000 + "\t\n" + "Z" * 4000 + " end ", "", "a b", " " * 4000]
    want = [s.tolist() for s in shingles.shingle_sets(texts)]
    for size in (64, 100, 999):
        monkeypatch.setattr(shingles, "STRETCH", size)
        assert [s.tolist() for s in shingles.shingle_sets(texts)] == want


def test_a_text_of_32_mb_in_little_memory():
    """Memory of a worker for one text of 32 MB: far below the 50 bytes for each that a stretch takes."""
    import os
    import subprocess
    import sys

    code = "import resource, sys; sys.path.insert(0, '.'); from aislewise.llm.shingles import shingle_sets; t = ' '.join(f'w{i}' for i in range(4_000_000)); before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; s = shingle_sets([t]); print(len(t), len(s[0]), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    size, n, mb = map(int, out.stdout.split())
    assert size > 32_000_000 and n == 3_999_996 and mb < 600
