import gzip
import hashlib
import io
from base64 import b32encode

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, Not, StringStartsWith

from aislewise.llm import warc
from aislewise.llm.oracles import ORACLES

OP11 = ORACLES["op11_warc_archives"]
CLASHING = "id n_bytes digest payload found maybe revisit top_id key held".split()


def pages_of(spark, rows):
    schema = "page_id long, url string, html string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], schema)


def read_back(df, **options):
    return sorted((tuple(r) for r in warc.round_trip(df, **options).collect()), key=str)


def expected(rows, least=0):
    """By plain Python: of each payload's rows, the greatest by id and URL, one of equals, is the response."""
    out, groups = [], {}
    for page, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((page is not None, page or 0, url is not None, url or "", page))
    for payload, members in groups.items():
        members = sorted(members, reverse=True)
        digest = b32encode(hashlib.sha1(payload).digest()).decode()
        top = members[0][4]
        for i, (*_, page) in enumerate(members):
            again = i > 0 and len(payload) >= least
            text = lambda x: None if x is None else str(x)
            out.append((text(page), len(payload), digest, "revisit" if again else "response", text(top) if again else None))
    return sorted(out, key=str)


ODD = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2\r\nWARC-Type: evil", "<p>one</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", "é" * 40_000), (6, "http://a/6", "\r\n\r\nWARC/1.1\r\n\r\n\x00😀"), (7, "http://a/7", "<p>one</p>"), (7, "http://a/7", "<p>one</p>"), (7, "http://a/70", "<p>one</p>"), (8, "u", "same"), (8, "u", "same"), (8, "u", "same"), (None, "http://n", "null id"), (None, None, "only nulls"), (None, None, "only nulls"), (9, "big", "word " * 600_000)]


@pytest.mark.parametrize("least", [0, 5])
def test_odd_rows(spark, least):
    assert read_back(pages_of(spark, ODD), min_bytes=least) == expected(ODD, least)


def test_against_sql(spark, tmp_path):
    import duckdb

    rows = [(i, f"http://x/{i}", f"page {i % 7 if i % 3 == 0 else i}") for i in range(300)] + [(1000, "z", None), (1001, "z", "")]
    df = pages_of(spark, rows).select("page_id", "url", "html")
    df.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    want = sorted(((str(a), b, c, d, None if e is None else str(e)) for a, b, c, d, e in con.execute(OP11).fetchall()), key=str)
    assert read_back(df) == want


def test_groups_beyond_the_broadcast_ones(spark):
    """Groups of too few rows to be broadcast take the way over the bit map, with the same result."""
    n = 24_000  # pairs: each has 1/12,000 of all rows in groups
    rows = spark.range(2 * n).selectExpr("id AS page_id", "concat('u', id) AS url", f"concat('text ', id % {n}) AS html")
    marked = warc.marked_pages(rows, "page_id", "url", "html")
    got = marked.groupBy("revisit").agg(F.count("*").alias("n"), F.sum((F.col("top_id") - F.col("id") == n).cast("int")).alias("right"), F.count("payload").alias("texts")).collect()
    assert {r["revisit"]: (r["n"], r["texts"]) for r in got} == {True: (n, 0), False: (n, n)}
    assert {r["revisit"]: r["right"] for r in got}[True] == n


def test_empty_table(spark):
    assert read_back(pages_of(spark, ODD).limit(0)) == []


def test_ids_of_text(spark):
    df = spark.createDataFrame([("a b>%é", "u", "x"), ("z", "u", "x")], "page_id string, url string, html string")
    assert [(r[0], r[3], r[4]) for r in read_back(df)] == [("a b>%é", "revisit", "z"), ("z", "response", None)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "out")
    warc.write_pages(pages_of(spark, ODD), path, maxFileBytes="1000")
    return path


def test_filters_are_pushed_and_right(spark, archive):
    every = warc.read_warc(spark, archive)
    rows = every.collect()
    assert len(rows) == len(ODD)
    for condition, keep in [
        ("record_type = 'revisit'", lambda r: r.record_type == "revisit"),
        ("record_type <> 'revisit' AND target_uri LIKE 'http://a/%'", lambda r: r.record_type != "revisit" and (r.target_uri or "").startswith("http://a/")),
        ("target_uri IS NULL", lambda r: r.target_uri is None),
        ("refers_to IN ('<urn:record:8>', 'none')", lambda r: r.refers_to == "<urn:record:8>"),
        ("target_uri > 'http://a/5' AND content_length > 100", lambda r: r.target_uri and r.target_uri > "http://a/5" and r.content_length > 100),
        ("headers['warc-date'] = date AND record_id <=> '<urn:record:5>'", lambda r: r.record_id == "<urn:record:5>"),
    ]:
        got = every.where(condition).collect()
        assert sorted(map(str, got)) == sorted(str(r) for r in rows if keep(r)), condition
    assert {r.http_length for r in rows if r.record_id == "<urn:record:5>"} == {80_000}
    assert all(r.payload is None for r in warc.read_warc(spark, archive, payload=False).collect())


class Counting(io.BytesIO):
    got = 0

    def read(self, n=-1):
        data = super().read(n)
        self.got += len(data)
        return data


def _record(kind, text, name="r"):
    return warc.member([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:record:{name}>"), ("Content-Type", "text/plain")], text, level=0)


def test_unwanted_payloads_are_not_read():
    data = b"".join(_record(k, b"x" * 3_000_000) for k in ("resource", "metadata", "resource"))
    f = Counting(data)
    reader = warc.WarcReader({"path": "x"}, None)
    assert list(reader.pushFilters([EqualTo(("record_type",), "metadata"), EqualTo(("content_length",), 1), Not(In(("record_id",), ("a",))), StringStartsWith(("date", "x"), "2")])) == [EqualTo(("content_length",), 1), StringStartsWith(("date", "x"), "2")]
    wanted = lambda fields: all(warc._holds(x, fields) for x in reader.filters)
    rows = list(warc.records(f, len(data), wanted, payload=False))
    assert [r["record_type"] for r in rows] == ["metadata"] and f.got < 300_000
    assert [len(r["payload"]) for r in warc.records(Counting(data), len(data), wanted, payload=True)] == [3_000_000]


def test_foreign_archives():
    """gzip members that do not say their length, and archives that are not packed."""
    raw = [f"WARC/1.0\r\nWARC-Type: {k}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for k, b in [("warcinfo", b""), ("resource", b"abc" * 100_000), ("conversion", b"\r\n\r\n")]]
    for data in (b"".join(raw), b"".join(map(gzip.compress, raw))):
        rows = list(warc.records(io.BytesIO(data), len(data), lambda f: f["warc-type"] != "resource", True))
        assert [(r["record_type"], r["payload"]) for r in rows] == [("warcinfo", b""), ("conversion", b"\r\n\r\n")]
        assert [r["content_length"] for r in warc.records(io.BytesIO(data), len(data), lambda f: True, False)] == [0, 300_000, 4]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-30]), len(data) - 30, lambda f: True, True))
    assert gzip.decompress(_record("resource", b"q")).startswith(b"WARC/1.1\r\nWARC-Type: resource")


def test_only_committed_archives_are_read(spark, archive):
    with open(f"{archive}/left-over.warc.gz", "wb") as f:
        f.write(b"half a rec")
    assert warc.read_warc(spark, archive).count() == len(ODD)
