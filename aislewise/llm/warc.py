"""WARC archives as a Spark data source, and their writing with revisit records.

``WarcSource`` is a Python data source, ``format("warc")``. Reading plans its partitions from file
sizes: small archives share one, and none is split. Predicates on the record type and on the other
columns that come from WARC headers are pushed down. A record's headers are parsed first; if a predicate
fails, or no payload is wanted (option ``payload`` = ``false``), its payload is neither inflated nor decoded: in
archives that this module wrote, each gzip member says its own length (extra field ``sl``), so that the reader seeks
to the next. Others are inflated to their end and thrown away; plain ``.warc`` files are sought in by ``Content-Length``.

Writing: each task writes archives of up to ``max_file_bytes``, one gzip member a record, under names
that no other attempt uses; only on commit a list of a job's archives is published, and readers open
listed archives alone. So tasks may be repeated and lost.

``write_pages`` writes a record per row. Of records with equal payloads of at least ``min_bytes`` bytes the
one with the largest id is a ``response`` and the others are ``revisit`` records that refer to it, without
payload. Payloads are compared by SHA-1 and length, from narrow rows counted before they are shuffled. Groups
with over 1/10,000 of all rows in such groups (fewer than 10,000, so they are broadcast) mark their rows in
place; of other rows only those that a bit map finds are shuffled, by digest, and no digest there has more rows.
A response is the only row of its group whose text may travel further.

Defined cases: a null payload is empty; a null id is smaller than all others, null URLs than all other
URLs; of rows with the largest id the one with the largest URL is the response, and of repeated rows
one; repeated ids give records of one name; very long payloads are written whole, a record at a time; an
empty table gives no records; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from aislewise.llm.common import arrow_schema, maybe_in, written
from aislewise.session import scratch_path

#: Columns from WARC headers; predicates on them are pushed down.
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
SCHEMA = ", ".join(f"{c} string" for c in HEADER_OF) + ", content_length long, http_status int, http_length long, headers map<string,string>, payload binary"
#: What ``format("warc")`` writes: ``payload`` is null in revisits, ``n_bytes`` and ``digest`` (hex SHA-1) are of the full payload.
WRITE_SCHEMA = "record_id string, target_uri string, digest string, n_bytes long, refers_to string, payload string"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16
_LIST = "_archives-"


# -- archives ------------------------------------------------------------------------------------


class _Bytes:
    """A record's bytes in order, inflated as they are asked for; ``f`` stands where they begin."""

    def __init__(self, f, packed: bool):
        self.f, self.held = f, b""
        self.inflate = zlib.decompressobj(31) if packed else None

    def _more(self) -> bool:
        if self.inflate is None:
            new = data = self.f.read(_CHUNK)
        elif self.inflate.eof:
            return False
        else:
            data = self.inflate.unconsumed_tail or self.f.read(_CHUNK)
            new = self.inflate.decompress(data, _CHUNK)
        self.held += new
        return bool(data or new)

    def until(self, mark: bytes) -> bytes:
        """Up to and with ``mark``."""
        while mark not in self.held:
            if not self._more():
                raise ValueError("a record ends within its headers")
        head, _, self.held = self.held.partition(mark)
        return head + mark

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self._more():
                raise ValueError("a record ends within its block")
            parts.append(self.held)
            have += len(self.held)
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]

    def finish(self) -> int:
        """Where the next gzip member begins."""
        while not self.inflate.eof:
            self.held = b""
            if not self._more():
                raise ValueError("an archive ends within a record")
        return self.f.tell() - len(self.inflate.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _member_length(head: bytes) -> int | None:
    """The length of a gzip member that says it in an extra field ``sl`` of its header."""
    if len(head) < 24 or not head[3] & 4 or head[12:14] != b"sl":
        return None
    return struct.unpack_from("<I", head, 16)[0] or None


def records(f, size: int, wanted, payload: bool) -> Iterator[dict]:
    """The records of an archive for which ``wanted(headers)`` holds, as rows of ``SCHEMA``."""
    f.seek(0)
    packed, at = f.read(2) == b"\x1f\x8b", 0
    while at < size:
        f.seek(at)
        length = _member_length(f.read(24)) if packed else None
        f.seek(at)
        data = _Bytes(f, packed)
        head = data.until(b"\r\n\r\n")
        fields = _fields(head)
        block = int(fields["content-length"])
        if wanted(fields):
            yield _row(fields, data, block, payload)
        if length:
            at += length
        elif packed:
            at = data.finish()
        else:
            at += len(head) + block + 4


def _row(fields: dict[str, str], data: _Bytes, block: int, payload: bool) -> dict:
    row = {c: fields.get(h) for c, h in HEADER_OF.items()}
    row |= {"content_length": block, "http_status": None, "http_length": None, "headers": list(fields.items()), "payload": None}
    left = block
    if (row["content_type"] or "").startswith("application/http") and block:
        head = data.until(b"\r\n\r\n")
        left -= len(head)
        first, http = head.split(b"\r\n", 1)[0].split(), _fields(head)
        row["http_status"] = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
        row["http_length"] = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    if payload and row["record_type"] != "revisit":
        row["payload"] = data.take(left)
    return row


def member(fields: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member that says its length."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    raw = b"".join([head.encode(), block, b"\r\n\r\n"])
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    total = 24 + len(body) + 8
    sizes = (total, len(raw)) if max(total, len(raw)) < 1 << 32 else (0, 0)  # 0: not said
    extra = b"sl" + struct.pack("<HII", 8, *sizes)
    return b"".join([b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", struct.pack("<H", len(extra)), extra, body, struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)])


# -- the data source -----------------------------------------------------------------------------


def _holds(f, fields: dict[str, str]) -> bool | None:
    """A pushed filter on a record's headers, with SQL's nulls."""
    kind = type(f).__name__
    if kind == "Not":
        inner = _holds(f.child, fields)
        return None if inner is None else not inner
    value = fields.get(HEADER_OF[f.attribute[0]])
    if kind in ("IsNull", "IsNotNull"):
        return (value is None) == (kind == "IsNull")
    want = None if kind == "In" else f.value
    if kind == "EqualNullSafe":
        return value == want
    if value is None or (kind != "In" and want is None):
        return None
    if kind == "In":
        return value in f.value or (None if None in f.value else False)
    if kind == "EqualTo":
        return value == want
    if kind in ("StringStartsWith", "StringEndsWith", "StringContains"):
        return value.startswith(want) if kind == "StringStartsWith" else value.endswith(want) if kind == "StringEndsWith" else want in value
    a, b = value.encode(), want.encode()  # in Spark's order
    return {"GreaterThan": a > b, "GreaterThanOrEqual": a >= b, "LessThan": a < b, "LessThanOrEqual": a <= b}[kind]


_KINDS = {"EqualTo", "EqualNullSafe", "In", "IsNull", "IsNotNull", "StringStartsWith", "StringEndsWith", "StringContains", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual"}


def _pushable(f) -> bool:
    if type(f).__name__ == "Not":
        return _pushable(f.child)
    return type(f).__name__ in _KINDS and len(f.attribute) == 1 and f.attribute[0] in HEADER_OF


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path: ``file:``, ``s3:``, ``gs:``, ``hdfs:`` or none."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


class Archives(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, arrow: pa.Schema):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.most, self.filters, self.arrow = int(options.get("maxpartitionbytes", 32 << 20)), [], arrow

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            if _pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _open(self.path)
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        sizes = {i.path: i.size for i in found if i.is_file and i.path.endswith((".warc", ".warc.gz"))}
        lists = [i.path for i in found if i.is_file and i.base_name.startswith(_LIST)]
        if lists:  # only what was committed
            named = []
            for path in lists:
                with fs.open_input_stream(path) as f:
                    named += [f"{path.rpartition('/')[0]}/{name}" for name in json.loads(f.read())]
            sizes = {p: s for p in named if (s := sizes.get(p)) is not None}
        out, held, total = [], [], 0
        for path, size in sorted(sizes.items(), key=lambda x: -x[1]):
            if held and total + size > self.most:
                out.append(Archives(held))
                held, total = [], 0
            held.append((path, size))
            total += size
        return [*out, Archives(held)] if held else out

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archives
            return
        fs, _ = _open(self.path)
        wanted = lambda fields: all(_holds(f, fields) for f in self.filters)
        held, size = [], 0
        for path, length in partition.files:
            with fs.open_input_file(path) as f:
                try:
                    for row in records(f, length, wanted, self.payload):
                        held.append(row)
                        size += 500 + len(row["payload"] or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=self.arrow)
                            held, size = [], 0
                except (ValueError, KeyError, zlib.error) as e:
                    raise ValueError(f"{path} is not a whole WARC archive: {e!r}") from e
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=self.arrow)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.most, self.level = int(options.get("maxfilebytes", 32 << 20)), int(options.get("level", 6))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open(self.path)
        files, out, size = [], None, 0
        for batch in iterator:
            for begin in range(0, batch.num_rows, 64):
                for row in batch.slice(begin, 64).to_pylist():
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        files.append(f"{root.rstrip('/')}/{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(files[-1], compression=None), 0
                    data = self.record(**row)
                    out.write(data)
                    size += len(data)
                    if size >= self.most:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return Written(files)

    def record(self, record_id, target_uri, digest, n_bytes, refers_to, payload) -> bytes:
        # A header value is one line: line ends in a URL are percent-encoded.
        uri = None if target_uri is None else target_uri.replace("\r", "%0D").replace("\n", "%0A")
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
        fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id), ("WARC-Date", self.date), ("Content-Type", "application/http;msgtype=response")]
        fields += [] if uri is None else [("WARC-Target-URI", uri)]
        fields.append(("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"))
        if refers_to is not None:
            fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to)]
        return member(fields, http if refers_to is not None else http + (payload or "").encode(), self.level)

    def commit(self, messages: list) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        old = [i.path for i in fs.get_file_info(pyarrow.fs.FileSelector(root)) if i.base_name.startswith(_LIST)] if self.overwrite else []
        with fs.open_output_stream(f"{root.rstrip('/')}/{_LIST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([p.rpartition("/")[2] for m in messages if m for p in m.files]).encode())
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list) -> None:
        fs, _ = _open(self.path)
        for path in [p for m in messages if m for p in m.files]:
            fs.delete_file(path)


class WarcSource(DataSource):
    """``format("warc")``. Options: ``path``; to read ``payload`` (true), ``maxPartitionBytes``; to write
    ``date``, ``maxFileBytes``, ``level``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return WarcReader({k.lower(): v for k, v in self.options.items()}, to_arrow_schema(schema))

    def writer(self, schema, overwrite: bool):
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below ``path``. Turns Spark's filter pushdown for Python sources on in the session."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


# -- pages ---------------------------------------------------------------------------------------


def _name(column: str) -> str:
    """SQL for the record's name; ids that are no numbers are percent-encoded."""
    return f"concat('<urn:record:', replace(url_encode(coalesce(cast({column} AS string), '')), '+', '%20'), '>')"


def key_of(column: str) -> str:
    """SQL for the id, as text, that a record's name holds; an empty one is a null id."""
    return f"nullif(url_decode(regexp_extract({column}, '^<urn:record:(.*)>$', 1)), '')"


def marked_pages(df: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """``id``, ``url``, ``digest``, ``n_bytes``, ``payload`` and, of a revisit, ``revisit`` true and ``top_id``, the
    id it refers to; a revisit's payload is null."""
    rows = df.select(df[id_col].alias("id"), df[url_col].alias("url"), F.coalesce(df[payload_col].cast("string"), F.lit("")).alias("payload"))
    rows = rows.select("id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))
    counted = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes", "id", "url").agg(F.count("*").alias("n"))
    largest = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", F.col("url").isNotNull().alias("known_url"), "url", "n"))
    groups = counted.groupBy("digest", "n_bytes").agg(largest.alias("top"), F.sum("n").alias("members")).where("members > 1")
    groups = written(groups.selectExpr("concat(digest, ':', n_bytes) AS found", "top.id AS top_id", "top.url AS top_url", "top.n AS top_n", "members"), "groups")
    total, ties = groups.agg(F.sum("members"), F.sum((F.col("top_n") > 1).cast("int"))).first()
    none = rows.selectExpr("id", "url", "digest", "n_bytes", "payload", "false AS revisit", "id AS top_id")
    if not total:
        return none
    heavy, light = (groups.where(f"members * 10000L {sign} {total}").drop("members") for sign in (">", "<="))
    rows = rows.withColumn("held", F.expr(f"if(n_bytes >= {min_bytes}, concat(digest, ':', n_bytes), NULL)"))
    near = rows.join(F.broadcast(heavy), F.col("held") == F.col("found"), "left")  # fewer than 10,000 rows
    far = maybe_in(near.where("found IS NULL").select(*rows.columns), "held", light.select("found"))
    risky = far.where("maybe").select(*rows.columns).join(light, F.col("held") == F.col("found"), "left")
    parts = near.where("found IS NOT NULL").unionByName(risky).unionByName(far.where("NOT maybe").select(*rows.columns), allowMissingColumns=True)
    parts = parts.withColumn("revisit", F.expr("found IS NOT NULL AND NOT (id <=> top_id AND url <=> top_url)"))
    out = parts.where("revisit OR coalesce(top_n, 1) = 1").selectExpr("id", "url", "digest", "n_bytes", "if(revisit, NULL, payload) AS payload", "revisit", "top_id")
    if ties:  # repeated rows: combined before the shuffle, one is the response and the others are revisits
        tied = parts.where("NOT revisit AND top_n > 1").groupBy("id", "url", "digest", "n_bytes", "top_n").agg(F.first("payload").alias("payload"))
        out = out.unionByName(tied.selectExpr("id", "url", "digest", "n_bytes", "payload", "false AS revisit", "id AS top_id"))
        more = tied.selectExpr("id", "url", "digest", "n_bytes", "top_n").withColumn("i", F.expr("explode(sequence(2L, top_n))"))
        out = out.unionByName(more.selectExpr("id", "url", "digest", "n_bytes", "cast(NULL AS string) AS payload", "true AS revisit", "id AS top_id"))
    return out


def write_pages(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, **options) -> None:
    """Write a record per row of ``df`` into archives below ``path``."""
    df.sparkSession.dataSource.register(WarcSource)
    rows = marked_pages(df, id_col, url_col, payload_col, min_bytes)
    rows = rows.selectExpr(f"{_name('id')} AS record_id", "url AS target_uri", "digest", "n_bytes", f"if(revisit, {_name('top_id')}, NULL) AS refers_to", "payload")
    rows.write.format("warc").options(**options).mode("append").save(path)


def archive_digests(spark: SparkSession, path: str) -> DataFrame:
    """Of every record read back: ``key`` (its id as text), ``payload_bytes``, ``payload_digest``,
    ``record_type`` and ``refers_to`` (the response's id as text). Payloads are decoded for responses
    only, whose digest and length are those of what was read."""
    digest = "regexp_replace(payload_digest, '^sha1:', '')"
    bodies = read_warc(spark, path).where("record_type = 'response'")
    ddl = "key string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    arrow = arrow_schema(spark, ddl)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                bodies = part.column(1).to_pylist()
                digests = [base64.b32encode(hashlib.sha1(b).digest()).decode() for b in bodies]
                yield pa.RecordBatch.from_pydict({"key": part.column(0), "payload_bytes": [len(b) for b in bodies], "payload_digest": digests, "record_type": ["response"] * len(bodies), "refers_to": [None] * len(bodies)}, schema=arrow)

    read = bodies.selectExpr(f"{key_of('record_id')} AS key", "payload").mapInArrow(measured, ddl)
    again = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    again = again.selectExpr(f"{key_of('record_id')} AS key", "http_length AS payload_bytes", f"{digest} AS payload_digest", "record_type", f"{key_of('refers_to')} AS refers_to")
    return read.unionByName(again)


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``write_pages`` into the shared checkpoint folder, then ``archive_digests`` of what stands there."""
    path = scratch_path(df.sparkSession, "llm-warc")
    write_pages(df, path, id_col, url_col, payload_col, min_bytes)
    return archive_digests(df.sparkSession, path)
