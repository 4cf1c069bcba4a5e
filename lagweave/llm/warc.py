"""WARC archives as a Spark data source, and pages written to and read from them.

Writing: a task writes one .warc.gz file, one gzip member a record, under a name of its own that
the commit moves into place; commit and abort clear away what failed or repeated tasks of the job
left under other names. Each member says in
its gzip header (subfield "sl") how long it is. Reading: files are planned into partitions of
about equal bytes; a record's headers are parsed first, predicates on record type and other
headers are applied there, and a record that fails them, or whose payload isn't asked for, is
skipped by its length without inflating or decoding the rest. Plain .warc files are skipped
through by Content-Length.

Columns: record_type, record_id, target_uri, date, refers_to, payload_digest (SHA-1 as bare
lower-case hex, whether the header has it in base 32 or hex; others as the header has them),
payload_bytes, payload (binary; null with option payload=false, and for revisits): what follows the
HTTP headers in records of type application/http, the whole block in others. With
option verify=true the digest of a present payload is recomputed and must agree. Headers that are
missing are null. Control characters in a header value are percent-encoded when written.
"""

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from . import bloom
from .shared import prepared, shared_dir, staged, table

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
TEXTS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
#: Names from the WARC 1.1 format.
VERSION, IDENTICAL = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Smaller payloads are written again rather than referred to.
REVISIT_BYTES = 1000
PARTITION_BYTES = 64 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
CHUNK = 1 << 16


def _filesystem(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _clean(value) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record_bytes(row: dict) -> bytes:
    """A record: WARC headers, HTTP headers and, but for revisits, the payload."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    digest = row["payload_digest"] and "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    named = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Date": row["date"], "WARC-Target-URI": row["target_uri"], "WARC-Payload-Digest": digest,
        "WARC-Refers-To": row["refers_to"] and f"<{row['refers_to']}>", "WARC-Profile": IDENTICAL if row["record_type"] == "revisit" else None,
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    head = "".join(f"{k}: {_clean(v)}\r\n" for k, v in named.items() if v is not None)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that says its own length: subfield sl holds both lengths."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    extra = struct.pack("<2sHII", b"sl", 8, 10 + 2 + 12 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return struct.pack("<4BIBBH", 0x1F, 0x8B, 8, 4, 0, 0, 255, len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _member_length(start: bytes) -> int:
    """Of a gzip member by its sl subfield; 0 if it has none."""
    if len(start) >= 24 and start[3] & 4 and start[12:14] == b"sl":
        return struct.unpack("<I", start[16:20])[0]
    return 0


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def _digest(value: str | None) -> str | None:
    kind, _, code = (value or "").partition(":")
    if kind.lower() == "sha1":
        if re.fullmatch("[0-9a-fA-F]{40}", code):
            return code.lower()
        if re.fullmatch("[A-Z2-7a-z]{32}", code):
            return base64.b32decode(code.upper()).hex()
    return value


def _fields(h: dict[str, str]) -> dict:
    out = {c: h.get(name) for c, name in TEXTS.items()}
    for c in ("record_id", "refers_to"):
        out[c] = out[c] and out[c].strip("<>")
    out["payload_digest"] = _digest(out["payload_digest"])
    return out


def payload_of(block: bytes, http: bool):
    """(payload length that the HTTP headers name, payload) of a record's block."""
    if not http:
        return len(block), block
    head, _, payload = block.partition(b"\r\n\r\n")
    named = _headers(head).get("content-length")
    return (int(named) if named and named.isdigit() else len(payload)), payload


def _is_http(h: dict[str, str]) -> bool:
    return h.get("content-type", "").lower().startswith("application/http")


def records(f, gz: bool, wanted, payload: bool):
    """(fields, block, whether it is HTTP) of each record that wanted(fields) takes; without payload
    a block may break off behind its HTTP headers."""
    at = 0
    while True:
        f.seek(at)
        start = f.read(CHUNK)
        if not start:
            return
        if not gz:
            while b"\r\n\r\n" not in start and (more := f.read(CHUNK)):
                start += more
            end = start.index(b"\r\n\r\n") + 4
            h = _headers(start[: end - 4])
            size = int(h["content-length"])
            fields = _fields(h)
            if wanted(fields):
                need = size if payload or not _is_http(h) else min(size, 4096)
                block = start[end : end + need]
                yield fields, block + (f.read(need - len(block)) if need > len(block) else b""), _is_http(h)
            at += end + size + 4
            continue
        z, raw, text = zlib.decompressobj(31), start, b""
        while b"\r\n\r\n" not in text and not z.eof:  # headers first
            text += z.decompress(raw, 2048)
            raw = z.unconsumed_tail or (b"" if z.eof else f.read(CHUNK))
            if not raw and not z.eof:
                raise ValueError("a gzip member breaks off")
        end = text.index(b"\r\n\r\n") + 4
        h = _headers(text[: end - 4])
        fields, size, length = _fields(h), int(h["content-length"]), _member_length(start)
        take = wanted(fields)
        short = not payload and _is_http(h) and b"\r\n\r\n" in text[end:]
        need = end + (text[end:].find(b"\r\n\r\n") + 4 if short else size)
        parts, have = [text], len(text)
        while not z.eof and ((take and have < need) or not length):
            got = z.decompress(raw, 1 << 20)
            parts.append(got)
            have += len(got)
            raw = z.unconsumed_tail or (b"" if z.eof else f.read(CHUNK))
        if take:
            yield fields, b"".join(parts)[end : min(need, end + size)], _is_http(h)
        at = at + length if length else f.tell() - len(z.unused_data)


def _test(p):
    """A pushed predicate as a test of a record's fields; None if it isn't one of theirs."""
    name = p.attribute[0] if hasattr(p, "attribute") and len(p.attribute) == 1 else None
    if name not in TEXTS:
        return None
    tests = {
        EqualTo: lambda x: x is not None and x == p.value, EqualNullSafe: lambda x: x == p.value, In: lambda x: x is not None and x in p.value, IsNull: lambda x: x is None, IsNotNull: lambda x: x is not None,
        StringStartsWith: lambda x: x is not None and x.startswith(p.value), StringEndsWith: lambda x: x is not None and x.endswith(p.value), StringContains: lambda x: x is not None and p.value in x,
    }
    return (name, tests[type(p)]) if type(p) in tests else None


@dataclass
class Files(InputPartition):
    paths: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.verify = options["path"], options.get("payload", "true") == "true", options.get("verify", "false") == "true"
        self.size, self.pushed = int(options.get("partitionbytes", PARTITION_BYTES)), []

    def pushFilters(self, filters):
        for p in filters:
            if _test(p):
                self.pushed.append(p)
            else:
                yield p

    def partitions(self):
        store, path = _filesystem(self.path)
        found = [x for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and re.search(r"\.warc(\.gz)?$", x.path) and not x.base_name.startswith(("_", "."))]
        plan, room = [], 0
        for x in sorted(found, key=lambda x: x.path):
            if not plan or room < x.size:
                plan.append(Files([]))
                room = self.size
            plan[-1].paths.append(x.path)
            room -= x.size
        return plan or [Files([])]

    def read(self, part):
        store, _ = _filesystem(self.path)
        tests = [_test(p) for p in self.pushed]
        wanted = lambda fields: all(t(fields[name]) for name, t in tests)
        rows, size = [], 0
        for path in part.paths:
            with store.open_input_file(path) as raw:
                for fields, block, http in records(io.BufferedReader(raw, 1 << 20), path.endswith(".gz"), wanted, self.payload or self.verify):
                    n, payload = payload_of(block, http)
                    full = fields["record_type"] != "revisit"
                    if self.verify and full and hashlib.sha1(payload).hexdigest() != fields["payload_digest"]:
                        raise ValueError(f"{path}: {fields['record_id']} has another payload than its digest says")
                    rows.append(fields | {"payload_bytes": n, "payload": payload if self.payload and full else None})
                    size += len(block)
                    if len(rows) == BATCH_ROWS or size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


ARROW = pa.schema([(c, pa.string()) for c in TEXTS] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator):
        store, path = _filesystem(self.path)
        store.create_dir(path, recursive=True)
        name = f"part-{self.job}-{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{path}/_{name}", compression=None, buffer_size=1 << 20) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(member(record_bytes(row)))
        return Written(name)

    def commit(self, messages):
        store, path = _filesystem(self.path)
        for m in messages:
            if m:
                store.move(f"{path}/_{m.name}", f"{path}/{m.name}")
        self._clear(store, path)

    def abort(self, messages):
        self._clear(*_filesystem(self.path))

    def _clear(self, store, path):
        """Deletes what tasks of this job wrote and the commit didn't take."""
        for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if x.base_name.startswith(f"_part-{self.job}-"):
                store.delete_file(x.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def with_warc(spark: SparkSession) -> SparkSession:
    prepared(spark).dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write_warc(records: DataFrame, path: str) -> None:
    """records has the source's columns; payload may be a string."""
    with_warc(records.sparkSession)
    cols = [F.col("payload").cast("binary").alias("payload") if c == "payload" else F.col(c) for c in [*TEXTS, "payload_bytes", "payload"]]
    records.select(*cols).write.format("warc").option("path", path).mode("append").save()


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    return with_warc(spark).read.format("warc").option("path", path).option("payload", str(payload).lower()).option("verify", str(verify).lower()).load()


def page_records(pages: DataFrame, least_bytes: int = REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record for each row of pages(page_id, url, html). Of equal payloads of at least
    least_bytes the one with the largest page_id is the response, the others revisit it; only
    pages whose digest may repeat shuffle. A null html is an empty payload; a null page_id is
    smaller than all others; rows that repeat page_id and payload are all responses."""
    made = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    digests = staged(made.where(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest"), "digests")
    groups = staged(digests.groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "groups")
    maybe = bloom.passes(pages.sparkSession, bloom.repeated(digests.select(F.xxhash64("payload_digest").alias("key")), "key"), F.xxhash64("payload_digest"))
    tested = made.withColumn("maybe", maybe & (F.col("payload_bytes") >= least_bytes))
    once = tested.where("not maybe").withColumn("last", F.lit(None).cast("long")).withColumn("found", F.lit(False))
    many = tested.where("maybe").join(groups.withColumn("found", F.lit(True)), "payload_digest", "left")
    rows = once.unionByName(many)
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    again = F.coalesce("found", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.when(again, urn("last")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )


def page_number(urn: str):
    return F.expr(f"try_cast(substring({urn}, {len('urn:page:') + 1}) as bigint)")


def op3(spark, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, which must have the digest in their headers; of
    revisits, which a second scan asks for by record type, only the headers are."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    columns = (page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))
    full = read_warc(spark, path, payload=False, verify=True).where("record_type = 'response'")
    again = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    return full.select(*columns).unionByName(again.select(*columns))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE octet_length(b) >= 1000 GROUP BY 1)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, p.payload_digest,
 CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND octet_length(b) >= 1000
"""
