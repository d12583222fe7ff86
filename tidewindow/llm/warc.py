"""WARC archives: a writer with revisit records and a sequential reader.

Archives are gzip files with one member per record, in the shared folder that the cluster names in
spark.checkpoint.dir.  A writing task names its files by its attempt and reports them in a manifest,
so the files of a lost or repeated attempt are never read.

Defined cases: null html is an empty payload; null urls become ``urn:page``; payloads under 1000
bytes are always responses; of rows repeated under the largest page_id each is a response; a null
page_id keeps its record and stays null, and never is what others revisit unless all are null;
an empty table gives no archive and no rows.
"""

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as store
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewindow.sources.staging import stage, stage_root

LEAST_REVISIT = 1000
FILE_BYTES = 64 << 20
CHUNK = 1 << 16
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, _sha1, _refers: equal long payloads refer to their largest page_id.

    Copies are counted with a map-side combine; the join back splits hot payloads by AQE and is a
    broadcast only where the written table of copies is below the session's threshold.
    """
    slim = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    slim = slim.withColumn("_sha1", F.unhex(F.sha1("html")))
    groups = (
        slim.where(F.octet_length("html") >= LEAST_REVISIT)
        .groupBy(F.col("_sha1").alias("_of"), F.octet_length("html").alias("_bytes"))
        .agg(F.count("*").alias("_n"), F.max("page_id").alias("_keep"))
        .where("_n > 1")
        .drop("_n")
    )
    groups = stage(groups)
    same = (F.col("_sha1") == F.col("_of")) & (F.octet_length("html") == F.col("_bytes"))
    revisit = ~F.col("page_id").eqNullSafe(F.col("_keep")) & F.col("_keep").isNotNull()
    return slim.join(groups, same, "left").select(
        "page_id", "url", "html", "_sha1", revisit.alias("_revisit"), F.when(revisit, F.col("_keep")).alias("_refers")
    )


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, html: bytes, sha1: bytes, revisit: bool, refers) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if revisit else http + html
    digest = lambda b: "sha1:" + base64.b32encode(b).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        "WARC-Target-URI: " + "".join((url or "urn:page").split("\r")).replace("\n", ""),
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {digest(sha1)}",
        f"WARC-Block-Digest: {digest(hashlib.sha1(block).digest())}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str):
    def write(batches):
        files, (system, root) = 0, store.FileSystem.from_uri(folder)
        out = path = None
        records = size = 0
        attempt = TaskContext.get().taskAttemptId()

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "_sha1", "_revisit", "_refers")]
            for row in zip(*columns):
                if out is None:
                    path, files = f"{folder}/archive-{attempt}-{files}.warc.gz", files + 1
                    out = system.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}")
                    records = size = 0
                member = zlib.compressobj(wbits=31)
                packed = member.compress(record(*[x.as_py() for x in row])) + member.flush()
                out.write(packed)
                records, size = records + 1, size + len(packed)
                if size >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return write


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page as a record; returns the manifest (path, records, bytes), itself written once."""
    folder = folder or f"{stage_root(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    system, root = store.FileSystem.from_uri(folder)
    system.create_dir(root)
    return stage(with_record_types(pages).mapInArrow(_writer(folder), MANIFEST))


class Member:
    """One gzip member read piece by piece: nothing beyond a chunk is held."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.rest, self.data, self.inflate = stream, rest, b"", zlib.decompressobj(31)

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        raw = self.inflate.unconsumed_tail or self.rest or self.stream.read(CHUNK)
        self.rest = b""
        if not raw:
            raise ValueError("archive ends inside a record")
        self.data += self.inflate.decompress(raw, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.data.find(mark)) < 0:
            if not self.more():
                raise ValueError("record without a header")
        head, self.data = self.data[:at], self.data[at + len(mark) :]
        return head

    def take(self, n: int):
        """Exactly n bytes, in pieces."""
        while n:
            if not self.data and not self.more():
                raise ValueError("record shorter than its Content-Length")
            piece, self.data = self.data[:n], self.data[n:]
            n -= len(piece)
            if piece:
                yield piece

    def end(self) -> bytes:
        while self.more():
            pass
        if self.data != b"\r\n\r\n":
            raise ValueError("record longer than its Content-Length")
        return self.inflate.unused_data


def _fields(head: bytes) -> dict:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def _page(name: str | None):
    return int(name[10:-1]) if name and name != "<urn:page:>" else None


def read_records(stream, with_payload: bool = False):
    """Yield one dict per record; a wrong length or digest raises ValueError."""
    rest = b""
    while rest or (rest := stream.read(CHUNK)):
        member = Member(stream, rest)
        head = _fields(member.until(b"\r\n\r\n"))
        left = int(head["content-length"])
        block, http = hashlib.sha1(), b""
        payload, kept, got = hashlib.sha1(), [], 0
        want = None
        for piece in member.take(left):
            block.update(piece)
            if want is None:
                http += piece
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                piece, want = http[at + 4 :], int(_fields(http[:at])["content-length"])
            payload.update(piece)
            got += len(piece)
            if with_payload:
                kept.append(piece)
        rest = member.end()
        base32 = lambda d: "sha1:" + base64.b32encode(d).decode()
        response = head["warc-type"] == "response"
        if base32(block.digest()) != head["warc-block-digest"]:
            raise ValueError("block digest differs")
        if response and (got != want or base32(payload.digest()) != head["warc-payload-digest"]):
            raise ValueError("payload digest or length differs")
        yield {
            "page_id": _page(head["warc-record-id"]),
            "url": head["warc-target-uri"],
            "payload_bytes": want,
            "payload_digest": base64.b32decode(head["warc-payload-digest"][5:]).hex(),
            "record_type": head["warc-type"],
            "refers_to": _page(head.get("warc-refers-to")),
            "payload": b"".join(kept) if with_payload and response else None,
        }


def _reader(with_payload: bool, rows: int = 1000, held: int = 16 << 20):
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = store.FileSystem.from_uri(path)
                found, size = [], 0
                with system.open_input_stream(name) as stream:
                    for x in read_records(stream, with_payload):
                        found.append(x)
                        size += len(x["payload"] or b"")
                        if len(found) >= rows or size >= held:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema)

    return read


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives; a task per file.  The payload column is null unless asked for."""
    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(_reader(with_payload), RECORDS)
