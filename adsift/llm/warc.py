"""WARC archives: written, revisits resolved, deduplicated, read back.

An archive is a set of ``.warc.gz`` files, each record a gzip member of its own, and an
index with a row for each record: file, offset, length and the headers that matter.
Records never go through a shuffle.  To deduplicate, only the index is shuffled by payload
digest: of the responses with equal payloads one stays, all others become revisits that
refer to it, and revisits that are there already are joined to that response.  Then the
verdicts go to the files: each file is read once, in order, responses that stay are copied
as they are, and each revisit is written with fresh headers and without its payload.

Tasks write to files with names of their own and the index lists those of finished tasks
only, so a task that is run again, or twice at once, leaves at most a file that nothing
refers to.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adsift.llm.common import hot_join, own_columns, scratch_path, stage

#: A file is closed when it has so many bytes.
FILE_BYTES = 64 << 20
#: Tasks that read an archive, at most; each reads some files.
MOST_TASKS = 20_000
#: Payloads below this are kept in every record: a revisit's headers are not much smaller.
LEAST_PAYLOAD = 1000
#: The date of records that are written, unless another is given.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLOCK = 1 << 20
_END = b"\r\n\r\n"

INDEX = (
    "file string, offset long, length long, record_id string, kind string, page_id long,"
    " url string, digest string, payload_bytes long, refers_to string"
)
_COLUMNS = [c.split()[0] for c in INDEX.split(", ")]
_ARROW = pa.schema(
    [
        (name, pa.int64() if kind == "long" else pa.string())
        for name, kind in (c.split() for c in INDEX.split(", "))
    ]
)


@dataclass
class Archive:
    """A folder and the staged index of its records."""

    folder: str
    index: DataFrame


# --- records --------------------------------------------------------------------


def digest_header(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def digest_hex(header: str) -> str:
    return base64.b32decode(header.removeprefix("sha1:")).hex()


def _uri(url: str) -> str:
    """A url as a header value: what may not stand there is percent-encoded."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def record_bytes(headers: dict[str, str | int | None], block: bytes) -> bytes:
    """A record as a gzip member; headers without a value are left out."""
    lines = [f"{name}: {value}" for name, value in headers.items() if value is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode()
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress(head + _END + block + _END) + packer.flush()


def _http_head(payload_bytes: int) -> bytes:
    return (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {payload_bytes}\r\n\r\n"
    ).encode()


def _headers(row: dict, date: str) -> dict:
    url, page_id = row["url"], row["page_id"]
    return {
        "WARC-Type": row["kind"],
        "WARC-Record-ID": f"<urn:uuid:{row['record_id']}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else _uri(url),
        "WARC-Payload-Digest": digest_header(row["digest"]),
        "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": page_id,
    }


def response_record(row: dict, payload: bytes, date: str) -> bytes:
    return record_bytes(_headers(row, date), _http_head(len(payload)) + payload)


def revisit_record(row: dict, date: str) -> bytes:
    """Headers of an identical payload; the block has the HTTP head only."""
    url = row["origin_url"]
    headers = _headers(row, date) | {
        "WARC-Profile": PROFILE,
        "WARC-Refers-To": f"<urn:uuid:{row['refers_to']}>",
        "WARC-Refers-To-Target-URI": None if url is None else _uri(url),
        "WARC-Refers-To-Date": date,
    }
    return record_bytes(headers, _http_head(row["payload_bytes"]))


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of an unpacked record."""
    head, _, rest = record.partition(_END)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    headers = {}
    for line in lines:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = int(headers["content-length"])
    if len(rest) != size + len(_END) or not rest.endswith(_END):
        raise ValueError(f"record of {len(rest)} bytes, {size} and the end were announced")
    return headers, rest[:size]


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, packed length and content of each gzip member; one is held at a time."""
    offset, rest = 0, b""
    while True:
        rest = rest or stream.read(_BLOCK)
        if not rest:
            return
        unpacker, content, length = zlib.decompressobj(wbits=31), [], 0
        while not unpacker.eof:
            if not rest and not (rest := stream.read(_BLOCK)):
                raise ValueError(f"the file ends inside a record, at {offset + length}")
            content.append(unpacker.decompress(rest))
            length += len(rest) - len(unpacker.unused_data)
            rest = unpacker.unused_data
        yield offset, length, b"".join(content)
        offset += length


# --- files ----------------------------------------------------------------------


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


class _Writer:
    """Appends records to files of a folder; rows of the index come out in batches."""

    def __init__(self, folder: str, file_bytes: int):
        self.files, self.root = _opened(folder)
        self.file_bytes, self.stream, self.rows = file_bytes, None, []

    def add(self, row: dict, record: bytes) -> None:
        if self.stream is None:
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.stream = self.files.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.stream.write(record)
        self.rows.append(row | {"file": self.name, "offset": self.at, "length": len(record)})
        self.at += len(record)
        if self.at >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist([{c: r[c] for c in _COLUMNS} for r in rows], _ARROW)


def _new_folder(spark: SparkSession, name: str) -> str:
    folder = scratch_path(spark, name)
    files, root = _opened(folder)
    files.create_dir(root)
    return folder


def write_archive(
    pages: DataFrame, folder: str | None = None, date: str = DATE, file_bytes: int = FILE_BYTES
) -> Archive:
    """A response record for each row of ``pages`` (page_id, url, html).

    The payload is the html in UTF-8, empty for null; a null id or url has no header.
    Further columns are not read.
    """
    own = own_columns(pages, page_id="long", url="string", html="string")
    rows = pages.select(*[c.alias(n) for n, c in own.items()])
    folder = folder or _new_folder(pages.sparkSession, "warc")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, file_bytes)
        for batch in batches:
            for page_id, url, html in zip(*(column.to_pylist() for column in batch.columns)):
                payload = (html or "").encode()
                row = {
                    "record_id": str(uuid.uuid4()), "kind": "response", "page_id": page_id,
                    "url": url, "digest": hashlib.sha1(payload).hexdigest(),
                    "payload_bytes": len(payload), "refers_to": None,
                }
                writer.add(row, response_record(row, payload, date))
            yield writer.batch()
        writer.close()

    return Archive(folder, stage(rows.mapInArrow(write, INDEX), "warc-index"))


# --- deduplication --------------------------------------------------------------


def resolve(index: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """The index with each record's verdict: ``new_kind``, and of the response that a
    revisit stands for ``origin`` (record id), ``origin_url`` and ``origin_bytes``.

    Of the responses with equal digests and lengths the one with the largest page_id
    stays, null below all; of several rows with that id the one with the largest record
    id.  A revisit in the archive goes to the response that stays for its digest, whatever its
    size, and is left as it is if there is none.  A page that itself has the id of the
    response that stays, but another payload, is not concerned.
    """
    response = F.col("kind") == "response"
    ranked = F.struct("page_id", "record_id", "url", "payload_bytes")
    origins = stage(
        index.where(response).groupBy("digest").agg(F.max(ranked).alias("origin")), "warc-origins"
    )
    rows = hot_join(index, origins, "digest", "record_id")
    other = F.col("origin")["record_id"] != F.col("record_id")
    large = (F.col("payload_bytes") >= least) & other
    revisit = F.when(response, large).otherwise(F.col("origin").isNotNull())
    part = lambda name: F.when(revisit, F.col("origin")[name])
    return rows.select(
        *_COLUMNS,
        F.when(revisit, "revisit").otherwise(F.col("kind")).alias("new_kind"),
        part("record_id").alias("origin"),
        part("url").alias("origin_url"),
        part("payload_bytes").alias("origin_bytes"),
    )


def deduplicate(
    archive: Archive,
    folder: str | None = None,
    least: int = LEAST_PAYLOAD,
    date: str = DATE,
    file_bytes: int = FILE_BYTES,
) -> Archive:
    """A new archive in which each payload of ``least`` bytes or more is there once.

    Verdicts are sorted by file and offset; the records of a file are read from where
    they are, one at a time.
    """
    source = archive.folder
    folder = folder or _new_folder(archive.index.sparkSession, "warc-deduplicated")
    verdicts = resolve(archive.index, least)

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, file_bytes)
        files, root = _opened(source)
        for batch in batches:
            rows = batch.to_pylist()
            for name, some in itertools.groupby(rows, key=lambda r: r["file"]):
                with files.open_input_file(f"{root}/{name}") as stream:
                    for row in some:
                        if row["origin"] is not None:
                            fresh = row | {
                                "kind": "revisit", "record_id": str(uuid.uuid4()),
                                "refers_to": row["origin"], "payload_bytes": row["origin_bytes"],
                            }
                            writer.add(fresh, revisit_record(fresh, date))
                        else:
                            stream.seek(row["offset"])
                            writer.add(row, stream.read(row["length"]))
            yield writer.batch()
        writer.close()

    ordered = verdicts.repartition(_tasks(archive), "file").sortWithinPartitions("file", "offset")
    return Archive(folder, stage(ordered.mapInArrow(rewrite, INDEX), "warc-index"))


# --- reading --------------------------------------------------------------------


def _tasks(archive: Archive) -> int:
    """Tasks that read the archive's files: index rows are too small for Spark to tell how much
    there is to read behind them."""
    return min(max(1, archive.index.select("file").distinct().count()), MOST_TASKS)


def _header_id(value: str | None) -> str | None:
    return value and value.removeprefix("<urn:uuid:").removesuffix(">")


def read_archive(archive: Archive, payloads: bool = False) -> DataFrame:
    """The records of all files of the archive, parsed from their bytes alone: the columns of the index,
    and ``payload`` if wanted.

    Digest and length of a response are those of its payload as it was read; one that is not
    what the header says is an error.  Those of a revisit are what its headers say.
    """
    source = archive.folder

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(source)
        schema = _ARROW.append(pa.field("payload", pa.binary())) if payloads else _ARROW
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_file(f"{root}/{name}") as stream:
                    for offset, length, content in members(stream):
                        headers, block = parsed(content)
                        page_id, kind = headers.get("x-page-id"), headers["warc-type"]
                        http, _, payload = block.partition(_END)
                        digest = digest_hex(headers["warc-payload-digest"])
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        if kind == "response":
                            found = hashlib.sha1(payload).hexdigest(), len(payload)
                            if found != (digest, size):
                                raise ValueError(f"{name} at {offset}: the payload is not as announced")
                        rows.append(
                            {
                                "file": name, "offset": offset, "length": length,
                                "record_id": _header_id(headers["warc-record-id"]), "kind": kind,
                                "page_id": page_id and int(page_id),
                                "url": headers.get("warc-target-uri"), "digest": digest,
                                "payload_bytes": size,
                                "refers_to": _header_id(headers.get("warc-refers-to")),
                                "payload": payload,
                            }
                        )
                        held += len(payload) if payloads else 200
                        if held > _BLOCK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    names = archive.index.select("file").distinct().repartition(_tasks(archive), "file")
    return names.mapInArrow(read, INDEX + ", payload binary" if payloads else INDEX)


def page_records(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Each page's record in the deduplicated archive, with the page its revisit refers to.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every row:
    archives are written, deduplicated and read back, and revisits are joined to the
    response that their header names, which has the full payload.  Null ids are kept; of
    repeated rows one is the response and the others refer to its id.  An empty table has no rows.
    """
    records = stage(read_archive(deduplicate(write_archive(pages), least=least)), "warc-records")
    responses = records.where("kind = 'response'").select(
        F.col("record_id").alias("refers_to"),
        F.col("page_id").alias("origin_page"),
        F.col("payload_bytes").alias("origin_bytes"),
        F.col("digest").alias("origin_digest"),
    )
    revisits = stage(records.where("kind = 'revisit'"), "warc-revisits")
    found = hot_join(revisits, stage(responses, "warc-responses"), "refers_to", "record_id", "inner")

    def result(rows: DataFrame, size: str, digest: str, origin: Column) -> DataFrame:
        return rows.select(
            "page_id",
            F.col(size).alias("payload_bytes"),
            F.col(digest).alias("payload_digest"),
            F.col("kind").alias("record_type"),
            origin.cast("long").alias("refers_to"),
        )

    plain = result(records.where("kind = 'response'"), "payload_bytes", "digest", F.lit(None))
    return plain.unionAll(result(found, "origin_bytes", "origin_digest", F.col("origin_page")))
