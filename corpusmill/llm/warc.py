"""WARC records in ZIP-packaged archives: a writer for tasks, and a reader by ranges.

An archive is a ZIP file with two stored (not deflated) members: `archive/data.warc.gz`,
one gzip member per WARC record, and `indexes/index.cdxj`, one line per record with
offset and length inside the first. The reader finds the end-of-central-directory
record in the file's tail, follows the ZIP64 records where the 32-bit fields are full,
parses the central directory, reads the members' local headers for their data
offsets, then the index, and reads each record by its range. Nothing is extracted.

Equal payloads of at least REVISIT_BYTES bytes are kept once: the record with the
largest key is the response, the others are revisits that name it.

Defined results: a null page is an empty payload; small payloads are never revisits;
an empty table gives no archive and no rows; a null url is an empty one. A null key comes
back as null and orders before all others, so its page revisits any that has a key; where
all keys of a payload are null, all are responses. Every row gets a record of its own, repeated
rows too; those with the largest key of their payload are all responses. Archives are rolled at ARCHIVE_BYTES; a longer record is
an archive's last. File names hold a random part, and only those that the successful
attempt of a task reports are read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusmill.llm.common import chunks
from corpusmill.runtime import materialize, scratch_path, small_side

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_NO_KEY = "<urn:no-page>"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Fixed values of the ZIP format: signatures and fixed parts of its records.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_LOCAL, _CENTRAL = struct.Struct("<IHHHHHIIIHH"), struct.Struct("<IHHHHHHIIIHHHHHII")
_END, _END64, _LOCATOR64 = struct.Struct("<IHHHHIIH"), struct.Struct("<IQHHIIQQQQ"), struct.Struct("<IIQI")
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    stored: bool
    size: int
    header: int  # offset of the local header


def _open(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" not in path and not path.startswith("file:"):
        return LocalFileSystem(), path
    return FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and "://" not in path else path)


class ArchiveWriter:
    """Writes one archive front to back; sizes of stored members follow in ZIP64 fields."""

    def __init__(self, path: str):
        fs, place = _open(path)
        fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(place)
        self.at = 0
        self.entries: list[tuple[str, int, int, int]] = []
        self.index: list[bytes] = []
        self._begin(DATA)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _begin(self, name: str) -> None:
        # sizes are not known yet: flag 8 says that a descriptor follows the data
        self.name, self.header, self.crc = name, self.at, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._write(_LOCAL.pack(LOCAL, 45, 8, 0, 0, 0x21, 0, _FULL32, _FULL32, len(name), len(extra)) + name.encode() + extra)
        self.start = self.at

    def _data(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self._write(data)

    def _end(self) -> None:
        size = self.at - self.start
        self._write(struct.pack("<IIQQ", 0x08074B50, self.crc, size, size))
        self.entries.append((self.name, self.crc, size, self.header))

    def add(self, key: str, record: bytes) -> None:
        packed = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = packed.compress(record) + packed.flush()
        line = json.dumps({"key": key, "offset": self.at - self.start, "length": len(data)})
        self.index.append(line.encode() + b"\n")
        self._data(data)

    def close(self) -> None:
        self._end()
        self._begin(INDEX)
        for line in self.index:
            self._data(line)
        self._end()
        begin = self.at
        for name, crc, size, header in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header)
            self._write(
                _CENTRAL.pack(CENTRAL, 45, 45, 8, 0, 0, 0x21, crc, _FULL32, _FULL32, len(name), len(extra), 0, 0, 0, 0, _FULL32)
                + name.encode()
                + extra
            )
        size, n, end64 = self.at - begin, len(self.entries), self.at
        self._write(_END64.pack(END64, 44, 45, 45, 0, 0, n, n, size, begin))
        self._write(_LOCATOR64.pack(LOCATOR64, 0, end64, 1))
        self._write(_END.pack(END, 0, 0, _FULL16, _FULL16, _FULL32, _FULL32, 0))
        self.out.close()


def directory(file, size: int) -> list[Member]:
    """Members of a ZIP file by its central directory, ZIP64 or not."""

    def at(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n)

    tail_at = max(0, size - _END.size - _FULL16)
    tail = at(tail_at, size - tail_at)
    place = tail.rfind(struct.pack("<I", END))
    if place < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    _, _, _, _, n, length, offset, _ = _END.unpack_from(tail, place)
    if n == _FULL16 or length == _FULL32 or offset == _FULL32:
        locator = at(tail_at + place - _LOCATOR64.size, _LOCATOR64.size)
        signature, _, end64, _ = _LOCATOR64.unpack(locator)
        if signature == LOCATOR64:
            fields = _END64.unpack(at(end64, _END64.size))
            if fields[0] != END64:
                raise ValueError("damaged ZIP64 end of central directory")
            n, length, offset = fields[7], fields[8], fields[9]
    raw, here, members = at(offset, length), 0, []
    for _ in range(n):
        fields = _CENTRAL.unpack_from(raw, here)
        if fields[0] != CENTRAL:
            raise ValueError("damaged central directory")
        method, packed, plain, n_name, n_extra, n_comment, header = fields[4], fields[8], fields[9], *fields[10:13], fields[16]
        here += _CENTRAL.size
        name = raw[here : here + n_name].decode()
        extra = raw[here + n_name : here + n_name + n_extra]
        here += n_name + n_extra + n_comment
        while len(extra) >= 4:  # ZIP64 values stand only for full 32-bit fields, in this order
            kind, n_value = struct.unpack_from("<HH", extra)
            if kind == 1:
                values = iter(struct.unpack(f"<{min(n_value // 8, 3)}Q", extra[4 : 4 + 8 * min(n_value // 8, 3)]))
                plain = next(values) if plain == _FULL32 else plain
                packed = next(values) if packed == _FULL32 else packed
                header = next(values) if header == _FULL32 else header
            extra = extra[4 + n_value :]
        members.append(Member(name, method == 0 and packed == plain, packed, header))
    return members


def data_offset(file, member: Member) -> int:
    """Where a stored member's bytes begin: its local header has its own name and extra lengths."""
    if not member.stored:
        raise ValueError(f"{member.name} is not stored, so it has no ranges")
    file.seek(member.header)
    fields = _LOCAL.unpack(file.read(_LOCAL.size))
    if fields[0] != LOCAL:
        raise ValueError("damaged local header")
    return member.header + _LOCAL.size + fields[9] + fields[10]


def read_records(path: str) -> Iterator[bytes]:
    """Each record of an archive, unpacked, by a range read that the index names."""
    fs, place = _open(path)
    with fs.open_input_file(place) as file:
        members = {m.name: m for m in directory(file, file.size())}
        begin, index = data_offset(file, members[DATA]), members[INDEX]
        at, end, rest = data_offset(file, index), 0, b""
        end = at + index.size
        while at < end or rest:
            file.seek(at)
            block = file.read(min(1 << 20, end - at)) if at < end else b""
            at += len(block)
            *lines, rest = (rest + block).split(b"\n")
            if at >= end and rest:
                lines, rest = [*lines, rest], b""
            for line in filter(None, lines):
                entry = json.loads(line)
                file.seek(begin + entry["offset"])
                yield zlib.decompress(file.read(entry["length"]), 31)


def record(key: str | None, url: str, payload: bytes, digest: bytes, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_NO_KEY if key is None else f'<urn:page:{key}>'}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{b32encode(digest).decode()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Key, type, reference, full payload size and digest of a record; a response's payload is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    digest = b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if fields["WARC-Type"] == "response" and (
        hashlib.sha1(payload).digest() != digest or len(payload) != int(headers["Content-Length"])
    ):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    name = lambda field: fields[field][len("<urn:page:") : -1] if fields.get(field, _NO_KEY) != _NO_KEY else None
    return {
        "key": name("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI", ""),
        "payload": payload if fields["WARC-Type"] == "response" else None,
        "payload_bytes": int(headers["Content-Length"]),
        "payload_digest": digest.hex(),
        "record_type": fields["WARC-Type"],
        "refers_to": name("WARC-Refers-To"),
    }


#: Copies of a payload from which on they are joined apart from the others.
HOT = 10_000


def revisits(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Distinct (page, digest, refers_to) of all pages whose payload a page with a larger key has too.

    Works on digests. The digests of hot payloads are fewer than one in HOT pages; pages
    that have one are joined with those alone, so no task gets all copies of a payload.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    narrow = pages.filter(F.octet_length(html) >= REVISIT_BYTES).select(F.col(key).alias("page"), _digest(body).alias("digest"))
    counts = narrow.groupBy("digest").agg(F.max("page").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null")
    repeated = materialize(counts, "warc-repeated")
    hot = small_side(materialize(repeated.filter(F.col("n") > HOT), "warc-hot"))
    usual = narrow.join(hot, "digest", "left_anti").join(repeated.filter(F.col("n") <= HOT), "digest")
    found = usual.unionByName(narrow.join(hot, "digest"))
    return found.filter(F.col("page").isNull() | (F.col("page") < F.col("refers_to"))).select("page", "digest", "refers_to").distinct()


def _digest(body: Column) -> Column:
    """SHA-1 of a payload and its size."""
    return F.concat(F.unhex(F.sha1(body)), F.unhex(F.hex(F.octet_length(body).cast("long"))))


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write archives into `folder`, which all executors share; one row per archive: its path and number of records."""
    plain = pages.select(
        F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("u"), F.coalesce(F.col(html), F.lit("")).alias("h")
    )
    found = revisits(pages, key, html).alias("found")
    same = plain["key"].eqNullSafe(F.col("found.page")) & (_digest(plain["h"].cast("binary")) == F.col("found.digest"))
    rows = plain.join(found, same, "left").select("key", "u", "h", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int]] = []
        out, n, path = None, 0, ""
        for batch in chunks(batches, "h"):
            for page, place, text, refers in zip(*(batch.column(c).to_pylist() for c in ("key", "u", "h", "refers_to"))):
                if out is None:
                    path, n = f"{folder}/{uuid.uuid4().hex}.wacz", 0
                    out = ArchiveWriter(path)
                payload = text.encode()
                refers = None if refers is None else str(refers)
                name = None if page is None else str(page)
                out.add(name or "", record(name, place, payload, hashlib.sha1(payload).digest(), refers))
                n += 1
                if out.at >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        if done:
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "n": pa.array([k for _, k in done], pa.int64())})

    return materialize(rows.mapInArrow(run, "path string, n long"), "archives")


def read(archives: DataFrame, key_type: T.DataType | None = None, with_payload: bool = False) -> DataFrame:
    """Records of the archives whose `path` is given; keys come back in `key_type`."""
    names = ["key", "url", *(["payload"] if with_payload else []), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = {"payload": ("binary", pa.binary()), "payload_bytes": ("long", pa.int64())}
    schema = ", ".join(f"{c} {kinds.get(c, ('string', None))[0]}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], kinds.get(c, ("", pa.string()))[1]) for c in names], names=names
            )

        for paths in batches:
            for path in paths.column("path").to_pylist():
                rows: list[dict] = []
                held = 0
                for data in read_records(path):
                    rows.append(parse(data))
                    held += len(data) if with_payload else 500
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    n = max(1, archives.count())
    out = archives.select("path").repartition(n, "path").mapInArrow(run, schema)
    if key_type is None:
        return out
    return out.withColumns({c: F.col(c).cast(key_type) for c in ("key", "refers_to")})


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages, read the archives back: one row per page, without the payload."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder, key, url, html), pages.schema[key].dataType).withColumnRenamed("key", key)
