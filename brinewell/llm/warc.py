"""WARC archives: a writer with one gzip member per record, and a sequential reader.

An archive is a sequence of records in one piece of bytes; on a cluster it is a row of a table in the shared folder, and it
can be exported to plain .warc.gz files. The reader inflates chunk after chunk, frames records by Content-Length and checks
block and payload digests, so that beyond the archive's bytes its memory is bounded by a record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from uuid import UUID

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, written

#: Bytes after which a task begins a new archive, and bytes inflated at a time.
ARCHIVE, CHUNK = 1 << 20, 1 << 16
#: Payloads below this many bytes are always stored.
SMALLEST_REVISIT = 100
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: High half of the identifier of a record that others may refer to; the low half is the page's number.
RECORDS = 0x7B1D0F4E5C2A4B8E
#: Marks in the high half of all other identifiers, which number the records of each task; the low half is as above.
OWN, NO_PAGE = 1 << 63, 1 << 62


class WarcError(ValueError):
    pass


def record_id(page_id: int | None, own: int | None = None) -> str:
    """The identifier of a page's referable record, or with own (a number that is unique to it) of another record."""
    high = RECORDS if own is None else OWN | own | NO_PAGE * (page_id is None)
    return "<urn:uuid:" + str(UUID(int=high << 64 | (page_id or 0) & (1 << 64) - 1)) + ">"


def page_of(record: str) -> int | None:
    n = UUID(record.removeprefix("<urn:uuid:").removesuffix(">")).int
    high, low = n >> 64, n & (1 << 64) - 1
    if not (high == RECORDS or high & OWN and not high & NO_PAGE):
        return None
    return low - (1 << 64) if low >> 63 else low


def clean(value: str) -> str:
    """A header's value stays on its line."""
    return "".join(" " if c in "\r\n" else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, own: int | None = None, date: str = "2026-01-01T00:00:00Z") -> bytes:
    """A gzip member with a response, or with a revisit of the record refers_to (the block is then the HTTP header alone)."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id, own), "WARC-Date": date, "WARC-Target-URI": clean(url or ""),
        "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": "sha256:" + hashlib.sha256(payload).hexdigest(), "WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(),
    }
    if refers_to is not None:
        fields |= {"WARC-Refers-To": record_id(refers_to), "WARC-Profile": PROFILE}
    fields["Content-Length"] = str(len(block))
    whole = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block[self.block.index(b"\r\n\r\n") + 4 :]

    def http(self, name: str) -> str | None:
        head = self.block[: self.block.index(b"\r\n\r\n")].decode("latin-1").split("\r\n")
        return next((v.strip() for k, _, v in (line.partition(":") for line in head[1:]) if k.lower() == name.lower()), None)


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of each gzip member, inflated chunk by chunk."""
    inflate, parts, begun = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            begun = True
            try:
                parts.append(inflate.decompress(chunk))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            chunk = b""
            if inflate.eof:
                yield b"".join(parts)
                chunk, inflate, parts, begun = inflate.unused_data, zlib.decompressobj(31), [], False
    if begun:
        raise WarcError("the archive ends within a record")


def parse(content: bytes) -> Record:
    """A record framed by its Content-Length, with its digests checked."""
    at = content.find(b"\r\n\r\n")
    if not content.startswith(b"WARC/1.") or at < 0:
        raise WarcError("no record header")
    fields = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in content[:at].decode().split("\r\n")[1:])}
    n = int(fields["Content-Length"])
    block = content[at + 4 : at + 4 + n]
    if len(block) != n or content[at + 4 + n :] != b"\r\n\r\n":
        raise WarcError("the block isn't as long as Content-Length says")
    out = Record(fields, block)
    checks = [("WARC-Block-Digest", block)] + [("WARC-Payload-Digest", out.payload)] * (fields["WARC-Type"] == "response")
    for name, data in checks:
        if name in fields and fields[name] != "sha256:" + hashlib.sha256(data).hexdigest():
            raise WarcError(f"{name} differs")
    return out


def read(chunks: Iterable[bytes]) -> Iterator[Record]:
    return map(parse, members(chunks))


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to (null for what is stored, else the page with the same payload that is), target (what others refer to).

    Only digests and identifiers are grouped, summed before the shuffle. Payloads are shuffled once, by digest; those too
    small for a revisit get a key of their own, which spreads them and matches nothing.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pick(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload"))
    large = F.octet_length("payload") >= SMALLEST_REVISIT
    digest = F.unhex(F.sha2("payload", 256))
    groups = rows.filter(large).groupBy(digest.alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = groups.filter("n > 1 and first is not null").select("d", "first")
    keyed = rows.withColumn("digest", F.when(large, digest).otherwise(F.unhex(F.hex(F.xxhash64("page_id", "url", F.monotonically_increasing_id())))))
    joined = keyed.join(groups, F.col("digest") == F.col("d"), "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"), F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)).alias("target"))


def write_archives(plan: DataFrame) -> DataFrame:
    """archive, data: each task's records as archives of about ARCHIVE bytes, in the shared folder.

    Of repeated rows of a page that others refer to, which are next to each other, the first has the identifier meant."""

    def run(batches):
        from pyspark import TaskContext

        task, made, count, held, size, last = TaskContext.get().partitionId() << 32, 0, 0, [], 0, None

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([task + made], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["archive", "data"])

        for batch in batches:
            for page_id, url, payload, refers_to, target in zip(*(c.to_pylist() for c in batch.columns)):
                first = target and page_id != last
                held.append(record(page_id, url, payload, refers_to, None if first else task + count))
                last = page_id if target else last
                count, size = count + 1, size + len(held[-1])
                if size >= ARCHIVE:
                    yield archive()
                    made, held, size = made + 1, [], 0
        if held:
            yield archive()

    return written(plan.mapInArrow(run, "archive long, data binary"))


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; an archive is read from start to end."""

    def run(batches):
        for batch in batches:
            for data in batch.column(1):
                data, rows = memoryview(data.as_buffer()), []
                for r in read(data[i : i + CHUNK] for i in range(0, len(data), CHUNK)):
                    rows.append((page_of(r.fields["WARC-Record-ID"]), int(r.http("Content-Length")), r.fields["WARC-Payload-Digest"].partition(":")[2], r.fields["WARC-Type"], page_of(r.fields["WARC-Refers-To"]) if "WARC-Refers-To" in r.fields else None))
                    if len(rows) >= 4096:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return archives.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives and reads them back: a row for every input row.

    Null html is an empty payload. Of equal payloads of 100 bytes or more the smallest page_id's is the response; a
    repeated row with that page_id is a response too, and so is every row of a group without any page_id. Rows with a null
    page_id in another group are responses. Empty tables give no rows.
    """
    return read_archives(write_archives(planned(pages)))


def export(archives: DataFrame, folder: str) -> list[str]:
    """Archives as .warc.gz files of a folder that this process can write, one archive in memory at a time."""
    import os

    paths = []
    os.makedirs(folder, exist_ok=True)
    for row in archives.toLocalIterator():
        paths.append(os.path.join(folder, f"pages-{row['archive']:016x}.warc.gz"))
        with open(paths[-1], "wb") as f:
            f.write(row["data"])
    return sorted(paths)


def read_file(path: str) -> Iterator[Record]:
    with open(path, "rb") as f:
        yield from read(iter(lambda: f.read(CHUNK), b""))
