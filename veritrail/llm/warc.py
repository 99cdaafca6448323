"""WARC: archives as one gzip stream, and the normaliser that gives every record its own member.

`write` puts the pages' records into archives of one gzip stream each, as crawlers that compress whole files leave them. `normalise` inflates
each such stream once, in bounded pieces, compresses each record as a member of its own and writes a sidecar index with every record's
offset and length; members and index lines go to their files as they are made, so that no archive is held in memory, one record is.
`read` opens records by that index alone.

Records with equal payloads of at least LEAST bytes are stored once: the one with the smallest page id is the response, the others are revisits
that name it and carry no payload. Which are revisits is found on ids and digests alone: smallest ids are taken by digest before rows meet, and
the join that brings them back is one that adaptive execution splits, since a third of all pages may have one payload. The revisits' ids are
a written table; if it is below the session's limit for broadcasts, payloads stay where they are, else they move once to meet it.

Archives of others are taken as they are: records of any type, header names in any case, with or without blanks, folded or repeated fields, records without
target or digest (the digest is then taken of the block), several members, zeros after the last. An archive that ends inside a record or inside
a gzip member, or whose record is not as long as it says, is an error and leaves no file under its name.

Defined results: null html is an empty payload, null url an empty target; a null page id writes its record with an empty id, is read back as null and is
response unless another id has its payload; rows that repeat an id and a payload are all responses; an empty table writes nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.files import growing, lines, opened, put
from veritrail.sources.catalog import materialise, remove

LEAST = 100
#: Bytes of records before an archive is closed, of a piece that is inflated at once, and the compression level.
ARCHIVE, PIECE, LEVEL = 64 << 20, 1 << 20, 4
_GZIP = 31
#: The folder with archives as they came.
WHOLE = "whole"
DATE = "2024-01-01T00:00:00Z"


def classified(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, url, payload, payload_bytes, payload_digest, record_type, refers_to) of each row."""
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    rows = pages.select(F.col(id).cast("long").alias("page"), F.coalesce(url, F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    ids = rows.where(F.col("payload_bytes") >= LEAST).select("page", "payload_digest")
    first = ids.groupBy("payload_digest").agg(F.min("page").alias("least"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    again = ids.join(first, "payload_digest").where(~F.col("page").eqNullSafe(F.col("least")) & F.col("least").isNotNull()).distinct()
    again = materialise(again.select(F.col("page").alias("p"), F.col("payload_digest").alias("d"), "least"), "revisits")
    found = rows.join(again, F.col("page").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
    revisit = F.col("least").isNotNull()
    return found.select(
        "page", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("least").alias("refers_to"),
    )


def _record(page, url: str, payload: bytes, size: int, digest: str, kind: str, refers) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    name = "" if page is None else page
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}".replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Bytes: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Headers(dict):
    """The fields of a record by name, in any case; of a field that comes again the first, folded lines joined by a blank."""

    def __init__(self, raw: bytes) -> None:
        first, *rest = raw.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        for line in re.sub(r"\r\n[ \t]+", " ", "\r\n".join(rest)).split("\r\n"):
            name, _, value = line.partition(":")
            self.setdefault(name.strip().lower(), value.strip())

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)


def _page(urn: str | None) -> int | None:
    """The page that a record of `write` is of; null for other records."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _block(headers: Headers, block: bytes) -> bytes:
    """The payload: what follows the header of an HTTP message, or the whole block."""
    http = (headers.get("Content-Type") or "").replace(" ", "").startswith("application/http")
    return block.partition(b"\r\n\r\n")[2] if http else block


def _digest(headers: Headers, payload: bytes) -> str:
    return headers.get("WARC-Payload-Digest") or f"sha256:{hashlib.sha256(payload).hexdigest()}"


def write(records: DataFrame, out: str, archives: int | None = None) -> DataFrame:
    """Write `records` (of `classified`) as archives of one gzip stream each; returns their names as (archive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size, parts = TaskContext.get().partitionId(), 0, 0, []
        stream = zlib.compressobj(LEVEL, wbits=_GZIP)

        def close() -> pa.RecordBatch:
            name = f"crawl-{task:06d}-{made:04d}"
            put(f"{out}/{WHOLE}/{name}.warc.gz", b"".join([*parts, stream.flush()]))
            return pa.RecordBatch.from_pydict({"archive": [name]})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = _record(*row)
                parts.append(stream.compress(record))
                size += len(record)
                if size >= ARCHIVE:
                    yield close()
                    made, size, parts, stream = made + 1, 0, [], zlib.compressobj(LEVEL, wbits=_GZIP)
        if size:
            yield close()

    columns = ["page", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    dealt = records.select(columns)
    dealt = dealt.repartition(archives, F.xxhash64("page", "url")) if archives else dealt
    return materialise(dealt.sortWithinPartitions("page", "url").mapInArrow(run, "archive string"), "archives")


def _pieces(uri: str) -> Iterator[bytes]:
    """The inflated stream, a bounded piece at a time; members that follow the first are read on."""
    fs, path = opened(uri)
    with fs.open_input_stream(path, compression=None) as f:
        inflate, begun = zlib.decompressobj(wbits=_GZIP), False
        while data := f.read(PIECE):
            while data:
                data = data if begun else data.lstrip(b"\0")
                begun = begun or bool(data)
                yield inflate.decompress(data, PIECE)
                data = inflate.unconsumed_tail
                if inflate.eof:
                    data, inflate, begun = inflate.unused_data, zlib.decompressobj(wbits=_GZIP), False
        while begun and not inflate.eof and (piece := inflate.decompress(b"", PIECE)):
            yield piece
        if begun and not inflate.eof:
            raise ValueError("the archive ends inside a gzip member")


def records_in(pieces: Iterator[bytes]) -> Iterator[tuple[Headers, bytes]]:
    """(headers, whole record) of each record of an inflated stream."""
    held = bytearray()

    def more() -> bool:
        for piece in pieces:
            if piece:
                held.extend(piece)
                return True
        return False

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record")
                return
        headers = Headers(bytes(held[:at]))
        end = at + 4 + int(headers["Content-Length"]) + 4
        while len(held) < end:
            if not more():
                raise ValueError("the archive ends inside a record")
        if held[end - 4 : end] != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('WARC-Record-ID')} is not as long as it says")
        yield headers, bytes(held[:end])
        del held[:end]


def normalise(archives: DataFrame, out: str, keep: bool = False) -> DataFrame:
    """Rewrite each archive with a member a record and write its index; returns (archive, records). The archives as they came go once all are rewritten, unless `keep`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                at = records = 0
                with growing(f"{out}/{name}.warc.gz") as members, growing(f"{out}/{name}.index.jsonl") as index:
                    for headers, record in records_in(_pieces(f"{out}/{WHOLE}/{name}.warc.gz")):
                        pack = zlib.compressobj(LEVEL, wbits=_GZIP)
                        member = pack.compress(record) + pack.flush()
                        digest = headers.get("WARC-Payload-Digest") or _digest(headers, split(record)[1])
                        entry = {"id": headers.get("WARC-Record-ID"), "url": headers.get("WARC-Target-URI"), "type": headers.get("WARC-Type"), "digest": digest, "offset": at, "length": len(member)}
                        members.write(member)
                        index.write(json.dumps(entry).encode() + b"\n")
                        at, records = at + len(member), records + 1
                yield pa.RecordBatch.from_pydict({"archive": [name], "records": [records]})

    done = materialise(archives.repartition(max(1, archives.count()), "archive").mapInArrow(run, "archive string, records long"), "normalised")
    if not keep:
        remove(archives.sparkSession, f"{out}/{WHOLE}")
    return done


def fetch(uri: str, entry: dict) -> tuple[Headers, bytes]:
    """(headers, payload) of the record that an index entry names: one ranged read and one inflation."""
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        f.seek(entry["offset"])
        return parsed(f.read(entry["length"]))


def split(record: bytes) -> tuple[Headers, bytes]:
    """(headers, payload) of a whole record."""
    at = record.index(b"\r\n\r\n")
    headers = Headers(record[:at])
    return headers, _block(headers, record[at + 4 : at + 4 + int(headers["Content-Length"])])


def parsed(member: bytes) -> tuple[Headers, bytes]:
    """(headers, payload) of one member."""
    return split(zlib.decompress(member, wbits=_GZIP))


def read(spark: SparkSession, archives: DataFrame, out: str) -> DataFrame:
    """(page, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record, by the archives' indexes; records that are not of `write` have no page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                fs, path = opened(f"{out}/{name}.warc.gz")
                with fs.open_input_file(path) as f:
                    for entry in map(json.loads, lines(f"{out}/{name}.index.jsonl")):
                        f.seek(entry["offset"])
                        h, payload = parsed(f.read(entry["length"]))
                        size_ = int(h.get("X-Payload-Bytes") or len(payload))
                        rows.append((_page(h.get("WARC-Record-ID")), h.get("WARC-Target-URI"), payload, size_, _digest(h, payload).removeprefix("sha256:"), h.get("WARC-Type"), _page(h.get("WARC-Refers-To"))))
                        size += len(payload)
                        if size > PIECE * 8:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)

    dealt = archives.select("archive").repartition(max(1, archives.count()), "archive")
    return dealt.mapInArrow(run, "page long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
