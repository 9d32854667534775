"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about ``FRAME_BYTES`` plain bytes
(a longer record has a frame of its own), so that any Zstandard reader can read
a bundle from end to end, and a record can be read by unpacking one frame.
Behind the frames stands a seek table in a skippable frame: per frame its
compressed and plain size, then the number of frames, a descriptor byte and a
magic number, as the seekable format has it. The index maps record identifiers
to bundle, frame, offset in the plain frame, and length.

Of records with equal payloads of at least ``LEAST`` bytes, that with the
largest id is written as a response and the others as revisits of it. Which is
which is settled on digests alone before any payload moves; payloads are then
dealt by record id, so a payload that a third of all pages share is no hot key.

A task writes its bundles under a name of its own attempt and lists them in its
output; a repeated task writes new files, and those of a lost attempt are in no
index. Bundles roll over at ``BUNDLE_BYTES``. Reading back is dealt by runs of
frames over as many tasks as the records' bytes need, and holds one frame.

Null html is an empty payload, and so is empty html. Repeated rows give a
record each; equal ids with equal payloads refer to each other's id. An empty
table writes no bundle. Null urls become ``urn:`` ids. Only ``page_id``,
``url`` and ``html`` are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import configure, scratch, stored

LEAST = 1000
BUNDLE_BYTES = 64 << 20
FRAME_BYTES = 1 << 20
#: Frames that one group of the read-back holds, and plain bytes that give it another task.
RUN_FRAMES = 8
READ_BYTES = 64 << 20
LEVEL = 3
# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

_INDEX = "bundle string, frame int, offset int, length int, record_id string, page_id long"


def _filesystem(folder: str):
    """File system and path of a URI or a plain path in the shared folder."""
    if urlsplit(folder).scheme:
        return pyarrow.fs.FileSystem.from_uri(folder)
    return pyarrow.fs.LocalFileSystem(), folder


def record_id(page_id: int, digest: str) -> str:
    """An identifier that a repeated task makes again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> tuple[str, bytes]:
    """Record identifier and bytes of one WARC record; a revisit when ``refers_to`` is given."""
    raw = hashlib.sha1(payload)
    name = record_id(page_id, raw.hexdigest())
    target = url or f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": name,
        "WARC-Target-URI": target.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(raw.digest()).decode(),
        **({} if page_id is None else {"X-Page-ID": str(page_id)}),
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = record_id(refers_to, raw.hexdigest())
        fields["X-Refers-To-Page-ID"] = str(refers_to)
    fields["Content-Length"] = str(len(block))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return name, head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, dict[str, str]]:
    """WARC fields, payload, and HTTP fields of a record."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    return fields, payload, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, plain) size."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(stream) -> list[tuple[int, int, int]]:
    """Offset, compressed and plain size of each frame, from the footer of an open bundle."""
    size = stream.size()
    stream.seek(size - 9)
    count, descriptor, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if descriptor & 0x80 else 8
    stream.seek(size - 9 - count * entry)
    body = stream.read(count * entry)
    frames, at = [], 0
    for k in range(count):
        length, plain = struct.unpack_from("<II", body, k * entry)
        frames.append((at, length, plain))
        at += length
    return frames


class _Bundle:
    """A bundle being written."""

    def __init__(self, filesystem, path: str):
        self.path, self.sizes, self.at = path, [], 0
        self.stream = filesystem.open_output_stream(path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True)
        self.frame = bytearray()

    def add(self, data: bytes) -> tuple[int, int]:
        """Number of the frame that takes the record, and its offset there."""
        if self.frame and len(self.frame) + len(data) > FRAME_BYTES:
            self._end_frame()
        offset = len(self.frame)
        self.frame += data
        return len(self.sizes), offset

    def _end_frame(self):
        packed = self.packer.compress(bytes(self.frame))
        self.stream.write(packed)
        self.sizes.append((len(packed), len(self.frame)))
        self.at += len(packed)
        self.frame.clear()

    def close(self):
        if self.frame:
            self._end_frame()
        self.stream.write(seek_table(self.sizes))
        self.stream.close()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        bundle, name = None, ""
        for part in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(part.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to"))):
                if bundle is None or bundle.at >= BUNDLE_BYTES:
                    if bundle is not None:
                        bundle.close()
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = _Bundle(filesystem, f"{root}/{name}")
                identifier, data = record(page_id, url, (html or "").encode(), refers_to)
                rows.append((name, *bundle.add(data), len(data), identifier, page_id))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["bundle", "frame", "offset", "length", "record_id", "page_id"],
            )
        if bundle is not None:
            bundle.close()

    return run


def references(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the revisits: rows that share a payload of at least LEAST bytes with a larger id."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    narrow = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes")).where(
        F.col("bytes") >= LEAST
    )
    largest = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1")
    return narrow.join(largest, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the bundles; the index (bundle, frame, offset, length, record_id, page_id), stored."""
    configure(pages.sparkSession)
    known = references(pages)
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    dealt = pages.select("page_id", "url", "html", digest.alias("digest")).join(known, ["page_id", "digest"], "left")
    return stored(dealt.mapInArrow(_writer(folder), _INDEX))


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(folder)
        unpacker = zstandard.ZstdDecompressor()
        path = stream = frames = held = plain = None
        for part in batches:
            rows = []
            for name, frame, offset, length in zip(*(part.column(n).to_pylist() for n in ("bundle", "frame", "offset", "length"))):
                if name != path:
                    if stream is not None:
                        stream.close()
                    path, stream = name, filesystem.open_input_file(f"{root}/{name}")
                    frames, held = read_seek_table(stream), None
                if frame != held:
                    begin, packed, size = frames[frame]
                    stream.seek(begin)
                    # Frame headers need not state the plain size; the seek table does.
                    held, plain = frame, unpacker.decompress(stream.read(packed), max_output_size=max(1, size))
                fields, payload, http = parse(plain[offset : offset + length])
                noted = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                whole = fields["WARC-Type"] == "response"
                digest = hashlib.sha1(payload).hexdigest() if whole else noted
                if digest != noted:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                refers_to = fields.get("X-Refers-To-Page-ID")
                page_id = fields.get("X-Page-ID")
                rows.append((
                    None if page_id is None else int(page_id), len(payload) if whole else int(http["Content-Length"]), digest,
                    fields["WARC-Type"], None if refers_to is None else int(refers_to),
                ))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )
        if stream is not None:
            stream.close()

    return run


def read(index: DataFrame, folder: str) -> DataFrame:
    """Read the indexed records back from their frames; payloads are checked against their digests.

    Any part of an index will do: only frames that it names are unpacked.
    """
    spark = configure(index.sparkSession)
    total = index.agg(F.sum(F.col("length").cast("long"))).first()[0] or 0
    tasks = max(-(-total // READ_BYTES), min(spark.sparkContext.defaultParallelism, -(-total // FRAME_BYTES)), 1)
    dealt = index.select("bundle", "frame", "offset", "length").repartition(
        tasks, "bundle", F.floor(F.col("frame") / RUN_FRAMES)
    ).sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(
        _reader(folder),
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to bundles in the shared folder and read them back."""
    folder = scratch(pages.sparkSession)
    return read(write(pages, folder), folder)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""
