"""WARC records in stored ZIP archives, read by range through the ZIP directories.

Each task writes archives of bounded size: a member ``archive/<name>.warc`` with the records
and a member ``indexes/index.cdx`` with one line per record (offset, length, type, ids). Both
are stored, not compressed, so a record is a byte range of the archive. The reader parses the
end record, the ZIP64 records where values do not fit 32 bits, the central directory and the
local header, takes the index, and reads single records; it never unpacks a member.

Payloads that are equal and at least ``min_bytes`` long are written once: the page with the
largest id holds the response and the others revisit it. Null pages are empty payloads.
Repeated rows (equal ids) are records of their own and all responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlscout.llm.common import byte_rows, file_system, groups_of, shared_folder, spread_evenly, stored

ARCHIVE_BYTES = 16 << 20  # payload after which a task begins another archive
KEEPERS = 500_000  # repeated payloads broadcast at most: a digest of 20 bytes and an id each
RECORDS_PER_READ = 500  # index lines that one reading row stands for
FULL = 0xFFFFFFFF
#: Fixed values of the formats.
END, END64, LOCATE64, CENTRAL, LOCAL = (
    b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04",
)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class StoredZip:
    """Writes stored members to a stream; sizes are known before, so nothing is patched."""

    def __init__(self, sink, zip64_from: int = FULL):
        self.sink, self.at, self.members, self.limit = sink, 0, [], zip64_from

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _extra(self, *values: int) -> tuple[list[int], bytes]:
        """The 32-bit fields and the ZIP64 block that holds those that do not fit."""
        big = [v for v in values if v >= self.limit]
        block = struct.pack(f"<HH{len(big)}Q", 1, 8 * len(big), *big) if big else b""
        return [FULL if v >= self.limit else v for v in values], block

    def member(self, name: str, parts: list[bytes]) -> None:
        raw, size, crc, begin = name.encode(), sum(map(len, parts)), 0, self.at
        for p in parts:
            crc = zlib.crc32(p, crc)
        (packed, plain), extra = self._extra(size, size)
        fields = (45 if extra else 20, 0x800, 0, 0, 33, crc, packed, plain, len(raw), len(extra))
        self._put(LOCAL + struct.pack("<5H3I2H", *fields) + raw + extra)
        for p in parts:
            self._put(p)
        self.members.append((raw, size, crc, begin))

    def close(self) -> None:
        begin = self.at
        for raw, size, crc, at in self.members:
            (packed, plain, offset), extra = self._extra(size, size, at)
            need = 45 if extra else 20
            fields = (need, need, 0x800, 0, 0, 33, crc, packed, plain, len(raw), len(extra), 0, 0, 0, 0)
            self._put(CENTRAL + struct.pack("<6H3I5H2I", *fields, offset) + raw + extra)
        size, n = self.at - begin, len(self.members)
        if max(begin, size) >= self.limit or n >= 0xFFFF:
            end64 = self.at
            self._put(END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(LOCATE64 + struct.pack("<IQI", 0, end64, 1))
            n, size, begin = min(n, 0xFFFF), FULL, FULL
        self._put(END + struct.pack("<4H2IH", 0, 0, n, n, size, begin, 0))


class ZipRanges:
    """The members of an archive by reading ranges of it."""

    def __init__(self, path: str):
        system, inner = file_system(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        tail_at = max(0, size - 66_000)  # the comment has 65,535 bytes at most
        tail = self.range(tail_at, size - tail_at)
        at = tail.rfind(END)
        if at < 0:
            raise ValueError(f"{path} has no end of central directory")
        n, length, begin = struct.unpack("<10xH2I", tail[at : at + 20])
        if n == 0xFFFF or length == FULL or begin == FULL:
            locator = tail_at + at - 20
            (end64,) = struct.unpack("<8xQ4x", self._tagged(locator, 20, LOCATE64))
            n, length, begin = struct.unpack("<32x3Q", self._tagged(end64, 56, END64))
        self.members: dict[str, tuple[int, int, int]] = {}
        directory, at = self.range(begin, length), 0
        for _ in range(n):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError(f"{path} has a broken central directory")
            method, packed, plain, n_name, n_extra, n_note, offset = struct.unpack(
                "<10xH8x2I3H8xI", directory[at : at + 46]
            )
            name = directory[at + 46 : at + 46 + n_name].decode()
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            plain, packed, offset = self._wide([plain, packed, offset], extra)
            if method:
                raise ValueError(f"member {name} of {path} is compressed")
            self.members[name] = (offset, plain, packed)
            at += 46 + n_name + n_extra + n_note

    @staticmethod
    def _wide(values: list[int], extra: bytes) -> list[int]:
        """Replace values that stand in the ZIP64 block of the extra field, in its order."""
        at = 0
        while at + 4 <= len(extra):
            kind, length = struct.unpack("<2H", extra[at : at + 4])
            if kind == 1:
                wide = list(struct.unpack(f"<{length // 8}Q", extra[at + 4 : at + 4 + length // 8 * 8]))
                return [wide.pop(0) if v == FULL and wide else v for v in values]
            at += 4 + length
        return values

    def _tagged(self, at: int, size: int, tag: bytes) -> bytes:
        data = self.range(at, size)
        if data[:4] != tag:
            raise ValueError("a ZIP64 record is not where it should be")
        return data

    def range(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at) if size else b""

    def data_at(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member begin, and how many there are."""
        offset, size, _ = self.members[name]
        n_name, n_extra = struct.unpack("<26x2H", self._tagged(offset, 30, LOCAL))
        return offset + 30 + n_name + n_extra, size

    def close(self) -> None:
        self.file.close()


def _digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to, digest: str | None = None) -> bytes:
    """One WARC 1.1 record: a response with its payload, or a revisit without."""
    kind = "response" if refers_to is None else "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: {digest or _digest(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def duplicates(pages: DataFrame, min_bytes: int, keepers: int = KEEPERS) -> DataFrame:
    """Pages with ``refers_to``: the page that holds an equal payload, null for responses.

    The largest id of a payload is found by an aggregate, which combines before the shuffle.
    Payloads that are there more than once are counted; up to ``keepers`` of them are sent to
    all tasks, so that pages stay where they are. More are joined by a shuffle of the pages,
    which Spark splits where one payload is very frequent.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("text"),
    ).withColumn("_sha", F.unhex(F.sha1("text")))
    known = F.octet_length("text") >= min_bytes
    largest = (
        rows.filter(known)
        .groupBy("_sha")
        .agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    largest = stored(largest, "keepers")
    few = largest.count() <= keepers
    joined = rows.join(F.broadcast(largest) if few else largest.hint("merge"), "_sha", "left")
    other = known & F.col("_keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    return joined.select("page_id", "url", "text", F.when(other, F.col("_keeper")).alias("refers_to"))


def write(
    pages: DataFrame,
    *,
    min_bytes: int = 1000,
    archive_bytes: int = ARCHIVE_BYTES,
    zip64_from: int = FULL,
    keepers: int = KEEPERS,
) -> DataFrame:
    """Write archives to the shared folder and return the manifest (path, n_records)."""
    folder = shared_folder(pages.sparkSession, "warc")

    def save(parts: list[bytes], lines: list[str]) -> tuple[str, int]:
        path = f"{folder}/{uuid.uuid4().hex}.zip"
        system, inner = file_system(path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inner) as sink:
            out = StoredZip(sink, zip64_from)
            out.member("archive/data.warc", parts)
            out.member("indexes/index.cdx", ["\n".join(lines).encode()])
            out.close()
        return path, len(lines)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        lines: list[str] = []
        size, saved = 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                columns = [some.column(i).to_pylist() for i in (0, 1, 3)]
                for page_id, url, refers, payload in zip(*columns, byte_rows(some.column(2))):
                    made = record(page_id, " ".join(url.split()), payload, refers)
                    lines.append(f"{size} {len(made)}")
                    parts.append(made)
                    size += len(made)
                    if size >= archive_bytes:
                        saved.append(save(parts, lines))
                        parts, lines, size = [], [], 0
        if lines:
            saved.append(save(parts, lines))
        if saved:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in saved]), pa.array([n for _, n in saved], pa.int64())],
                ["path", "n_records"],
            )

    rows = duplicates(pages, min_bytes, keepers)
    return stored(rows.mapInArrow(run, "path string, n_records long"), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, digest, refers_to, payload) of every record.

    A reading row is a range of index lines, so that an archive is read by several tasks.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                archive = ZipRanges(row["path"])
                at, size = archive.data_at("indexes/index.cdx")
                index = [tuple(map(int, x.split())) for x in archive.range(at, size).split(b"\n")]
                data, _ = archive.data_at("archive/data.warc")
                some = index[row["first"] : row["first"] + RECORDS_PER_READ]
                for a, b in groups_of([n for _, n in some], 8 << 20):
                    out: list[list] = [[], [], [], [], [], []]
                    for offset, length in some[a:b]:
                        fields, block = parse(archive.range(data + offset, length))
                        values = (
                            _page(fields["warc-record-id"]),
                            fields["warc-target-uri"],
                            fields["warc-type"],
                            base64.b32decode(fields["warc-payload-digest"][5:]).hex(),
                            _page(fields.get("warc-refers-to", "")),
                            block,
                        )
                        for column, value in zip(out, values):
                            column.append(value)
                    kinds = [pa.int64(), *[pa.string()] * 3, pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(out, kinds)],
                        ["page_id", "url", "record_type", "digest", "refers_to", "payload"],
                    )
                archive.close()

    last = F.greatest(F.col("n_records") - 1, F.lit(0))
    ranges = manifest.select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(RECORDS_PER_READ))).alias("first")
    )
    schema = (
        "page_id long, url string, record_type string, digest string, refers_to long, payload binary"
    )
    n_ranges = manifest.agg(F.sum(F.ceil(F.col("n_records") / RECORDS_PER_READ))).first()[0] or 0
    return spread_evenly(ranges, int(n_ranges), "path", "first").mapInArrow(run, schema)


def _page(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def summary(records: DataFrame) -> DataFrame:
    """Per record the size and SHA-1 of its full payload, taken from the payloads read.

    A revisit's payload is that of the response it refers to.
    """
    own = records.select(
        "page_id",
        "record_type",
        "refers_to",
        F.col("digest").alias("_stated"),
        F.octet_length("payload").cast("long").alias("_bytes"),
        F.sha1("payload").alias("_sha"),
    )
    own = stored(own, "records")
    kept = own.filter("record_type = 'response'").groupBy("page_id").agg(
        F.max(F.struct("_bytes", "_sha")).alias("_kept")
    )
    joined = own.join(kept.withColumnRenamed("page_id", "_to"), F.col("refers_to") == F.col("_to"), "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        "page_id",
        F.when(revisit, F.col("_kept._bytes")).otherwise(F.col("_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("_kept._sha")).otherwise(F.col("_sha")).alias("payload_digest"),
        "record_type",
        "refers_to",
        (F.when(revisit, F.col("_kept._sha")).otherwise(F.col("_sha")) == F.col("_stated")).alias("digest_ok"),
    )
