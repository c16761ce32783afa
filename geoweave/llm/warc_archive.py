"""WARC archives with a Zstandard dictionary, records compressed one by one.

An archive starts with a skippable frame that holds a dictionary built from a bounded sample of its
own records; then each record is a frame of its own, so records can be read singly. Payloads that
occur more than once are stored by the row with the largest id; the others are revisit records that
name it. Archives are rows of a table in the folder that all executors share (an archive is a binary
value of bounded size), so writing them survives a lost executor; export() lays them out as files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import ROW_ID, materialize, with_row_id

#: Fixed values of the formats: skippable frame of a dictionary, base URI of record ids, revisit profile.
SKIPPABLE_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of records of one archive before compression, of the sample for its dictionary, of the dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 16 << 20, 2 << 20, 64 << 10, 3


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def write_record(row_id, page_id, url: str | None, payload: bytes, sha1: str, refers_to, refers_to_row, is_revisit: bool) -> bytes:
    """One record: response with the payload, or revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(f'row:{row_id}')}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(f'row:{refers_to_row}')}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of a record; the block's length must agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:n]


def build_archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """Dictionary frame, then a frame for each record."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = [r[: 128 << 10] for r in records[::step]]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=level) if len(sample) >= 8 else None
    except zstandard.ZstdError:  # too little to learn from
        trained = None
    if trained is None:  # the records themselves serve as a raw dictionary
        trained = zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held = trained.as_bytes()
    compressor = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True, write_checksum=True)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(held)) + held + b"".join(map(compressor.compress, records))


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, with the dictionary that it carries."""
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not start with a dictionary")
    held = data[8 : 8 + n]
    kind = zstandard.DICT_TYPE_FULLDICT if held[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held, dict_type=kind))
    rest = data[8 + n :]
    while rest:
        d = reader.decompressobj()
        yield d.decompress(rest)
        rest = d.unused_data


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records, size, first = [], 0, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([f"pages-{first}"]), pa.array([len(records)], pa.int64()), pa.array([build_archive(records)], pa.binary())], names=["archive", "n_records", "warc_zst"])

    for b in batches:
        for row in b.select([ROW_ID, "page_id", "url", "payload", "sha1", "refers_to", "refers_to_row", "is_revisit"]).to_pylist():
            first = row[ROW_ID] if first is None else first
            records.append(write_record(*row.values()))
            size += len(records[-1])
            if size >= ARCHIVE_BYTES:
                yield done()
                records, size, first = [], 0, None
    if records:
        yield done()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b["warc_zst"]:
            out = [[] for _ in range(9)]
            for record in read_archive(data.as_py()):
                fields, block = parse_record(record)
                kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                payload = block.partition(b"\r\n\r\n")[2]
                if kind == "response" and digest_of(payload) != said:
                    raise ValueError("a payload does not have its digest")
                page, other = fields["X-Page-Id"], fields.get("X-Refers-To-Page", "")
                row = (int(page) if page else None, fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), said, kind, int(other) if other else None, payload if kind == "response" else None, fields["WARC-Record-ID"], fields.get("WARC-Refers-To"))
                for o, v in zip(out, row):
                    o.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=RECORD_NAMES)


RECORD_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "record_id", "refers_to_record"]
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string, refers_to_record string"


def plan_records(pages: DataFrame, payload: str = "html", id_col: str = "page_id", url: str = "url", min_bytes: int = 0) -> DataFrame:
    """One row per page: payload, sha1 (hex), is_revisit, refers_to (a page) and refers_to_row (its row).

    Of pages with equal payloads of at least min_bytes, that with the largest id (of repeated ids the
    last row) is the response. Counts are combined before the shuffle, so a popular payload is one row per
    task; pages themselves are never grouped.
    """
    rows = with_row_id(
        pages.select(F.col(id_col).alias("page_id"), (F.col(url) if url in pages.columns else F.lit(None).cast("string")).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    )
    hashed = rows.withColumn("sha1", F.sha1("payload"))
    me = F.struct(F.col("page_id"), F.col(ROW_ID))
    groups = (
        hashed.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max(me).alias("best"), F.count("*").alias("n")).where("n > 1").select("sha1", "best")
    )
    of_row = hashed.select(ROW_ID, "sha1", F.octet_length("payload").alias("size")).where(F.col("size") >= min_bytes).join(groups, "sha1")
    others = of_row.where(F.col(ROW_ID) != F.col(f"best.{ROW_ID}")).select(ROW_ID, F.col("best.page_id").alias("refers_to"), F.col(f"best.{ROW_ID}").alias("refers_to_row"), F.lit(True).alias("is_revisit"))
    return hashed.join(others, ROW_ID, "left").withColumn("is_revisit", F.coalesce("is_revisit", F.lit(False)))


def write_archives(pages: DataFrame, payload: str = "html", id_col: str = "page_id", url: str = "url", min_bytes: int = 0) -> DataFrame:
    """Table of archives (archive, n_records, warc_zst), written to the shared folder.

    Ids must be integers; of the other columns only the URL is archived. Null payloads are empty ones; null ids and URLs
    are written as empty fields (a null id is never preferred); repeated rows give a record each; payloads of any length are one
    record; an empty table gives no archive.
    """
    planned = plan_records(pages, payload, id_col, url, min_bytes)
    return materialize(planned.mapInArrow(_write, "archive string, n_records long, warc_zst binary"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the archives; the payload is null for revisits, whose digest is that of the full payload."""
    return archives.select("warc_zst").mapInArrow(_read, RECORD_SCHEMA)


def export(archives: DataFrame, folder: str) -> int:
    """Write each archive as <folder>/<archive>.warc.zst on a file system that the driver sees; one at a time."""
    n = 0
    for row in archives.toLocalIterator():
        with open(f"{folder}/{row.archive}.warc.zst", "wb") as f:
            f.write(bytes(row.warc_zst))
        n += 1
    return n
