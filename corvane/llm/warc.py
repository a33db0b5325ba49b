"""Dictionary-compressed web archives, written by Spark and read back.

An archive is a sequence of Zstandard frames. The leading one is skippable and holds a
dictionary that is built from the archive's own first records; then every record is a
frame of its own, compressed with that dictionary, so that any record can be read alone.
Equal payloads are archived once: later records revisit the first.

One shuffle brings equal payloads together, sorted; payloads of very many copies are
dealt out by row, since their few first records are known beforehand. Frames are lines of
Spark's text writer, whose line separator is an empty skippable frame: archives reach any
store that Spark writes to, and a lost task leaves no part of one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, parallelism, table

#: Payload bytes under which equal payloads are archived each.
LEAST = 100
#: Payload bytes that an archive aims at, uncompressed.
ARCHIVE = 128 << 20
#: Dictionary bytes, and bytes of an archive's first records that it is built from.
DICTIONARY, SAMPLE = 64 << 10, 4 << 20
#: Longest cut of a record for the dictionary: more of one record would crowd others out.
CUT = 16 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
# Magic numbers of Zstandard frames, and the frame type that the archive
# format gives to dictionaries.
DICTIONARY_FRAME = 0x184D2A5D
EMPTY_FRAME = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
ZSTD_FRAME = 0xFD2FB528
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ODD = re.compile(r"[\x00-\x20\x7f%]")
_CODE = re.compile(r"%([0-9A-F]{2})")
_RECORDS = "archive string, record_id string, page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string"


def record_id(page_id: int | None, row: int) -> str:
    return f"urn:page:{'-' if page_id is None else page_id}:{row}"


def page_of(name: str | None) -> int | None:
    """The page of a record id."""
    page = name.split(":")[2] if name else "-"
    return None if page == "-" else int(page)


def encode_record(name: str, url: str | None, payload: bytes, digest: str, revisits: str | None = None, date: str = DATE) -> bytes:
    """A record: its head, then the response's head and, unless it revisits, the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisits is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:  # marks that would end the line stand as codes
        head.append("WARC-Target-URI: " + _ODD.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisits:
        head += [f"WARC-Refers-To: <{revisits}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """(head fields in lower case, payload length, payload) of a record; raises ValueError
    on records that are cut or whose payload does not have its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4:
        raise ValueError(f"record {fields.get('warc-record-id')} is cut")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["warc-type"] == "revisit":
        return fields, length, None
    if len(payload) != length or f"sha256:{hashlib.sha256(payload).hexdigest()}" != fields["warc-payload-digest"]:
        raise ValueError(f"payload of {fields.get('warc-record-id')} differs from its digest")
    return fields, length, payload


def build_dictionary(records: list[bytes], size: int = DICTIONARY) -> bytes:
    """A Zstandard dictionary of the records. Of too few for statistics, their content."""
    cuts = [r[:CUT] for r in records]
    total = sum(map(len, cuts))
    try:
        if len(cuts) >= 8:
            return zstandard.train_dictionary(max(256, min(size, total // 8)), cuts, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"".join(reversed(cuts))[-size:] or b"\r\n" * 8


def frames(records: Iterator[bytes], level: int = LEVEL) -> Iterator[bytes]:
    """An archive: the dictionary in a skippable frame, then a frame for each record."""
    held, size, coder = [], 0, None

    def start() -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(build_dictionary(held))
        known.precompute_compress(level=level)
        return known, zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)

    def lead(known) -> bytes:
        raw = known.as_bytes()
        return DICTIONARY_FRAME.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw

    for r in records:
        if coder:
            yield coder.compress(r)
            continue
        held.append(r)
        size += min(len(r), CUT)
        if size >= SAMPLE:
            known, coder = start()
            yield lead(known)
            yield from map(coder.compress, held)
            held = []
    if held:
        known, coder = start()
        yield lead(known)
        yield from map(coder.compress, held)


def read_frames(archive: bytes, window: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, frame by frame."""
    view, at, known = memoryview(archive), 0, None
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic >> 4 == DICTIONARY_FRAME >> 4:
            end = at + 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            if magic == DICTIONARY_FRAME and at == 0:
                known = zstandard.ZstdCompressionDict(bytes(view[8:end]))
            at = end
            continue
        if magic != ZSTD_FRAME:
            raise ValueError(f"no frame at byte {at}")
        reader = zstandard.ZstdDecompressor(dict_data=known).decompressobj() if known else zstandard.ZstdDecompressor().decompressobj()
        parts = []
        while not reader.eof:
            if at >= len(view):
                raise ValueError("the last frame is cut")
            piece = bytes(view[at : at + window])
            parts.append(reader.decompress(piece))
            at += len(piece) - len(reader.unused_data)
        yield b"".join(parts)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (digest, page_id, row) to frames. Within a partition the first row of
    a digest is archived and the rest revisit it, but where `first` says who it is."""

    def records() -> Iterator[bytes]:
        digest = name = None
        for b in batches:
            for r in b.to_pylist():
                own = record_id(r["page_id"], r["row"])
                if r["first_row"] is not None:
                    to = record_id(r["first_page"], r["first_row"])
                    revisits = None if to == own else to
                elif len(r["payload"]) >= r["least"] and r["digest"] == digest:
                    revisits = name
                else:
                    digest, name, revisits = r["digest"], own, None
                yield encode_record(own, r["url"], r["payload"], r["digest"], revisits)

    held, size = [], 0
    for f in frames(records()):
        held.append(f)
        size += len(f)
        if size >= 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])


def write_archives(spark: SparkSession, pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, size: int = ARCHIVE, ws: Workspace | None = None) -> None:
    """Write a record per row of `pages` to archives in the folder `path`.

    Of rows with equal payloads of at least `least` bytes that with the smallest id is a
    response, others revisit it. Cases: a null payload is empty; payloads shorter than
    `least` are responses each; repeated rows and shared ids are records each, of which the
    first row is the response; a null id comes after all others; a null url gives a record
    without a target, white space, control characters and `%` in one stand as codes; very long
    payloads are whole, a record must fit 2 GB; no rows, no archive; other columns are
    ignored.
    """
    ws = ws or Workspace(spark)
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = ws.save(rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload")), "pages")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bytes").cast("long")), F.lit(0))).first()
    archives = max(parallelism(spark), -(-total // size))
    # Digests with more rows than a quarter of an archive's share: 4 * archives at most.
    copied = rows.filter(F.col("bytes") >= least).select("digest", F.struct(F.col("page_id").isNull().alias("no"), "page_id", "row").alias("at"))
    many = copied.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).filter(F.col("n") > max(64, n // (4 * archives))).collect()
    hot = F.broadcast(spark.createDataFrame([(r.digest, r["at"].page_id, r["at"].row) for r in many], "digest string, first_page long, first_row long"))
    dealt = rows.join(hot, "digest", "left").withColumn("least", F.lit(least))
    alone = F.col("first_row").isNotNull() | (F.col("bytes") < least)
    dealt = dealt.withColumn("key", F.when(alone, F.xxhash64("row")).otherwise(F.xxhash64("digest")))
    order = [F.col("digest"), F.asc_nulls_last("page_id"), F.col("row")]
    sorted_rows = dealt.repartition(archives, "key").sortWithinPartitions(*order).select("page_id", "row", "url", "payload", "digest", "first_page", "first_row", "least")
    lines = sorted_rows.mapInArrow(_write, "frame binary").select(F.col("frame").cast("string").alias("value"))
    lines.write.mode("overwrite").option("lineSep", EMPTY_FRAME.decode()).option("compression", "none").text(path)
    ws.drop("pages")


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record of the archives in `path`: archive, record_id, page_id, record_type,
    url, payload_bytes, payload_digest, refers_to, refers_to_record, and with `payloads` the
    payload, null for revisits. Every payload is checked against its digest; a damaged
    archive raises ValueError. An archive is read as one row, so it must fit a task."""
    schema = _RECORDS + (", payload binary" if payloads else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0), b.column(1), strict=True):
                out, size = [], 0
                for record in read_frames(memoryview(raw.as_buffer())):
                    head, length, payload = decode_record(record)
                    own, to = head["warc-record-id"][1:-1], head.get("warc-refers-to", "<>")[1:-1] or None
                    url = head.get("warc-target-uri")
                    url = None if url is None else _CODE.sub(lambda m: chr(int(m[1], 16)), url)
                    out.append((name.as_py(), own, page_of(own), head["warc-type"], url, length, head["warc-payload-digest"].partition(":")[2], page_of(to), to, *([payload] if payloads else [])))
                    size += len(payload or b"") if payloads else 0
                    if len(out) == 4000 or size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in schema.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, archived and read back."""
    ws = Workspace(spark)
    path = f"{ws.root}/archives"
    write_archives(spark, table(spark, sf_dir, "pages"), path, ws=ws)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS place, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= {LEAST} AND place > 1 THEN least END AS refers_to FROM d
"""

QUERIES = {"op13_warc": op13_warc}
ORACLE_SQL = {"op13_warc": _SQL}
