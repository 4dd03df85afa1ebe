"""WARC archives compressed with a Zstandard dictionary.

An archive is a skippable frame that carries the dictionary, then one frame per record.  The writer trains the
dictionary on a bounded, repeatable sample of payload heads, packs each task's records into archives of bounded
size, and hands them on as rows ``archive, content``; ``export_archives`` writes the rows as files and
``open_archives`` reads files with Spark's own binary reader.  The reader loads the dictionary from the leading
frame, decodes frame by frame, checks version line, required headers and lengths, and recomputes the digest of
every stored payload.

Equal payloads of at least 100 bytes are stored once: the one with the smallest ``page_id`` is the response, the
others are revisits.  Defined cases: NULL html is the empty payload; repeated rows of the smallest ``page_id`` are
all responses; a NULL ``page_id`` counts as larger than any other.
"""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

SKIPPABLE = 0x184D2A5D
SHARED_FROM = 100
SAMPLED = 2000
SAMPLE_HEAD = 4096
DICTIONARY = 32_768
ARCHIVE_BYTES = 8 << 20
VERSION = b"WARC/1.1"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
ENTRIES = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def train_dictionary(pages: DataFrame, sampled: int = SAMPLED) -> bytes:
    """Dictionary from the heads of the ``sampled`` payloads whose ids hash lowest."""
    html = F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_HEAD)
    rows = pages.select(F.xxhash64("page_id").alias("h"), "page_id", html.alias("head")).orderBy("h", "page_id", "head").limit(sampled)
    heads = [r.head.encode() for r in rows.select("head").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, heads).as_bytes()
    except zstandard.ZstdError:  # too few or too short: what there is, as raw content
        return (b"WARC/1.1\r\nWARC-Type: response\r\n" + b"".join(heads))[:DICTIONARY]


def _skippable(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def build_record(page_id, url, record_type: str, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    head = {
        "WARC-Type": record_type,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": str(size),
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": str(len(payload)),
    }
    if refers_to is not None:
        head["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v or k != "WARC-Target-URI")
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; anything malformed is an error."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION or not gap:
        raise ValueError(f"not a {VERSION.decode()} record")
    headers = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or name in headers:
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name] = value.strip()
    missing = [name for name in REQUIRED if name not in headers]
    if missing:
        raise ValueError(f"missing headers {missing}")
    length = int(headers["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not match the record")
    return headers, rest[:length]


def read_archive(content: bytes):
    """Yield the parsed records of one archive."""
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE or 8 + size > len(content):
        raise ValueError("the archive does not start with a dictionary frame")
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8:8 + size]))
    at, view = 8 + size, memoryview(content)
    while at < len(content):
        frame, record, step = decoder.decompressobj(), [], 2048
        while not frame.eof:
            if at >= len(content):
                raise ValueError("the archive ends inside a frame")
            record.append(frame.decompress(view[at:at + step]))
            at, step = min(at + step, len(content)), 2 * step
        at -= len(frame.unused_data)
        yield parse_record(b"".join(record))


def write_archives(pages: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """Archives ``archive, content`` with one record per row of ``page_id, url, html``."""
    dictionary = train_dictionary(pages) if dictionary is None else dictionary
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("size", F.length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    shared = rows.filter(F.col("size") >= SHARED_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = cut_lineage(shared.filter("n > 1").select("digest", "first"))
    rows = rows.join(shared, "digest", "left").select("page_id", "url", "payload", "size", "digest", "first")

    def pack(batches):
        level = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        parts, held, name = [_skippable(dictionary)], 0, hashlib.sha256()
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                page = None if pd.isna(row.page_id) else int(row.page_id)
                first = None if pd.isna(row.first) else int(row.first)
                again = first is not None and page != first
                record = build_record(page, row.url, "revisit" if again else "response", row.digest, int(row.size),
                                      first if again else None, b"" if again else row.payload)
                frame = level.compress(record)
                parts.append(frame)
                held += len(frame)
                name.update(frame)
                if held >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"archive": [name.hexdigest()[:32]], "content": [b"".join(parts)]})
                    parts, held = [_skippable(dictionary)], 0
        if held:
            yield pd.DataFrame({"archive": [name.hexdigest()[:32]], "content": [b"".join(parts)]})

    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("size").cast("string").alias("size"),
                       "digest", F.col("first").cast("string").alias("first"))
    return rows.mapInPandas(pack, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the archives, headers and lengths checked."""

    def number(value: str | None):
        inner = (value or "")[len("<urn:page:"):-1]
        return int(inner) if inner else None

    def entries(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for headers, block in read_archive(content):
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
                    size = int(headers["WARC-Payload-Length"])
                    if kind == "response" and (len(block) != size or hashlib.sha256(block).hexdigest() != digest):
                        raise ValueError("a stored payload differs from its digest or length")
                    if kind == "revisit" and (block or "WARC-Refers-To" not in headers):
                        raise ValueError("a revisit needs an empty block and the record it refers to")
                    rows.append((number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, size, digest,
                                 number(headers.get("WARC-Refers-To")), block))
                out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return archives.select("content").mapInPandas(entries, ENTRIES)


def export_archives(archives: DataFrame, folder: str) -> int:
    """Write each archive as ``folder/<archive>.warc.zst`` from the tasks; ``folder`` is a URI all machines reach."""

    def put(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["archive"], pdf["content"]):
                with store.open_output_stream(f"{path}/{name}.warc.zst", compression=None) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})

    return archives.mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0


def open_archives(spark, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select(F.col("path").alias("archive"), "content")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read their records back."""
    archives = cut_lineage(write_archives(pages))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
