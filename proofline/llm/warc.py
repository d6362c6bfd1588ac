"""WARC archives, compressed record by record with a dictionary each archive carries.

A task writes its rows to archives of its own. From the first records of an
archive (``sample_bytes`` of them at most) it builds a Zstandard dictionary,
puts that into a leading skippable frame, and compresses every record as a
frame of its own, so a reader can start at any record. Archives end at
``roll_bytes``.

An archive's name is new for every attempt of a task, and only what an attempt
that Spark accepted has written is listed in the manifest, so a lost executor
leaves at most unlisted files. The manifest is a table, never a list on the
driver. Files go through ``pyarrow.fs``, to any store that it knows.

Of pages with equal payloads that with the largest id is written as response;
the others are revisits without payload. To find them, a Bloom filter lets all
pages whose payload is certainly unique through without a shuffle.

A null html is an empty payload. A null id is written without one, counts as the
smallest and is read as null. Of rows alike in id and payload one, the first by
url, is the response, and the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import shared_folder, stored
from proofline.llm.exact_dedup import possibly_repeated, repeat_filter

# Fixed by the format.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
ROLL_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"


def place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder's URI or absolute path."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page: str | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{copy}')}>"


def _line(name: str, value: str) -> bytes:
    value = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)
    return f"{name}: {value}\r\n".encode("utf-8", "surrogatepass")


def record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = b"".join(_line(k, v) for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))] if v is not None)
    return VERSION + head + b"\r\n" + block + b"\r\n\r\n"


def page_record(row: dict, date: str = DATE) -> bytes:
    revisit = row["kind"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    fields = [
        ("WARC-Record-ID", record_id(row["id"], row["copy"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", row["url"]),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(row["sha1"])),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(row["refers_to"], 1) if revisit else None),
        ("X-Page-Id", row["id"]),
        ("X-Refers-To-Page-Id", row["refers_to"] if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(row["kind"], fields, http if revisit else http + (row["payload"] or b""))


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; of too few or too short ones, their raw bytes."""
    try:
        return zstandard.train_dictionary(size, samples, level=3)
    except zstandard.ZstdError:
        raw = b"".join(samples)[-size:].ljust(8, b"\0")
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _Archive:
    def __init__(self, fs, path: str, samples: list[bytes]):
        dictionary = build_dictionary(samples)
        packed = dictionary.as_bytes()
        self.path, self.records = path, 0
        self.out = fs.open_output_stream(path, compression=None)
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.bytes = 8 + len(packed)
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)

    def add(self, record: bytes) -> None:
        frame = self.zstd.compress(record)
        self.out.write(frame)
        self.bytes += len(frame)
        self.records += 1


_ROW = "id string, url string, payload binary, kind string, refers_to string, copy int, bytes bigint, sha1 string"


def write_archives(rows: DataFrame, folder: str, sample_bytes: int = SAMPLE_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write ``rows`` (as ``archive_rows`` makes them) below ``folder``; returns the
    stored manifest: path, records, bytes."""

    def run(batches):
        fs, base = place(folder)
        fs.create_dir(base, recursive=True)
        archive, waiting, size = None, [], 0

        def begin():
            archive = _Archive(fs, f"{base}/{uuid.uuid4().hex}.warc.zst", waiting)
            info = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            archive.add(info)
            for x in waiting:
                archive.add(x)
            return archive

        def end(archive):
            archive.out.close()
            return pa.RecordBatch.from_pydict({"path": [archive.path], "records": [archive.records - 1], "bytes": [archive.bytes]})

        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                made = page_record({n: c[i].as_py() for n, c in columns.items()}, date)
                if archive is None:
                    waiting.append(made)
                    size += len(made)
                    if size >= sample_bytes:
                        archive, waiting, size = begin(), [], 0
                else:
                    archive.add(made)
                if archive is not None and archive.bytes >= roll_bytes:
                    yield end(archive)
                    archive = None
        if archive is None and waiting:
            archive = begin()
        if archive is not None:
            yield end(archive)

    return stored(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "manifest")


def archive_rows(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """One row per page, as the writer takes them: responses with payload, revisits without."""
    pages = pages.select(
        F.col(id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    )
    words, bits = repeat_filter(pages, "html")
    maybe = possibly_repeated(F.col("html"), words.scalar(), bits) & (F.octet_length("html") >= min_bytes)

    def rows(df: DataFrame, kind: Column, refers: Column, copy: Column) -> DataFrame:
        body = F.col("html").cast("binary")
        return df.select(
            F.col("id").cast("string").alias("id"),
            "url",
            F.when(kind == "response", body).alias("payload"),
            kind.alias("kind"),
            refers.cast("string").alias("refers_to"),
            copy.alias("copy"),
            F.octet_length(body).cast("bigint").alias("bytes"),
            F.sha1(body).alias("sha1"),
        )

    nothing, one = F.lit(None).cast("string"), F.lit(1)
    once = rows(pages.where(~maybe), F.lit("response"), nothing, one)
    alike = pages.where(maybe).withColumn("sha", F.unhex(F.sha2("html", 256)))
    listed = stored(alike.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n")), "payloads")
    groups = stored(listed.groupBy("sha").agg(F.max("id").alias("last"), F.max("n").alias("n")), "payloads")
    joined = alike.join(groups, "sha")
    # Rows that may be alike in id and payload are counted; elsewhere the largest id decides.
    plain = joined.where("n = 1")
    first = F.col("id").eqNullSafe(F.col("last"))
    kind = F.when(first, "response").otherwise("revisit")
    single = rows(plain, kind, F.when(~first, F.col("last")), one)
    counted = (
        joined.where("n > 1")
        .groupBy("sha", "id", "url", "last")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("html").alias("html"))
    )
    before = Window.partitionBy("sha", "id").orderBy("url").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    counted = counted.withColumn("copy", F.explode(F.sequence((F.col("before") + 1).cast("int"), (F.col("before") + F.col("rows")).cast("int"))))
    first = F.col("id").eqNullSafe(F.col("last")) & (F.col("copy") == 1)
    repeated = rows(counted, F.when(first, "response").otherwise("revisit"), F.when(~first, F.col("last")), F.col("copy"))
    return once.unionByName(single).unionByName(repeated)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records of one archive."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(stream.read(size))
    plain = io.BufferedReader(
        zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(stream, read_across_frames=True), 1 << 20
    )
    while line := plain.readline():
        if line != VERSION:
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := plain.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[name] = value.strip()
        block = plain.read(int(fields["Content-Length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, block


def _pages_of(stream) -> Iterator[dict]:
    for fields, block in read_records(stream):
        if fields["WARC-Type"] not in ("response", "revisit"):
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        said = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response" and (len(payload), base32_sha1(hashlib.sha1(payload).hexdigest())) != (said, digest):
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what was archived")
        yield {
            "id": fields.get("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "kind": fields["WARC-Type"],
            "refers_to": fields.get("X-Refers-To-Page-Id"), "bytes": said, "digest": digest, "payload": payload,
        }


def read_archives(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The pages in the archives of a manifest: id, url, kind, refers_to, bytes, digest
    and, if asked for, payload (null for revisits)."""
    schema = "id string, url string, kind string, refers_to string, bytes bigint, digest string" + ", payload binary" * payload

    def run(batches):
        fs, _ = place(folder)
        names = ["id", "url", "kind", "refers_to", "bytes", "digest"] + ["payload"] * payload
        kinds = {"bytes": pa.int64(), "payload": pa.binary()}
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for row in _pages_of(stream):
                        if row["kind"] == "revisit" or not payload:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size >= 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    # One archive a task.
    archives = max(1, manifest.count())
    return manifest.select("path").repartition(archives, "path").mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the pages to archives below ``folder`` (a new shared one), read them back.

    Columns: id, payload_bytes, payload_digest, record_type, refers_to.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    manifest = write_archives(archive_rows(pages, id, url, html, min_bytes), folder)
    kind = pages.schema[id].dataType
    return read_archives(manifest, folder, payload=False).select(
        F.col("id").cast(kind).alias(id),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
