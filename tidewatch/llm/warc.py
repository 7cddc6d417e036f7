"""WARC archives in seekable Zstandard bundles.

A page becomes a WARC/1.1 record: a ``response`` with its whole payload, or, where a page of a larger id has the same payload,
a ``revisit`` of that page's record, with headers alone. A task writes its records into bundles: consecutive records form a
frame of about ``FRAME_BYTES``, a frame is an independent Zstandard frame, and a bundle ends with a seek table in a skippable
frame (the Zstandard seekable format), so any Zstandard tool reads the whole and a reader that seeks decompresses one frame
for one record. What a task returns is its part of the index: for each record its identifier, its bundle, its frame, and its
place in that frame. Bundles get a new name for each attempt and count only if Spark commits the index rows that name them,
so lost executors and repeated tasks leave at most files that nothing points to.

Reading back: seek tables give the frames of each bundle, frames are dealt out over the cluster, each is decompressed once,
its records are parsed and their digests checked; revisits find the page they refer to by record identifier.

Defined results: null html is an empty payload; a payload below ``least`` bytes is always a response; of rows with equal
payloads those with the largest page_id are responses, so rows that repeat it are responses, each of its own; null ids count
as smallest, have no Page-ID header and come back as null. No pages, no bundles, no rows. Urls stand in a header line with
control characters and blanks percent-encoded; a null url leaves the header out. A record (html and its headers) is held in memory by the task that writes
or reads it, as Spark holds the row. Extra columns don't matter.

The folder must be one that pyarrow's filesystems reach (``file://``, ``hdfs://``, ``s3://``, ``gs://``) from all executors.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .components import FEW
from .storage import folder, only, scratch, written

LEAST = 0
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 28
LEVEL = 6
#: The seekable format's skippable frame and its last number; the profile of a revisit.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, bundle string, frame int, at long, size long"
RECORD = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to_id string, intact boolean, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(sha1(data).digest()).decode()


def record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """A uuid from what tells a record from others, so that a revisit knows its target wherever that is written."""
    h = F.sha2(F.to_json(F.struct(page_id.alias("p"), url.alias("u"), digest.alias("d"))), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, record_id and, for revisits, refers_to_id.

    Payloads that occur once need no partner, so the table that says who is a response holds only those that recur; it is
    broadcast where it was counted to be small, else joined, with adaptive execution splitting a payload of many rows.
    """
    rows = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    first = F.struct("page_id", "url")
    again = written(rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max(first).alias("first")).where("n > 1").drop("n"), "payloads")
    named = again.select("digest", F.col("first.page_id").alias("top"), record_id(F.col("first.page_id"), F.col("first.url"), F.col("digest")).alias("target"))
    rows = rows.join(F.broadcast(named) if again.count() <= FEW else named, "digest", "left")
    response = F.col("target").isNull() | F.col("page_id").eqNullSafe(F.col("top"))
    return rows.select("page_id", "url", "html", record_id(F.col("page_id"), F.col("url"), F.col("digest")).alias("record_id"), F.when(~response, F.col("target")).alias("refers_to_id"))


def _header_url(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(row: dict, date: str) -> bytes:
    """A whole WARC record. The HTTP headers of a revisit tell the length of the payload that it leaves out."""
    payload, refers = row["html"].encode(), row["refers_to_id"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date)]
    head += [("WARC-Target-URI", _header_url(row["url"]))] if row["url"] is not None else []
    head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers}>")] if refers else []
    head += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    head += [("Page-ID", row["page_id"])] if row["page_id"] is not None else []
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parsed(data: memoryview, at: int) -> tuple[dict, int]:
    """The record that begins at ``at``, and where the next one does."""
    raw = bytes(data[at : at + 65536])
    while (end := raw.find(b"\r\n\r\n")) < 0 and at + len(raw) < len(data):  # a very long url
        raw = bytes(data[at : at + 4 * len(raw)])
    if end < 0 or not raw.startswith(b"WARC/"):
        raise ValueError(f"no WARC record at byte {at} of its frame")
    head = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    start = at + end + 4
    block = bytes(data[start : (stop := start + int(head["Content-Length"]))])
    http = block.index(b"\r\n\r\n") + 4
    fields = dict(line.split(": ", 1) for line in block[: http - 4].decode().split("\r\n")[1:])
    whole = head["WARC-Type"] == "response"
    payload, size, digest = block[http:] if whole else None, int(fields["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
    intact = head["WARC-Block-Digest"] == f"sha1:{base32_sha1(block)}" and (not whole or (len(payload), base32_sha1(payload)) == (size, digest))
    out = {
        "record_id": head["WARC-Record-ID"].strip("<>"), "page_id": int(head["Page-ID"]) if "Page-ID" in head else None, "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"], "payload_bytes": size,
        "payload_digest": digest, "refers_to_id": head["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in head else None, "intact": intact, "payload": payload,
    }
    return out, stop + 4


class Bundle:
    """A file that is written frame by frame and closed with its seek table."""

    def __init__(self, path: str) -> None:
        self.path, self.at, self.table = path, 0, []
        system, name = fs.FileSystem.from_uri(path)
        self.out = system.open_output_stream(name, compression=None)  # by its name it would compress the whole

    def add(self, frame: bytes) -> None:
        stored = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(frame)
        self.out.write(stored)
        self.at += len(stored)
        self.table.append((len(stored), len(frame)))

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0, SEEKABLE))
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(place, stored bytes, bytes) of each frame of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    n, flags, last = struct.unpack("<IBI", file.read(9))
    if last != SEEKABLE or flags & 0x80 and flags != 0x80:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8  # with a checksum of each frame
    file.seek(size - 9 - n * width)
    entries, out, at = file.read(n * width), [], 0
    for i in range(n):
        stored, whole = struct.unpack_from("<II", entries, i * width)
        out.append((at, stored, whole))
        at += stored
    return out


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least: int = LEAST, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes bundles below ``path`` and gives the index (record_id, page_id, bundle, frame, at, size), itself written to ``path``/index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, frame, size, index = None, [], 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if bundle is None:
                    bundle = Bundle(f"{path}/{uuid.uuid4().hex}.warc.zst")
                data = record(row, date)
                index.append((row["record_id"], row["page_id"], bundle.path, len(bundle.table), size, len(data)))
                frame.append(data)
                size += len(data)
                if size >= frame_bytes:
                    bundle.add(b"".join(frame))
                    frame, size = [], 0
                    if bundle.at >= bundle_bytes:
                        bundle.close()
                        yield _table(index, INDEX)
                        bundle, index = None, []
        if bundle is not None:
            if frame:
                bundle.add(b"".join(frame))
            bundle.close()
            yield _table(index, INDEX)

    planned(pages, least).mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    return index(pages.sparkSession, path)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], [n for n, _ in names])


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def frames(index_: DataFrame) -> DataFrame:
    """bundle, frame, start, stored, whole: the seek tables of the bundles that the index names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("bundle").to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as file:
                    yield _table([(path, i, *x) for i, x in enumerate(seek_table(file))], "bundle string, frame int, start long, stored long, whole long")

    return index_.select("bundle").distinct().mapInArrow(run, "bundle string, frame int, start long, stored long, whole long")


def _frame(path: str, start: int, stored: int, whole: int) -> memoryview:
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        file.seek(start)
        return memoryview(zstandard.ZstdDecompressor().decompress(file.read(stored), max_output_size=whole))


def read(index_: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all bundles that the index names, by reading every frame once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                data, at, out = _frame(x["bundle"], x["start"], x["stored"], x["whole"]), 0, []
                while at < len(data):
                    found, at = parsed(data, at)
                    if not payloads:
                        found["payload"] = None
                    out.append(tuple(found.values()))
                yield _table(out, RECORD)

    spark = index_.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    return frames(index_).repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bundle", "frame").mapInArrow(run, RECORD)


def fetch(index_: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose record_id is in ``wanted``, by seeking: one frame is decompressed for all that is wanted of it."""
    rows = index_.join(wanted.select("record_id").distinct(), "record_id", "left_semi").groupBy("bundle", "frame").agg(F.sort_array(F.collect_set("at")).alias("places"))
    rows = rows.join(frames(index_.join(rows.select("bundle").distinct(), "bundle", "left_semi")), ["bundle", "frame"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                data = _frame(x["bundle"], x["start"], x["stored"], x["whole"])
                yield _table([tuple(parsed(data, at)[0].values()) for at in x["places"]], RECORD)

    return rows.mapInArrow(run, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with refers_to: the page whose record a revisit names; null for a response."""
    targets = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'").join(targets, "refers_to_id", "left")
    return records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits.select(*records.columns, "refers_to"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the contract's records of ``pages``, written as bundles and read back from them, and whether their digests held."""
    with scratch(spark) as keep:
        index_ = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder(spark, "warc"))
        back = written(read(index_, payloads=False).drop("payload"), "records")
        return keep(resolved(back).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"), "resolved")


def oracle(least: int = LEAST) -> str:
    letters = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (k // 4) + 1, 5))::int >> (15 - 5 * (k % 4))) & 31) + 1, 1)"
    return f"""with p as (select page_id, coalesce(html, '') html from pages), g as (select html, max(page_id) top from p where strlen(html) >= {least} group by 1),
      r as (select page_id, strlen(p.html)::bigint payload_bytes, sha1(p.html) h, case when page_id < top then top end refers_to from p left join g using (html))
      select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: {letters}), '') payload_digest, case when refers_to is null then 'response' else 'revisit' end record_type, refers_to, true intact from r"""
