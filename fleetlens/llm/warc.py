"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page id into shards of about equal payload, each shard is written by one
task into files that roll by compressed size, and every file appears under its final name only when
it is complete.  A manifest, written by Spark after all files, commits the archive: the reader opens
only files that it lists.  Names, headers and digests depend on the rows alone, so a task that runs
again writes the same bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.storage import stored

BUCKETS = 4096  #: equal steps of the id range whose payload sizes place the shard bounds
SHARD_BYTES = 16 << 20  #: payload per shard
ROLL_BYTES = 8 << 20  #: a file closes once it has so many compressed bytes
MIN_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:fleetlens:page:"

MANIFEST = "file string, records long, bytes long, sha1 string"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary, digest_ok boolean, file string"
)


def _digest32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _urn(page_id: int | None) -> str:
    return f"<{URN}{'none' if page_id is None else page_id}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One gzip member.  ``refers_to`` is null for a response; a revisit carries headers only."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        # Printable ASCII stays; anything else would break a header line.
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127))).replace("%", "") + "%"))
    head.append(f"WARC-Payload-Digest: {_digest32(digest)}")
    head.append(f"WARC-Block-Digest: {_digest32(hashlib.sha1(block).hexdigest())}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, compresslevel=5, mtime=0)


def parse_records(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of each record of a decompressed stream."""

    def headers() -> dict[str, str]:
        out = {}
        while (line := data.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            out[name.strip().lower()] = value.strip()
        return out

    while first := data.readline():
        if not first.startswith(b"WARC/"):
            continue
        warc = headers()
        block = data.read(int(warc["content-length"]))
        head, _, payload = block.partition(b"\r\n\r\n")
        http = dict(
            (k.strip().lower(), v.strip())
            for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])
        )
        yield warc, http, payload


class _Roll:
    """Files of one shard: temporary name while open, final name when complete."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int, roll_bytes: int):
        self.fs, self.folder, self.shard, self.limit = fs, folder, shard, roll_bytes
        self.number = 0
        self.out = None

    def add(self, data: bytes) -> dict | None:
        if self.out is None:
            self.temporary = f"{self.folder}/_writing-{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temporary)
            self.records = self.bytes = 0
            self.sha1 = hashlib.sha1()
        self.out.write(data)
        self.sha1.update(data)
        self.records += 1
        self.bytes += len(data)
        return self.close() if self.bytes >= self.limit else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        name = f"shard-{self.shard:08d}-{self.number:05d}.warc.gz"
        self.number += 1
        self.fs.move(self.temporary, f"{self.folder}/{name}")
        return {"file": name, "records": self.records, "bytes": self.bytes, "sha1": self.sha1.hexdigest()}



def write_warc(
    pages: DataFrame,
    path: str,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write ``page_id, url, html`` as WARC records below ``path``; returns the manifest.

    Of records with equal payloads of at least ``min_revisit_bytes`` the one with the largest id is
    the response and the others revisit it; of repeated rows of that id the first written is the
    response.  A null html is an empty payload, a null url has no target header, rows with a null id
    are written under ``none`` and come first.  An empty table gives an empty archive with a manifest.
    Other columns are ignored.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    digests = stored(
        rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n")),
        "warc-digests",
    )
    same = (
        digests.where(F.col("n") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.count("*").alias("copies"), F.max("page_id").alias("target"))
        .where("copies > 1 and target is not null")
    )
    # One small row per copy tells the shard's task where the copy points.
    links = (
        digests.where(F.col("n") >= min_revisit_bytes)
        .join(same, "digest")
        .select("page_id", "digest", "target")
        .distinct()
    )
    bounds = digests.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
    low = bounds["low"] or 0
    width = ((bounds["high"] or 0) - low) // BUCKETS + 1
    bucket = F.coalesce(F.floor((F.col("page_id") - low) / F.lit(width)), F.lit(0)).cast("int")
    # At most BUCKETS rows, whatever the table holds.
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    places = F.broadcast(
        digests.groupBy(bucket.alias("bucket"))
        .agg(F.sum(F.col("n") + 400).alias("n"))
        .select("bucket", F.floor(F.coalesce(before, F.lit(0)) / shard_bytes).cast("int").alias("shard"))
    )
    columns = ["page_id", "digest", "kind", "target", "url", "payload"]
    both = rows.select(
        "page_id", F.sha1("payload").alias("digest"), F.lit(1).alias("kind"),
        F.lit(None).cast("long").alias("target"), "url", "payload",
    ).unionByName(
        links.select(
            "page_id", "digest", F.lit(0).alias("kind"), "target",
            F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"),
        )
    )
    placed = (
        both.withColumn("bucket", bucket)
        .join(places, "bucket")
        .select("shard", *columns)
        .repartition("shard")
        .sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "digest", "kind", F.asc_nulls_first("url"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])
        roll, link, seen = None, (), None
        done: list[dict | None] = []
        for batch in batches:
            for shard, page_id, digest, kind, target, url, body in zip(*(c.to_pylist() for c in batch.columns)):
                if roll is None or roll.shard != shard:
                    done.append(roll.close() if roll else None)
                    roll = _Roll(fs, folder, shard, roll_bytes)
                if kind == 0:
                    link = (page_id, digest, target)
                    seen = None
                    continue
                refers_to = link[2] if link and link[:2] == (page_id, digest) else None
                if refers_to == page_id and seen != (page_id, digest):
                    seen, refers_to = (page_id, digest), None
                done.append(roll.add(record_bytes(page_id, url, body, digest, refers_to, date)))
        done.append(roll.close() if roll else None)
        if found := [x for x in done if x]:
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    placed.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of a committed archive: headers, payload and whether its digest holds.

    ``payload_bytes`` and ``payload_digest`` describe the full payload, also for a revisit, whose
    own payload is empty.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch["file"]:
                rows, size = [], 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as raw:
                    for warc, http, payload in parse_records(gzip.GzipFile(fileobj=raw)):
                        digest = base64.b32decode(warc["warc-payload-digest"].partition(":")[2]).hex()
                        number = warc["warc-record-id"].removeprefix(f"<{URN}").rstrip(">")
                        refers = warc.get("warc-refers-to", "").removeprefix(f"<{URN}").rstrip(">")
                        revisit = warc["warc-type"] == "revisit"
                        rows.append(
                            (
                                None if number == "none" else int(number), warc.get("warc-target-uri"),
                                int(http["content-length"]), digest, warc["warc-type"],
                                int(refers) if refers else None, payload,
                                None if revisit else hashlib.sha1(payload).hexdigest() == digest, name,
                            )
                        )
                        size += len(payload)
                        if size > 4 << 20:
                            yield _frame(rows)
                            rows, size = [], 0
                if rows:
                    yield _frame(rows)

    names = [c.split()[0] for c in RECORDS.split(", ")]

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        for c in ("page_id", "refers_to", "payload_bytes"):
            out[c] = pd.array(out[c].tolist(), dtype="Int64")
        return out

    files = manifest.repartition(max(1, spark.sparkContext.defaultParallelism))
    return files.mapInPandas(read, RECORDS)


