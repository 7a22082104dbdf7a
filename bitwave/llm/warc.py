"""Deterministic sharded WARC archives.

Records are sorted by page_id, then digest. Shards are ranges of both with about equal bytes: CUTS rows
with the least hashes of id and digest give the cuts, an exact histogram over these gives bytes, and
neighbouring ranges make up a shard. Both depend on the rows alone, so the same rows always give the same
shards, and ids that are far apart, equal or null spread like any others. Payloads are exchanged once: what
makes a row a revisit travels to its shard beside it. The task of a shard streams its records, one gzip member each, and starts a new file when the compressed size
passes ROLL_BYTES. Headers and digests are made anew from the payload. A file is written under a
temporary name and moved when closed (a rename on file systems, a copy on object stores); a file counts only if the manifest, a table committed by
Spark after all shards, lists it. A task that runs twice writes the same bytes under the same name.

Of records with equal payloads of at least LEAST_REVISIT bytes, the one with the smallest page_id is
a response and the others are revisits without payload.

Defined results: a null html is an empty payload; a null url becomes urn:page:<page_id>; a null
page_id sorts first, is written without an id and never makes others revisits; of rows with equal
page_id and payload the first is the response; extra columns are ignored; an empty table gives
archives without files.

Files are written and read through pyarrow's file systems, which open file://, hdfs:// and object
stores; the folder must be one that all executors share.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import os
import uuid
import zlib

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_path, stored

ROLL_BYTES = 16 << 20
LEAST_REVISIT = 100
#: Cuts of the histogram that shards are made of (this many rows reach the driver at most), and shards.
CUTS, SHARDS = 8192, 4096
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "file string, shard int, records long, bytes long, sha256 string, first_id long, last_id long"


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def record(page_id, url: str, payload: bytes, digest: str, size: int, refers_to, refers_url) -> bytes:
    """The bytes of a record: WARC headers, HTTP headers and, for a response, the payload."""
    name = "" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    b32 = lambda h: "sha256:" + base64.b32encode(h).decode().rstrip("=")
    head = {
        "WARC-Type": "revisit" if refers_to is not None else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {url} {digest}')}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Page-ID": name,
        "WARC-Payload-Digest": b32(bytes.fromhex(digest)),
        "WARC-Block-Digest": b32(hashlib.sha256(block).digest()),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": refers_url, "WARC-Refers-To-Page-ID": str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member with no time and no name, so equal data give equal bytes."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


class Roller:
    """Writes members of one shard into files of about ROLL_BYTES."""

    def __init__(self, uri: str, shard: int, roll: int):
        self.fs, self.base = _open(uri)
        self.shard, self.roll, self.seq, self.out, self.done = shard, roll, 0, None, []

    def add(self, page_id, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.seq:06d}.warc.gz"
            self.temp = f"{self.base}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.sum, self.size, self.count, self.first = self.fs.open_output_stream(self.temp), hashlib.sha256(), 0, 0, page_id
            self.seq += 1
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)
        self.count += 1
        self.last = page_id
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.fs.move(self.temp, f"{self.base}/{self.name}")
            self.done.append((self.name, self.shard, self.count, self.size, self.sum.hexdigest(), self.first, self.last))


def write_archives(pages: DataFrame, uri: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives of pages under uri; returns the manifest, which is at uri/manifest."""
    spark = pages.sparkSession
    fs, base = _open(uri)
    fs.create_dir(f"{base}/_temporary", recursive=True)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))

    # Which payloads occur again, from narrow rows only.
    narrow = stored(rows.select("page_id", "url", "digest", "size"), "warc-rows")
    big = narrow.where((F.col("size") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
    again = big.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("m"), F.count("*").alias("n")).where("n > 1")
    again = stored(again.select("digest", F.col("m.page_id").alias("first_id"), F.col("m.url").alias("first_url")), "warc-again")
    later = big.join(again, "digest").where("page_id > first_id").select("page_id", "digest", "first_id", "first_url").distinct()
    later = stored(later, "warc-revisits")

    # Shards: neighbouring ranges of the histogram with about equal bytes.
    total = narrow.agg(F.sum(F.col("size") + 512)).first()[0]
    if total is None:
        return _commit(spark, spark.createDataFrame([], MANIFEST), uri)
    key = [F.col("page_id").isNull().alias("none"), F.coalesce("page_id", F.lit(0)).alias("id"), F.substring("digest", 1, 16).alias("head")]
    picked = narrow.select(*key).distinct().orderBy(F.xxhash64("id", "head", "none"), "id", "head", "none").limit(CUTS).collect()
    cuts = sorted((not r.none, r.id, r.head) for r in picked)

    @F.pandas_udf("int")
    def range_of(none: pd.Series, ids: pd.Series, head: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(cuts, x) for x in zip(~none, ids, head, strict=True)], dtype="int32")

    sums = {r.b: r.n for r in narrow.groupBy(range_of(*key).alias("b")).agg(F.sum(F.col("size") + 512).alias("n")).collect()}
    shards = max(1, min(SHARDS, -(-total // (4 * roll_bytes)) * 4))
    shard_of, spent = [], 0
    for b in range(len(cuts) + 1):
        shard_of.append(min(shards - 1, spent * shards // total))
        spent += sums.get(b, 0)

    @F.pandas_udf("int")
    def shard(none: pd.Series, ids: pd.Series, head: pd.Series) -> pd.Series:
        return pd.Series([shard_of[bisect.bisect_right(cuts, x)] for x in zip(~none, ids, head, strict=True)], dtype="int32")

    nothing = lambda kind: F.lit(None).cast(kind)
    marks = later.select("page_id", nothing("string").alias("url"), nothing("binary").alias("payload"), "digest", nothing("long").alias("size"), "first_id", "first_url")
    both = rows.withColumns({"first_id": nothing("long"), "first_url": nothing("string")}).select(*marks.columns).union(marks)
    dealt = both.select(shard(*key).alias("shard"), "*").repartitionById(shards, F.col("shard"))
    # Of one id and digest the mark comes before the rows.
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", F.col("first_id").asc_nulls_last(), "url")

    def run(batches):
        roller, previous, mark = None, None, None
        for batch in batches:
            for shard, page_id, url, payload, digest, size, first_id, first_url in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size is None:
                    mark = (page_id, digest, first_id, first_url)
                    continue
                if mark and mark[:2] == (page_id, digest):
                    first_id, first_url, payload = mark[2], mark[3], b""
                if roller is None or roller.shard != shard:
                    if roller:
                        roller.close()
                        yield from rows_of(roller)
                    roller = Roller(uri, shard, roll_bytes)
                link = url if url is not None else f"urn:page:{page_id}"
                if first_id is None and page_id is not None and size >= LEAST_REVISIT and previous and previous[:2] == (page_id, digest):
                    first_id, first_url = page_id, previous[2]
                elif first_id is None:
                    previous = (page_id, digest, link)
                if first_id is not None and first_url is None:
                    first_url = f"urn:page:{first_id}"
                roller.add(page_id, member(record(page_id, link, payload, digest, size, first_id, first_url)))
        if roller:
            roller.close()
            yield from rows_of(roller)

    def rows_of(roller):
        if roller.done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*roller.done, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    return _commit(spark, dealt.mapInArrow(run, MANIFEST), uri)


def _commit(spark: SparkSession, rows: DataFrame, uri: str) -> DataFrame:
    rows.write.mode("error").parquet(f"{uri}/manifest")
    fs, base = _open(uri)
    fs.delete_dir(f"{base}/_temporary")  # what failed attempts have left
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def members(stream):
    """The decompressed members of a gzip file, one after the other; memory for one at a time."""
    d, out, data = zlib.decompressobj(31), io.BytesIO(), b""
    while True:
        data = data or stream.read(1 << 15)  # short reads: the rest of one is copied for each member
        if not data:
            return
        out.write(d.decompress(data))
        data = b""
        if d.eof:
            yield out.getvalue()
            data, d, out = d.unused_data, zlib.decompressobj(31), io.BytesIO()


def parsed(data: bytes) -> tuple[dict, bytes, bytes]:
    """WARC headers, HTTP headers and payload of a record; checks the block digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != "sha256:" + base64.b32encode(hashlib.sha256(block).digest()).decode().rstrip("="):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def read_archives(spark: SparkSession, uri: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of the manifest's files."""
    files = spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, base = _open(uri)
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in members(stream):
                        fields, http, payload = parsed(data)
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha256:") + "====").hex()
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        if fields["WARC-Type"] == "response" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
                        number = lambda x: int(x) if x else None
                        rows.append((number(fields["WARC-Page-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To-Page-ID"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # Files are the unit of work: each goes to a task of its own as far as there are tasks.
    dealt = files.select("file").repartition(partitions(spark), "file")
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of pages in the shared folder, read back: the digest rows."""
    uri = shared_path(pages.sparkSession, "warc")
    if "://" not in uri and os.path.isabs(uri):
        uri = "file://" + uri
    write_archives(pages, uri)
    return read_archives(pages.sparkSession, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
