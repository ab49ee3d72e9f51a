"""Sharded WARC archives: a deterministic writer and a reader."""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
#: Payload bytes of a shard (one task) and compressed bytes at which a file is rolled.
SHARD_BYTES, ROLL_BYTES = 32 << 20, 16 << 20
#: No more shards than this, however large the table.
MOST_SHARDS = 50_000
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "shard long, seq long, name string, temporary string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, file string, offset long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(common.hadoop_uri(uri))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def format_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record with its headers and digests; the same row always gives the same bytes."""
    digest = hashlib.sha256(payload).hexdigest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
        head.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head += [
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)  # its header holds no time
    return pack.compress(data) + pack.flush()


class _Files:
    """Files of one shard, rolled by compressed size, under temporary names of this attempt."""

    def __init__(self, root: str, roll: int):
        self.fs, self.root = _filesystem(root)
        self.roll, self.attempt = roll, uuid.uuid4().hex
        self.shard = self.stream = None
        self.done: list[tuple] = []

    def _open(self, shard: int, seq: int) -> None:
        self.shard, self.seq = shard, seq
        self.name = f"part-{shard:06d}-{seq:04d}.warc.gz"
        self.temporary = f"_temporary/{self.attempt}-{self.name}"
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.stream = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
        self.records, self.bytes, self.sha = 0, 0, hashlib.sha256()
        body = b"software: sparrowdex\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.name)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
        self._put(gzip_member(head.encode() + body + b"\r\n\r\n"))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.done.append((self.shard, self.seq, self.name, self.temporary, self.records, self.bytes, self.sha.hexdigest()))
            self.stream = None

    def add(self, shard: int, data: bytes) -> None:
        if self.stream is None or self.shard != shard:
            self.close()
            self._open(shard, 0)
        elif self.bytes >= self.roll:
            self.close()
            self._open(shard, self.seq + 1)
        self._put(gzip_member(data))
        self.records += 1


def write_warc(pages: DataFrame, root: str, *, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least: int = REVISIT_BYTES) -> DataFrame:
    """Writes a record for each row (page_id, url, html) and returns the manifest of the committed files.

    Shards are ranges of (page_id, hash of the payload), so rows without an id spread too, with near-equal payload bytes, from exact counts (``common.histogram_splitters``), so names and
    contents are the same on every run. Which payloads recur is found on (page_id, digest) alone; each of them sends a small marker
    row into the one exchange that carries the pages, and sorts just before its page. From ``MOST_SHARDS`` on shards grow with the table. Files are written under names of the attempt;
    the manifest, itself committed by Spark, names the attempts that count, and those files get their final names. A task
    that runs again or twice leaves nothing behind that is not in the manifest.

    Nulls: a null html is the empty payload, a null url leaves out the target, null page_ids come first. Equal payloads of ``least`` bytes or
    more: the smallest page_id is the response and the others revisit it; of rows equal in page_id and payload one is the response.
    An empty table gives an empty manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    low = F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63)))
    narrow = common.written(pages.select(low.alias("_l"), F.xxhash64(body).alias("_h"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n")), "warc-keys")
    weighed = narrow.withColumn("w", F.col("n") + 512)
    total = weighed.agg(F.sum("w")).first()[0] or 0
    shards = max(1, -(-total // max(shard_bytes, -(-total // MOST_SHARDS))))
    splitters, _, _ = common.histogram_splitters(weighed, "_l", "_h", "w", shards, 0.02)
    # min over the digests that recur; the hot digest is reduced before it moves
    recurs = narrow.filter(F.col("n") >= least).groupBy("digest").agg(F.min("_l").alias("first"), F.count("*").alias("c")).filter("c > 1").select("digest", "first")
    # distinct before the join: nothing after it asks for the digest's partitioning, so the skew rule may split a hot digest
    marks = narrow.filter(F.col("n") >= least).select("_l", "_h", "digest").distinct().join(recurs, "digest")
    none = lambda t: F.lit(None).cast(t)
    marks = marks.select("_l", "_h", F.lit(0).alias("kind"), none("string").alias("url"), none("binary").alias("payload"), F.col("digest"), F.col("first"))
    rows = pages.select(low.alias("_l"), F.xxhash64(body).alias("_h"), F.lit(1).alias("kind"), F.col("url"), body.alias("payload"), none("string").alias("digest"), none("long").alias("first"))
    both = marks.unionByName(rows)
    both = both.withColumn("shard", common.bucket_column("_l", "_h", splitters))
    sorted_rows = both.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "_l", "_h", "kind", "url", "digest", F.sha2("payload", 256))
    null_key = -(1 << 63)

    def run(batches):
        files = _Files(root, roll_bytes)
        page, firsts, seen = None, {}, set()
        for batch in batches:
            cols = [batch.column(c) for c in ("_l", "_h", "kind", "url", "payload", "digest", "first", "shard")]
            for at in range(0, batch.num_rows, 64):
                for l, h, kind, url, payload, digest, first, shard in zip(*(c.slice(at, 64).to_pylist() for c in cols), strict=True):
                    if (l, h) != page:
                        page, firsts, seen = (l, h), {}, set()
                    if kind == 0:
                        firsts[digest] = first
                        continue
                    own = hashlib.sha256(payload).hexdigest()
                    first = firsts.get(own)
                    revisit = first is not None and (first != l or own in seen)
                    seen.add(own)
                    files.add(shard, format_record(None if l == null_key else l, url, payload, None if first in (None, null_key) else first, revisit))
        files.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "seq", "name", "temporary", "records", "bytes", "sha256"), d, strict=True)) for d in files.done], schema=pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    spark_manifest = f"{root}/_manifest"
    sorted_rows.mapInArrow(run, MANIFEST).write.parquet(spark_manifest)
    manifest = spark.read.schema(MANIFEST).parquet(spark_manifest)

    def commit(batches):
        files, base = _filesystem(root)
        for batch in batches:
            for r in batch.to_pylist():
                final, temporary = f"{base}/{r['name']}", f"{base}/{r['temporary']}"
                if files.get_file_info(temporary).type.name == "File":  # a commit that runs again finds it moved
                    files.move(temporary, final)
                assert files.get_file_info(final).size == r["bytes"], f"{final} isn't what the manifest says"
            yield batch

    manifest.mapInArrow(commit, MANIFEST).write.parquet(f"{root}/_committed")
    common.remove(spark, f"{root}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{root}/_committed")


def parse_members(stream, chunk: int = 1 << 20):
    """(offset, record bytes) of each gzip member of a stream, read piece by piece."""
    offset, data, unpack, out = 0, b"", None, []
    used = 0
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                break
        if unpack is None:
            unpack, out, used = zlib.decompressobj(31), [], 0
        before = len(data)
        out.append(unpack.decompress(data))
        data = unpack.unused_data if unpack.eof else b""
        used += before - len(data)
        if unpack.eof:
            yield offset, b"".join(out)
            offset, unpack = offset + used, None
    if unpack is not None:
        raise ValueError("a record is cut off")


def parse_record(raw: bytes) -> dict | None:
    """Page record of one member with its digests checked; None for other types."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": digest, "refers_to": number("X-Refers-To-Page-ID"), "payload": None if revisit else payload}


def read_warc(spark: SparkSession, root: str, *, payload: bool = True) -> DataFrame:
    """Records of the committed archives under ``root``, files dealt over tasks and read as streams."""
    columns = [c.split(" ") for c in RECORD.split(", ")]
    columns = [c for c in columns if payload or c[0] != "payload"]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in columns])

    def run(batches):
        files, base = _filesystem(root)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, raw in parse_members(stream):
                        if (record := parse_record(raw)) is not None:
                            rows.append(record | {"file": name, "offset": offset})
                            held += len(raw) if payload else 64
                        if held > 8 << 20 or len(rows) >= 20_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/_committed")
    n = max(1, min(manifest.count(), 4096))
    return manifest.select("name").repartition(n, "name").mapInArrow(run, ", ".join(" ".join(c) for c in columns))


def archive_rows(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages as archives, reads them back and returns the digest of each record."""
    root = common.new_dir(spark, "warc")
    write_warc(pages.select("page_id", "url", "html"), root)
    return read_warc(spark, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
