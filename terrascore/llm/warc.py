"""Deterministic sharded WARC archives of pages.

Every page becomes one record in a gzip member of its own: ``response``, or ``revisit`` of the record that holds the same
payload. Headers and digests are made anew from the page; dates and ids of records depend on the page alone, so the same
table gives the same files, byte for byte, however it is partitioned and however often a task is run again.

1. Keys: one pass gives each page's SHA-1 and length. Payloads that several pages share are counted before anything is
   joined; the page of the largest id keeps the payload. The few digests that more than a thousandth of all pages have
   are joined by broadcast (fewer than 1,000 by their definition), all others by a shuffle on the digest.
2. Shards: ranges of the id. Their bounds are ids picked by a hash of the id, about 16 a shard, so that they don't depend
   on partitions; that sample is all that reaches the driver (at most some 2 million ids, for MOST_SHARDS shards).
3. Writing: pages, and the links of revisits without any payload, meet in the task of their shard, sorted by id and
   digest; the task streams them into files that roll over at a compressed size. A task holds one record at a time.
4. Commit: files are written under temporary names and renamed; a table of all files (the manifest) is written under a
   temporary name too and renamed when every task is done. Readers read the files that the manifest names, nothing else.

Nulls: a null payload is empty, a null url gives no target, a null id sorts first. Pages of a null id revisit a page with an
id where one has their payload, and are never revisited. Rows that repeat an id: among those of the same payload the one of the
largest url is the response, the others revisit it. An empty table gives a manifest without files. Control characters in a url are
percent-encoded. Columns of other names aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_stored, new_path, stored

#: Raw bytes of a shard, the most shards, and compressed bytes at which a file ends and the next begins.
SHARD_BYTES, MOST_SHARDS, ROLL_BYTES = 1 << 25, 1 << 16, 1 << 28
PICKS = 16
#: The profile of revisits by payload and the line ends of records.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
FILES = "file string, shard int, records long, bytes long, crc32 long"
_WRITTEN = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64())])


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: bytes, place: int) -> str:
    """The URI of a record: a name-based UUID of its page's id, its payload and its place among equal ones."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest.hex()}:{place}')}"


def safe_url(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def record(page_id: int | None, place: int, url: str | None, payload: bytes, digest: bytes, date: str, original: tuple[int, str | None] | None) -> bytes:
    """One record: a response with the payload, or a revisit (original: id and url of the response), whose block is the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if original else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if original else 'response'}", f"WARC-Record-ID: <{record_id(page_id, digest, place)}>", f"WARC-Date: {date}"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {safe_url(url)}")
    if page_id is not None:
        fields.append(f"Page-ID: {page_id}")
    if original:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(original[0], digest, 0)}>", f"Refers-To-Page-ID: {original[0]}"]
        if original[1] is not None:
            fields.append(f"WARC-Refers-To-Target-URI: {safe_url(original[1])}")
    fields += [f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", f"WARC-Payload-Digest: sha1:{base32(digest)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + END + block + END


def info(name: str, date: str) -> bytes:
    """The record that opens a file."""
    block = f"format: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    fields = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'file:{name}')}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + END + block + END


def member(data: bytes) -> bytes:
    """A gzip member without name or time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def replace(store: pafs.FileSystem, temp: str, name: str) -> None:
    """Rename temp to name; what an earlier attempt left there goes."""
    try:
        store.move(temp, name)
    except OSError:
        if store.get_file_info(name).type == pafs.FileType.NotFound:
            raise
        store.delete_file(name)
        store.move(temp, name)


class ShardWriter:
    """Writes the records of one shard to files under root that end at a compressed size."""

    def __init__(self, store: pafs.FileSystem, root: str, shard: int, roll_bytes: int, date: str):
        self.store, self.root, self.shard, self.roll_bytes, self.date = store, root, shard, roll_bytes, date
        self.number, self.out = 0, None

    def add(self, data: bytes) -> Iterator[pa.RecordBatch]:
        if self.out is None:
            self.name, self.temp = f"shard-{self.shard:06d}-{self.number:06d}.warc.gz", f"{self.root}/_temporary/{uuid.uuid4().hex}"
            self.out, self.records, self.size, self.crc = self.store.open_output_stream(self.temp, compression=None), 0, 0, 0
            self._write(member(info(self.name, self.date)))
        self._write(member(data))
        self.records += 1
        if self.size >= self.roll_bytes:
            yield from self.finish()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.crc = zlib.crc32(data, self.crc)

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.out is not None:
            self.out.close()
            replace(self.store, self.temp, f"{self.root}/{self.name}")
            yield pa.RecordBatch.from_pylist([{"file": self.name, "shard": self.shard, "records": self.records, "bytes": self.size, "crc32": self.crc}], _WRITTEN)
            self.out, self.number = None, self.number + 1


def shard_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most key, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*(F.lit(2**k) for k in range(len(bounds).bit_length() - 1, -1, -1)))
    b = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    found = F.aggregate(steps, F.lit(0), lambda a, s: F.when(F.coalesce(F.get(b, a + s - 1) <= key, F.lit(False)), a + s).otherwise(a))
    return F.when(key.isNull(), 0).otherwise(found)


def shard_bounds(keys: DataFrame, rows: int, shards: int) -> list[int]:
    """Ids that cut the table into at most that many ranges of like numbers of bytes (but for what a single pick spans): among ids
    picked by a hash of the id alone, about 16 a shard, those where the bytes before them pass the next share."""
    if shards < 2:
        return []
    every = max(1, rows // (shards * PICKS))
    picked = np.sort(keys.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).where("id is not null").select("id").distinct().toArrow().column(0).to_numpy())
    size = np.zeros(len(picked) + 1, np.int64)
    for part in keys.groupBy(shard_of(F.col("id"), picked.tolist()).alias("part")).agg(F.sum(F.col("n") + 1).alias("bytes")).toArrow().to_pylist():
        size[part["part"]] = part["bytes"]
    share = np.cumsum(size)[:-1] * shards // max(1, size.sum())
    return picked[np.flatnonzero(np.diff(share, prepend=0) > 0)].tolist()


def links(keys: DataFrame, rows: int, min_bytes: int) -> DataFrame:
    """(id, digest, keeper id and url) of every page whose payload, of at least min_bytes, a page of a larger id has too."""
    shared = stored(keys.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max(F.struct("id", "url")).alias("keeper"), F.count("*").alias("copies")).where("copies > 1 and keeper.id is not null"), "payloads")
    hot = shared.where(F.col("copies") > rows // 1000)  # fewer than 1,000
    few = shared.where(F.col("copies") <= rows // 1000)
    found = keys.join(F.broadcast(hot), "digest").unionByName(keys.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(few, "digest"))
    return found.where("id is null or id < keeper.id").select("id", "digest", "keeper")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages as an archive under path and return its manifest: (file, shard, records, bytes, crc32), a row a file.

    Of pages of equal payloads of at least min_bytes the one of the largest id holds the payload, the others revisit it.
    date is written into every record. A path that has a manifest already is an error."""
    spark = pages.sparkSession
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col].cast("binary"), F.lit(b"")).alias("payload"))
    keyed = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    keys = stored(keyed.select("id", "url", "digest", F.length("payload").cast("long").alias("n")), "page-keys")
    n, size = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = min(MOST_SHARDS, max(1, math.ceil(size / shard_bytes), n >> 20))
    bounds = shard_bounds(keys, n, shards)
    to_shard = shard_of(F.col("id"), bounds).alias("shard")
    none = F.lit(None).cast("struct<id: bigint, url: string>")
    both = keyed.select(to_shard, "id", "digest", F.lit(1).alias("kind"), "url", "payload", none.alias("keeper")).unionByName(links(keys, n, min_bytes).select(to_shard, "id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "keeper"))
    dealt = both.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("id", "digest", "kind", F.desc("url")).select("shard", "id", "digest", "kind", "url", "payload", F.col("keeper.id").alias("k_id"), F.col("keeper.url").alias("k_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, original, place = None, None, None, 0
        for b in batches:
            for shard, i, digest, kind, url, payload, k_id, k_url in zip(*(b.column(c).to_pylist() for c in range(8)), strict=True):
                if out is None or out.shard != shard:
                    if out is not None:
                        yield from out.finish()
                    store, root = pafs.FileSystem.from_uri(path)
                    store.create_dir(f"{root}/_temporary", recursive=True)
                    out = ShardWriter(store, root, shard, roll_bytes, date)
                if (i, digest) != last:
                    last, original, place = (i, digest), None, 0
                if kind == 0:  # the link comes before the pages it speaks of
                    original = (k_id, k_url)
                    continue
                yield from out.add(record(i, place, url, payload, digest, date, original))
                place += 1
                if original is None and i is not None and len(payload) >= min_bytes:
                    original = (i, url)  # further rows of this id and payload revisit this one
        if out is not None:
            yield from out.finish()

    jvm = spark._jvm
    table, temp = f"{path}/_manifest", f"{path}/_manifest-{uuid.uuid4().hex}"
    to, fresh, left = (jvm.org.apache.hadoop.fs.Path(x) for x in (table, temp, f"{path}/_temporary"))
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(to):
        raise ValueError(f"{path} holds an archive already")
    dealt.mapInArrow(run, FILES).write.parquet(temp)
    if not files.rename(fresh, to):
        raise OSError(f"the manifest of {path} can't be put in its place")
    files.delete(left, True)
    drop_stored(keys)
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files of a committed archive: (file, shard, records, bytes, crc32)."""
    return spark.read.schema(FILES).parquet(f"{path}/_manifest")


def members(stream) -> Iterator[bytes]:
    """The records of a file, one gzip member after the other."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the last record isn't whole")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields in lower case, block) of a record, held against its length and block digest."""
    head, _, rest = data.partition(END)
    version, *lines = head.decode().split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    n = int(fields["content-length"])
    block = rest[:n]
    if not version.startswith("WARC/") or len(block) != n or rest[n:] != END:
        raise ValueError(f"not a record: {head[:80]!r}")
    want = fields.get("warc-block-digest")
    if want is not None and want != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise ValueError(f"the block of {fields['warc-record-id']} doesn't match its digest")
    return fields, block


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, payload binary"
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("payload", pa.binary())])


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, record_id, payload) of every record of a committed archive.

    payload_bytes and payload_digest are those of the full payload, also for revisits, which have no payload of their own.
    Lengths, digests and the manifest's numbers of records and bytes are checked; what doesn't match is an error."""

    def row(fields: dict[str, str], block: bytes) -> dict:
        http, _, body = block.partition(END)
        digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
        length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:"))
        if kind == "response" and (len(body) != length or base32(hashlib.sha1(body).digest()) != digest):
            raise ValueError(f"the payload of {fields['warc-record-id']} doesn't match its digest")
        number = lambda k: int(fields[k]) if k in fields else None
        return {"page_id": number("page-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": length, "payload_digest": digest, "refers_to": number("refers-to-page-id"), "record_id": fields["warc-record-id"].strip("<>"), "payload": body if payload and kind == "response" else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        for b in batches:
            for f in b.to_pylist():
                rows, size, seen = [], 0, 0
                if store.get_file_info(f"{root}/{f['file']}").size != f["bytes"]:
                    raise ValueError(f"{f['file']} hasn't the size that the manifest names")
                with store.open_input_stream(f"{root}/{f['file']}", compression=None) as stream:
                    for data in members(stream):
                        fields, block = parse(data)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        rows.append(row(fields, block))
                        size, seen = size + (len(block) if payload else 0), seen + 1
                        if len(rows) >= 2000 or size >= 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, _READ)
                            rows, size = [], 0
                if seen != f["records"]:
                    raise ValueError(f"{f['file']} holds {seen} records; the manifest names {f['records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    listed = manifest(spark, path)
    return listed.repartition(max(1, min(MOST_SHARDS, listed.count()))).mapInArrow(run, READ)


def archive_and_read(pages: DataFrame, path: str | None = None, **more) -> DataFrame:
    """Write pages as an archive (in the shared folder, unless path is given) and read it back."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archive(pages, path, **more)
    return read_archive(pages.sparkSession, path, payload=False)
