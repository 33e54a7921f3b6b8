"""A deterministic sharded WARC writer and its reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspark.llm import common
from tallyspark.sources import store

#: Records and payload bytes of a shard, and compressed bytes after which a shard goes on in another file.
SHARD_RECORDS = 16384
SHARD_BYTES = 64 << 20
ROLL_BYTES = 32 << 20
#: Every record carries this date, so that a rerun writes the same bytes.
WARC_DATE = "2024-01-01T00:00:00Z"
_STEP = 1 << 14
_ENTRY = "file string, temporary string, shard long, part long, records long, bytes long, sha256 string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record. A revisit names the page whose payload it repeats and has no payload of its own."""
    digest, uri = base32_sha1(payload), _clean(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{record_id(page_id, digest)}>",
        f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Length: {len(block)}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{record_id(refers_to, digest)}>", f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")


def _clean(url: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "")


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of one file, a gzip member each. Digests are checked."""
    at = 0
    while at < len(data):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:  # small steps, as what lies behind a member is copied
            if at >= len(data):
                raise ValueError("file ends within a record")
            parts.append(inflate.decompress(data[at : at + _STEP]))
            at += min(_STEP, len(data) - at)
        at -= len(inflate.unused_data)
        text = b"".join(parts)
        head, _, rest = text.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(headers["Content-Length"])]
        if f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
        yield headers, block


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 0, shard_records: int = SHARD_RECORDS, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write one record per row of `pages` under `folder` and return the manifest (file, shard, part, records, bytes, sha256).

    Of records with equal payloads of at least `least_bytes` bytes the one of smallest id is a response and the others
    revisit it. Records are in the order of id, payload digest and URL. Shards are cut from the exact running counts of
    rows and payload bytes in that order, after `shard_records` rows or `shard_bytes` bytes, so that files do not depend on
    how Spark happens to partition; a shard rolls to a new file once `roll_bytes` are compressed. Headers and digests
    are computed anew and dates are fixed: a rerun writes the same files.

    Shards are sorted by Spark and written as a stream, a record at a time, so a task holds one Arrow batch and never a shard.
    A task writes under temporary names of its own attempt; its manifest rows exist only if it succeeded. The manifest
    is written, then the files it lists are renamed, and readers open only listed files. Leftovers of lost tasks are never read.

    NULL html is an empty payload. Records of a NULL id come first; they revisit the page of the smallest id with their
    payload, and are responses where no such page has an id. Rows that repeat an id are cut like others; only rows that are
    the same in all three columns stay together.
    """
    spark, work = pages.sparkSession, common.scratch(pages.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keys = rows.select("id", F.sha2("payload", 256).alias("digest"), _key().alias("key"), F.octet_length("payload").cast("long").alias("n"))
    keys = store.staged(keys.groupBy("id", "digest", "key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")), work, "keys")
    repeated = keys.filter(F.col("n") >= least_bytes).groupBy("digest").agg(
        F.min("id").alias("first_id"), F.sum("copies").alias("copies")
    ).filter("copies > 1 and first_id is not null").select("digest", "first_id")
    revisits = keys.join(repeated, "digest").filter("id is null or id > first_id").select("key", "first_id")
    ranked = common.running_totals(
        keys.select("key", "n", "copies"), work, [F.col("key")], {"rows": F.col("copies"), "bytes": F.col("copies") * F.col("n")}
    )
    ends = [
        F.floor(F.col(total) / most) > F.floor((F.col(total) - own) / most)
        for total, own, most in (("rows", F.col("copies"), shard_records), ("bytes", F.col("copies") * F.col("n"), shard_bytes))
    ]
    bounds = ranked.filter(ends[0] | ends[1]).select("key").orderBy("key").toArrow().column(0)  # the last key of each shard
    shard = _sharder(spark.sparkContext.broadcast(np.array(bounds.to_pylist(), "S")))
    none = F.lit(None)
    records = rows.select(_key().alias("key"), "url", "payload", none.cast("long").alias("first_id"), F.lit(1).alias("kind")).unionByName(
        revisits.select("key", none.cast("string").alias("url"), none.cast("binary").alias("payload"), "first_id", F.lit(0).alias("kind"))
    )
    dealt = records.withColumn("shard", shard("key")).repartition("shard").sortWithinPartitions("shard", "key", "kind")
    written = dealt.select("shard", "key", "url", "payload", "first_id", "kind").mapInArrow(_writer(f"{folder}/files", roll_bytes), _ENTRY)
    manifest = f"{folder}/manifest-{uuid.uuid4().hex[:8]}"
    written.write.parquet(manifest)
    entries = spark.read.parquet(manifest)
    entries.repartition("shard").mapInArrow(_committer(f"{folder}/files"), "file string").write.format("noop").mode("overwrite").save()
    return entries.drop("temporary")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record in the files of the manifest.

    Revisits carry the size and digest of the payload they repeat. An empty manifest gives no rows.
    """
    spark = manifest.sparkSession
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/files")
    listed = manifest.select("file")
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(listed, "file", "left_semi")
    return files.select("content").mapInArrow(_parser, schema)


def _parser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0).to_pylist():
            out = []
            for h, block in read_records(content):
                if h["WARC-Type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    size, digest = len(payload), base32_sha1(payload)
                else:
                    size, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                refers = h.get("X-Refers-To-Page-ID")
                page = int(h["X-Page-ID"]) if h["X-Page-ID"] else None
                out.append((page, h["WARC-Target-URI"], size, digest, h["WARC-Type"], int(refers) if refers else None))
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _key() -> Column:
    """One text in the order of id (NULL first), payload digest, URL digest."""
    unsigned = F.lpad(F.hex(F.col("id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(unsigned, F.lit("")), F.lit("."), F.sha2("payload", 256), F.md5(F.coalesce("url", F.lit("")).cast("binary")))


def _id_of(key: str) -> int | None:
    digits = key.partition(".")[0]
    return int(digits, 16) - (1 << 63) if digits else None


def _sharder(shared):
    """Shard 0 holds keys up to the first bound, and so on."""

    @F.arrow_udf("long")
    def shard(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(shared.value, np.array(keys.to_pylist(), "S")), pa.int64())

    return shard


def _file_system(folder: str):
    """The file system of a URI or path, as workers reach it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _writer(folder: str, roll_bytes: int):
    """Rows come by shard and key; one of kind 0 says what the pages with its key revisit."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        part = None
        try:
            for shard, packed in _packed(batches):
                if part and (part.shard != shard or part.size >= roll_bytes):
                    yield part.closed()
                    part = _Part(system, root, shard, part.number + 1 if part.shard == shard else 0)
                part = part or _Part(system, root, shard, 0)
                part.add(packed)
            if part:
                yield part.closed()
        finally:
            if part:
                part.out.close()

    return write


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(shard, compressed record) of every page."""
    revisit = (None, None)
    for batch in batches:
        for piece in common.pieces(batch, 3):
            for shard, key, url, payload, first_id, kind in zip(*(c.to_pylist() for c in piece.columns)):
                if kind == 0:
                    revisit = (key, first_id)
                else:
                    refers_to = revisit[1] if revisit[0] == key else None
                    yield shard, _compressed(record(_id_of(key), url, payload, refers_to))


class _Part:
    """One file under the temporary name of this attempt."""

    def __init__(self, system, root: str, shard: int, number: int) -> None:
        self.shard, self.number, self.size, self.records, self.digest = shard, number, 0, 0, hashlib.sha256()
        self.name = f"part-{shard:08d}-{number:05d}.warc.gz"
        self.temporary = f"_{self.name}.{uuid.uuid4().hex}"
        self.out = system.open_output_stream(f"{root}/{self.temporary}", compression=None)

    def add(self, packed: bytes) -> None:
        self.out.write(packed)
        self.digest.update(packed)
        self.size, self.records = self.size + len(packed), self.records + 1

    def closed(self) -> pa.RecordBatch:
        self.out.close()
        values = [self.name, self.temporary, self.shard, self.number, self.records, self.size, self.digest.hexdigest()]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in _ENTRY.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)


def _compressed(data: bytes) -> bytes:
    """A gzip member without time stamp."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def _committer(folder: str):
    """Rename listed files; one that already has its name was committed by an earlier attempt."""

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = _file_system(folder)
        for batch in batches:
            names = batch.column("file").to_pylist()
            for name, temporary in zip(names, batch.column("temporary").to_pylist()):
                if system.get_file_info(f"{root}/{temporary}").type != fs.FileType.NotFound:
                    system.move(f"{root}/{temporary}", f"{root}/{name}")
                elif system.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{folder}/{temporary}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    return commit


def round_trip(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages and read the archives back."""
    return read_warc(write_warc(pages, folder), folder)
