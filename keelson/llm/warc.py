"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page: the bounds of the shards are quantiles, by bytes, of the page ids of smallest hash, some
SAMPLE of them and SPLITS for each shard, so the same table gives the same shards however it is partitioned. Rows without an id,
and those of an id that one row in HOT has or more, are dealt to shards of their own by digest; other rows of one id are
never apart. One task writes a shard: it regenerates every record's
headers and digests, rolls to a new file once the compressed size reaches `roll_bytes`, writes under a temporary name
and renames a finished file, then commits the shard by renaming its manifest. The driver commits the archive by a
manifest of all shards; the reader reads what that names. A task that runs again writes the same bytes.

Defined cases: null html is an empty payload; equal payloads of at least `least_bytes` are stored once, as the response
of the smallest page id, the others are revisits of it (also rows that repeat a page id; rows without an id are
revisits unless no row with an id has the payload); rows without an id sort first; a null url is written as urn:none;
an empty table gives an archive without files; other columns are never read."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Page ids that are sampled at least, and for each shard: what the driver holds.
SAMPLE, SPLITS = 20_000, 16
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SALTS = 16
#: An id of at least one row in so many is hot; there are no more of them.
HOT = 1 << 8
#: Bytes of a record beside its payload, about.
RECORD = 700


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _commit(files: pafs.FileSystem, path: str, data: bytes) -> None:
    """Write under a temporary name, then rename: readers see all of it or nothing."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(temporary) as out:
        out.write(data)
    files.move(temporary, path)


def record(page_id: int | None, url: str | None, payload: bytes, date: str, refers_to: int | None = None, revisit: bool = False, repeat: int = 0) -> bytes:
    """One WARC record with fresh headers and digests."""
    digest = base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else "urn:none"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{digest}/{target}/{repeat}")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if revisit:
        lines.append(f"WARC-Profile: {_REVISIT}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}"]
    lines += [f"{k}: {v}" for k, v in (("X-Page-Id", page_id), ("X-Refers-To-Page-Id", refers_to)) if v is not None]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Shard:
    """The files of one shard. Each record is a gzip member of its own, with a fixed time stamp."""

    def __init__(self, uri: str, shard: int, roll_bytes: int, level: int) -> None:
        self.files, self.top = _open(uri)
        self.shard, self.roll, self.level, self.done, self.out = shard, roll_bytes, level, [], None

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:07d}-{len(self.done):05d}.warc.gz"
            self.temporary = f"{self.top}/{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.records, self.sum = self.files.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.sum.update(member)
        self.size, self.records = self.size + len(member), self.records + 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.move(self.temporary, f"{self.top}/{self.name}")
            self.done.append({"file": self.name, "records": self.records, "bytes": self.size, "sha256": self.sum.hexdigest()})
            self.out = None

    def commit(self) -> list[dict]:
        self.close()
        _commit(self.files, f"{self.top}/part-{self.shard:07d}.manifest", json.dumps(self.done).encode())
        return self.done


def _revisits(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the rows whose payload a smaller page id has; digests of many rows are salted."""
    marked = rows.select("page_id", "digest").where(F.col("size") >= least_bytes)
    first = marked.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    first = first.select(F.col("digest").alias("of"), "first", F.explode(F.array(*[F.lit(i) for i in range(_SALTS)])).alias("salt"))
    marked = marked.withColumn("s", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)))
    found = marked.join(first, (marked.digest == first.of) & (marked.s == first.salt) & ~F.col("page_id").eqNullSafe(F.col("first")))
    return found.select("page_id", "digest", F.col("first").alias("refers_to")).distinct()


def _hot(narrow: DataFrame) -> list[int]:
    """The page ids of at least one row in HOT."""
    ids = narrow.select("page_id").where(F.col("page_id").isNotNull())
    # a superset of these, of at most a few times HOT, in one pass
    some = ids.freqItems(["page_id"], 1 / HOT).first()[0] or []
    n = ids.count()
    return sorted(r[0] for r in ids.where(F.col("page_id").isin(some)).groupBy("page_id").count().collect() if r[1] * HOT >= n and r[1] > 1)


def _bounds(narrow: DataFrame, n: int, shards: int) -> np.ndarray:
    """Page ids that cut the table into about so many ranges of equal bytes."""
    if shards < 2:
        return np.zeros(0, np.int64)
    # all rows of the ids whose hash is small: as many ids as are wanted, or fewer if rows share ids
    part = min(1.0, max(SAMPLE, SPLITS * shards) / n)
    some = narrow.where(F.shiftrightunsigned(F.xxhash64("page_id"), 11) <= int(part * (1 << 53)))
    ids = some.groupBy("page_id").agg(F.sum(F.col("size") + RECORD).alias("bytes")).toPandas().sort_values("page_id")
    up_to = ids.bytes.to_numpy().cumsum()
    if not len(up_to):
        return np.zeros(0, np.int64)
    at = np.searchsorted(up_to, up_to[-1] * np.arange(1, shards) / shards, "right")
    return np.unique(ids.page_id.to_numpy(np.int64)[np.minimum(at, len(ids) - 1)])


def write(pages: DataFrame, uri: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, shard_bytes: int = 24 << 20, roll_bytes: int = 8 << 20, date: str = "2000-01-01T00:00:00Z", level: int = 6) -> list[dict]:
    """Write the archive below uri, a folder that driver and executors share; the committed manifest's entries."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"), payload.alias("payload"))
    narrow = rows.select("page_id", "digest", "size")
    hot = _hot(narrow)
    no_id = F.col("page_id").isNull() | F.col("page_id").isin(hot)
    sums = narrow.agg(F.count(F.when(~no_id, 1)).alias("n"), F.sum(F.when(~no_id, F.col("size") + RECORD)).alias("bytes"), F.sum(F.when(no_id, F.col("size") + RECORD)).alias("null_bytes")).first()
    wanted, nameless = (-(-(sums[c] or 0) // shard_bytes) for c in ("bytes", "null_bytes"))
    bounds = _bounds(narrow.where(~no_id), sums["n"], wanted)
    shards = nameless + (len(bounds) + 1 if wanted else 0)
    if not shards:
        nameless = shards = 1

    @F.pandas_udf(T.IntegerType())
    def shard_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), "right") + nameless
        return pd.Series(np.where(ids.isna() | ids.isin(hot), hashes.to_numpy(np.int64) % max(nameless, 1), own).astype(np.int32))

    marks = _revisits(narrow, least_bytes).select("page_id", F.lit(None).cast("string").alias("url"), "digest", F.lit(None).cast("binary").alias("payload"), "refers_to")
    both = rows.select("page_id", "url", "digest", "payload", F.lit(None).cast("long").alias("refers_to")).unionByName(marks)
    dealt = both.withColumn("shard", shard_of("page_id", F.xxhash64("digest"))).repartitionById(shards, "shard")
    # the mark of a page precedes it
    ordered = dealt.sortWithinPartitions("shard", F.asc_nulls_first("page_id"), F.col("payload").isNotNull(), "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, page, seen, marked, done = None, object(), {}, {}, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or out.shard != row["shard"]:
                    done += out.commit() if out else []
                    out = _Shard(uri, row["shard"], roll_bytes, level)
                if row["page_id"] != page:
                    page, seen, marked = row["page_id"], {}, {}
                if row["payload"] is None:
                    marked[row["digest"]] = row["refers_to"]
                    continue
                digest, body = row["digest"], bytes(row["payload"])
                again = seen.get(digest, 0)
                seen[digest] = again + 1
                refers = marked.get(digest, page if again and len(body) >= least_bytes else None)
                out.write(record(page, row["url"], body, date, refers, refers is not None, again))
        done += out.commit() if out else []
        yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    files, top = _open(uri)
    files.create_dir(top, recursive=True)
    # one line for each file: their number is the archive's size over roll_bytes
    written = ordered.mapInArrow(run, "file string, records long, bytes long, sha256 string").collect()
    entries = sorted((x.asDict() for x in written), key=lambda x: x["file"])
    _commit(files, f"{top}/MANIFEST.json", json.dumps({"files": entries}).encode())
    return entries


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an open archive: headers by lower-case name, and the block."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the archive ends within a record")
        yield head, block


def read(spark: SparkSession, uri: str, with_payload: bool = True) -> DataFrame:
    """Every record of the committed archive: page_id, url, record_type, refers_to, payload_bytes, payload_digest and,
    if asked for, the payload (null for revisits). Digests are verified."""
    files, top = _open(uri)
    with files.open_input_stream(f"{top}/MANIFEST.json") as f:
        entries = json.loads(f.read())["files"]
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    if not entries:
        return spark.createDataFrame([], schema)
    names = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                files, top = _open(uri)
                held, size = [], 0
                with files.open_input_stream(f"{top}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in records(stream):
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        payload = None if head["warc-type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
                        if payload is not None and base32_sha1(payload) != digest:
                            raise ValueError(f"{name}: a payload isn't that of its digest")
                        number = lambda k, head=head: int(head[k]) if k in head else None
                        row = {"page_id": number("x-page-id"), "url": head["warc-target-uri"], "record_type": head["warc-type"], "refers_to": number("x-refers-to-page-id"), "payload_bytes": number("x-payload-length"), "payload_digest": digest}
                        held.append(row | {"payload": payload} if with_payload else row)
                        size += 200 + len(payload or b"") * with_payload
                        if size > 1 << 24:
                            yield pa.RecordBatch.from_pylist(held, names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, names)

    listed = spark.createDataFrame([(e["file"],) for e in entries], "file string").repartition(len(entries))
    return listed.mapInArrow(run, schema)
