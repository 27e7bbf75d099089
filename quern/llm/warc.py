"""A deterministic, sharded WARC writer and its reader.

Records are ordered by key over the whole table.  Boundaries between shards come from the
BOUNDS_A_SHARD * shards keys with the smallest hashes, which any run on the same rows
finds alike, so the same rows always make the same files.  Each shard's task streams its
sorted records, one gzip member each, and starts a new file when the current one has
reached a size in compressed bytes.  Headers, lengths and digests are made anew.  A payload
that occurs in several records is kept once, with the largest key; the others become
revisit records.

A file is written under a temporary name of its own attempt.  The tasks' reports (temporary
name, final name, sizes, digest) form a manifest that Spark commits as a table, one
successful attempt a task; a second job renames exactly those files, and readers open only
files that the manifest names, each found under its final name or, after a broken rename,
its temporary one.  Leftovers of lost attempts are never read, and go once all files have
their final names.

Only html payload, key and url are moved once, to the shards; who keeps a payload is
decided on digests and travels as one small row ahead of its record.

Defined cases: a null payload is empty; a null key is ordered before all others, and as a
keeper gives way to any key; rows that repeat key and payload are records of their own, and
all of them are responses where theirs is the largest key; other columns are ignored; an
empty table makes an empty archive.  Storage is reached through pyarrow's file systems, by
the scheme of the folder's address.
"""

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.scratch import drop, new_path, release_shuffles, stage
from quern.llm.workers import lean

#: Payload bytes a shard aims at; shards are MIN_SHARDS at least and MAX_SHARDS at most.
SHARD_BYTES, MIN_SHARDS, MAX_SHARDS = 256 << 20, 32, 20_000
BOUNDS_A_SHARD = 20
#: Compressed bytes at which a file is closed; html packs to about a fifth, so that a shard
#: makes two files or so.
FILE_BYTES = 32 << 20
LEVEL = 6
#: WARC-Date of every record, unless the caller gives the crawl's own.
DATE = "1970-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, RFC 4122


def _fs(address: str) -> tuple[pafs.FileSystem, str]:
    if address.startswith("s3a://"):
        address = "s3://" + address[6:]
    if address.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + address[5:].lstrip("/")
    if "://" not in address:
        return pafs.LocalFileSystem(), address
    return pafs.FileSystem.from_uri(address)


def _order(key: Column, payload_digest: Column) -> Column:
    """Sort key of a record: nulls first, then by key, and by digest among equal keys."""
    return F.struct(key.isNotNull().cast("int").alias("has"), F.coalesce(key, F.lit(0)).cast("long").alias("key"), F.xxhash64(payload_digest).alias("tie"))


def _boundaries(orders: DataFrame, shards: int) -> list[tuple[int, int, int]]:
    """shards - 1 sort keys that part the rows evenly; the same for the same rows."""
    want = BOUNDS_A_SHARD * shards
    low = orders.select("order", F.xxhash64("order").alias("h")).orderBy("h", "order").limit(want).select("order.*").collect()
    keys = sorted((r["has"], r["key"], r["tie"]) for r in low)
    if len(keys) < shards:
        return keys[1:]
    return [keys[len(keys) * k // shards] for k in range(1, shards)]


def record_id(key: int | None, digest: str, number: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key}:{digest}:{number}')}>"


def _headers(pairs: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode()


def _clean(url: str | None) -> str:
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "urn:none"


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def make_record(key: int | None, url: str | None, payload: bytes, keeper: int | None, revisit: bool, number: int, date: str) -> bytes:
    digest = _b32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    pairs = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(key, digest, number)), ("WARC-Date", date), ("WARC-Target-URI", _clean(url))]
    if key is not None:
        pairs.append(("X-Record-Key", str(key)))
    pairs += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_b32(hashlib.sha1(block).digest())}")]
    if revisit:
        pairs += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(keeper, digest)), ("X-Refers-To-Key", str(keeper))]
    pairs += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _headers(pairs) + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    """One gzip member without time or name, so equal records give equal bytes."""
    body = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = body.compress(record) + body.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + packed + (zlib.crc32(record) & 0xFFFFFFFF).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")


_MANIFEST = "temp string, name string, records long, bytes long, sha256 string"


def write_warc(df: DataFrame, folder: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, min_shards: int = MIN_SHARDS, date: str = DATE) -> DataFrame:
    """Write one record a row into ``folder`` and return the manifest (name, records,
    bytes, sha256), which is also kept there as a table."""
    spark = df.sparkSession
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    digest = F.sha1(payload)
    small = stage(df.select(F.col(key_col).cast("long").alias("key"), digest.alias("digest"), F.octet_length(payload).cast("long").alias("n"), _order(F.col(key_col).cast("long"), digest).alias("order")), "warc-digests")
    size = small.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()["bytes"]
    shards = max(min_shards, min(MAX_SHARDS, -(-size // shard_bytes)))
    bounds = _boundaries(small, shards)
    # payloads that recur, and the largest key of each (null below all)
    groups = stage(small.groupBy("digest", "n").agg(F.max("key").alias("keeper"), F.count("*").alias("times")).where("times > 1"), "warc-copies")
    repeats = small.join(groups, ["digest", "n"]).where("NOT key <=> keeper").select("order", "keeper", "n").distinct()

    def shard_of(keys: pd.DataFrame) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, k) for k in zip(keys["has"].tolist(), keys["key"].tolist(), keys["tie"].tolist())], dtype="int32")

    shard = F.pandas_udf(shard_of, "int")
    rows = df.select(_order(F.col(key_col).cast("long"), digest).alias("order"), F.lit(1).alias("kind"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.lit(None).cast("long").alias("keeper"))
    notes = repeats.select("order", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "keeper")
    dealt = rows.unionByName(notes).withColumn("shard", shard("order")).repartitionById(shards, "shard").sortWithinPartitions("shard", "order", "kind", "url")
    flat = dealt.select("shard", "kind", "order.has", "order.key", "order.tie", "url", "payload", "keeper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        fs.create_dir(f"{root}/_temporary", recursive=True)
        done: list[tuple] = []
        out = state = None

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((state["temp"], state["name"], state["records"], state["bytes"], state["sha"].hexdigest()))
                out = None

        shard_now, number = None, 0
        note = None  # (key, tie, keeper) of the record that comes next
        last, repeat = None, 0
        for b in batches:
            for k in range(0, b.num_rows, 200):
                for s, kind, has, key, tie, url, payload, keeper in zip(*(c.to_pylist() for c in b.slice(k, 200).columns)):
                    if kind == 0:
                        note = (has, key, tie, keeper)
                        continue
                    if s != shard_now:
                        close()
                        shard_now, number = s, 0
                    if out is None:
                        name = f"part-{s:05d}-{number:05d}.warc.gz"
                        state = {"name": name, "temp": f"_temporary/{name}.{uuid.uuid4().hex}", "records": 0, "bytes": 0, "sha": hashlib.sha256()}
                        out = fs.open_output_stream(f"{root}/{state['temp']}", compression=None)
                        number += 1
                    repeat = repeat + 1 if (has, key, tie) == last else 0
                    last = (has, key, tie)
                    revisit = note is not None and note[:3] == last
                    data = _member(make_record(key if has else None, url, payload, note[3] if revisit else None, revisit, repeat, date), LEVEL)
                    out.write(data)
                    state["sha"].update(data)
                    state["records"] += 1
                    state["bytes"] += len(data)
                    if state["bytes"] >= file_bytes:
                        close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done]) for i in range(5)], ["temp", "name", "records", "bytes", "sha256"])

    manifest = f"{folder}/_manifest"
    flat.mapInArrow(lean(run), _MANIFEST).write.parquet(manifest)
    release_shuffles(spark)
    table = spark.read.schema(_MANIFEST).parquet(manifest)
    _commit(table, folder)
    drop(small, groups)
    return table.drop("temp")


def _commit(manifest: DataFrame, folder: str) -> None:
    """Give the manifest's files their final names; running it again changes nothing."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        n = 0
        for b in batches:
            for temp, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                    try:
                        fs.move(f"{root}/{temp}", f"{root}/{name}")
                    except OSError:  # another attempt of this task has moved it
                        if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                            raise
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    manifest.select("temp", "name").mapInArrow(move, "n long").agg(F.sum("n")).collect()
    fs, root = _fs(folder)
    if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
        fs.delete_dir(f"{root}/_temporary")
    with fs.open_output_stream(f"{root}/_SUCCESS") as f:
        f.write(b"")


def _records(stream) -> Iterator[bytes]:
    """The gzip members of a stream, unpacked one at a time."""
    unpack, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        parts.append(unpack.decompress(data))
        data = b""
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("a record is cut off")


def parse_record(raw: bytes) -> dict:
    """Headers and payload of a record, with lengths and digests checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    n = int(h["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("wrong length")
    if h["WARC-Block-Digest"] != f"sha1:{_b32(hashlib.sha1(block).digest())}":
        raise ValueError("wrong block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = h["WARC-Payload-Digest"][5:]
    if h["WARC-Type"] == "response" and (len(payload) != length or _b32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError("wrong payload")
    key, refers = h.get("X-Record-Key"), h.get("X-Refers-To-Key")
    return {
        "key": int(key) if key is not None else None, "url": h["WARC-Target-URI"], "record_id": h["WARC-Record-ID"], "record_type": h["WARC-Type"], "payload_bytes": length, "payload_digest": digest,
        "refers_to": int(refers) if refers not in (None, "None") else None, "payload": payload if h["WARC-Type"] == "response" else None,
    }


_READ = T.StructType([T.StructField(n, t) for n, t in (("key", T.LongType()), ("url", T.StringType()), ("record_id", T.StringType()), ("record_type", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.LongType()), ("payload", T.BinaryType()))])


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """All records of an archive that ``write_warc`` made, streamed file by file."""
    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")
    n = max(1, min(files.count(), 10_000))
    schema = T.StructType([f for f in _READ if payload or f.name != "payload"])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        kinds = [pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for temp, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = f"{root}/{name}"
                if fs.get_file_info(path).type == pafs.FileType.NotFound:
                    path = f"{root}/{temp}"
                with fs.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for raw in _records(stream):
                        rows.append(parse_record(raw))
                        held += len(raw)
                        if len(rows) >= 500 or held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds)], names)

    return files.select("temp", "name").repartition(n).mapInArrow(lean(run), schema)


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Write the rows to an archive in the shared folder and read it back, without payloads."""
    folder = new_path(df.sparkSession, "warc")
    write_warc(df, folder, **options)
    return read_warc(df.sparkSession, folder, payload=False)
