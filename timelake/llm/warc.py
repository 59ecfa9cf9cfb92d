"""A deterministic sharded WARC writer, and its reader.

Records are range-sorted by page id, each task writes its range as files that roll when their compressed size passes a
limit (one gzip member a record), and headers and digests are made anew from the payload. The ranges depend on the
records alone: their number on the records' bytes, their bounds on the ids that a fixed hash draws; neither the number
of shuffle partitions nor Spark's sampling plays a part, so every run writes the same files. A file is written under a
temporary name that holds the task attempt, then renamed to a name that depends only on the range and the roll number;
the job's manifest, written last, lists files, sizes, record counts and digests. A reader takes the manifest's files
alone, so leftovers of lost attempts are never read, and a repeated task writes the same bytes again.

Payloads of at least `min_revisit` bytes that are equal are stored once: the record of the largest page id is a
response, the others are revisit records that refer to it.

Edge cases: a null payload is the empty payload; null urls become urn:page:<id>; rows without a page id are left out;
rows of equal page id and payload are each written, of which one is the response. Line breaks in urls are
percent-encoded. Very long payloads are one record, and its file rolls after it. An empty table writes an empty manifest.
Extra columns are ignored. All rows of one page id are in one range, and so pass through one task, which streams them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, drop, fresh_path, saved

#: Records carry this date, so that equal inputs give equal bytes.
DATE = "2000-01-01T00:00:00Z"
ROLL_BYTES = 32 << 20
#: Payload bytes of a range, and how many ranges there are at least (if there are records for them) and at most.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 256 << 20, 32, 1 << 16
#: Ids drawn for each range to find its bounds.
DRAWN = 32
#: Payloads of more pages than this, or than 1 / HOT_SHARE of all, are looked up by broadcast: at most HOT_SHARE payloads.
HOT, HOT_SHARE = 100_000, 10_000
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, file string"


def file_system(path: str):
    """Any store that pyarrow reaches: local or shared folders, HDFS, S3, GCS."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {payload_digest}')}>"


def member(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    own = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, own)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{own}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Page-ID: {page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[7:7] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, own)}", f"X-Refers-To-Page: {refers_to}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(data: bytes, step: int = 8192) -> Iterator[bytes]:
    """The records of a file, one gzip member after the other; fed in small steps, as each member's rest is copied."""
    view, pos = memoryview(data), 0
    while pos < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            piece = view[pos : pos + step]
            if not piece:
                raise ValueError("a truncated archive")
            parts.append(z.decompress(piece))
            pos += len(piece)
        pos -= len(z.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Fields of one record; the block digest is verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(h["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or "sha1:" + digest(block) != h["WARC-Block-Digest"]:
        raise ValueError("a damaged WARC record: " + h["WARC-Record-ID"])
    payload = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
    own = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and digest(payload) != own:
        raise ValueError("a damaged payload: " + h["WARC-Record-ID"])
    return {
        "page_id": int(h["X-Page-ID"]),
        "url": h["WARC-Target-URI"],
        "record_type": h["WARC-Type"],
        "refers_to": int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None,
        "payload_digest": own,
        "payload_bytes": int(h["X-Payload-Length"]),
        "payload": payload,
    }


def decisions(pages: DataFrame, min_revisit: int) -> DataFrame:
    """(page_id, payload digest as hex, n, refers_to, shared): per distinct page and payload, whom it refers to."""
    groups = saved(pages.groupBy("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n")).agg(F.count("*").alias("rows")), "payloads")
    large = F.col("n") >= min_revisit
    repeated = groups.where(large).groupBy("sha", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("k")).where("k > 1")
    repeated = saved(repeated, "repeated")
    # a payload that many pages share would meet in one task: the few such payloads are broadcast, the rest is shuffled
    limit = max(HOT, groups.count() // HOT_SHARE)
    hot = repeated.where(F.col("k") > limit).select("sha", "n", F.col("last").alias("hot"))  # fewer than HOT_SHARE rows
    cold = repeated.where(F.col("k") <= limit).select(F.col("sha").alias("key"), F.col("n").alias("key_n"), F.col("last").alias("cold"))
    marked = groups.join(F.broadcast(hot), ["sha", "n"], "left")
    own = F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.concat(F.lit("page "), F.col("page_id").cast("string")))
    joined = marked.withColumn("own", own).join(cold.hint("merge"), (F.col("own") == cold["key"]) & (F.col("n") == cold["key_n"]), "left")
    last = F.coalesce("hot", "cold")
    return joined.select("page_id", "sha", F.when(last != F.col("page_id"), last).alias("refers_to"), large.alias("shared"))


def cut_points(rows: DataFrame) -> list[int]:
    """The first page ids of all ranges but the first: a function of the rows alone, with at most MOST_RANGES values."""
    head = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("payload").cast("long")).alias("bytes")).first()
    ranges = min(MOST_RANGES, max(-(-(head.bytes or 0) // RANGE_BYTES), min(LEAST_RANGES, -(-head.n // 128))))
    if ranges < 2:
        return []
    every = max(1, head.n // (DRAWN * ranges))
    drawn = rows.where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).select("page_id").distinct().orderBy("page_id").toPandas()  # about DRAWN ids a range
    ids = drawn["page_id"].tolist()
    return sorted({ids[i * len(ids) // ranges] for i in range(1, ranges)}) if ids else []


def range_of(page_id: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below the id, by binary search."""
    found = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")

    def halve(a, _):
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        inside, right = a["low"] < a["high"], F.coalesce(F.get(found, middle) <= page_id, F.lit(False))
        return F.struct(F.when(inside & right, middle + 1).otherwise(a["low"]).alias("low"), F.when(inside & ~right, middle).otherwise(a["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")), halve, lambda a: a["low"])


def _write(root: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        task = TaskContext.get()
        state = {"part": [], "size": 0, "records": 0, "roll": 0}
        done = []
        own = 0

        def close():
            data = b"".join(state["part"])
            name = f"part-{own:06d}-{state['roll']:04d}.warc.gz"
            temporary = f"{base}/_temporary/{name}.{task.taskAttemptId()}"
            fs.create_dir(f"{base}/_temporary", recursive=True)
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            fs.move(temporary, f"{base}/{name}")
            done.append((name, state["records"], len(data), hashlib.sha256(data).hexdigest()))
            state.update(part=[], size=0, records=0, roll=state["roll"] + 1)

        before = page = None
        told: dict[str, tuple] = {}
        for b in batches:
            for of, page_id, kind, url, payload, sha, last, shared in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != own:
                    if state["records"]:
                        close()
                    own, state["roll"] = of, 0
                if page_id != page:
                    page, told = page_id, {}
                if kind == 0:
                    told[sha] = (last, shared)
                    continue
                refers_to, shared = told[hashlib.sha1(payload).hexdigest()]
                here = (page_id, payload)
                if shared and refers_to is None and here == before:  # a repeated row: it refers to the row before
                    refers_to = page_id
                before = here
                m = member(page_id, url, payload, refers_to)
                state["part"].append(m)
                state["size"] += len(m)
                state["records"] += 1
                if state["size"] >= roll:
                    close()
        if state["records"]:
            close()
        cols = list(zip(*done, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["file", "records", "bytes", "sha256"])

    return run


def write_warc(pages: DataFrame, root: str, min_revisit: int = 0, roll: int = ROLL_BYTES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one record a row below `root` and return the manifest, which is written there as well."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.where(pages[key].isNotNull()).select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), F.coalesce(pages[html].cast("binary"), F.lit("").cast("binary")).alias("payload"))
    told = saved(decisions(rows, min_revisit), "warc-decisions")
    # decisions travel with the records, before those of their page, so that payloads are shuffled once
    none = lambda kind: F.lit(None).cast(kind)
    records = rows.select("page_id", F.lit(1).alias("kind"), "url", "payload", none("string").alias("sha"), none("long").alias("refers_to"), none("boolean").alias("shared"))
    both = records.union(told.select("page_id", F.lit(0), none("string"), none("binary"), "sha", "refers_to", "shared"))
    cuts = cut_points(rows)
    ranged = both.select(range_of(F.col("page_id"), cuts).alias("range"), "*")
    ordered = ranged.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "page_id", "kind", "payload", "url")
    ordered.mapInArrow(_write(root, roll), MANIFEST).write.mode("overwrite").json(f"{root}/_manifest")
    drop(told)
    return spark.read.schema(MANIFEST).json(f"{root}/_manifest")


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """RECORDS of the archives that the manifest of `root` lists; each file's and record's digest is verified."""
    bounded_batches(spark)
    manifest = spark.read.schema(MANIFEST).json(f"{root}/_manifest")
    names = [f.name for f in T._parse_datatype_string(RECORDS).fields]
    types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(root)
    listed = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(manifest.select("file", "sha256"), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types.get(k, pa.string())) for k in names], names)

        for b in batches:
            for name, content, sha in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError("a damaged archive: " + name)
                rows, held = [], 0
                for raw in members(content):
                    rows.append(parse(raw) | {"file": name})
                    held += len(raw)
                    if held > 8 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    return listed.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write `pages` to a new folder of the shared directory and read its records back."""
    spark = pages.sparkSession
    root = fresh_path(spark, "warc")
    write_warc(pages, root, **options)
    return read_warc(spark, root)
